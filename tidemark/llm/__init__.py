"""Operators for preparing training corpora.

Nothing outside this package imports it. ``registry`` holds the queries and
their SQL; each operator has a module of its own with a general interface.
"""
