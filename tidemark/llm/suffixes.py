"""Suffix arrays by the linear grouping construction over Lyndon prefixes.

First phase: suffixes start in groups by their first symbol. Groups are taken in
descending order. All suffixes of a group begin with the same Lyndon word u, and
what follows a smaller suffix p directly is a run of k copies of u exactly if k
members of the group have p as their previous smaller suffix. So p's known
prefix grows by u^k: p moves to a new group just above its old one, higher for
larger k. A member finds its previous smaller suffix by following the pointers
of the larger, finished suffixes before it.

Second phase: groups now hold suffixes with the same longest Lyndon prefix, in
order. Reading the array from its start, each suffix puts the suffix before it,
and those its pointers lead to, at the next free place of their groups: each
group fills in order, and nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, previous smaller pointer of each, groups in ascending order).

    ``symbols`` are not negative; the text is taken to end with a smaller symbol.
    """
    n = len(symbols)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        if c in by_symbol:
            by_symbol[c].append(i)
        else:
            by_symbol[c] = [i]
    of, members = [0] * n, []
    for g, c in enumerate(sorted(by_symbol)):
        for i in by_symbol[c]:
            of[i] = g
        members.append(by_symbol[c])
    # Groups are a list linked both ways; -1 ends it.
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    size = [len(m) for m in members]
    previous, done = [-1] * n, [False] * n
    group, descending = len(members) - 1, []
    while group >= 0:
        if size[group]:
            descending.append(group)
            # Suffixes that moved on are still listed; ``of`` tells.
            here = members[group]
            if len(here) != size[group]:
                here = [s for s in here if of[s] == group]
            if len(here) > 1:
                here.sort()
            copies: dict[int, int] = {}
            for s in here:
                p = s - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                if p >= 0 and of[p] == group:
                    # A copy of u directly before this one: both belong to the same run.
                    p = previous[p]
                previous[s] = p
                if p >= 0:
                    copies[p] = copies.get(p, 0) + 1
            for s in here:
                done[s] = True
            members[group] = None
            moves: dict[tuple[int, int], list[int]] = {}
            for p, k in copies.items():
                key = (of[p], k)
                if key in moves:
                    moves[key].append(p)
                else:
                    moves[key] = [p]
            # More copies are larger: with the largest last, each is put right above its old group.
            for old, k in sorted(moves, key=lambda x: -x[1]) if len(moves) > 1 else moves:
                moved = moves[old, k]
                if len(moved) == size[old]:
                    # The whole group grows alike (what was above it has been put there before).
                    continue
                fresh, over = len(members), above[old]
                members.append(moved)
                size.append(len(moved))
                size[old] -= len(moved)
                below.append(old)
                above.append(over)
                above[old] = fresh
                if over >= 0:
                    below[over] = fresh
                for p in moved:
                    of[p] = fresh
        group = below[group]
    return of, previous, descending[::-1]


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` (not negative) in lexicographic order, shorter before longer."""
    n = len(symbols)
    of, previous, ascending = lyndon_groups(symbols)
    counts = np.bincount(np.array(of, np.int64), minlength=max(ascending, default=-1) + 1) if n else np.zeros(0, np.int64)
    free, at = [0] * len(counts), 0
    for g in ascending:
        free[g] = at
        at += int(counts[g])
    out, placed = [0] * n, [False] * n

    def place(p: int) -> None:
        while p >= 0 and not placed[p]:
            g = of[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = previous[p]

    place(n - 1)
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not placed[p]:
            g = of[p]
            out[free[g]] = p
            free[g] += 1
            placed[p] = True
            p = previous[p]
    return out
