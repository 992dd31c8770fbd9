"""Versioned event schemas: validation, compatibility, registry, normalisation.

Fixed field lists of the two event versions and the two result versions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name: (type, required)
EVENT_V1 = {"event_id": ("string", True), "event_time": ("number", True), "status": ("integer", True), "schema_version": ("integer", True), "payload": ("object", False)}
EVENT_V2 = {"event_id": ("string", True), "event_time": ("number", True), "http_status": ("integer", True), "service_name": ("string", True), "schema_version": ("integer", True), "payload": ("object", False)}
RESULT_V1 = {"window_id": ("string", True), "partition_id": ("integer", True), "window_start": ("number", True), "window_end": ("number", True), "count": ("integer", True), "status_500": ("integer", True)}
RESULT_V2 = {**RESULT_V1, "target_sla": ("number", False)}
EVENT_ANY = "event_id string, event_time double, status int, http_status int, service_name string, schema_version int, payload map<string,string>"
LEGACY_SERVICE = "legacy-service"
MODES = ("v1_only", "dual_emit", "dual_consume", "switch_primary", "drop_legacy")

_KIND = {"string": str, "number": (int, float), "object": dict, "array": list, "boolean": bool}
_VARIANT = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def valid_event(event: dict, schema: dict) -> list[str]:
    """What is wrong with an event; nothing: it is valid."""
    wrong = [f"missing {k}" for k, (_, required) in schema.items() if required and event.get(k) is None]
    for k, (kind, _) in schema.items():
        v = event.get(k)
        if v is None:
            continue
        good = isinstance(v, int) and not isinstance(v, bool) if kind == "integer" else isinstance(v, _KIND[kind])
        if not good:
            wrong.append(f"{k} is not {kind}")
    return wrong


def valid_json(text: Column, schema: dict) -> Column:
    """The same rules on a JSON column, in the JVM; text that is no JSON object is not valid."""
    v = F.try_parse_json(text)
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    for k, (kind, required) in schema.items():
        of = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
        missing = of.isNull() | (of == "VOID")
        typed = F.lit(False)
        for name in _VARIANT[kind]:
            typed = typed | of.startswith(name)
        ok = ok & F.when(missing, F.lit(not required)).otherwise(typed)
    return F.coalesce(ok, F.lit(False))


def incompatibilities(old: dict, new: dict) -> list[str]:
    """Why readers of ``old`` could not read ``new``: required field gone or new, or a type changed."""
    out = [f"required {k} removed" for k, (_, r) in old.items() if r and k not in new]
    out += [f"{k} changed type" for k in old if k in new and old[k][0] != new[k][0]]
    out += [f"required {k} added" for k, (_, r) in new.items() if r and k not in old]
    return out


@dataclass
class Registry:
    """Subjects with versions and global ids; registering a known schema gives its id again."""

    subjects: dict[str, list[tuple[int, dict]]] = field(default_factory=dict)
    last_id: int = 0

    def register(self, subject: str, schema: dict) -> tuple[int, list[str]]:
        versions = self.subjects.setdefault(subject, [])
        for number, known in versions:
            if known == schema:
                return number, []
        warned = incompatibilities(versions[-1][1], schema) if versions else []
        self.last_id += 1
        versions.append((self.last_id, schema))
        return self.last_id, warned

    def latest(self, subject: str) -> dict | None:
        versions = self.subjects.get(subject)
        return versions[-1][1] if versions else None


def normalised(rows: DataFrame) -> DataFrame:
    """Both versions with all fields of both: status from http_status and the other way round."""
    return rows.withColumns(
        {
            "status": F.coalesce("status", "http_status"),
            "http_status": F.coalesce("http_status", "status"),
            "service_name": F.coalesce("service_name", F.lit(LEGACY_SERVICE)),
            "schema_version": F.coalesce("schema_version", F.lit(1)),
        }
    )


def emitted(rows: DataFrame, mode: str) -> DataFrame:
    """Rows of normalised events as a migration mode emits them: version 1, version 2, or both."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    v1 = rows.withColumn("schema_version", F.lit(1)).drop("http_status", "service_name")
    v2 = rows.withColumn("schema_version", F.lit(2)).drop("status")
    if mode == "v1_only":
        return v1
    if mode in ("switch_primary", "drop_legacy"):
        return v2
    return v1.unionByName(v2, allowMissingColumns=True)
