"""Reviewed plans: TOML on the driver, small tables in Spark."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.session import BROADCAST_ROWS


class PlanError(ValueError):
    """The plan cannot be used."""


@dataclass(frozen=True)
class Plan:
    """A plan; ``object`` is '' where overrides hold for every object."""

    scope: list[str] = field(default_factory=list)
    overrides: dict[tuple[str, str], str] = field(default_factory=dict)
    reasons: dict[tuple[str, str], str] = field(default_factory=dict)
    known_fields: set[tuple[str, str]] = field(default_factory=set)

    def _table(self, spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
        frame = spark.createDataFrame(rows, schema)
        return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame

    def override_table(self, spark: SparkSession) -> DataFrame:
        rows = [(o, f, a) for (o, f), a in self.overrides.items()]
        return self._table(spark, rows, "object string, field string, action string")

    def reason_table(self, spark: SparkSession) -> DataFrame:
        rows = [(o, f, t) for (o, f), t in self.reasons.items()]
        return self._table(spark, rows, "object string, field string, text string")

    def known_table(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, sorted(self.known_fields), "object string, field string")


def _load(path: str | Path) -> dict:
    try:
        return tomllib.loads(Path(path).read_text(encoding="utf-8"))
    except tomllib.TOMLDecodeError as error:
        raise PlanError(f"{path} is not valid TOML: {error}") from error


def _check(overrides: dict[tuple[str, str], str], allowed: tuple[str, ...]) -> None:
    for key, action in overrides.items():
        if action not in allowed:
            raise PlanError(f"override {'.'.join(k for k in key if k)}: {action!r} is not one of {sorted(allowed)}")


def _per_object(section: dict | None) -> dict[tuple[str, str], str]:
    return {
        (str(obj), str(name)): str(value)
        for obj, fields in (section or {}).items()
        if isinstance(fields, dict)
        for name, value in fields.items()
    }


def load_records_plan(path: str | Path) -> Plan:
    """``[scope] objects``, ``[overrides.X]``, ``[reasons.X]``, ``[known_fields]``."""
    data = _load(path)
    overrides = _per_object(data.get("overrides"))
    _check(overrides, rules.RECORD_ACTIONS)
    known = {
        (str(obj), str(name))
        for obj, names in (data.get("known_fields") or {}).items()
        if isinstance(names, list)
        for name in names
    }
    return Plan([str(o) for o in data.get("scope", {}).get("objects", [])], overrides, _per_object(data.get("reasons")), known)


def load_event_plan(path: str | Path) -> Plan:
    """Overrides by column; names and actions are read in any case."""
    data = _load(path)
    overrides = {("", str(k).upper()): str(v).upper() for k, v in (data.get("overrides") or {}).items()}
    _check(overrides, rules.EVENT_ACTIONS)
    reasons = {("", str(k).upper()): str(v) for k, v in (data.get("reasons") or {}).items()}
    return Plan([str(t) for t in data.get("scope", {}).get("event_types", [])], overrides, reasons)


def load_technical_plan(path: str | Path) -> Plan:
    """Overrides by ``"Object.Field"``; actions are read in any case."""
    data = _load(path)

    def split(key: str) -> tuple[str, str]:
        obj, _, name = str(key).partition(".")
        return obj, name

    overrides = {split(k): str(v).upper() for k, v in (data.get("overrides") or {}).items()}
    _check(overrides, rules.TECHNICAL_ACTIONS)
    reasons = {split(k): str(v) for k, v in (data.get("reasons") or {}).items()}
    return Plan([str(o) for o in data.get("scope", {}).get("objects", [])], overrides, reasons)


def _quoted(names: list[str]) -> str:
    return "[" + ", ".join('"' + n.replace("\\", "\\\\").replace('"', '\\"') + '"' for n in names) + "]"


def records_plan_text(rows: list[tuple[str, str, str, str, bool]]) -> str:
    """Plan text of ONE scope from (object, field, action, reason, special)."""
    objects = list(dict.fromkeys(row[0] for row in rows))
    out = ["# Reviewed plan: set actions under [overrides.*] and say why under [reasons.*].", ""]
    out += ["[scope]", f"objects = {_quoted(objects)}", ""]
    for obj in objects:
        for _, name, action, reason, special in (r for r in rows if r[0] == obj):
            out.append(f"# {name}: {action} - {reason}{' [SPECIAL]' if special else ''}")
        out += [f"[overrides.{obj}]", "", f"[reasons.{obj}]", ""]
    out.append("[known_fields]")
    out += [f"{obj} = {_quoted([r[1] for r in rows if r[0] == obj])}" for obj in objects]
    return "\n".join(out) + "\n"


def tagged_plan_text(scope_name: str, scope: list[str], tags: list[tuple[str, str]]) -> str:
    """Plan text for event logs (column, tag) or technical objects (object.field, tag)."""
    out = ["# Reviewed plan: a more exposing override needs a line under [reasons].", ""]
    out += ["[scope]", f"{scope_name} = {_quoted(sorted(scope))}", ""]
    out += [f"# {name}: {tag}" for name, tag in tags]
    return "\n".join([*out, "", "[overrides]", "", "[reasons]", ""])
