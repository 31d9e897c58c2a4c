"""Applying resolved actions to tables."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions.masking import apply_action, derive_recipe_of
from hushframe.functions.text import as_text


@dataclass(frozen=True)
class ColumnAction:
    """What happens to one column."""

    name: str
    action: str
    recipe: str = ""
    source: str = "default"
    downgraded: bool = False
    type: str = ""
    special_category: bool = False
    reason: str = ""

    @property
    def kept(self) -> bool:
        if self.action == rules.DERIVE:
            return bool(self.recipe)
        return self.action != rules.DROP


@dataclass(frozen=True)
class ClassifiedFrame:
    """A masked table together with the actions that made it.

    Sinks accept nothing else, so no table can be written unaudited.
    """

    name: str
    frame: DataFrame
    actions: tuple[ColumnAction, ...]

    def audit(self) -> DataFrame:
        return action_table(self.frame.sparkSession, self.name, self.actions)


def read_actions_by_object(resolved: DataFrame, objects: list[str]) -> dict[str, list[ColumnAction]]:
    """Action rows (object, field, action, ...) of some objects, in one job.

    Rows come in ``position`` order if there is one.  They are one per column of
    tables whose schemas the driver holds anyway, to build their projections.
    """
    rows = _in_order(resolved.where(F.col("object").isin(objects)))
    out: dict[str, list[ColumnAction]] = {name: [] for name in objects}
    for row in rows:
        out[row["object"]].append(_action(row, "field"))
    return out


def read_actions(resolved: DataFrame, name: str = "column") -> list[ColumnAction]:
    """Action rows of one header."""
    return [_action(row, name) for row in _in_order(resolved)]


def _in_order(resolved: DataFrame) -> list[Row]:
    return (resolved.orderBy("position") if "position" in resolved.columns else resolved).collect()


def _action(row: Row, name: str) -> ColumnAction:
    known = ColumnAction.__dataclass_fields__
    values = {k: v for k, v in row.asDict().items() if k in known and v is not None}
    return ColumnAction(**{**values, "name": row[name]})


def mask(frame: DataFrame, actions: Iterable[ColumnAction], key: str | None = "Id") -> DataFrame:
    """Project kept columns in order and transform them.

    Dropped columns are never selected, so the scan does not read them.  Names are
    matched as Spark resolves them, without regard to case, and shown as audited.
    When nothing is kept only the key column stays; without a key the result has
    neither columns nor rows.
    """
    found = {c.lower(): c for c in frame.columns}
    kept = [a for a in actions if a.kept and a.name.lower() in found]
    if not kept:
        return frame.select(key) if key else frame.limit(0).select()
    types = dict(frame.dtypes)
    return frame.select(
        *[
            apply_action(F.col(f"`{found[a.name.lower()]}`"), a.action, a.recipe, types[found[a.name.lower()]]).alias(a.name)
            for a in kept
        ]
    )


def as_cells(frame: DataFrame) -> DataFrame:
    """All columns as the text a file would show."""
    return frame.select(*[as_text(F.col(f"`{n}`"), t).alias(n) for n, t in frame.dtypes])


def action_table(spark: SparkSession, name: str, actions: Iterable[ColumnAction]) -> DataFrame:
    """Audit rows of one table, dropped columns included."""
    rows = [
        (
            name,
            position,
            a.name,
            a.type,
            a.action if a.kept or a.action == rules.DROP else rules.DROP,
            a.recipe,
            a.source,
            a.special_category,
            a.downgraded,
            a.reason,
        )
        for position, a in enumerate(actions)
    ]
    schema = (
        "object string, position int, field string, type string, action string, recipe string, "
        "source string, special_category boolean, downgraded boolean, reason string"
    )
    return spark.createDataFrame(rows, schema)


def long_cells(frame: DataFrame, object_name: str, keys: tuple[str, ...]) -> DataFrame:
    """Wide rows as (keys, object, field, value) cells."""
    columns = [c for c in frame.columns if c not in keys]
    texts = as_cells(frame.select(*columns)).columns
    cells = frame.select(
        *keys,
        *[as_text(F.col(f"`{c}`"), dict(frame.dtypes)[c]).alias(c) for c in texts],
    )
    return cells.unpivot(list(keys), columns, "field", "value").withColumn("object", F.lit(object_name))


def record_action(name: str, action: str, **extra) -> ColumnAction:
    """Action of a business field; DERIVE takes its recipe from the name."""
    recipe = (derive_recipe_of(name) or "") if action == rules.DERIVE else ""
    return ColumnAction(name=name, action=action, recipe=recipe, **extra)
