"""Joining a reviewed plan to the classification.

A plan reaches Spark as three tables: ``overrides(object, field, action)``,
``reasons(object, field, text)`` and ``known_fields(object, field)``.  They are
joined on their keys.  Tables made from a plan file are tiny and carry a
broadcast hint (see ``Plan``); tables that come from elsewhere carry none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions.masking import derive_recipe

RECORD_KEYS = ("object", "field")


def _lookup(side: DataFrame, keys: tuple[str, ...], value: str, alias: str) -> DataFrame:
    """One row per key, so a plan that repeats a key cannot multiply fields."""
    return side.groupBy(*keys).agg(F.max(value).alias(alias))


def _with_plan(
    fields: DataFrame, overrides: DataFrame | None, reasons: DataFrame | None, keys: tuple[str, ...]
) -> DataFrame:
    """Fields with ``_override`` and ``_given``; no join without a plan."""
    nothing = F.lit(None).cast("string")
    if overrides is None or reasons is None:
        return fields.withColumn("_override", nothing).withColumn("_given", nothing)
    wanted = _lookup(overrides, keys, "action", "_override")
    given = _lookup(reasons, keys, "text", "_given")
    return fields.join(wanted, list(keys), "left").join(given, list(keys), "left")


def _asked(override: Column) -> Column:
    return F.when(override == rules.KEEP, rules.PASS).otherwise(override)


def exposure(action: Column) -> Column:
    """0 shows nothing, 3 shows the raw value."""
    chain = F
    for name, rank in rules.EXPOSURE.items():
        chain = chain.when(action == name, rank)
    return chain


def resolve_records(
    fields: DataFrame,
    overrides: DataFrame | None,
    reasons: DataFrame | None,
    keys: tuple[str, ...] = RECORD_KEYS,
) -> DataFrame:
    """Effective action of classified business fields.

    Showing a special-category field needs a reason; without one the field is
    dropped and flagged.
    """
    joined = _with_plan(fields, overrides, reasons, keys)
    asked = _asked(F.col("_override"))
    unjustified = F.col("special_category") & (asked != rules.DROP) & (F.coalesce("_given", F.lit("")) == "")
    downgraded = F.col("_override").isNotNull() & F.coalesce(unjustified, F.lit(False))
    effective = F.when(downgraded, rules.DROP).otherwise(F.coalesce(asked, F.col("action")))
    text = (
        F.when(F.col("_override").isNull(), F.col("reason"))
        .when(downgraded, F.concat(F.lit("override without reason, dropped: "), asked))
        .when(F.col("special_category") & (asked != rules.DROP), F.concat(F.lit("override, justified: "), F.col("_given")))
        .otherwise(F.concat(F.lit("override: "), asked))
    )
    kept = [c for c in fields.columns if c not in ("action", "reason")]
    return joined.select(
        *kept,
        effective.alias("action"),
        F.when(effective == rules.DERIVE, derive_recipe(F.col("field"))).alias("recipe"),
        text.alias("reason"),
        F.when(F.col("_override").isNull(), "default").otherwise("override").alias("source"),
        downgraded.alias("downgraded"),
    )


def applied_action(resolved: DataFrame) -> DataFrame:
    """DERIVE without a recipe counts, and is treated, as DROP."""
    return resolved.withColumn(
        "action",
        F.when((F.col("action") == rules.DERIVE) & (F.coalesce("recipe", F.lit("")) == ""), rules.DROP).otherwise(
            F.col("action")
        ),
    ).withColumn("recipe", F.coalesce("recipe", F.lit("")))


def resolve_exposure(
    fields: DataFrame, overrides: DataFrame | None, reasons: DataFrame | None, keys: tuple[str, ...]
) -> DataFrame:
    """Effective action where any more exposing override needs a reason.

    Event logs join on the column name, technical objects on object and field.
    The recipe survives an override that keeps the action it belongs to.
    """
    joined = _with_plan(fields, overrides, reasons, keys)
    asked = _asked(F.col("_override"))
    unjustified = (exposure(asked) > exposure(F.col("action"))) & (F.coalesce("_given", F.lit("")) == "")
    downgraded = F.coalesce(unjustified, F.lit(False))
    effective = F.when(downgraded | asked.isNull(), F.col("action")).otherwise(asked)
    recipe = F.when(effective == F.col("action"), F.col("recipe")).when(effective == rules.HASH, "id").otherwise("")
    kept = [c for c in fields.columns if c not in ("action", "recipe")]
    return joined.select(
        *kept,
        effective.alias("action"),
        recipe.alias("recipe"),
        F.when(F.col("_override").isNull(), "default").otherwise("override").alias("source"),
        downgraded.alias("downgraded"),
    )


def event_key(name: Column) -> Column:
    """Spelling-independent key of an event-log column."""
    return F.upper(F.btrim(name, F.lit(rules.WHITESPACE)))


def drift(fields: DataFrame, known: DataFrame, keys: tuple[str, ...] = RECORD_KEYS) -> DataFrame:
    """Fields the plan has never seen."""
    return fields.join(known.select(*keys).distinct(), list(keys), "left_anti")


def invalid_actions(overrides: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Override rows whose action does not exist; must be empty."""
    return overrides.where(~F.coalesce("action", F.lit("")).isin(*allowed))


def plan_rows(classified: DataFrame) -> DataFrame:
    """A plan as rows: scope and known fields with what is recommended."""
    recipe = F.col("recipe") if "recipe" in classified.columns else F.lit("")
    return classified.select(
        "object",
        "field",
        F.concat(F.col("action"), F.when(recipe != "", F.concat(F.lit("/"), recipe)).otherwise("")).alias("recommended"),
    )


def first_tag_per_column(columns: DataFrame) -> DataFrame:
    """Distinct columns over all event types with the tag of the first type."""
    tag = F.concat(F.col("action"), F.when(F.col("recipe") != "", F.concat(F.lit("/"), F.col("recipe"))).otherwise(""))
    return columns.groupBy("column").agg(F.min_by(tag, F.col("event_type")).alias("tag"))


def tally(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
