"""Audit rows, tallies and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def action_counts(audit: DataFrame, *keys: str) -> DataFrame:
    """Fields per action over ALL fields of each object."""
    return audit.groupBy(*keys, "action").agg(F.count(F.lit(1)).alias("fields"))


def column_action_counts(columns: DataFrame) -> DataFrame:
    """Distinct columns per action of an event-log run."""
    return columns.select("column", "action").distinct().groupBy("action").agg(F.count(F.lit(1)).alias("columns"))


def kept_columns(audit: DataFrame, *keys: str) -> DataFrame:
    return audit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fields"), F.count_if(F.col("action") != "DROP").alias("columns")
    )


def flagged_fields(resolved: DataFrame, drifted: DataFrame, *keys: str) -> DataFrame:
    """Downgraded and drifted fields as (keys, kind, field) rows."""
    down = resolved.where("downgraded").select(*keys, F.lit("downgraded").alias("kind"), "field")
    return down.union(drifted.select(*keys, F.lit("drift").alias("kind"), "field"))


def record_audit(resolved: DataFrame) -> DataFrame:
    """The nine audit columns of business objects."""
    return resolved.select(
        "object", "field", "type", "action", "recipe", "source", "special_category", "downgraded", "reason"
    )


def where_row(audit: DataFrame, predicate: str) -> DataFrame:
    """Audit plus one row that records the narrowing predicate."""
    row = [("*", "__where__", "", "WHERE", "", "operator", False, False, predicate)]
    return audit.union(audit.sparkSession.createDataFrame(row, audit.schema))


def event_audit(columns: DataFrame) -> DataFrame:
    """Per column: action, recipe, source, downgraded, and where it was seen.

    The event types of a column are a closed vocabulary, so the set is small.
    """
    return columns.groupBy("column").agg(
        F.min("action").alias("action"),
        F.min("recipe").alias("recipe"),
        F.min("source").alias("source"),
        F.bool_or("downgraded").alias("downgraded"),
        F.array_sort(F.collect_set("event_type")).alias("event_types"),
    )


def technical_audit(resolved: DataFrame) -> DataFrame:
    return resolved.select("object", F.col("field").alias("column"), "type", "action", "recipe", "source", "downgraded")


def json_document(**parts: Column) -> Column:
    """A JSON object with keys in name order."""
    return F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"})


def record_summary(audit: DataFrame, rows: DataFrame) -> DataFrame:
    """One JSON document per object.

    Lists hold fields of one object, which the schema bounds.
    """
    field = F.struct("position", "field")
    per_action = action_counts(audit, "object").groupBy("object").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "fields")))).alias("action_counts")
    )
    columns = audit.groupBy("object").agg(
        F.array_sort(F.collect_list(F.when(F.col("action") != "DROP", field)))["field"].alias("columns"),
        F.array_sort(F.collect_list(F.when(F.col("downgraded"), F.col("field")))).alias("downgraded"),
    )
    joined = per_action.join(columns, "object").join(rows, "object")
    return joined.select(
        "object",
        json_document(
            rows_out=F.col("rows_out"),
            columns=F.col("columns"),
            action_counts=F.col("action_counts"),
            downgraded=F.col("downgraded"),
        ).alias("summary"),
    )


def object_summaries(audit: DataFrame, *keys: str) -> DataFrame:
    """One JSON document per technical object: kept columns and action counts."""
    per_action = action_counts(audit, *keys)
    entry = F.struct("action", "fields")  # six actions at most
    return per_action.groupBy(*keys).agg(
        json_document(
            columns=F.sum(F.when(F.col("action") != "DROP", F.col("fields")).otherwise(0)),
            action_counts=F.map_from_entries(F.array_sort(F.collect_list(entry))),
        ).alias("summary")
    )


def technical_summary(audit: DataFrame, rows: DataFrame, skipped: DataFrame, limit: int | None) -> DataFrame:
    """One JSON document of a run: per object rows, kept columns and action counts; the skips; the limit.

    Objects come from the closed catalogue, so the lists are short.
    """
    per_action = action_counts(audit, "object").groupBy("object").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "fields")))).alias("action_counts"),
        F.sum(F.when(F.col("action") != "DROP", F.col("fields")).otherwise(0)).alias("columns"),
    )
    done = per_action.join(rows, "object").select("object", F.col("n_rows").alias("rows"), "columns", "action_counts")
    parts = done.unionByName(skipped.select("object", "reason"), allowMissingColumns=True)

    def listed(kept: Column, *names: str) -> Column:
        found = F.collect_list(F.when(kept, F.struct(*names)))
        return F.array_sort(found, lambda a, b: F.when(a["object"] < b["object"], -1).when(a["object"] > b["object"], 1).otherwise(0))

    return parts.agg(
        listed(F.col("reason").isNull(), "object", "rows", "columns", "action_counts").alias("objects"),
        listed(F.col("reason").isNotNull(), "object", "reason").alias("skipped"),
    ).select(json_document(objects=F.col("objects"), skipped=F.col("skipped"), limit=F.lit(limit).cast("int")).alias("summary"))


def success_counts(outcomes: DataFrame) -> DataFrame:
    """Objects that worked and that were skipped."""
    return outcomes.agg(
        F.count_if("ok").alias("succeeded"),
        F.count_if(~F.col("ok")).alias("skipped"),
        (F.count_if("ok") > 0).alias("publishable"),
    )
