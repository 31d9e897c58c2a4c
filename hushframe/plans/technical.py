"""Technical objects: scope, select, classify, mask, tolerate single failures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators import audit as audits
from hushframe.operators.classify import classify_technical, selectable
from hushframe.operators.gates import check_values
from hushframe.operators.mask import ClassifiedFrame, mask, read_actions_by_object
from hushframe.operators.resolve import resolve_exposure, union_all
from hushframe.sinks.publish import TABLE_ERRORS, Publication
from hushframe.sinks.text import check_header
from hushframe.sources.planfile import Plan, tagged_plan_text

SENTINEL = "field_handling"
SUMMARY = "summary"
SKIP_COLUMNS = "object string, reason string"


def scope(only: list[str] | None, plan: Plan | None) -> list[str]:
    """Explicit objects, else the plan's, else all 40; unknown names stop the run."""
    known = [name for name, _ in rules.CATALOGUE]
    names = list(only or (plan.scope if plan else []) or known)
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown objects {unknown}; known are {known}")
    return names


def resolve_fields(fields: DataFrame, plan: Plan | None = None, keys: tuple[str, ...] = ("object", "field")) -> DataFrame:
    """Effective action per technical field (object, name, type, queryable)."""
    classified = classify_technical(selectable(fields)).withColumnRenamed("name", "field")
    if plan is None:
        return resolve_exposure(classified, None, None, keys)
    spark = fields.sparkSession
    return resolve_exposure(classified, plan.override_table(spark), plan.reason_table(spark), keys)


def preview(fields: DataFrame, plan: Plan | None = None) -> DataFrame:
    resolved = resolve_fields(fields, plan)
    return resolved.groupBy("object", "action").agg(F.count(F.lit(1)).alias("fields"))


def plan_text(fields: DataFrame, objects: list[str]) -> str:
    rows = resolve_fields(fields.where(F.col("object").isin(objects))).orderBy("object", "field").collect()
    tags = [(f"{r['object']}.{r['field']}", r["action"] + (f"/{r['recipe']}" if r["recipe"] else "")) for r in rows]
    return tagged_plan_text("objects", objects, tags)


def _limited(table: DataFrame, limit: int | None, order: str) -> DataFrame:
    if limit is None:
        return table
    return table.orderBy(order).limit(limit) if order in table.columns else table.limit(limit)


def extract(
    spark: SparkSession,
    open_table: Callable[[str], DataFrame],
    fields: DataFrame,
    objects: list[str],
    plan: Plan | None = None,
    limit: int | None = None,
    order: str = "Id",
) -> tuple[list[ClassifiedFrame], DataFrame]:
    """(masked tables, skip rows).  One object's failure skips that object.

    An object whose fields all drop is a table without columns and rows.  A failure
    of every object ends the run.
    """
    per_object = read_actions_by_object(resolve_fields(fields, plan), objects)
    done, skipped = [], []
    for name in objects:
        try:
            table = _limited(open_table(name), limit, order)
            actions = per_object[name]
            if not actions:
                raise ValueError("no safe queryable fields")
            done.append(ClassifiedFrame(name, mask(table, actions, key=None), tuple(actions)))
        except TABLE_ERRORS as error:
            skipped.append((name, str(error)[: rules.SKIP_DETAIL_MAX]))
    if objects and not done:
        raise RuntimeError("every object failed; nothing is published")
    return done, spark.createDataFrame(skipped, SKIP_COLUMNS)


def export(
    spark: SparkSession, target: str, tables: list[ClassifiedFrame], skipped: DataFrame, limit: int | None = None
) -> str:
    """Publish masked objects, skips, summary and audit as one snapshot.

    Every object is read, written and checked on its own: one that fails while its rows
    are read becomes a skip row, the others are published.  A gate refuses the run.
    """
    with Publication(spark, target, SENTINEL) as run:
        done = [t for t in tables if run.attempt(t.name, lambda t=t: _checked(t))]
        if not done:
            raise RuntimeError("every object failed; nothing is published")
        for table in done:
            check_values(table.name, run.written[table.name], table.actions)
        late = spark.createDataFrame(sorted(run.failed.items()), SKIP_COLUMNS)
        run.write("skipped", skipped.unionByName(late))
        audit = union_all([table.audit() for table in done])
        counted = spark.createDataFrame([(t.name, run.rows[t.name]) for t in done], "object string, n_rows bigint")
        run.write(SUMMARY, audits.technical_summary(audit, counted, run.written["skipped"], limit))
        run.write(SENTINEL, audit)
        run.commit()
        return run.run


def _checked(table: ClassifiedFrame) -> DataFrame:
    check_header(table)
    return table.frame
