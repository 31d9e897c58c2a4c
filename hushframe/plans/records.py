"""Business records: scan, classify, resolve, mask, audit, publish."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators import audit as audits
from hushframe.operators.classify import classify_records
from hushframe.operators.gates import check_values
from hushframe.operators.mask import ClassifiedFrame, mask, read_actions_by_object
from hushframe.operators.predicate import narrowed, record_scope
from hushframe.operators.resolve import applied_action, drift, resolve_records
from hushframe.sinks.publish import Gate, Publication
from hushframe.sinks.text import check_header
from hushframe.sources.planfile import Plan, records_plan_text

SENTINEL = "field_handling"
SUMMARY = "summary"


def resolve_fields(fields: DataFrame, plan: Plan | None) -> DataFrame:
    """Applied action of every field (object, name, ...) under a plan."""
    classified = classify_records(fields).withColumnRenamed("name", "field")
    if plan is None:
        return applied_action(resolve_records(classified, None, None))
    spark = fields.sparkSession
    return applied_action(resolve_records(classified, plan.override_table(spark), plan.reason_table(spark)))


def preview(fields: DataFrame, plan: Plan | None = None) -> tuple[DataFrame, DataFrame]:
    """(tally, plan rows) of a dry run: schema rows only, no values are read."""
    resolved = resolve_fields(fields, plan)
    return audits.action_counts(resolved, "object"), resolved.select("object", "field", "action", "reason", "special_category")


def plan_text(fields: DataFrame, objects: list[str]) -> str:
    """The editable plan of a few objects; their schemas bound its size."""
    scan = classify_records(fields.where(F.col("object").isin(objects)))
    if "position" in fields.columns:
        scan = scan.orderBy("position")
    rows = [
        (r["object"], r["name"], r["action"], r["reason"], r["special_category"]) for r in scan.toLocalIterator()
    ]
    return records_plan_text(sorted(rows, key=lambda r: objects.index(r[0])))


def extract(
    tables: dict[str, DataFrame], fields: DataFrame, plan: Plan | None, predicate: str | None = None
) -> list[ClassifiedFrame]:
    """Masked tables of all objects in scope; nothing runs yet but the schema job."""
    names = record_scope(list(tables), plan.scope if plan else None)
    missing = [name for name in names if name not in tables]
    if missing:
        raise ValueError(f"the plan's scope names objects without a table: {missing}")
    actions = read_actions_by_object(resolve_fields(fields, plan), names)
    return [
        ClassifiedFrame(name, mask(narrowed(tables[name], predicate), actions[name]), tuple(actions[name]))
        for name in names
    ]


def value_gate(masked: list[ClassifiedFrame]) -> Gate:
    """Written tables hold nothing that their actions should have removed."""

    def check(written: dict[str, DataFrame]) -> None:
        for table in masked:
            check_values(table.name, written[table.name], table.actions)

    return check


def export(
    spark: SparkSession,
    target: str,
    tables: dict[str, DataFrame],
    fields: DataFrame,
    plan: Plan | None = None,
    predicate: str | None = None,
) -> str:
    """Publish masked objects, their audit and their summary as one snapshot."""
    if predicate is not None and not tables:
        raise ValueError("a predicate needs explicit objects")
    masked = extract(tables, fields, plan, predicate)
    for table in masked:
        check_header(table, ("Id",))
    resolved = resolve_fields(fields, plan).where(F.col("object").isin([t.name for t in masked]))
    audit = audits.record_audit(resolved)
    if predicate is not None:
        audit = audits.where_row(audit, predicate)
    drifted = drift(resolved, plan.known_table(spark)) if plan else resolved.limit(0)
    with Publication(spark, target, SENTINEL) as run:
        for table in masked:
            run.write(table.name, table.frame)
        run.check(value_gate(masked))
        run.write("flagged_fields", audits.flagged_fields(resolved, drifted, "object"))
        counted = spark.createDataFrame([(t.name, run.rows[t.name]) for t in masked], "object string, rows_out bigint")
        placed = resolved if "position" in resolved.columns else resolved.withColumn("position", F.lit(0))
        run.write(SUMMARY, audits.record_summary(placed, counted))
        run.write(SENTINEL, audit)
        run.commit()
        return run.run
