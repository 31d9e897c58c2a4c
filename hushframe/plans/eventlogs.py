"""Event logs: window, classify by header, mask, append."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators import audit as audits
from hushframe.operators.classify import classify_event_columns
from hushframe.operators.gates import check_values
from hushframe.operators.incremental import header_scan, open_window
from hushframe.operators.mask import ClassifiedFrame, ColumnAction, mask, read_actions
from hushframe.operators.resolve import event_key, first_tag_per_column, resolve_exposure
from hushframe.sinks.files import create_new, delete, join, listed, read_text
from hushframe.sinks.publish import TABLE_ERRORS
from hushframe.sinks.text import append_slices, read_dated_csv, write_dated_csv, write_report
from hushframe.sources.eventlog import columns_by_type, headers_per_type
from hushframe.sources.planfile import Plan, tagged_plan_text


#: Folders and tables of a target that :func:`run` writes.
LEDGER, RUNS, BODIES = "ledger", "runs", "bodies"
SENTINEL, SUMMARY, SKIPPED = "field_handling", "summary", "skipped"


def resolve_columns(columns: DataFrame, plan: Plan | None = None) -> DataFrame:
    """Effective action per (event_type, column)."""
    classified = classify_event_columns(columns).withColumn("key", event_key(F.col("column")))
    if plan is None:
        return resolve_exposure(classified, None, None, ("key",)).drop("key")
    spark = columns.sparkSession
    overrides = plan.override_table(spark).withColumnRenamed("field", "key").select("key", "action")
    reasons = plan.reason_table(spark).withColumnRenamed("field", "key").select("key", "text")
    return resolve_exposure(classified, overrides, reasons, ("key",)).drop("key")


def actions_for(spark: SparkSession, header: list[str], plan: Plan | None = None) -> list[ColumnAction]:
    """Actions of one header, in its order."""
    rows = [(position, name) for position, name in enumerate(header)]
    columns = spark.createDataFrame(rows, "position int, column string")
    return read_actions(resolve_columns(columns, plan))


def anonymise(event_type: str, rows: DataFrame, plan: Plan | None = None, keep: tuple[str, ...] = ()) -> ClassifiedFrame:
    """Masked rows of one event type; ``keep`` are partition columns."""
    actions = actions_for(rows.sparkSession, [c for c in rows.columns if c not in keep], plan)
    shown = [ColumnAction(k, rules.PASS) for k in keep]
    return ClassifiedFrame(event_type, mask(rows, [*actions, *shown]), tuple(actions))


def counted(rows: DataFrame, seen: Observation) -> DataFrame:
    """Rows as they are read, counted by whatever reads them, as ``rows``.

    Masking keeps every row, so this is the count of what is written.  Counting before
    the masking instead of after it has the optimizer compile the two sides apart: in one
    method they pass the 8,000 bytes of code above which the JVM only interprets.
    """
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"))


def preview(headers: DataFrame, start: dt.date, end: dt.date, plan: Plan | None = None) -> tuple[DataFrame, DataFrame]:
    """(files per type, tag per column) of a window, from headers alone."""
    only = plan.scope if plan and plan.scope else None
    found = header_scan(headers, start, end, only)
    resolved = resolve_columns(columns_by_type(found), plan)
    return headers_per_type(found), first_tag_per_column(resolved)


def plan_text(headers: DataFrame) -> str:
    """Editable plan; distinct column names are a closed vocabulary."""
    columns = resolve_columns(columns_by_type(headers))
    tags = [(r["column"], r["tag"]) for r in first_tag_per_column(columns).orderBy("column").collect()]
    types = [r["event_type"] for r in headers_per_type(headers).collect()]
    return tagged_plan_text("event_types", types, tags)


def export(
    spark: SparkSession,
    target: str,
    bodies: dict[str, DataFrame],
    ledger: DataFrame,
    run_day: dt.date,
    plan: Plan | None = None,
) -> tuple[dt.date, dt.date] | None:
    """Append the open window of every event type; None when up to date.

    ``bodies`` maps an event type to rows with a ``log_date``.  Days already
    there are untouched, and a repeated run rewrites the same slices.
    """
    window = open_window(ledger, run_day)
    if window is None:
        return None
    start, end = window
    for event_type, rows in bodies.items():
        if plan and plan.scope and event_type not in plan.scope:
            continue
        inside = rows.where(F.col("log_date").between(F.lit(start), F.lit(end)))
        append_slices(anonymise(event_type, inside, plan, keep=("log_date",)), f"{target}/event_type={event_type}")
    return window


def read_ledger(spark: SparkSession, target: str) -> DataFrame:
    """(name, sentinel) of the windows that runs on ``target`` have finished."""
    names = [(n[:-5], True) for n in sorted(listed(spark, join(target, LEDGER))) if n.endswith(".json")]
    return spark.createDataFrame(names, "name string, sentinel boolean")


def run(
    spark: SparkSession,
    target: str,
    bodies: dict[str, DataFrame],
    run_day: dt.date,
    plan: Plan | None = None,
    skipped: DataFrame | None = None,
) -> tuple[dt.date, dt.date] | None:
    """Export the open window of every event type with its audit, summary and skips; None when up to date.

    The target keeps its own ledger: one file per finished window, created last and only
    if no other run has created it, so a repeated run adds nothing, and of two runs at
    once one counts and the other removes what it wrote.  ``bodies`` maps an event type
    to rows with a ``log_date``, ``skipped`` are (event_type, reason) rows of files that
    were not read.  A type that fails while it is read or written becomes a skip row; a
    type whose columns all drop is a success without output; a gate refuses the run.
    """
    window = open_window(read_ledger(spark, target), run_day)
    if window is None:
        return None
    start, end = window
    run_id = uuid.uuid4().hex
    root = join(target, RUNS, run_id)
    wanted = [t for t in sorted(bodies) if not (plan and plan.scope) or t in plan.scope]
    headers, files, rows, failed = [], [], 0, []
    try:
        for event_type in wanted:
            path = join(root, BODIES, f"event_type={event_type}")
            try:
                inside = bodies[event_type].where(F.col("log_date").between(F.lit(start), F.lit(end)))
                seen = Observation()
                table = anonymise(event_type, counted(inside, seen), plan, keep=("log_date",))
                if any(a.kept for a in table.actions):
                    write_dated_csv(table, path)
                    rows += seen.get["rows"]
            except TABLE_ERRORS as error:
                delete(spark, path)
                failed.append((event_type, str(error)[: rules.SKIP_DETAIL_MAX]))
                continue
            headers += [(event_type, k, a.name) for k, a in enumerate(table.actions)]
            days = [n for n in sorted(listed(spark, path)) if n.startswith("log_date=")]
            files += [(event_type, day.removeprefix("log_date=")) for day in days]
            if days:
                check_values(event_type, read_dated_csv(spark, path, table), table.actions)
        if wanted and len(failed) == len(wanted):
            raise RuntimeError("every event type failed; nothing is published")
        lost = spark.createDataFrame(failed, "event_type string, reason string")
        lost = lost if skipped is None else skipped.select("event_type", "reason").unionByName(lost)
        columns = resolve_columns(spark.createDataFrame(headers, "event_type string, position int, column string"), plan)
        written = spark.createDataFrame(files, "event_type string, log_date string")
        summary = run_summary(columns, written, lost).select(
            F.lit(f"{start}_to_{end}").alias("window"), F.lit(rows).cast("bigint").alias("n_rows"), "summary"
        )
        write_report(lost, join(root, SKIPPED))
        write_report(summary, join(root, SUMMARY))
        audit = audits.event_audit(columns).withColumn("event_types", F.array_join("event_types", ","))
        write_report(audit, join(root, SENTINEL))
        entry = {"run": run_id, "start": str(start), "end": str(end), "files": len(files), "rows": rows}
        if not create_new(spark, join(target, LEDGER, f"{start}_to_{end}.json"), json.dumps(entry) + "\n"):
            delete(spark, root)
    except Exception:
        delete(spark, root)
        raise
    return window


def finished_runs(spark: SparkSession, target: str) -> list[dict]:
    """The ledger's entries in the order of their windows."""
    names = sorted(n for n in listed(spark, join(target, LEDGER)) if n.endswith(".json"))
    texts = [read_text(spark, join(target, LEDGER, n)) for n in names]
    return [json.loads(t) for t in texts if t.endswith("\n")]


def read_rows(spark: SparkSession, target: str, event_type: str) -> DataFrame | None:
    """The masked rows of one event type over all finished windows, as text; None if there are none."""
    paths = [join(target, RUNS, entry["run"], BODIES, f"event_type={event_type}") for entry in finished_runs(spark, target)]
    frames = [read_dated_csv(spark, path) for path in paths if listed(spark, path)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def read_part(spark: SparkSession, target: str, part: str) -> DataFrame:
    """``SENTINEL``, ``SUMMARY`` or ``SKIPPED`` rows of all finished windows, with ``window``."""
    frames = []
    for entry in finished_runs(spark, target):
        frame = spark.read.csv(join(target, RUNS, entry["run"], part), header=True, escape='"', multiLine=True)
        frames.append(frame.withColumn("window", F.lit(f"{entry['start']}_to_{entry['end']}")))
    if not frames:
        raise ValueError(f"{target} has no finished window")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def run_summary(columns: DataFrame, files: DataFrame, skipped: DataFrame) -> DataFrame:
    """One JSON document of a run; its parts are closed vocabularies or counts."""
    one = F.count(F.lit(1)).alias("n")
    parts = (
        audits.column_action_counts(columns).select(F.lit("action").alias("part"), F.col("action").alias("key"), F.col("columns").alias("n"))
        .union(files.groupBy("event_type").agg(one).select(F.lit("type"), "event_type", "n"))
        .union(skipped.agg(one).select(F.lit("skipped"), F.lit(""), "n"))
    )

    def as_map(part: str) -> Column:
        entries = F.collect_list(F.when(F.col("part") == part, F.struct("key", "n")))
        return F.map_from_entries(F.array_sort(entries))

    def total(part: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0))

    return parts.agg(
        as_map("action").alias("column_action_counts"),
        as_map("type").alias("records_by_type"),
        total("type").alias("files"),
        total("skipped").alias("skipped"),
    ).select(
        audits.json_document(
            **{c: F.col(c) for c in ("column_action_counts", "records_by_type", "files", "skipped")}
        ).alias("summary")
    )
