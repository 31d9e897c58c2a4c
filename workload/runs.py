"""Whole exports with failures, repeats and gates (T3, T5, T6, F2, F3, K5, K7, K14)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hushframe.operators import incremental
from hushframe.operators.gates import GateError
from hushframe.operators.resolve import union_all
from hushframe.plans import eventlogs, records, reports, technical
from hushframe.session import staged_path
from hushframe.sinks import publish as publishing
from hushframe.sources import payloads
from hushframe.sources.planfile import Plan
from workload import bindings as b
from workload.base import bind, query, table, with_
from workload.landing import SCORES, account_fields, risk_pages, score_bodies
from workload.narrowing import EVENT_MASKED, event_rows, geo, logins, technical_fields
from workload.summaries import LANDED, landed

_WINDOWS = "log_date BETWEEN '2023-12-20' AND '2024-01-19'"


def _logins_by_day(spark, sf_dir):
    return event_rows(spark, sf_dir).withColumn("log_date", F.to_date("log_date"))


def _torn(spark, sf_dir, schema):
    """A file that is announced as Parquet and is none: the region names as text."""
    path = staged_path(spark, "torn")
    table(spark, sf_dir, "region").select("r_name").coalesce(1).write.text(path)
    return spark.read.schema(schema).parquet(path)


def _two_runs(spark, sf_dir, **options):
    """Two windows, each asked for twice; one type has nothing to show and one cannot be read."""
    target = staged_path(spark, "event-run")
    rows = _logins_by_day(spark, sf_dir)
    bodies = {"Login": rows, "Hidden": rows.select("QUERY", "log_date"), "Torn": _torn(spark, sf_dir, "USER_ID string, log_date date")}
    for day in (18, 18, 20, 20):
        eventlogs.run(spark, target, bodies, dt.date(2024, 1, day), **options)
    return target


@query(
    "t3_run_ledger",
    with_(e=b.EVENTS, m=EVENT_MASKED) + f"SELECT REQUEST_ID, USER_NAME, CLIENT_IP, URI, log_date FROM m WHERE {_WINDOWS}",
)
def _(spark, sf_dir):
    found = eventlogs.read_rows(spark, _two_runs(spark, sf_dir), "Login")
    cells = [F.coalesce(c, F.lit("")).alias(c) for c in ("REQUEST_ID", "USER_NAME", "CLIENT_IP", "URI")]
    return found.select(*cells, F.col("log_date").cast("string").alias("log_date"))


@query(
    "k7_run_summary",
    with_(e=b.EVENTS)
    + f"""SELECT CASE WHEN log_date < '2024-01-18' THEN '2023-12-20_to_2024-01-17' ELSE '2024-01-18_to_2024-01-19' END AS "window",
 count(*) AS n_rows, count(DISTINCT log_date) AS n_files, CAST(1 AS BIGINT) AS n_skipped FROM e WHERE {_WINDOWS} GROUP BY 1""",
)
def _(spark, sf_dir):
    found = eventlogs.read_part(spark, _two_runs(spark, sf_dir), eventlogs.SUMMARY)
    return found.select(
        "window",
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.get_json_object("summary", "$.records_by_type.Login").cast("bigint").alias("n_files"),
        F.get_json_object("summary", "$.skipped").cast("bigint").alias("n_skipped"),
    )


_BAD = "CASE event_id % 13 WHEN 0 THEN 'fetch failed' ELSE 'parse failed' END"


@query(
    "t5_run_skips",
    with_(events_=b.EVENTS, l=LANDED)
    + f"""SELECT event_type, {_BAD} AS reason, count(*) AS n FROM l WHERE event_id % 13 <= 1 GROUP BY ALL
 UNION ALL SELECT 'Torn', 'read failed', count(*) FROM (SELECT DISTINCT 1 FROM l)""",
)
def _(spark, sf_dir):
    _, bad = incremental.split_bad(landed(spark, sf_dir))
    target = staged_path(spark, "event-skips")
    bodies = {"Login": _logins_by_day(spark, sf_dir), "Torn": _torn(spark, sf_dir, "USER_ID string, log_date date")}
    eventlogs.run(spark, target, bodies, dt.date(2024, 1, 20), skipped=bad)
    lost = eventlogs.read_part(spark, target, eventlogs.SKIPPED)
    reason = F.when(F.col("event_type") == "Torn", "read failed").otherwise(F.col("reason"))
    return lost.groupBy("event_type", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "t6_quarantined_export",
    with_(events_=b.EVENTS)
    + """SELECT 'LoginHistory' AS object, count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns, true AS published FROM events_
 UNION ALL SELECT 'LoginGeo', 0, 0, true UNION ALL SELECT 'AuthSession', 0, 0, false""",
)
def _(spark, sf_dir):
    fields = technical_fields(spark)
    extra = fields.where("object = 'LoginHistory' AND name IN ('Id', 'Status')").withColumn("object", F.lit("AuthSession"))
    hidden = Plan(overrides={("LoginGeo", r["name"]): "DROP" for r in fields.where("object = 'LoginGeo'").collect()})
    tables = {
        "LoginHistory": logins(spark, sf_dir),
        "LoginGeo": geo(spark, sf_dir),
        "AuthSession": _torn(spark, sf_dir, "Id string, Status string"),
    }
    target = staged_path(spark, "quarantined")
    done, skipped = technical.extract(spark, tables.__getitem__, fields.unionByName(extra), list(tables), hidden)
    technical.export(spark, target, done, skipped)
    with publishing.held_snapshot(spark, target) as held:
        document = held(technical.SUMMARY).select(F.from_json("summary", "objects array<struct<object:string,rows:bigint,columns:bigint>>").alias("s"))
        good = document.select(F.explode("s.objects").alias("o")).select(
            "o.object", F.col("o.rows").alias("n_rows"), F.col("o.columns").alias("n_columns"), F.lit(True).alias("published")
        )
        zero = F.lit(0).cast("bigint")
        return union_all([good, held("skipped").select("object", zero.alias("n_rows"), zero.alias("n_columns"), F.lit(False).alias("published"))])


@query(
    "k14_refused_runs",
    """SELECT 'records' AS export, count(*) AS kept_rows, true AS refused FROM $customer
 UNION ALL SELECT 'technical', count(*), true FROM $events UNION ALL SELECT 'events', count(*), true FROM $events""",
)
def _(spark, sf_dir):
    """A run of each export that a gate refuses, after one that passed: the first snapshot stays."""
    out = []

    def refused(run) -> bool:
        try:
            run()
        except GateError:
            return True
        return False

    fields = account_fields(spark)
    accounts = bind(spark, sf_dir, b.ACCOUNTS)
    target = staged_path(spark, "refused-records")
    records.export(spark, target, {"Account": accounts}, fields)
    leaky = accounts.withColumn("Industry", F.lit("ask jane@example.com"))
    no = refused(lambda: records.export(spark, target, {"Account": leaky}, fields))
    out.append((publishing.read_published(spark, target, "Account"), "records", no))

    target = staged_path(spark, "refused-technical")
    for status in ("ok", "jane@example.com"):
        tables = {"LoginHistory": logins(spark, sf_dir).withColumn("Status", F.lit(status))}
        done, skipped = technical.extract(spark, tables.__getitem__, technical_fields(spark), list(tables))
        no = refused(lambda: technical.export(spark, target, done, skipped))
    out.append((publishing.read_published(spark, target, "LoginHistory"), "technical", no))

    target = staged_path(spark, "refused-events")
    rows = event_rows(spark, sf_dir).withColumn("log_date", F.lit(dt.date(2024, 1, 16)))
    eventlogs.run(spark, target, {"Login": rows}, dt.date(2024, 1, 18))
    later = rows.withColumn("log_date", F.lit(dt.date(2024, 1, 18))).withColumn("COUNTRY_CODE", F.lit("jane@example.com"))
    no = refused(lambda: eventlogs.run(spark, target, {"Login": later}, dt.date(2024, 1, 20)))
    out.append((eventlogs.read_rows(spark, target, "Login"), "events", no))
    return union_all(
        [
            rows.agg(F.lit(name).alias("export"), F.count(F.lit(1)).alias("kept_rows"), F.lit(no).alias("refused"))
            for rows, name, no in out
        ]
    )


@query(
    "s11_unscored_run",
    with_(s=SCORES, r=b.RISKS)
    + """SELECT s.org, s.Score AS score, count(*) AS risk_count, true AS refused
 FROM s JOIN r ON r.org = s.org GROUP BY s.org, s.Score""",
)
def _(spark, sf_dir):
    """A run whose check shows no score for one organisation leaves the documents of the run before."""
    target = staged_path(spark, "health")
    answers, risks = score_bodies(spark, sf_dir), payloads.read_health_risks(risk_pages(spark, sf_dir))
    reports.export_health(spark, target, payloads.read_health_scores(answers), risks)
    least = answers.agg(F.min("org")).scalar()
    empty = F.when(F.col("org") == least, F.lit('{"records": []}')).otherwise(F.col("body"))
    refused = False
    try:
        reports.export_health(spark, target, payloads.read_health_scores(answers.withColumn("body", empty)), risks)
    except RuntimeError as error:
        refused = "score" in str(error)
    kept = publishing.read_published(spark, target, reports.HEALTH)
    shape = "SecurityHealthCheck struct<Score:int>, risk_count bigint"
    return kept.select("org", F.from_json("document", shape).alias("d")).select(
        "org", F.col("d.SecurityHealthCheck.Score").alias("score"), "d.risk_count", F.lit(refused).alias("refused")
    )
