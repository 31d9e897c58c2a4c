"""Aggregates (A1 to A17), sets and orders (U1 to U6), windows (W1 to W4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators import audit, batching, incremental, inventory, reports, resolve
from hushframe.operators.incremental import split_bad
from hushframe.operators.predicate import ordered_distinct
from hushframe.operators.ranking import cap_per_group
from hushframe.plans import inventory as inventory_plan
from hushframe.sources.eventlog import headers_per_type
from hushframe.sources.payloads import read_violations
from workload import bindings as b
from workload.base import bind, query, sql_list, table, with_
from workload.classification import (
    _E_PLAN,
    _WEIGHT,
    PLAN,
    T_PLAN,
    _resolved_events,
    fields,
    known_fields,
    resolved_records,
    resolved_technical,
)
from workload.landing import ENUM, SKIPS, described, listing, report_bodies


def applied_records(spark, sf_dir):
    return resolve.applied_action(resolved_records(spark, sf_dir))


# ---------------------------------------------------------------- A1 to A5
@query("a1_record_action_counts", with_(**PLAN) + "SELECT object, action, count(*) AS fields FROM applied GROUP BY object, action")
def _(spark, sf_dir):
    return audit.action_counts(applied_records(spark, sf_dir), "object")


@query("a2_technical_action_counts", with_(**T_PLAN) + "SELECT object, action, count(*) AS fields FROM applied GROUP BY object, action")
def _(spark, sf_dir):
    return audit.action_counts(resolved_technical(spark, sf_dir), "object")


@query(
    "a3_event_action_counts",
    with_(**_E_PLAN, named="SELECT DISTINCT key, action FROM applied") + "SELECT action, count(*) AS columns FROM named GROUP BY action",
)
def _(spark, sf_dir):
    rows = _resolved_events(spark, sf_dir).select(F.col("key").alias("column"), "action")
    return audit.column_action_counts(rows)


@query(
    "a4_row_and_column_counts",
    with_(**PLAN) + "SELECT object, count(*) AS fields, count(*) FILTER (action <> 'DROP') AS columns FROM applied GROUP BY object",
)
def _(spark, sf_dir):
    return audit.kept_columns(applied_records(spark, sf_dir), "object")


LANDED = """SELECT event_id, EVENT_TYPE AS event_type, 'EVENT_TYPE, USER_ID,URI' AS names,
 CASE WHEN event_id % 13 = 0 THEN CAST(NULL AS STRING) WHEN event_id % 13 = 1 THEN '<html>busy</html>'
 ELSE '"EVENT_TYPE","USER_ID","URI"' || chr(10) || EVENT_TYPE || ',' || USER_ID || ',' || URI END AS body FROM events_"""


def landed(spark, sf_dir):
    return bind(spark, sf_dir, with_(events_=b.EVENTS) + LANDED)


@query(
    "a5_files_per_type",
    with_(events_=b.EVENTS, l=LANDED)
    + """SELECT event_type, count(*) FILTER (event_id % 13 > 1) AS files, count(*) FILTER (event_id % 13 <= 1) AS skipped FROM l GROUP BY event_type""",
)
def _(spark, sf_dir):
    good, bad = split_bad(landed(spark, sf_dir))
    files = good.select("event_type", F.lit(1).alias("ok"))
    return files.union(bad.select("event_type", F.lit(0))).groupBy("event_type").agg(
        F.count_if(F.col("ok") == 1).alias("files"), F.count_if(F.col("ok") == 0).alias("skipped")
    )


@query("a6_headers_per_type", with_(h=b.HEADERS) + "SELECT EventType AS event_type, count(*) AS files FROM h GROUP BY EventType")
def _(spark, sf_dir):
    return headers_per_type(bind(spark, sf_dir, b.HEADERS))


@query("a7_skip_buckets", with_(**ENUM, skips=SKIPS) + "SELECT bucket, count(*) AS n FROM skips GROUP BY bucket")
def _(spark, sf_dir):
    return resolve.tally(inventory.listing_skips(described(spark, sf_dir), listing(spark, sf_dir)), "bucket")


@query(
    "a8_excluded_counts",
    with_(c=b.COMPONENTS) + f"SELECT type, count(*) AS n FROM c WHERE type IN ({sql_list(rules.DENIED)}) GROUP BY ROLLUP (type)",
)
def _(spark, sf_dir):
    return inventory.excluded_counts(bind(spark, sf_dir, b.COMPONENTS))


# ---------------------------------------------------------------- W1, W2, A9: batches
MAX_MEMBERS, MAX_WEIGHT = 300, 2_000
_FOLD = f"""SELECT 0 AS i, CAST(1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS w, '' AS type,
   CAST(0 AS BIGINT) AS b0, CAST(0 AS BIGINT) AS k1, CAST(1 AS BIGINT) AS k
 UNION ALL
 SELECT i, CASE WHEN n <= k1 THEN b0 ELSE b0 + 1 + (n - k1 - 1) // k END,
   CASE WHEN n <= k1 THEN c0 + n ELSE n - k1 - ((n - k1 - 1) // k) * k END,
   CASE WHEN n <= k1 THEN w0 + n * wt ELSE (n - k1 - ((n - k1 - 1) // k) * k) * wt END, type, b0, k1, k
 FROM (SELECT *, least({MAX_MEMBERS} - c0, ({MAX_WEIGHT} - w0 + wt - 1) // wt) AS k1,
     least({MAX_MEMBERS}, ({MAX_WEIGHT} + wt - 1) // wt) AS k
   FROM (SELECT t.i, t.type, t.n, t.wt, f.b + CASE WHEN f.c >= {MAX_MEMBERS} OR f.w >= {MAX_WEIGHT} THEN 1 ELSE 0 END AS b0,
       CASE WHEN f.c >= {MAX_MEMBERS} OR f.w >= {MAX_WEIGHT} THEN 0 ELSE f.c END AS c0,
       CASE WHEN f.c >= {MAX_MEMBERS} OR f.w >= {MAX_WEIGHT} THEN 0 ELSE f.w END AS w0
     FROM fold f JOIN totals t ON t.i = f.i + 1) s) s2"""
def batches_sql(**source: str) -> str:
    """The batch rule over ``comps``, the last of the given bindings."""
    return "WITH RECURSIVE " + with_(
        **source,
        kept=f"SELECT DISTINCT type, member FROM comps WHERE type NOT IN ({sql_list(rules.DENIED)})",
        totals=f"""SELECT type, n, CAST({_WEIGHT} AS BIGINT) AS wt, row_number() OVER (ORDER BY type) AS i
 FROM (SELECT type, count(*) AS n FROM kept GROUP BY type) t""",
        fold=_FOLD,
        placed="SELECT type, member, row_number() OVER (PARTITION BY type ORDER BY member) - 1 AS p FROM kept",
        batches="""SELECT CASE WHEN p < k1 THEN b0 ELSE b0 + 1 + (p - k1) // k END AS batch, d.type, d.member, wt AS weight
 FROM placed d JOIN fold f ON f.type = d.type JOIN totals t ON t.type = d.type""",
    ).removeprefix("WITH ")


BATCHES_SQL = batches_sql(comps=b.COMPONENTS)
_TOTALS = "SELECT batch, type, count(*) AS members, CAST(sum(weight) AS BIGINT) AS weight FROM batches GROUP BY ROLLUP (batch, type)"


def batches(spark, sf_dir):
    components = inventory.allowed(bind(spark, sf_dir, b.COMPONENTS))
    return batching.assign_batches(components, MAX_MEMBERS, MAX_WEIGHT)


@query("w1_batches", BATCHES_SQL + "SELECT batch, type, member, weight FROM batches")
def _(spark, sf_dir):
    return batches(spark, sf_dir)


@query("w2_chunks", BATCHES_SQL + "SELECT batch, type, string_agg(member, '|' ORDER BY member) AS members FROM batches GROUP BY batch, type")
def _(spark, sf_dir):
    return batching.chunks(batches(spark, sf_dir)).withColumn("members", F.array_join("members", "|"))


@query(
    "a9_batch_totals",
    BATCHES_SQL + _TOTALS,
)
def _(spark, sf_dir):
    return batching.batch_totals(batches(spark, sf_dir))


@query("p10_preview_inventory", batches_sql(**ENUM, comps="SELECT type, member FROM components") + _TOTALS)
def _(spark, sf_dir):
    totals, _, _ = inventory_plan.preview(described(spark, sf_dir), listing(spark, sf_dir), MAX_MEMBERS, MAX_WEIGHT)
    return totals


@query(
    "w4_cap_per_object",
    """SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS p
 FROM $events) x WHERE p <= 50""",
)
def _(spark, sf_dir):
    return cap_per_group(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"], 50)


# ---------------------------------------------------------------- A10 to A17
def components(spark, sf_dir):
    return inventory.allowed(bind(spark, sf_dir, b.COMPONENTS))


def retrieved(spark, sf_dir):
    return bind(spark, sf_dir, b.RETRIEVED)


RECONCILE = dict(
    c=b.COMPONENTS,
    r=b.RETRIEVED,
    req=f"SELECT type, count(DISTINCT member) AS requested FROM c WHERE type NOT IN ({sql_list(rules.DENIED)}) GROUP BY type",
    got="SELECT type, count(DISTINCT member) AS retrieved FROM r GROUP BY type",
)


@query(
    "a10_requested_retrieved",
    with_(**RECONCILE) + "SELECT type, requested, coalesce(retrieved, 0) AS retrieved FROM req LEFT JOIN got USING (type)",
)
def _(spark, sf_dir):
    return inventory.requested_vs_retrieved(components(spark, sf_dir), retrieved(spark, sf_dir))


@query(
    "a11_severity_counts",
    with_(v=b.VIOLATIONS)
    + "SELECT engine, count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = {i}) AS sev{i}" for i in range(1, 6)) + " FROM v GROUP BY engine",
)
def _(spark, sf_dir):
    return reports.severity_counts(bind(spark, sf_dir, b.VIOLATIONS), "engine")


@query("a12_risk_count", with_(r=b.RISKS) + "SELECT org, count(*) AS risk_count FROM r GROUP BY org")
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.RISKS).groupBy("org").agg(F.count(F.lit(1)).alias("risk_count"))


@query(
    "a13_latest_end",
    with_(l=b.LEDGER) + "SELECT max(CAST(string_split(name, '_to_')[2] AS DATE)) AS \"end\" FROM l WHERE sentinel AND contains(name, '_to_')",
)
def _(spark, sf_dir):
    return incremental.latest_end(bind(spark, sf_dir, b.LEDGER))


@query(
    "a14_flagged_fields",
    with_(**PLAN, known=b.KNOWN)
    + """SELECT object, 'downgraded' AS kind, field FROM effective WHERE downgraded UNION ALL
 SELECT object, 'drift', name FROM fields f WHERE NOT EXISTS (SELECT 1 FROM known n WHERE n.object = f.object AND n.field = f.name)""",
)
def _(spark, sf_dir):
    seen = fields(spark, sf_dir).withColumnRenamed("name", "field")
    return audit.flagged_fields(resolved_records(spark, sf_dir), resolve.drift(seen, known_fields(spark, sf_dir)), "object")


@query(
    "a15_success_counts",
    with_(technical=b.TECHNICAL, per="SELECT org, object, bool_or(queryable) AS ok FROM technical GROUP BY org, object")
    + "SELECT count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS skipped, count(*) FILTER (ok) > 0 AS publishable FROM per",
)
def _(spark, sf_dir):
    outcomes = bind(spark, sf_dir, b.TECHNICAL).groupBy("org", "object").agg(F.bool_or("queryable").alias("ok"))
    return audit.success_counts(outcomes)


@query(
    "a16_violation_dimensions",
    with_(v=b.VIOLATIONS)
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM v GROUP BY {d}" for d in ("rule", "engine", "file")),
)
def _(spark, sf_dir):
    return reports.by_dimension(bind(spark, sf_dir, b.VIOLATIONS), "rule", "engine", "file")


@query(
    "a16_violation_tags",
    with_(v=b.VIOLATIONS) + "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(tag_list, ',')) AS tag FROM v) x GROUP BY tag",
)
def _(spark, sf_dir):
    return reports.by_tag(read_violations(report_bodies(spark, sf_dir)))


@query(
    "a17_risk_matrix",
    with_(r=b.RISKS)
    + "SELECT SettingGroup, " + ", ".join(f"nullif(count(*) FILTER (RiskType = '{t}'), 0) AS {t}" for t in rules.RISK_TYPES) + " FROM r GROUP BY SettingGroup",
)
def _(spark, sf_dir):
    return reports.risk_matrix(bind(spark, sf_dir, b.RISKS))


@query("a17_risk_cube", with_(r=b.RISKS) + "SELECT SettingGroup, RiskType, count(*) AS n FROM r GROUP BY CUBE (SettingGroup, RiskType)")
def _(spark, sf_dir):
    return reports.risk_cube(bind(spark, sf_dir, b.RISKS))


# ---------------------------------------------------------------- U1 to U6
@query("u1_candidate_types", with_(**ENUM) + "SELECT type FROM candidates")
def _(spark, sf_dir):
    return inventory.candidate_types(described(spark, sf_dir))


@query("u2_folders", with_(**ENUM) + "SELECT type, folder FROM folders")
def _(spark, sf_dir):
    return inventory.folders(listing(spark, sf_dir))


@query("u3_distinct_members", with_(**ENUM) + "SELECT DISTINCT type, member FROM components ORDER BY type, member")
def _(spark, sf_dir):
    found = inventory.enumerate_components(described(spark, sf_dir), listing(spark, sf_dir))
    return inventory.merged(found).orderBy("type", "member")


@query(
    "u4_manifest_merge",
    with_(c=b.COMPONENTS, r=b.RETRIEVED) + "SELECT type, member FROM c UNION SELECT type, member FROM r",
)
def _(spark, sf_dir):
    asked = bind(spark, sf_dir, b.COMPONENTS).select("type", "member")
    return inventory.merged(asked.union(retrieved(spark, sf_dir)))


@query(
    "u5_ordered_distinct",
    "SELECT p_name AS name, min(p_partkey) AS position FROM $part GROUP BY p_name ORDER BY position",
)
def _(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("position"))
    return ordered_distinct(names, "name", "position").orderBy("position")


@query(
    "u6_report_orders",
    with_(**RECONCILE) + "SELECT 'partial_retrieve' AS bucket, type, requested, retrieved FROM req JOIN got USING (type) WHERE retrieved < requested ORDER BY bucket, type",
)
def _(spark, sf_dir):
    asked = components(spark, sf_dir)
    rows = inventory.partial_retrieves(asked, retrieved(spark, sf_dir)).where(F.col("retrieved") > 0)
    return inventory.skip_report(rows).select("bucket", "type", "requested", "retrieved").orderBy("bucket", "type")

