"""Joins (J1 to J13) and documented analytics (X1 to X5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions import masking
from hushframe.operators import correlate, inventory
from hushframe.operators.classify import classify_technical, selectable, technical_outcome, type_weight
from workload import bindings as b
from workload.base import bind, query, sql_list, table, with_
from workload.classification import _WEIGHT, C3, PLAN, resolved_records
from workload.narrowing import GEO, LOGINS, geo, logins
from workload.summaries import RECONCILE, components, retrieved
from workload.values import email_sql, ip_sql


@query(
    "j1_plan_lookup",
    with_(**PLAN) + "SELECT chosen AS action, source, count(*) AS n FROM effective GROUP BY ALL",
)
def _(spark, sf_dir):
    return resolved_records(spark, sf_dir).groupBy("action", "source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j2_constant_lookups",
    with_(c=b.COMPONENTS) + f"SELECT type, count(*) AS n, CAST(sum({_WEIGHT}) AS BIGINT) AS weight FROM c GROUP BY type",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, b.COMPONENTS)
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(type_weight(F.col("type"))).alias("weight"))


@query(
    "j2_curated_lookup",
    with_(technical=b.TECHNICAL)
    + f"SELECT org, object, name FROM technical WHERE object || '.' || name IN ({sql_list(f'{o}.{n}' for o, n, _, _ in rules.CURATED)})",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, b.TECHNICAL)
    return rows.where(technical_outcome(F.col("object"), F.col("name"), F.col("type"))["rule"] == "C3.1").select(
        "org", "object", "name"
    )


@query(
    "j3_deny_split",
    with_(c=b.COMPONENTS) + f"SELECT type, member, type IN ({sql_list(rules.DENIED)}) AS denied FROM c",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, b.COMPONENTS).select("type", "member")
    return inventory.allowed(rows).withColumn("denied", F.lit(False)).union(
        inventory.denied(rows).withColumn("denied", F.lit(True))
    )


@query(
    "j4_partial_retrieves",
    with_(**RECONCILE)
    + """SELECT type, 'partial_retrieve' AS bucket, requested, coalesce(retrieved, 0) AS retrieved FROM req LEFT JOIN got USING (type)
 WHERE coalesce(retrieved, 0) < requested""",
)
def _(spark, sf_dir):
    return inventory.partial_retrieves(components(spark, sf_dir), retrieved(spark, sf_dir)).drop("detail")


@query(
    "j5_missing_components",
    with_(**RECONCILE)
    + f"""SELECT DISTINCT type, member FROM c WHERE type NOT IN ({sql_list(rules.DENIED)})
 AND NOT EXISTS (SELECT 1 FROM r WHERE r.type = c.type AND r.member = c.member)""",
)
def _(spark, sf_dir):
    return inventory.missing_components(components(spark, sf_dir), retrieved(spark, sf_dir))


@query(
    "j6_hashed_join",
    with_(
        a=b.ACCOUNTS,
        e=b.EVENTS,
        h=f"SELECT Id, {email_sql('Contact_Email__c')} AS k FROM a",
        g=f"SELECT {email_sql('USER_NAME')} AS k, count(*) AS n_events FROM e GROUP BY 1",
    )
    + "SELECT Id, k AS email_hash, n_events FROM h JOIN g USING (k) WHERE k <> ''",
)
def _(spark, sf_dir):
    people = bind(spark, sf_dir, b.ACCOUNTS).select("Id", masking.hash_email(F.col("Contact_Email__c")).alias("email_hash"))
    seen = bind(spark, sf_dir, b.EVENTS).select(masking.hash_email(F.col("USER_NAME")).alias("email_hash"))
    known = F.col("email_hash") != ""
    counts = correlate.per_key(seen.where(known), "email_hash", n_events=F.count(F.lit(1)))
    return people.where(known).join(counts, "email_hash").select("Id", "email_hash", "n_events")


@query(
    "j7_request_fan_out",
    with_(e=b.EVENTS)
    + """SELECT REQUEST_ID, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_types, string_agg(EVENT_TYPE, ',' ORDER BY EVENT_TYPE) AS types
 FROM (SELECT REQUEST_ID, EVENT_TYPE, count(*) AS n FROM e GROUP BY ALL) x GROUP BY REQUEST_ID""",
)
def _(spark, sf_dir):
    return correlate.fan_out(bind(spark, sf_dir, b.EVENTS), "REQUEST_ID", "EVENT_TYPE")


@query(
    "j8_session_correlation",
    with_(
        e=b.EVENTS,
        l="SELECT SESSION_KEY, count(*) AS n_logins, CAST(min(ts) AS VARCHAR) AS first_login FROM e WHERE EVENT_TYPE = 'view' GROUP BY SESSION_KEY",
        d="SELECT SESSION_KEY, count(*) AS n_actions, CAST(sum(CAST(RUN_TIME AS DECIMAL(18,2))) AS BIGINT) AS total FROM e WHERE EVENT_TYPE <> 'view' GROUP BY SESSION_KEY",
    )
    + "SELECT SESSION_KEY, n_logins, n_actions, total FROM l LEFT JOIN d USING (SESSION_KEY)",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, b.EVENTS)
    is_login = F.col("EVENT_TYPE") == "view"
    found = correlate.sessions(rows.where(is_login), rows.where(~is_login), "SESSION_KEY", "RUN_TIME")
    return found.select("SESSION_KEY", "n_logins", "n_actions", F.col("total").cast("bigint").alias("total"))


SEARCHES = "SELECT 'Q' || CAST(o_orderkey AS STRING) AS QUERY_ID, o_custkey AS USER_ID, o_orderstatus AS STATUS FROM $orders"
#: Every line is a click; only those of returned lines come from a search.
CLICKS = """SELECT CASE WHEN l_returnflag = 'R' THEN 'Q' ELSE 'B' END || CAST(l_orderkey AS STRING) AS QUERY_ID,
 l_partkey AS CLICKED_RECORD_ID, l_linenumber AS RANK FROM $lineitem"""


@query(
    "j9_search_clicks",
    with_(s=SEARCHES, c=CLICKS) + "SELECT s.QUERY_ID, USER_ID, STATUS, CLICKED_RECORD_ID, RANK FROM s LEFT JOIN c ON c.QUERY_ID = s.QUERY_ID",
)
def _(spark, sf_dir):
    return correlate.search_clicks(bind(spark, sf_dir, SEARCHES), bind(spark, sf_dir, CLICKS), "QUERY_ID")


@query(
    "j10_job_events",
    """SELECT o.o_orderkey AS JOB_ID, o.o_orderstatus AS status, j.n_events, j.n_rows FROM $orders o LEFT JOIN
 (SELECT l_orderkey, count(*) AS n_events, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_rows FROM $lineitem GROUP BY l_orderkey) j
 ON j.l_orderkey = o.o_orderkey""",
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("JOB_ID"), F.col("l_quantity").cast("bigint").alias("rows")
    )
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("JOB_ID"), F.col("o_orderstatus").alias("status"))
    return correlate.job_runs(events, jobs, "JOB_ID")


@query(
    "j11_analytics_sessions",
    with_(e=b.EVENTS)
    + """SELECT SESSION_KEY AS WAVE_SESSION_ID, count(*) FILTER (EVENT_TYPE = 'view') AS loads, count(*) FILTER (EVENT_TYPE = 'click') AS interactions,
 count(*) FILTER (EVENT_TYPE = 'error') AS performance, count(*) FILTER (EVENT_TYPE = 'purchase') AS downloads FROM e GROUP BY SESSION_KEY""",
)
def _(spark, sf_dir):
    kinds = {"loads": "view", "interactions": "click", "performance": "error", "downloads": "purchase"}
    rows = bind(spark, sf_dir, b.EVENTS).withColumnRenamed("SESSION_KEY", "WAVE_SESSION_ID")
    return correlate.per_key(
        rows, "WAVE_SESSION_ID", **{name: F.count_if(F.col("EVENT_TYPE") == kind) for name, kind in kinds.items()}
    )


CHECKS = """SELECT '0Vx' || CAST(event_id AS STRING) AS CheckId, '0Yx' || CAST(event_id + 1 AS STRING) AS LoginHistoryId, EVENT_TYPE AS Method
FROM events_"""


@query(
    "j12_login_places",
    with_(events_=b.EVENTS, l=LOGINS, g=GEO, c=CHECKS)
    + """SELECT CheckId, Method, l.UserId, l.Status, g.Country FROM c LEFT JOIN l ON l.Id = c.LoginHistoryId
 LEFT JOIN g ON g.Id = l.LoginGeoId""",
)
def _(spark, sf_dir):
    checks = bind(spark, sf_dir, with_(events_=b.EVENTS) + CHECKS)
    places = geo(spark, sf_dir).select(F.col("Id").alias("LoginGeoId"), "Country")
    started = logins(spark, sf_dir).select(F.col("Id").alias("LoginHistoryId"), "UserId", "Status", "LoginGeoId")
    return correlate.login_places(started, places, checks).select("CheckId", "Method", "UserId", "Status", "Country")


@query(
    "j13_privilege_paths",
    """SELECT l.l_orderkey AS AssignmentId, l.l_linenumber AS line, p.p_name AS PermissionSet, p.p_size % 2 = 0 AS ModifyAllData, c.c_mktsegment AS Department
 FROM $lineitem l JOIN $part p ON p.p_partkey = l.l_partkey JOIN $orders o ON o.o_orderkey = l.l_orderkey
 JOIN $customer c ON c.c_custkey = o.o_custkey""",
)
def _(spark, sf_dir):
    owner = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("AssigneeId"))
    assignments = table(spark, sf_dir, "lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("AssignmentId"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("PermissionSetId"), "AssigneeId",
    )
    sets = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("PermissionSetId"), F.col("p_name").alias("PermissionSet"),
        (F.col("p_size") % 2 == 0).alias("ModifyAllData"),
    )
    users = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("AssigneeId"), F.col("c_mktsegment").alias("Department")
    )
    return correlate.privilege_paths(assignments, sets, users).drop("AssigneeId", "PermissionSetId")


# ---------------------------------------------------------------- X1 to X5
@query(
    "x1_sampled_rows",
    """SELECT l_shipdate::DATE::VARCHAR AS day, CAST(sum(CAST(l_quantity AS BIGINT) * (1 + l_linenumber % 10)) AS BIGINT) AS est_rows
 FROM $lineitem GROUP BY 1""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.to_date("l_shipdate").cast("string").alias("day")).agg(
        correlate.scaled_rows(F.col("l_quantity").cast("bigint"), 1 + F.col("l_linenumber") % 10).alias("est_rows")
    )


@query(
    "x2_client_address",
    with_(e=b.EVENTS) + f"SELECT event_id, {ip_sql('coalesce(nullif(FORWARDED_FOR_IP, chr(0)), CLIENT_IP)').replace('chr(0)', chr(39) * 2)} AS address FROM e",
)
def _(spark, sf_dir):
    best = correlate.client_address(F.col("FORWARDED_FOR_IP"), F.col("CLIENT_IP"))
    return bind(spark, sf_dir, b.EVENTS).select("event_id", masking.ip_prefix(best).alias("address"))


@query(
    "x3_prefer_derived",
    with_(e=b.EVENTS) + "SELECT event_id, CASE WHEN trim(USER_NAME) <> '' THEN USER_NAME ELSE USER_ID END AS who FROM e",
)
def _(spark, sf_dir):
    derived = F.when(F.btrim("USER_NAME") != "", F.col("USER_NAME")).otherwise("")
    return bind(spark, sf_dir, b.EVENTS).select("event_id", correlate.prefer_derived(derived, F.col("USER_ID")).alias("who"))


USAGE = """SELECT 'page' || CAST(p.p_size AS STRING) AS PageName, CAST(l.l_quantity AS BIGINT) AS RecordCountEPT,
 CAST(floor(l.l_extendedprice) AS BIGINT) AS SumEPT, CASE WHEN l.l_linenumber <= 2 THEN 1 ELSE 0 END AS EptBinUnder3,
 CASE WHEN l.l_linenumber BETWEEN 3 AND 5 THEN 1 ELSE 0 END AS EptBin3To5, CASE WHEN l.l_linenumber > 5 THEN 1 ELSE 0 END AS EptBinOver10
FROM $lineitem l JOIN $part p ON p.p_partkey = l.l_partkey"""


@query(
    "x4_page_times",
    with_(u=USAGE)
    + """SELECT PageName, CAST(sum(SumEPT) AS BIGINT) AS sum_ept, CAST(sum(RecordCountEPT) AS BIGINT) AS views,
 round(CAST(sum(SumEPT) AS DOUBLE) / CAST(sum(RecordCountEPT) AS DOUBLE), 4) AS mean_ept FROM u GROUP BY PageName""",
)
def _(spark, sf_dir):
    return correlate.page_times(bind(spark, sf_dir, USAGE), "PageName")


_BINS = ["EptBinUnder3", "EptBin3To5", "EptBinOver10"]


@query(
    "x4_page_time_bins",
    with_(u=USAGE) + " UNION ALL ".join(f"SELECT PageName, '{c}' AS bin, CAST(sum({c}) AS BIGINT) AS n FROM u GROUP BY PageName" for c in _BINS),
)
def _(spark, sf_dir):
    return correlate.page_time_bins(bind(spark, sf_dir, USAGE), "PageName", _BINS)


@query(
    "x5_content_matrix",
    with_(**C3)
    + """SELECT org, object, bool_or(regexp_matches(lower(name), 'user|owner|assignee|identity')) AS identifies_users,
 bool_or(rule = 'C3.3' OR rule = 'C3.7') AS has_network_or_place,
 bool_or(rule = 'C3.8' OR (rule = 'C3.1' AND action = 'DROP')) AS has_free_text FROM classified GROUP BY org, object""",
)
def _(spark, sf_dir):
    found = classify_technical(selectable(bind(spark, sf_dir, b.TECHNICAL)))
    return correlate.content_matrix(found, "org", "object")
