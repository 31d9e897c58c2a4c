"""Incremental runs (T1 to T9), sinks (K1 to K14) and named functions (E1 to E3)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe import rules
from hushframe.functions import sqlnames
from hushframe.operators import audit, gates, incremental, inventory, mask, resolve
from hushframe.operators.batching import chunks
from hushframe.operators.correlate import per_key
from hushframe.plans import eventlogs, records, reports, technical
from hushframe.session import staged_path
from hushframe.sinks import publish as publishing
from hushframe.sinks import text as text_sinks
from hushframe.sources import payloads
from hushframe.sources.planfile import Plan, load_records_plan
from hushframe.streaming import eventlog_stream
from workload import bindings as b
from workload.base import bind, query, table, with_
from workload.classification import _E_PLAN, PLAN, T_PLAN, _resolved_events, resolved_technical
from workload.landing import ENUM, PLAN_FILE, SCORES, SKIPS, account_fields, described, listing, report_bodies, risk_pages, score_bodies
from workload.narrowing import EVENT_MASKED, GEO, event_rows, geo, logins, technical_fields
from workload.summaries import BATCHES_SQL, LANDED, RECONCILE, applied_records, batches, components, landed, retrieved
from workload.values import PATHS_SQL, SAFE_SQL, email_sql, id_sql, ip_sql, strip_sql, url_sql

RUN_DAY = dt.date(2024, 1, 20)


# ---------------------------------------------------------------- T1 to T9
@query(
    "t1_complete_days",
    "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM $events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1",
)
def _(spark, sf_dir):
    last = incremental.last_complete_day(RUN_DAY)
    rows = table(spark, sf_dir, "events")
    inside = rows.where(F.col("ts") < F.date_add(F.lit(last), 1).cast("timestamp_ntz"))
    return per_key(inside.withColumn("day", F.to_date("ts").cast("string")), "day", n=F.count(F.lit(1)))


_LEDGER_END = "(SELECT max(CAST(string_split(name, '_to_')[2] AS DATE)) FROM l WHERE sentinel AND contains(name, '_to_'))"


@query(
    "t2_window_plan",
    with_(l=b.LEDGER)
    + f"SELECT {_LEDGER_END} AS last_end, {_LEDGER_END} + 1 AS start, DATE '2024-01-19' AS stop, {_LEDGER_END} >= DATE '2024-01-19' AS up_to_date",
)
def _(spark, sf_dir):
    return incremental.window_plan(bind(spark, sf_dir, b.LEDGER), RUN_DAY)


@query(
    "t2_cold_start",
    with_(l=b.LEDGER)
    + "SELECT CAST(NULL AS DATE) AS last_end, DATE '2023-12-22' AS start, DATE '2024-01-19' AS stop, false AS up_to_date FROM l HAVING count(*) > 0",
)
def _(spark, sf_dir):
    ledger = bind(spark, sf_dir, b.LEDGER).withColumn("sentinel", F.lit(False))
    return incremental.window_plan(ledger, RUN_DAY)


@query(
    "t3_up_to_date",
    with_(l=b.LEDGER)
    + f"SELECT CAST(d AS DATE) AS run_day, {_LEDGER_END} >= CAST(d AS DATE) - 1 AS up_to_date FROM (SELECT unnest(['2024-01-15', '2024-01-16', '2024-01-17', '2024-01-20']) AS d) x",
)
def _(spark, sf_dir):
    ledger = bind(spark, sf_dir, b.LEDGER)
    plans = [
        incremental.window_plan(ledger, day).select(F.lit(day).alias("run_day"), "up_to_date")
        for day in (dt.date(2024, 1, 15), dt.date(2024, 1, 16), dt.date(2024, 1, 17), RUN_DAY)
    ]
    return resolve.union_all(plans)


@query(
    "t4_dated_slices",
    with_(e=b.EVENTS, m=EVENT_MASKED)
    + "SELECT REQUEST_ID, USER_NAME, CLIENT_IP, URI, log_date FROM m WHERE log_date BETWEEN '2024-01-16' AND '2024-01-19'",
)
def _(spark, sf_dir):
    rows = event_rows(spark, sf_dir).withColumn("log_date", F.to_date("log_date"))
    target = staged_path(spark, "slices")
    ledger = bind(spark, sf_dir, b.LEDGER)
    eventlogs.export(spark, target, {"Login": rows}, ledger, dt.date(2024, 1, 18))
    eventlogs.export(spark, target, {"Login": rows}, ledger, RUN_DAY)  # rewrites 16 and 17, adds 18 and 19
    written = spark.read.parquet(f"{target}/event_type=Login")
    return written.select("REQUEST_ID", "USER_NAME", "CLIENT_IP", "URI", F.col("log_date").cast("string").alias("log_date"))


@query(
    "t5_skipped_files",
    with_(events_=b.EVENTS, l=LANDED)
    + "SELECT event_id, event_type, CASE event_id % 13 WHEN 0 THEN 'fetch failed' ELSE 'parse failed' END AS reason FROM l WHERE event_id % 13 <= 1",
)
def _(spark, sf_dir):
    _, skipped = incremental.split_bad(landed(spark, sf_dir))
    return skipped.select("event_id", "event_type", "reason")


@query(
    "t6_object_tolerance",
    with_(events_=b.EVENTS, g=GEO)
    + "SELECT 'LoginHistory' AS object, count(*) AS n_rows, true AS ok FROM events_ UNION ALL SELECT 'LoginGeo', count(*), true FROM g UNION ALL SELECT 'AuthSession', 0, false",
)
def _(spark, sf_dir):
    tables = {"LoginHistory": logins(spark, sf_dir), "LoginGeo": geo(spark, sf_dir)}

    def open_table(name):
        return tables[name] if name in tables else spark.read.parquet(f"{sf_dir}/{name}.parquet")

    done, skipped = technical.extract(spark, open_table, technical_fields(spark), [*tables, "AuthSession"])
    counts = [t.frame.agg(F.lit(t.name).alias("object"), F.count(F.lit(1)).alias("n_rows"), F.lit(True).alias("ok")) for t in done]
    lost = skipped.select("object", F.lit(0).cast("bigint").alias("n_rows"), F.lit(False).alias("ok"))
    return resolve.union_all([*counts, lost])


_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark, sf_dir):
    return eventlog_stream.file_stream(spark, sf_dir, _EVENT_SCHEMA, pathGlobFilter="events.parquet")


def _stream_rows(stream):
    """The login shape of the raw stream, enough columns to mask."""
    user = F.col("user_id").cast("string")
    return stream.select(
        "event_id",
        F.concat(F.lit(" User"), user, F.lit("@Example.com")).alias("USER_NAME"),
        F.concat(F.lit("10.1."), (F.col("event_id") % 256).cast("string"), F.lit("."), user).alias("CLIENT_IP"),
        F.concat(F.lit("/"), F.col("event_type"), F.lit("?"), F.col("props")).alias("URI"),
        F.col("props").alias("QUERY"),
        F.to_date("ts").alias("log_date"),
    )


@query(
    "t7_stream_masking",
    """SELECT event_id, sha256('User' || CAST(user_id AS VARCHAR) || '@Example.com') AS USER_NAME,
 '10.1.' || CAST(event_id % 256 AS VARCHAR) || '.0' AS CLIENT_IP, '/' || event_type AS URI, CAST(ts AS DATE) AS log_date FROM $events""",
)
def _(spark, sf_dir):
    rows = _stream_rows(event_stream(spark, sf_dir))
    table_ = eventlogs.anonymise("Login", rows, keep=("event_id", "log_date"))
    target = staged_path(spark, "stream")
    for _ in range(2):  # the second run finds nothing new
        eventlog_stream.drain(table_, f"{target}/out", f"{target}/checkpoint", ("log_date",))
    return spark.read.parquet(f"{target}/out").select("event_id", "USER_NAME", "CLIENT_IP", "URI", "log_date")


@query(
    "t8_late_rows",
    "SELECT event_id FROM $events WHERE ts < TIMESTAMP '2024-01-16'",
)
def _(spark, sf_dir):
    last = incremental.latest_end(bind(spark, sf_dir, b.LEDGER)).first()["end"]
    return incremental.late_rows(table(spark, sf_dir, "events"), last).select("event_id")


@query(
    "t8_closed_days",
    """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM $events
 WHERE CAST(ts AS DATE) + 1 <= (SELECT max(ts) - INTERVAL 2 DAY FROM $events) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    days = eventlog_stream.closed_days(event_stream(spark, sf_dir), "ts", "2 days", "event_type")
    target = staged_path(spark, "days")
    eventlog_stream.drain_append(days, f"{target}/out", f"{target}/checkpoint")
    return spark.read.parquet(f"{target}/out")


@query(
    "t9_daily_counts",
    "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM $events GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return incremental.daily(table(spark, sf_dir, "events"), "ts", "event_type")


# ---------------------------------------------------------------- K1 to K3: text
ODD = "CASE WHEN event_id % 3 = 0 THEN 'a' || chr(9) || EVENT_TYPE WHEN event_id % 3 = 1 THEN 'say \"' || EVENT_TYPE || '\"' ELSE '' END"
ODD_ROWS = f"SELECT CAST(event_id AS STRING) AS Id, {ODD} AS Note, event_id % 2 = 0 AS Flag FROM events_"


@query(
    "k1_object_tsv",
    with_(events_=b.EVENTS, o=ODD_ROWS)
    + """SELECT 'Id' || chr(9) || 'Note' || chr(9) || 'Flag' AS line UNION ALL SELECT Id || chr(9) ||
 CASE WHEN Note LIKE '%' || chr(9) || '%' OR Note LIKE '%"%' THEN '"' || replace(Note, '"', '""') || '"' ELSE Note END
 || chr(9) || CASE WHEN Flag THEN 'True' ELSE 'False' END FROM o""",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, with_(events_=b.EVENTS) + ODD_ROWS)
    actions = tuple(mask.ColumnAction(name, "PASS") for name in ("Id", "Note", "Flag"))
    path = staged_path(spark, "tsv")
    text_sinks.write_tsv(mask.ClassifiedFrame("Odd", mask.mask(rows, actions), actions), path)
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    header = "Id\tNote\tFlag"  # each part file repeats it
    body = lines.where(F.col("line") != header)
    return body.union(lines.where(F.col("line") == header).distinct())


@query("k2_masked_event_log", with_(e=b.EVENTS) + EVENT_MASKED)
def _(spark, sf_dir):
    return eventlogs.anonymise("Login", event_rows(spark, sf_dir), keep=("log_date",)).frame


@query(
    "k2_event_csv",
    with_(e=b.EVENTS, m=EVENT_MASKED) + "SELECT REQUEST_ID, USER_NAME, CLIENT_IP, URI, CAST(RUN_TIME AS VARCHAR) AS RUN_TIME, log_date FROM m",
)
def _(spark, sf_dir):
    table_ = eventlogs.anonymise("Login", event_rows(spark, sf_dir), keep=("log_date",))
    path = staged_path(spark, "event-csv")
    text_sinks.write_csv(
        mask.ClassifiedFrame("Login", table_.frame, (*table_.actions, mask.ColumnAction("log_date", "PASS"))), path
    )
    columns = ["REQUEST_ID", "USER_NAME", "CLIENT_IP", "URI", "RUN_TIME", "log_date"]
    rows = spark.read.csv(path, header=True, escape='"').select(*columns)
    return rows.fillna("", ["USER_NAME", "CLIENT_IP", "URI"])


@query(
    "k3_technical_csv",
    with_(g=GEO) + "SELECT Id, Country, Subdivision FROM g",
)
def _(spark, sf_dir):
    done, _ = technical.extract(spark, {"LoginGeo": geo(spark, sf_dir)}.__getitem__, technical_fields(spark), ["LoginGeo"])
    path = staged_path(spark, "technical-csv")
    text_sinks.write_csv(done[0], path)
    return spark.read.csv(path, header=True, escape='"')


# ---------------------------------------------------------------- K4 to K8: audits, summaries, skips
@query(
    "k4_record_audit",
    with_(**PLAN)
    + """SELECT object, field, type, action, recipe, source, special_category, downgraded FROM applied
 UNION ALL SELECT '*', '__where__', '', 'WHERE', '', 'operator', false, false""",
)
def _(spark, sf_dir):
    rows = audit.where_row(audit.record_audit(applied_records(spark, sf_dir)), "AnnualRevenue > 5")
    return rows.drop("reason")


@query(
    "k5_event_audit",
    with_(**_E_PLAN)
    + """SELECT key AS "column", min(action) AS action, min(recipe) AS recipe, min(source) AS source, bool_or(downgraded) AS downgraded,
 string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM applied GROUP BY key""",
)
def _(spark, sf_dir):
    rows = _resolved_events(spark, sf_dir).drop("column").withColumnRenamed("key", "column")
    return audit.event_audit(rows).withColumn("event_types", F.array_join("event_types", ","))


@query(
    "k6_technical_audit",
    with_(**T_PLAN) + 'SELECT org || \'/\' || object AS object, field AS "column", type, action, recipe, source, downgraded FROM applied',
)
def _(spark, sf_dir):
    rows = resolved_technical(spark, sf_dir).withColumn("object", F.concat_ws("/", "org", "object"))
    return audit.technical_audit(rows)


@query(
    "k7_record_summary",
    with_(**PLAN)
    + """SELECT object, count(*) FILTER (action <> 'DROP') AS columns, string_agg(field, ',' ORDER BY position) FILTER (action <> 'DROP') AS kept,
 CAST(count(*) FILTER (downgraded) AS BIGINT) AS downgraded, CAST(sum(k) AS BIGINT) AS rows_out,
 count(*) FILTER (action = 'DROP') AS dropped FROM applied GROUP BY object""",
)
def _(spark, sf_dir):
    applied = applied_records(spark, sf_dir)
    rows = applied.groupBy("object").agg(F.sum("k").alias("rows_out"))
    summary = audit.record_summary(applied, rows)
    shape = "columns array<string>, downgraded array<string>, rows_out bigint, action_counts map<string,bigint>"
    parsed = F.from_json("summary", shape)
    return summary.select("object", parsed.alias("s")).select(
        "object",
        F.size("s.columns").cast("bigint").alias("columns"),
        F.array_join("s.columns", ",").alias("kept"),
        F.size("s.downgraded").cast("bigint").alias("downgraded"),
        "s.rows_out",
        F.coalesce(F.col("s.action_counts")["DROP"], F.lit(0)).cast("bigint").alias("dropped"),
    )


@query(
    "k7_event_summary",
    with_(**_E_PLAN, events_=b.EVENTS, l=LANDED, named="SELECT DISTINCT key, action FROM applied")
    + """SELECT (SELECT count(*) FROM named WHERE action = 'DROP') AS dropped, (SELECT count(*) FROM l WHERE event_id % 13 > 1) AS files,
 (SELECT count(*) FROM l WHERE event_id % 13 <= 1) AS skipped, (SELECT count(*) FROM l WHERE event_id % 13 > 1 AND event_type = 'view') AS views""",
)
def _(spark, sf_dir):
    columns = _resolved_events(spark, sf_dir).drop("column").withColumnRenamed("key", "column")
    good, bad = incremental.split_bad(landed(spark, sf_dir))
    summary = eventlogs.run_summary(columns, good, bad)
    shape = "column_action_counts map<string,bigint>, files bigint, records_by_type map<string,bigint>, skipped bigint"
    return summary.select(F.from_json("summary", shape).alias("s")).select(
        F.col("s.column_action_counts")["DROP"].alias("dropped"), "s.files", "s.skipped",
        F.col("s.records_by_type")["view"].alias("views"),
    )


@query(
    "k7_technical_summary",
    with_(**T_PLAN)
    + """SELECT org, object, count(*) FILTER (action <> 'DROP') AS columns, count(*) FILTER (action = 'DERIVE') AS derived,
 count(*) FILTER (action = 'RAW') AS raw FROM applied GROUP BY org, object""",
)
def _(spark, sf_dir):
    summary = audit.object_summaries(resolved_technical(spark, sf_dir), "org", "object")
    parsed = F.from_json("summary", "columns bigint, action_counts map<string,bigint>")

    def count_of(action):
        return F.coalesce(F.col("s.action_counts")[action], F.lit(0)).cast("bigint")

    return summary.select("org", "object", parsed.alias("s")).select(
        "org", "object", "s.columns", count_of("DERIVE").alias("derived"), count_of("RAW").alias("raw")
    )


def all_skips(spark, sf_dir):
    lost = inventory.listing_skips(described(spark, sf_dir), listing(spark, sf_dir))
    return lost.unionByName(inventory.partial_retrieves(components(spark, sf_dir), retrieved(spark, sf_dir)))


_ALL_SKIPS = with_(
    **ENUM, **RECONCILE, skips=SKIPS,
    partials="SELECT type, requested, coalesce(retrieved, 0) AS retrieved FROM req LEFT JOIN got USING (type) WHERE coalesce(retrieved, 0) < requested",
)


@query(
    "k8_skip_report",
    _ALL_SKIPS
    + """SELECT type, bucket, CAST(NULL AS BIGINT) AS requested, CAST(NULL AS BIGINT) AS retrieved FROM skips
 UNION ALL SELECT type, 'partial_retrieve', requested, retrieved FROM partials""",
)
def _(spark, sf_dir):
    return inventory.skip_report(all_skips(spark, sf_dir))


@query(
    "k8_skip_lines",
    _ALL_SKIPS
    + """SELECT type, bucket, 'skip ' || type || ' [' || bucket || ']: ' || detail AS line FROM skips UNION ALL
 SELECT type, 'partial_retrieve', 'skip ' || type || ' [partial_retrieve] (requested=' || CAST(requested AS VARCHAR) || ', retrieved='
 || CAST(retrieved AS VARCHAR) || '): fewer components than requested' FROM partials""",
)
def _(spark, sf_dir):
    return inventory.skip_lines(all_skips(spark, sf_dir))


# ---------------------------------------------------------------- K9 to K12: documents
@query(
    "k9_manifest_blocks",
    BATCHES_SQL
    + """SELECT batch, type, '  <types>' || chr(10) || string_agg('    <members>' || member || '</members>' || chr(10), '' ORDER BY member)
 || '    <name>' || type || '</name>' || chr(10) || '  </types>' AS block FROM batches GROUP BY batch, type""",
)
def _(spark, sf_dir):
    return inventory.manifest_blocks(chunks(batches(spark, sf_dir)))


@query(
    "k9_manifest_documents",
    BATCHES_SQL
    + f"""SELECT batch, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Package xmlns="{rules.MANIFEST_NAMESPACE}">' || chr(10)
 || string_agg(block || chr(10), '' ORDER BY type) || '  <version>{rules.MANIFEST_VERSION}</version>' || chr(10) || '</Package>' || chr(10) AS document
 FROM (SELECT batch, type, '  <types>' || chr(10) || string_agg('    <members>' || member || '</members>' || chr(10), '' ORDER BY member)
 || '    <name>' || type || '</name>' || chr(10) || '  </types>' AS block FROM batches GROUP BY batch, type) x GROUP BY batch""",
)
def _(spark, sf_dir):
    return inventory.manifest_documents(inventory.manifest_blocks(chunks(batches(spark, sf_dir))))


@query(
    "k10_rename_map",
    PATHS_SQL
    + f"SELECT ltrim(path, '/') AS original, {SAFE_SQL} AS extracted FROM p WHERE path NOT LIKE '../%' AND ltrim(path, '/') <> {SAFE_SQL}",
)
def _(spark, sf_dir):
    return inventory.rename_map(bind(spark, sf_dir, b.PATHS))


@query(
    "k11_health_documents",
    with_(s=SCORES, r=b.RISKS)
    + """SELECT s.org, s.Score AS score, count(*) AS risk_count, string_agg(r.Setting, ',' ORDER BY r.RiskType, r.Setting) AS settings
 FROM s JOIN r ON r.org = s.org GROUP BY s.org, s.Score""",
)
def _(spark, sf_dir):
    scores = payloads.read_health_scores(score_bodies(spark, sf_dir))
    documents = reports.health_documents(scores, payloads.read_health_risks(risk_pages(spark, sf_dir)))
    shape = "Risks array<struct<RiskType:string,Setting:string>>, SecurityHealthCheck struct<Id:string,Score:int>, risk_count bigint"
    return documents.select("org", F.from_json("document", shape).alias("d")).select(
        "org", F.col("d.SecurityHealthCheck.Score").alias("score"), "d.risk_count",
        F.array_join(F.col("d.Risks.Setting"), ",").alias("settings"),
    )


@query(
    "k12_analysis_documents",
    with_(v=b.VIOLATIONS)
    + """SELECT l_orderkey, '{"engine_versions":{"' || engine || '":"1.' || CAST(severity AS VARCHAR) || '"},"org_alias":"o' || CAST(l_orderkey AS VARCHAR)
 || '","output_files":{"csv":"code_analyser_results_o' || CAST(l_orderkey AS VARCHAR) || '.csv","html":"code_analyser_results_o' || CAST(l_orderkey AS VARCHAR)
 || '.html","json":"code_analyser_results_o' || CAST(l_orderkey AS VARCHAR) || '.json"},"violation_counts":{"total":1,"sev1":' || CAST((severity = 1)::INT AS VARCHAR)
 || ',"sev2":' || CAST((severity = 2)::INT AS VARCHAR) || ',"sev3":' || CAST((severity = 3)::INT AS VARCHAR) || ',"sev4":' || CAST((severity = 4)::INT AS VARCHAR)
 || ',"sev5":' || CAST((severity = 5)::INT AS VARCHAR) || '}}' AS document FROM v""",
)
def _(spark, sf_dir):
    found = payloads.read_reports(report_bodies(spark, sf_dir))
    keyed = found.withColumn("org", F.concat(F.lit("o"), F.col("l_orderkey").cast("string")))
    documents = reports.analysis_documents(keyed.withColumn("org", F.col("org")))
    return documents.select(F.substring("org", 2, 30).cast("bigint").alias("l_orderkey"), "document")


# ---------------------------------------------------------------- K13, K14: publish
@query(
    "k13_published_records",
    with_(a=b.ACCOUNTS)
    + f"""SELECT Id, OwnerId, Industry, AnnualRevenue, {id_sql('Website_ID__c')} AS Website_ID__c, {email_sql('Contact_Email__c')} AS Contact_Email__c,
 sha256(Phone) AS Phone, string_split(upper({strip_sql('MailingPostalCode')}), ' ')[1] AS MailingPostalCode,
 CASE WHEN Birthdate = 'unknown' THEN '' ELSE substr(Birthdate, 1, 4) END AS Birthdate FROM a""",
)
def _(spark, sf_dir):
    target = staged_path(spark, "published")
    plan = load_records_plan(PLAN_FILE)
    records.export(spark, target, {"Account": bind(spark, sf_dir, b.ACCOUNTS)}, account_fields(spark), plan)
    return publishing.read_published(spark, target, "Account")


@query(
    "k14_sentinel",
    "SELECT false AS before, count(*) AS n_rows, CAST(1 AS INTEGER) AS purged FROM $customer",
)
def _(spark, sf_dir):
    target = staged_path(spark, "sentinel")
    try:
        publishing.read_published(spark, target, "rows")
        before = True
    except publishing.PublishError:
        before = False
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    for _ in range(2):
        publishing.publish(spark, target, {"rows": rows, "audit": rows.limit(1)}, "audit")
    purged = publishing.purge_superseded(spark, target)
    return publishing.read_published(spark, target, "rows").agg(
        F.lit(before).alias("before"), F.count(F.lit(1)).alias("n_rows"), F.lit(purged).alias("purged")
    )


# ---------------------------------------------------------------- E1 to E3
@query(
    "e1_stage_protocol",
    "SELECT 1 AS stage_no, 'long text' AS stage, CAST(doc_id AS VARCHAR) AS path, 'length' AS category, CAST(n_chars AS VARCHAR) AS detail FROM $documents WHERE n_chars > 5000",
)
def _(spark, sf_dir):
    long_text = gates.Stage(
        "long text",
        lambda frame: frame.where(F.col("n_chars") > 5000).select(
            F.col("doc_id").alias("path"), F.lit("length").alias("category"), F.col("n_chars").cast("string").alias("detail")
        ),
    )
    return gates.run_stages(table(spark, sf_dir, "documents"), [gates.noop_stage(), long_text])


@query(
    "e2_any_source",
    with_(events_=b.EVENTS) + f"SELECT '0Yx' || CAST(event_id AS VARCHAR) AS Id, {ip_sql('CLIENT_IP')} AS SourceIp FROM events_",
)
def _(spark, sf_dir):
    staged = staged_path(spark, "orc")
    logins(spark, sf_dir).write.orc(staged)
    done, _ = technical.extract(spark, lambda _: spark.read.orc(staged), technical_fields(spark), ["LoginHistory"], Plan())
    return done[0].frame.select("Id", "SourceIp")


@query(
    "e3_sql_names",
    with_(e=b.EVENTS)
    + f"SELECT event_id, {email_sql('USER_NAME')} AS mail, {id_sql('SESSION_KEY')} AS sess, {ip_sql('CLIENT_IP')} AS ip, {url_sql('URI')} AS url FROM e",
)
def _(spark, sf_dir):
    sqlnames.register(spark)
    return bind(spark, sf_dir, b.EVENTS).selectExpr(
        "event_id", "hf_hash_email(USER_NAME) AS mail", "hf_hash_id(SESSION_KEY) AS sess",
        "hf_ip_prefix(CLIENT_IP) AS ip", "hf_clean_url(URI) AS url",
    )

