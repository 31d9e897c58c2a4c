"""Sources (S1 to S16): payloads made of table rows, read back by the readers."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators import inventory
from hushframe.operators.incremental import header_scan
from hushframe.operators.ranking import next_page, pages
from hushframe.plans import eventlogs, records
from hushframe.session import staged, staged_path
from hushframe.sinks.files import delete
from hushframe.sources import payloads
from hushframe.sources.catalogue import catalogue
from hushframe.sources.eventlog import columns_by_type, field_names, read_bodies
from hushframe.sources.manifest import parse_manifests, read_manifests
from hushframe.sources.planfile import load_records_plan
from hushframe.sources.reports import read_report_files
from workload import bindings as b
from workload.base import bind, query, sql_list, table, with_
from workload.values import WS, email_sql, id_sql, ip_sql, strip_sql

PLAN_FILE = Path(__file__).parent / "files" / "account_plan.toml"


# ---------------------------------------------------------------- S1, S2: describe
def describe_bodies(spark, sf_dir):
    """A describe payload per object: 40 consecutive part keys, so 40 fields."""
    field = F.struct(
        "position",
        F.when(F.col("name") == "Stage", "").otherwise(F.col("name")).alias("name"),
        F.concat(F.lit("<b>"), F.col("label"), F.lit("  </b>\n")).alias("label"),
        F.upper("type").alias("type"),
        F.when(F.col("length") > 0, F.col("length")).alias("length"),
        "custom",
        "calculated",
        F.nullif("formula", F.lit("")).alias("calculatedFormula"),
        F.col("help_text").alias("inlineHelpText"),
    )
    rows = bind(spark, sf_dir, b.FIELDS).groupBy("object").agg(F.array_sort(F.collect_list(field)).alias("fields"))
    plain = F.to_json(F.struct("fields"))
    wrapped = F.to_json(F.struct(F.struct("fields").alias("result")))
    return rows.select("object", F.when(F.length("object") % 2 == 0, wrapped).otherwise(plain).alias("body"))


@query(
    "s1_describe_scan",
    with_(fields=b.FIELDS)
    + r"""SELECT object, position, name, 'b' || label || ' /b' AS label, type, length, custom, calculated, formula,
 trim(regexp_replace(help_text, '\s+', ' ', 'g')) AS help_text FROM fields WHERE name <> 'Stage'""",
)
def _(spark, sf_dir):
    return payloads.read_describe(describe_bodies(spark, sf_dir)).select(
        "object", "position", "name", "label", "type", "length", "custom", "calculated", "formula", "help_text"
    )


def technical_bodies(spark, sf_dir):
    """A describe payload per organisation and object, 48 fields at most."""
    field = F.struct("name", "type", F.when(~F.col("queryable"), F.lit(False)).alias("queryable"))
    rows = bind(spark, sf_dir, b.TECHNICAL).groupBy("org", "object").agg(F.collect_list(field).alias("fields"))
    return rows.select("org", "object", F.to_json(F.struct("fields")).alias("body"))


_SELECTED = f"""SELECT org, object, name, type FROM technical WHERE queryable
 AND lower(type) NOT IN ({sql_list(rules.BLOB_TYPES)}) AND name NOT IN ({sql_list(rules.BLOB_NAMES)})"""


@query("s2_technical_describe", with_(technical=b.TECHNICAL) + _SELECTED)
def _(spark, sf_dir):
    return payloads.read_technical_describe(technical_bodies(spark, sf_dir)).select("org", "object", "name", "type")


@query(
    "s2_objects_without_fields",
    with_(technical=b.TECHNICAL, kept=_SELECTED)
    + """SELECT DISTINCT org || '/' || object AS object, 'no safe queryable fields' AS reason FROM technical t
 WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.org = t.org AND k.object = t.object)""",
)
def _(spark, sf_dir):
    bodies = technical_bodies(spark, sf_dir).select(F.concat_ws("/", "org", "object").alias("object"), "body")
    return payloads.objects_without_fields(bodies)


# ---------------------------------------------------------------- S3 to S5: records and pages
_ORDER = "Id:string,OwnerId:string,Status:string,Amount:double"


def order_pages(spark, sf_dir):
    """Result pages of 200 orders; ten to a chain, the eighth says it is the last."""
    record = F.struct(
        F.struct(F.lit("Order").alias("type"), F.lit("/x").alias("url")).alias("attributes"),
        F.concat(F.lit("801"), F.col("o_orderkey").cast("string")).alias("Id"),
        F.col("o_custkey").cast("string").alias("OwnerId"),
        F.nullif("o_orderstatus", F.lit("P")).alias("Status"),
        F.col("o_totalprice").alias("Amount"),
    )
    rows = table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey div 2000").alias("chain"), F.expr("(o_orderkey div 200) % 10").alias("page"), record.alias("r")
    )
    grouped = rows.groupBy("chain", "page").agg(F.collect_list("r").alias("records"))
    last = F.col("page") == 7
    return grouped.select(
        "chain",
        "page",
        F.to_json(
            F.struct("records", last.alias("done"), F.when(~last, F.lit("/next")).alias("nextRecordsUrl"))
        ).alias("body"),
    )


_ORDER_SQL = """SELECT CAST(floor(o_orderkey / 2000) AS BIGINT) AS chain, CAST(floor(o_orderkey / 200) AS BIGINT) % 10 AS page,
 '801' || CAST(o_orderkey AS VARCHAR) AS Id, CAST(o_custkey AS VARCHAR) AS OwnerId, nullif(o_orderstatus, 'P') AS Status,
 o_totalprice AS Amount FROM $orders"""


@query("s3_record_scan", _ORDER_SQL)
def _(spark, sf_dir):
    return payloads.read_records(order_pages(spark, sf_dir), _ORDER)


@query("s4_page_chains", f"SELECT * FROM ({_ORDER_SQL}) o WHERE page <= 7")
def _(spark, sf_dir):
    return payloads.read_paged(order_pages(spark, sf_dir), _ORDER, "chain", "page")


_NAMES = "SELECT o_orderkey, 'QN' || CAST(o_orderkey AS STRING) AS QualifiedApiName FROM $orders"


@query(
    "s5_key_pages",
    with_(o=_NAMES)
    + "SELECT QualifiedApiName, CAST(floor((row_number() OVER (ORDER BY QualifiedApiName) - 1) / 2000) AS BIGINT) AS page FROM o",
)
def _(spark, sf_dir):
    names = bind(spark, sf_dir, _NAMES).select("QualifiedApiName")
    return pages(names, "QualifiedApiName", rules.PAGE_ROWS)


@query(
    "s5_next_page",
    with_(o=_NAMES) + "SELECT QualifiedApiName FROM o WHERE QualifiedApiName > 'QN12' ORDER BY QualifiedApiName LIMIT 2000",
)
def _(spark, sf_dir):
    return next_page(bind(spark, sf_dir, _NAMES).select("QualifiedApiName"), "QualifiedApiName", "QN12", rules.PAGE_ROWS)


# ---------------------------------------------------------------- S6 to S8: event logs
def headers(spark, sf_dir):
    return bind(spark, sf_dir, b.HEADERS)


@query(
    "s6_header_scan",
    with_(h=b.HEADERS)
    + """SELECT Id, EventType, CAST(LogFileLength AS BIGINT) AS LogFileLength FROM h WHERE Interval = 'Daily' AND EventType IN ('Login', 'API')
 AND log_ts >= TIMESTAMP '2024-01-05' AND log_ts < TIMESTAMP '2024-01-21'""",
)
def _(spark, sf_dir):
    found = header_scan(
        headers(spark, sf_dir), dt.date(2024, 1, 5), dt.date(2024, 1, 20), ["Login", "API"], time="log_ts"
    )
    return found.select("Id", "EventType", "LogFileLength")


#: Cells written per event type, and the (longer or shorter) header they are read with.
_FILES = {
    "view": (["event_id", "USER_NAME", "QUERY"], ["event_id", "USER_NAME", "QUERY"]),
    "click": (["event_id", "URI", "QUERY"], ["event_id", "URI"]),
    "error": (["event_id", "CLIENT_IP"], ["event_id", "CLIENT_IP", "URI", "QUERY"]),
    "purchase": (["event_id", "QUERY", "RUN_TIME"], ["event_id", "QUERY", "RUN_TIME"]),
    "signup": (["event_id", "SESSION_KEY"], ["event_id", "SESSION_KEY"]),
}
_QUERY_CELL = "CASE WHEN event_id % 3 = 0 THEN QUERY || chr(10) || 'two, lines' ELSE QUERY END"


@query(
    "s7_event_bodies",
    with_(e=b.EVENTS)
    + f"""SELECT event_type AS source, CAST(event_id AS VARCHAR) AS event_id,
 CASE WHEN event_type = 'view' THEN USER_NAME END AS USER_NAME,
 CASE WHEN event_type = 'click' THEN URI WHEN event_type = 'error' THEN '' END AS URI,
 CASE WHEN event_type = 'error' THEN CLIENT_IP END AS CLIENT_IP,
 CASE WHEN event_type IN ('view', 'purchase') THEN {_QUERY_CELL} WHEN event_type = 'error' THEN '' END AS QUERY,
 CASE WHEN event_type = 'purchase' THEN CAST(RUN_TIME AS VARCHAR) END AS RUN_TIME,
 CASE WHEN event_type = 'signup' THEN SESSION_KEY END AS SESSION_KEY FROM e""",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, b.EVENTS).withColumn("QUERY", F.expr(_QUERY_CELL))
    root = staged_path(spark, "bodies")
    parts = []
    for event_type, (written, read) in _FILES.items():
        path = f"{root}/{event_type}"
        (
            rows.where(F.col("EVENT_TYPE") == event_type)
            .select(*written)
            .write.option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path, header=True, escape='"', emptyValue="")
        )
        parts.append(read_bodies(spark, path, read).withColumn("source", F.lit(event_type)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


#: Headers of files of one type: in another order, with fewer and with more columns.
_MIXED = (
    ["event_id", "USER_NAME", "COUNTRY_CODE", "QUERY"],
    ["COUNTRY_CODE", "event_id", "USER_NAME"],
    ["QUERY", "COUNTRY_CODE", "RUN_TIME", "USER_NAME", "CLIENT_IP", "event_id"],
)


@query(
    "s7_mixed_headers",
    with_(e=b.EVENTS)
    + f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {id_sql('USER_NAME')} AS USER_NAME, coalesce(COUNTRY_CODE, '') AS COUNTRY_CODE,
 CASE WHEN event_id % 3 = 2 THEN CAST(RUN_TIME AS VARCHAR) ELSE '' END AS RUN_TIME,
 CASE WHEN event_id % 3 = 2 THEN {ip_sql('CLIENT_IP')} ELSE '' END AS CLIENT_IP FROM e""",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, b.EVENTS)
    path = staged_path(spark, "mixed-headers")
    for k, header in enumerate(_MIXED):
        (
            rows.where(F.col("event_id") % len(_MIXED) == k)
            .select(*header)
            .write.mode("append")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(path, header=True, escape='"', emptyValue="")
        )
    return eventlogs.anonymise("Login", read_bodies(spark, path)).frame


_NAMES_SQL = f"list_filter(list_transform(string_split(LogFileFieldNames, ','), lambda c: trim(c, {WS})), lambda c: c <> '')"


@query(
    "s8_columns_by_type",
    with_(h=b.HEADERS, f=f"SELECT EventType, {_NAMES_SQL.replace('LogFileFieldNames', 'arg_min(LogFileFieldNames, Id)')} AS names FROM h GROUP BY EventType")
    + 'SELECT EventType AS event_type, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS position, unnest(names) AS "column" FROM f',
)
def _(spark, sf_dir):
    return columns_by_type(headers(spark, sf_dir))


@query(
    "s8_header_names",
    with_(h=b.HEADERS) + f"SELECT Id, array_to_string({_NAMES_SQL}, '|') AS names FROM h",
)
def _(spark, sf_dir):
    return headers(spark, sf_dir).select("Id", F.array_join(field_names(F.col("LogFileFieldNames")), "|").alias("names"))


# ---------------------------------------------------------------- S9, S10: limits and counts
@query(
    "s9_limits",
    """SELECT c_nationkey AS org, 'Limit' || c_mktsegment AS LimitName, count(*) * 10 AS Max, CAST(floor(sum(c_custkey % 7)) AS BIGINT) AS Remaining
 FROM $customer GROUP BY c_nationkey, c_mktsegment""",
)
def _(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(
        (F.count(F.lit(1)) * 10).alias("Max"), F.sum(F.col("c_custkey") % 7).alias("Remaining")
    )
    entry = F.struct(F.concat(F.lit("Limit"), F.col("c_mktsegment")), F.struct("Max", "Remaining"))
    bodies = counts.groupBy(F.col("c_nationkey").alias("org")).agg(  # five segments
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("json")
    )
    spliced = F.concat(F.lit('{"Edition":"dev","Days":3,"Flags":[1,2],'), F.expr("substring(json, 2)"))
    return payloads.read_limits(bodies.select("org", spliced.alias("body")))


@query(
    "s10_record_counts",
    "SELECT o_orderstatus AS org, o_orderpriority AS ObjectName, count(*) AS RecordCount FROM $orders GROUP BY ALL",
)
def _(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.col("o_orderpriority").alias("name"), F.col("n").alias("count"))
    bodies = counts.groupBy(F.col("o_orderstatus").alias("org")).agg(  # five priorities
        F.to_json(F.struct(F.collect_list(entry).alias("sObjects"))).alias("body")
    )
    return payloads.read_record_counts(bodies)


# ---------------------------------------------------------------- S11: health check
def risk_pages(spark, sf_dir):
    """Risk pages; an organisation has 40 consecutive suppliers at most."""
    record = F.struct(
        F.struct(F.lit("Risk").alias("type")).alias("attributes"),
        "RiskType", "Setting", "SettingGroup", "OrgValue", "StandardValue",
    )
    rows = bind(spark, sf_dir, b.RISKS).groupBy("org", "page").agg(F.collect_list(record).alias("records"))
    return rows.select(
        "org",
        "page",
        F.to_json(F.struct("records", F.lit(False).alias("done"), F.lit("/next").alias("nextRecordsUrl"))).alias("body"),
    )


@query(
    "s11_health_risks",
    with_(r=b.RISKS) + "SELECT org, page, RiskType, Setting, SettingGroup, OrgValue, StandardValue FROM r",
)
def _(spark, sf_dir):
    return payloads.read_health_risks(risk_pages(spark, sf_dir))


SCORES = f"""SELECT org, 'id' || org AS Id, CAST(count(*) % 100 AS INT) AS Score FROM ({b.RISKS}) r GROUP BY org"""


def score_bodies(spark, sf_dir):
    rows = bind(spark, sf_dir, SCORES)
    record = F.struct(F.struct(F.lit("Check").alias("type")).alias("attributes"), "Id", "Score")
    return rows.select("org", F.to_json(F.struct(F.array(record).alias("records"), F.lit(True).alias("done"))).alias("body"))


@query("s11_health_scores", with_(s=SCORES) + "SELECT org, Id, Score FROM s")
def _(spark, sf_dir):
    return payloads.read_health_scores(score_bodies(spark, sf_dir))


# ---------------------------------------------------------------- S12: analysis reports
def report_bodies(spark, sf_dir):
    """One report per line item with one finding; the second location is primary."""
    place = lambda file, line: F.struct(file.alias("file"), line.alias("startLine"))
    finding = F.struct(
        "rule",
        "engine",
        "severity",
        F.split("tag_list", ",").alias("tags"),
        F.when(F.col("engine") == "cpd", 1).otherwise(0).alias("primaryLocationIndex"),
        F.array(
            place(F.col("file"), F.col("line")), place(F.concat(F.col("file"), F.lit("2")), F.col("line") + 1)
        ).alias("locations"),
        F.concat(F.lit('said "'), F.col("rule"), F.lit('"')).alias("message"),
    )
    counts = F.struct(
        F.lit(1).alias("total"), *[F.when(F.col("severity") == s, 1).otherwise(0).alias(f"sev{s}") for s in range(1, 6)]
    )
    versions = F.create_map(F.col("engine"), F.concat(F.lit("1."), F.col("severity").cast("string")))
    return bind(spark, sf_dir, b.VIOLATIONS).select(
        "l_orderkey",
        F.to_json(
            F.struct(
                F.lit("/run").alias("runDir"),
                counts.alias("violationCounts"),
                versions.alias("versions"),
                F.array(finding).alias("violations"),
            )
        ).alias("body"),
    )


@query(
    "s12_violations",
    with_(v=b.VIOLATIONS)
    + """SELECT l_orderkey, rule, engine, severity, tag_list AS tags, file || CASE WHEN engine = 'cpd' THEN '2' ELSE '' END AS file,
 CAST(line + CASE WHEN engine = 'cpd' THEN 1 ELSE 0 END AS INTEGER) AS line, 'said "' || rule || '"' AS message FROM v""",
)
def _(spark, sf_dir):
    found = payloads.read_violations(report_bodies(spark, sf_dir))
    return found.withColumn("tags", F.array_join("tags", ","))


_REPORTED = "SELECT CAST(floor(l_orderkey / 20000) AS BIGINT) AS report, * FROM v"
#: Findings whose reports lie on disk at once, in all and per core; the larger number counts, and a report is whole.
REPORT_ROWS, CORE_ROWS = 16_000_000, 1_000_000


def report_batches(spark, rows):
    """Conditions that part the findings into batches of whole reports, by ranges of keys; the driver sees one row per report."""
    most = max(REPORT_ROWS, CORE_ROWS * spark.sparkContext.defaultParallelism)
    key = F.col("l_orderkey")
    counts = rows.groupBy("report").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))
    batches = []
    for n, first, last in counts.orderBy("report").select("n", "first", "last").toLocalIterator():
        if batches and batches[-1][0] + n <= most:
            held, begin, _ = batches.pop()
            n, first = held + n, first if begin is None else begin
        batches.append((n, first, last))
    ranges = [key.between(F.lit(first), F.lit(last)) for _, first, last in batches]
    return [ranges[0] | key.isNull(), *ranges[1:]] if ranges else [F.lit(True)]


def report_files(rows, path):
    """Folder with one large document per 20,000 orders; every finding holds braces in strings and a nested array.

    What is shuffled and sorted are the cells; the text is made of them as it is written.
    """
    place = lambda file: F.struct(file.alias("file"), F.col("line").alias("startLine"))
    finding = F.struct(
        "rule", "engine", "severity", F.split("tag_list", ",").alias("tags"), F.lit(0).alias("primaryLocationIndex"),
        F.array(place(F.col("file")), place(F.lit("}],{"))).alias("locations"),
        F.concat(F.lit('\\ "violations": [{'), F.col("rule"), F.lit('}] "')).alias("message"),
        F.array(F.struct(F.array(F.struct(F.lit("x").alias("rule"))).alias("violations"))).alias("resources"),
    )
    told = rows.select(
        "report", F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "rule", "engine", "severity", "tag_list", "file", "line"
    )
    ends = rows.select("report").distinct().select("report", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("k"), F.lit('{"runDir": "/violations", "tools": [{"rule": "none"}], "violations": [').alias("end")),
        F.struct(F.lit(2**62).alias("k"), F.lit('{"rule": "last"}], "versions": {"pmd": "1"}, "other": [{"rule": "none"}]}').alias("end")),
    )).alias("e")).select("report", "e.k", F.lit(0).alias("n"), "e.end")
    lines = told.unionByName(ends, allowMissingColumns=True).repartition("report").sortWithinPartitions("report", "k", "n")
    value = F.coalesce("end", F.concat(F.to_json(finding), F.lit(",")))
    lines.select("report", value.alias("value")).write.partitionBy("report").text(path)
    return path


@query(
    "s12_report_files",
    with_(v=b.VIOLATIONS, r=_REPORTED)
    + """SELECT CAST(report AS STRING) AS report, rule, engine, severity, tag_list AS tags, file, line, '\\ "violations": [{' || rule || '}] "' AS message FROM r
 UNION ALL SELECT DISTINCT CAST(report AS STRING), 'last', NULL, CAST(NULL AS INTEGER), NULL, NULL, CAST(NULL AS INTEGER), NULL FROM r""",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, with_(v=b.VIOLATIONS) + _REPORTED)
    batches = report_batches(spark, rows)
    parts = []
    for k, batch in enumerate(batches, 1):
        root = staged_path(spark, "reports")
        found = read_report_files(spark, report_files(rows.where(batch), f"{root}/files"), root)
        found = found.withColumns({"report": F.regexp_extract("report", "report=([0-9]+)", 1), "tags": F.array_join("tags", ",")})
        if k < len(batches):  # the files of the last batch stay, as its findings are read when they are asked for
            found = staged(found, "report-findings")
            delete(spark, root)
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)


@query(
    "s12_report_counts",
    with_(v=b.VIOLATIONS)
    + """SELECT engine, '1.' || CAST(severity AS VARCHAR) AS version, count(*) AS total, count(*) FILTER (severity = 1) AS sev1,
 count(*) FILTER (severity = 5) AS sev5 FROM v GROUP BY engine, severity""",
)
def _(spark, sf_dir):
    reports = payloads.read_reports(report_bodies(spark, sf_dir))
    rows = reports.select(F.explode_outer("versions").alias("engine", "version"), "violationCounts.*")
    return rows.groupBy("engine", "version").agg(
        F.sum("total").alias("total"), F.sum("sev1").alias("sev1"), F.sum("sev5").alias("sev5")
    )


# ---------------------------------------------------------------- S13, S14: manifests, listings
def manifest_texts(spark, sf_dir):
    """Manifests of 1,000 consecutive parts each, with blanks and repeated types."""
    rows = bind(spark, sf_dir, b.COMPONENTS).withColumn("chunk", F.expr("k div 1000"))
    members = rows.groupBy("type", "chunk").agg(F.collect_list("member").alias("members"))
    lines = F.array_join(
        F.transform("members", lambda m: F.concat(F.lit("<members> "), m, F.lit(" </members><members> </members>"))), ""
    )
    block = F.concat(F.lit("<types>"), lines, F.lit("<name>"), F.col("type"), F.lit("</name></types>"))
    blocks = members.select("chunk", F.concat(block, block).alias("block")).groupBy("chunk").agg(
        F.array_join(F.collect_list("block"), "").alias("blocks")
    )
    return blocks.select(
        "chunk", F.concat(F.lit("<Package>"), F.col("blocks"), F.lit("<version>61.0</version></Package>")).alias("body")
    )


_MEMBERS_SQL = with_(c=b.COMPONENTS) + "SELECT DISTINCT type, member FROM c"


@query("s13_manifest_texts", _MEMBERS_SQL)
def _(spark, sf_dir):
    return parse_manifests(manifest_texts(spark, sf_dir))


@query("s13_manifest_files", _MEMBERS_SQL)
def _(spark, sf_dir):
    path = staged_path(spark, "manifests")
    manifest_texts(spark, sf_dir).write.partitionBy("chunk").text(path)
    return read_manifests(spark, path)


def described(spark, sf_dir):
    return bind(spark, sf_dir, with_(listing=b.LISTING) + b.DESCRIBED)


def listing(spark, sf_dir):
    return bind(spark, sf_dir, b.LISTING)


_OPEN = "('Report', 'Dashboard', 'EmailTemplate')"
ENUM = dict(
    listing=b.LISTING,
    described=b.DESCRIBED,
    candidates=f"""SELECT type FROM (SELECT type FROM described UNION SELECT unnest(['ApexClass', 'ApexTrigger', 'StandardValueSet'])) x
 WHERE type NOT IN ('Report', 'Dashboard', 'EmailTemplate', 'Document') AND type NOT IN ({sql_list(rules.DENIED)})""",
    folders="""SELECT CASE type WHEN 'ReportFolder' THEN 'Report' ELSE 'Dashboard' END AS type, member AS folder FROM listing
 WHERE type IN ('ReportFolder', 'DashboardFolder') AND error IS NULL
 UNION SELECT unnest(['Report', 'Dashboard']), 'unfiled$$public'""",
    components=f"""SELECT type, member FROM listing l WHERE error IS NULL AND folder IS NULL AND type IN (SELECT type FROM candidates)
 UNION SELECT l.type, l.member FROM listing l JOIN folders f ON f.type = l.type AND f.folder = l.folder
   WHERE l.error IS NULL AND l.type IN {_OPEN}
 UNION SELECT type, member FROM listing WHERE error IS NULL AND type IN ('ReportFolder', 'DashboardFolder', 'EmailFolder')""",
)


@query("s14_enumerate", with_(**ENUM) + "SELECT type, member FROM components")
def _(spark, sf_dir):
    return inventory.enumerate_components(described(spark, sf_dir), listing(spark, sf_dir))


SKIPS = f"""SELECT CASE type WHEN 'ReportFolder' THEN 'Report' WHEN 'DashboardFolder' THEN 'Dashboard' ELSE type END AS type, error,
 CASE WHEN contains(upper(error), 'INSUFFICIENT_ACCESS') THEN 'insufficient_access' WHEN contains(upper(error), 'CANNOT USE') THEN 'invalid_type'
 ELSE 'unknown' END AS bucket, CASE WHEN length(error) > 400 THEN substr(error, 1, 400) || '...' ELSE error END AS detail
 FROM listing WHERE error IS NOT NULL AND (type IN {_OPEN} OR type IN ('ReportFolder', 'DashboardFolder')
 OR (folder IS NULL AND type IN (SELECT type FROM candidates WHERE type NOT IN ('ReportFolder', 'DashboardFolder'))))"""


@query("s14_listing_skips", with_(**ENUM, skips=SKIPS) + "SELECT type, bucket, detail FROM skips")
def _(spark, sf_dir):
    return inventory.listing_skips(described(spark, sf_dir), listing(spark, sf_dir)).select("type", "bucket", "detail")


# ---------------------------------------------------------------- S15, S16
@query(
    "s15_catalogue",
    with_(technical=b.TECHNICAL)
    + f"""SELECT t.object, c.transport, c.position, count(*) AS fields FROM technical t JOIN
 (SELECT * FROM (VALUES {', '.join(f"({i}, '{o}', '{t}')" for i, (o, t) in enumerate(rules.CATALOGUE))}) AS x(position, object, transport)) c
 ON c.object = t.object GROUP BY ALL""",
)
def _(spark, sf_dir):
    known = F.broadcast(catalogue(spark))  # 40 fixed rows
    return bind(spark, sf_dir, b.TECHNICAL).join(known, "object").groupBy("object", "transport", "position").agg(
        F.count(F.lit(1)).alias("fields")
    )


def account_fields(spark):
    rows = [("Account", i, n, label, t, length) for i, (n, t, label, length) in enumerate(b.ACCOUNT_FIELDS)]
    frame = spark.createDataFrame(rows, "object string, position int, name string, label string, type string, length int")
    blank = F.lit("")
    return frame.select(
        "*", F.lit(False).alias("custom"), F.lit(False).alias("calculated"), blank.alias("formula"), blank.alias("help_text")
    )


@query(
    "s16_plan_file",
    with_(a=b.ACCOUNTS)
    + f"""SELECT Id, OwnerId, Industry, AnnualRevenue, {id_sql('Website_ID__c')} AS Website_ID__c,
 {email_sql('Contact_Email__c')} AS Contact_Email__c, sha256(Phone) AS Phone,
 string_split(upper({strip_sql('MailingPostalCode')}), ' ')[1] AS MailingPostalCode,
 CASE WHEN Birthdate = 'unknown' THEN '' ELSE substr(Birthdate, 1, 4) END AS Birthdate FROM a""",
)
def _(spark, sf_dir):
    plan = load_records_plan(PLAN_FILE)
    (masked,) = records.extract({"Account": bind(spark, sf_dir, b.ACCOUNTS)}, account_fields(spark), plan)
    return masked.frame

