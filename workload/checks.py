"""Gates (G1 to G10) over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators import gates, inventory, resolve, secrets
from hushframe.operators.mask import mask
from hushframe.plans import eventlogs
from workload import bindings as b
from workload.base import bind, query, sql_list, table, with_
from workload.classification import PLAN, fields
from workload.narrowing import EVENT_MASKED, event_rows
from workload.outputs import _ALL_SKIPS, all_skips
from workload.summaries import applied_records, components
from workload.values import RECORD_ACTIONS, RECORDS_MASKED_SQL

_P = rules.LEAK_PATTERNS


def _detect(key: str, column: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, '{name}' AS category, sha256(unnest(regexp_extract_all({column}, '{p}'))) AS detail FROM {source}"
        for name, p in _P.items()
    )


@query("g1_document_findings", _detect("doc_id", "text", "$documents"))
def _(spark, sf_dir):
    return gates.findings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    "g1_scrub_stages",
    f"SELECT category, count(*) AS n FROM ({_detect('page_id', 'html', '$pages')} UNION ALL {_detect('conv_id', 'text', '$conversations')}) x GROUP BY category",
)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.col("html").alias("body"))
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k"), F.col("text").alias("body"))
    stages = [gates.noop_stage(), gates.detector_stage("k", "body")]
    found = gates.run_stages(pages.union(chats), stages)
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_HEX = "'0123456789abcdef'"
_HASHED = "md5(CAST({k} AS STRING))"
_DENSE = f"translate({_HASHED}, {_HEX}, 'aB3dE6gH9jK2mN5p') || translate(md5(CAST({{k}} + 1 AS STRING)), {_HEX}, 'qR8sT1uV4wX7yZ0c')"


def _key_text(k: str) -> str:
    """A key of a shape that depends on the row, or none, or something that only looks like one."""
    hashed, dense = _HASHED.format(k=k), _DENSE.format(k=k)
    return f"""CASE {k} % 13 WHEN 0 THEN 'AKIA' || upper(substr({hashed}, 1, 16)) WHEN 1 THEN 'ghp_' || {hashed} || 'Ab12'
 WHEN 2 THEN 'eyJ' || {hashed} || '.' || {hashed} || '.' || {hashed} WHEN 3 THEN 'ftp://robot:' || {hashed} || '@host'
 WHEN 4 THEN '-----BEGIN RSA PRIVATE KEY-----' WHEN 5 THEN 'xoxb-' || {hashed} WHEN 6 THEN 'sk_live_' || {hashed}
 WHEN 7 THEN 'AIza' || {hashed} || 'xyz' WHEN 8 THEN 'API_KEY: "' || {hashed} || '"' WHEN 9 THEN {dense}
 WHEN 10 THEN 'password = "aaaaaaa1"' WHEN 11 THEN 'digest ' || {hashed} ELSE 'secret = "nothing-here"' END"""


KEYED_DOCUMENTS = f"SELECT doc_id, text || ' ' || {_key_text('doc_id')} AS body FROM $documents"
KEYED_PATHS = f"""SELECT 'customMetadata/' || CAST(p_size AS STRING) || '/' || CASE WHEN p_partkey % 13 IN (3, 4, 8, 10, 12) THEN p_name ELSE {_key_text('p_partkey')} END
 || '.' || CAST(p_partkey AS STRING) AS path FROM $part"""


def _secrets(key: str, column: str, source: str) -> str:
    shapes = [
        f"SELECT {key}, '{name}' AS category, unnest(regexp_extract_all({column}, '{pattern}')) AS hit FROM {source}"
        for name, (_, pattern) in rules.SECRET_SHAPES.items()
    ]
    assignment = rules.SECRET_ASSIGNMENT.replace("'", "''")
    bits = "list_aggregate(string_split(hit, ''), 'entropy')"
    valued = f"""SELECT {key}, 'assigned secret' AS category, hit FROM (SELECT {key}, unnest(regexp_extract_all({column}, '{assignment}', 1)) AS hit FROM {source}) v
 WHERE regexp_matches(hit, '[0-9]') AND {bits} >= {rules.SECRET_VALUE_BITS}"""
    dense = f"""SELECT {key}, 'dense run' AS category, hit FROM (SELECT {key}, unnest(regexp_extract_all({column}, '{rules.SECRET_RUN}')) AS hit FROM {source}) d
 WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND {bits} >= {rules.SECRET_RUN_BITS}"""
    return f"SELECT {key}, category, sha256(hit) AS detail FROM ({' UNION ALL '.join([*shapes, valued, dense])}) f"


@query("g1_secret_scan", with_(k=KEYED_DOCUMENTS) + _secrets("doc_id", "body", "k"))
def _(spark, sf_dir):
    return secrets.secret_findings(bind(spark, sf_dir, KEYED_DOCUMENTS), "doc_id", "body")


@query(
    "g1_name_shapes",
    with_(k=KEYED_PATHS, c="SELECT path, regexp_replace(unnest(string_split(path, '/')), '\\.[0-9A-Za-z]{1,5}$', '') AS name FROM k")
    + _secrets("path", "name", "c"),
)
def _(spark, sf_dir):
    stages = [secrets.name_stage("path")]
    return gates.run_stages(bind(spark, sf_dir, KEYED_PATHS), stages).select("path", "category", "detail")


@query(
    "g2_raw_ip_rows",
    f"SELECT doc_id FROM $documents WHERE regexp_matches(text, '{_P['ip']}')",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(gates.has_raw_ip(F.col("text"))).select("doc_id")


def masked_events(spark, sf_dir):
    return eventlogs.anonymise("Login", event_rows(spark, sf_dir), keep=("log_date",)).frame


_MASKED_COLUMNS = ["USER_NAME", "CLIENT_IP", "URI", "SESSION_KEY"]


def _per_column(test: str, name: str, columns=None) -> str:
    return with_(e=b.EVENTS, m=EVENT_MASKED) + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({test.replace("{c}", c)}) AS {name} FROM m" for c in columns or _MASKED_COLUMNS
    )


@query("g2_masked_ip_leaks", _per_column("regexp_matches({c}, '" + _P["ip"] + "')", "leaks"))
def _(spark, sf_dir):
    return gates.count_per_column(masked_events(spark, sf_dir), _MASKED_COLUMNS, gates.has_raw_ip, "leaks")


@query(
    "g3_clear_emails",
    with_(e=b.EVENTS)
    + f"SELECT 'USER_NAME' AS \"column\", count(*) FILTER (regexp_matches(USER_NAME, '{_P['email']}')) AS leaks FROM e "
    + f"UNION ALL SELECT 'QUERY', count(*) FILTER (regexp_matches(QUERY, '{_P['email']}')) FROM e",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, b.EVENTS)
    return gates.count_per_column(rows, ["USER_NAME", "QUERY"], gates.has_clear_email, "leaks")


@query("g3_masked_emails", _per_column("regexp_matches({c}, '" + _P["email"] + "')", "leaks"))
def _(spark, sf_dir):
    return gates.count_per_column(masked_events(spark, sf_dir), _MASKED_COLUMNS, gates.has_clear_email, "leaks")


@query(
    "g4_header_check",
    with_(**PLAN, shown="SELECT object, field FROM applied WHERE action <> 'DROP' OR k % 10 = 0 UNION SELECT object, field || '_extra' FROM applied WHERE k % 50 = 0")
    + """SELECT s.object, s.field, CASE WHEN a.object IS NULL THEN 'not audited' ELSE 'dropped column published' END AS problem
 FROM shown s LEFT JOIN applied a ON a.object = s.object AND a.field = s.field WHERE a.object IS NULL OR a.action = 'DROP'""",
)
def _(spark, sf_dir):
    audit = applied_records(spark, sf_dir)
    leaked = audit.where((F.col("action") != "DROP") | (F.col("k") % 10 == 0)).select("object", "field")
    extra = audit.where(F.col("k") % 50 == 0).select("object", F.concat("field", F.lit("_extra")).alias("field"))
    return gates.header_violations(leaked.union(extra), audit)


@query(
    "g5_hash_shape",
    with_(e=b.EVENTS, m=EVENT_MASKED)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (NOT regexp_matches({c}, '{rules.HASH_SHAPE}')) AS misshapen FROM m"
        for c in ("USER_NAME", "SESSION_KEY")
    ),
)
def _(spark, sf_dir):
    return gates.count_per_column(
        masked_events(spark, sf_dir), ["USER_NAME", "SESSION_KEY"], lambda c: ~gates.is_hash_shaped(c), "misshapen"
    )


@query(
    "g6_query_strings",
    with_(e=b.EVENTS, m=EVENT_MASKED)
    + "SELECT 'raw' AS state, count(*) FILTER (contains(URI, '?')) AS n FROM e UNION ALL SELECT 'masked', count(*) FILTER (contains(URI, '?')) FROM m",
)
def _(spark, sf_dir):
    raw = gates.count_per_column(event_rows(spark, sf_dir), ["URI"], gates.has_query_string, "n")
    masked = gates.count_per_column(masked_events(spark, sf_dir), ["URI"], gates.has_query_string, "n")
    return raw.select(F.lit("raw").alias("state"), "n").union(masked.select(F.lit("masked").alias("state"), "n"))


@query(
    "g7_action_sums",
    with_(**PLAN)
    + """SELECT f.object, f.n AS expected, nullif(count(a.object), 0) AS audited FROM (SELECT object, count(*) AS n FROM fields GROUP BY object) f
 LEFT JOIN (SELECT * FROM applied WHERE k % 41 <> 0) a ON a.object = f.object GROUP BY f.object, f.n HAVING count(a.object) <> f.n""",
)
def _(spark, sf_dir):
    audited = applied_records(spark, sf_dir).where(F.col("k") % 41 != 0)  # an audit with holes
    return gates.uneven_counts(audited, fields(spark, sf_dir)).select("object", "expected", "audited")


@query(
    "g8_bucket_domain",
    _ALL_SKIPS
    + """SELECT type, 'lost' AS bucket, count(*) AS n FROM skips WHERE bucket = 'unknown' GROUP BY type""",
)
def _(spark, sf_dir):
    spoiled = all_skips(spark, sf_dir).withColumn(
        "bucket", F.when(F.col("bucket") == "unknown", "lost").otherwise(F.col("bucket"))
    )
    return resolve.tally(inventory.bad_buckets(spoiled), "type", "bucket")


@query(
    "g8_denied_listed",
    with_(c=b.COMPONENTS) + f"SELECT count(*) AS listed, count(*) FILTER (type IN ({sql_list(rules.DENIED)})) AS denied FROM c WHERE type NOT IN ({sql_list(rules.DENIED)})",
)
def _(spark, sf_dir):
    return components(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("listed"), F.count_if(F.col("type").isin(*rules.DENIED)).alias("denied")
    )


def twice(spark, sf_dir):
    """The same masking over differently partitioned input."""
    rows = bind(spark, sf_dir, b.ACCOUNTS)
    return mask(rows, RECORD_ACTIONS), mask(rows.repartition(7), RECORD_ACTIONS)


@query("g9_determinism", with_(a=b.ACCOUNTS, m=RECORDS_MASKED_SQL) + "SELECT count(*) AS rows, true AS same_digest FROM m")
def _(spark, sf_dir):
    return gates.same_digest(*twice(spark, sf_dir))


@query("g9_differences", "SELECT CAST(0 AS BIGINT) AS different FROM $customer HAVING count(*) > 0")
def _(spark, sf_dir):
    return gates.differences(*twice(spark, sf_dir)).agg(F.count(F.lit(1)).alias("different"))


@query(
    "g10_profile",
    with_(e=b.EVENTS)
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{name}' AS detector, count(*) AS rows, count(*) FILTER (regexp_matches({c}, '{p}')) AS hits, "
        f"round(count(*) FILTER (regexp_matches({c}, '{p}')) / count(*), 6) AS share FROM e"
        for c in ("USER_NAME", "CLIENT_IP", "URI", "SESSION_KEY")
        for name, p in _P.items()
    ),
)
def _(spark, sf_dir):
    return gates.profile(bind(spark, sf_dir, b.EVENTS), ["USER_NAME", "CLIENT_IP", "URI", "SESSION_KEY"])
