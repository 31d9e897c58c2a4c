"""Value transforms (V1 to V20) over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions import dates, masking, paths, text
from hushframe.operators.mask import ColumnAction, as_cells, long_cells, mask, record_action
from workload import bindings as b
from workload.base import bind, query, table, with_

#: The stripped characters, written out for the checking SQL.
WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in rules.WHITESPACE) + ")"


def strip_sql(value: str) -> str:
    return f"trim({value}, {WS})"


def email_sql(value: str) -> str:
    return f"CASE WHEN coalesce({strip_sql(value)}, '') = '' THEN '' ELSE sha256(lower({strip_sql(value)})) END"


def id_sql(value: str) -> str:
    return f"CASE WHEN coalesce({strip_sql(value)}, '') = '' THEN '' ELSE sha256({strip_sql(value)}) END"


def ip_sql(value: str) -> str:
    v = strip_sql(value)
    return (
        f"CASE WHEN regexp_full_match({v}, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}(:[0-9]+)?') "
        f"THEN array_to_string(string_split({v}, '.')[1:3], '.') || '.0' "
        f"WHEN regexp_matches({v}, '^[0-9A-Fa-f]{{1,4}}:') "
        f"THEN array_to_string(string_split(string_split({v}, '::')[1], ':')[1:3], ':') || '::' ELSE '' END"
    )


def quad_sql(value: str) -> str:
    return rf"regexp_replace({value}, '(\b[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.)[0-9]+\b', '\10', 'g')"


def url_sql(value: str) -> str:
    return quad_sql(f"regexp_extract({strip_sql(value)}, '^[^?;#]*')")


EVENTS_SQL = with_(e=b.EVENTS)
ACCOUNTS_SQL = with_(a=b.ACCOUNTS)


@query("v1_hash_email", EVENTS_SQL + f"SELECT event_id, {email_sql('USER_NAME')} AS out FROM e")
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.EVENTS).select("event_id", masking.hash_email(F.col("USER_NAME")).alias("out"))


@query("v2_hash_id", ACCOUNTS_SQL + f"SELECT Id, {id_sql('Website_ID__c')} AS out FROM a")
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.ACCOUNTS).select("Id", masking.hash_id(F.col("Website_ID__c")).alias("out"))


@query("v3_ip_prefix", EVENTS_SQL + f"SELECT event_id, {ip_sql('CLIENT_IP')} AS out FROM e")
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.EVENTS).select("event_id", masking.ip_prefix(F.col("CLIENT_IP")).alias("out"))


@query(
    "v4_clean_url",
    EVENTS_SQL
    + f"SELECT 'events' AS src, event_id AS id, {url_sql('URI')} AS out FROM e "
    + f"UNION ALL SELECT 'pages', page_id, {url_sql('url')} FROM $pages",
)
def _(spark, sf_dir):
    events = bind(spark, sf_dir, b.EVENTS).select(F.lit("events").alias("src"), F.col("event_id").alias("id"), "URI")
    pages = table(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), "url")
    return events.union(pages).select("src", "id", masking.clean_url(F.col("URI")).alias("out"))


@query("v5_mask_quads", f"SELECT doc_id, {quad_sql('text')} AS out FROM $documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", masking.mask_quads(F.col("text")).alias("out"))


@query(
    "v6_outcode",
    ACCOUNTS_SQL + f"SELECT Id, string_split(upper({strip_sql('MailingPostalCode')}), ' ')[1] AS out FROM a",
)
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.ACCOUNTS).select("Id", masking.outcode(F.col("MailingPostalCode")).alias("out"))


@query(
    "v7_birth_year",
    ACCOUNTS_SQL + "SELECT Id, CASE WHEN Birthdate = 'unknown' THEN '' ELSE substr(Birthdate, 1, 4) END AS out FROM a",
)
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.ACCOUNTS).select("Id", masking.birth_year(F.col("Birthdate")).alias("out"))


@query(
    "v8_cell_text",
    ACCOUNTS_SQL
    + "SELECT Id, CASE WHEN IsActive THEN 'True' ELSE 'False' END AS IsActive, "
    "CAST(AnnualRevenue AS VARCHAR) AS AnnualRevenue, coalesce(nullif(Industry, 'BUILDING'), '') AS Industry FROM a",
)
def _(spark, sf_dir):
    rows = bind(spark, sf_dir, b.ACCOUNTS).withColumn("Industry", F.nullif("Industry", F.lit("BUILDING")))
    return as_cells(rows.select("Id", "IsActive", "AnnualRevenue", "Industry"))


RECORD_ACTIONS = [
    record_action("Id", "RAW"),
    record_action("Website_ID__c", "HASH_ID"),
    record_action("Contact_Email__c", "HASH_EMAIL"),
    record_action("MailingPostalCode", "DERIVE"),
    record_action("Birthdate", "DERIVE"),
    record_action("Phone", "DERIVE"),
    record_action("Ethnicity__c", "DROP"),
    record_action("Industry", "PASS"),
    record_action("IsActive", "HASH_ID"),
]
RECORDS_MASKED_SQL = f"""SELECT Id, {id_sql('Website_ID__c')} AS Website_ID__c, {email_sql('Contact_Email__c')} AS Contact_Email__c,
  string_split(upper({strip_sql('MailingPostalCode')}), ' ')[1] AS MailingPostalCode,
  CASE WHEN Birthdate = 'unknown' THEN '' ELSE substr(Birthdate, 1, 4) END AS Birthdate, Industry,
  sha256(CASE WHEN IsActive THEN 'True' ELSE 'False' END) AS IsActive FROM a"""


@query("v9_record_actions", ACCOUNTS_SQL + RECORDS_MASKED_SQL)
def _(spark, sf_dir):
    return mask(bind(spark, sf_dir, b.ACCOUNTS), RECORD_ACTIONS)


EVENT_ACTIONS = [
    ColumnAction("event_id", "RAW"),
    ColumnAction("USER_NAME", "HASH", "id"),
    ColumnAction("CLIENT_IP", "DERIVE", "ip_prefix"),
    ColumnAction("URI", "DERIVE", "url_sanitise"),
    ColumnAction("QUERY", "DROP"),
    ColumnAction("SESSION_KEY", "PASS"),
]


@query(
    "v10_event_actions",
    EVENTS_SQL
    + f"SELECT event_id, {id_sql('USER_NAME')} AS USER_NAME, {ip_sql('CLIENT_IP')} AS CLIENT_IP, "
    + f"{url_sql('URI')} AS URI, SESSION_KEY FROM e",
)
def _(spark, sf_dir):
    return mask(bind(spark, sf_dir, b.EVENTS), EVENT_ACTIONS)


@query(
    "v11_technical_actions",
    EVENTS_SQL
    + f"SELECT event_id, {email_sql('USER_NAME')} AS USER_NAME, {id_sql('SESSION_KEY')} AS SESSION_KEY, "
    + f"{ip_sql('CLIENT_IP')} AS CLIENT_IP, COUNTRY_CODE FROM e",
)
def _(spark, sf_dir):
    actions = [
        ColumnAction("event_id", "RAW"),
        ColumnAction("USER_NAME", "HASH", "email"),
        ColumnAction("SESSION_KEY", "HASH", "id"),
        ColumnAction("CLIENT_IP", "DERIVE", "ip_prefix"),
        ColumnAction("URI", "DERIVE", ""),
        ColumnAction("COUNTRY_CODE", "PASS"),
    ]
    return mask(bind(spark, sf_dir, b.EVENTS), actions)


@query(
    "v12_long_cells",
    ACCOUNTS_SQL
    + f"""SELECT Id, 'Account' AS object, 'Website_ID__c' AS field, {id_sql('Website_ID__c')} AS out FROM a
UNION ALL SELECT Id, 'Account', 'Contact_Email__c', {email_sql('Contact_Email__c')} FROM a
UNION ALL SELECT Id, 'Account', 'MailingPostalCode', string_split(upper({strip_sql('MailingPostalCode')}), ' ')[1] FROM a
UNION ALL SELECT Id, 'Account', 'Phone', '' FROM a
UNION ALL SELECT Id, 'Account', 'IsActive', CASE WHEN IsActive THEN 'True' ELSE 'False' END FROM a
UNION ALL SELECT Id, 'Account', 'AnnualRevenue', CAST(AnnualRevenue AS VARCHAR) FROM a""",
)
def _(spark, sf_dir):
    columns = ["Website_ID__c", "Contact_Email__c", "MailingPostalCode", "Phone", "IsActive", "AnnualRevenue"]
    actions = spark.createDataFrame(
        [
            ("Account", "Website_ID__c", "HASH_ID", ""),
            ("Account", "Contact_Email__c", "HASH_EMAIL", ""),
            ("Account", "MailingPostalCode", "DERIVE", "uk_postcode_outcode"),
            ("Account", "Phone", "DROP", ""),
            ("Account", "IsActive", "PASS", ""),
            ("Account", "AnnualRevenue", "RAW", ""),
        ],
        "object string, field string, action string, recipe string",
    )
    cells = long_cells(bind(spark, sf_dir, b.ACCOUNTS).select("Id", *columns), "Account", ("Id",))
    joined = cells.join(F.broadcast(actions), ["object", "field"])  # one row per field of one object
    return joined.select(
        "Id", "object", "field", masking.apply_action_column(F.col("value"), F.col("action"), F.col("recipe")).alias("out")
    )


DATES_SQL = with_(d=b.LOG_DATES)


@query(
    "v13_log_day",
    DATES_SQL
    + "SELECT event_id, CASE WHEN raw = 'no-date-here-T00' THEN 'no-date-he' "
    "ELSE substr(raw, 1, 10) END AS out FROM d",
)
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.LOG_DATES).select("event_id", dates.log_day(F.col("raw")).alias("out"))


PATHS_SQL = with_(p=b.PATHS)
LEGAL_SQL = """CASE WHEN rtrim(regexp_replace({n}, '[<>:"|?*]', '_', 'g'), ' .') = '' THEN '_'
 ELSE rtrim(regexp_replace({n}, '[<>:"|?*]', '_', 'g'), ' .') END"""
SHORT_SQL = """CASE WHEN length({n}) <= 120 THEN {n} ELSE
 substr(string_split({n}, '.')[1], 1, 120 - 9 - (CASE WHEN instr({n}, '.') > 0 THEN length({n}) - instr({n}, '.') + 1 ELSE 0 END))
 || '_' || substr(sha1({n}), 1, 8) || CASE WHEN instr({n}, '.') > 0 THEN substr({n}, instr({n}, '.')) ELSE '' END END"""


@query("v14_legal_component", PATHS_SQL + f"SELECT p_partkey, {LEGAL_SQL.format(n='path')} AS out FROM p")
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.PATHS).select("p_partkey", paths.legal_component(F.col("path")).alias("out"))


@query("v15_short_component", PATHS_SQL + f"SELECT p_partkey, {SHORT_SQL.format(n='path')} AS out FROM p")
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.PATHS).select("p_partkey", paths.short_component(F.col("path")).alias("out"))


SAFE_SQL = f"""array_to_string(list_transform(
  list_filter(string_split(ltrim(path, '/'), '/'), lambda c: c <> '' AND c <> '.'),
  lambda c: {SHORT_SQL.format(n='(' + LEGAL_SQL.format(n='c') + ')')}), '/')"""


@query("v16_safe_path", PATHS_SQL + rf"SELECT p_partkey, {SAFE_SQL} AS out, path LIKE '../%' AS escapes FROM p")
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.PATHS).select(
        "p_partkey", paths.safe_path(F.col("path")).alias("out"), paths.escapes_root(F.col("path")).alias("escapes")
    )


@query(
    "v18_skip_detail",
    with_(l=b.LISTING)
    + "SELECT type, CASE WHEN length(error) > 400 THEN substr(error, 1, 400) || '...' ELSE coalesce(error, '') END AS out FROM l",
)
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.LISTING).select("type", text.skip_detail(F.col("error")).alias("out"))


@query(
    "v19_window_bounds",
    DATES_SQL
    + "SELECT event_id, CAST(d AS VARCHAR) || ' 00:00:00' AS low, CAST(d + 3 AS VARCHAR) || ' 00:00:00' AS high FROM d",
)
def _(spark, sf_dir):
    low, high = dates.window_bounds(F.col("d"), F.date_add("d", 2))
    return bind(spark, sf_dir, b.LOG_DATES).select(
        "event_id", low.cast("string").alias("low"), high.cast("string").alias("high")
    )


@query(
    "v20_window_names",
    DATES_SQL
    + "SELECT event_id, CASE event_id % 4 WHEN 0 THEN d WHEN 1 THEN DATE '2024-01-05' END AS ends, "
    "CAST(d AS VARCHAR) || '_to_' || CAST(d + 1 AS VARCHAR) AS name FROM d",
)
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.LOG_DATES).select(
        "event_id",
        dates.window_end(F.col("window_name")).alias("ends"),
        dates.window_name(F.col("d"), F.date_add("d", 1)).alias("name"),
    )
