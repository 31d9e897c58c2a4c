"""Filters, scopes and caps (F1 to F16)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions.dates import in_window
from hushframe.operators import inventory, predicate
from hushframe.operators.classify import classify_technical, selectable
from hushframe.operators.incremental import unfinished
from hushframe.operators.mask import ColumnAction, mask
from hushframe.operators.ranking import cap_per_group
from hushframe.plans import eventlogs, records, technical
from hushframe.sources.catalogue import catalogue
from hushframe.sources.planfile import Plan
from workload import bindings as b
from workload.base import bind, query, sql_list, table, with_
from workload.classification import C3
from workload.landing import account_fields
from workload.values import email_sql, id_sql, ip_sql, url_sql

EVENT_MASKED = f"""SELECT EVENT_TYPE, TIMESTAMP_DERIVED, REQUEST_ID, USER_ID, {id_sql('USER_NAME')} AS USER_NAME,
 {ip_sql('CLIENT_IP')} AS CLIENT_IP, {url_sql('URI')} AS URI, SESSION_KEY, COUNTRY_CODE, RUN_TIME, log_date FROM e"""


def event_rows(spark, sf_dir):
    return bind(spark, sf_dir, b.EVENTS).select(*b.EVENT_HEADER, "log_date")


@query(
    "f1_record_projection",
    with_(a=b.ACCOUNTS)
    + f"""SELECT Id, OwnerId, Industry, AnnualRevenue, {id_sql('Website_ID__c')} AS Website_ID__c,
 {email_sql('Contact_Email__c')} AS Contact_Email__c, IsActive FROM a""",
)
def _(spark, sf_dir):
    (masked,) = records.extract({"Account": bind(spark, sf_dir, b.ACCOUNTS)}, account_fields(spark), None)
    return masked.frame


@query("f2_event_projection", with_(e=b.EVENTS) + EVENT_MASKED)
def _(spark, sf_dir):
    return eventlogs.anonymise("Login", event_rows(spark, sf_dir), keep=("log_date",)).frame


LOGINS = """SELECT '0Yx' || CAST(event_id AS STRING) AS Id, USER_ID AS UserId, CLIENT_IP AS SourceIp,
 CASE WHEN event_id % 3 = 0 THEN 'Success' ELSE 'Invalid Password' END AS Status, URI AS LoginUrl, COUNTRY_CODE AS CountryIso,
 'geo' || USER_ID AS LoginGeoId, QUERY AS Remark FROM events_"""
GEO = """SELECT 'geo005' || lpad(CAST(n_nationkey AS STRING), 6, '0') AS Id, 50.0 + n_nationkey AS Latitude, n_nationkey - 0.5 AS Longitude,
 'City ' || n_name AS City, 'P' || CAST(n_nationkey AS STRING) AS PostalCode, n_name AS Country, 'Sub' || n_name AS Subdivision FROM $nation"""
TECH_TABLES = {
    "LoginHistory": [
        ("Id", "id"), ("UserId", "reference"), ("SourceIp", "string"), ("Status", "string"), ("LoginUrl", "string"),
        ("CountryIso", "string"), ("LoginGeoId", "reference"), ("Remark", "textarea"),
    ],
    "LoginGeo": [
        ("Id", "id"), ("Latitude", "double"), ("Longitude", "double"), ("City", "string"), ("PostalCode", "string"),
        ("Country", "string"), ("Subdivision", "string"),
    ],
}


def logins(spark, sf_dir):
    return bind(spark, sf_dir, with_(events_=b.EVENTS) + LOGINS)


def geo(spark, sf_dir):
    return bind(spark, sf_dir, GEO)


def technical_fields(spark):
    rows = [(o, i, n, t, True) for o, fields in TECH_TABLES.items() for i, (n, t) in enumerate(fields)]
    return spark.createDataFrame(rows, "object string, position int, name string, type string, queryable boolean")


LOGINS_MASKED = f"""SELECT Id, UserId, {ip_sql('SourceIp')} AS SourceIp, Status, {url_sql('LoginUrl')} AS LoginUrl, CountryIso, LoginGeoId FROM l"""


@query("f3_technical_projection", with_(events_=b.EVENTS, l=LOGINS) + LOGINS_MASKED)
def _(spark, sf_dir):
    tables = {"LoginHistory": logins(spark, sf_dir)}
    done, _ = technical.extract(spark, tables.__getitem__, technical_fields(spark), ["LoginHistory"])
    return done[0].frame


@query(
    "f4_structural_skip",
    with_(technical=b.TECHNICAL)
    + f"""SELECT org, object, name, type FROM technical WHERE queryable AND lower(type) NOT IN ({sql_list(rules.BLOB_TYPES)})
 AND name NOT IN ({sql_list(rules.BLOB_NAMES)})""",
)
def _(spark, sf_dir):
    return selectable(bind(spark, sf_dir, b.TECHNICAL)).select("org", "object", "name", "type")


PREDICATES = """SELECT o_orderkey, CASE o_orderkey % 12
 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN 'Amount > 5; x' WHEN 3 THEN 'a = 1 -- b' WHEN 4 THEN 'a /* b */ = 1'
 WHEN 5 THEN 'Status = 1 or DELETE' WHEN 6 THEN 'x Update y' WHEN 7 THEN 'a limit 5' WHEN 8 THEN 'a = 1 OFFSET 3'
 WHEN 9 THEN ' CreatedDate = THIS_YEAR ' WHEN 10 THEN 'LastUpdated > 3 AND Dropped = 0'
 ELSE 'Status = ''' || o_orderstatus || ''' AND Priority = ''' || o_orderpriority || '''' END AS text FROM $orders"""


@query(
    "f5_predicate_check",
    with_(p=PREDICATES)
    + r"""SELECT o_orderkey, CASE WHEN trim(text) = '' THEN 'empty' WHEN contains(text, ';') THEN 'statement separator'
 WHEN contains(text, '--') OR contains(text, '/*') OR contains(text, '*/') THEN 'comment marker'
 WHEN regexp_matches(lower(text), '\b(insert|update|delete|merge|upsert|create|drop|alter|truncate|limit|offset)\b') THEN 'forbidden word' END AS problem FROM p""",
)
def _(spark, sf_dir):
    return bind(spark, sf_dir, PREDICATES).select("o_orderkey", predicate.predicate_problem(F.col("text")).alias("problem"))


@query(
    "f5_predicate_narrowing",
    with_(a=b.ACCOUNTS)
    + f"""SELECT Id, OwnerId, Industry, AnnualRevenue, {id_sql('Website_ID__c')} AS Website_ID__c,
 {email_sql('Contact_Email__c')} AS Contact_Email__c, IsActive FROM a WHERE AnnualRevenue > 5000 AND Phone LIKE '555-1%'""",
)
def _(spark, sf_dir):
    tables = {"Account": bind(spark, sf_dir, b.ACCOUNTS)}
    (masked,) = records.extract(tables, account_fields(spark), None, " AnnualRevenue > 5000 AND Phone LIKE '555-1%' ")
    return masked.frame


@query("f6_key_fallback", with_(a=b.ACCOUNTS) + "SELECT Id FROM a")
def _(spark, sf_dir):
    actions = [ColumnAction(name, "DROP") for name, *_ in b.ACCOUNT_FIELDS]
    return mask(bind(spark, sf_dir, b.ACCOUNTS), actions)


@query(
    "f8_ordered_scope",
    "SELECT user_id AS name, min(event_id) AS position FROM $events GROUP BY user_id",
)
def _(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("position"))
    return predicate.ordered_distinct(requests, "name", "position")


REQUESTED = """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Unknown' || CAST(p_size AS STRING) WHEN p_size % 5 = 1 THEN 'ApexClass'
 WHEN p_size % 5 = 2 THEN 'LoginHistory' WHEN p_size % 5 = 3 THEN 'limits' ELSE 'EntityDefinition' END AS object FROM $part"""


@query(
    "f9_catalogue_scope",
    with_(r=REQUESTED)
    + """SELECT p_partkey, object, CASE object WHEN 'ApexClass' THEN 'tooling' WHEN 'LoginHistory' THEN 'soql' WHEN 'limits' THEN 'rest_limits'
 WHEN 'EntityDefinition' THEN 'entitydef' END AS transport FROM r""",
)
def _(spark, sf_dir):
    known, unknown = predicate.catalogue_scope(bind(spark, sf_dir, REQUESTED), catalogue(spark))
    return known.select("p_partkey", "object", "transport").unionByName(
        unknown.select("p_partkey", "object", F.lit(None).cast("string").alias("transport"))
    )


@query(
    "f10_event_types",
    "SELECT event_type, count(*) AS n FROM $events WHERE event_type IN ('view', 'signup') GROUP BY event_type",
)
def _(spark, sf_dir):
    plan = Plan(scope=["view", "signup"])
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin(plan.scope))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f11_time_window",
    "SELECT event_id FROM $events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.where(in_window(F.col("ts"), dt.date(2024, 1, 5), dt.date(2024, 1, 10))).select("event_id")


@query("f12_deny_list", with_(c=b.COMPONENTS) + f"SELECT type, member FROM c WHERE type NOT IN ({sql_list(rules.DENIED)})")
def _(spark, sf_dir):
    return inventory.allowed(bind(spark, sf_dir, b.COMPONENTS)).select("type", "member")


@query(
    "f13_row_cap",
    """SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p
 FROM $orders) x WHERE p <= 3""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return cap_per_group(rows, ["o_custkey"], ["o_orderkey"], 3)


@query(
    "f13_large_row_cap",
    """SELECT o_orderstatus, o_orderkey FROM (SELECT o_orderstatus, o_orderkey,
 row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS p FROM $orders) x WHERE p <= 1500""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey")
    return cap_per_group(rows, ["o_orderstatus"], ["o_orderkey"], 1500)


@query(
    "f14_unfinished_files",
    with_(ledger=b.LEDGER, done="SELECT CAST(substr(name, 1, 10) AS DATE) AS d FROM ledger WHERE sentinel AND contains(name, '_to_')")
    + "SELECT event_id, CAST(ts AS DATE) AS log_date FROM $events WHERE CAST(ts AS DATE) NOT IN (SELECT d FROM done)",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.to_date("ts").alias("log_date"))
    return unfinished(rows, bind(spark, sf_dir, b.LEDGER), time="ts").select("event_id", "log_date")


@query("f15_geo_columns", GEO.replace("50.0 + n_nationkey AS Latitude, n_nationkey - 0.5 AS Longitude,", "").replace("'City ' || n_name AS City, 'P' || CAST(n_nationkey AS STRING) AS PostalCode,", ""))
def _(spark, sf_dir):
    done, _ = technical.extract(spark, {"LoginGeo": geo(spark, sf_dir)}.__getitem__, technical_fields(spark), ["LoginGeo"])
    return done[0].frame


@query(
    "f15_geo_rules",
    with_(**C3) + "SELECT object, name, action, count(*) AS n FROM classified WHERE rule = 'C3.7' GROUP BY ALL",
)
def _(spark, sf_dir):
    found = classify_technical(selectable(bind(spark, sf_dir, b.TECHNICAL))).where(F.col("rule") == "C3.7")
    return found.groupBy("object", "name", "action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f16_published_types",
    with_(l=b.LISTING) + "SELECT type, count(member) AS members FROM l GROUP BY type HAVING count(member) > 0",
)
def _(spark, sf_dir):
    return inventory.published_types(bind(spark, sf_dir, b.LISTING))
