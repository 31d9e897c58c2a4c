"""Classifiers (C1 to C8) and plan resolution (P1 to P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions.masking import derive_recipe
from hushframe.functions.text import schema_text
from hushframe.operators import audit, classify, resolve
from hushframe.plans import eventlogs as event_plan
from workload import bindings as b
from workload.base import bind, query, sql_list, table, with_
from workload.values import WS

# ---------------------------------------------------------------- checking SQL
def _hit(text: str, words) -> str:
    return f"list_filter([{sql_list(words)}], lambda w: contains({text}, lower(w)))[1]"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _ends(text: str, words) -> str:
    return "(" + " OR ".join(f"ends_with({text}, '{w}')" for w in words) + ")"


HITS = f"""SELECT *, {_hit('hay', rules.SPECIAL_CATEGORY)} AS special, {_hit('hay', rules.DIRECT_PII)} AS direct,
 {_hit('hay', rules.ESSAY_NAMES)} AS essay, {_hit('hay', rules.IDENTIFIERS)} AS ident,
 CASE WHEN calculated THEN {_hit('lower(formula)', rules.FORMULA_SOURCES)} END AS leak
 FROM (SELECT *, lower(name || chr(10) || label || chr(10) || help_text) AS hay FROM fields) h"""
RULED = f"""SELECT *, CASE WHEN type IN ('id', 'reference') THEN 'C1.1'
 WHEN lower(name) IN ({sql_list(rules.PARTNER_ID_NAMES)}) THEN 'C1.2' WHEN special IS NOT NULL THEN 'C1.3'
 WHEN name = 'Name' THEN 'C1.4' WHEN direct IS NOT NULL THEN 'C1.5'
 WHEN type = 'textarea' AND length >= 30000 THEN 'C1.6' WHEN essay IS NOT NULL AND length >= 1000 THEN 'C1.7'
 WHEN leak IS NOT NULL THEN 'C1.8' WHEN type = 'email' THEN 'C1.9'
 WHEN contains(hay, 'email') AND type IN ('string', 'textarea', 'url', '') THEN 'C1.10'
 WHEN ident IS NOT NULL THEN 'C1.11' ELSE 'C1.12' END AS rule FROM hits"""
CLASSIFIED = """SELECT *, CASE WHEN rule IN ('C1.1', 'C1.2') THEN 'RAW' WHEN rule IN ('C1.9', 'C1.10') THEN 'HASH_EMAIL'
 WHEN rule = 'C1.11' THEN 'HASH_ID' WHEN rule = 'C1.12' THEN 'PASS' ELSE 'DROP' END AS action,
 coalesce(CASE rule WHEN 'C1.3' THEN special WHEN 'C1.5' THEN direct WHEN 'C1.7' THEN essay WHEN 'C1.8' THEN leak
 WHEN 'C1.11' THEN ident END, '') AS matched, rule = 'C1.3' AS special_category FROM ruled"""
C1 = dict(fields=b.FIELDS, hits=HITS, ruled=RULED, classified=CLASSIFIED)

U = f"upper(trim(col_name, {WS}))"
EVENT_RULED = f"""SELECT *, CASE
 WHEN {U} IN ({sql_list(rules.EVENT_IP)}) OR ends_with({U}, '_IP') THEN 'C2.1'
 WHEN {U} IN ({sql_list(rules.EVENT_URL)}) OR {_ends(U, ('URI', 'URL'))} THEN 'C2.2'
 WHEN {U} IN ({sql_list(rules.EVENT_PERSON)}) THEN 'C2.3' WHEN {U} IN ({sql_list(rules.EVENT_CONTENT)}) THEN 'C2.4'
 WHEN {U} IN ({sql_list(rules.EVENT_KEYS)}) OR {_ends(U, rules.EVENT_KEY_SUFFIXES)} THEN 'C2.5'
 WHEN {_ends(U, rules.EVENT_CONTENT_SUFFIXES)} OR {_any(U, rules.EVENT_SECRET_WORDS)} THEN 'C2.6' ELSE 'C2.7' END AS rule FROM columns_"""
EVENT_ACTIONS = """SELECT *, CASE rule WHEN 'C2.1' THEN 'DERIVE' WHEN 'C2.2' THEN 'DERIVE' WHEN 'C2.3' THEN 'HASH'
 WHEN 'C2.5' THEN 'RAW' WHEN 'C2.7' THEN 'PASS' ELSE 'DROP' END AS action,
 CASE rule WHEN 'C2.1' THEN 'ip_prefix' WHEN 'C2.2' THEN 'url_sanitise' WHEN 'C2.3' THEN 'id' ELSE '' END AS recipe FROM ruled"""
C2 = dict(columns_=b.EVENT_COLUMNS, ruled=EVENT_RULED, classified=EVENT_ACTIONS)

_CUR = "object || '.' || name"
TECH_RULED = f"""SELECT *, CASE
 WHEN {_CUR} IN ({sql_list(f'{o}.{f}' for o, f, _, _ in rules.CURATED)}) THEN 'C3.1'
 WHEN lower(type) IN ('id', 'reference') OR {_ends('lower(name)', ('id', 'ids'))} THEN 'C3.2'
 WHEN ends_with(lower(name), 'ip') OR lower(name) IN ({sql_list(rules.TECHNICAL_IP_NAMES)}) THEN 'C3.3'
 WHEN lower(type) = 'email' OR (lower(type) IN ('string', 'email', 'url', '') AND contains(lower(name), 'email')) THEN 'C3.4'
 WHEN lower(type) = 'phone' OR {_any('lower(name)', ('phone', 'mobile'))} THEN 'C3.5'
 WHEN lower(type) = 'url' OR {_ends('lower(name)', ('url', 'uri'))} THEN 'C3.6'
 WHEN {_any('lower(name)', rules.FINE_GEO)} THEN 'C3.7f' WHEN {_any('lower(name)', rules.COARSE_GEO)} THEN 'C3.7c'
 WHEN {_any('lower(name)', rules.FREE_TEXT)} OR lower(name) IN ({sql_list(rules.LABEL_NAMES)}) THEN 'C3.8' ELSE 'C3.9' END AS r FROM selected"""
_CURATED_CASE = " ".join(f"WHEN '{o}.{f}' THEN '{a}|{r}'" for o, f, a, r in rules.CURATED)
TECH_ACTIONS = f"""SELECT *, substr(r, 1, 4) AS rule,
 CASE r WHEN 'C3.1' THEN string_split(CASE {_CUR} {_CURATED_CASE} END, '|')[1] WHEN 'C3.2' THEN 'RAW' WHEN 'C3.3' THEN 'DERIVE'
 WHEN 'C3.4' THEN 'HASH' WHEN 'C3.6' THEN 'DERIVE' WHEN 'C3.7c' THEN 'PASS' WHEN 'C3.9' THEN 'PASS' ELSE 'DROP' END AS action,
 CASE r WHEN 'C3.1' THEN string_split(CASE {_CUR} {_CURATED_CASE} END, '|')[2] WHEN 'C3.3' THEN 'ip_prefix' WHEN 'C3.4' THEN 'email'
 WHEN 'C3.6' THEN 'url_sanitise' ELSE '' END AS recipe FROM ruled"""
SELECTED = f"""SELECT * FROM technical WHERE queryable AND lower(type) NOT IN ({sql_list(rules.BLOB_TYPES)})
 AND name NOT IN ({sql_list(rules.BLOB_NAMES)})"""
C3 = dict(technical=b.TECHNICAL, selected=SELECTED, ruled=TECH_RULED, classified=TECH_ACTIONS)

_RECIPE = "CASE WHEN regexp_matches(lower({f}), 'postcode|postal|zip') THEN 'uk_postcode_outcode' WHEN regexp_matches(lower({f}), 'birth|dob') THEN 'year_of_birth' END"
RESOLVED = f"""SELECT c.object, c.position, c.name AS field, c.type, c.k, c.special_category, o.action AS ov, r.text AS given,
 CASE WHEN o.action = 'KEEP' THEN 'PASS' ELSE o.action END AS asked, c.action AS default_action,
 coalesce(o.action IS NOT NULL AND c.special_category AND o.action <> 'DROP' AND r.text IS NULL, false) AS downgraded
 FROM classified c LEFT JOIN overrides o ON o.object = c.object AND o.field = c.name
 LEFT JOIN reasons r ON r.object = c.object AND r.field = c.name"""
EFFECTIVE = f"""SELECT *, CASE WHEN downgraded THEN 'DROP' ELSE coalesce(asked, default_action) END AS chosen,
 CASE WHEN ov IS NULL THEN 'default' ELSE 'override' END AS source FROM resolved"""
APPLIED = f"""SELECT *, CASE WHEN chosen = 'DERIVE' AND {_RECIPE.format(f='field')} IS NULL THEN 'DROP' ELSE chosen END AS action,
 CASE WHEN chosen = 'DERIVE' THEN coalesce({_RECIPE.format(f='field')}, '') ELSE '' END AS recipe FROM effective"""
PLAN = dict(C1, overrides=b.OVERRIDES, reasons=b.REASONS, resolved=RESOLVED, effective=EFFECTIVE, applied=APPLIED)

T_RESOLVED = """SELECT c.org, c.object, c.name AS field, c.type, c.rule, c.action AS default_action, c.recipe AS default_recipe, o.action AS ov,
 CASE WHEN o.action = 'KEEP' THEN 'PASS' ELSE o.action END AS asked, r.text AS given
 FROM classified c LEFT JOIN overrides o ON o.org = c.org AND o.object = c.object AND o.field = c.name
 LEFT JOIN reasons r ON r.org = c.org AND r.object = c.object AND r.field = c.name"""
_EXP = "CASE {a} WHEN 'DROP' THEN 0 WHEN 'DERIVE' THEN 1 WHEN 'HASH' THEN 2 WHEN 'RAW' THEN 3 WHEN 'PASS' THEN 3 END"
T_EFFECTIVE = f"""SELECT *, coalesce({_EXP.format(a='asked')} > {_EXP.format(a='default_action')} AND given IS NULL, false) AS downgraded
 FROM resolved"""
T_APPLIED = """SELECT *, CASE WHEN downgraded OR asked IS NULL THEN default_action ELSE asked END AS action,
 CASE WHEN downgraded OR asked IS NULL OR asked = default_action THEN default_recipe WHEN asked = 'HASH' THEN 'id' ELSE '' END AS recipe,
 CASE WHEN ov IS NULL THEN 'default' ELSE 'override' END AS source FROM effective"""
T_PLAN = dict(C3, overrides=b.T_OVERRIDES, reasons=b.T_REASONS, resolved=T_RESOLVED, effective=T_EFFECTIVE, applied=T_APPLIED)


# ---------------------------------------------------------------- frames
def fields(spark, sf_dir):
    return bind(spark, sf_dir, b.FIELDS)


def record_plan(spark, sf_dir):
    base = dict(fields=b.FIELDS)
    return bind(spark, sf_dir, with_(**base) + b.OVERRIDES), bind(spark, sf_dir, with_(**base) + b.REASONS)


def known_fields(spark, sf_dir):
    return bind(spark, sf_dir, with_(fields=b.FIELDS) + b.KNOWN)


def resolved_records(spark, sf_dir):
    overrides, reasons = record_plan(spark, sf_dir)
    classified = classify.classify_records(fields(spark, sf_dir)).withColumnRenamed("name", "field")
    return resolve.resolve_records(classified, overrides, reasons)


def event_columns(spark, sf_dir):
    return bind(spark, sf_dir, b.EVENT_COLUMNS).withColumnRenamed("col_name", "column")


def technical(spark, sf_dir):
    return bind(spark, sf_dir, b.TECHNICAL)


def resolved_technical(spark, sf_dir):
    base = with_(technical=b.TECHNICAL)
    classified = classify.classify_technical(classify.selectable(technical(spark, sf_dir))).withColumnRenamed("name", "field")
    return resolve.resolve_exposure(
        classified, bind(spark, sf_dir, base + b.T_OVERRIDES), bind(spark, sf_dir, base + b.T_REASONS), ("org", "object", "field")
    )


# ---------------------------------------------------------------- C
@query("c1_record_fields", with_(**C1) + "SELECT object, name, k, rule, action, special_category, matched FROM classified")
def _(spark, sf_dir):
    found = classify.classify_records(fields(spark, sf_dir))
    matched = F.when(
        F.col("rule").isin("C1.3", "C1.5", "C1.7", "C1.8", "C1.11"), F.element_at(F.split("reason", ": "), -1)
    ).otherwise("")
    return found.select("object", "name", "k", "rule", "action", "special_category", matched.alias("matched"))


def _register_record_rules() -> None:
    for number in range(1, 13):
        rule = f"C1.{number}"

        def run(spark, sf_dir, rule=rule):
            found = classify.classify_records(fields(spark, sf_dir)).where(F.col("rule") == rule)
            return found.groupBy("name", "action").agg(F.count(F.lit(1)).alias("n"))

        query(
            f"c1_{number:02d}_rule",
            with_(**C1) + f"SELECT name, action, count(*) AS n FROM classified WHERE rule = '{rule}' GROUP BY name, action",
        )(run)


_register_record_rules()


@query("c2_event_columns", with_(**C2) + "SELECT event_type, key, k, rule, action, recipe FROM classified")
def _(spark, sf_dir):
    return classify.classify_event_columns(event_columns(spark, sf_dir)).select("event_type", "key", "k", "rule", "action", "recipe")


def _register_column_rules() -> None:
    def event_rule(rule):
        def run(spark, sf_dir):
            found = classify.classify_event_columns(event_columns(spark, sf_dir)).where(F.col("rule") == rule)
            return resolve.tally(found, "key", "action", "recipe")

        return run

    def technical_rule(rule):
        def run(spark, sf_dir):
            found = classify.classify_technical(classify.selectable(technical(spark, sf_dir)))
            return resolve.tally(found.where(F.col("rule") == rule), "object", "name", "type", "action", "recipe")

        return run

    for number in range(1, 8):
        rule = f"C2.{number}"
        sql = f"SELECT key, action, recipe, count(*) AS n FROM classified WHERE rule = '{rule}' GROUP BY ALL"
        query(f"c2_{number}_rule", with_(**C2) + sql)(event_rule(rule))
    for number in range(1, 10):
        rule = f"C3.{number}"
        sql = f"SELECT object, name, type, action, recipe, count(*) AS n FROM classified WHERE rule = '{rule}' GROUP BY ALL"
        query(f"c3_{number}_rule", with_(**C3) + sql)(technical_rule(rule))


_register_column_rules()


@query("c2_rule_counts", with_(**C2) + "SELECT rule, action, recipe, count(*) AS n FROM classified GROUP BY ALL")
def _(spark, sf_dir):
    return resolve.tally(classify.classify_event_columns(event_columns(spark, sf_dir)), "rule", "action", "recipe")


@query("c3_technical_fields", with_(**C3) + "SELECT org, object, name, rule, action, recipe FROM classified")
def _(spark, sf_dir):
    found = classify.classify_technical(classify.selectable(technical(spark, sf_dir)))
    return found.select("org", "object", "name", "rule", "action", "recipe")


@query("c3_rule_counts", with_(**C3) + "SELECT rule, action, recipe, count(*) AS n FROM classified GROUP BY ALL")
def _(spark, sf_dir):
    found = classify.classify_technical(classify.selectable(technical(spark, sf_dir)))
    return resolve.tally(found, "rule", "action", "recipe")


@query(
    "c4_schema_text",
    r"""SELECT page_id, CASE WHEN length(t) > 500 THEN substr(t, 1, 500) || '...' ELSE t END AS out FROM (
  SELECT page_id, trim(regexp_replace(regexp_replace(html, '[<>]', '', 'g'), '\s+', ' ', 'g')) AS t FROM $pages) x""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", schema_text(F.col("html")).alias("out"))


@query(
    "c5_skip_buckets",
    with_(l=b.LISTING)
    + """SELECT type, member, error, CASE WHEN contains(upper(error), 'INSUFFICIENT_ACCESS') THEN 'insufficient_access'
 WHEN contains(upper(error), 'INVALID_TYPE') OR contains(upper(error), 'CANNOT USE') THEN 'invalid_type' ELSE 'unknown' END AS bucket FROM l""",
)
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.LISTING).select("type", "member", "error", classify.skip_bucket(F.col("error")).alias("bucket"))


@query("c6_derive_recipe", with_(fields=b.FIELDS) + f"SELECT object, label, {_RECIPE.format(f='label')} AS recipe FROM fields")
def _(spark, sf_dir):
    return fields(spark, sf_dir).select("object", "label", derive_recipe(F.col("label")).alias("recipe"))


_WEIGHT = "CASE type " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in rules.TYPE_WEIGHTS.items()) + " ELSE 1 END"


@query("c7_type_weights", with_(c=b.COMPONENTS) + f"SELECT type, member, {_WEIGHT} AS weight FROM c")
def _(spark, sf_dir):
    return bind(spark, sf_dir, b.COMPONENTS).select("type", "member", classify.type_weight(F.col("type")).alias("weight"))


@query(
    "c8_schema_scan",
    with_(**C1)
    + "SELECT object, name AS field, type, length, custom, calculated, action AS recommended_action, special_category FROM classified",
)
def _(spark, sf_dir):
    return classify.schema_scan(fields(spark, sf_dir)).drop("reason")


# ---------------------------------------------------------------- P
@query(
    "p1_record_overrides",
    with_(**PLAN) + "SELECT object, field, k, chosen AS action, source FROM effective",
)
def _(spark, sf_dir):
    return resolved_records(spark, sf_dir).select("object", "field", "k", "action", "source")


@query(
    "p2_special_category",
    with_(**PLAN) + "SELECT object, field, k, chosen AS action, downgraded, coalesce(given, '') AS given FROM effective WHERE special_category",
)
def _(spark, sf_dir):
    _, reasons = record_plan(spark, sf_dir)
    rows = resolved_records(spark, sf_dir).where("special_category").join(reasons, ["object", "field"], "left")
    return rows.select("object", "field", "k", "action", "downgraded", F.coalesce("text", F.lit("")).alias("given"))


_E_OVERRIDES = "SELECT DISTINCT key, CASE length(key) % 5 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'HASH' WHEN 2 THEN 'DROP' ELSE 'RAW' END AS action FROM columns_ WHERE length(key) % 5 < 4"
_E_REASONS = "SELECT DISTINCT key, 'checked' AS text FROM columns_ WHERE length(key) % 2 = 0"
_E_PLAN = dict(
    C2,
    overrides=_E_OVERRIDES,
    reasons=_E_REASONS,
    resolved="""SELECT c.event_type, c.key, c.k, c.action AS default_action, c.recipe AS default_recipe, o.action AS ov,
 CASE WHEN o.action = 'KEEP' THEN 'PASS' ELSE o.action END AS asked, r.text AS given
 FROM classified c LEFT JOIN overrides o ON o.key = c.key LEFT JOIN reasons r ON r.key = c.key""",
    effective=T_EFFECTIVE,
    applied=T_APPLIED,
)


def _resolved_events(spark, sf_dir):
    base = with_(columns_=b.EVENT_COLUMNS)
    overrides, reasons = bind(spark, sf_dir, base + _E_OVERRIDES), bind(spark, sf_dir, base + _E_REASONS)
    columns = classify.classify_event_columns(event_columns(spark, sf_dir).drop("key"))
    keyed = columns.withColumn("key", resolve.event_key(F.col("column")))
    return resolve.resolve_exposure(keyed, overrides, reasons, ("key",))


@query("p3_event_overrides", with_(**_E_PLAN) + "SELECT event_type, key, k, action, recipe, source FROM applied")
def _(spark, sf_dir):
    return _resolved_events(spark, sf_dir).select("event_type", "key", "k", "action", "recipe", "source")


@query(
    "p4_exposure_ranking",
    with_(**_E_PLAN) + "SELECT key, action, downgraded, count(*) AS n FROM applied GROUP BY ALL",
)
def _(spark, sf_dir):
    return resolve.tally(_resolved_events(spark, sf_dir), "key", "action", "downgraded")


@query(
    "p5_technical_overrides",
    with_(**T_PLAN) + "SELECT org, object, field, action, recipe, source, downgraded FROM applied",
)
def _(spark, sf_dir):
    return resolved_technical(spark, sf_dir).select("org", "object", "field", "action", "recipe", "source", "downgraded")


@query(
    "p6_drift",
    with_(fields=b.FIELDS, known=b.KNOWN)
    + "SELECT f.object, f.name AS field, f.k FROM fields f WHERE NOT EXISTS (SELECT 1 FROM known n WHERE n.object = f.object AND n.field = f.name)",
)
def _(spark, sf_dir):
    rows = fields(spark, sf_dir).withColumnRenamed("name", "field")
    return resolve.drift(rows, known_fields(spark, sf_dir)).select("object", "field", "k")


@query(
    "p7_action_validation",
    with_(fields=b.FIELDS, overrides=b.OVERRIDES, bad="SELECT object, field, CASE WHEN length(field) % 3 = 0 THEN lower(action) ELSE action END AS action FROM overrides")
    + f"SELECT object, field, action FROM bad WHERE action NOT IN ({sql_list(rules.RECORD_ACTIONS)})",
)
def _(spark, sf_dir):
    overrides, _ = record_plan(spark, sf_dir)
    spoiled = overrides.withColumn("action", F.when(F.length("field") % 3 == 0, F.lower("action")).otherwise(F.col("action")))
    return resolve.invalid_actions(spoiled, rules.RECORD_ACTIONS)


@query(
    "p8_plan_rows",
    with_(**C3) + "SELECT object, name AS field, action || CASE WHEN recipe <> '' THEN '/' || recipe ELSE '' END AS recommended, count(*) AS n FROM classified GROUP BY ALL",
)
def _(spark, sf_dir):
    found = classify.classify_technical(classify.selectable(technical(spark, sf_dir))).withColumnRenamed("name", "field")
    return resolve.tally(resolve.plan_rows(found), "object", "field", "recommended")


@query(
    "p9_first_tag",
    with_(**C2, tagged="SELECT col_name, event_type, action || CASE WHEN recipe <> '' THEN '/' || recipe ELSE '' END AS tag FROM classified")
    + 'SELECT col_name AS "column", arg_min(tag, event_type) AS tag FROM tagged GROUP BY col_name',
)
def _(spark, sf_dir):
    return resolve.first_tag_per_column(classify.classify_event_columns(event_columns(spark, sf_dir)))


@query(
    "p10_preview_records",
    with_(**PLAN) + "SELECT object, action, count(*) AS fields FROM applied GROUP BY object, action",
)
def _(spark, sf_dir):
    return audit.action_counts(resolve.applied_action(resolved_records(spark, sf_dir)), "object")


@query(
    "p10_preview_technical",
    with_(**T_PLAN) + "SELECT org, object, action, count(*) AS fields FROM applied GROUP BY org, object, action",
)
def _(spark, sf_dir):
    return audit.action_counts(resolved_technical(spark, sf_dir), "org", "object")


@query(
    "p10_preview_events",
    with_(h=b.HEADERS, w="SELECT * FROM h WHERE Interval = 'Daily' AND log_ts >= TIMESTAMP '2024-01-05' AND log_ts < TIMESTAMP '2024-01-21'")
    + "SELECT EventType AS event_type, count(*) AS files FROM w GROUP BY EventType",
)
def _(spark, sf_dir):
    import datetime as dt

    headers = bind(spark, sf_dir, b.HEADERS).drop("LogDate").withColumnRenamed("log_ts", "LogDate")
    files, _ = event_plan.preview(headers, dt.date(2024, 1, 5), dt.date(2024, 1, 20))
    return files
