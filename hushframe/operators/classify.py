"""Column classifiers: schema rows in, action rows out, first rule wins.

Each classifier is one ``CASE`` over native predicates, so a job over the schema
rows of thousands of organisations needs no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions.text import let, strip, words


def first_hit(text: Column, patterns: Sequence[str]) -> Column:
    """First pattern (in list order) contained in ``text``, else NULL."""
    return F.get(F.filter(words(patterns), lambda word: F.contains(text, word)), F.lit(0))


def one_of(text: Column, names: Sequence[str]) -> Column:
    """Membership in a fixed list, as one folded literal."""
    return F.array_contains(words(names), text)


def any_word(text: Column, parts: Iterable[str]) -> Column:
    return text.rlike("|".join(map(re.escape, parts)))


def any_suffix(text: Column, suffixes: Iterable[str]) -> Column:
    return text.rlike("(?:" + "|".join(map(re.escape, suffixes)) + r")\z")


def first_match(cases: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """``CASE WHEN`` chain over (predicate, outcome) pairs."""
    (predicate, outcome), *rest = cases
    chain = F.when(predicate, outcome)
    for predicate, outcome in rest:
        chain = chain.when(predicate, outcome)
    return chain.otherwise(default)


# ---------------------------------------------------------------- business records
def _recommend(rule: str, action: str, reason: Column | str, special: bool = False) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"),
        F.lit(action).alias("action"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        F.lit(special).alias("special_category"),
    )


def classify_records(fields: DataFrame) -> DataFrame:
    """Recommendation per business field.

    ``fields`` has name, label, type, length, calculated, formula, help_text;
    rule, action, reason and special_category are added.
    """
    blank = F.lit("")
    text = F.lower(F.concat_ws("\n", F.col("name"), F.coalesce("label", blank), F.coalesce("help_text", blank)))
    found = let(text, lambda t: let(_evidence(t), _records_outcome))
    return fields.withColumn("_found", found).select(*[F.col(c) for c in fields.columns], "_found.*")


def _evidence(text: Column) -> Column:
    """What the rules look for, searched once per field."""
    return F.struct(
        first_hit(text, rules.SPECIAL_CATEGORY).alias("special"),
        first_hit(text, rules.DIRECT_PII).alias("direct"),
        first_hit(text, rules.ESSAY_NAMES).alias("essay"),
        first_hit(text, rules.IDENTIFIERS).alias("identifier"),
        F.when(F.col("calculated"), _formula_source(F.col("formula"))).alias("source"),
        F.contains(text, F.lit("email")).alias("email"),
    )


def _records_outcome(seen: Column) -> Column:
    kind = F.lower(F.coalesce("type", F.lit("")))
    length = F.coalesce("length", F.lit(0))

    def matched(label: str, hit: str) -> Column:
        return F.concat(F.lit(f"{label}: "), seen[hit])

    cases = [
        (one_of(kind, ("id", "reference")), _recommend("C1.1", rules.RAW, F.concat(kind, F.lit(" key, opaque outside the system")))),
        (one_of(F.lower("name"), rules.PARTNER_ID_NAMES), _recommend("C1.2", rules.RAW, "opaque partner id")),
        (seen["special"].isNotNull(), _recommend("C1.3", rules.DROP, matched("special category", "special"), True)),
        (F.col("name") == "Name", _recommend("C1.4", rules.DROP, "plain name of a person or company")),
        (seen["direct"].isNotNull(), _recommend("C1.5", rules.DROP, matched("personal data", "direct"))),
        (
            (kind == "textarea") & (length >= rules.ESSAY_TEXTAREA_LEN),
            _recommend("C1.6", rules.DROP, F.concat(F.lit("long text: "), length.cast("string"))),
        ),
        (
            seen["essay"].isNotNull() & (length >= rules.ESSAY_NAMED_LEN),
            _recommend("C1.7", rules.DROP, matched("essay", "essay")),
        ),
        (seen["source"].isNotNull(), _recommend("C1.8", rules.DROP, matched("formula reads", "source"))),
        (
            kind == "email",
            _recommend(
                "C1.9",
                rules.HASH_EMAIL,
                F.when(seen["email"], "email type").otherwise("email type, name lacks the word"),
            ),
        ),
        (seen["email"] & one_of(kind, rules.TEXT_TYPES), _recommend("C1.10", rules.HASH_EMAIL, "text that mentions email")),
        (seen["identifier"].isNotNull(), _recommend("C1.11", rules.HASH_ID, matched("identifier", "identifier"))),
    ]
    return first_match(cases, _recommend("C1.12", rules.PASS, "no identifying signal"))


def _formula_source(formula: Column) -> Column:
    """First personal field a formula mentions, in any case."""
    return let(
        F.lower(F.coalesce(formula, F.lit(""))),
        lambda text: F.get(F.filter(words(rules.FORMULA_SOURCES), lambda s: F.contains(text, F.lower(s))), F.lit(0)),
    )


# ---------------------------------------------------------------- event logs
def _decide(rule: str, action: str, recipe: str = "") -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"), F.lit(recipe).alias("recipe"))


def event_column_outcome(name: Column) -> Column:
    """Struct(rule, action, recipe) for an event-log column name."""
    upper = F.upper(strip(F.coalesce(name, F.lit(""))))
    cases = [
        (one_of(upper, rules.EVENT_IP) | upper.endswith("_IP"), _decide("C2.1", rules.DERIVE, "ip_prefix")),
        (
            one_of(upper, rules.EVENT_URL) | any_suffix(upper, ("URI", "URL")),
            _decide("C2.2", rules.DERIVE, "url_sanitise"),
        ),
        (one_of(upper, rules.EVENT_PERSON), _decide("C2.3", rules.HASH, "id")),
        (one_of(upper, rules.EVENT_CONTENT), _decide("C2.4", rules.DROP)),
        (one_of(upper, rules.EVENT_KEYS) | any_suffix(upper, rules.EVENT_KEY_SUFFIXES), _decide("C2.5", rules.RAW)),
        (
            any_suffix(upper, rules.EVENT_CONTENT_SUFFIXES) | any_word(upper, rules.EVENT_SECRET_WORDS),
            _decide("C2.6", rules.DROP),
        ),
    ]
    return first_match(cases, _decide("C2.7", rules.PASS))


def classify_event_columns(columns: DataFrame, name: str = "column") -> DataFrame:
    return columns.withColumn("_found", event_column_outcome(F.col(name))).select(
        *[F.col(c) for c in columns.columns], "_found.*"
    )


# ---------------------------------------------------------------- technical objects
def technical_outcome(object_name: Column, name: Column, data_type: Column) -> Column:
    """Struct(rule, action, recipe) for one technical-object field."""
    kind = F.lower(F.coalesce(data_type, F.lit("")))
    lower = F.lower(F.coalesce(name, F.lit("")))
    key = F.concat_ws(".", object_name, name)
    by_outcome: dict[tuple[str, str], list[str]] = {}
    for obj, field, action, recipe in rules.CURATED:
        by_outcome.setdefault((action, recipe), []).append(f"{obj}.{field}")
    cases = [(one_of(key, keys), _decide("C3.1", *outcome)) for outcome, keys in by_outcome.items()]
    cases += [
        (one_of(kind, ("id", "reference")) | any_suffix(lower, ("id", "ids")), _decide("C3.2", rules.RAW)),
        (
            lower.endswith("ip") | one_of(lower, rules.TECHNICAL_IP_NAMES),
            _decide("C3.3", rules.DERIVE, "ip_prefix"),
        ),
        (
            (kind == "email") | (one_of(kind, rules.TECHNICAL_TEXT_TYPES) & F.contains(lower, F.lit("email"))),
            _decide("C3.4", rules.HASH, "email"),
        ),
        ((kind == "phone") | any_word(lower, ("phone", "mobile")), _decide("C3.5", rules.DROP)),
        ((kind == "url") | any_suffix(lower, ("url", "uri")), _decide("C3.6", rules.DERIVE, "url_sanitise")),
        (any_word(lower, rules.FINE_GEO), _decide("C3.7", rules.DROP)),
        (any_word(lower, rules.COARSE_GEO), _decide("C3.7", rules.PASS)),
        (any_word(lower, rules.FREE_TEXT) | one_of(lower, rules.LABEL_NAMES), _decide("C3.8", rules.DROP)),
    ]
    return first_match(cases, _decide("C3.9", rules.PASS))


def classify_technical(fields: DataFrame) -> DataFrame:
    """Action and recipe per technical field (object, name, type)."""
    outcome = technical_outcome(F.col("object"), F.col("name"), F.col("type"))
    return fields.withColumn("_found", outcome).select(*[F.col(c) for c in fields.columns], "_found.*")


def selectable(fields: DataFrame) -> DataFrame:
    """Technical fields that may be read at all: queryable and not a blob."""
    return fields.where(
        F.coalesce("queryable", F.lit(True))
        & ~F.lower(F.coalesce("type", F.lit(""))).isin(*rules.BLOB_TYPES)
        & ~F.coalesce("name", F.lit("")).isin(*rules.BLOB_NAMES)
    )


# ---------------------------------------------------------------- smaller lookups
def skip_bucket(message: Column) -> Column:
    """Bucket of an error text."""
    upper = F.upper(F.coalesce(message, F.lit("")))
    return (
        F.when(F.contains(upper, F.lit("INSUFFICIENT_ACCESS")), "insufficient_access")
        .when(any_word(upper, ("INVALID_TYPE", "CANNOT USE")), "invalid_type")
        .otherwise("unknown")
    )


def type_weight(component_type: Column) -> Column:
    """Weight of one component of a type; a 14-entry map folded into the plan."""
    by_weight: dict[int, list[str]] = {}
    for name, weight in rules.TYPE_WEIGHTS.items():
        by_weight.setdefault(weight, []).append(name)
    cases = [(one_of(component_type, names), F.lit(weight)) for weight, names in by_weight.items()]
    return first_match(cases, F.lit(rules.DEFAULT_WEIGHT))


def schema_scan(fields: DataFrame) -> DataFrame:
    """Report rows of a records classification, one per object and field."""
    return classify_records(fields).select(
        "object",
        F.col("name").alias("field"),
        "type",
        "length",
        "custom",
        "calculated",
        F.col("action").alias("recommended_action"),
        "special_category",
        "reason",
    )
