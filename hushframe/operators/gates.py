"""Checks a table has to pass before it is published."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import rules


class GateError(RuntimeError):
    """Publication is refused."""


def _worth_searching(text: Column, category: str) -> Column:
    """Cheap necessary condition for a hit, so most texts skip the pattern."""
    hint = rules.LEAK_HINTS.get(category)
    return F.contains(text, F.lit(hint)) if hint else text.isNotNull()


def find_all(text: Column, category: str, pattern: str) -> Column:
    """Array of (category, hit) in one text."""
    hits = F.when(
        _worth_searching(text, category), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))
    return F.transform(hits, lambda hit: F.struct(F.lit(category).alias("category"), hit.alias("hit")))


def matches(text: Column, category: str, pattern: str) -> Column:
    return _worth_searching(text, category) & text.rlike(pattern)


def findings(texts: DataFrame, key: str, column: str, detectors: dict[str, str] | None = None) -> DataFrame:
    """All detector hits in whole texts, one pass, as (key, category, detail).

    The detail is the SHA-256 of the hit: equal hits can be counted and looked
    up, but the log does not repeat what must not leak.
    """
    detectors = detectors or rules.LEAK_PATTERNS
    text = F.col(column)
    hits = F.concat(*[find_all(text, name, pattern) for name, pattern in detectors.items()])
    return texts.select(key, F.explode(hits).alias("f")).select(
        key, F.col("f.category").alias("category"), F.sha2(F.col("f.hit"), 256).alias("detail")
    )


@dataclass(frozen=True)
class Stage:
    """A named check: table in, findings out."""

    name: str
    run: Callable[[DataFrame], DataFrame]


def noop_stage() -> Stage:
    return Stage("noop", lambda frame: frame.limit(0).select(
        F.lit("").alias("path"), F.lit("").alias("category"), F.lit("").alias("detail")
    ))


def detector_stage(key: str, column: str, detectors: dict[str, str] | None = None) -> Stage:
    return Stage(
        "detectors",
        lambda frame: findings(frame, key, column, detectors).withColumnRenamed(key, "path"),
    )


def run_stages(frame: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Findings of all stages in order, with the stage's name."""
    results = [
        stage.run(frame).select(
            F.lit(number).alias("stage_no"), F.lit(stage.name).alias("stage"),
            F.col("path").cast("string").alias("path"), "category", "detail",
        )
        for number, stage in enumerate(stages)
    ]
    out = results[0]
    for result in results[1:]:
        out = out.unionByName(result)
    return out


def require_empty(frame: DataFrame, what: str) -> None:
    """Stop when a violation table has a row; at most five reach the driver."""
    rows = frame.limit(5).collect()
    if rows:
        raise GateError(f"{what}: {[row.asDict() for row in rows]}")


# ---------------------------------------------------------------- leak counts
def has_raw_ip(value: Column) -> Column:
    """A dotted quad whose last octet is not zero."""
    return value.rlike(rules.LEAK_PATTERNS["ip"])


def has_clear_email(value: Column) -> Column:
    # A hash has no @, so 64 hex digits never count.
    return matches(value, "email", rules.LEAK_PATTERNS["email"])


def is_hash_shaped(value: Column) -> Column:
    return value.rlike(rules.HASH_SHAPE)


def has_query_string(value: Column) -> Column:
    return F.contains(value, F.lit("?"))


def count_per_column(frame: DataFrame, columns: Sequence[str], test: Callable[[Column], Column], name: str) -> DataFrame:
    """(column, name) with the rows that meet ``test``, in one pass."""
    counts = frame.agg(*[F.count_if(test(F.col(f"`{c}`").cast("string"))).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", name)


def _value_tests(action: str, recipe: str, source: str) -> dict[str, Callable[[Column], Column]]:
    """What a masked text column must not hold, by what was done to it.

    A value that an operator's override exposes is theirs to answer for.
    """
    if action.startswith(rules.HASH):
        return {"hash shape": lambda c: ~is_hash_shaped(c)}
    if recipe == "ip_prefix":
        return {"raw address": has_raw_ip}
    if recipe == "url_sanitise":
        return {"raw address": has_raw_ip, "query string": has_query_string, "clear e-mail": has_clear_email}
    if source == "override":
        return {}
    return {"clear e-mail": has_clear_email}


def check_values(name: str, frame: DataFrame, actions: Sequence) -> None:
    """Refuse a written table with a value that its actions should have removed; one pass, no value is told.

    ``actions`` have name, action, recipe, source and kept.
    """
    text = set(text_columns(frame))
    tests = [
        (a.name, what, test)
        for a in actions
        if a.kept and a.name in text
        for what, test in _value_tests(a.action, a.recipe, a.source).items()
    ]
    if not tests:
        return
    found = frame.agg(*[F.count_if(test(F.col(f"`{column}`"))).alias(f"c{k}") for k, (column, _, test) in enumerate(tests)]).first()
    wrong = [f"{column}: {what} in {found[k]} rows" for k, (column, what, _) in enumerate(tests) if found[k]]
    if wrong:
        raise GateError(f"{name}: {'; '.join(wrong)}")


def text_columns(frame: DataFrame) -> list[str]:
    return [name for name, kind in frame.dtypes if kind == "string"]


def profile(frame: DataFrame, columns: Sequence[str], detectors: dict[str, str] | None = None) -> DataFrame:
    """Share of rows each detector hits, per column: finds what names hide."""
    detectors = detectors or rules.LEAK_PATTERNS
    counts = frame.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.count_if(matches(F.col(f"`{c}`"), name, pattern)).alias(f"{c}|{name}")
            for c in columns
            for name, pattern in detectors.items()
        ],
    )
    cells = counts.unpivot(["rows"], [f"{c}|{name}" for c in columns for name in detectors], "cell", "hits")
    parts = F.split("cell", r"\|")
    return cells.select(
        parts[0].alias("column"),
        parts[1].alias("detector"),
        "rows",
        "hits",
        F.round(F.col("hits") / F.col("rows"), 6).alias("share"),
    )


# ---------------------------------------------------------------- consistency
def header_violations(published: DataFrame, audit: DataFrame, keys: tuple[str, ...] = ("object", "field")) -> DataFrame:
    """Published columns that were never audited or should have been dropped."""
    on = list(keys)
    state = audit.groupBy(*on).agg(F.min("action").alias("action"), F.max("action").alias("_last"))
    joined = published.select(*on).distinct().join(state, on, "left")
    return joined.where(F.col("action").isNull() | (F.col("action") == "DROP")).select(
        *on, F.when(F.col("action").isNull(), "not audited").otherwise("dropped column published").alias("problem")
    )


def uneven_counts(audit: DataFrame, fields: DataFrame, key: str = "object") -> DataFrame:
    """Objects whose action counts do not add up to their fields."""
    audited = audit.groupBy(key).agg(F.count(F.lit(1)).alias("audited"))
    expected = fields.groupBy(key).agg(F.count(F.lit(1)).alias("expected"))
    joined = expected.join(audited, key, "full")
    return joined.where(~F.col("audited").eqNullSafe(F.col("expected")))


def fingerprint(frame: DataFrame) -> DataFrame:
    """Order-free digest of a table: rows, and two folds of the row hashes."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns])
    return frame.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(row.cast("decimal(38,0)")).alias("sum"),
        F.bit_xor(row).alias("xor"),
    )


def same_digest(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows of the left table, and whether both digests agree."""
    digest = F.struct("rows", "sum", "xor")
    both = fingerprint(left).union(fingerprint(right))
    return both.agg(F.max("rows").alias("rows"), (F.min(digest) == F.max(digest)).alias("same_digest"))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, repeats counted."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )
