"""Secrets in texts and in the names of files.

Keys of published shapes are found by their pattern.  What is assigned to a name like
``api_key`` counts if it has a digit and more bits per character than words have, and a
long run of key characters counts by its bits alone, so hexadecimal digests, which
masking leaves behind, are not reported.  All of it is column expressions; texts without
the fixed part of a shape are not searched for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators.gates import Stage

_NO_HITS = "array<string>"


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    size = F.length(value)

    def add(total: Column, char: Column) -> Column:
        share = (size - F.length(F.replace(value, char, F.lit("")))) / size
        return total - share * F.log2(share)

    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda t, c: F.when(c == "", t).otherwise(add(t, c)))


def _shaped(text: Column, hint: str, pattern: str) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(F.array().cast(_NO_HITS))


def assigned_values(text: Column) -> Column:
    """Values of names that promise a secret, unless they read like words."""
    values = F.regexp_extract_all(text, F.lit(rules.SECRET_ASSIGNMENT), F.lit(1))
    return F.filter(values, lambda v: v.rlike("[0-9]") & (entropy(v) >= rules.SECRET_VALUE_BITS))


def dense_runs(text: Column) -> Column:
    """Long runs of key characters with a digit, both cases and many bits per character."""
    runs = F.regexp_extract_all(text, F.lit(rules.SECRET_RUN), F.lit(0))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    return F.filter(runs, lambda v: mixed(v) & (entropy(v) >= rules.SECRET_RUN_BITS))


def _told(hits: Column, category: str) -> Column:
    return F.transform(hits, lambda hit: F.struct(F.lit(category).alias("category"), hit.alias("hit")))


def secrets_in(text: Column) -> Column:
    """Array of (category, hit) of one text; a value may be told by several categories."""
    found = {name: _shaped(text, *shape) for name, shape in rules.SECRET_SHAPES.items()}
    found |= {"assigned secret": assigned_values(text), "dense run": dense_runs(text)}
    return F.concat(*[_told(hits, name) for name, hits in found.items()])


def secret_findings(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, category, detail) of every secret; the detail is the SHA-256 of the hit."""
    return texts.select(F.col(key), F.explode(secrets_in(F.col(column))).alias("f")).select(
        key, F.col("f.category").alias("category"), F.sha2(F.col("f.hit"), 256).alias("detail")
    )


def name_findings(paths: DataFrame, path: str) -> DataFrame:
    """(path, category, detail) of components of a path that are shaped like a secret.

    An extension of up to five letters or digits is no part of a name.
    """
    names = F.transform(F.split(F.col(path), "/"), lambda c: F.regexp_replace(c, r"\.[0-9A-Za-z]{1,5}$", ""))
    return secret_findings(paths.select(F.col(path).alias("path"), F.explode(names).alias("_name")), "path", "_name")


def secret_stage(key: str, column: str) -> Stage:
    return Stage("secrets", lambda frame: secret_findings(frame, key, column).withColumnRenamed(key, "path"))


def name_stage(path: str) -> Stage:
    return Stage("names", lambda frame: name_findings(frame, path))
