"""Registry of the queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from string import Template

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use ``$table`` and binding names in ``with_``."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = Template(sql).safe_substitute({t: t for t in TABLES}).strip()
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Rows of a binding: the same SELECT both engines run on the given tables."""
    return spark.sql(Template(text).safe_substitute({t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def with_(**bindings: str) -> str:
    """``WITH a AS (...), b AS (...)`` for the checking SQL."""
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in bindings.items()) + "\n"


def sql_list(words) -> str:
    """A tuple of words as SQL string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
