"""The fixed list of technical objects, and the two fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushframe import rules

FIXED_SCHEMAS = {
    "limits": (("LimitName", "string"), ("Max", "int"), ("Remaining", "int")),
    "recordCount": (("ObjectName", "string"), ("RecordCount", "int")),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """Object, transport and position, in listing order (40 rows)."""
    rows = [(position, name, transport) for position, (name, transport) in enumerate(rules.CATALOGUE)]
    return spark.createDataFrame(rows, "position int, object string, transport string")


def transport_of(name: str) -> str:
    return dict(rules.CATALOGUE)[name]
