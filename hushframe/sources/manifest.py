"""Component manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.text import strip

_TYPES = "members array<string>, name string"
_PACKAGE = "types array<struct<members:array<string>,name:string>>, version string"


def _members(blocks: DataFrame) -> DataFrame:
    """Distinct (type, member) of ``<types>`` blocks, blanks left out."""
    return (
        blocks.where(F.coalesce("name", F.lit("")) != "")
        .select(F.col("name").alias("type"), F.explode("members").alias("m"))
        .select("type", strip(F.col("m")).alias("member"))
        .where(F.col("member") != "")
        .distinct()
    )


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Members of all manifest files below ``path``; large files are split."""
    return _members(spark.read.format("xml").option("rowTag", "types").schema(_TYPES).load(path))


def parse_manifests(texts: DataFrame, column: str = "body") -> DataFrame:
    """As :func:`read_manifests`, for manifests held in a column."""
    package = F.from_xml(F.col(column), _PACKAGE)
    return _members(
        texts.where(strip(F.col(column)) != "").select(F.explode_outer(package["types"]).alias("t")).select(
            "t.members", "t.name"
        )
    )
