"""Tables behind the code-analysis and health-check reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe import rules


def severity_counts(violations: DataFrame, *keys: str) -> DataFrame:
    """Violations in total and per severity 1 to 5."""
    return violations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == level).alias(f"sev{level}") for level in range(1, 6)],
    )


def by_dimension(violations: DataFrame, *dimensions: str) -> DataFrame:
    """Counts per value of each dimension, as (dimension, value, n)."""
    cells = violations.select(*[F.col(d).cast("string").alias(d) for d in dimensions]).unpivot(
        [], list(dimensions), "dimension", "value"
    )
    return cells.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def by_tag(violations: DataFrame) -> DataFrame:
    return violations.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def risk_matrix(risks: DataFrame) -> DataFrame:
    """Setting groups by risk type, fixed columns."""
    return risks.groupBy("SettingGroup").pivot("RiskType", list(rules.RISK_TYPES)).agg(F.count(F.lit(1)))


def risk_cube(risks: DataFrame) -> DataFrame:
    return risks.cube("SettingGroup", "RiskType").agg(F.count(F.lit(1)).alias("n"))
