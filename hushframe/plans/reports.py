"""Health-check and code-analysis documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.operators.audit import json_document
from hushframe.sinks.publish import publish
from hushframe.sources.payloads import require_score

HEALTH = "security_health_check"

#: A health check evaluates a fixed catalogue of settings (30 to 60).
_RISK = ("RiskType", "Setting", "SettingGroup", "OrgValue", "StandardValue")


def health_documents(scores: DataFrame, risks: DataFrame, key: str = "org") -> DataFrame:
    """One JSON document per organisation, envelopes left out."""
    per_org = risks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*_RISK))).alias("risks"), F.count(F.lit(1)).alias("n")
    )
    joined = scores.join(per_org, key, "left")
    return joined.select(
        key,
        json_document(
            SecurityHealthCheck=F.struct("Id", "Score"),
            Risks=F.coalesce("risks", F.array().cast("array<struct<RiskType:string,Setting:string,SettingGroup:string,OrgValue:string,StandardValue:string>>")),
            risk_count=F.coalesce("n", F.lit(0)),
        ).alias("document"),
    )


def export_health(spark: SparkSession, target: str, scores: DataFrame, risks: DataFrame, key: str = "org") -> str:
    """Publish the documents; an organisation without a score row stops the run before anything is written."""
    require_score(scores)
    return publish(spark, target, {HEALTH: health_documents(scores, risks, key)}, HEALTH)


def analysis_documents(reports: DataFrame, key: str = "org") -> DataFrame:
    """Summary document per report: counts, engine versions, output names."""
    stem = F.concat(F.lit("code_analyser_results_"), F.col(key))
    files = F.struct(*[F.concat(stem, F.lit(f".{kind}")).alias(kind) for kind in ("csv", "html", "json")])
    return reports.select(
        key,
        json_document(
            org_alias=F.col(key),
            violation_counts=F.col("violationCounts"),
            engine_versions=F.col("versions"),
            output_files=files,
        ).alias("document"),
    )
