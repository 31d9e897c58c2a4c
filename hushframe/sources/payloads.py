"""Tables out of landed JSON payloads.

A landing zone is a table of response bodies (one row per response); each
reader parses the ``body`` column with an explicit schema, so nothing is
inferred and a broken payload yields NULL instead of ending the job.

Arrays are exploded with the outer form and empty rows filtered afterwards: the
inner form makes the optimizer copy the parse into a filter and run it twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.functions.text import let, schema_text, strip
from hushframe.operators.classify import selectable

_FIELD = (
    "struct<name:string,label:string,type:string,length:string,custom:boolean,calculated:boolean,"
    "calculatedFormula:string,inlineHelpText:string,queryable:boolean>"
)
_DESCRIBE = f"struct<result:struct<fields:array<{_FIELD}>>,fields:array<{_FIELD}>>"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Bodies of a landing folder: one file is one response."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("body")
    )


def _described(bodies: DataFrame) -> DataFrame:
    parsed = F.from_json("body", _DESCRIBE)
    keys = [c for c in bodies.columns if c != "body"]
    return bodies.withColumn("_p", parsed).select(
        *keys, F.posexplode_outer(F.coalesce("_p.result.fields", "_p.fields")).alias("position", "f")
    ).where(F.col("f").isNotNull())


def read_describe(bodies: DataFrame) -> DataFrame:
    """Business field rows of describe payloads; nameless fields are left out."""
    keys = [c for c in bodies.columns if c != "body"]
    text = F.lit("")
    return (
        _described(bodies)
        .select(
            *keys,
            "position",
            F.coalesce("f.name", text).alias("name"),
            schema_text(F.col("f.label")).alias("label"),
            F.lower(F.coalesce("f.type", text)).alias("type"),
            F.coalesce(F.col("f.length").try_cast("int"), F.lit(0)).alias("length"),
            F.coalesce("f.custom", F.lit(False)).alias("custom"),
            F.coalesce("f.calculated", F.lit(False)).alias("calculated"),
            schema_text(F.col("f.calculatedFormula")).alias("formula"),
            schema_text(F.col("f.inlineHelpText")).alias("help_text"),
        )
        .where(F.col("name") != "")
    )


def read_technical_describe(bodies: DataFrame) -> DataFrame:
    """Technical field rows that may be selected."""
    keys = [c for c in bodies.columns if c != "body"]
    return selectable(
        _described(bodies).select(
            *keys,
            "position",
            F.col("f.name").alias("name"),
            F.coalesce("f.type", F.lit("")).alias("type"),
            F.coalesce("f.label", F.lit("")).alias("label"),
            F.coalesce("f.queryable", F.lit(True)).alias("queryable"),
        )
    ).drop("queryable")


def objects_without_fields(bodies: DataFrame, key: str = "object") -> DataFrame:
    """Skip rows of objects that have no selectable field left."""
    return (
        bodies.select(key)
        .join(read_technical_describe(bodies).select(key).distinct(), key, "left_anti")
        .withColumn("reason", F.lit("no safe queryable fields"))
    )


def _records(record_schema: str) -> str:
    records = f"array<struct<{record_schema}>>"
    return f"result struct<records:{records}>, records {records}"


def parse_records(bodies: DataFrame, record_schema: str) -> DataFrame:
    """Pages with their records; columns outside the schema, such as the
    envelope, are not read."""
    keys = [c for c in bodies.columns if c != "body"]
    return bodies.withColumn("_p", F.from_json("body", _records(record_schema))).select(
        *keys, F.coalesce("_p.result.records", "_p.records").alias("records")
    )


def is_last_page(body: Column) -> Column:
    """No further page: done, or nothing to follow.  Records are skipped over."""
    return let(
        F.from_json(body, "done boolean, nextRecordsUrl string"),
        lambda page: F.coalesce(page["done"], F.lit(True)) | page["nextRecordsUrl"].isNull(),
    )


def read_records(bodies: DataFrame, record_schema: str) -> DataFrame:
    """Record rows of result payloads."""
    keys = [c for c in bodies.columns if c != "body"]
    return parse_records(bodies, record_schema).select(
        *keys, F.explode_outer("records").alias("r")
    ).where(F.col("r").isNotNull()).select(*keys, "r.*")


def read_paged(bodies: DataFrame, record_schema: str, chain: str, page: str) -> DataFrame:
    """Records of page chains up to each chain's last page.

    Only page numbers are aggregated and joined; records are exploded after.
    """
    stop = bodies.where(is_last_page(F.col("body"))).groupBy(chain).agg(F.min(page).alias("_stop"))
    used = parse_records(
        bodies.join(stop, chain, "left").where(F.col("_stop").isNull() | (F.col(page) <= F.col("_stop"))), record_schema
    )
    return (
        used.select(chain, page, F.explode_outer("records").alias("r"))
        .where(F.col("r").isNotNull())
        .select(chain, page, "r.*")
    )


def read_limits(bodies: DataFrame) -> DataFrame:
    """(LimitName, Max, Remaining) of limit payloads; values that are not
    objects are ignored."""
    keys = [c for c in bodies.columns if c != "body"]
    entries = bodies.select(*keys, F.explode_outer(F.from_json("body", "map<string,string>")).alias("LimitName", "v"))
    value = F.from_json("v", "Max bigint, Remaining bigint")
    return (
        entries.where(strip(F.col("v")).startswith("{"))
        .withColumn("o", value)
        .select(*keys, "LimitName", F.col("o.Max").alias("Max"), F.col("o.Remaining").alias("Remaining"))
    )


def read_record_counts(bodies: DataFrame) -> DataFrame:
    """(ObjectName, RecordCount) of record-count payloads."""
    keys = [c for c in bodies.columns if c != "body"]
    parsed = F.from_json("body", "sObjects array<struct<name:string,count:bigint>>")
    return bodies.select(*keys, F.explode_outer(parsed["sObjects"]).alias("o")).where(F.col("o").isNotNull()).select(
        *keys, F.col("o.name").alias("ObjectName"), F.col("o.count").alias("RecordCount")
    )


_RISK = "RiskType:string,Setting:string,SettingGroup:string,OrgValue:string,StandardValue:string"


def read_health_scores(bodies: DataFrame) -> DataFrame:
    """Score row per organisation; NULL where the feature is not available."""
    keys = [c for c in bodies.columns if c != "body"]
    first = F.get(F.col("records"), F.lit(0))
    return parse_records(bodies, "Id:string,Score:string").select(  # the score arrives quoted
        *keys, first["Id"].alias("Id"), first["Score"].try_cast("int").alias("Score")
    )


def read_health_risks(bodies: DataFrame, chain: str = "org", page: str = "page") -> DataFrame:
    return read_paged(bodies, _RISK, chain, page)


def require_score(scores: DataFrame) -> None:
    """At least one organisation, each with a score."""
    found = scores.agg(F.count(F.lit(1)).alias("rows"), F.count("Score").alias("scored")).first()
    if found["rows"] == 0 or found["scored"] < found["rows"]:
        raise RuntimeError("health check returned no score row")


_REPORT_HEAD = (
    "runDir string, violationCounts struct<total:bigint,sev1:bigint,sev2:bigint,sev3:bigint,sev4:bigint,sev5:bigint>, "
    "versions map<string,string>"
)
_FINDING = (
    "struct<rule:string,engine:string,severity:int,tags:array<string>,"
    "primaryLocationIndex:int,locations:array<struct<file:string,startLine:int>>,message:string>"
)


def read_reports(bodies: DataFrame) -> DataFrame:
    """Counts and engine versions of analysis reports, NULL when unreadable.

    Findings are not in the schema, so the parser skips over them.  A body that is an
    expression is used twice here, so the optimizer does not copy it into the parser,
    whose arguments are not compiled.
    """
    keys = [c for c in bodies.columns if c != "body"]
    parsed = F.when(F.col("body").isNotNull(), F.from_json("body", _REPORT_HEAD))
    return bodies.withColumn("_p", parsed).select(*keys, "_p.*")


def primary_location() -> Column:
    """The location a finding points at, NULL when the index is out of range."""
    return F.get(F.col("v.locations"), F.coalesce("v.primaryLocationIndex", F.lit(0)))


def violation_of(text: Column) -> Column:
    """One finding of a report from its JSON text."""
    return F.from_json(text, _FINDING)


def read_violations(bodies: DataFrame) -> DataFrame:
    """One row per finding with its primary location."""
    keys = [c for c in bodies.columns if c != "body"]
    parsed = F.from_json("body", f"violations array<{_FINDING}>")["violations"]
    return violation_columns(bodies.select(*keys, F.explode_outer(parsed).alias("v")).where(F.col("v").isNotNull()), keys)


def violation_columns(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The shown columns of findings ``v``."""
    return findings.withColumn("at", primary_location()).select(
        *keys,
        "v.rule",
        "v.engine",
        "v.severity",
        "v.tags",
        F.col("at.file").alias("file"),
        F.col("at.startLine").alias("line"),
        "v.message",
    )
