"""Event-log files as a stream, with the same masking expressions as batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hushframe.operators.mask import ClassifiedFrame


def file_stream(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int = 1000, **options: str
) -> DataFrame:
    """New files of a folder; the schema is given, never inferred."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.options(**options).load(path)


def drain(
    table: ClassifiedFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()
) -> StreamingQuery:
    """Mask all files that are new and stop.

    The checkpoint makes a repeated run a no-op, and the file sink's log makes
    each file count once even when tasks are retried.
    """
    writer = (
        table.frame.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.start()
    query.awaitTermination()
    return query


def closed_days(stream: DataFrame, ts: str, lateness: str, *keys: str) -> DataFrame:
    """Daily counts of days the watermark has closed; later rows are dropped."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return (
        timed.groupBy(F.window("_ts", "1 day").alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *keys, "n")
    )


def drain_append(frame: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows of an aggregation."""
    query = (
        frame.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
