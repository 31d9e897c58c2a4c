"""Text of large files by block, staged so that every later step sees the same blocks.

Where Spark cuts a file depends on the other files of the scan and on the cores at hand,
so two scans of one file need not agree.  A block is therefore read once, and what comes
after it works on the staged rows: stretches of the block's lines, told apart by
(file, start, part) and in that order along a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in one row; a longer line is one row.
STRETCH = 1 << 20
#: Tasks per core that read blocks at most.
TASKS = 16


def lines_of(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(file, size, start, value): the lines of all files by block, in the order of each block."""
    return spark.read.option("lineSep", separator).text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
    )


def _bytes_of(spark: SparkSession, setting: str) -> int:
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))


def may_split(spark: SparkSession) -> Column:
    """Whether a file is large enough to be read in several blocks; a scan does not open files that fail this."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    return F.col("size") > min(_bytes_of(spark, n) for n in names)


def in_tasks(lines: DataFrame) -> DataFrame:
    """``lines`` in a bounded number of tasks, which is that of the staged files; blocks stay whole and in order."""
    return lines.coalesce(TASKS * lines.sparkSession.sparkContext.defaultParallelism)


def by_block(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The stretches of a batch that lie in one block, with the block (file, start)."""
    if not batch.num_rows:
        return
    file, start = batch.column("file"), batch.column("start")
    cuts: list[int] = []
    if file[0] != file[-1] or start[0] != start[-1]:
        codes, starts = np.asarray(file.dictionary_encode().indices), np.asarray(start)
        cuts = (np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist()
    for at, end in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield (file[at].as_py(), start[at].as_py()), batch.slice(at, end - at)


def stretches(values: pa.Array, separator: str) -> pa.Array:
    """Lines joined to texts of about STRETCH bytes."""
    ends = np.cumsum(np.asarray(pc.binary_length(values)).astype(np.int64) + len(separator))
    group = (ends - 1) // STRETCH
    edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(ends)]]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), values), separator)
