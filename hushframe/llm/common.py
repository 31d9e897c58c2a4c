"""What the operators of this subpackage share: words, row keys, staged tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.session import staged_path

#: A word is a longest run of code points other than space and U+0009..U+000D.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

find_words = re.compile(WORD).findall


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The whole text, null as the empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(column: str | Column) -> Column:
    """The words of a text as an array; none for null or blank texts."""
    return F.array_remove(F.split(text_of(column), GAP), "")


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def row_key(text: str | Column) -> Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation,
    and two readers of the result do not compute it twice.
    """
    path = staged_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def thinned(df: DataFrame, share: float, *columns: str) -> DataFrame:
    """About ``share`` of the distinct values of ``columns``, by their hash.

    What tasks send to fit something on a sample then follows the sample, not the number of tasks.
    """
    if share >= 1:
        return df
    return df.filter(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int(share * (1 << 30)))


#: Bytes of the large column that a Python step handles at once.
SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``limit`` bytes, so that long texts do not add up in a worker."""
    for batch in batches:
        size = max(1, batch.column(column).nbytes)
        step = max(1, batch.num_rows * limit // size) if size > limit else max(1, batch.num_rows)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
