"""Delimited text outputs of classified tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.operators.gates import GateError
from hushframe.operators.mask import ClassifiedFrame, as_cells

_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "lineSep": "\n",
}


def check_header(table: ClassifiedFrame, extra: tuple[str, ...] = ()) -> None:
    """Refuse columns that were not audited, or audited as dropped."""
    kept = {a.name for a in table.actions if a.kept} | set(extra)
    wrong = [c for c in table.frame.columns if c not in kept]
    if wrong:
        raise GateError(f"{table.name}: columns {wrong} must not be written")


def _write(frame: DataFrame, path: str, mode: str, partition_by: tuple[str, ...] = (), **options) -> None:
    writer = frame.write.mode(mode).options(**{**_CSV, **options})
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_tsv(table: ClassifiedFrame, path: str, key: str = "Id") -> None:
    """Tab-separated, header first, quotes only where needed; parts stay split."""
    check_header(table, (key,))
    _write(as_cells(table.frame), path, "overwrite", sep="\t")


def write_csv(table: ClassifiedFrame, path: str, key: str = "Id") -> None:
    check_header(table, (key,))
    _write(as_cells(table.frame), path, "overwrite")


def append_slices(table: ClassifiedFrame, path: str, partitions: tuple[str, ...] = ("log_date",)) -> None:
    """Add dated slices; a rerun of a day replaces that day only.

    Rows are rebalanced by slice: small slices become one file, and adaptive
    execution splits a slice that holds most of the rows.
    """
    check_header(table, partitions)
    table.frame.hint("rebalance", *partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_dated_csv(table: ClassifiedFrame, path: str, day: str = "log_date") -> None:
    """One folder per day; a day that holds most of the rows is split by adaptive execution."""
    check_header(table, (day,))
    names = [F.col(f"`{c}`") for c in table.frame.columns if c != day]
    dated = as_cells(table.frame).select(*names, day).hint("rebalance", day)
    _write(dated, path, "overwrite", (day,))


def read_dated_csv(spark: SparkSession, path: str, table: ClassifiedFrame | None = None, day: str = "log_date") -> DataFrame:
    """What :func:`write_dated_csv` wrote, all cells as text."""
    reader = spark.read.options(**{k: _CSV[k] for k in ("header", "quote", "escape", "nullValue")}, multiLine=True)
    if table is not None:
        names = [c for c in table.frame.columns if c != day]
        reader = reader.schema(T.StructType([T.StructField(n, T.StringType()) for n in [*names, day]]))
    return reader.csv(path)


def write_report(frame: DataFrame, path: str) -> None:
    """An audit, a skip report or a summary as CSV."""
    _write(frame, path, "overwrite")
