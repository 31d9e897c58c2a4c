"""Event-log headers and bodies."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushframe.functions.text import strip
from hushframe.session import staged
from hushframe.sources.blocks import by_block, in_tasks, lines_of, may_split, stretches

#: Bytes of file names and headers of all stretches that travel to every task at most.
BLOCK_LIST_BYTES = 32 << 20


def field_names(raw: Column) -> Column:
    """Names of a comma list, trimmed, blanks left out."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), strip), lambda name: name != "")


def columns_by_type(headers: DataFrame, order: str = "Id") -> DataFrame:
    """(event_type, position, column): the first header of a type wins."""
    first = headers.groupBy(F.coalesce("EventType", F.lit("Unknown")).alias("event_type")).agg(
        F.min_by("LogFileFieldNames", order).alias("names")
    )
    return first.select("event_type", F.posexplode(field_names(F.col("names"))).alias("position", "column"))


def headers_per_type(headers: DataFrame) -> DataFrame:
    return headers.groupBy(F.coalesce("EventType", F.lit("Unknown")).alias("event_type")).agg(
        F.count(F.lit(1)).alias("files")
    )


def file_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, size, start, value): the lines of all files by block, in the order of each block."""
    return lines_of(spark, paths, "\n")


def _stripped(header: Column) -> Column:
    return F.regexp_replace(F.rtrim(header, F.lit("\r")), "^\ufeff", "")


def first_lines(lines: DataFrame) -> DataFrame:
    """(file, line)."""
    numbered = lines.where("start = 0").withColumn("row", F.monotonically_increasing_id())
    return numbered.groupBy("file").agg(F.min_by("value", "row").alias("line"))


def distinct_headers(first: DataFrame) -> list[str]:
    """The first lines of the files, each once, in the order of the files."""
    found = first.groupBy(_stripped(F.col("line")).alias("header")).agg(F.min("file").alias("file")).orderBy("file")
    return [row["header"] for row in found.collect()]


def file_blocks(lines: DataFrame) -> DataFrame:
    """(file, start, part, odd, line, value): the text of each block in stretches of whole lines.

    ``odd`` tells whether a stretch holds an odd number of quotes, ``line`` is the first line of a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part = None, 0
        for batch in batches:
            for key, rows in by_block(batch):
                if key != block:
                    block, part = key, 0
                texts = stretches(rows.column("value"), "\n")
                n = len(texts)
                line = [rows.column("value")[0].as_py() if key[1] == 0 and part == 0 else None, *[None] * (n - 1)]
                columns = [
                    pa.array([key[0]] * n, pa.string()),
                    pa.array([key[1]] * n, pa.int64()),
                    pa.array(range(part, part + n), pa.int32()),
                    pc.bit_wise_and(pc.count_substring(texts, '"'), pa.scalar(1, pa.int32())),
                    pa.array(line, pa.string()),
                    texts,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["file", "start", "part", "odd", "line", "value"])
                part += n

    shape = "file string, start bigint, part int, odd int, line string, value string"
    return in_tasks(lines.select("file", "start", "value")).mapInArrow(run, shape)


def block_states(blocks: DataFrame) -> DataFrame:
    """(file, start, part, open, crossed, header), one row per stretch of a block.

    A stretch turns the state "inside a quoted cell" if it holds an odd number of quotes.
    These maps are composed along a file, so ``open`` tells the state in which a stretch
    begins, and ``crossed`` whether a row reaches over either of its ends.  ``header`` is
    the first line of the file.  A quote counts wherever it stands, as in files that
    quote every cell holding one; a header is one line.
    """
    along = Window.partitionBy("file").orderBy("start", "part")
    state = F.pmod(F.sum("odd").over(along), F.lit(2))
    whole = Window.partitionBy("file")
    header = _stripped(F.first("line", ignorenulls=True).over(whole))
    return blocks.select(
        "file",
        "start",
        "part",
        (F.pmod(state - F.col("odd"), F.lit(2)) == 1).alias("open"),
        ((state == 1) | (F.pmod(state - F.col("odd"), F.lit(2)) == 1)).alias("crossed"),
        header.alias("header"),
    )


def _names(header: str) -> list[str]:
    return [name.strip() for name in next(csv.reader([header]), [])]


class _Rows:
    """Cells of whole rows in the wanted columns, by the header of their file."""

    def __init__(self, wanted: list[str]):
        self.wanted, self.places = wanted, {}
        csv.field_size_limit((1 << 31) - 1)

    def cells(self, header: str, records: list[str]) -> list[list[str]]:
        places = self.places.get(header)
        if places is None:
            at = {name: k for k, name in enumerate(_names(header))}  # of a repeated name the last
            places = self.places[header] = [at.get(name, -1) for name in self.wanted]
        columns = [[] for _ in self.wanted]
        for row in _parsed(records):
            for column, place in zip(columns, places):
                column.append(row[place] if 0 <= place < len(row) else "")
        return columns

    def batch(self, header: str, records: list[str]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.string()) for c in self.cells(header, records)]
        return pa.RecordBatch.from_arrays(columns, self.wanted)


def _parsed(records: list[str]) -> list[list[str]]:
    """The cells of each record; one that is not well formed does not disturb its neighbours."""
    try:
        rows = list(csv.reader(records))
        if len(rows) == len(records):
            return rows
    except csv.Error:
        pass
    rows = []
    for record in records:
        try:
            rows.append(next(csv.reader([record]), []))
        except csv.Error:  # a bare carriage return outside of quotes
            rows.append(next(csv.reader([record.replace("\r", " ")]), []))
    return rows


def _record(lines: list[str]) -> str:
    return "\n".join(lines).removesuffix("\r")


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int, int], pa.RecordBatch, list[str]]]:
    """The rows of a batch that belong together, with their lines: a stretch, or the lines of a file read in one go."""
    if "part" not in batch.schema.names:
        for key, rows in by_block(batch):
            yield (*key, 0), rows, rows.column("value").to_pylist()
        return
    for k in range(batch.num_rows):
        row = batch.slice(k, 1)
        yield tuple(row.column(c)[0].as_py() for c in ("file", "start", "part")), row, row.column("value")[0].as_py().split("\n")


def _odd(lines: list[str]) -> list[int]:
    return [line.count('"') & 1 for line in lines]


def _whole_rows(lines: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows that begin and end in one stretch.

    ``lines`` are stretches with the state that they begin in and their file's header, or
    the lines of files that are one block each.
    """
    told = "part" in lines.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, block, inside, held, header = _Rows(wanted), None, False, None, ""
        for batch in batches:
            for key, part, values in _stretches(batch):
                skip = 0
                if key != block:  # a row left over from the last stretch is a fragment, see _fragments
                    block, inside = key, told and part.column("open")[0].as_py()
                    held = None if inside else []
                    skip = int(key[1:] == (0, 0))
                    header = values[0].removesuffix("\r").removeprefix("\ufeff") if skip else part.column("header")[0].as_py()
                records = []
                for value, turns in zip(values[skip:], _odd(values[skip:])):
                    inside ^= bool(turns)
                    if held is not None:
                        held.append(value)
                    if not inside:
                        if held is not None and (len(held) > 1 or held[0].strip("\r")):
                            records.append(_record(held))
                        held = []
                if records:
                    yield rows.batch(header, records)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in wanted])
    return lines.mapInArrow(run, schema)


def _fragments(lines: DataFrame) -> DataFrame:
    """(file, start, part, closes, header, text): the pieces of rows that cross the ends of stretches, two of each at most.

    ``closes`` tells a piece that ends a row from one that begins it or is its middle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, inside, held, head, header = None, False, [], False, ""

        def out(closes: bool) -> pa.RecordBatch:
            columns = [*([k] for k in block), [closes], [header], ["\n".join(held)]]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "part", "closes", "header", "text"]
            )

        for batch in batches:
            for key, part, values in _stretches(batch):
                if block is not None and inside:
                    yield out(False)
                block, inside, held = key, part.column("open")[0].as_py(), []
                header, head, skip = part.column("header")[0].as_py(), inside, int(key[1:] == (0, 0))
                for value, turns in zip(values[skip:], _odd(values[skip:])):
                    inside ^= bool(turns)
                    held.append(value)
                    if not inside:
                        if head:
                            yield out(True)
                        held, head = [], False
        if block is not None and inside:
            yield out(False)

    return lines.mapInArrow(run, "file string, start bigint, part int, closes boolean, header string, text string")


def _crossing_rows(lines: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows put together from the pieces that stretches hold of them."""
    along = Window.partitionBy("file").orderBy("start", "part", F.col("closes").desc())
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # A piece that closes a row ends its group; in a stretch it stands before the one that opens the next.
    pieces = _fragments(lines).withColumn("row", F.coalesce(F.count_if("closes").over(before), F.lit(0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "text"))), lambda p: p["text"])
    joined = pieces.groupBy("file", "row", "header").agg(F.array_join(texts, "\n").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(wanted)
        for batch in batches:
            for header, text in zip(batch.column("header").to_pylist(), batch.column("text").to_pylist()):
                yield rows.batch(header, [text.removesuffix("\r")])

    schema = T.StructType([T.StructField(c, T.StringType()) for c in wanted])
    return joined.select("header", "text").mapInArrow(run, schema)


def read_bodies(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of CSV files, each read by its own header, a large file by many tasks.

    Quoted cells may hold line ends, so the state in which a block begins is composed
    from the blocks before it; rows that cross the end of a block are put together from
    their pieces.  A cell belongs to the name above it; of a name that stands twice in
    a header the last counts.  The result has ``columns``, or all names of all files in
    the order of the files.  All cells are text: columns that a file lacks and short
    rows are padded with '', cells beyond the header are cut, empty lines are no rows.
    Files that are too small to be split are read by their own first line; the others
    are read once, into staged stretches of whole lines with their quotes counted, and
    all else is made of these.  What comes to the driver is one row per distinct header,
    and that only if ``columns`` are not given.
    """
    lines = file_lines(spark, paths)
    large = lines.where(may_split(spark))
    small = lines.where(~may_split(spark))
    blocks = None if large.isEmpty() else staged(file_blocks(large), "blocks")
    wanted = columns
    if wanted is None:
        first = first_lines(small)
        if blocks is not None:
            first = first.unionByName(blocks.where("line IS NOT NULL").select("file", "line"))
        wanted = list(dict.fromkeys(n for header in distinct_headers(first) for n in _names(header) if n))
    if not wanted:
        return spark.createDataFrame([], T.StructType([]))
    rows = _whole_rows(small.select("file", "start", "value"), wanted)
    if blocks is None:
        return rows
    states = staged(block_states(blocks), "states")
    size = states.agg(
        F.sum(F.octet_length("file") + F.octet_length("header")).alias("bytes"), F.count_if("crossed").alias("crossed")
    ).first()
    known = F.broadcast(states) if size["bytes"] <= BLOCK_LIST_BYTES else states  # too many to send along: both sides meet
    stated = blocks.join(known, ["file", "start", "part"]).select("file", "start", "part", "open", "crossed", "header", "value")
    rows = rows.unionByName(_whole_rows(stated, wanted))
    if not size["crossed"]:
        return rows
    return rows.unionByName(_crossing_rows(stated.where("crossed"), wanted))
