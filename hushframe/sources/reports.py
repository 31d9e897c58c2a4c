"""Analysis reports that are one large JSON document each, read by many tasks.

A report's findings are one array, so no line tells where a finding begins.  The text
is cut at closing braces, that of shorter files only where a comma follows, and scanned by
block.  The block that begins a file begins in a
known state and yields its findings at once.  Of the later blocks the text is staged in
stretches.  What a stretch does to the state "inside a string, inside these brackets" is a
map: the brackets it closes, then those it leaves open, for either string state it may
begin in.  The maps are composed along a file, and with the state it begins in each
stretch yields its findings on its own; those that cross its ends are put together from
their pieces.

Defined cases: a file without findings, an empty one, and one that is no object have no
rows; of a file that ends too early the findings before the end are read, and one that is cut
right behind a value is read with the values it has (in a file above SHORT not behind a brace); braces,
brackets and the name of the array inside strings count for nothing; arrays of the same
name deeper in the document are part of what they are in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hushframe.session import staged
from hushframe.sources.blocks import by_block, in_tasks, lines_of, may_split, stretches
from hushframe.sources.payloads import violation_columns, violation_of

FINDINGS = b"violations"
#: Bytes of files that are cut into fewer rows; without a cut such a file is one row, which is why longer ones are not.
SHORT = 32 << 20

#: Kinds of bytes that count.
_QUOTE, _BACK, _BRACE, _BRACKET, _CLOSE = 1, 2, 3, 4, 5
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b'"\\{[]}')] = [_QUOTE, _BACK, _BRACE, _BRACKET, _CLOSE, _CLOSE]
#: What an open bracket is.
ARRAY, NAMED, OBJECT = 0, 1, 2


def in_finding(stack: list[int]) -> bool:
    return len(stack) > 2 and stack[0] != NAMED and stack[1] == NAMED and stack[2] == OBJECT


class Marks:
    """The brackets of one text outside of strings, for the state in which it begins."""

    def __init__(self, text: bytes):
        self.text = text
        kind = _KINDS[np.frombuffer(text, np.uint8)]
        at = np.flatnonzero(kind)
        kind = kind[at]
        back = at[kind == _BACK]
        if len(back):  # what follows an odd number of backslashes is no end of a string
            first = np.flatnonzero(np.diff(back, prepend=-2) != 1)
            last = np.append(first[1:], len(back)) - 1
            escaped = back[last][(last - first) % 2 == 0] + 1
            k = np.minimum(np.searchsorted(at, escaped), len(at) - 1)
            k = k[(at[k] == escaped) & (kind[k] == _QUOTE)]
            kind[k] = 0
        quotes = kind == _QUOTE
        self.quotes = at[quotes]
        brackets = kind >= _BRACE
        self._at, self._kind = at[brackets], kind[brackets]
        self._turned = (np.cumsum(quotes) & 1)[brackets]
        self._levels: dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def ends(self, inside: bool) -> bool:
        return bool(inside ^ (len(self.quotes) & 1))

    def brackets(self, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, kind, level): ``level`` counts the brackets open after each, those open before left out."""
        if inside not in self._levels:
            outside = self._turned == int(inside)
            kind = self._kind[outside]
            self._levels[inside] = self._at[outside], kind, np.cumsum(np.where(kind == _CLOSE, -1, 1))
        return self._levels[inside]

    def what(self, place: int, kind: int) -> int:
        """What the bracket at a place opens."""
        if kind == _BRACE:
            return OBJECT
        k = int(np.searchsorted(self.quotes, place)) - 1
        if k < 1 or self.text[self.quotes[k - 1] + 1 : self.quotes[k]] != FINDINGS:
            return ARRAY
        return NAMED if self.text[self.quotes[k] + 1 : place].strip() == b":" else ARRAY

    def does(self, inside: bool) -> tuple[int, list[int]]:
        """(pops, pushes): how many brackets the text closes that it did not open, and what it leaves open."""
        at, kind, level = self.brackets(inside)
        if not len(at):
            return 0, []
        later = np.minimum.accumulate(level[::-1])[::-1]
        stay = np.flatnonzero((kind != _CLOSE) & (later >= level))
        return -min(0, int(level.min())), [self.what(int(at[k]), int(kind[k])) for k in stay]

    def findings(self, inside: bool, stack: list[int]) -> tuple[int | None, list[tuple[int, int]], int | None]:
        """(end of the finding that the text begins in, whole findings, begin of the one it ends in)."""
        at, kind, level = self.brackets(inside)
        level = level + len(stack)
        level = level - np.minimum(0, np.minimum.accumulate(level)) if len(level) else level
        ends = at[(kind == _CLOSE) & (level == 2)] + 1
        closes = int(ends[0]) if in_finding(stack) and len(ends) else None
        begins = np.flatnonzero((kind == _BRACE) & (level == 3))
        for depth in (2, 1):  # the brackets around: the last one opened on their level
            opened = np.flatnonzero((kind != _CLOSE) & (level == depth))
            last = np.searchsorted(opened, begins)
            before = len(stack) >= depth and stack[depth - 1] == NAMED
            used = np.unique(last)
            named = {int(k): self.what(int(at[opened[k - 1]]), int(kind[opened[k - 1]])) == NAMED if k else before for k in used}
            begins = begins[np.array([named[int(k)] == (depth == 2) for k in used], bool)[np.searchsorted(used, last)]]
        starts = at[begins]
        stops = np.searchsorted(ends, starts)
        whole = stops < len(ends)
        spans = list(zip(starts[whole].tolist(), ends[stops[whole]].tolist()))
        return closes, spans, int(starts[-1]) if len(starts) and not whole[-1] else None


_WHOLE, _OPEN, _CLOSING, _STATE, _TEXT = 0, 1, 2, 3, 4
_ROW = {
    "file": pa.string(), "start": pa.int64(), "part": pa.int32(), "kind": pa.int32(), "text": pa.binary(),
    "ends": pa.list_(pa.bool_()), "pops": pa.list_(pa.int32()), "pushes": pa.list_(pa.list_(pa.int32())),
}
_SHAPE = (
    "file string, start bigint, part int, kind int, text string, "
    "ends array<boolean>, pops array<int>, pushes array<array<int>>"
)


def _rows(key: tuple[str, int], rows: list[tuple], shape: dict[str, pa.DataType] = _ROW) -> pa.RecordBatch:
    """A batch of rows of one block, without the block in them."""
    columns = [[key[0]] * len(rows), [key[1]] * len(rows), *map(list, zip(*rows))]
    arrays = [pa.array(c, kind) for c, kind in zip(columns, shape.values())]
    return pa.RecordBatch.from_arrays([a.cast(pa.string()) if a.type == pa.binary() else a for a in arrays], list(shape))


def _after(stack: list[int], pops: int, pushes: list[int]) -> list[int]:
    return stack[: max(0, len(stack) - pops)] + pushes


def _pieces(spark: SparkSession, paths: str | list[str], large: bool = True) -> DataFrame:
    """What the blocks of files hold, each read once.

    Whole findings and the open one at the end of a block that begins its file, with the
    state in which that block ends; the texts of other blocks with the maps of both states.
    """
    wanted, short = may_split(spark) if large else ~may_split(spark), F.col("size") <= SHORT
    few = _cut(lines_of(spark, paths, "},").where(wanted & short), "},")
    return few.unionByName(_cut(lines_of(spark, paths, "}").where(wanted & ~short), "}"))


def _cut(lines: DataFrame, separator: str) -> DataFrame:
    lines, sign = in_tasks(lines.select("file", "start", "value")), separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part, inside, stack, held = None, 0, False, [], []

        def end() -> pa.RecordBatch:
            state = (part + 1, _STATE, None, [inside] * 2, [0, 0], [stack] * 2)
            left = [(part, _OPEN, b"".join(held), None, None, None)] if held else []
            return _rows(block, [*left, state])

        for batch in batches:
            for key, rows in by_block(batch):
                if key != block:
                    if block is not None and block[1] == 0:
                        yield end()
                    block, part, inside, stack, held = key, 0, False, [], []
                for text in stretches(rows.column("value"), separator).cast(pa.binary()).to_pylist():
                    text, part = text + sign, part + 1
                    marks = Marks(text)
                    if key[1]:
                        maps = [marks.does(state) for state in (False, True)]
                        ends = [marks.ends(False), marks.ends(True)]
                        yield _rows(key, [(part, _TEXT, text, ends, [m[0] for m in maps], [m[1] for m in maps])])
                        continue
                    closes, spans, begins = marks.findings(inside, stack)
                    found = [text[a:z] for a, z in spans]
                    if held:
                        held.append(text[:closes])
                        if closes is not None:
                            found.append(b"".join(held))
                            held = []
                    if begins is not None:
                        held = [text[begins:]]
                    if found:
                        yield _rows(key, [(part, _WHOLE, t, None, None, None) for t in found])
                    stack = _after(stack, *marks.does(inside))
                    inside = marks.ends(inside)
        if block is not None and block[1] == 0:
            yield end()

    return lines.mapInArrow(run, _SHAPE)


def _composed(maps: pd.DataFrame) -> pd.DataFrame:
    """The state in which each stretch of one file begins."""
    inside, stack, rows = False, [], []
    for row in maps.sort_values(["start", "part"]).itertuples():
        rows.append((row.file, row.start, row.part, inside, list(stack)))
        begun = int(inside)
        stack = _after(stack, int(row.pops[begun]), [int(p) for p in row.pushes[begun]])
        inside = bool(row.ends[begun])
    return pd.DataFrame(rows, columns=["file", "start", "part", "inside", "stack"])


def file_states(pieces: DataFrame) -> DataFrame:
    """(file, start, part, inside, stack): one row per stretch, with the state it begins in.

    The maps of one file meet in one task; a stretch is one short row.
    """
    maps = pieces.where(F.col("kind").isin(_STATE, _TEXT)).select("file", "start", "part", "ends", "pops", "pushes")
    return maps.groupBy("file").applyInPandas(
        _composed, "file string, start bigint, part int, inside boolean, stack array<int>"
    )


def _texts(stated: DataFrame, crossing: bool) -> DataFrame:
    """(file, start, part, kind, text): whole findings, or the pieces of those that cross the ends of stretches."""
    shape = dict(list(_ROW.items())[:5])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                file, start, part, inside, stack, text = (c[k].as_py() for c in batch.columns)
                text = text.encode()
                closes, spans, begins = Marks(text).findings(inside, stack)
                found = [(part, _WHOLE, text[a:z]) for a, z in spans]
                if crossing:
                    found = [(part, _OPEN if closes is None else _CLOSING, text[:closes])] if in_finding(stack) else []
                    found += [(part, _OPEN, text[begins:])] if begins is not None else []
                if found:
                    yield _rows((file, start), found, shape)

    columns = ("file", "start", "part", "inside", "stack", "text")
    return stated.select(*columns).mapInArrow(run, "file string, start bigint, part int, kind int, text string")


def _joined(pieces: DataFrame) -> DataFrame:
    """(file, text) of findings put together; a finding without an end stays out."""
    along = Window.partitionBy("file").orderBy("start", "part", F.col("kind").desc())
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.withColumn("row", F.coalesce(F.count_if(F.col("kind") == _CLOSING).over(before), F.lit(0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "text"))), lambda p: p["text"])
    whole = numbered.groupBy("file", "row").agg(
        F.array_join(texts, "").alias("text"), F.max("kind").alias("last")
    )
    return whole.where(F.col("last") == _CLOSING).select("file", "text")


def finding_texts(spark: SparkSession, paths: str | list[str], root: str | None = None) -> DataFrame:
    """(file, text): every finding of every report, as JSON; no text is read twice from the files."""
    whole = F.col("kind") == _WHOLE
    found = _pieces(spark, paths, False).where(whole).select("file", "text")
    if lines_of(spark, paths, "}").where(may_split(spark)).isEmpty():
        return found
    large = staged(_pieces(spark, paths), "findings", root)
    found = found.unionByName(large.where(whole).select("file", "text"))
    later = large.where(F.col("kind") == _TEXT)
    if later.isEmpty():
        return found
    states = staged(file_states(large), "states", root)
    stated = later.select("file", "start", "part", "text").join(states, ["file", "start", "part"])
    ends = large.where(F.col("kind") == _OPEN).select("file", "start", "part", "kind", "text")
    crossing = _joined(ends.unionByName(_texts(stated, True)))
    return found.unionByName(_texts(stated, False).select("file", "text")).unionByName(crossing)


def read_report_files(spark: SparkSession, paths: str | list[str], root: str | None = None) -> DataFrame:
    """One row per finding with its primary location, and the ``report`` file it is from.

    What is staged lies below the shared folder, or in a folder ``root`` that the caller
    drops when the rows are no longer needed.
    """
    # A finding is never null, and a filter that asks would parse it once more.
    found = finding_texts(spark, paths, root).select(F.col("file").alias("report"), violation_of(F.col("text")).alias("v"))
    return violation_columns(found, ["report"])
