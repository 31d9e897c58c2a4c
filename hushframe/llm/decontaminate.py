"""Benchmark decontamination: an FM-index per training shard.

The test items become phrases of ten words; an item of fewer is one phrase.  A task
gathers its documents into shards.  Only words that occur in a phrase have a number, and
no occurrence reaches across another word, so a shard is a collection of strings: the
runs of numbered words that are as long as the shortest phrase.  Nothing is lost by that,
and where a benchmark knows all words of a text, the text is one string.  The shard is
indexed, all phrases are searched backwards at once, occurrences are located through
sampled suffixes, and the words they cover are merged into spans.

The benchmark travels in blocks of bounded size; the documents pass every block in turn.
A document's rows never move, so nothing is shuffled and no text is hot.

Defined cases: null, empty and wordless texts and items have no words, and such items
occur nowhere; items that share an id count once, and an item without an id is told as
the empty string; rows that share a document id are separate rows, a null id stays null;
an empty table gives an empty result, an empty benchmark leaves all documents clean.  Of
both tables the id and the text alone are read.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import LOWER, UPPER, slices, staged, text_of
from hushframe.llm.fmindex import Index
from hushframe.llm.wordscan import find_words, hashed

WINDOW = 10
#: Bytes of test text that travel to the tasks at once, and phrases that a piece of an item starts.
BLOCK_BYTES = 4 << 20
PIECE = 4096
#: Numbers, texts and bytes that a shard gathers before it is indexed.
SHARD_WORDS = 1 << 21
SHARD_ROWS = 1 << 17
SHARD_BYTES = 64 << 20
#: Patterns searched and rows located at once.
AT_ONCE = 1 << 19

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Phrases(NamedTuple):
    """Distinct phrases of one block: ``by_size`` holds lines of word numbers; ``owners`` the items of each phrase."""

    vocabulary: np.ndarray
    by_size: list[np.ndarray]
    owners: np.ndarray
    owner_bounds: np.ndarray
    items: list[str]

    @property
    def shortest(self) -> int:
        return min((p.shape[1] for p in self.by_size), default=1 << 62)

    @property
    def width(self) -> int:
        return max(1, len(self.vocabulary).bit_length())

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 for words that no phrase has."""
        maybe = np.zeros(1 << 20, bool)
        maybe[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        out = np.zeros(len(hashes), np.int64)
        asked = np.flatnonzero(maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(asked):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[asked]), len(self.vocabulary) - 1)
            out[asked] = np.where(self.vocabulary[at] == hashes[asked], at + 1, 0)
        return out


def pieces(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, text) of items cut into pieces that together have all their phrases."""
    lowered = F.translate(text_of(text), UPPER, LOWER)
    words = benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.array_remove(F.split(lowered, _GAP), "").alias("words")
    ).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE))
    cut = F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, PIECE + window - 1), " "))
    return words.select("item", F.explode(cut).alias("text"))


def phrases(items: list[str], texts: pa.Array, window: int = WINDOW) -> Phrases:
    """The phrases of one block."""
    words = find_words(texts)
    hashes = hashed(words)
    vocabulary, numbers = np.unique(hashes, return_inverse=True)
    names = sorted(set(items))
    place = {name: k for k, name in enumerate(names)}
    owner = np.array([place[i] for i in items], np.int64)
    counts = np.diff(words.bounds)
    by_size, owners = [], []
    for size in sorted({min(window, int(c)) for c in counts if c}):
        of = np.flatnonzero(counts >= window) if size == window else np.flatnonzero(counts == size)
        n = counts[of] - size + 1
        text = np.repeat(of, n)
        first = np.repeat(words.bounds[of] - (np.cumsum(n) - n), n) + np.arange(len(text))
        lines = (numbers + 1)[first[:, None] + np.arange(size)].astype(np.int32)
        distinct, which = np.unique(lines, axis=0, return_inverse=True)
        base = sum(len(p) for p in by_size)
        owners.append(np.unique(np.stack([which.ravel() + base, owner[text]], axis=1), axis=0))
        by_size.append(distinct)
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *owners])
    bounds = np.searchsorted(pairs[:, 0], np.arange(sum(len(p) for p in by_size) + 1))
    return Phrases(vocabulary, by_size, pairs[:, 1].astype(np.int32), bounds, names)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class Shard:
    """Documents of one task, and the strings of numbered words they hold."""

    def __init__(self, known: Phrases):
        self.known = known
        self.batches: list[pa.RecordBatch] = []
        self.counts: list[np.ndarray] = []
        self.strings: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.places: list[tuple[np.ndarray, ...]] = []
        self.words = self.rows = self.bytes = 0

    @property
    def full(self) -> bool:
        return self.words >= SHARD_WORDS or self.rows >= SHARD_ROWS or self.bytes >= SHARD_BYTES

    def add(self, batch: pa.RecordBatch) -> None:
        words = find_words(batch.column("text"))
        number = self.known.numbers(hashed(words))
        # A run ends before a word without a number, and where a text ends.
        edge = np.zeros(len(number) + 1, bool)
        edge[words.bounds] = True
        edge[1:-1] |= (number[1:] != 0) != (number[:-1] != 0)
        start = np.flatnonzero(edge)
        size = np.diff(start)
        start = start[:-1]
        keep = (size >= self.known.shortest) & (number[start] != 0)
        start, size = start[keep], size[keep]
        word = _spread(start, size)
        at = np.arange(len(word)) + np.repeat(np.arange(len(size)), size)
        string = np.zeros(len(word) + len(size), np.int64)
        string[at] = number[word]
        text = words.text_of(word)
        self.strings.append(string)
        # In the order of the strings: row of the shard, word, and its bytes in the text; -1 for the closing 0.
        place = [np.full(len(string), -1, np.int64) for _ in range(4)]
        for held, value in zip(
            place,
            (
                text + self.rows,
                word - words.bounds[text],
                words.begin[word] - words.offsets[text],
                words.end[word] - words.offsets[text],
            ),
        ):
            held[at] = value
        self.places.append(tuple(place))
        self.batches.append(batch)
        self.counts.append(np.diff(words.bounds))
        self.words += len(string)
        self.rows += batch.num_rows
        self.bytes += batch.column("text").nbytes

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, place among the strings, size of the phrase) of the occurrences, some at a time."""
        index = Index(np.concatenate(self.strings), self.known.width)
        base = 0
        for lines in self.known.by_size:
            for start in range(0, len(lines), AT_ONCE):
                which, low, high = index.search(lines[start : start + AT_ONCE])
                total = np.cumsum(high - low)
                done = 0
                while done < len(which):
                    stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + AT_ONCE, "right")))
                    count = (high - low)[done:stop]
                    rows = _spread(low[done:stop], count)
                    phrase = np.repeat(which[done:stop], count) + start + base
                    yield phrase, index.locate(rows), np.full(len(rows), lines.shape[1])
                    done = stop
            base += len(lines)

    def judged(self) -> tuple[np.ndarray, list[list[str]], list[list[dict]]]:
        """(words, items, spans) of each row of the shard."""
        items: list[list[str]] = [[] for _ in range(self.rows)]
        spans: list[list[dict]] = [[] for _ in range(self.rows)]
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int64)
        if not self.words:
            return counts, items, spans
        row, word, begin, end = (np.concatenate([[-1], *held]) for held in zip(*self.places))
        steps = np.zeros(len(row) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for phrase, place, size in self.found():
            np.add.at(steps, place, 1)
            np.subtract.at(steps, place + size, 1)
            held = np.unique(np.stack([row[place], phrase], axis=1), axis=0)
            bounds = self.known.owner_bounds
            n = bounds[held[:, 1] + 1] - bounds[held[:, 1]]
            owner = self.known.owners[_spread(bounds[held[:, 1]], n)]
            pairs.append(np.unique(np.stack([np.repeat(held[:, 0], n), owner], axis=1), axis=0))
        for r, i in np.unique(np.concatenate(pairs), axis=0).tolist():
            items[r].append(self.known.items[i])
        covered = np.append(False, np.append(np.cumsum(steps[:-1]) > 0, False))
        edge = np.flatnonzero(covered[1:] != covered[:-1])
        for a, z in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()):
            spans[row[a]].append({"first": int(word[a]), "last": int(word[z]), "begin": int(begin[a]), "end": int(end[z])})
        return counts, items, spans


def union(spans: list[dict]) -> list[dict]:
    """The spans in order; those that overlap or touch become one."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if not out or s["first"] > out[-1]["last"] + 1:
            out.append(dict(s))
        elif s["last"] > out[-1]["last"]:
            out[-1].update(last=s["last"], end=s["end"])
    return out


_SPAN = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("begin", pa.int64()), ("end", pa.int64())])
_FOUND = "n_words bigint, items array<string>, spans array<struct<first:int,last:int,begin:bigint,end:bigint>>"


def _passed(docs: DataFrame, known: Phrases, keep_text: bool) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def out(shard: Shard) -> Iterator[pa.RecordBatch]:
        counts, items, spans = shard.judged()
        at = 0
        for batch in shard.batches:
            until = at + batch.num_rows
            columns = [
                batch.column("id"),
                *([batch.column("text")] if keep_text else []),
                pa.array(counts[at:until], pa.int64()),
                pa.array([sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), items[at:until])], pa.list_(pa.string())),
                pa.array([union(a + b) for a, b in zip(batch.column("spans").to_pylist(), spans[at:until])], pa.list_(_SPAN)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", *(["text"] if keep_text else []), "n_words", "items", "spans"])
            at = until

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(known)
        for batch in slices(batches, "text"):
            shard.add(batch)
            if shard.full:
                yield from out(shard)
                shard = Shard(known)
        if shard.batches:
            yield from out(shard)

    return docs.mapInArrow(run, f"id {kind}, {'text string, ' if keep_text else ''}{_FOUND}")


def spans(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    keep_text: bool = False,
) -> DataFrame:
    """(id, n_words, items, spans) per row of ``docs``, and ``text`` if asked for.

    ``items`` are the test items that occur, in order; ``spans`` the merged ranges of
    words that occurrences cover, in order: first and last word, and their bytes.
    """
    held = docs.select(
        F.col(key).alias("id"),
        text_of(text).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast("array<string>").alias("items"),
        F.array().cast("array<struct<first:int,last:int,begin:bigint,end:bigint>>").alias("spans"),
    )
    cut = staged(pieces(benchmark, item, item_text, window), "phrases")
    size = cut.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    blocks = max(1, int(-(-size // BLOCK_BYTES)))
    for block in range(blocks):
        part = cut.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        known = phrases(part.column("item").to_pylist(), part.column("text").combine_chunks(), window)
        if block + 1 == blocks:
            return _passed(held, known, keep_text)
        held = staged(_passed(held, known, True), "decontaminated")
    raise AssertionError("there is a last block")


def hit_words(spans: str = "spans"):
    """The number of words that spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def removed(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, text, n_hit) per row of ``docs``: the text without the bytes of its spans."""
    found = spans(docs, benchmark, key, text, keep_text=True, **options)
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    begins = F.concat(F.transform("spans", lambda s: s["begin"]), F.array(F.octet_length("text").cast("long")))
    data = F.col("text").cast("binary")
    parts = F.transform(
        F.arrays_zip(ends.alias("a"), begins.alias("z")),
        lambda p: F.hex(F.substring(data, (p["a"] + 1).cast("int"), (p["z"] - p["a"]).cast("int"))),
    )
    return found.select("id", F.unhex(F.array_join(parts, "")).cast("string").alias("text"), hit_words().alias("n_hit"))
