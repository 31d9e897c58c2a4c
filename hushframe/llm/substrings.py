"""Substring dedup by super-k-mers.

A window is 13 consecutive words.  Its minimiser is the least hash of its runs of
four words, and neighbouring windows mostly share it, so they travel together: as
one packed string of words, to the bucket the minimiser names.  Equal windows have
equal minimisers and meet in one bucket, where sorting brings them side by side and
their words are compared, so hashes alone decide nothing.

Before anything is sent, a task joins equal strings of the documents at hand.  All
but the document with the smallest id are settled there, and the string travels
once.  What a bucket gets for a passage is therefore bounded by the number of tasks, even
if a third of all documents hold it.

Defined cases: null, empty and blank texts have no words and lose none; texts of
fewer words than a window lose none; rows that share an id never take words from
each other; a null id ranks as the largest; an empty table gives an empty result.
Ids are integers.  Only the id and the text are read; extra columns do not appear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import row_key, slices, text_of

WINDOW = 13
#: Words of a minimiser.
RUN = 4

#: Bytes of packed strings a bucket is to hold; the number of buckets follows the input.
BUCKET_BYTES = 24 << 20
#: Words a task works on at once; longer texts are cut with overlap.
PASS_WORDS = 1 << 20

_NULL_ID = np.iinfo(np.int64).max
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Ranges:
    """64-bit hashes of any ranges of a sequence of numbers."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(numbers) * _powers(_BASE, n), out=self.sums[1:], dtype=np.uint64)
        self.back = _powers(_INVERSE, n + 1)

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.back[start]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = lists.flatten()
    real = np.asarray(pc.greater(pc.binary_length(words), 0))
    counts = np.concatenate([[0], np.cumsum(real)])
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return (words if real.all() else words.filter(pa.array(real))), counts[offsets - offsets[0]]


def _coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = words.dictionary_encode()
    return np.asarray(encoded.indices), encoded.dictionary


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    done = 1
    n = len(x) - width + 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n])


def super_kmers(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser, text) of each super-k-mer.

    ``hashes`` has one number per word; text k has the words begin[k]..end[k].
    """
    none = np.empty(0, np.int64)
    if len(hashes) < WINDOW:
        return none, none, none.astype(np.uint64), none
    runs = hashes[: len(hashes) - RUN + 1].copy()
    for k in range(1, RUN):
        runs = mixed(runs) + hashes[k : len(hashes) - RUN + 1 + k]
    least = _sliding_least(mixed(runs), WINDOW - RUN + 1)
    windows = np.maximum(0, end - begin - WINDOW + 1)
    text = np.repeat(np.arange(len(begin)), windows)
    first = np.cumsum(windows) - windows
    at = begin[text] + np.arange(len(text)) - first[text]
    if not len(at):
        return none, none, none.astype(np.uint64), none
    value = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    return at[start], np.diff(np.append(start, len(at))), value[start], text[start]


def _concatenated(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    first = np.cumsum(length) - length
    return np.repeat(start - first, length) + np.arange(int(length.sum()))


#: Columns of a packed string: words, its number, place, id and row of each occurrence.
_PACKED = (np.int32, np.int32, np.int32, np.int64, np.int64)
#: Of zstandard; packed strings are most of what is shuffled.
LEVEL = 6


def _pack(arrays: list[np.ndarray], text: bytes) -> bytes:
    """Arrays and text as one compressed string; numbers as steps, like bytes side by side."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    steps = [np.diff(a, prepend=a.dtype.type(0)) for a in arrays]
    planes = [a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in steps]
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join([head, *planes, text]))


def _unpack(blob: bytes) -> tuple[list[np.ndarray], memoryview]:
    body = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    counts = np.frombuffer(body[: 8 * len(_PACKED)], np.int64)
    arrays, at = [], 8 * len(_PACKED)
    for n, kind in zip(counts.tolist(), _PACKED):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(body[at : at + n * width], np.uint8).reshape(width, n)
        arrays.append(np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind))
        at += n * width
    return arrays, body[at:]


def _runs(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """Word ranges in order of their row; touching ranges become one."""
    order = np.lexsort((starts, rows, ids))
    ids, rows, starts, ends = ids[order], rows[order], starts[order], (starts + lengths)[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] > ends[:-1])
    at = np.flatnonzero(new)
    ends = np.maximum.reduceat(ends, at) if len(at) else ends
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[at]), pa.array(rows[at]), pa.array(starts[at].astype(np.int32)), pa.array(ends.astype(np.int32))],
        ["id", "row", "start", "end"],
    )


def _to_ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def _from_ipc(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def _sent(words: pa.Array, begin, end, shift, ids, rows, buckets: int) -> Iterator[tuple[int, bool, bytes]]:
    """(bucket, whether it is settled, packed) for the texts of one pass.

    ``shift`` is added to word positions of a text that was cut.
    """
    codes, dictionary = _coded(words)
    vocabulary = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in dictionary), np.uint64, len(dictionary))
    hashes = vocabulary[codes]
    start, count, minimiser, text = super_kmers(hashes, begin, end)
    if not len(start):
        return
    one, two = Ranges(hashes), Ranges(mixed(hashes ^ _BASE))
    length = count + WINDOW - 1
    key_one, key_two = one.hash(start, length), two.hash(start, length)
    order = np.lexsort((ids[text], key_two, key_one))
    new = np.ones(len(order), bool)
    k1, k2 = key_one[order], key_two[order]
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    group = np.cumsum(new) - 1
    head = order[new]
    settled = ids[text[order]] != ids[text[head]][group]
    place = start - begin[text] + shift[text]
    gone = order[settled]
    if len(gone):
        found = _runs(ids[text[gone]], rows[text[gone]], place[gone], length[gone])
        # spread by the first row, as any task may hand them on
        yield int(mixed(rows[text[gone[:1]]].view(np.uint64))[0] % np.uint64(buckets)), True, _to_ipc(found)
    bucket = (mixed(minimiser) % np.uint64(buckets)).astype(np.int64)
    spaced = pc.binary_join_element_wise(dictionary, pa.scalar("", dictionary.type), pa.scalar(" ", dictionary.type))
    by_bucket = np.lexsort((start[head], bucket[head]))  # in the order of the texts, which packs best
    stays = order[~settled]
    stay_group = group[~settled]
    number = np.empty(len(head), np.int64)  # of the string among those of its bucket
    sizes = np.bincount(bucket[head], minlength=buckets)
    number[by_bucket] = np.arange(len(head)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    occurrence = np.lexsort((start[stays], bucket[stays]))
    occurrences = np.bincount(bucket[stays], minlength=buckets)
    at_head, at_stay = np.cumsum(sizes) - sizes, np.cumsum(occurrences) - occurrences
    for b in np.flatnonzero(sizes):
        strings = head[by_bucket[at_head[b] : at_head[b] + sizes[b]]]
        mine = occurrence[at_stay[b] : at_stay[b] + occurrences[b]]
        who = stays[mine]
        taken = spaced.take(pa.array(codes[_concatenated(start[strings], length[strings])]))
        data = taken.buffers()[2]
        yield int(b), False, _pack(
            [
                length[strings].astype(np.int32),
                number[stay_group[mine]].astype(np.int32),
                place[who].astype(np.int32),
                ids[text[who]],
                rows[text[who]],
            ],
            data.to_pybytes(),
        )


def _passes(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first word, end) of the stretches that make up one pass; long texts are cut with overlap."""
    texts, firsts, ends, total = [], [], [], 0
    for k, (a, z) in enumerate(zip(begin.tolist(), end.tolist())):
        while a + WINDOW <= z:
            stop = min(z, a + PASS_WORDS)
            texts.append(k), firsts.append(a), ends.append(stop)
            total += stop - a
            a = z if stop == z else stop - WINDOW + 1
            if total >= PASS_WORDS:
                yield np.array(texts), np.array(firsts), np.array(ends)
                texts, firsts, ends, total = [], [], [], 0
    if texts:
        yield np.array(texts), np.array(firsts), np.array(ends)


def _found(blobs: list[bytes]) -> pa.RecordBatch | None:
    """The word ranges that the packed strings of one bucket show to be repeated."""
    parts = [_unpack(b) for b in blobs]
    lengths = np.concatenate([p[0][0] for p in parts]).astype(np.int64)
    strings = np.cumsum([0] + [len(p[0][0]) for p in parts])
    occ = np.concatenate([p[0][1].astype(np.int64) + s for p, s in zip(parts, strings)])
    place = np.concatenate([p[0][2] for p in parts]).astype(np.int64)
    ids, rows = (np.concatenate([p[0][k] for p in parts]) for k in (3, 4))
    string_ids = np.empty(len(lengths), np.int64)
    string_ids[occ] = ids  # all occurrences of a string that a task sends have one id
    texts = pa.array([bytes(p[1][:-1]) for p in parts], pa.large_binary()).cast(pa.large_string())
    codes, _ = _coded(pc.split_pattern(texts, " ").flatten())
    del texts
    counts = lengths - WINDOW + 1
    first_word = np.cumsum(lengths) - lengths
    at = _concatenated(first_word, counts)
    string = np.repeat(np.arange(len(lengths)), counts)
    keys = Ranges(codes.astype(np.uint64) + np.uint64(1)).hash(at, WINDOW)
    order = np.argsort(keys)

    def parted(order: np.ndarray, alike: np.ndarray) -> np.ndarray:
        """Where neighbours that may be alike have a different word."""
        one, other = at[order[:-1][alike]], at[order[1:][alike]]
        differ = np.zeros(len(one), bool)
        for k in range(WINDOW):
            differ |= codes[one + k] != codes[other + k]
        return differ

    equal = keys[order[1:]] == keys[order[:-1]]
    if parted(order, equal).any():  # two windows with one hash: sort by the words themselves
        order = np.lexsort([codes[at + k] for k in range(WINDOW)])
        equal = np.zeros(len(order) - 1, bool) if len(order) else equal
        equal = ~parted(order, np.ones(max(0, len(order) - 1), bool))
    new = np.append(True, ~equal) if len(order) else np.empty(0, bool)
    owner = string_ids[string[order]]
    least = np.minimum.reduceat(owner, np.flatnonzero(new))[np.cumsum(new) - 1]
    taken = np.zeros(len(order), bool)
    taken[order] = least < owner
    if not taken.any():
        return None
    # Stretches of repeated windows within a string, then for each place of the string.
    edge = np.ones(len(taken), bool)
    edge[1:] = (taken[1:] != taken[:-1]) | (string[1:] != string[:-1])
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(taken)))
    keep = taken[start]
    start, size = start[keep], size[keep]
    in_string, offset = string[start], at[start] - first_word[string[start]]
    per_string = np.bincount(in_string, minlength=len(lengths))
    first_run = np.cumsum(per_string) - per_string
    repeat = per_string[occ]
    run = _concatenated(first_run[occ], repeat)
    return _runs(
        np.repeat(ids, repeat), np.repeat(rows, repeat), np.repeat(place, repeat) + offset[run], size[run] + WINDOW - 1
    )


_SPANS = "id bigint, row bigint, start int, end int"


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, start, end): ranges of words that an earlier document has.

    A bucket returns one row per repeated stretch, so their number follows the
    occurrences and not the buckets.  Ranges of a text may overlap and are not in order.
    """
    rows = docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(int(_NULL_ID))).alias("id"), row_key(text).alias("row"), text_of(text).alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(8, -(-3 * size // BUCKET_BYTES)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words, bounds = split_words(batch.column("text"))
            ids = np.asarray(batch.column("id"))
            keys = np.asarray(batch.column("row"))
            for texts, begin, end in _passes(bounds[:-1], bounds[1:]):
                low, high = int(begin.min()), int(end.max())
                shift = begin - bounds[:-1][texts]
                part = words.slice(low, high - low)
                sent = list(_sent(part, begin - low, end - low, shift, ids[texts], keys[texts], buckets))
                if sent:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s[0] for s in sent], pa.int32()), pa.array([s[1] for s in sent]), pa.array([s[2] for s in sent], pa.binary())],
                        ["bucket", "settled", "packed"],
                    )

    def meet(table: pa.Table) -> pa.Table:
        settled = np.asarray(table.column("settled").combine_chunks().cast(pa.uint8())).astype(bool)
        packed = table.column("packed").to_pylist()
        out = [_from_ipc(p) for p, s in zip(packed, settled) if s]
        if not settled.all():
            found = _found([p for p, s in zip(packed, settled) if not s])
            out += [] if found is None else [pa.Table.from_batches([found])]
        if not out:
            none, places = pa.array([], pa.int64()), pa.array([], pa.int32())
            return pa.table({"id": none, "row": none, "start": places, "end": places})
        return pa.concat_tables(out)

    sent = rows.mapInArrow(send, "bucket int, settled boolean, packed binary")
    return sent.groupBy("bucket").applyInArrow(meet, _SPANS)


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text, spans) per row of ``docs``.

    ``kept_text`` has the words that stay, joined by one space; ``spans`` the removed
    ranges of words in order.
    """
    rows = docs.select(
        F.col(key).alias("given"),
        F.coalesce(F.col(key).cast("long"), F.lit(int(_NULL_ID))).alias("id"),
        row_key(text).alias("row"),
        text_of(text).alias("text"),
    )
    spans = (
        repeated_spans(docs, key, text)
        .groupBy("id", "row")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
        .select("id", "row", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    )
    joined = rows.join(spans, (rows["id"] == spans["id"]) & rows["row"].eqNullSafe(spans["row"]), "left").select(
        "given", "text", "starts", "ends"
    )
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n_words, n_removed, texts, found = [], [], [], []
            for text, starts, ends in zip(*(batch.column(c) for c in ("text", "starts", "ends"))):
                words = text.as_buffer().to_pybytes().split()
                spans = merged(starts.values.to_numpy(), ends.values.to_numpy()) if starts.is_valid else []
                left, at = [], 0
                for a, z in spans:
                    left += words[at:a]
                    at = z
                left += words[at:]
                n_words.append(len(words)), n_removed.append(len(words) - len(left))
                texts.append(b" ".join(left)), found.append([{"start": a, "end": z} for a, z in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("given"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["id", "n_words", "n_removed", "kept_text", "spans"],
            )

    return joined.mapInArrow(
        cut, f"id {kind}, n_words bigint, n_removed bigint, kept_text string, spans array<struct<start:int,end:int>>"
    )


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges, in order."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    at = np.flatnonzero(new)
    return list(zip(starts[at].tolist(), ends[np.append(at[1:], len(ends)) - 1].tolist()))
