"""Target-distribution importance resampling over hashed runs of words.

A feature is a run of one to three words, and its bucket the CRC-32 of its bytes.  A
dictionary automaton (Aho-Corasick) over the distinct words at hand, each bounded by
delimiters, reads the texts and emits for each word its payload: CRC and length.  The CRC
of a run follows from the payloads of its words alone, because appending n bytes to a
message turns its CRC by a linear map that depends on n only; no run is ever spelled out.

Buckets are counted over the whole corpus and over the target, a document's weight is the
sum of its buckets' gains, and a Gumbel draw keyed by the document's id decides the order.
The order is one range partitioning of narrow rows with the sizes of the ranges added up.

Defined cases: null, empty and wordless texts have no features and weight 0; a document
without an id draws as the id ``null`` and comes last of equal scores; rows that share an
id share the draw and are ranked as separate rows; an empty corpus gives an empty result,
an empty target counts 0 in every bucket.  Of both tables the id and the text alone are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import slices, staged, text_of
from hushframe.llm.wordscan import ALPHANUMERIC, LOWERED

BUCKETS = 10_000
RUN = 3
SEED = 42
#: Percent of the documents of at least MIN_WORDS words that are drawn.
SHARE = 5
MIN_WORDS = 20

#: Lengths that have a table of their own; longer ones are put together from powers of two.
TABLED = 64
#: Bits of a payload that hold the length.
_LENGTH = 31

_SPACED = bytes(LOWERED[c] if ALPHANUMERIC[c] else 32 for c in range(256))


def _byte_maps() -> tuple[np.ndarray, np.ndarray]:
    """What n zero bytes, and 2^k zero bytes, make of a CRC register: tables by byte of the register."""

    def apply(table: np.ndarray, register: np.ndarray) -> np.ndarray:
        out = np.zeros_like(register)
        for k in range(4):
            out ^= table[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    value = np.arange(256, dtype=np.uint32)
    one = value.copy()
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1))
    step = np.stack([one, *(value << np.uint32(8 * (k - 1)) for k in (1, 2, 3))])
    identity = np.stack([value << np.uint32(8 * k) for k in range(4)])
    tables = [identity]
    for _ in range(TABLED):
        tables.append(np.stack([apply(step, row) for row in tables[-1]]))
    powers = [step]
    for _ in range(_LENGTH):
        powers.append(np.stack([apply(powers[-1], row) for row in powers[-1]]))
    return np.stack(tables), np.stack(powers)


_TABLES, _POWERS = _byte_maps()


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The part of a message's CRC in that of the message and ``length`` more bytes."""
    small = np.minimum(length, TABLED)
    out = np.zeros_like(crc)
    for k in range(4):
        out ^= _TABLES[small, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    long = np.flatnonzero(length > TABLED)
    if len(long):
        rest, crcs = length[long] - TABLED, out[long]
        for power in range(int(rest.max()).bit_length()):
            some = (rest >> power) & 1 != 0
            part = crcs[some]
            turned = np.zeros_like(part)
            for k in range(4):
                turned ^= _POWERS[power, k, (part >> np.uint32(8 * k)) & np.uint32(255)]
            crcs[some] = turned
        out[long] = crcs
    return out


_SPACE = np.uint32(zlib.crc32(b" "))


def automaton_of(words: set[str]) -> ahocorasick.Automaton:
    """An automaton that emits the payload of every one of ``words`` that stands between delimiters."""
    automaton = ahocorasick.Automaton()
    for word in words:
        data = word.encode()
        automaton.add_word(f" {word} ", zlib.crc32(data) << _LENGTH | len(data))
    automaton.make_automaton()
    return automaton


def spaced(text: str) -> str:
    """The text with A-Z in lower case and one delimiter for all, bounded by it."""
    return f" {text.encode().translate(_SPACED).decode()} "


def payloads(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(crc, length, text) of all words of the texts in order."""
    ready = [spaced(t) for t in texts]
    words = set().union(*map(str.split, ready, [" "] * len(ready))) - {""}
    if not words:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint32), none, none
    automaton = automaton_of(words)
    found = [np.fromiter((p for _, p in automaton.iter(t)), np.int64) for t in ready]
    all_ = np.concatenate(found)
    crc = (all_ >> _LENGTH).astype(np.uint32)
    return crc, all_ & ((1 << _LENGTH) - 1), np.repeat(np.arange(len(found)), [len(f) for f in found])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of all features of the texts, and the number of words of each text."""
    crc, length, text = payloads(texts)
    buckets, owners = [crc % BUCKETS], [text]
    run = crc
    led = shifted(np.full(len(crc), _SPACE), length) ^ crc  # of a space and the word
    for size in range(2, RUN + 1):
        run = shifted(run[:-1], length[size - 1 :] + 1) ^ led[size - 1 :]
        within = text[size - 1 :] == text[: len(text) - size + 1]
        buckets.append(run[within] % BUCKETS)
        owners.append(text[size - 1 :][within])
    words = np.bincount(text, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), words


def bucket_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many features of all texts lie in each bucket; a task sends one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, "text"):
            buckets, _, _ = features(batch.column("text").to_pylist())
            counts += np.bincount(buckets, minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held])], ["bucket", "n"])

    found = docs.select(text_of(text).alias("text")).mapInArrow(run, "bucket int, n bigint")
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[bucket] = n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight."""
    big_s, big_t = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [
            math.floor(1000 * math.log((float(t + 1) * big_s) / (float(s + 1) * big_t)))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) per row of ``docs``."""
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buckets, owner, words = features(batch.column("text").to_pylist())
            order = np.argsort(owner, kind="stable")
            sums = np.concatenate([[0], np.cumsum(gain[buckets[order]])])
            n = np.bincount(owner, minlength=batch.num_rows)
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(words.astype(np.int64)),
                    pa.array(n.astype(np.int64)),
                    pa.array(sums[ends] - sums[ends - n]),
                ],
                ["id", "n_words", "n_features", "weight"],
            )

    return rows.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def scored(weights: DataFrame, seed: int = SEED) -> DataFrame:
    """``weights`` with ``score``: the weight and a Gumbel draw keyed by seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    return weights.withColumn("score", F.col("weight") + draw)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    share: int = SHARE,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) per row of ``docs``; ``rank`` is null for documents not drawn."""
    gain = gains(bucket_counts(docs, text), bucket_counts(target, target_text))
    # Written once, so that the numbers that tell repeated rows apart stay what they are.
    held = staged(
        scored(weighed(docs, gain, key, text), seed).withColumn("eligible", F.col("n_words") >= min_words).withColumn(
            "turn", F.monotonically_increasing_id()
        ),
        "scored",
    )
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("turn")]
    placed = staged(
        held.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33)),
        "ranged",
    )
    parts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("eligible").alias("fit")).orderBy("part").collect()
    drawn = share * sum(p["fit"] for p in parts) // 100
    before, starts = 0, {}
    for p in parts:  # one row per partition of the range
        starts[p["part"]] = before
        before += p["n"]
    offsets = placed.sparkSession.createDataFrame(list(starts.items()) or [(0, 0)], "part long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), "part").select(
        "id", "n_words", "n_features", "weight", "score", F.when(F.col("eligible") & (rank <= drawn), rank).alias("rank")
    )
