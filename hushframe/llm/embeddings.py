"""Embedding near-dedup: sign hashing in several tables, exact cosines, components.

Equal vectors are one class, found by a 128-bit hash with a partial count, so copies
are never compared with each other.  One vector per class is scaled to length one
and rounded to 16-bit integers.  Signs of random hyperplanes, taken of the
integers in exact arithmetic, give its bucket in each table.  The classes of a bucket
are compared there.  The rounding error has a bound: what lies above 0.9 by
more than it is a link, what lies below it by more is none, and the few pairs between
are looked up and compared in double precision.

A pair that meets in several tables counts in the first of them, so the links of a
vector are sums, and no list of pairs is made: a bucket returns the number of links per
class and one link per class that joins its set.  Buckets over ``CAPACITY`` rows are cut
into chunks, and pairs of chunks are compared in tasks of their own.

The number of hyperplanes grows with the logarithm of the classes, and the number of
tables follows from it, so that a pair at the threshold is found with probability
``RECALL`` at any size; closer pairs are found more often (at 0.95, over 0.999).

Defined cases: a vector that is null, empty, zero or holds null or non-finite components
links with nothing, and so does a row without an id; vectors of different lengths
do not link; rows that share an id are separate vectors; an empty table gives an empty
result.  Only the id and the vector are read; extra columns do not appear.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import staged
from hushframe.llm.graph import components
from hushframe.llm.simhash import unite
from hushframe.session import broadcast_if_small

THRESHOLD = 0.9
#: Chance that a pair exactly at the threshold shares a bucket.
RECALL = 0.97
#: Rows of a bucket compared in one task; longer buckets are cut into chunks.
CAPACITY = 4096
#: Rows a bucket holds on average at most, and hyperplanes per table at least.
LOAD = 2048
MIN_PLANES = 5
SEED = 42

#: Rows of a block compared at once.
BLOCK = 512
_SCALE = 32767


def layout(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(tables, hyperplanes per table) for so many classes."""
    planes = min(60, max(MIN_PLANES, ceil(log2(max(1, classes) / LOAD))))
    met = (1 - acos(threshold) / pi) ** planes
    return ceil(log(1 - recall) / log(1 - met)), planes


@lru_cache(maxsize=16)
def hyperplanes(size: int, n: int) -> np.ndarray:
    """``n`` random normals as whole numbers, so that sums of products are exact in any order."""
    drawn = np.random.default_rng([SEED, size]).standard_normal((n, size))
    return np.rint(drawn * 256).T


def codes(q: np.ndarray, tables: int, planes: int) -> np.ndarray:
    """The bucket of each row of 16-bit vectors in each table."""
    signs = q.astype(np.float64) @ hyperplanes(q.shape[1], tables * planes) >= 0
    powers = np.int64(1) << np.arange(planes, dtype=np.int64)
    return signs.reshape(len(q), tables, planes) @ powers


def rounded(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in 1/32767."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return np.rint(scaled / np.linalg.norm(scaled, axis=1, keepdims=True) * _SCALE).astype(np.int16)


def doubt(size: int) -> float:
    """How far the cosine of two rounded vectors can be from that of the vectors."""
    error = sqrt(size) / (2 * _SCALE)
    return 2 * error + error * error + size * 2.0**-22


def usable(vector: str | Column) -> Column:
    """Whether a vector can link; null vectors count as False."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(a: str, b: str) -> Column:
    """Of two arrays of doubles, each scaled by its largest component against overflow."""

    def scaled(name: str) -> Column:
        most = F.array_max(F.transform(F.col(name), F.abs))
        return F.transform(F.col(name), lambda x: x / most)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = scaled(a), scaled(b)
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) per length of the vectors."""
    lengths = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), dtype=np.float64)
    starts = np.cumsum(lengths) - lengths
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def _buckets(classes: DataFrame, tables: int, planes: int, whole: bool) -> DataFrame:
    """(size, t, code) per class and table, and (id, n, q) if ``whole``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _matrix(batch.column("v")):
                q = rounded(vectors)
                size = q.shape[1]
                found = codes(q, tables, planes)
                packed = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(2 * size), len(q), [None, pa.py_buffer(np.ascontiguousarray(q))]
                ).cast(pa.binary())
                for t in range(tables):
                    head = [
                        pa.array(np.full(len(q), size, np.int32)),
                        pa.array(np.full(len(q), t, np.int32)),
                        pa.array(found[:, t]),
                    ]
                    more = [batch.column("id").take(pa.array(rows)), batch.column("n").take(pa.array(rows)), packed]
                    names = ["size", "t", "code", "id", "n", "q"]
                    yield pa.RecordBatch.from_arrays(head + more, names) if whole else pa.RecordBatch.from_arrays(head, names[:3])

    kinds = "size int, t int, code bigint"
    return classes.mapInArrow(run, kinds + ", id bigint, n bigint, q binary" if whole else kinds)


#: Kinds of rows that a bucket returns.
_COUNT, _LINK, _CLOSE = 0, 1, 2


def _compared(threshold: float, tables: int, planes: int):
    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        size, t = group.column("size")[0].as_py(), group.column("t")[0].as_py()
        crossing = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        ids, n, own = (np.asarray(group.column(c).combine_chunks()) for c in ("id", "n", "own"))
        flat = b"".join(group.column("q").to_pylist())
        q = np.frombuffer(flat, np.int16).reshape(len(ids), size)
        before = codes(q, tables, planes)[:, :t]
        unit = q.astype(np.float32) / np.float32(_SCALE)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        band = doubt(size)
        if crossing:
            left, right = np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())
        else:
            left = right = np.arange(len(ids))
        links, parent, close = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        for at in range(0, len(left), BLOCK):
            a = left[at : at + BLOCK]
            b = right if crossing else right[at:]
            near = unit[a] @ unit[b].T
            i, j = np.nonzero(near >= threshold - band)
            sure = near[i, j] >= threshold + band
            i, j = a[i], b[j]
            first = i != j if crossing else i < j
            for k in range(t):
                first &= before[i, k] != before[j, k]
            certain = first & sure
            np.add.at(links, i[certain], n[j[certain]])
            np.add.at(links, j[certain], n[i[certain]])
            parent = unite(parent, i[certain], j[certain])
            unsure = first & ~sure
            close.append((ids[i[unsure]], ids[j[unsure]]))
        some, moved = links > 0, parent != np.arange(len(ids))
        close_a, close_b = (np.concatenate(x) for x in zip(*close))
        parts = [
            (_COUNT, ids[some], ids[some], links[some]),
            (_LINK, ids[moved], ids[parent[moved]], np.zeros(moved.sum(), np.int64)),
            (_CLOSE, close_a, close_b, np.zeros(len(close_a), np.int64)),
        ]
        return pa.table(
            {
                "kind": np.concatenate([np.full(len(a), k, np.int32) for k, a, _, _ in parts]),
                **{c: np.concatenate([p[1 + k] for p in parts]) for k, c in enumerate(("a", "b", "links"))},
            }
        )

    return meet


def linked(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component) per row of ``vectors``."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn(
        "ok", F.col("id").isNotNull() & usable("v")
    )
    name = (F.when(F.col("ok"), F.xxhash64("v")).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")).alias("h2"))
    kind = vectors.schema[vector].dataType.simpleString()
    exact = kind if kind == "array<float>" else "array<double>"
    classes = staged(
        rows.filter("ok")
        .select("id", *name, F.col("v").cast(exact).alias("v"))
        .groupBy("h1", "h2")
        .agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
        .select("h1", "h2", F.col("least").alias("id"), "n", "v"),
        "vector-classes",
    )
    # Rows of unequal vectors may share an id, so classes need not have a number of
    # their own by it; the first hash is one, and the least id is brought in at the end.
    points = classes.select(F.col("h1").alias("id"), "n", "v")
    tables, planes = layout(classes.count(), threshold)
    key_of = ["size", "t", "code"]
    full = _buckets(points, tables, planes, False).groupBy(*key_of).count().filter(F.col("count") > CAPACITY)
    cut = broadcast_if_small(
        staged(full.select(*key_of, F.ceil(F.col("count") / CAPACITY).cast("int").alias("chunks")), "vector-buckets")
    )
    dealt = (
        _buckets(points, tables, planes, True)
        .join(cut, key_of, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*key_of, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "n", "q")
    )
    met = staged(
        dealt.groupBy(*key_of, "i", "j").applyInArrow(
            _compared(threshold, tables, planes), "kind int, a bigint, b bigint, links bigint"
        ),
        "vector-links",
    )
    sides = [
        points.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("v").cast("array<double>").alias(f"v_{s}"))
        for s in "ab"
    ]
    pairs = met.filter(F.col("kind") == _CLOSE).select("a", "b")
    close = staged(
        pairs.join(sides[0], "a").join(sides[1], "b").filter(cosine("v_a", "v_b") >= threshold).select("a", "b", "n_a", "n_b"),
        "vector-pairs",
    )
    counted = (
        met.filter(F.col("kind") == _COUNT)
        .select("a", "links")
        .unionByName(close.select("a", F.col("n_b").alias("links")))
        .unionByName(close.select(F.col("b").alias("a"), F.col("n_a").alias("links")))
        .groupBy(F.col("a").alias("h1"))
        .agg(F.sum("links").alias("links"))
    )
    joined = components(met.filter(F.col("kind") == _LINK).select("a", "b").unionByName(close.select("a", "b")))
    rooted = (
        classes.select("h1", "h2", "id", "n")
        .join(joined.select(F.col("node").alias("h1"), "root"), "h1", "left")
        .withColumn("root", F.coalesce("root", "h1"))
    )
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    told = (
        rooted.join(least, "root")
        .join(counted, "h1", "left")
        .select("h1", "h2", (F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1).alias("n_links"), "component")
    )
    return rows.select("id", *name).join(told, ["h1", "h2"], "left").select(
        "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "id").alias("component")
    )
