"""SimHash near-dedup: fingerprints in vantage-point trees.

A fingerprint takes the majority of its shingles' 64-bit hashes in each bit.
Equal fingerprints are one point.  A vantage-point tree, fitted on a bounded
sample of the points, sends each point to one home shard by its Hamming distances
to the vantage points.  A point near a boundary also visits the shards beyond
it that can hold a point within the radius; the triangle bound rules out the
rest, so no pair within the radius is lost and none is made up.  Within a shard
the same search goes on in memory.  A shard reports the components it sees, not
pairs, so a group of thousands of copies yields one row per member.

Defined cases: null, empty and blank texts have fingerprint 0, which links like
any other; texts with fewer words than a shingle are one shingle; rows that share
an id are separate rows; a null id never is the smallest unless all are null; an
empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import row_key, staged, text_of, thinned
from hushframe.llm.graph import components

SEED = 42
SHINGLE = 3
RADIUS = 2

#: Points the tree is fitted on at most; every point is searched.
SAMPLE = 1 << 17
#: Points a shard is to hold as home, while the sample allows that many shards.
SHARD = 4096
#: Sample points a leaf of the tree keeps at least.
LEAF_SAMPLE = 8
#: Home points that are compared with all others of their branch at once.
BRUTE = 512

_SHIFTS = (np.arange(64, dtype=np.uint64))
#: Bits of each byte value, least first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def shingles(text: bytes, words: int = SHINGLE) -> list[bytes]:
    """Word shingles in order, repeats included; the whole text if it is shorter.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` parts at space and
    U+0009..U+000D alone.
    """
    found = text.lower().split()
    if len(found) <= words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[k:] for k in range(words)))))


def fingerprint(text: bytes, words: int = SHINGLE, seed: int = SEED) -> int:
    parts = shingles(text, words)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, seed) for p in parts), dtype="<u8", count=len(parts))
    octets = hashes.view(np.uint8).reshape(-1, 8) + _PLACES
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * counts.ravel() > len(parts)).astype(np.uint64)
    return int((bits << _SHIFTS).sum())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE) -> DataFrame:
    """(id, row, fp) per row of ``docs``; ``fp`` has the bits of the fingerprint as a signed long."""
    rows = docs.select(F.col(key).alias("id"), row_key(text).alias("row"), text_of(text).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(t.as_py(), words) for t in batch.column("text")), dtype=np.uint64, count=batch.num_rows
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(found.view(np.int64))], ["id", "row", "fp"]
            )

    return rows.mapInArrow(run, f"id {kind}, row bigint, fp bigint")


def distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def _cut(distances: np.ndarray) -> int:
    """The largest distance on the near side: the median, or less where that parts nothing."""
    median, far = int(np.median(distances)), int(distances.max())
    return min(median, far - 1)


class Tree:
    """A vantage-point tree over fingerprints; leaves are numbered shards.

    ``nodes`` holds (vantage, cut, near, far); a negative child is the leaf -child - 1.
    """

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple[np.uint64, int, int, int]] = []
        self.leaves = 0
        self.top = self._grow(np.unique(sample), shards)

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, points: np.ndarray, shards: int) -> int:
        if shards < 2 or len(points) < 2 * LEAF_SAMPLE:
            return self._leaf()
        vantage = points[len(points) // 2]
        away = distance(points, vantage)
        cut = _cut(away)
        near = away <= cut
        if cut < 0 or not near.any():
            return self._leaf()
        place = len(self.nodes)
        self.nodes.append((vantage, cut, 0, 0))
        children = self._grow(points[near], shards // 2), self._grow(points[~near], shards - shards // 2)
        self.nodes[place] = (vantage, cut, *children)
        return place

    def route(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(shard, indices of points, whether it is their home).

        Of two close points that part at a node, the near one visits the far side.
        """
        todo = [(self.top, np.arange(len(points)), True)]
        while todo:
            node, rows, home = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows, home
                continue
            vantage, cut, near, far = self.nodes[node]
            away = distance(points[rows], vantage)
            if home:
                todo.append((near, rows[away <= cut], True))
                todo.append((far, rows[away > cut], True))
                todo.append((far, rows[(away <= cut) & (away + radius > cut)], False))
            else:
                todo.append((near, rows[away - radius <= cut], False))
                todo.append((far, rows[away + radius > cut], False))


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` with the sets of a[i] and b[i] joined; every entry points at its set's least index."""
    while len(a):
        one, other = parent[a], parent[b]
        apart = one != other
        if not apart.any():
            break
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(parent, np.maximum(one, other), np.minimum(one, other))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def search(points: np.ndarray, home: np.ndarray, visitors: np.ndarray, radius: int) -> np.ndarray:
    """Least index of each point's set after linking every home point to all points within the radius."""
    parent = np.arange(len(points))
    todo = [(home, visitors)]
    while todo:
        here, guests = todo.pop()
        if not len(here):
            continue
        away = distance(points[here], points[here[len(here) // 2]])
        cut = _cut(away)
        near = away <= cut
        if len(here) <= BRUTE or max(near.mean(), 1 - near.mean()) > 0.9:
            both = np.concatenate([here, guests])
            for k in range(0, len(here), BRUTE):
                block = here[k : k + BRUTE]
                for j in range(k, len(both), 4 * BRUTE):
                    other = both[j : j + 4 * BRUTE]
                    i, o = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[other][None, :]) <= radius)
                    parent = unite(parent, block[i], other[o])
            continue
        vantage = points[here[len(here) // 2]]
        guest_away = distance(points[guests], vantage)
        todo.append((here[near], guests[guest_away - radius <= cut]))
        todo.append(
            (here[~near], np.concatenate([guests[guest_away + radius > cut], here[near & (away + radius > cut)]]))
        )
    return parent


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that join exactly the points of a component.

    ``points`` has one column ``fp`` without repeats.  Pairs at ``radius`` or fewer
    differing bits are all found; each shard returns one row per point that is not
    the first of its set.
    """
    n = points.count()
    some = thinned(points, 1.1 * SAMPLE / max(1, n), "fp")
    sample = some.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = Tree(sample, -(-n // SHARD))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp")).view(np.uint64)
            for shard, rows, home in tree.route(fps, radius):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), shard, np.int32)),
                        pa.array(fps[rows].view(np.int64)),
                        pa.array(np.full(len(rows), home)),
                    ],
                    ["shard", "fp", "home"],
                )

    def joined(table: pa.Table) -> pa.Table:
        fps = np.asarray(table.column("fp").combine_chunks()).view(np.uint64)
        at_home = np.asarray(table.column("home").combine_chunks().cast(pa.uint8())).astype(bool)
        order = np.arange(len(fps))
        parent = search(fps, order[at_home], order[~at_home], radius)
        moved = parent != order
        return pa.table({"a": fps[moved].view(np.int64), "b": fps[parent[moved]].view(np.int64)})

    routed = points.select("fp").mapInArrow(route, "shard int, fp bigint, home boolean")
    return routed.groupBy("shard").applyInArrow(joined, "a bigint, b bigint")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (id, row, fp) with ``component``: the least id that links reach."""
    points = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "points")
    roots = components(links(points.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return prints.join(rooted.join(least, "root").select("fp", "component"), "fp")


def components_of(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, row, fp, component) per row of ``docs``."""
    return classes(staged(fingerprints(docs, key, text, words), "fingerprints"), radius)


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs`` per group: that of the least id, and of rows that share it any one.

    Rows of one id and text are one row before the join, so a row that is repeated
    without end is reduced on the map side; the join uses the same partitioning.
    """
    return least_of(docs, components_of(docs, key, text, words, radius), key, text)


def least_of(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``docs`` that are first in their component by ``found`` (id, row, component)."""
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"))
    chosen = first.select(F.col("least.none").alias("_none"), F.coalesce("least.id", _zero(docs, key)).alias("_id"), F.col("least.row").alias("_row"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"),
        F.col(key).isNull().alias("_none"),
        F.coalesce(F.col(key), _zero(docs, key)).alias("_id"),
        row_key(text).alias("_row"),
    )
    single = keyed.dropDuplicates(["_none", "_id", "_row"])
    kept = single.join(chosen, ["_none", "_id", "_row"], "left_semi")
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


def _zero(docs: DataFrame, key: str) -> Column:
    return F.lit(0).cast(docs.schema[key].dataType)


def hex_of(fp: str | Column) -> Column:
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
