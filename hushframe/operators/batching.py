"""Cutting an inventory into batches under a count and a weight ceiling.

A member opens a new batch exactly when the current one has reached a ceiling, so a
batch ends at a place that follows from the place it begins at.  The members, in
name order, are cut into blocks of places.  What a block does is a map: from each
place at which the batch open at its border may have begun to the same for its
other border, and how many batches it opens.  Blocks are mapped side by side, the
maps are composed, and each block then tells its types their batches.

A type only enters a block as its first place, length and weight, and a member's
batch follows from its place by arithmetic.  Nothing bounds the number of types.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators.classify import type_weight
from hushframe.operators.ranking import ranked
from hushframe.session import cut_lineage

#: A block has at least this many times the places that a batch can have, so maps stay smaller than the table.
_BATCHES_PER_BLOCK = 16
_MAP = "block bigint, width bigint, begins array<bigint>, opened array<bigint>"
_FIRST = "type string, first bigint, weight bigint, batch bigint, head bigint, size bigint"


class _Runs(NamedTuple):
    """The types of one block and of the places a batch may have begun at before it."""

    first: np.ndarray
    end: np.ndarray
    weight: np.ndarray
    load: np.ndarray  # weight before each run, counted from the first
    max_members: int
    max_weight: int

    @classmethod
    def of(cls, rows: pd.DataFrame, max_members: int, max_weight: int) -> _Runs:
        rows = rows.sort_values("first")
        first, n, weight = (rows[c].to_numpy(np.int64) for c in ("first", "n", "weight"))
        return cls(first, first + n, weight, np.cumsum(n * weight) - n * weight, max_members, max_weight)

    def run(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def loaded(self, place: np.ndarray) -> np.ndarray:
        at = self.run(place)
        return self.load[at] + (place - self.first[at]) * self.weight[at]

    def size(self, at: np.ndarray) -> np.ndarray:
        """Members of a batch that lies in one run."""
        return np.minimum(self.max_members, -(-self.max_weight // self.weight[at]))

    def following(self, begin: np.ndarray) -> np.ndarray:
        """Where the batch after the one that begins here begins."""
        wanted = self.loaded(begin) + self.max_weight
        at = np.searchsorted(self.load, wanted, "left") - 1
        heavy = self.first[at] + -(-(wanted - self.load[at]) // self.weight[at])
        return np.minimum(begin + self.max_members, heavy)

    def advance(self, begin: np.ndarray, border: int) -> tuple[np.ndarray, np.ndarray]:
        """The last batch that begins at or before ``border``, and how many were opened on the way."""
        begin, opened = begin.copy(), np.zeros_like(begin)
        border = min(border, int(self.end[-1]))  # beyond the last member nothing begins
        while True:
            at = self.run(begin)
            size = self.size(at)
            inside = (np.minimum(self.end[at], border) - begin) // size
            begin, opened = begin + inside * size, opened + inside
            after = self.following(begin)
            moves = after <= border
            if not moves.any():
                return begin, opened
            begin, opened = np.where(moves, after, begin), opened + moves


def _block_map(max_members: int, max_weight: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per place back from a block's border: places back from its other border, and batches opened."""

    def mapped(rows: pd.DataFrame) -> pd.DataFrame:
        block, width = int(rows["block"].iloc[0]), int(rows["width"].iloc[0])
        border, last = block * width, (block + 1) * width
        runs = _Runs.of(rows, max_members, max_weight)
        begins = border - np.arange(min(border + 1, max_members), dtype=np.int64)
        ends, opened = runs.advance(begins, last)
        return pd.DataFrame({"block": [block], "width": [width], "begins": [last - ends], "opened": [opened]})

    return mapped


def _first_batches(max_members: int, max_weight: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Per type that begins in the block: its first batch, how many fit there, the size of later ones."""

    def placed(rows: pd.DataFrame) -> pd.DataFrame:
        block, width = int(rows["block"].iloc[0]), int(rows["width"].iloc[0])
        begin = np.array([block * width - int(rows["back"].iloc[0])], np.int64)
        batch = int(rows["batch"].iloc[0])
        runs = _Runs.of(rows, max_members, max_weight)
        own = rows[rows["first"] >= block * width].sort_values("first")
        found = own[["type", "first", "weight"]].copy()
        batches, heads = [], []
        for first, weight in zip(own["first"], own["weight"], strict=True):
            begin, opened = runs.advance(begin, int(first))
            batch += int(opened[0])
            left = max_weight - int(runs.loaded(np.array([first]))[0] - runs.loaded(begin)[0])
            batches.append(batch)
            heads.append(min(max_members - int(first - begin[0]), -(-left // int(weight))))
        found["batch"], found["head"] = batches, heads
        found["size"] = runs.size(runs.run(own["first"].to_numpy(np.int64)))
        return found

    return placed


def _entries(maps: DataFrame) -> DataFrame:
    """Batch open at each block's border, and how far back it began.

    The maps meet in one row: as many as blocks, together smaller than the table by
    the places of a block for each one of a map.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    at = "struct<block:bigint,back:bigint,batch:bigint>"
    start = F.struct(zero.alias("back"), one.alias("batch"), F.array().cast(f"array<{at}>").alias("found"))

    def step(state: Column, row: Column) -> Column:
        entry = F.struct(row["block"].alias("block"), state["back"].alias("back"), state["batch"].alias("batch"))
        return F.struct(
            F.get(row["begins"], state["back"]).alias("back"),
            (state["batch"] + F.get(row["opened"], state["back"])).alias("batch"),
            F.concat(state["found"], F.array(entry)).alias("found"),
        )

    in_order = F.array_sort(F.collect_list(F.struct("block", "begins", "opened")))
    folded = maps.agg(F.aggregate(in_order, start, step, lambda s: s["found"]).alias("found"))
    return folded.select(F.explode("found").alias("e")).select("e.*")


def entry_states(totals: DataFrame, max_members: int, max_weight: int) -> DataFrame:
    """Per type: first place, weight, first batch, how many members still fit there, size of later ones.

    ``totals`` has one row per type (type, first, n, weight); ``first`` is the place of
    its first member among all members in name order.
    """
    members = totals.agg(F.sum("n")).scalar()
    pieces = int(totals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = F.lit(_BATCHES_PER_BLOCK * max_members).cast("bigint")
    width = F.greatest(F.ceil(members / pieces), least)
    last_block = F.floor((members - 1) / width)
    # a type also enters the block of every place at which a batch that it is part of can be open
    reach = F.least(last_block, F.floor((F.col("first") + F.col("n") - 1 + max_members) / F.col("width")))
    spread = totals.withColumn("width", width).withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("first") / F.col("width")), reach))
    )
    blocks = spread.groupBy("block")
    entries = _entries(blocks.applyInPandas(_block_map(max_members, max_weight), _MAP))
    known = spread.join(entries, "block")
    return known.groupBy("block").applyInPandas(_first_batches(max_members, max_weight), _FIRST)


def assign_batches(
    components: DataFrame,
    max_members: int = rules.MAX_BATCH_MEMBERS,
    max_weight: int = rules.MAX_BATCH_WEIGHT,
) -> DataFrame:
    """Distinct (type, member) with batch number, from 1, and weight; rows without a type are left out."""
    if max_members <= 0 or max_weight <= 0:
        raise ValueError("both ceilings must be positive")
    distinct = components.select("type", "member").where(F.col("type").isNotNull()).distinct()
    placed = ranked(distinct, [], ["type", "member"], "place")
    totals = placed.groupBy("type").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    totals = cut_lineage(totals.withColumn("weight", type_weight(F.col("type")).cast("bigint")))
    index = F.col("place") - F.col("first")
    later = F.col("batch") + 1 + F.floor((index - F.col("head")) / F.col("size"))
    return placed.join(entry_states(totals, max_members, max_weight), "type").select(
        F.when(index < F.col("head"), F.col("batch")).otherwise(later).alias("batch"),
        "type",
        "member",
        "weight",
    )


def chunks(batches: DataFrame) -> DataFrame:
    """(batch, type, members); a batch's ceiling bounds each list."""
    return batches.groupBy("batch", "type").agg(F.array_sort(F.collect_list("member")).alias("members"))


def batch_totals(batches: DataFrame) -> DataFrame:
    """Members and weight per batch and type, per batch, and over all."""
    return batches.rollup("batch", "type").agg(
        F.count(F.lit(1)).alias("members"), F.sum("weight").alias("weight")
    )
