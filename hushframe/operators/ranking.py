"""Positions and caps that hold when one group has most of the rows.

The keys (group and order columns) are cut into ranges by a sample, and the ranges
of a group are counted.  A row's position is the size of the ranges before its own
plus its place inside it, so no task sorts a whole group.  Which keys are sampled
depends on their hashes alone: a range is the same wherever and whenever it is
computed, so nothing is kept in between and a lost executor renumbers nothing.

Building a frame runs no job.  Nulls come first, as in an ascending sort.  Rows with
equal group and order are placed in any order among themselves and share a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys per range; more make the ranges more even.
_PER_RANGE = 16
_HASHES = 1 << 40
#: Steps of the search for a range, which bounds the number of ranges.
_MAX_STEPS = 20


def _in_ranges(df: DataFrame, columns: list[str], ranges: int) -> DataFrame:
    """Add ``_range``, the number of the range a row's key falls into; it rises with the key."""
    key = F.struct(*[F.col(c) for c in columns])
    wanted = ranges * _PER_RANGE
    share = F.pmod(F.xxhash64(key), F.lit(_HASHES)) / F.lit(float(_HASHES))
    rows = df.agg(F.count(F.lit(1))).scalar()
    sample = df.where(share * rows < F.lit(float(wanted))).agg(F.array_sort(F.collect_set(key)).alias("keys"))
    thinned = F.filter("keys", lambda k, i: i % _PER_RANGE == _PER_RANGE - 1)
    borders = sample.select(thinned).scalar()

    def step(found: Column, width: Column) -> Column:
        border = F.get("_borders", found + width - 1)
        return found + F.when(border.isNotNull() & (border < key), width).otherwise(F.lit(0))

    # twice the ranges asked for: how many keys the sample has is a matter of chance
    steps = min(_MAX_STEPS, (2 * ranges).bit_length())
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return df.withColumn("_borders", borders).withColumn("_range", F.aggregate(widths, F.lit(0), step)).drop("_borders")


def _placed(df: DataFrame, group: list[str], order: list[str], slices: int | None, limit: int | None) -> DataFrame:
    """Rows with their 0-based ``_position``; with a limit, only those below it."""
    ranges = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = _in_ranges(df, [*group, *order], ranges)
    keys = [*group, "_range"]
    pieces = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = pieces.select(*keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    if limit is not None:
        shifts = shifts.where(F.col("_shift") < limit)  # later ranges of a group have none of its first rows
    rows, shifts = spread.alias("rows"), shifts.alias("shifts")
    same = F.lit(True)
    for name in keys:
        same &= F.col(f"rows.`{name}`").eqNullSafe(F.col(f"shifts.`{name}`"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    placed = rows.join(shifts, same).select("rows.*", "_shift").withColumn("_place", place)
    if limit is not None:  # implied by the position, and small enough limits are applied before the shuffle
        placed = placed.where(F.col("_place") <= limit).where(F.col("_shift") + F.col("_place") <= limit)
    return placed.withColumn("_position", F.col("_shift") + F.col("_place") - 1).drop("_range", "_shift", "_place")


def ranked(df: DataFrame, group: list[str], order: list[str], position: str, slices: int | None = None) -> DataFrame:
    """Add the 0-based position of each row inside its group.

    ``slices`` is the number of ranges, by default that of shuffle partitions.
    ``order`` should be unique inside a group.
    """
    return _placed(df, group, order, slices, None).withColumnRenamed("_position", position)


def pages(df: DataFrame, key: str, page_rows: int) -> DataFrame:
    """Page number of every row in key order, ``page_rows`` to a page."""
    placed = ranked(df, [], [key], "_position")
    return placed.withColumn("page", F.floor(F.col("_position") / F.lit(page_rows))).drop("_position")


def next_page(df: DataFrame, key: str, last: object, page_rows: int) -> DataFrame:
    """The page after ``last``: a pushed-down range and a top-n, no full sort."""
    return df.where(F.col(key) > F.lit(last)).orderBy(key).limit(page_rows)


def cap_per_group(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows per group, the first in ``order``.

    The ranges of a group are a histogram of its order: those that begin at or after
    the limit are dropped before their rows are shuffled, and only the range that the
    limit falls into is cut inside.  One way for every limit and every group size.
    """
    return _placed(df, group, order, None, limit).drop("_position")
