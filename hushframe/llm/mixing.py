"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times.  Within the
source the expected copies are summed up in the order of document size, one
offset drawn from the seed is added, and a document is emitted once per integer
boundary that its share of the sum crosses.  Ordering by size keeps the words
taken within about one large document of the target, whatever the sizes are.

The prefix sum is made in two levels, so that a source with a third of all rows
is never one task: blocks of documents of like size and equal digest prefix are
counted first, the counts are summed up over the blocks of a source, and
documents are numbered within their block only.

Defined cases: a null or blank text has size 0 and takes no words; the null
source is a source of its own, last in order; rows that share an id are separate
documents, and equal rows differ in their place only, which leaves the mix as it is; a source
without words has target 0; an empty table gives an empty mix.  Extra columns
pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import row_key, staged, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No document is emitted more often on average.
MAX_COPIES = 3
SEED = 42

#: Hex digits of the digest that split documents of like size into blocks.
SALT_DIGITS = 2


def _digest(column: str | Column, seed: int) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("null"))).cast("binary"))


def offset_of(source: str | Column, seed: int = SEED) -> Column:
    """The offset of a source in [0, 1), a multiple of 2**-20."""
    return F.conv(F.substring(_digest(source, seed), 1, 5), 16, 10).cast("double") / float(1 << 20)


def targets(sized: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) with one row per source.

    Targets share the total by weight; where a share exceeds ``cap`` sizes of its
    source it stops there, and the excess goes to the others by weight until none
    is above.  That ends at one level L with target = min(L weight, cap size), and
    L follows from sums over the sources in order of cap size / weight.
    """
    sizes = sized.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    zero = F.lit(0).cast("long")
    levels = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), zero))
        / F.sum("weight").over(onward),
    )
    # The first source whose cap is not below its level sets the level of all after it.
    open_ = levels.withColumn("fits", cap * F.col("source_size") >= F.col("level") * F.col("weight"))
    common = open_.withColumn("final", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
        level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ))
    capped = (cap * F.col("source_size")).cast("double")
    return common.select(
        "source",
        "source_size",
        F.least(capped, F.coalesce(F.col("final") * F.col("weight"), capped)).alias("target"),
    )


def size_class(size: str) -> Column:
    """Sizes below 256 as they are, larger ones rounded down to eight leading bits."""
    return F.expr(f"{size} - {size} % shiftleft(1L, greatest(0, length(bin({size})) - 8))")


def copies(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    carry: list[str] | None = None,
    seed: int = SEED,
) -> DataFrame:
    """(doc, size, source_size, target, copies) per row of ``docs``.

    ``doc`` is a struct of the columns to ``carry``, by default the key alone.
    """
    named = F.col(source)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (carry or [key])]).alias("doc"),
        F.col(key).alias("id"),
        row_key(text).alias("row"),
        named.alias("source"),
        F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("source_key"),
        word_count(text).alias("size"),
    ).withColumns({"size_class": size_class("size"), "salt": F.substring(_digest("id", seed), 1, SALT_DIGITS)})
    block = ["source_key", "size_class", "salt"]
    # At most (classes x salts) rows per source, however many documents it has.
    blocks = staged(
        rows.groupBy("source", *block).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-blocks"
    )
    before = Window.partitionBy("source_key").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    shares = targets(blocks, "source", "words").select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("source_key"),
        offset_of("source", seed).alias("offset"),
        "source_size",
        "target",
    )
    within = Window.partitionBy(*block).orderBy("size", F.col("id").asc_nulls_last(), "row")
    placed = (
        rows.repartition(*block)
        .withColumn("place", F.row_number().over(within))
        .join(offsets.join(shares, "source_key"), block)
        .withColumn("place", F.col("before") + F.col("place"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(rate * F.col("place") + F.col("offset")) - F.floor(rate * (F.col("place") - 1) + F.col("offset"))
    return placed.select(
        "doc", "size", "source_size", "target", F.least(crossed, F.ceil(rate)).cast("long").alias("copies")
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it."""
    taken = copies(docs, key, source, text, docs.columns, seed).filter(F.col("copies") > 0)
    repeated = taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return repeated.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
