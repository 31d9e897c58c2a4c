"""Line dedup: repeated lines leave every document but the last that holds them.

Line hashes are written once, then range-partitioned with the document and the
position as secondary sort, so that a line found in a third of all documents is
spread over as many partitions as its rows need.  Each partition streams its sorted
rows and takes the first occurrence of a line in a document; these are counted per
line after a partial count.  What goes back to a document is a bitmap of the lines
it keeps, not text.

Defined cases: a null or empty text is one empty line; lines whose key is shorter
than ``min_chars`` always stay; a null id ranks below every other id; rows that
share an id count as one document and all keep, or all lose, a line; an empty table gives an
empty result.  Only the id and text are read; extra columns pass through
``drop_repeated`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushframe.llm.common import BLANKS, LOWER, UPPER, row_key, staged, text_of

MIN_CHARS = 20
MIN_DOCS = 3

#: Lines a bitmap word covers.
BITS = 64


def split_lines(text: str | Column) -> Column:
    return F.split(text_of(text), "\n")


def line_key(line: Column) -> Column:
    """The line without blanks at either end, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def keep_bitmaps(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(id, row, keep_words, n_dropped) for each row of ``docs`` that loses lines.

    ``row`` is ``row_key`` of the text.  Bit ``k`` of ``keep_words[j]`` tells
    whether line ``64 j + k`` stays; words after the last loss are left out, and
    documents without a loss have no row, so the result is as small as the losses.
    """
    lines = (
        docs.select(F.col(key).alias("id"), row_key(text).alias("row"), F.posexplode(split_lines(text)).alias("pos", "line"))
        .select("id", "row", "pos", line_key(F.col("line")).alias("line"))
        .filter(F.length("line") >= min_chars)
        # 128 bits, so that equal hashes can be taken for equal lines at any size
        .select(
            F.xxhash64("line").alias("h1"), F.xxhash64(F.concat(F.lit("#"), F.col("line"))).alias("h2"), "id", "row", "pos"
        )
    )
    # Written once: the range sample, the counts and the losses all read it.
    lines = staged(lines, "lines")
    order = [F.col(c) for c in ("h1", "h2", "id", "row", "pos")]
    ranged = lines.repartitionByRange(*order[:3]).sortWithinPartitions(*order)
    # A line of one document lies in one partition, so its first occurrence is the first row of its run in the sorted stream.
    run = Window.partitionBy("h1", "h2", "id").orderBy("row", "pos")
    firsts = ranged.withColumn("nth", F.row_number().over(run)).filter(F.col("nth") == 1)
    repeated = (
        firsts.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
        .filter(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # Read back, so that the join sees a table of its own and can split a line that a third of all rows hold.
    repeated = staged(repeated, "repeated-lines")
    lost = (
        lines.join(repeated, ["h1", "h2"])
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .select("id", "row", F.floor(F.col("pos") / BITS).cast("int").alias("word"), (F.col("pos") % BITS).alias("bit"))
        .distinct()  # a row that occurs twice names its lines twice
    )
    words = lost.repartition("id", "row").groupBy("id", "row", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("lost"), F.count(F.lit(1)).alias("n")
    )
    per_row = words.groupBy("id", "row").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "lost"))).alias("lost"),
        F.max("word").alias("last"),
        F.sum("n").alias("n_dropped"),
    )
    keep = F.transform(
        F.sequence(F.lit(0), F.col("last")),
        lambda j: F.bitwise_not(F.coalesce(F.try_element_at("lost", j), F.lit(0).cast("long"))),
    )
    return per_row.select("id", "row", keep.alias("keep_words"), "n_dropped")


def kept_lines(lines: Column, keep_words: Column) -> Column:
    """The lines that a bitmap keeps."""

    def stays(_: Column, pos: Column) -> Column:
        word = F.coalesce(F.get(keep_words, F.floor(pos / BITS).cast("int")), F.lit(-1).cast("long"))
        return F.getbit(word, pos % BITS) == 1

    return F.filter(lines, stays)


def with_kept_text(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` joined to its bitmaps: struct ``row`` as given, ``kept_text``, ``n_dropped``."""
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col(key).alias("_id"),
        row_key(text).alias("_row"),
    )
    both = held.join(bitmaps, held["_id"].eqNullSafe(bitmaps["id"]) & held["_row"].eqNullSafe(bitmaps["row"]), "left")
    whole = text_of(F.col("doc").getField(text))
    kept = F.array_join(kept_lines(F.split(whole, "\n"), F.col("keep_words")), "\n")
    return both.select(
        "doc",
        F.when(F.col("n_dropped").isNull(), whole).otherwise(kept).alias("kept_text"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
    )


def drop_repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with the texts that are left, in their own columns; a null text stays null.

    ``n_chars`` names a column with the text's length to bring up to date, if there is one.
    """
    joined = with_kept_text(docs, keep_bitmaps(docs, key, text), key, text)
    changed = F.col("n_dropped") > 0
    columns = []
    for c in docs.columns:
        value = F.col("doc").getField(c)
        if c == text:
            value = F.when(changed, F.col("kept_text")).otherwise(value)
        elif c == n_chars:
            value = F.when(changed, F.length("kept_text").cast(docs.schema[c].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return joined.select(*columns)
