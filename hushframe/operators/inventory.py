"""Component inventories: listing, denying, reconciling, manifests, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.functions.paths import escapes_root, safe_path
from hushframe.functions.text import skip_detail
from hushframe.operators.classify import skip_bucket


def allowed(components: DataFrame) -> DataFrame:
    """Components of types that may be exported (pushed down to the scan)."""
    return components.where(~F.col("type").isin(*rules.DENIED))


def denied(components: DataFrame) -> DataFrame:
    return components.where(F.col("type").isin(*rules.DENIED))


def excluded_counts(components: DataFrame) -> DataFrame:
    """Denied components per type, and over all types (type NULL)."""
    return denied(components).rollup("type").agg(F.count(F.lit(1)).alias("n"))


def candidate_types(described: DataFrame) -> DataFrame:
    """(described or always probed) minus foldered minus denied."""
    spark = described.sparkSession
    probed = spark.createDataFrame([(t,) for t in rules.ALWAYS_PROBED], "type string")
    return (
        described.select("type")
        .union(probed)
        .distinct()
        .where(~F.col("type").isin(*rules.FOLDERED, *rules.DENIED))
    )


def _open_folder_types() -> dict[str, str]:
    return {inner: folder for inner, folder in rules.FOLDERED.items() if inner not in rules.DENIED}


def folders(listing: DataFrame) -> DataFrame:
    """(type, folder) pairs to read: listed folders and the synthetic ones."""
    inner_of = {folder: inner for inner, folder in _open_folder_types().items()}
    owner = F.create_map(*[F.lit(x) for pair in inner_of.items() for x in pair])
    listed = listing.where(F.col("type").isin(*inner_of) & F.col("error").isNull()).select(
        owner[F.col("type")].alias("type"), F.col("member").alias("folder")
    )
    synthetic = [(t, f) for t, names in rules.SYNTHETIC_FOLDERS.items() if t in inner_of.values() for f in names]
    return listed.union(listing.sparkSession.createDataFrame(synthetic, "type string, folder string")).distinct()


def enumerate_components(described: DataFrame, listing: DataFrame) -> DataFrame:
    """Distinct (type, member) of everything that could be listed.

    ``listing`` has type, folder, member, error; a folder is a component itself.
    One pass over the listing meets the pairs (type, folder) that are wanted, which
    takes the folders' own rows out of it; no job runs while the frame is built.
    """
    folder_types = list(_open_folder_types().values())
    whole = F.lit(None).cast("string")
    probed = listing.sparkSession.createDataFrame([(t,) for t in folder_types], "type string")
    wanted = candidate_types(described).union(probed).distinct().select("type", whole.alias("folder")).union(folders(listing))
    place = F.when(~F.col("type").isin(*folder_types), F.col("folder"))  # where folders lie does not matter
    readable = listing.where(F.col("error").isNull() & F.col("member").isNotNull())
    rows, keys = readable.select("type", "member", place.alias("folder")).alias("rows"), wanted.alias("keys")
    same = (F.col("rows.type") == F.col("keys.type")) & F.col("rows.folder").eqNullSafe(F.col("keys.folder"))
    return rows.join(keys, same, "left_semi").select("type", "member").distinct()


def listing_skips(described: DataFrame, listing: DataFrame) -> DataFrame:
    """One skip row per listing that failed, failed folders included."""
    open_types = _open_folder_types()
    failed = listing.where(F.col("error").isNotNull())
    inner_of = F.create_map(*[F.lit(x) for inner, folder in open_types.items() for x in (folder, inner)])
    known = candidate_types(described).withColumn("_known", F.lit(True))
    tried = F.when(F.col("_known") & F.col("folder").isNull(), F.col("type"))
    foldered = F.when(
        F.col("type").isin(*open_types, *open_types.values()), F.coalesce(inner_of[F.col("type")], F.col("type"))
    )
    reported = F.explode(F.array_compact(F.array(tried, foldered))).alias("type")
    both = failed.join(known, "type", "left").select(reported, "error")
    return both.select(
        "type",
        skip_bucket(F.col("error")).alias("bucket"),
        skip_detail(F.col("error")).alias("detail"),
        F.lit(None).cast("bigint").alias("requested"),
        F.lit(None).cast("bigint").alias("retrieved"),
    )


def distinct_counts(components: DataFrame, name: str) -> DataFrame:
    """Distinct members per type; the distinct step spreads a hot type."""
    return components.select("type", "member").distinct().groupBy("type").agg(F.count(F.lit(1)).alias(name))


def requested_vs_retrieved(requested: DataFrame, retrieved: DataFrame) -> DataFrame:
    counts = distinct_counts(requested, "requested").join(distinct_counts(retrieved, "retrieved"), "type", "left")
    return counts.select("type", "requested", F.coalesce("retrieved", F.lit(0)).cast("bigint").alias("retrieved"))


def partial_retrieves(requested: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Skip rows of types that came back with fewer members than asked for."""
    return requested_vs_retrieved(requested, retrieved).where(F.col("retrieved") < F.col("requested")).select(
        "type",
        F.lit("partial_retrieve").alias("bucket"),
        F.lit("fewer components than requested").alias("detail"),
        "requested",
        "retrieved",
    )


def missing_components(requested: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The members behind a partial retrieve."""
    return requested.select("type", "member").distinct().join(
        retrieved.select("type", "member"), ["type", "member"], "left_anti"
    )


def merged(manifests: DataFrame) -> DataFrame:
    """Union of the members of many manifests."""
    return manifests.select("type", "member").distinct()


def published_types(components: DataFrame) -> DataFrame:
    """Types that have members at all."""
    return components.groupBy("type").agg(F.count("member").alias("members")).where(F.col("members") > 0)


def skip_report(skips: DataFrame) -> DataFrame:
    """The published face of the skip log: no detail column."""
    return skips.select("type", "bucket", "requested", "retrieved")


def skip_lines(skips: DataFrame) -> DataFrame:
    """The internal face: one line with the full detail."""
    partial = F.col("bucket") == "partial_retrieve"
    line = F.concat(
        F.lit("skip "), F.col("type"), F.lit(" ["), F.col("bucket"), F.lit("]"),
        F.when(
            partial,
            F.concat(
                F.lit(" (requested="), F.col("requested").cast("string"),
                F.lit(", retrieved="), F.col("retrieved").cast("string"), F.lit(")"),
            ),
        ).otherwise(""),
        F.when(F.col("detail") != "", F.concat(F.lit(": "), F.col("detail"))).otherwise(""),
    )
    return skips.select("type", "bucket", line.alias("line"))


def bad_buckets(skips: DataFrame) -> DataFrame:
    return skips.where(~F.coalesce("bucket", F.lit("")).isin(*rules.SKIP_BUCKETS))


# ---------------------------------------------------------------- manifests
def xml_text(value: Column) -> Column:
    """Text as XML character data."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(raw), F.lit(entity))
    return value


def manifest_blocks(batch_chunks: DataFrame) -> DataFrame:
    """One ``<types>`` block per chunk (batch, type, members).

    A type larger than a batch has several blocks, which readers merge; no row
    holds more members than one batch.
    """
    lines = F.transform(
        F.col("members"), lambda m: F.concat(F.lit("    <members>"), xml_text(m), F.lit("</members>\n"))
    )
    block = F.concat(
        F.lit("  <types>\n"), F.array_join(lines, ""),
        F.lit("    <name>"), xml_text(F.col("type")), F.lit("</name>\n  </types>"),
    )
    return batch_chunks.where(F.size("members") > 0).select("batch", "type", block.alias("block"))


def manifest_documents(blocks: DataFrame) -> DataFrame:
    """(batch, document): whole documents, types in name order; a batch's ceiling bounds each."""
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<Package xmlns="{rules.MANIFEST_NAMESPACE}">\n'
    tail = f"  <version>{rules.MANIFEST_VERSION}</version>\n</Package>\n"
    in_order = F.array_sort(F.collect_list(F.struct("type", "block")))
    lines = F.transform(in_order, lambda b: F.concat(b["block"], F.lit("\n")))
    return blocks.groupBy("batch").agg(F.concat(F.lit(head), F.array_join(lines, ""), F.lit(tail)).alias("document"))


# ---------------------------------------------------------------- paths
def rename_map(paths: DataFrame, column: str = "path") -> DataFrame:
    """(original, extracted) of paths that change; escaping ones are left out."""
    safe = paths.where(~escapes_root(F.col(column))).select(
        F.regexp_replace(column, "^/+", "").alias("original"), safe_path(F.col(column)).alias("extracted")
    )
    return safe.where(F.col("original") != F.col("extracted"))
