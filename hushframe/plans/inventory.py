"""Component inventories: list, deny, batch, reconcile, scrub, publish."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe import rules
from hushframe.operators import inventory as inv
from hushframe.operators.batching import assign_batches, batch_totals, chunks
from hushframe.operators.gates import Stage, require_empty, run_stages
from hushframe.session import cut_lineage
from hushframe.sinks.publish import publish

SENTINEL = "manifest"
SKIPS = "skipped_types"
DOCUMENTS = "packages"


def preview(
    described: DataFrame,
    listing: DataFrame,
    max_members: int = rules.MAX_BATCH_MEMBERS,
    max_weight: int = rules.MAX_BATCH_WEIGHT,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(batch totals, excluded counts, would-be skips); nothing is retrieved."""
    components = inv.enumerate_components(described, listing)
    batches = assign_batches(inv.allowed(components), max_members, max_weight)
    return batch_totals(batches), inv.excluded_counts(components), inv.skip_report(inv.listing_skips(described, listing))


def reconcile(described: DataFrame, listing: DataFrame, retrieved: DataFrame) -> DataFrame:
    """All skip rows of a run: failed listings and partial retrieves."""
    requested = inv.allowed(inv.enumerate_components(described, listing))
    return inv.listing_skips(described, listing).unionByName(inv.partial_retrieves(requested, retrieved))


def export(
    spark: SparkSession,
    target: str,
    retrieved: DataFrame,
    skips: DataFrame,
    contents: DataFrame | None = None,
    stages: Sequence[Stage] = (),
) -> str:
    """Publish the manifest of what came back, as blocks and as one document per batch; any scrub finding stops it."""
    blocks = cut_lineage(inv.manifest_blocks(chunks(assign_batches(inv.allowed(retrieved)))))
    require_empty(inv.bad_buckets(skips), "unknown skip bucket")
    if contents is not None and stages:
        require_empty(run_stages(contents, stages), "scrub findings")
    artefacts = {SENTINEL: blocks, SKIPS: inv.skip_report(skips), DOCUMENTS: inv.manifest_documents(blocks)}
    return publish(spark, target, artefacts, SENTINEL, preceding=(SKIPS,))


def manifest_of(blocks: DataFrame, batch: int) -> str:
    """Document of one batch."""
    return inv.manifest_documents(blocks.where(F.col("batch") == batch)).first()["document"]
