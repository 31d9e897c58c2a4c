"""The training corpus: documents are judged, stripped of repeated lines, thinned to
one of each near-duplicate group, mixed to target weights and encoded.

Each stage reads what its predecessor wrote as Parquet and works on all of it.
All stages but the last keep the columns of ``documents``; the last returns one row
per document and copy of the mix: doc_id, lang, source, n_tokens, ids, and the text
that the ids decode to.

Nulls, empty and very long texts, repeated rows and ids, empty tables and extra
columns follow the cases that each operator names.  Extra columns pass through all
stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import bpe, lines, mixing, quality, simhash
from hushframe.llm.common import staged, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the policy."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of larger id repeats."""
    return lines.drop_repeated(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of texts whose fingerprints link (three-word shingles, two bits)."""
    return simhash.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and the text they decode to."""
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, carry=["lang", "source"])
    return bpe.decode(encoded, RANKS, public_tokenizers.PATTERN, carry=["lang", "source"]).select(
        F.col("id").alias("doc_id"),
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.col("decoded").cast("string").alias("text"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: XXH64 fingerprints and byte-level BPE are beyond DuckDB; a brute-force run is in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
