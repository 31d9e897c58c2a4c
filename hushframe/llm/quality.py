"""Quality rules as a bitmask ledger: measured once, judged by versioned policies.

``ledger`` reads each text once and stores one row per document with the
measurements and one failure bit per rule.  A policy is a mask over these bits,
so a new policy or an ablation never reads a text again.  Everything is a
DataFrame expression within the row: no shuffle, and no Python on the executors.

Nulls and empty texts have no words and fail ``too_few_words``.  Rows are judged
one by one, so repeated rows and ids get equal verdicts, and an empty table gives
an empty ledger.  Only the id and the text column are read; extra columns, also
ones named like a measurement, neither disturb nor appear.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import BLANKS, UPPER, text_of, words_of

#: Words in a window whose second occurrence counts as repetition.
WINDOW = 8
SYMBOLS = "#*$%&|<>"

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")



def _rules() -> dict[str, Column]:
    c = F.col
    return {
        "too_few_words": c("n_words") < 20,
        "repeated_windows": 100 * c("n_repeat_words") > 30 * c("n_words"),
        "symbol_share": 100 * c("n_symbols") > 10 * c("n_words"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 15 * c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "shouting": 100 * c("n_upper") > 40 * c("word_chars"),
    }


RULE_NAMES = (
    "too_few_words",
    "repeated_windows",
    "symbol_share",
    "short_words",
    "long_words",
    "duplicate_lines",
    "shouting",
)

#: Version to the rules it rejects by.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": RULE_NAMES[:2],
    "v1": RULE_NAMES,
}


def mask_of(policy: str) -> int:
    return sum(1 << RULE_NAMES.index(name) for name in POLICIES[policy])


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _measured(rows: DataFrame) -> DataFrame:
    """Adds MEASUREMENTS to rows of (id, _text).

    The steps are separate projections so that each array is built once.
    """
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, BLANKS)) > 0)
    first = rows.withColumns({"_words": words_of(text), "_lines": lines})
    counted = first.select(
        "_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(_without(text, BLANKS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length(text) - F.length(_without(text, UPPER))).cast("long").alias("n_upper"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_codes"),
        F.col("_words"),
    )
    none = F.array().cast("array<bigint>")
    windows = F.when(
        F.col("n_words") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1))),
            lambda i: F.xxhash64(F.slice("_codes", i, WINDOW)),
        ),
    ).otherwise(none)
    hashed = counted.withColumn("_hashes", windows).drop("_codes")
    # Only texts with an equal pair of hashes are sorted, by hash and position.
    pairs = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ordered = hashed.withColumn(
        "_pairs", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs)
    ).drop("_hashes")

    def words_at(pair: Column) -> Column:
        return F.slice("_words", pair["i"] + 1, WINDOW)

    def same(one: Column, other: Column) -> Column:
        """Equal hashes are believed only if the words agree."""
        return F.when(one["h"] == other["h"], words_at(one) == words_at(other)).otherwise(F.lit(False))

    def repeated(pair: Column, k: Column) -> Column:
        before, after = F.get("_pairs", k - 1), F.get("_pairs", k + 1)
        return F.coalesce(same(before, pair), F.lit(False)) | F.coalesce(same(after, pair), F.lit(False))

    starts = ordered.withColumn(
        "_starts", F.sort_array(F.transform(F.filter("_pairs", repeated), lambda pair: pair["i"]))
    ).drop("_pairs", "_words")
    covered = F.aggregate(
        F.transform("_starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, step: total + step,
    )
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_starts")


def _with_bits(measured: DataFrame) -> DataFrame:
    rules = _rules()
    bits = [F.when(rules[name], F.lit(1 << k)).otherwise(F.lit(0)) for k, name in enumerate(RULE_NAMES)]
    return measured.withColumn("failed_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, MEASUREMENTS and ``failed_bits``."""
    rows = docs.select(F.col(key).alias("_id"), text_of(text).alias("_text"))
    return _with_bits(_measured(rows)).select(F.col("_id").alias(key), *MEASUREMENTS, "failed_bits")


def failed(policy: str) -> Column:
    """True where a ledger row fails a rule of the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy))) != 0


def keep_good(docs: DataFrame, policy: str = "v1", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with their own columns only.

    The row travels as one struct beside its measurements, so extra columns
    cannot clash with them, and no join brings text and verdict together.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_id"), text_of(text).alias("_text"))
    # The generator keeps the filter above it: pushed down, the optimizer would copy
    # every measurement into the filter once per use.
    judged = _with_bits(_measured(rows)).select("_id", F.explode_outer(F.array("failed_bits")).alias("failed_bits"))
    kept = judged.filter(~failed(policy))
    return kept.select(*[F.col("_id").getField(c).alias(c) for c in docs.columns])


def ablations(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, and that only it rejects.

    Rows are first counted by bit pattern, at most 2**rules groups whatever the
    input, and the rules are read from the patterns.  An empty ledger gives zeros.
    """
    mask = F.lit(mask_of(policy))
    patterns = ledger_rows.groupBy(F.col("failed_bits").bitwiseAND(mask).alias("bits")).count()
    columns = []
    for name in POLICIES[policy]:
        bit = F.lit(1 << RULE_NAMES.index(name))
        hit = F.col("bits").bitwiseAND(bit) != 0
        columns.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias("n_failed"),
                F.coalesce(F.sum(F.when(F.col("bits") == bit, F.col("count"))), F.lit(0)).alias("n_only"),
            )
        )
    return patterns.agg(F.array(*columns).alias("rules")).select(F.inline("rules"))
