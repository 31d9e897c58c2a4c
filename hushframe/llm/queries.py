"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import bpe, collocations, decontaminate, embeddings, importance, licences, lines, mixing, quality, simhash, substrings, tokens, warc
from hushframe.llm.common import table
from hushframe.session import staged_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


# Pieces of SQL used by several queries.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOWER = "'abcdefghijklmnopqrstuvwxyz'"


@query(
    "op1_mix_sources",
    f"""
    WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
    r AS (SELECT *, size - size % (1 << greatest(0, length(bin(size)) - 8)) AS size_class,
                 substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 2) AS salt FROM d),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
    l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
                       ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (
                       ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM w),
    f AS (SELECT min_by(level, (source_size / weight, source)) AS final FROM l WHERE 3 * source_size >= level * weight),
    t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, final * weight) AS target,
                 CAST('0x' || substr(md5('42:' || coalesce(source, 'null')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS o
          FROM l CROSS JOIN f),
    p AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.o,
                 CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                 row_number() OVER (PARTITION BY r.source ORDER BY r.size_class, r.salt, r.size, r.doc_id) AS place
          FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(least(floor(rate * place + o) - floor(rate * (place - 1) + o), ceil(rate)) * size AS BIGINT) AS taken
    FROM p
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.copies(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("doc").getField("doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


@query(
    "op5_line_dedup",
    f"""
    WITH l AS (SELECT doc_id, u.pos, u.line
               FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) t,
                    LATERAL (SELECT unnest(t.ls) AS line, generate_subscripts(t.ls, 1) AS pos) u),
    k AS (SELECT *, translate(trim(line, {_BLANKS}), {_UPPER}, {_LOWER}) AS key FROM l),
    r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.*, coalesce(k.doc_id <> r.keeper, false) AS dropped FROM k LEFT JOIN r ON k.key = r.key)
    SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
    FROM m GROUP BY doc_id
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = lines.with_kept_text(docs, lines.keep_bitmaps(docs))
    return joined.select(
        F.col("doc.doc_id").alias("doc_id"),
        F.size(lines.split_lines(F.col("doc.text"))).cast("long").alias("n_lines"),
        "n_dropped",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


@query(
    "op7_quality_rules",
    f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
    w AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS key
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
    c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS n FROM w),
    g AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM c WHERE n > 1),
    r AS (SELECT doc_id, CAST(sum(step) AS BIGINT) AS n_repeat_words FROM g GROUP BY doc_id),
    l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE length(translate(line, {_BLANKS}, '')) > 0 GROUP BY doc_id),
    m AS (SELECT d.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                 length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 coalesce(n_lines, 0) AS n_lines, length(text) - length(translate(text, {_UPPER}, '')) AS n_upper
          FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
    f AS (SELECT *, CAST(n_words < 20 AS INT) + 2 * CAST(100 * n_repeat_words > 30 * n_words AS INT)
                 + 4 * CAST(100 * n_symbols > 10 * n_words AS INT) + 8 * CAST(word_chars < 2 * n_words AS INT)
                 + 16 * CAST(word_chars > 15 * n_words AS INT) + 32 * CAST(100 * n_dup_lines > 50 * n_lines AS INT)
                 + 64 * CAST(100 * n_upper > 40 * word_chars AS INT) AS failed_bits FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits & 3 <> 0 AS base_failed,
           failed_bits = 0 AS kept, failed_bits
    FROM f
    """,
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.ledger(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        quality.failed("base").alias("base_failed"),
        (~quality.failed("v1")).alias("kept"),
        "failed_bits",
    )


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components_of(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), simhash.hex_of("fp").alias("fingerprint"), F.col("component").alias("component_id")
    )


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op10_byte_bpe")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    return bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op3_substring_dedup",
    f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
    w AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS key
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM d WHERE len(words) >= 13)),
    m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY key) AS least FROM w),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM m WHERE least < doc_id),
    p AS (SELECT d.doc_id, u.pos, u.word
          FROM d, LATERAL (SELECT unnest(d.words) AS word, generate_subscripts(d.words, 1) AS pos) u),
    k AS (SELECT p.doc_id, count(*) AS n_words, CAST(count(c.pos) AS BIGINT) AS n_removed,
                 string_agg(word, ' ' ORDER BY p.pos) FILTER (c.pos IS NULL) AS kept
          FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN k USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.kept(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_removed",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


COUNTED = public_tokenizers.path("word_bpe_49k.json")


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), COUNTED)
    return counted.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit")
    )


@query(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
    h AS (SELECT payload_digest, max(page_id) AS holder FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id <> holder THEN holder END AS refers_to
    FROM d LEFT JOIN h USING (payload_digest)
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = staged_path(spark, "warc")
    warc.write(pages, path)
    kind = pages.schema["page_id"].dataType
    return warc.read(spark, path).select(
        F.col("page").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


@query("op2_embedding_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.linked(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


@query("op6_licence_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licences.finds(docs, licences.train(docs))
    families = F.array_sort(F.array_distinct(F.transform("finds", lambda f: f["family"])))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_paragraphs",
        F.size("finds").cast("long").alias("n_finds"),
        F.array_join(families, ",").alias("families"),
    )


# Words of the operators that take letters, digits and everything beyond ASCII.
_ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(
    "op13_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {_ALNUM} AS words FROM documents),
    b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_ALNUM} AS words FROM benchmark),
    p AS (SELECT DISTINCT item, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS phrase
          FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
    s AS (SELECT DISTINCT size FROM p),
    w AS (SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS phrase
          FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM d, s WHERE len(words) >= size)),
    h AS (SELECT doc_id, size, i, item FROM w JOIN p USING (size, phrase)),
    c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY doc_id),
    m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        decontaminate.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query("op11_importance")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def _slice(first: str, count: str) -> str:
    return f"array_to_string(words[{first}:{first} + {count} - 1], ' ')"


@query(
    "op12_collocations",
    f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
          FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece
                FROM documents)),
    t AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM p GROUP BY lang),
    g AS (SELECT lang, size, {_slice("i", "size")} AS phrase
          FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
                FROM p, (SELECT unnest(range(1, 6)) AS size) WHERE len(words) >= size)),
    f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY lang, size, phrase HAVING count(*) >= 100),
    w AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1),
    o AS (SELECT lang, phrase, max(a) AS longer
          FROM (SELECT lang, {_slice("i", "s")} AS phrase, a
                FROM (SELECT lang, words, a, s, unnest(range(1, size - s + 2)) AS i
                      FROM w, (SELECT unnest(range(2, 5)) AS s) WHERE s < size)) GROUP BY lang, phrase),
    c AS (SELECT lang, phrase, a, k, {_slice("1", "k")} AS first, {_slice("(k + 1)", "(size - k)")} AS rest
          FROM (SELECT w.*, unnest(range(1, size)) AS k FROM w LEFT JOIN o USING (lang, phrase) WHERE 100 * coalesce(longer, 0) < 100 * a)),
    j AS (SELECT c.*, l.a AS l, r.a AS r, n, CAST(1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a) AS BIGINT) AS score
          FROM c JOIN f l ON c.lang = l.lang AND c.first = l.phrase JOIN f r ON c.lang = r.lang AND c.rest = r.phrase
                 JOIN t ON c.lang = t.lang),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM j)
    SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
                          phrase, a, l, r, n, score FROM b WHERE cut = 1)
    WHERE rank <= 2000
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
