"""Every dealt operator against brute force, on awkward rows and on the smallest tables."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hushframe.llm import bpe, embeddings, licences, lines, mixing, quality, queries, simhash, substrings, tokens, warc
from hushframe.llm.common import staged
from hushframe.session import staged_path
from tests.conftest import SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 5000}" for k in range(60_000))
PASSAGE = " ".join(f"shared{k}" for k in range(30))
TEXTS = [
    None,
    "",
    " \t\n",
    "One two",
    "Ünïcode ÄÖ 漢字 <|endoftext|> it's\x0b tab nbsp ſtraße",
    "same words " * 40,
    "same words " * 40,
    LONG,
    LONG + " tail",
    "head " + PASSAGE + " end of one",
    "other " + PASSAGE + " end of two",
    "A line that is repeated everywhere\nalone 1",
    " a LINE that is repeated everywhere \nalone 2\n\n",
    "a line that is repeated everywhere\nalone 3",
    "Some prose first.\n\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0.",
    "The driver lost the driving license.",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, size int, fp string, _id int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", [None, "a", "b", "a"][k % 4], len(t or ""), "x", 1, 2, "y", 3) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def plain_counts(texts):
    tokenizer = Tokenizer.from_file(queries.COUNTED)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_counts(docs, small):
    for table in (docs, small):
        texts = dict(table.select("doc_id", "text").collect())
        found = {r.id: r for r in tokens.token_counts(table, queries.COUNTED).collect()}
        assert {k: r.n_tokens for k, r in found.items()} == dict(zip(texts, plain_counts(texts.values())))
        assert all(r.n_bytes == len((texts[k] or "").encode()) for k, r in found.items())


def test_token_counts_of_chunks(monkeypatch):
    counter = tokens.Counter(queries.COUNTED)
    for text in filter(None, TEXTS):
        maps = [counter.map_of(c) for c in tokens.chunks(text, 7)] if len(text) < 2000 else [counter.map_of(text)]
        assert counter.closed(counter.scan(maps)) == plain_counts([text])[0]


def test_byte_bpe(docs, small):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (docs, small):
        texts = dict(table.select("doc_id", "text").collect())
        encoded = bpe.encode(table, queries.RANKS, public_tokenizers.PATTERN)
        for r in bpe.decode(encoded, queries.RANKS, public_tokenizers.PATTERN).collect():
            text = texts[r.id] or ""
            assert list(r.ids) == plain.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def plain_fingerprint(text):
    words = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(points):
    """Least id reachable over links of two or fewer bits, from (id, fingerprint)."""
    parent = {k: k for k, _ in points}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, x in points:
        for b, y in points:
            if a < b and (x ^ y).bit_count() <= 2:
                i, j = sorted((top(a), top(b)))
                parent[j] = i
    return {k: top(k) for k, _ in points}


def test_simhash(docs, small):
    for table in (docs, small):
        points = [(k, plain_fingerprint(t)) for k, t in table.select("doc_id", "text").collect()]
        found = simhash.components_of(table).collect()
        assert {r.id: r.fp % (1 << 64) for r in found} == dict(points)
        classes = plain_classes(points)
        assert {r.id: r.component for r in found} == classes
        kept = simhash.keep_first(table)
        assert kept.columns == table.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, c in classes.items() if k == c)


def test_vantage_points_lose_no_pair():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [x ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for x in base for a, b in [rng.integers(0, 64, 2)]]
    points = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    tree, met = simhash.Tree(points, 16), set()
    assert tree.leaves > 4
    for _, group in _by_shard(tree, points).items():
        at_home = {k for k, home in group if home}
        met |= {(min(a, b), max(a, b)) for a in at_home for b, _ in group if a != b}
    want = {
        (a, b) for a in range(len(points)) for b in range(a + 1, len(points)) if int(points[a] ^ points[b]).bit_count() <= 2
    }
    assert len(want) > 250 and want <= met


def _by_shard(tree, points):
    shards = defaultdict(list)
    for shard, rows, home in tree.route(points, 2):
        shards[shard] += [(int(k), home) for k in rows]
    return shards


def test_substrings(docs, small):
    for table in (docs, small):
        words = {k: WORD.findall(t or "") for k, t in table.select("doc_id", "text").collect()}
        first = {}
        for k in sorted(words):
            for i in range(len(words[k]) - 12):
                first.setdefault(tuple(words[k][i : i + 13]), k)
        for r in substrings.kept(table).collect():
            own, gone = words[r.id], set()
            for i in range(len(own) - 12):
                if first[tuple(own[i : i + 13])] < r.id:
                    gone |= set(range(i, i + 13))
            left = " ".join(w for i, w in enumerate(own) if i not in gone)
            assert (r.n_words, r.n_removed, r.kept_text) == (len(own), len(gone), left)


def plain_lines(texts):
    """{id: text} without the repeated lines."""
    held = defaultdict(set)
    split = {k: (t or "").split("\n") for k, t in texts.items()}

    def key(line):
        return re.sub("[A-Z]+", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    for k, ls in split.items():
        for line in ls:
            if len(key(line)) >= 20:
                held[key(line)].add(k)
    return {
        k: "\n".join(x for x in ls if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == k) for k, ls in split.items()
    }


def test_lines(docs, small):
    for table in (docs, small):
        want = plain_lines(dict(table.select("doc_id", "text").collect()))
        kept = lines.drop_repeated(table)
        assert kept.columns == table.columns
        assert {r.doc_id: r.text or "" for r in kept.collect()} == want


def test_mixing(docs, small):
    for table in (docs, small):
        rows = mixing.copies(table, carry=["doc_id", "source"]).collect()
        assert len(rows) == table.count()
        taken = Counter()
        for r in rows:
            taken[r.doc.source] += r.copies * r.size
            assert 0 <= r.copies <= 3 and r.target <= 3 * r.source_size
        for r in rows:
            most = max(x.size for x in rows if x.doc.source == r.doc.source)
            assert abs(taken[r.doc.source] - r.target) <= 2 * most
        total = sum(r.size for r in rows)
        assert math.isclose(sum({r.doc.source: r.target for r in rows}.values()), total, rel_tol=1e-9, abs_tol=1e-6)
        mixed = mixing.mix(table)
        assert mixed.columns == table.columns
        assert Counter(r.doc_id for r in mixed.collect()) == Counter({r.doc.doc_id: r.copies for r in rows if r.copies})


def test_quality(docs, small):
    for table in (docs, small):
        judged = quality.ledger(table)
        want = {r.doc_id for r in judged.collect() if r.failed_bits == 0}
        kept = quality.keep_good(table)
        assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == want
        rules = {r.rule: r for r in quality.ablations(judged).collect()}
        assert rules["too_few_words"].n_failed == judged.filter("n_words < 20").count()


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    vectors = [list(map(float, x)) for x in base]
    vectors += [list(map(float, x + 0.1 * rng.standard_normal(16))) for x in base[:10] for _ in range(4)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[1]]]
    vectors += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows = [(k, v, "x", 1) for k, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, n int")
    fine = [k for k, v in enumerate(vectors) if v and None not in v and all(map(math.isfinite, v)) and any(v)]
    linked = defaultdict(set)
    for a in fine:
        for b in fine:
            x, y = np.array(vectors[a]), np.array(vectors[b])
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                linked[a].add(b)
    least = {k: k for k in range(len(vectors))}
    for _ in vectors:
        least = {k: min([least[k], *(least[o] for o in linked[k])]) for k in least}
    found = {r.id: (r.n_links, r.component) for r in embeddings.linked(table).collect()}
    assert found == {k: (len(linked[k]), least[k]) for k in least}


def test_embedding_buckets_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal(8) + 0.02 * rng.standard_normal((120, 8))
    table = spark.createDataFrame([(k, list(map(float, v))) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(embeddings, "CAPACITY", 25)
    assert {(r.n_links, r.component) for r in embeddings.linked(table).collect()} == {(119, 0)}


def test_licences(docs, small):
    model = licences.train(small)
    found = {r.id: r for r in licences.finds(docs, model).collect()}
    assert [(f.paragraph, f.family) for f in found[14].finds] == [(1, "mit"), (2, "cc-by-nc")]
    assert not any(r.finds for k, r in found.items() if k != 14) and found[0].n_paragraphs == 0


def test_licences_of_one_paragraph(small):
    model = licences.train(small)
    told = lambda text: [f.family for f in licences.scan(text, model)[1]]
    assert told("SPDX-License-Identifier: MIT OR Apache-2.0") == ["apache", "mit"]
    assert told("SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause") == ["apache", "bsd", "mit"]
    assert told("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl"]
    for family, notices in licences.TEMPLATES.items():
        for notice in notices:
            assert told(notice) == [family], notice
            for other, more in licences.TEMPLATES.items():
                for also in more:
                    assert told(f"{notice}\n{also}") == sorted({family, other}), (notice, also)


def test_licences_held_out(small):
    made = licences.examples(licences.sample_of(small))
    held, learn = made[::4], [x for k, x in enumerate(made) if k % 4]
    model = licences.fit(learn)
    told = [model.classes[int(np.argmax(model.probabilities(w)))] for w, _ in held]
    assert sum(a == c for a, (_, c) in zip(told, held)) >= 0.95 * len(held)


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 800
    html = [None, "", "short", "short", big, big, big + "x", "a\0b\r\n\r\nWARC/1.1\n" * 200]
    rows = [(k, f"http://h/{k}", h, "x") for k, h in enumerate(html)] + [(None, None, "no id", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = staged_path(spark, "warc-test")
    warc.write(table.repartition(2), path)
    found = {r.page: r for r in warc.read(spark, path).collect()}
    assert len(found) == len(rows)
    for k, h in enumerate(html):
        r, data = found[str(k)], (h or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", "5") if k == 4 else ("response", None))
        assert r.payload is None if k == 4 else bytes(r.payload) == data
    with pytest.raises(EOFError):
        list(warc._read(warc.member("a", b"WARC/1.1\r\n\r\n")[0]))


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    model = licences.train(none)
    results = [
        mixing.copies(none), mixing.mix(none), substrings.kept(none), tokens.token_counts(none, queries.COUNTED),
        lines.drop_repeated(none), licences.finds(none, model), quality.keep_good(none), quality.ledger(none),
        simhash.components_of(none), simhash.keep_first(none), bpe.encode(none, queries.RANKS, public_tokenizers.PATTERN),
        embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    path = staged_path(spark, "warc-empty")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = [Row(doc_id=k, text=t, source="s", n_chars=1) for k, t in [(None, "a b c"), (1, "a b c"), (1, "a b c"), (None, None)]]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    assert [r.doc_id for r in simhash.keep_first(table).filter("text is not null").collect()] == [1]
    assert simhash.keep_first(table).count() == 2
    for result in (mixing.copies(table), lines.drop_repeated(table), substrings.kept(table), simhash.components_of(table)):
        assert result.count() == 4
    assert tokens.token_counts(table, queries.COUNTED).count() == quality.ledger(table).count() == 4


def test_pipeline(spark, small):
    texts = small.filter(F.col("text").isNotNull())
    good = {r.doc_id for r in quality.ledger(texts).collect() if r.failed_bits == 0}
    sources = {r.doc_id: (r.source, r.text) for r in texts.collect() if r.doc_id in good}
    left = plain_lines({k: t for k, (_, t) in sources.items()})
    classes = plain_classes([(k, plain_fingerprint(t)) for k, t in left.items()])
    firsts = {k for k, c in classes.items() if k == c}
    docs, kept = small, []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = staged(stage(spark, docs, SMALL), "test-stage")
        assert docs.columns == small.columns
        kept.append(dict(docs.select("doc_id", "text").collect()))
    assert set(kept[0]) == good and kept[1] == left and kept[2] == {k: left[k] for k in firsts}
    expected = Counter({r.doc.doc_id: r.copies for r in mixing.copies(docs).collect()})
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert Counter(r.doc_id for r in found) == +expected
    assert all(r.text == left[r.doc_id] and r.n_tokens == len(r.ids) for r in found)


def test_pipeline_of_no_documents(spark, small):
    docs = small.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SMALL), "test-stage")
    assert docs.count() == 0


def test_a_sample_of_many_points_is_thinned(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 50)
    points = spark.range(4000).select(F.xxhash64("id").alias("fp"))
    near = points.select((F.col("fp").bitwiseXOR(F.lit(5))).alias("fp"))
    assert simhash.links(points.unionByName(near)).distinct().count() == 4000


def test_collocations_hold_the_words_of_few_texts_at_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from hushframe.llm import collocations as c
    from hushframe.llm.common import slices

    texts = pa.array([f"w{k} some words, and more words " * 300 for k in range(1800)])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    tracemalloc.start()
    for part in slices(iter([batch]), "text", c.SLICE):
        c.Slice(part.column("text"), ["en"] * part.num_rows).phrases(2, np.full(c.MAP >> 3, 255, np.uint8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 15 << 20 and peak < 160 << 20
