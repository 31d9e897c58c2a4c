"""Importance resampling, collocations and decontamination against brute force and on awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hushframe.llm import collocations, decontaminate, importance, queries
from hushframe.llm.fmindex import Index, suffix_order
from hushframe.llm.wordscan import find_words, hashed
from tests.conftest import SMALL

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{k % 5000}" for k in range(60_000))
PASSAGE = "What is the name of the river that runs through the old town of Besançon?"
ITEMS = [
    (1, PASSAGE),
    (1, "another row of the same item which is rather long as well, " + PASSAGE),
    (2, "short item"),
    (3, PASSAGE.upper() + " And then the text goes on for a little while"),
    (4, None),
    (5, " -- "),
    (None, "an item without any name that is nevertheless found in texts"),
    (6, " ".join(f"w{k}" for k in range(4990, 5000)) + " " + " ".join(f"w{k}" for k in range(9000))),
]
TEXTS = [
    (0, None, "en"),
    (1, "", None),
    (2, " \t\n--", "und"),
    (3, "Short", "en"),
    (4, "a short  ITEM,short;item", "en"),
    (5, "before " + PASSAGE.replace(" ", "\n") + " after", "en"),
    (5, "the same id, " + PASSAGE + " " + PASSAGE, "de"),
    (6, LONG, "en"),
    (7, LONG + " short item", None),
    (None, "An item without any name, that is nevertheless found in texts. short. item", "xx"),
    (8, "of the of the of the of the\tof the. of the! the\x0bof ß SS İ ⅷ", "en"),
    (9, "of the of the of the of the\tof the. of the! the\x0bof ß SS İ ⅷ", "en"),
    (10, "x" * 70_000 + " " + "y" * 300 + " z", "en"),
]
COLUMNS = "doc_id long, text string, lang string, id string, n int, items int, spans int, score string, rank int, part int, phrase int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*t, "x", 1, 2, 3, "y", 4, 5, 6) for t in TEXTS], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, item string")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def tests_of_small(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def lowered(text):
    return re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode())


def rows_of(table, *columns):
    return [tuple(r) for r in table.select(*columns).collect()]


def plain_hits(docs, items):
    """(id, words, hit positions, items) per document."""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(lowered(text))
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[k : k + size])].add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    for id_, text in docs:
        words = ALNUM.findall(lowered(text))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                owners = windows.get(tuple(words[k : k + size]))
                if owners:
                    hit.update(range(k, k + size))
                    found |= owners
        yield id_, len(words), hit, sorted(found)


def check_spans(docs, items):
    found = decontaminate.spans(docs, items, keep_text=True).collect()
    expected = list(plain_hits(rows_of(docs, "doc_id", "text"), rows_of(items, "item_id", "text")))
    got = []
    for r in found:
        hit = [k for s in r.spans for k in range(s["first"], s["last"] + 1)]
        assert len(hit) == len(set(hit)) and hit == sorted(hit)
        words = ALNUM.findall(lowered(r.text))
        for s in r.spans:
            inside = ALNUM.findall(lowered(r.text.encode()[s["begin"] : s["end"]].decode()))
            assert inside == words[s["first"] : s["last"] + 1]
        got.append((r.id, r.n_words, set(hit), r["items"]))
    key = lambda t: (t[0] is None, t[0], t[1], sorted(t[2]))
    assert sorted(got, key=key) == sorted(expected, key=key)
    return got


def test_decontamination(docs, items, small, tests_of_small):
    assert sum(bool(h) for _, _, h, _ in check_spans(docs, items)) == 6
    assert any(h for _, _, h, _ in check_spans(small, tests_of_small))


def test_decontamination_in_blocks_shards_and_pieces(docs, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(decontaminate, "PIECE", 700)
    check_spans(docs, items)


def test_decontamination_of_small_shards(docs, items):
    known = decontaminate.phrases(["1", "2"], pa.array([PASSAGE, "short item"]))
    shard = decontaminate.Shard(known)
    for text in ("no", "a short item", PASSAGE, "short", "item"):
        shard.add(pa.RecordBatch.from_pydict({"text": [text]}))
    counts, found, spans = shard.judged()
    assert counts.tolist() == [1, 3, 15, 1, 1] and found == [[], ["2"], ["1"], [], []]
    assert [[(s["first"], s["last"]) for s in x] for x in spans] == [[], [(1, 2)], [(0, 14)], [], []]


def test_removed_passages(docs, items):
    held = {r.id: r.text for r in decontaminate.removed(docs.filter("doc_id in (1, 3, 4)"), items).collect()}
    assert held == {1: "", 3: "Short", 4: "a "}


def test_decontamination_without_rows(docs, items):
    assert decontaminate.spans(docs.limit(0), items).count() == 0
    found = decontaminate.spans(docs, items.limit(0)).collect()
    assert len(found) == len(TEXTS) and not any(r.spans or r["items"] for r in found)


def test_index_against_plain_search():
    rng = np.random.default_rng(1)
    for trial in range(12):
        sigma, width = int(rng.integers(1, 9)), (4, 13)[trial % 2]
        strings = [rng.integers(1, sigma + 1, rng.integers(1, 60)).tolist() for _ in range(rng.integers(1, 9))]
        strings += strings[:3]
        text = np.array([0] + sum([s + [0] for s in strings], []))
        closing = [next(e for e in range(p, len(text)) if text[e] == 0) for p in range(len(text))]
        assert suffix_order(text, width).tolist() == sorted(
            range(len(text)), key=lambda p: (text[p : closing[p]].tolist() + [0], closing[p])
        )
        index = Index(text, width)
        for size in (1, 2, 5, 10):
            wanted = [s[k : k + size] for s in strings for k in range(len(s) - size + 1)][:6]
            patterns = np.array(wanted + rng.integers(1, sigma + 1, (4, size)).tolist())
            found = {int(w): sorted(index.locate(np.arange(a, z)).tolist()) for w, a, z in zip(*index.search(patterns))}
            for w, p in enumerate(patterns):
                assert found.get(w, []) == [k for k in range(len(text) - size + 1) if (text[k : k + size] == p).all()]


def test_words_of_many_texts():
    texts = pa.array(["", "Ab c", "c", "d-", "éA b", "--", "x" * 100 + "y", "x" * 100 + "z"])
    for held in (texts, texts.slice(1, 4), texts.cast(pa.large_binary()), texts.slice(0, 0)):
        words = find_words(held)
        plain = [ALNUM.findall(lowered(t.as_py() if isinstance(t.as_py(), str) else t.as_py().decode())) for t in held]
        assert [words.of(k) for k in range(len(words.begin))] == sum(plain, [])
        assert np.diff(words.bounds).tolist() == [len(p) for p in plain]
        assert len(set(hashed(words).tolist())) == len(set(sum(plain, [])))


def plain_features(text):
    words = ALNUM.findall(lowered(text))
    return len(words), [zlib.crc32(b" ".join(words[k : k + n])) % 10_000 for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def plain_resampled(docs, target):
    held = [(id_, *plain_features(text)) for id_, text in docs]
    corpus, aim = Counter(b for _, _, f in held for b in f), Counter(b for (t,) in target for b in plain_features(t)[1])
    s, t = sum(corpus.values()), sum(aim.values())
    gain = [
        math.floor(1000 * math.log(float(aim[b] + 1) * float(s + 10_000) / (float(corpus[b] + 1) * float(t + 10_000))))
        for b in range(10_000)
    ]
    rows = []
    for id_, n, f in held:
        h = int(hashlib.sha256(f"42:{'null' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((id_, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[: 5 * len(order) // 100])}
    return [(*r, rank.get(id(r))) for r in rows]


def test_importance(docs, items, small, tests_of_small):
    for corpus, target in ((docs, items), (small, tests_of_small)):
        found = [tuple(r) for r in importance.resampled(corpus, target).collect()]
        expected = plain_resampled(rows_of(corpus, "doc_id", "text"), rows_of(target, "text"))
        assert sorted(found, key=str) == sorted(expected, key=str)


def test_importance_of_repeated_rows_and_no_rows(spark, items):
    text = " ".join(f"w{k}" for k in range(25))
    rows = spark.createDataFrame([(k % 3 or None, text) for k in range(60)], "doc_id long, text string").repartition(4)
    found = importance.resampled(rows, items).collect()
    assert len(found) == 60 and sorted(r.rank for r in found if r.rank) == [1, 2, 3]
    assert len({(r.id, r.score) for r in found}) == 3
    assert importance.resampled(rows.limit(0), items).count() == 0
    assert importance.resampled(rows, items.limit(0)).count() == 60


def test_crc_of_joined_parts():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 64, 65, 300, 70_000):
        head, tail = rng.bytes(9), rng.bytes(n)
        turned = importance.shifted(np.array([zlib.crc32(head)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(tail))
        assert turned == zlib.crc32(head + tail)


def plain_collocations(docs, min_count, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = re.findall(rb"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                counts[lang].update(b" ".join(words[k : k + size]) for k in range(len(words) - size + 1))
    out = []
    for lang, held in counts.items():
        often = {p: a for p, a in held.items() if a >= min_count}
        gone = set()
        for p, a in often.items():
            words = p.split(b" ")
            for size in range(1, len(words)):
                for k in range(len(words) - size + 1):
                    inner = b" ".join(words[k : k + size])
                    if 100 * a >= 100 * often[inner]:
                        gone.add(inner)
        rows = []
        for p, a in often.items():
            words = p.split(b" ")
            if len(words) > 1 and p not in gone:
                cuts = []
                for k in range(1, len(words)):
                    l, r = often[b" ".join(words[:k])], often[b" ".join(words[k:])]
                    cuts.append((1000 * a * totals[lang] // (l * r), k, l, r))
                score, _, l, r = min(cuts)
                rows.append((-score, -a, p, l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("burst, full", [(1 << 15, 1 << 22), (3, 50)])
def test_collocations(docs, small, monkeypatch, burst, full):
    monkeypatch.setattr(collocations, "BURST", burst)
    monkeypatch.setattr(collocations, "FULL", full)
    for table, least, top in ((docs, 2, 40), (small, 20, 2000), (small, 100, 5)):
        found = sorted(map(tuple, collocations.collocations(table, min_count=least, top=top).collect()))
        assert found == plain_collocations(rows_of(table, "text", "lang"), least, top)


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 4)
    rng = np.random.default_rng(2)
    trie, expected = collocations.HatTrie(3), Counter()
    for _ in range(20):
        route = np.unique(rng.integers(0, 1 << 24, 60) & 0x070703)
        h = (route.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        trie.add(h, np.ones(len(h), np.int64), route & 255, route)
        expected.update(h.tolist())
    assert any(isinstance(c, dict) for c in trie.root.values())
    out, held = Counter(), trie.held()
    for keep in (held // 2, 0):
        for h, n, _ in trie.spilled(keep):
            assert (h[1:] > h[:-1]).all()
            out.update(dict(zip(h.tolist(), n.tolist())))
        assert trie.held() <= keep
    assert out == expected


def test_collocations_of_no_rows_and_exact_scores(spark, docs):
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert queries.ORACLE["op12_collocations"]
    pair = spark.createDataFrame([("a b",)] * 100, "text string").withColumn("lang", F.lit("a"))
    assert [tuple(r) for r in collocations.collocations(pair).collect()] == [("a", 1, "a b", 100, 100, 100, 200, 2000)]
