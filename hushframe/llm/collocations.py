"""Phrase collocation mining: HAT-trie counting, one phrase length after the other.

A task counts phrases in a shallow trie over word ids; the id of a word is its 64-bit hash
and the same in all tasks.  The trie's leaves are containers of phrase hashes and counts;
a container that grows too large bursts into a node over the next word.  When the trie is
full, its largest subtrees leave as sorted runs.  Runs meet by the prefix of the hash: the
sort of the shuffle merges them, and a pass over the sorted rows adds up equal phrases, so
no group is ever held.  What a frequent phrase sends is bounded by the tasks and their
spills, not by its occurrences.  Only phrases that are frequent are spelled, by one more
pass over the texts: a count carries a witness, sixteen bits of the least hash of a text
that holds the phrase, and only such texts spell it.

A phrase is as frequent as each part of it at most.  So phrases of k words are counted
only where both of their parts of k - 1 words may be frequent, by a bitmap of fixed size
over hashes of those that are; a wrong bit costs a count and changes no result.

Defined cases: null, empty and wordless texts have no phrases; a null language is
``UNKNOWN``; repeated rows and rows that share an id count each; an empty table gives an
empty result.  Only the text and the language are read, so ids and extra columns do not
matter.  Words and phrases are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hushframe.llm.common import row_key, slices, staged, text_of
from hushframe.llm.substrings import mixed
from hushframe.llm.wordscan import find_words, hashed

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
UNKNOWN = "und"

#: Phrases that a container holds before it bursts, and words that the trie branches on.
BURST = 1 << 15
DEPTH = 3
#: Phrases that a task holds before subtrees are spilled, and rows of a batch that leaves.
FULL = 1 << 22
BATCH = 1 << 16
#: Bytes of text whose words a task holds at once, with about forty bytes of arrays per byte of text.
SLICE = 1 << 21
#: Bits of the map of frequent phrases, and of one piece of it.
MAP = 1 << 26
PIECE = 1 << 15
#: Low bits of a text's hash that name it as the witness of a phrase: the least one that holds it spells it.
WITNESS = 16
#: Bits that a phrase and its witness mark.
MARKS = 3
#: Leading bits of a hash that name its partition.
PREFIX = 20
#: Parts of a language that are ranked on their own before its best are.
SALTS = 64

_NEXT = np.uint64(0xD1342543DE82EF95)
_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_INSIDE = ~_SEPARATORS
_INSIDE[list(b" \t")] = False


class Container:
    """Phrase hashes, counts, witnesses and routes; what came last is added up when it outgrows the rest."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = self.settled = 0

    def add(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > 2 * self.settled + 1024:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """(hash, count, witness, route) in the order of the hashes, each once."""
        if len(self.parts) > 1 or self.size != self.settled:
            h, n, seen, route = (np.concatenate(c) for c in zip(*self.parts))
            order, start = _grouped(h)
            first = order[start]
            self.parts = [(h[first], np.add.reduceat(n[order], start), np.minimum.reduceat(seen[order], start), route[first])]
            self.size = self.settled = len(start)
        return self.parts[0]


def _grouped(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start): places in the order of their hashes, and where each hash begins."""
    order = np.argsort(h)
    return order, np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]])) if len(h) else np.zeros(0, np.int64)


class HatTrie:
    """Counts of phrases by their words' ids: a node branches on eight bits of the next one's."""

    def __init__(self, size: int):
        self.levels = min(size, DEPTH)
        self.root: dict[int, dict | Container] = {}

    def add(self, h: np.ndarray, n: np.ndarray, seen: np.ndarray, route: np.ndarray) -> None:
        """Count phrases; byte k of ``route``, from the lowest, leads on in a node of depth k."""
        self._into(self.root, 0, h, n, seen, route)

    def _into(self, node: dict, depth: int, h: np.ndarray, n: np.ndarray, seen: np.ndarray, route: np.ndarray) -> None:
        digit = (route >> (8 * depth)) & 255
        order = np.argsort(digit, kind="stable")
        h, n, seen, route, digit = h[order], n[order], seen[order], route[order], digit[order]
        start = np.flatnonzero(np.append(True, digit[1:] != digit[:-1])) if len(digit) else []
        for a, z in zip(start, np.append(start[1:], len(digit))):
            child = node.setdefault(int(digit[a]), None) or Container()
            if isinstance(child, dict):
                self._into(child, depth + 1, h[a:z], n[a:z], seen[a:z], route[a:z])
                continue
            node[int(digit[a])] = child
            child.add(h[a:z], n[a:z], seen[a:z], route[a:z])
            if child.size > BURST and depth + 1 < self.levels and len(child.settle()[0]) > BURST:
                burst: dict = {}
                self._into(burst, depth + 1, *child.settle())
                node[int(digit[a])] = burst

    def held(self) -> int:
        return sum(map(_size, self.root.values()))

    def spilled(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hash, count, witness) of the largest subtrees, each sorted, until at most ``keep`` phrases are held."""
        trees = sorted(((_size(child), digit) for digit, child in self.root.items()), reverse=True)
        held = sum(size for size, _ in trees)
        for size, digit in trees:
            if held <= keep:
                break
            held -= size
            parts = [c.settle() for c in _containers(self.root.pop(digit))]
            h, n, seen = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(h)
            yield h[order], n[order], seen[order]


def _containers(node: dict | Container) -> Iterator[Container]:
    if isinstance(node, Container):
        yield node
    else:
        for child in node.values():
            yield from _containers(child)


def _size(node: dict | Container) -> int:
    return sum(c.size for c in _containers(node))


def _lang_seed(lang: str) -> np.uint64:
    """Scrambled once more, as a language may also be a word."""
    return mixed(hashed(find_words(pa.array(["#" + lang]), np.ones(256, bool))) + _NEXT)[0]


class Slice:
    """The words of some texts, and the hashes of the phrases that begin at each of them."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        self.words = find_words(texts, _INSIDE)
        self.hashes = hashed(self.words)
        self.text = self.words.text_of(np.arange(len(self.hashes)))
        seeds = {lang: _lang_seed(lang) for lang in set(langs)}
        seed = np.array([seeds[lang] for lang in langs], np.uint64)
        self.first = mixed(self.hashes ^ seed[self.text]) if len(self.hashes) else self.hashes
        passed = np.cumsum(_SEPARATORS[self.words.data], dtype=np.int32)
        # Differs across a separator and across texts.
        self.piece = passed[self.words.begin] + self.text

    def longer(self, h: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of ``size`` words from those of one word less; the last place has none."""
        return mixed(h[:-1] * _NEXT ^ self.hashes[size - 1 :])

    def whole(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each place on lie in one piece."""
        n = max(0, len(self.piece) - size + 1)
        return self.piece[:n] == self.piece[size - 1 :]

    def phrases(self, size: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the phrases to be counted."""
        h = self.first
        for k in range(2, size):
            h = self.longer(h, k)
        if size == 1:
            return np.arange(len(h)), h
        if len(self.hashes) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        may = _marked(frequent, h)
        places = np.flatnonzero(may[:-1] & may[1:] & self.whole(size))
        return places, mixed(h[places] * _NEXT ^ self.hashes[places + size - 1])

    def route(self, places: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(places), np.int64)
        for k in range(min(size, DEPTH)):
            out |= (self.hashes[places + k] & np.uint64(255)).astype(np.int64) << (8 * k)
        return out


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(MAP - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _runs(rows: DataFrame, size: int, frequent: np.ndarray | None) -> DataFrame:
    """(h, n): the sorted runs of all tasks; the low bits of ``n`` hold the witness, the others the count."""

    def out(trie: HatTrie, keep: int) -> Iterator[pa.RecordBatch]:
        for h, n, seen in trie.spilled(keep):
            packed = n << WITNESS | seen
            for at in range(0, len(h), BATCH):
                columns = [pa.array(h[at : at + BATCH].view(np.int64)), pa.array(packed[at : at + BATCH])]
                yield pa.RecordBatch.from_arrays(columns, ["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(size)
        for batch in slices(batches, "text", SLICE):
            held = Slice(batch.column("text"), batch.column("lang").to_pylist())
            places, whole = held.phrases(size, frequent)
            order, start = _grouped(whole)
            if not len(start):
                continue
            n, first = np.diff(np.append(start, len(order))), order[start]
            seen = _witness(batch)[held.text[places]]
            trie.add(whole[first], n, np.minimum.reduceat(seen[order], start), held.route(places[first], size))
            if trie.held() > FULL:
                yield from out(trie, FULL // 2)
        yield from out(trie, 0)

    return rows.mapInArrow(count, "h bigint, n bigint")


def _witness(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("row")) & ((1 << WITNESS) - 1)


def _merged(runs: DataFrame, min_count: int) -> DataFrame:
    """(h, n, seen) of the phrases found ``min_count`` times or more, from runs merged per prefix partition."""
    together = runs.repartition(F.shiftright("h", 64 - PREFIX)).sortWithinPartitions("h")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h: np.ndarray, n: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
            often = n >= min_count
            return pa.RecordBatch.from_arrays([pa.array(c[often]) for c in (h, n, seen)], ["h", "n", "seen"])

        last = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            packed = np.asarray(batch.column("n"))
            columns = np.asarray(batch.column("h")), packed >> WITNESS, packed & ((1 << WITNESS) - 1)
            h, n, seen = (np.concatenate(c) for c in zip(last, columns))
            if not len(h):
                continue
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            held = h[start], np.add.reduceat(n, start), np.minimum.reduceat(seen, start)
            last = [c[-1:] for c in held]
            yield out(*(c[:-1] for c in held))
        yield out(*last)

    return together.mapInArrow(add_up, "h bigint, n bigint, seen bigint")


def _pairs(h: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """A hash of each phrase with its witness."""
    return mixed(h ^ mixed(seen.astype(np.uint64) + _NEXT))


def _by_witness(frequent: DataFrame) -> np.ndarray:
    """A map that marks MARKS bits for each phrase and its witness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = _pairs(np.asarray(batch.column("h")).view(np.uint64), np.asarray(batch.column("seen")))
            marks = np.concatenate([_mark(pair, k) for k in range(MARKS)])
            yield pa.RecordBatch.from_arrays([pa.array(marks.view(np.int64))], ["h"])

    return _bitmap(frequent.mapInArrow(run, "h bigint"))


def _mark(pair: np.ndarray, k: int) -> np.ndarray:
    return mixed(pair + np.uint64(k) * _NEXT)


def _spelled(rows: DataFrame, longest: int, frequent: np.ndarray, named: np.ndarray) -> DataFrame:
    """(h, lang, phrase, size, n): phrases that may be frequent, and with size 0 the words of a language.

    Of the texts that hold a phrase those spell it that are its witness; a task spells it once.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, totals = [np.zeros(0, np.uint64)] * (longest + 1), {}
        for batch in slices(batches, "text", SLICE):
            langs = batch.column("lang").to_pylist()
            held, witness = Slice(batch.column("text"), langs), _witness(batch)
            for lang, n in zip(langs, np.diff(held.words.bounds).tolist()):
                totals[lang] = totals.get(lang, 0) + n
            h = held.first
            for size in range(1, longest + 1):
                if len(held.hashes) < size:
                    break
                h = held.longer(h, size) if size > 1 else h
                places = np.flatnonzero(_marked(frequent, h) & held.whole(size))
                pair = _pairs(h[places], witness[held.text[places]])
                for k in range(MARKS):
                    mine = _marked(named, _mark(pair, k))
                    places, pair = places[mine], pair[mine]
                new, first = np.unique(h[places], return_index=True)
                fresh = ~np.isin(new, seen[size], assume_unique=True)
                new, places = new[fresh], places[first[fresh]]
                seen[size] = np.concatenate([seen[size], new])
                spelled = [b" ".join(map(held.words.of, range(p, p + size))).decode() for p in places.tolist()]
                yield _named(new, [langs[t] for t in held.text[places].tolist()], spelled, size, [0] * len(new))
        yield _named(np.zeros(len(totals), np.uint64), list(totals), [""] * len(totals), 0, list(totals.values()))

    return rows.mapInArrow(spell, "h bigint, lang string, phrase string, size int, n bigint")


def _named(h: np.ndarray, langs: list[str], phrases: list[str], size: int, n: list[int]) -> pa.RecordBatch:
    columns = [
        pa.array(h.view(np.int64)),
        pa.array(langs, pa.string()),
        pa.array(phrases, pa.string()),
        pa.array([size] * len(h), pa.int32()),
        pa.array(n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["h", "lang", "phrase", "size", "n"])


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """One bit per hash slot that a frequent phrase has: MAP bits, whatever their number."""
    slots = frequent.select(F.pmod("h", F.lit(MAP)).alias("slot"))
    pieces = slots.select(F.floor(F.col("slot") / PIECE).cast("int").alias("piece"), (F.col("slot") % PIECE).alias("bit"))
    held = pieces.repartition("piece").groupBy("piece").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(MAP >> 3, np.uint8)
    for piece, bits in held.collect():
        out[piece * (PIECE >> 3) : (piece + 1) * (PIECE >> 3)] = np.frombuffer(bits, np.uint8)
    return out


def frequent_phrases(
    docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, n) of all phrases found often enough, (lang, total words))."""
    rows = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), row_key(text).alias("row"), text_of(text).alias("text")
    ).withColumn("row", F.coalesce("row", F.lit(0).cast("long")))
    counts, bits, every = None, None, np.zeros(MAP >> 3, np.uint8)
    for size in range(1, longest + 1):
        level = staged(_merged(_runs(rows, size, bits), min_count), f"phrases-{size}")
        counts = level if counts is None else counts.unionByName(level)
        bits = _bitmap(level)
        every |= bits
        if not bits.any():
            break
    spelled = staged(_spelled(rows, longest, every, _by_witness(counts)), "phrases")
    names = spelled.filter("size > 0").groupBy("h").agg(F.min(F.struct("lang", "phrase", "size")).alias("name"))
    known = names.join(counts.drop("seen"), "h").select("name.lang", "name.phrase", "name.size", "n")
    return staged(known, "frequent"), spelled.filter("size = 0").groupBy("lang").agg(F.sum("n").alias("total"))


def _part(words: str, first, count) -> F.Column:
    return F.array_join(F.slice(words, first, count), " ")


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two words or more of each language."""
    known, totals = frequent_phrases(docs, text, lang, longest, min_count)
    words = known.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    # A candidate goes if one word more on either side is found as often.
    longer = words.filter("size > 2")
    inner = [
        longer.select("lang", _part("words", at, F.col("size") - 1).alias("phrase"), F.col("a").alias("longer")) for at in (1, 2)
    ]
    most = inner[0].unionByName(inner[1]).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = words.join(most, ["lang", "phrase"], "left").filter(~(F.coalesce("longer", F.lit(0)) >= F.col("a")))
    cuts = left.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang",
        "phrase",
        "a",
        "k",
        _part("words", 1, F.col("k")).alias("first"),
        _part("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    first = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    rest = known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    exact = "(CAST(a AS DECIMAL(19)) * CAST(total AS DECIMAL(19)) * 1000) div (CAST(l AS DECIMAL(19)) * CAST(r AS DECIMAL(19)))"
    judged = cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"]).join(totals, "lang").withColumn("score", F.expr(exact))
    best = judged.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    scored = best.select("lang", "phrase", "a", F.col("total").alias("n"), "cut.l", "cut.r", "cut.score")
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
