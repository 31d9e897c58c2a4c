"""Token counts by a transducer compiled from a tokenizer file.

Merging pairs by rank gives a prefix of a word the tokens of the word's start,
but for the last one.  So the word can be read byte by byte: the last token at a
position is the one token ending there that stays apart from the last token before
it.  What the next bytes need of the past is, for each earlier position from which
some token still may go on, the place in the token trie, the last token there and
how many tokens came since.  These are the states; each transition carries the
number of tokens by which the count changes, and the transition that ends a word
closes it.  States are made when first met, and whole words are remembered as one transition.

Texts are cut into chunks.  White space brings the transducer back to its start
whatever came before, so a chunk's map of entry states is its head up to the first
blank, the count between, and its tail; two maps compose into a map again, and
composition is associative, so the maps of a text are summed up in a tree of any shape.

Letters, digits and lower case follow the installed Unicode tables; code points that
these know and the library does not yet (unassigned there) may count differently.

Defined cases: a null or empty text has no tokens; special strings inside texts are
one token each; rows are counted one by one, so repeated rows and ids are kept; an
empty table gives an empty result.  Only the id and the text are read; extra columns do
not appear.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.bpe import byte_characters
from hushframe.llm.common import row_key, slices, text_of

#: Code points of a chunk, give or take the way to the next blank.
CHUNK = 1 << 16
#: States and words a worker remembers; beyond that it starts anew, with equal results.
REMEMBER_STATES = 300_000
REMEMBER_WORDS = 600_000

_START = 0
_FREE = -1  # no token before


class Transducer:
    """Reads words as bytes and tells how many tokens they have."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        of_character = {c: b for b, c in byte_characters().items()}
        self.spelled: dict[int, tuple[int, ...]] = {}
        for token, number in vocabulary.items():
            ends = token.endswith(suffix)
            bytes_ = [of_character[c] for c in (token[: -len(suffix)] if ends else token)]
            if ends:
                bytes_[-1] += 256
            self.spelled[number] = tuple(bytes_)
        spelling = {s: n for n, s in self.spelled.items()}
        self.base = {s[0]: n for s, n in spelling.items() if len(s) == 1}
        self.ranks = {
            (vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)
        }
        self.parts = {whole: (rank, *pair) for pair, (rank, whole) in self.ranks.items()}
        if len(self.parts) < len(self.ranks):
            raise ValueError("two merges make the same token")
        self.edges: tuple[dict, dict] = {}, {}
        # The trie of all tokens; ``ending`` has the token that ends at a node.
        self.children: dict[int, int] = {}
        self.ending: dict[int, int] = {}
        nodes = 1
        for spelled, number in spelling.items():
            node = 0
            for symbol in spelled:
                key = node << 9 | symbol
                if key not in self.children:
                    self.children[key] = nodes
                    nodes += 1
                node = self.children[key]
            self.ending[node] = number
        self.apart: dict[tuple[int, int], bool] = {}
        self.words: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        start = ((0, _FREE, 0),)
        self.numbers = {start: _START}
        self.states = [start]
        self.steps: dict[int, tuple[int, int]] = {}

    def merged(self, symbols: list[int] | tuple[int, ...]) -> list[int]:
        """The tokens of a few symbols, by merging the pair of least rank until none is left."""
        tokens = [self.base[s] for s in symbols]
        while len(tokens) > 1:
            best = min((self.ranks.get(p, (1 << 60, -1)) for p in zip(tokens, tokens[1:])), default=(1 << 60, -1))
            if best[1] < 0:
                break
            k = next(k for k, p in enumerate(zip(tokens, tokens[1:])) if self.ranks.get(p) == best)
            tokens[k : k + 2] = [best[1]]
        return tokens

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """What stood at one edge (0: left, 1: right) while a token was made, last first:
        the token there, the rank that made it, and the rank that took it up."""
        known = self.edges[side].get(token)
        if known is None:
            known, at, taken = [], token, 1 << 60
            while at in self.parts:
                rank = self.parts[at][0]
                known.append((at, rank, taken))
                at, taken = self.parts[at][1 + side], rank
            known.append((at, -1, taken))
            self.edges[side][token] = known
        return known

    def _never_meet(self, left: int, right: int) -> bool:
        """Whether no merge joins two neighbours at any time while either token is made.

        Of equal merges the left one goes first, hence the two signs.
        """
        one, other = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            a, made_a, taken_a = one[i]
            b, made_b, taken_b = other[j]
            rank = self.ranks.get((a, b))
            if rank is not None and max(made_a, made_b) < rank[0] and rank[0] < taken_a and rank[0] <= taken_b:
                return False
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                i += 1
            else:
                j += 1

    def _stays(self, before: int, token: int) -> bool:
        """Whether ``token`` is the last one when ``before`` is the last one up to its start."""
        known = self.apart.get((before, token))
        if known is None:
            if before == _FREE:
                known = self.merged(self.spelled[token]) == [token]
            elif not self._stays(_FREE, token):
                known = False
            else:
                known = self._never_meet(before, token)
            if len(self.apart) > 4 * REMEMBER_STATES:
                self.apart.clear()
            self.apart[before, token] = known
        return known

    def _step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and the change of the count; made on first use."""
        going, last, change = [], None, 0
        for node, before, since in self.states[state]:
            child = self.children.get(node << 9 | symbol)
            if child is None:
                continue
            going.append((child, before, since))
            token = self.ending.get(child)
            if token is not None and self._stays(before, token):
                last, change = token, 1 - since
        if last is None:
            raise ValueError(f"no token ends with symbol {symbol}")
        if symbol >= 256:
            after = _START
        else:
            entries = tuple(sorted({(n, b, s + change) for n, b, s in going} | {(0, last, 0)}))
            after = self.numbers.setdefault(entries, len(self.states))
            if after == len(self.states):
                self.states.append(entries)
        self.steps[state << 9 | symbol] = after, change
        return after, change

    def word(self, piece: str) -> int:
        """Tokens of one word."""
        state, count = _START, 0
        symbols = piece.encode("utf-8", "surrogatepass")
        for symbol in symbols[:-1]:
            step = self.steps.get(state << 9 | symbol)
            state, change = step or self._step(state, symbol)
            count += change
        symbol = symbols[-1] + 256
        return count + (self.steps.get(state << 9 | symbol) or self._step(state, symbol))[1]

    def total(self, pieces: list[str]) -> int:
        known = self.words
        for piece in set(pieces).difference(known):
            known[piece] = self.word(piece)
        count = sum(map(known.__getitem__, pieces))
        if len(known) > REMEMBER_WORDS:
            known.clear()
        if len(self.states) > REMEMBER_STATES:
            self._forget()
        return count


class ChunkMap(NamedTuple):
    """How a chunk acts on the text so far: ``head`` goes on with the last word, then
    ``count`` tokens follow and ``tail`` is left open.  Without a blank there is only a head."""

    head: str
    blank: bool
    count: int
    tail: str


class Counter:
    """Tokens of texts as the tokenizer file has them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", _SPACE), regex.V0).findall
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.machine = Transducer(model["vocab"], merges, model["end_of_word_suffix"])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.machine.total(self.pieces(text.lower()))

    def whole(self, text: str) -> int:
        """Tokens of a text that begins and ends where words do."""
        if self.special is None or "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def map_of(self, chunk: str) -> ChunkMap:
        first = _BLANK.search(chunk)
        if first is None:
            return ChunkMap(chunk, False, 0, "")
        last = max(chunk.rfind(c) for c in _BLANKS)
        return ChunkMap(chunk[: first.start()], True, self.whole(chunk[first.start() : last + 1]), chunk[last + 1 :])

    def compose(self, one: ChunkMap, other: ChunkMap) -> ChunkMap:
        if not one.blank:
            return ChunkMap(one.head + other.head, other.blank, other.count, other.tail)
        if not other.blank:
            return one._replace(tail=one.tail + other.head)
        return ChunkMap(one.head, True, one.count + self.whole(one.tail + other.head) + other.count, other.tail)

    def closed(self, whole: ChunkMap) -> int:
        """Tokens of a text from the map of all its chunks."""
        return self.whole(whole.head) + whole.count + self.whole(whole.tail)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """The map of neighbouring chunks together, pairwise in log depth."""
        while len(maps) > 1:
            pairs = [self.compose(*maps[k : k + 2]) for k in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(maps) - len(maps) % 2 :]
        return maps[0]


#: White space of the tokenizer's patterns, which know Unicode's White_Space alone (fixed values).
_SPACE = r"\t\n\v\f\r\x20\x85\xa0  -     　"
#: The blanks at which chunks are parted.
_BLANKS = " \n\t\r"
_BLANK = regex.compile(f"[{_BLANKS}]")


@lru_cache(maxsize=4)
def _counter(path: str) -> Counter:
    return Counter(path)


def chunks(text: str, size: int = CHUNK) -> list[str]:
    return [text[k : k + size] for k in range(0, len(text), size)] or [""]


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, n_bytes, n_tokens) per row of ``docs``; every executor can read ``tokenizer``."""
    rows = docs.select(F.col(key).alias("id"), row_key(text).alias("row"), text_of(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer)
        for batch in slices(batches, "text"):
            counts = []
            for value in batch.column("text"):
                maps = [counter.map_of(c) for c in chunks(value.as_py())]
                counts.append(counter.closed(counter.scan(maps)))
            size = pa.array([v.as_buffer().size for v in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), size, pa.array(counts, pa.int64())],
                ["id", "row", "n_bytes", "n_tokens"],
            )

    return rows.mapInArrow(run, f"id {kind}, row bigint, n_bytes bigint, n_tokens bigint")
