"""The words of many texts at once, as places in the byte buffer that holds the texts."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from hushframe.llm.substrings import mixed

_SEED = np.uint64(0x9E3779B97F4A7C15)
#: Masks that leave the first n bytes of eight.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)

#: A-Z in lower case, all else as it is.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32

#: Bytes of words of ASCII letters, digits and everything beyond ASCII.
ALPHANUMERIC = np.zeros(256, bool)
for _first, _last in ((48, 57), (65, 90), (97, 122), (128, 255)):
    ALPHANUMERIC[_first : _last + 1] = True


class Words(NamedTuple):
    """Words in the order of the texts; text k has the words bounds[k]..bounds[k + 1]."""

    data: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    def of(self, word: int) -> bytes:
        return self.data[self.begin[word] : self.end[word]].tobytes()

    def text_of(self, words: np.ndarray) -> np.ndarray:
        """The number of the text that holds each word."""
        return np.searchsorted(self.bounds, words, "right") - 1


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of strings or binaries without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.type in (pa.large_string(), pa.large_binary())
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(texts: pa.Array, inside: np.ndarray = ALPHANUMERIC) -> Words:
    """All words of the texts, A-Z in lower case; ``inside`` tells the bytes a word is made of."""
    data, offsets = buffer_of(texts)
    within = np.zeros(len(data) + 1, bool)
    within[:-1] = inside[data]
    change = np.empty(len(data) + 1, bool)
    change[:1] = within[:1]
    np.not_equal(within[1:], within[:-1], out=change[1:])
    begins, ends = change & within, change & ~within
    # A text that ends in a word and one that begins with a word do not share it.
    cut = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    met = cut[within[cut] & within[cut - 1]]
    begins[met] = ends[met] = True
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return Words(LOWERED[data], begin, end, np.searchsorted(begin, offsets), offsets)


def hashed(words: Words) -> np.ndarray:
    """64-bit hashes of the words, taken eight bytes at a time."""
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(words.data) + 1, "<u8", buffer=padded, strides=(1,))
    size = words.end - words.begin
    out = mixed(size.astype(np.uint64) ^ _SEED)
    live, done = np.arange(len(size)), 0
    while len(live):
        left = size[live] - done
        part = eights[words.begin[live] + done] & _FIRST[np.minimum(left, 8)]
        out[live] = mixed(out[live] ^ part) * _SEED
        done += 8
        live = live[left > 8]
    return mixed(out)
