"""Byte-level BPE through a sentencepiece model made from the vocabulary itself.

The model is written out as it would be after training: one piece per token, its
bytes mapped to one printable character each, scored by the negative rank, with
identity normalisation.  The merge of the highest score is then the merge of the
lowest rank, so that the library yields the ids of the rank file.  Nothing is trained.

Texts are cut by the split pattern first.  A task encodes each different pre-token
of a batch once; ids come back as arrays, and decoding maps ids to bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; special
strings are ordinary text; rows are encoded one by one, so repeated rows and ids
are kept; an empty table gives an empty result; an id outside the vocabulary is an
error.  Only the named columns are read; extra columns do not appear.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import row_key, slices, text_of

#: Pre-tokens a worker remembers; the memory is only a shortcut.
REMEMBER = 400_000

# Field numbers and values of the sentencepiece model format (fixed values).
_MODEL_PIECE, _MODEL_TRAINER, _MODEL_NORMALIZER = 1, 2, 3
_PIECE_TEXT, _PIECE_SCORE, _PIECE_TYPE, _TYPE_UNKNOWN = 1, 2, 3, 2
_TRAINER_TYPE, _TYPE_BPE, _TRAINER_SIZE, _TRAINER_BOS, _TRAINER_EOS = 3, 2, 4, 41, 42
_NORM_NAME, _NORM_DUMMY_PREFIX, _NORM_EXTRA_SPACES, _NORM_ESCAPE_SPACES = 1, 3, 4, 5


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"{path}: the ranks have gaps")
    return tokens


def byte_characters() -> dict[int, str]:
    """One printable character per byte: itself where it is one, else the next from U+0100."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & (1 << 64) - 1)


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _score(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model; piece 0 is the unknown piece, piece r + 1 has rank r."""
    shown = byte_characters()
    unknown = _block(_PIECE_TEXT, b"<unk>") + _score(_PIECE_SCORE, 0.0) + _number(_PIECE_TYPE, _TYPE_UNKNOWN)
    parts = [_block(_MODEL_PIECE, unknown)]
    for rank, token in enumerate(tokens):
        text = "".join(shown[b] for b in token).encode()
        parts.append(_block(_MODEL_PIECE, _block(_PIECE_TEXT, text) + _score(_PIECE_SCORE, -float(rank))))
    trainer = _number(_TRAINER_TYPE, _TYPE_BPE) + _number(_TRAINER_SIZE, len(tokens) + 1)
    trainer += _number(_TRAINER_BOS, -1) + _number(_TRAINER_EOS, -1)
    norm = _block(_NORM_NAME, b"identity") + _number(_NORM_DUMMY_PREFIX, 0)
    norm += _number(_NORM_EXTRA_SPACES, 0) + _number(_NORM_ESCAPE_SPACES, 0)
    return b"".join([*parts, _block(_MODEL_TRAINER, trainer), _block(_MODEL_NORMALIZER, norm)])


class Codec:
    """Encodes and decodes single texts; made once per worker."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens = tokens
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(tokens))
        self.shown = byte_characters()
        self.known: dict[str, list[int]] = {}

    def _learn(self, parts: list[str]) -> None:
        if len(self.known) + len(parts) > REMEMBER:
            self.known.clear()
        mapped = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown) for p in parts]
        for part, pieces in zip(parts, self.model.encode(mapped, num_threads=1)):
            self.known[part] = [piece - 1 for piece in pieces]

    def encode(self, text: str) -> list[int]:
        parts = self.split(text)
        unknown = set(parts).difference(self.known)
        if not unknown:
            return list(chain.from_iterable(map(self.known.__getitem__, parts)))
        if len(unknown) > REMEMBER:  # a text with more pre-tokens than are remembered
            ids: list[int] = []
            for k in range(0, len(parts), REMEMBER // 2):
                self._learn(sorted(set(parts[k : k + REMEMBER // 2])))
                ids.extend(chain.from_iterable(map(self.known.__getitem__, parts[k : k + REMEMBER // 2])))
            return ids
        if len(self.known) + len(unknown) > REMEMBER:
            self.known.clear()
            unknown = set(parts)
        self._learn(sorted(unknown))
        return list(chain.from_iterable(map(self.known.__getitem__, parts)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(
    docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, row, ids) and the columns to ``carry`` per row of ``docs``; ``ranks`` is a path every executor can read."""
    rows = docs.select(F.col(key).alias("id"), row_key(text).alias("row"), *[F.col(f"`{c}`") for c in carry], text_of(text).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in slices(batches, "text"):
            found = [np.array(codec.encode(t.as_py()), dtype=np.int32) for t in batch.column(batch.num_columns - 1)]
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(offsets, np.concatenate(found) if found else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "ids"])

    return rows.mapInArrow(run, f"{kinds}, ids array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str, carry: Sequence[str] = ()) -> DataFrame:
    """``encode``'s result with ``decoded``, the bytes of the ids."""
    rows = encoded.select("id", "row", *[F.col(f"`{c}`") for c in carry], "ids")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in slices(batches, "ids"):
            decoded = pa.array([codec.decode(ids.values.to_numpy()) for ids in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{kinds}, decoded binary")
