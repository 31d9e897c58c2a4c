"""Licence scans: a trained paragraph classifier whose finds a template must confirm.

Paragraphs are parted by blank lines; long ones are read in windows of ``WINDOW`` words
that overlap by half, so that whole texts are read.  A window is described by the word
1-, 2- and 3-grams it shares with the templates, and a multinomial logistic regression
gives each licence family, and the class of everything else, a probability.  The
probabilities are tempered on held-out examples.  A family is confirmed if the window
also holds most word pairs of one of that family's templates.  A window may hold several
notices, so each confirmed family is judged on the window and on the words around its own
matches, and every family that is most likely on one of them is told.  The parts of an SPDX
expression are read as an identifier each.

The regression is fitted on varied copies of the templates and on a bounded sample of
``SAMPLE`` paragraphs of the corpus, those of the least hashes, each by its first
``SAMPLE_CHARS`` characters; a paragraph that holds a template is left out.  Fitting is
seeded, so reruns agree.  The scan itself covers all rows and whole texts.

Defined cases: a null, empty or blank text has no paragraphs and no finds; rows are
scanned one by one, so repeated rows and ids get equal results; on an empty table the
fit uses the templates alone and the result is empty.  Only the id and the text are read;
extra columns do not appear.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import row_key, slices, text_of

#: Words of a window.
WINDOW = 96
#: Share of a template's word pairs that a window must hold to confirm the family.
CONFIRM = 0.7
#: Calibrated probability from which a family is told.
CERTAIN = 0.5
#: Paragraphs of the corpus the classifier is fitted on at most, and their characters.
SAMPLE = 2000
SAMPLE_CHARS = 600
#: Varied copies of each template, examples of the other class from ``OTHERS``, and steps of the fit.
COPIES = 24
STEPS = 300
SEED = 42

UNKNOWN = "unknown"

# Notices by licence family (fixed values: the wordings of the licences themselves).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "use of this source code is governed by a BSD-style license",
        "released under the BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc0": (
        "has dedicated the work to the public domain by waiving all rights",
        "released under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "cc-by": (
        "licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ),
    "cc-by-nc": (
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ),
    "cc-by-sa": (
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted",
        "released under the ISC License",
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License, version 3",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain",
    ),
}

# Sentences that speak of licences without granting one (fixed values).
OTHERS = (
    "The driver lost the driving license after the accident in the city",
    "A license fee is paid every year by each household that owns a television",
    "The software was released under pressure in the first week of the month",
    "The committee discussed whether the license of the radio station should be renewed",
    "The public library is open to any person free of charge",
    "Permission to build the bridge was granted by the council with conditions",
    "The terms of the agreement were published in the newspaper",
    "Copyright law differs from country to country and changed over the years",
)

_find = re.compile(r"[^\W_]+(?:[.+][^\W_]+)*").findall
_BREAK = re.compile(r"\n[\x20\t\r\x0b\f]*\n")


def words_of_notice(text: str) -> list[str]:
    return _find(text.lower())


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def grams(words: list[str]) -> set[tuple[str, ...]]:
    return {*zip(words), *zip(words, words[1:]), *zip(words, words[1:], words[2:])}


def paragraphs(text: str) -> list[str]:
    return [p for p in _BREAK.split(text) if not p.isspace() and p]


def windows(words: list[str], size: int = WINDOW) -> list[list[str]]:
    return [words[k : k + size] for k in range(0, max(1, len(words) - size // 2), size // 2)]


_SPDX = re.compile(r"SPDX-License-Identifier:[^\n]*", re.IGNORECASE)
_PART = re.compile(r"[\s()]+(?:OR|AND)[\s()]+")


def parted(text: str) -> str:
    """The text with one identifier line for each part of an SPDX expression."""
    return _SPDX.sub(lambda m: _PART.sub("\nSPDX-License-Identifier: ", m[0]), text)


_TEMPLATE_PAIRS = [(family, frozenset(pairs_of(words_of_notice(t)))) for family, ts in TEMPLATES.items() for t in ts]
_WORDS_OF = {f: set().union(*map(words_of_notice, ts)) for f, ts in TEMPLATES.items()}
#: Per template its words that no other family's templates have; a stretch without any is not the template's.
_OWN = [
    frozenset(words_of_notice(t)) - set().union(*(w for g, w in _WORDS_OF.items() if g != f))
    for f, ts in TEMPLATES.items()
    for t in ts
]
_ANY_PAIR = frozenset().union(*(p for _, p in _TEMPLATE_PAIRS))
#: No template is confirmed by fewer word pairs.
_LEAST = min(-(-int(CONFIRM * 100) * len(p) // 100) for _, p in _TEMPLATE_PAIRS)


def confirmed(words: list[str]) -> dict[str, float]:
    """Per family the largest share of a template's word pairs that the window holds."""
    held = pairs_of(words) & _ANY_PAIR
    best: dict[str, float] = {}
    if len(held) >= _LEAST:
        for family, pairs in _TEMPLATE_PAIRS:
            share = len(held & pairs) / len(pairs)
            if share >= CONFIRM:
                best[family] = max(share, best.get(family, 0.0))
    return best


def spans(words: list[str], pairs: frozenset[tuple[str, str]]) -> list[list[str]]:
    """The words around each shortest stretch that confirms a template, widened by the pairs it lacks."""
    hits = [k for k, p in enumerate(zip(words, words[1:])) if p in pairs]
    need, held, start, found = -(-round(CONFIRM * 100) * len(pairs) // 100), {}, 0, []
    for at in hits:
        pair = words[at], words[at + 1]
        held[pair] = held.get(pair, 0) + 1
        least = None
        while len(held) >= need:
            least = hits[start]
            gone = words[least], words[least + 1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            start += 1
        if least is not None:
            more = len(pairs) - need
            found.append(words[max(0, least - more) : at + 2 + more])
    return found


class Model(NamedTuple):
    """``features`` gives the row of ``weights`` of a gram; the last row is the bias."""

    classes: list[str]
    features: dict[tuple[str, ...], int]
    weights: np.ndarray
    temperature: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        rows = sorted(self.features[g] for g in grams(words) & self.features.keys())
        return _softmax((self.weights[rows].sum(axis=0) + self.weights[-1]) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def examples(sample: list[str], copies: int = COPIES, seed: int = SEED) -> list[tuple[list[str], str]]:
    """(words, class): varied templates among words of the sample, and the rest of the corpus."""
    rng = np.random.default_rng(seed)
    plain = [w for w in map(words_of_notice, [*sample, *OTHERS]) if len(w) > 1 and not confirmed(w)]
    made = [(w, UNKNOWN) for w in plain]
    made += [(words_of_notice(o), UNKNOWN) for o in OTHERS for _ in range(copies)]
    for family, notices in TEMPLATES.items():
        for words in map(words_of_notice, notices):
            for k in range(copies):
                kept = [w for w in words if k == 0 or rng.random() > 0.06] or words
                around = plain[rng.integers(len(plain))][: int(rng.integers(0, 40)) if k else 0]
                cut = int(rng.integers(0, len(around) + 1))
                made.append((around[:cut] + kept + around[cut:], family))
    order = rng.permutation(len(made))
    return [made[k] for k in order]


def fit(made: list[tuple[list[str], str]], steps: int = STEPS, rate: float = 4.0, decay: float = 1e-5) -> Model:
    """Multinomial regression by full gradients; every fifth example is held out for the temperature."""
    classes = sorted({*TEMPLATES, UNKNOWN})
    vocabulary = sorted(set().union(*(grams(words_of_notice(t)) for ts in TEMPLATES.values() for t in ts)))
    features = {g: k for k, g in enumerate(vocabulary)}
    x = np.zeros((len(made), len(features) + 1), np.float32)
    x[:, -1] = 1
    for row, (words, _) in enumerate(made):
        x[row, [features[g] for g in grams(words) & features.keys()]] = 1
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(c) for _, c in made]]
    held = np.arange(len(made)) % 5 == 0
    weight = 1 / y.sum(axis=0).clip(1)
    share = (y @ weight)[~held]
    share /= share.sum()
    weights = np.zeros((x.shape[1], len(classes)), np.float32)
    learn, target = x[~held], y[~held]
    for _ in range(steps):
        weights -= rate * (learn.T @ ((_softmax(learn @ weights) - target) * share[:, None]) + decay * weights)
    scores = x[held] @ weights

    def loss(temperature: float) -> float:
        return -float(np.log(_softmax(scores / temperature)[y[held] > 0].clip(1e-9)).mean())

    best = min((exp(k / 8) for k in range(-16, 9)), key=loss)
    return Model(classes, features, weights.astype(np.float64), best)


class Find(NamedTuple):
    paragraph: int
    family: str
    probability: float
    similarity: float


def scan(text: str, model: Model) -> tuple[int, list[Find]]:
    """Number of paragraphs and the confirmed families of each, by order."""
    parts, finds = paragraphs(text), []
    for number, part in enumerate(parts):
        words = words_of_notice(parted(part))
        if len(pairs_of(words) & _ANY_PAIR) < _LEAST:
            continue
        best: dict[str, Find] = {}
        for window in windows(words):
            likely = confirmed(window)
            if not likely:
                continue
            around = [
                (f, s)
                for (f, pairs), own in zip(_TEMPLATE_PAIRS, _OWN)
                if f in likely
                for s in spans(window, pairs)
                if not own or own & set(s)
            ]
            for only, judged in [(None, window), *around]:
                found = model.probabilities(judged)
                top = int(np.argmax(found))
                family = model.classes[top]
                if family in likely and only in (None, family) and found[top] >= CERTAIN:
                    find = Find(number, family, round(float(found[top]), 4), round(likely[family], 4))
                    best[family] = max(find, best.get(family, find), key=lambda f: f.probability)
        finds += [best[f] for f in sorted(best)]
    return len(parts), finds


def sample_of(docs: DataFrame, text: str = "text", n: int = SAMPLE) -> list[str]:
    """The paragraphs of the least hashes, a bounded number of bounded length."""
    parts = docs.select(F.explode(F.split(text_of(text), r"\n[\x20\t\r\x0B\f]*\n")).alias("part")).select(
        F.left("part", F.lit(SAMPLE_CHARS)).alias("part")
    )
    least = parts.filter(F.length(F.trim("part")) > 0).orderBy(F.xxhash64("part"), "part").limit(n)
    return [row["part"] for row in least.collect()]


def train(docs: DataFrame, text: str = "text", seed: int = SEED) -> Model:
    return fit(examples(sample_of(docs, text), seed=seed))


def finds(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, row, n_paragraphs, finds) per row of ``docs``; finds hold paragraph, family, probability, similarity."""
    rows = docs.select(F.col(key).alias("id"), row_key(text).alias("row"), text_of(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    find = pa.list_(
        pa.struct(
            [("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            scanned = [scan(t.as_py(), model) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("row"),
                    pa.array([n for n, _ in scanned], pa.int64()),
                    pa.array([[f._asdict() for f in fs] for _, fs in scanned], find),
                ],
                ["id", "row", "n_paragraphs", "finds"],
            )

    return rows.mapInArrow(
        run,
        f"id {kind}, row bigint, n_paragraphs bigint, "
        "finds array<struct<paragraph:int,family:string,probability:double,similarity:double>>",
    )
