"""Licence scan: a trained paragraph classifier, confirmed by templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import hash_words, mix, slices, text_buffer, words_of_rows
from pulsegrid.session import freeze

# Paragraphs of public licence notices. Words in brackets name the licence: a
# paragraph without them is not taken for that notice, however alike the rest.
TEMPLATES = {
    "all-rights-reserved": [
        "[All rights reserved].",
        "[Unauthorized copying] of this file, via any medium, is strictly prohibited.",
    ],
    "apache": [
        "Licensed under the [Apache License], Version 2.0.",
        'Licensed under the [Apache License], Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at",
        "you may not use this file [except in compliance with the License]",
        "Unless required by applicable law or agreed to in writing, software [distributed under the License is distributed] on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-[Identifier: Apache]-2.0",
    ],
    "bsd": [
        "[Redistribution and use] in source and binary forms, with or without modification, are permitted",
        "[Redistribution and use] in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
        "[Redistributions of source code] must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "[Redistributions in binary form] must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        "[Neither the name of] the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
        "Use of this source code is governed by a [BSD-style] license",
        "Released under the [BSD License].",
        "SPDX-License-[Identifier: BSD]-3-Clause",
    ],
    "cc-by": [
        "Licensed under [CC BY 4.0].",
        "This work is licensed under a Creative Commons [Attribution 4.0] International License",
    ],
    "cc-by-nc": [
        "Licensed under [CC BY-NC] 4.0.",
        "This work is licensed under a Creative Commons [Attribution-NonCommercial 4.0] International License",
    ],
    "cc-by-sa": [
        "Licensed under [CC BY-SA] 4.0.",
        "This work is licensed under a Creative Commons [Attribution-ShareAlike 4.0] International License",
    ],
    "gpl": [
        "This work is licensed under the [GNU General Public License], version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public License]",
        "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public License] "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the [GNU General Public License] for more details.",
        "You should have received a copy of the [GNU General Public License] along with this program.",
        "SPDX-License-[Identifier: GPL]-3.0-or-later",
    ],
    "mit": [
        "Released under the [MIT License].",
        "[Permission is hereby granted], free of charge, to any person obtaining a copy of this software",
        "[Permission is hereby granted], free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice [shall be included] in all copies or substantial portions of the Software.",
        "SPDX-License-[Identifier: MIT]",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the [Mozilla Public License], v. 2.0.",
        "Licensed under the [Mozilla Public License], version 2.0.",
    ],
    "public-domain": [
        "This work is released into the [public domain].",
        "This is free and [unencumbered software] released into the public domain.",
        "To the extent possible under law, the author has [waived all copyright] under CC0 1.0.",
    ],
}
# Words of paragraphs that may speak of a licence of which there is no template.
HINTS = ("license", "licence", "licensed", "licenced", "copyright")
UNKNOWN = "unknown"
# First bytes of lines in comment blocks, and what ends a sentence.
COMMENT_MARKS = np.frombuffer(b"#/*;%<!>|-", np.uint8)
SENTENCE_ENDS = np.frombuffer(b".!?", np.uint8)
WIDE_SENTENCE_ENDS = [np.frombuffer(c.encode(), np.uint8) for c in "。！？"]
# Characters of the longest line that counts as wrapped.
WRAP_WIDTH = 120
# Steps of probability in which the limit for naming a family is calibrated.
STEPS = 1000


def _features(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, pairs and triples of each row, their rows, and how many words each has."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out, rows, size = [h], [row], [np.ones(len(h), np.int8)]
    for k in (2, 3):
        if len(h) < k:
            break
        g = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        own = row[: len(g)] == row[k - 1 :]
        out.append(mix(g[own] + np.uint64(k)))
        rows.append(row[: len(g)][own])
        size.append(np.full(int(own.sum()), k, np.int8))
    return np.concatenate(out), np.concatenate(rows), np.concatenate(size)


def _of_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _features(*words_of_rows(pa.array(texts, pa.string())))


@dataclass
class Templates:
    """The word pairs of each template (none for templates of one word), the triples, pairs or words that name it, and its family."""

    families: list[str]
    family: np.ndarray
    keys: np.ndarray
    phrases: list[np.ndarray]
    sizes: np.ndarray
    names: list[np.ndarray]

    @classmethod
    def build(cls, templates: dict[str, list[str]]) -> Templates:
        families = sorted(templates)
        marked = [p for f in families for p in templates[f]]
        h, row, size = _of_texts([re.sub(r"[\[\]]", " ", p) for p in marked])
        pairs = [np.unique(h[(row == k) & (size == 2)]) for k in range(len(marked))]
        named = []
        for phrase in marked:
            grams = [_of_texts([name]) for name in re.findall(r"\[(.*?)\]", phrase)]
            named.append(np.unique(np.concatenate([g[z == z.max()] for g, _, z in grams if len(g)] or [h[:0]])))
        keys = np.unique(np.concatenate([*pairs, *named, h[:0]]))
        return cls(
            families,
            np.array([families.index(f) for f in families for _ in templates[f]]),
            keys,
            [np.searchsorted(keys, own) for own in pairs],
            np.array([max(len(own), 1) for own in pairs]),
            [np.searchsorted(keys, own) for own in named],
        )

    def similarity(self, h: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row and family: the largest share of a template's word pairs that the row holds, the same
        among the templates whose naming words it holds, and whether there is such a template."""
        out, sure = np.zeros((rows, len(self.families))), np.zeros((rows, len(self.families)))
        named = np.zeros((rows, len(self.families)), bool)
        if not len(self.keys):
            return out, sure, named
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == h)
        some, of = np.unique(row[hit], return_inverse=True)
        # so many rows at once that their marks take some megabytes
        step = max((1 << 23) // len(self.keys), 1)
        for first in range(0, len(some), step):
            these = some[first : first + step]
            there = np.zeros((len(these), len(self.keys)), bool)
            mine = (of >= first) & (of < first + step)
            there[of[mine] - first, at[hit[mine]]] = True
            for k, pairs in enumerate(self.phrases):
                share = there[:, pairs].sum(axis=1) / self.sizes[k]
                name = there[:, self.names[k]].all(axis=1)
                f = self.family[k]
                out[these, f] = np.maximum(out[these, f], share)
                sure[these, f] = np.maximum(sure[these, f], share * name)
                named[these, f] |= name
        return out, sure, named


@dataclass
class LicenceModel:
    """Softmax weights of word n-grams for the families and for no licence; calibrated least probability."""

    templates: Templates
    features: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    least: float

    def shares(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows that hold any feature and their probabilities of each family and of no licence."""
        if not len(self.features):
            return np.empty(0, np.int64), np.empty((0, len(self.bias)))
        at = np.minimum(np.searchsorted(self.features, h), len(self.features) - 1)
        hit = self.features[at] == h
        pair = np.unique(row[hit] * len(self.features) + at[hit])
        some, begin = np.unique(pair // len(self.features), return_index=True)
        if not len(some):
            return some, np.empty((0, len(self.bias)))
        return some, _softmax(np.add.reduceat(self.weights[pair % len(self.features)], begin, axis=0) + self.bias)


def _paragraphs(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their bounds by paragraph, and each paragraph's row, first line and number of lines.

    A paragraph is a run of lines with words. A line without words ends it,
    and so does the step into or out of a comment block (lines that begin with a
    comment mark). A line of more than ``WRAP_WIDTH`` characters is no part
    of wrapped text and stands alone. In texts that have no empty line between others, a line
    outside of comments that ends a sentence ends it too.
    """
    data, offsets = text_buffer(batch.column(at))
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate((offsets[:-1], breaks[breaks < len(data)])))
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    begin, end, h = hash_words(data, starts)
    bounds = np.searchsorted(begin, np.append(starts, len(data)))
    row = np.searchsorted(offsets, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(starts, offsets[row])
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return h, np.zeros(1, np.int64), full, full, full
    limits = np.append(starts, len(data))
    comment = _begins_with(data, starts[full], COMMENT_MARKS)
    over = np.diff(full) > 1
    same_row = row[full[1:]] == row[full[:-1]]
    spaced = np.isin(row[full], row[full[1:]][over & same_row])
    last = end[bounds[full + 1] - 1]
    ended = _holds(data, last, limits[full + 1], SENTENCE_ENDS)
    for mark in WIDE_SENTENCE_ENDS:
        there = last >= len(mark)
        for k, byte in enumerate(mark):
            there &= data[np.maximum(last - len(mark) + k, 0)] == byte
        ended |= there
    wide = (np.add.reduceat(((data & 0xC0) != 0x80) & (data != 10), starts, dtype=np.int64) > WRAP_WIDTH)[full]
    cut = np.ones(len(full), bool)
    cut[1:] = ~same_row | over | (comment[1:] != comment[:-1]) | (ended & ~comment & ~spaced)[:-1] | wide[1:] | wide[:-1]
    first = np.flatnonzero(cut)
    stop = np.append(first[1:], len(full))
    return h, np.append(bounds[full[first]], len(h)), row[full[first]], number[full[first]], full[stop - 1] - full[first] + 1


def _begins_with(data: np.ndarray, starts: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether the first byte of each line that is no blank is one of the marks."""
    solid = np.flatnonzero(~np.isin(data, np.frombuffer(b" \t\r", np.uint8)))
    return np.isin(data[solid[np.searchsorted(solid, starts)]], marks)


def _holds(data: np.ndarray, start: np.ndarray, stop: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether any of the marks lies between start and stop."""
    places = np.flatnonzero(np.isin(data, marks))
    return np.searchsorted(places, start) < np.searchsorted(places, stop)


def _samples(
    docs: DataFrame, templates: Templates, *, alike: float, unlike: float, hints: tuple[str, ...], max_like: int, max_other: int, max_grams: int, text: str
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """N-gram hashes of paragraphs that look like a template and of others, their families (-1 for others), words of others.

    All paragraphs of the corpus are drawn from; a task keeps those with the
    smallest hashes of their words, so no more than that leaves it.
    """
    most = {True: max_like, False: max_other}
    hinting = words_of_rows(pa.array(hints, pa.string()))[0]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, dict[int, tuple[int, bytes, bytes]]] = {True: {}, False: {}}
        limit = {True: 1 << 64, False: 1 << 64}
        for batch in slices(batches, "__text"):
            h, bounds, of_row, _, _ = _paragraphs(batch, 0)
            if not len(of_row):
                continue
            key = mix(np.add.reduceat(mix(h), bounds[:-1]))
            grams, row, _ = _features(h, bounds)
            alikeness = templates.similarity(grams, row, len(of_row))[0]
            best, highest = alikeness.argmax(axis=1), alikeness.max(axis=1)
            plain = np.add.reduceat(np.isin(h, hinting).astype(np.int64), bounds[:-1]) == 0
            order = np.argsort(row, kind="stable")
            grams, edges = grams[order], np.searchsorted(row[order], np.arange(len(of_row) + 1))
            for kind, fits in ((True, highest >= alike), (False, plain & (highest < unlike))):
                own = held[kind]
                for k in np.flatnonzero(fits & (key <= np.uint64(limit[kind] - 1))).tolist():
                    if int(key[k]) not in own:
                        mine = np.unique(grams[edges[k] : edges[k + 1]])[:max_grams]
                        some = h[bounds[k] : min(bounds[k + 1], bounds[k] + 12)]
                        own[int(key[k])] = (int(best[k]) if kind else -1, mine.tobytes(), some.tobytes())
                    if len(own) >= 2 * most[kind] + 1:
                        for extra in sorted(own)[most[kind] :]:
                            del own[extra]
                        limit[kind] = max(own, default=1)
        for kind, own in held.items():
            keys = sorted(own)[: most[kind]]
            yield pa.record_batch(
                [
                    pa.array(np.array(keys, np.uint64).view(np.int64)),
                    pa.array([own[k][0] for k in keys], pa.int32()),
                    pa.array([own[k][1] for k in keys], pa.binary()),
                    pa.array([own[k][2] for k in keys], pa.binary()),
                ],
                names=["key", "family", "grams", "words"],
            )

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("__text"))
    rows = rows.mapInArrow(find, "key bigint, family int, grams binary, words binary")
    rows = freeze(rows.dropDuplicates(["key"]))
    chosen = [r for kind, number in most.items() for r in rows.where((F.col("family") >= 0) == kind).orderBy("key").limit(number).collect()]
    words = [np.frombuffer(r["words"], np.uint64) for r in chosen if r["family"] < 0][:500]
    return (
        [np.frombuffer(r["grams"], np.uint64) for r in chosen],
        np.array([r["family"] for r in chosen], np.int64),
        np.concatenate([*words, np.empty(0, np.uint64)]),
    )


def _grams(words: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct n-grams of each list of word hashes."""
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    h, row, _ = _features(np.concatenate([*words, np.empty(0, np.uint64)]), bounds)
    order = np.argsort(row, kind="stable")
    return [np.unique(g) for g in np.split(h[order], np.searchsorted(row[order], np.arange(1, len(words))))] if words else []


def _variants(phrases: list[str], draw: np.random.Generator, fillers: np.ndarray, each: int) -> list[np.ndarray]:
    """Word hashes of the templates, with words left out at random and other words around them."""
    h, bounds = words_of_rows(pa.array([re.sub(r"[\[\]]", " ", p) for p in phrases], pa.string()))
    out = [h[a:b] for a, b in zip(bounds, bounds[1:])]
    for words in list(out):
        for _ in range(each):
            kept = words[draw.random(len(words)) > 0.1]
            around = [draw.choice(fillers, int(draw.integers(0, 6))) if len(fillers) else fillers for _ in range(2)]
            out.append(np.concatenate((around[0], kept if len(kept) else words, around[1])))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _softmax_fit(
    x: np.ndarray, y: np.ndarray, times: np.ndarray, classes: int, *, steps: int = 300, rate: float = 0.1, ridge: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression, every class with the same total weight; a row counts ``times``."""
    weights, bias = np.zeros((x.shape[1], classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    count = (target * times[:, None]).sum(axis=0)
    share = times * (1 / np.maximum(count, 1))[y] / max((count > 0).sum(), 1)
    state = [np.zeros((x.shape[1] + 1, classes)) for _ in range(2)]
    for step in range(1, steps + 1):
        error = (_softmax(x @ weights.astype(np.float32) + bias) - target) * share[:, None]
        grad = np.vstack((x.T @ error.astype(np.float32) + ridge * weights, error.sum(axis=0)))
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


def fit(
    docs: DataFrame,
    *,
    templates: dict[str, list[str]] | None = None,
    alike: float = 0.8,
    unlike: float = 0.3,
    hints: tuple[str, ...] = HINTS,
    max_like: int = 4_000,
    max_other: int = 4_000,
    max_grams: int = 1_000,
    max_features: int = 3_000,
    text: str = "text",
    seed: int = 5,
) -> LicenceModel:
    """Train on templates, varied at random, and on a bounded sample of the corpus' own paragraphs.

    A paragraph of the corpus that holds ``alike`` of the word pairs of a template is
    an example of its family; one that holds less than ``unlike`` of each, and none
    of the words ``hints``, is an example of no licence. Of both the distinct ones with the smallest hashes are
    taken, ``max_like`` and ``max_other`` at most, each with ``max_grams`` of its
    n-grams at most; weights are kept for ``max_features`` n-grams.

    The least probability at which a family is named is calibrated on
    all paragraphs of the corpus: no more than 0.1 % of those unlike each
    template reach it; it is 0.5 at least.

    Null and empty texts have no paragraphs. Repeated paragraphs count once as
    examples and each time in the calibration. A very long text is cut into its
    paragraphs like others. Without any document the templates alone teach.
    """
    given = templates or TEMPLATES
    known = Templates.build(given)
    grams, family, fillers = _samples(
        docs, known, alike=alike, unlike=unlike, hints=hints, max_like=max_like, max_other=max_other, max_grams=max_grams, text=text
    )
    draw = np.random.default_rng(seed)
    none = len(known.families)
    labels = list(np.where(family < 0, none, family))
    for k, name in enumerate(known.families):
        more = _grams(_variants(given[name], draw, fillers, 40))
        grams += more
        labels += [k] * len(more)
    # plain words without any licence, so that there are examples even without a corpus
    plain = _grams([draw.choice(fillers, 12) for _ in range(200)] if len(fillers) else [fillers])
    grams += plain
    labels += [none] * len(plain)
    y = np.array(labels, np.int64)
    row = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    every, at = np.unique(np.concatenate(grams), return_inverse=True)
    positive = y[row] != none
    p = np.bincount(at[positive], minlength=len(every))
    n = np.bincount(at[~positive], minlength=len(every))
    total_p, total_n = max((y != none).sum(), 1), max((y == none).sum(), 1)
    good = np.flatnonzero((p >= 5) & (p / total_p > 4 * n / total_n))
    score = (p / total_p - n / total_n)[good]
    features = every[np.sort(good[np.argsort(-score, kind="stable")[:max_features]])]
    column = np.searchsorted(features, every)
    hit = np.isin(every, features)[at]
    x = np.zeros((len(grams), len(features)), bool)
    x[row[hit], column[at[hit]]] = True
    # most examples of no licence hold no feature at all: equal rows are one
    _, first, times = np.unique(np.column_stack((np.packbits(x, axis=1), y[:, None].astype(np.uint16).view(np.uint8))), axis=0, return_index=True, return_counts=True)
    weights, bias = _softmax_fit(x[first].astype(np.float32), y[first], times, none + 1)
    model = LicenceModel(known, features, weights, bias, 0.5)
    model.least = max(0.5, _limit(docs, model, unlike, text))
    return model


def _limit(docs: DataFrame, model: LicenceModel, unlike: float, text: str, share: float = 0.001) -> float:
    """The probability of a family that at most ``share`` of all paragraphs unlike each template exceed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(STEPS + 1, np.int64)
        for batch in slices(batches, "__text"):
            h, bounds, of_row, _, _ = _paragraphs(batch, 0)
            if not len(of_row):
                continue
            h, row, _ = _features(h, bounds)
            other = model.templates.similarity(h, row, len(of_row))[0].max(axis=1) < unlike
            some, shares = model.shares(h, row)
            step = np.ceil(shares[other[some], :-1].max(axis=1) * STEPS).astype(np.int64) if len(some) else some
            found += np.bincount(step, minlength=STEPS + 1)
            found[0] += other.sum() - len(step)
        full = np.flatnonzero(found)
        yield pa.record_batch([pa.array(full), pa.array(found[full])], names=["step", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(count, "step bigint, n bigint")
    counts = np.zeros(STEPS + 1, np.int64)
    for r in rows.groupBy("step").agg(F.sum("n").alias("n")).collect():
        counts[r["step"]] = r["n"]
    above = counts.sum() - np.cumsum(counts)
    return float(np.argmax(above <= share * counts.sum()) / STEPS)


OUTPUT = ["paragraph", "n_lines", "family", "probability", "similarity", "confirmed"]


def scan(docs: DataFrame, model: LicenceModel, *, confirm: float = 0.6, text: str = "text") -> DataFrame:
    """A row for each paragraph that speaks of a licence.

    Returns the columns of ``docs`` without the text and ``paragraph`` (its first
    line, from 0), ``n_lines``, ``family``, ``probability``, ``similarity`` (the
    largest share of word pairs of a template of that family that it holds) and
    ``confirmed`` (at least ``confirm``, for a template whose naming words it
    holds). A paragraph that is likelier to be a licence than not is ``unknown``,
    and never confirmed, if its best family stays below the calibrated
    probability or if it holds the naming words of none of that family's templates.

    Columns of ``docs`` named like one of these are replaced. Null and empty texts
    give no rows; repeated rows are scanned each for itself; a very long text is
    cut into its paragraphs like others; of equally likely families the first by
    name is taken; no documents give no rows.
    """
    kept = [c for c in docs.columns if c not in (text, *OUTPUT)]
    schema = T.StructType(
        [
            *[docs.schema[c] for c in kept],
            T.StructField("paragraph", T.LongType()),
            T.StructField("n_lines", T.LongType()),
            T.StructField("family", T.StringType()),
            T.StructField("probability", T.DoubleType()),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("confirmed", T.BooleanType()),
        ]
    )
    names = np.array([*model.templates.families, UNKNOWN], dtype=object)
    none = len(model.templates.families)

    given = "__text" + "_" * max(len(c) for c in ["", *kept])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, given):
            h, bounds, of_row, number, lines = _paragraphs(batch, 0)
            if not len(of_row):
                continue
            h, row, _ = _features(h, bounds)
            some, share = model.shares(h, row)
            chosen = np.flatnonzero(share[:, none] < 0.5)
            some, share = some[chosen], share[chosen]
            if not len(some):
                continue
            best = share[:, :none].argmax(axis=1)
            every = np.arange(len(some))
            probability = share[every, best]
            mine = np.isin(row, some)
            alike, named_alike, named = (a[every, best] for a in model.templates.similarity(h[mine], np.searchsorted(some, row[mine]), len(some)))
            sure = (probability >= model.least) & named
            yield pa.record_batch(
                [
                    *[c.take(pa.array(of_row[some])) for c in batch.columns[1:]],
                    pa.array(number[some]), pa.array(lines[some]), pa.array(names[np.where(sure, best, none)].tolist(), pa.string()),
                    pa.array(probability), pa.array(alike), pa.array(sure & (named_alike >= confirm)),
                ],
                names=schema.names,
            )

    rows = docs.select(F.col(f"`{text}`").cast("string").alias(given), *[F.col(f"`{c}`") for c in kept])
    return rows.mapInArrow(classify, schema)
