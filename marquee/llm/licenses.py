"""License scans: a trained paragraph classifier, calibrated, and confirmed by templates.

A paragraph is a line of a text. Its features are the distinct words, word pairs and word triples
that also occur in a template; a multinomial logistic regression over them gives each licence family
and "unknown" a probability. The model is fitted on variants of the templates (words dropped, prose
around them) and on prose of the corpus with template words scattered in it; a temperature, fitted on
variants that the weights have not seen, calibrates it. The classifier names the family first; the
family is confirmed if the paragraph and one of its templates contain enough of one another. A
paragraph with too few of the templates' n-grams for any of them is unknown.

A line is classified as a whole and, where it has more words, in overlapping windows of each length
in WINDOWS; the families of all of them are the line's. Any run of words up to three quarters of a
window lies whole in one, so a template is always met in a window that it mostly fills, however long
the line is and whatever other notices it has. Windows are confirmed by the templates they contain;
only a whole line counts as part of a template. What mostly lies within a better match of another
family is that family's.

A null or empty text has no paragraphs and no licence. Rows with equal ids are scanned one by one;
very long texts are read whole, block by block. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.textbytes import byte_table, column_bytes, join_words, word_sequences

# Calibrated probability that a prediction needs, and share of n-grams that confirms it.
LEAST_PROBABILITY = 0.5
LEAST_SIMILARITY = 0.75
# A paragraph that lies within a template needs this many words to count as part of it.
LEAST_WORDS = 5
# Bounds of the sample of prose that the unknown class is fitted on, and characters of one of its
# paragraphs.
PROSE_TEXTS = 300
PROSE_PARAGRAPHS = 1_500
PIECE = 4_096
VARIANTS = 40
NGRAMS = 3
# Words in a window; windows of a length start every quarter of it. The longest template fits into
# three quarters of the last.
WINDOWS = (8, 16, 32, 64)
# N-grams of windows that are compared with the templates at a time.
COMPARED = 1 << 18

# Families and their usual notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files, to deal in the Software without restriction",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
        "Licensed under the ISC License.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "All-rights-reserved": [
        "All rights reserved. No part of this work may be reproduced without permission.",
    ],
}
FAMILIES = ["unknown", *TEMPLATES]

_LETTERS = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of all lines; every text ends one."""
    return np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))


def ngrams(
    data: np.ndarray, offsets: np.ndarray
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of paragraphs: first, last, n-gram hashes, the word each starts at and the word
    behind it, and the first word of each paragraph with the number of words at the end."""
    member, to = byte_table(_LETTERS)
    for first, last, words, owner in word_sequences(data, offsets, member, to):
        at = np.arange(len(words))
        hashes, begins, ends = [words], [at], [at + 1]
        for n in range(2, NGRAMS + 1):
            same = owner[n - 1 :] == owner[: len(owner) - n + 1]
            parts = [words[i : len(words) - n + 1 + i][same] for i in range(n)] if len(words) >= n else []
            if parts:
                hashes.append(join_words(parts))
                begins.append(at[: len(words) - n + 1][same])
                ends.append(begins[-1] + n)
        bounds = np.append(0, np.cumsum(np.bincount(owner, minlength=last - first)))
        yield first, last, np.concatenate(hashes), np.concatenate(begins), np.concatenate(ends), bounds


def windows(
    begins: np.ndarray, ends: np.ndarray, bounds: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, line, window) for each window of `width` words in longer lines that an n-gram lies in.

    Windows start every quarter of their width and are numbered through the block, in order; the
    last of a line reaches its end.
    """
    step = width // 4
    size = np.diff(bounds)
    count = np.where(size > width, -(-(size - width) // step) + 1, 0)
    before = np.append(0, np.cumsum(count))
    line = np.searchsorted(bounds, begins, side="right") - 1
    low = np.maximum(-(-(ends - bounds[line] - width) // step), 0)
    high = np.minimum((begins - bounds[line]) // step, count[line] - 1)
    times = np.maximum(high - low + 1, 0)
    gram = np.repeat(np.arange(len(begins)), times)
    nth = np.arange(len(gram)) - np.repeat(np.cumsum(times) - times, times)
    return gram, line[gram], before[line[gram]] + low[gram] + nth


def _grams_of(paragraphs: list[str]) -> list[np.ndarray]:
    """Distinct n-grams of each paragraph."""
    data, offsets = column_bytes(pa.array(paragraphs, pa.string()))
    out: list[np.ndarray] = []
    for first, last, hashes, begins, _, bounds in ngrams(data, offsets):
        owner = np.searchsorted(bounds, begins, side="right") - 1
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(last - first + 1))
        out += [np.unique(hashes[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
    return out


class Model:
    """Weights of the n-grams that templates have, and the templates' own n-grams."""

    def __init__(self, prose: list[str], seed: int = 0) -> None:
        self.templates = [(f, t) for f, texts in TEMPLATES.items() for t in texts]
        grams = _grams_of([t for _, t in self.templates])
        self.grams = np.unique(np.concatenate(grams))
        # per template, which of the n-grams it has
        self.has = np.zeros((len(grams), len(self.grams)), bool)
        for i, own in enumerate(grams):
            self.has[i, np.searchsorted(self.grams, own)] = True
        self.family = np.array([FAMILIES.index(f) for f, _ in self.templates])
        self.words = np.array([len(re.findall(r"\w+", t)) for _, t in self.templates])
        self.size = self.has.sum(axis=1)
        # a window or line with fewer of the templates' n-grams can't be confirmed
        parted = sum(max(0, LEAST_WORDS - n) for n in range(NGRAMS))
        self.least = math.ceil(LEAST_SIMILARITY * min(int(self.size.min()), parted))
        self._fit(prose, np.random.default_rng(seed))

    def _examples(self, prose: list[str], draw: np.random.Generator) -> tuple[list[str], list[int]]:
        known = [p for p in prose if self._nearest(_grams_of([p])[0]) < 0.5]
        words = [w for p in known for w in p.split()] or ["word"]
        marked = [w for _, t in self.templates for w in t.split()]
        # words that templates of several families have are ordinary ones
        families: dict[str, set[str]] = {}
        for family, template in self.templates:
            for w in re.findall(r"\w+", template.lower()):
                families.setdefault(w, set()).add(family)
        ordinary = sorted(w for w, f in families.items() if len(f) > 2)

        def some(pool: list[str], most: int) -> list[str]:
            return [pool[i] for i in draw.integers(0, len(pool), draw.integers(0, most + 1))]

        def around(most: int) -> list[str]:
            share = draw.choice([0.0, 0.5])
            return [ordinary[draw.integers(len(ordinary))] if draw.random() < share else w for w in some(words, most)]

        texts, labels = [], []
        for family, template in self.templates:
            for _ in range(VARIANTS):
                kept = [w for w in template.split() if draw.random() > 0.07]
                # as much as the windows that hold the template whole have besides it
                width = next(w for w in WINDOWS if w - w // 4 >= len(kept))
                left = int(draw.integers(0, width - len(kept) + 1))
                texts.append(" ".join(around(left) + kept + around(width - len(kept) - left)))
                labels.append(FAMILIES.index(family))
        for p in known:
            texts.append(p)
            labels.append(0)
        for _ in range(len(self.templates) * VARIANTS):
            width = int(draw.choice(WINDOWS))
            mixed = around(width) + some(marked, min(6, width // 2))
            draw.shuffle(mixed)
            texts.append(" ".join(mixed))
            labels.append(0)
        return texts, labels

    def _nearest(self, grams: np.ndarray) -> float:
        hit = np.isin(self.grams, grams)
        return float(((self.has & hit).sum(axis=1) / self.has.sum(axis=1)).max())

    def _fit(self, prose: list[str], draw: np.random.Generator) -> None:
        texts, labels = self._examples(prose, draw)
        x = np.zeros((len(texts), len(self.grams) + 1))
        for i, grams in enumerate(_grams_of(texts)):
            x[i, :-1] = np.isin(self.grams, grams)
        x[:, -1] = 1.0
        y = np.eye(len(FAMILIES))[labels]
        held = np.arange(len(texts)) % 4 == 0
        weights = np.zeros((x.shape[1], len(FAMILIES)))
        square = np.full(weights.shape, 1e-8)
        a, b = x[~held], y[~held]
        for _ in range(150):  # gradients with a rate per weight
            gradient = a.T @ (_softmax(a @ weights) - b) / len(a) + 1e-4 * weights
            square += gradient * gradient
            weights -= 0.3 * gradient / np.sqrt(square)
        weights[np.abs(weights) < 0.02] = 0.0
        scores = x[held] @ weights
        heat = np.geomspace(0.2, 5.0, 60)
        loss = [-(y[held] * np.log(_softmax(scores / t) + 1e-12)).sum() for t in heat]
        self.weights = weights / heat[int(np.argmin(loss))]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(paragraph, family, probability, similarity, template) of paragraphs that the classifier
        names a family for; a paragraph comes once for each such window. The template is -1 where
        none confirms the family."""
        for first, _, hashes, begins, ends, bounds in ngrams(data, offsets):
            at = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
            hit = np.flatnonzero(self.grams[at] == hashes)
            gram, begins, ends = at[hit], begins[hit], ends[hit]
            size = np.diff(bounds)
            line = np.searchsorted(bounds, begins, side="right") - 1
            total = sum(np.maximum(size - n, 0) for n in range(NGRAMS))
            total = np.where(size >= LEAST_WORDS, total, np.iinfo(np.int64).max)
            found = list(self._predicted(gram, begins, ends, line, line, total))
            for width in WINDOWS:
                each, lines, window = windows(begins, ends, bounds, width)
                found += self._predicted(gram[each], begins[each], ends[each], lines, window, None)
            confirmed = [f for f in found if f[4] >= 0]
            unconfirmed = [f[:5] for f in found if f[4] < 0]
            for paragraph, *one in [*_undisputed(confirmed, self.words), *unconfirmed]:
                yield first + paragraph, *one

    def _predicted(
        self,
        gram: np.ndarray,
        begins: np.ndarray,
        ends: np.ndarray,
        line: np.ndarray,
        unit: np.ndarray,
        total: np.ndarray | None,
    ) -> Iterator[tuple]:
        """What `scan` gives, and the first and last word that the template shares, for units (lines
        or windows) with the given n-grams. `total` has the n-grams of each line, where a line may
        also be part of a template."""
        # an n-gram counts once per unit
        pairs, where = np.unique(unit * len(self.grams) + gram, return_index=True)
        unit, gram = np.divmod(pairs, len(self.grams))
        heads = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])[: len(unit)])
        count = np.diff(np.append(heads, len(unit)))
        # units with too few n-grams for any template need no comparison
        enough = count >= self.least
        stays = np.repeat(enough, count)
        gram, where, lines, count = gram[stays], where[stays], line[where[heads[enough]]], count[enough]
        cuts = np.append(0, np.cumsum(count))
        begin = 0
        while begin < len(count):
            end = int(np.searchsorted(cuts, cuts[begin] + COMPARED, side="right")) - 1
            end = min(max(end, begin + 1), len(count))
            own = gram[cuts[begin] : cuts[end]]
            starts = cuts[begin:end] - cuts[begin]
            scores = np.add.reduceat(self.weights[own], starts, axis=0) + self.weights[-1]
            probability = _softmax(scores)
            families = probability.argmax(axis=1)
            sure = probability[np.arange(len(families)), families] >= LEAST_PROBABILITY
            for i in np.flatnonzero((families > 0) & sure):
                family = int(families[i])
                here = slice(cuts[begin + i], cuts[begin + i + 1])
                theirs = np.flatnonzero(self.family == family)
                shared = self.has[np.ix_(theirs, gram[here])].sum(axis=1)
                similarity = shared / self.size[theirs]
                if total is not None:
                    similarity = np.maximum(similarity, shared / total[lines[begin + i]])
                best = int(similarity.argmax())
                top, nearest = int(theirs[best]), min(1.0, float(similarity[best]))
                if nearest < LEAST_SIMILARITY:
                    yield lines[begin + i], family, probability[i, family], nearest, -1, 0, 0
                    continue
                shares = where[here][self.has[top, gram[here]]]
                # single words may be far from the notice
                shares = shares[ends[shares] - begins[shares] > 1]
                yield (
                    lines[begin + i], family, probability[i, family], nearest, top,
                    begins[shares].min(), ends[shares].max(),
                )
            begin = end


def _undisputed(found: list[tuple], words: np.ndarray) -> Iterator[tuple]:
    """Findings without those that mostly lie within a better one of another family: a piece of one
    notice may resemble another. The better one spans no more words than its template has."""
    room = int(words.max())
    near: dict[int, set[tuple]] = {}
    for _, family, _, similarity, top, a, b in found:
        if b - a <= words[top]:
            near.setdefault(int(a) // room, set()).add((family, similarity, int(a), int(b)))
    for one in found:
        _, family, _, similarity, _, a, b = one
        rivals = (x for i in range(int(a) // room - 1, int(b) // room + 1) for x in near.get(i, ()))
        if not any(
            f != family and s > similarity and min(b, d) - max(a, c) >= LEAST_SIMILARITY * (b - a)
            for f, s, c, d in rivals
        ):
            yield one[:5]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(documents: DataFrame) -> Model:
    """Model from the templates and a bounded sample of the corpus' prose: pieces of lines, by the
    smallest hashes, of the documents with the smallest hashes of id and text."""
    key = F.xxhash64("doc_id", "text")
    told = documents.where(F.octet_length("text") > 0).select(key.alias("draw"), "text")
    chosen = told.select("draw").distinct().orderBy("draw").limit(PROSE_TEXTS).collect()
    if not chosen:
        return Model([])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for draw, text in zip(batch.column("draw").to_pylist(), batch.column("text")):
                for pieces in _pieces(text.as_py()):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([draw] * len(pieces), pa.int64()), pa.array(pieces, pa.string())],
                        names=["draw", "piece"],
                    )

    # equal pieces of a document have one hash, so a repeated line counts once there
    rows = (
        told.where(F.col("draw").isin([r["draw"] for r in chosen]))
        .mapInArrow(cut, "draw bigint, piece string")
        .groupBy("draw", "piece")
        .agg(F.lit(0))
        .select(F.xxhash64("draw", "piece").alias("place"), "piece")
        .orderBy("place", "piece")
        .limit(PROSE_PARAGRAPHS)
        .collect()
    )
    return Model([r["piece"] for r in rows])


def _pieces(text: str) -> Iterator[list[str]]:
    """Lines of a text that aren't blank, in pieces of at most as many words as the longest window
    and PIECE characters, some at a time."""
    out: list[str] = []
    for line in text.split("\n"):
        words = line.split()
        for i in range(0, len(words), WINDOWS[-1]):
            out.append(" ".join(words[i : i + WINDOWS[-1]])[:PIECE])
        if len(out) > 1_000:
            yield out
            out = []
    if out:
        yield out


SCHEMA = (
    "doc_id bigint, n_paragraphs bigint, licenses string, n_licensed bigint, "
    "probability double, similarity double, n_unconfirmed bigint"
)


def scan_licenses(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: its lines, the licence families confirmed in them (sorted, joined by
    commas, null if none), lines with a licence, the best of their probabilities and
    similarities (null if none), and lines for which the classifier names families of which no
    template confirms any."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            lines = line_offsets(data, offsets)
            found: dict[int, list] = {}
            named: dict[int, set] = {}
            for line, family, probability, similarity, top in shared.value.scan(data, lines):
                doc = int(np.searchsorted(offsets, lines[line], side="right")) - 1
                named.setdefault(doc, set()).add(line)
                if top >= 0:
                    found.setdefault(doc, []).append((FAMILIES[family], probability, similarity, line))
            n = np.searchsorted(lines, offsets[1:]) - np.searchsorted(lines, offsets[:-1])
            each = [found.get(i) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array([",".join(sorted({f[0] for f in e})) if e else None for e in each], pa.string()),
                    pa.array([len({f[3] for f in e}) if e else 0 for e in each], pa.int64()),
                    pa.array([float(max(f[1] for f in e)) if e else None for e in each], pa.float64()),
                    pa.array([float(max(f[2] for f in e)) if e else None for e in each], pa.float64()),
                    pa.array(
                        [len(named.get(i, set()) - {f[3] for f in e or ()}) for i, e in enumerate(each)],
                        pa.int64(),
                    ),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, SCHEMA)
