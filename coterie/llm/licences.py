"""Licence notices in texts: a trained paragraph classifier over sparse word n-grams, confirmed by templates.

General: the project keeps no licensed texts, so the operator takes any table ``documents(doc_id, text)``.

Only n-grams of the templates are features, so a document is scanned by looking its words up. Where such n-grams stand
close together, or one stands that only notices have (``MIT License``, ``CC0``, ``SPDX-License-Identifier``), they make a
paragraph, whatever its line breaks; it is classified by softmax regression with sparse weights into the families,
``unknown`` (learned from notices whose family words are replaced) or none, its probability calibrated on
paragraphs kept from the fit, and compared with the templates of its family. A bare ``License: X`` of an unlisted X is no place.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Notice texts of public licences by SPDX family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0."),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is marked with CC0 1.0 Universal."),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
}
# Identifiers and short names; each is a notice of its own, its first two words (or its one word) mark a place.
NAMES = {
    "Apache-2.0": ("Apache-2.0", "Apache License"),
    "MIT": ("MIT License",),
    "GPL": ("GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GNU GPL"),
    "LGPL": ("LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "GNU LGPL"),
    "AGPL": ("AGPLv3", "AGPL-3.0", "GNU AGPL"),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause", "BSD License"),
    "MPL-2.0": ("MPL-2.0", "Mozilla Public License"),
    "EPL-2.0": ("EPL-2.0", "Eclipse Public License"),
    "ISC": ("ISC License",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0", "CC0-1.0"),
    "CC-BY-4.0": ("CC-BY-4.0",),
    "CC-BY-SA-4.0": ("CC-BY-SA-4.0",),
    "CC-BY-NC-4.0": ("CC-BY-NC-4.0",),
    "CC-BY-ND-4.0": ("CC-BY-ND-4.0",),
}
# What a family is called in a tag, besides its names.
TAGS = {"MIT": "MIT", "GPL": "GPL", "LGPL": "LGPL", "AGPL": "AGPL", "BSD": "BSD", "ISC": "ISC", "MPL-2.0": "MPL", "EPL-2.0": "EPL"}
# Frames of tags, and notices that name no known family; {} is any name.
TAG_FRAMES = ("License: {}", "SPDX-License-Identifier: {}", "Licensed under {}", "Licensed under the {}")
OTHER_FRAMES = ("SPDX-License-Identifier: {}", "Licensed under {}", "Licensed under the {} License", "Licensed under the {} License, version {}",
                "Released under the {} License", "Copyright {} {} All rights reserved")
# Rights that are kept without a copyright line; no licence.
NO_NOTICE = ("All rights reserved", "All rights reserved {} {} {}", "Copyright {} {} {} copyright {}")
# Words too common to start a paragraph by themselves.
COMMON = frozenset("a an and any are as at be by can for from in is it its not of on one or that the this to was were with you".split())
NONE, UNKNOWN = "none", "unknown"
WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _grams(words: list[str]) -> set[str]:
    return {" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def _share(own: set[tuple[str, str]], words: list[str], template: list[str]) -> float:
    """Share of a template's word pairs among those of a paragraph; a template of up to three words is there or not."""
    if len(template) == 1:
        return float(template[0] in words)
    pairs = _pairs(template)
    share = len(own & pairs) / len(pairs)
    return share if len(template) > 3 else float(share == 1)


_LONG = {k: [words_of(t) for t in v] for k, v in TEMPLATES.items()}
_NAMES = {k: [words_of(n) for n in v] for k, v in NAMES.items()}
_TAGGED = {k: [words_of(f.format(n)) for f in TAG_FRAMES for n in (*NAMES[k], *([TAGS[k]] if k in TAGS else []))] for k in TEMPLATES}
_TEMPLATE_WORDS = {k: _LONG[k] + _NAMES[k] + _TAGGED[k] for k in TEMPLATES}
_VOCABULARY = {g: i for i, g in enumerate(sorted({g for ts in _TEMPLATE_WORDS.values() for t in ts for g in _grams(t)}
                                                 .union(*[_grams(words_of(f)) for f in OTHER_FRAMES]) - COMMON))}
_MARKS = frozenset(p for t in [*[t for ts in _TEMPLATE_WORDS.values() for t in ts], *map(words_of, OTHER_FRAMES)]
                   for p in _pairs(t) if not COMMON.issuperset(p))
#: One-word names, and pairs that make a place by themselves: the start of a name, and what stands before a tag.
_SINGLE = frozenset(n[0] for ns in _NAMES.values() for n in ns if len(n) == 1)
_OPEN = frozenset([("license", "identifier"), ("licensed", "under")])
_FIRST = {n[0] for ns in _NAMES.values() for n in ns if n[0] not in ("gnu", "mozilla", "eclipse")} | {words_of(t)[0] for t in TAGS.values()}
_ALONE = _OPEN.union((n[0], n[1]) for ns in _NAMES.values() for n in ns if len(n) > 1).union((b, n) for b in ("license", "identifier") for n in _FIRST)
#: A mark too, but only beside others.
_WEAK = frozenset(["copyright"])
_MARK_WORDS = frozenset(w for p in _MARKS for w in p) | _SINGLE | _WEAK
#: Words that may go on after a mark that stands alone: "Apache License, Version 2.0", "GPL-3.0-or-later".
_MORE = frozenset(w for ts in _NAMES.values() for n in ts for w in n) | {"version", "license", "only", "or", "later"}


def paragraphs(text: str, gap: int = 12) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the places where word pairs of templates stand at most ``gap`` words apart; offsets in
    characters of the text. Two pairs make a paragraph, or one pair or word that notices alone have: that one with up to four
    words that go on with the name, and at least the next word (two after ``the``) where the name is still to come."""
    words = words_of(text)
    at = [i for i, pair in enumerate(zip(words, [*words[1:], ""])) if pair[0] in _MARK_WORDS and (pair in _MARKS or pair[0] in _SINGLE or pair[0] in _WEAK)]
    if not at:
        return []
    found, out, k = None, [], 0
    while k < len(at):
        j = k
        while j + 1 < len(at) and at[j + 1] - at[j] <= gap:
            j += 1
        lo, last = at[k], tuple(words[at[j]:at[j] + 2])
        hi = at[j] + (last in _MARKS)
        if j > k or last in _ALONE or words[lo] in _SINGLE:
            least = hi
            if last in _OPEN:
                least = hi + 1 + (words[hi + 1:hi + 2] == ["the"])
            while hi + 1 < len(words) and (hi < least or j == k and hi < lo + 5 and words[hi + 1] in _MORE):
                hi += 1
            found = found or list(WORD.finditer(text))
            out.append((found[lo].start(), found[hi].end(), words[lo:hi + 1]))
        k = j + 1
    return out


def _row(words: list[str]) -> list[int]:
    return [_VOCABULARY[g] for g in _grams(words) if g in _VOCABULARY]


def _matrix(rows: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(rows), len(_VOCABULARY) + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1 / np.sqrt(max(len(r), 1))
    x[:, -1] = 1
    return x


@dataclass
class LicenceModel:
    """Sparse weights (feature x class; the last two classes are unknown and none), the temperature and the confidence a family needs."""

    families: list[str]
    weights: np.ndarray
    temperature: float
    least: float

    def probabilities(self, paragraphs: list[list[str]]) -> np.ndarray:
        z = _matrix([_row(w) for w in paragraphs]) @ self.weights / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def classify(self, words: list[str]) -> tuple[str, float, float]:
        """Family (or none, or unknown), its probability, and the share of a template's word pairs that the paragraph has."""
        p = self.probabilities([words])[0]
        best = int(p[:-2].argmax())
        own = _pairs(words)
        alike = max(_share(own, words, t) for t in _TEMPLATE_WORDS[self.families[best]])
        if p[-1] >= 0.5:
            return NONE, float(p[-1]), alike
        if p[best] < max(self.least, p[-2]) or alike < 0.5:
            return UNKNOWN, float(1 - p[-1]), alike
        return self.families[best], float(p[best]), alike


def _examples(random: np.random.Generator, each: int) -> tuple[list[list[str]], list[int]]:
    """Damaged copies of templates (words dropped or replaced, ends cut, other words around), names and tags as they are, and
    notices of no known family: frames with other names, and templates that lost the words only their family has."""
    rows, labels = [], []

    def strange() -> str:
        return f"x{random.integers(999)}"

    def damaged(words: list[str]) -> list[str]:
        if len(words) > 14 and random.random() < 0.5:
            n = int(random.integers(12, len(words)))
            lo = int(random.integers(0, len(words) - n + 1))
            words = words[lo:lo + n]
        lost = random.random() * 0.12
        return [w if random.random() > lost / 2 else strange() for w in words if random.random() > lost / 2]

    def add(words: list[str], label: int) -> None:
        around = [strange() for _ in range(int(random.integers(0, 8)))]
        rows.append(around + words + around[::-1])
        labels.append(label)

    for c, family in enumerate(TEMPLATES):
        short = _NAMES[family] + _TAGGED[family]
        elsewhere = {w for k, ts in _TEMPLATE_WORDS.items() if k != family for t in ts for w in t}
        for i in range(each):
            add(damaged(_LONG[family][i % len(_LONG[family])]), c)
        for words in short * 2:  # as they are, so copies would be equal rows
            add(words, c)
        for _ in range(each // 8):
            frame = OTHER_FRAMES[int(random.integers(0, len(OTHER_FRAMES)))]
            add(words_of(frame.format(*[strange() for _ in range(frame.count("{}"))])), len(TEMPLATES))
            without = [w if w in elsewhere else strange() for w in _LONG[family][0]]
            if without != _LONG[family][0]:
                add(without, len(TEMPLATES))
    return rows, labels


def fit_licences(documents: DataFrame, train_documents: int = 5_000, most_paragraphs: int = 4_000, each: int = 120, seed: int = 5) -> LicenceModel:
    """Fit on damaged copies of the templates against paragraphs of the corpus.

    The paragraphs come from about ``train_documents`` documents chosen by a hash of ``doc_id``, ``most_paragraphs`` of them at most
    (the documented bounds); those that hold half of some template, or a mark that notices alone have, are left out, as they are notices. A fifth of all rows
    is kept for the temperature and for the confidence that 95 of 100 damaged copies reach. Unrelated words around
    templates and corpus words without any template word stand for none as well."""
    n = documents.select("doc_id").count()
    rows = documents.select("doc_id", "text")
    if n > train_documents:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * train_documents / n))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in pc.fill_null(batch.column(0), "").to_pylist():
                for _, _, words in paragraphs(text):
                    own = _pairs(words)
                    if max(_share(own, words, t) for ts in _LONG.values() for t in ts) < 0.5 and not _ALONE & own and not _SINGLE.intersection(words):
                        out.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["words"])

    other = rows.select("text").mapInArrow(read, "words string").distinct().orderBy(F.xxhash64("words")).limit(most_paragraphs).toPandas()["words"]
    random = np.random.default_rng(seed)
    texts, labels = _examples(random, each)
    k = len(TEMPLATES) + 1
    plain = [w.split(" ") for w in other]
    common = sorted(COMMON)
    plain += [[common[i] for i in random.integers(0, len(common), 12)] for _ in range(2 * each)]
    plain += [words_of(f.format(*["x"] * f.count("{}"))) for f in NO_NOTICE for _ in range(each // 4)]
    # template words out of order are no notice
    pool = sorted({w for ts in _TEMPLATE_WORDS.values() for t in ts for w in t})
    plain += [[pool[i] for i in random.integers(0, len(pool), 12)] for _ in range(2 * each)]
    texts, y = texts + plain, np.array(labels + [k] * len(plain))
    x = _matrix([_row(w) for w in texts])
    kept = random.random(len(y)) < 0.2
    xt, yt = x[~kept], np.eye(k + 1, dtype=np.float32)[y[~kept]]
    balance = (1 / np.maximum(yt.sum(0), 1))[yt.argmax(1)][:, None] * len(yt) / (k + 1)
    w = ahead = np.zeros((x.shape[1], k + 1), np.float32)
    rate, t = 2.0, 1.0
    for _ in range(250):  # accelerated proximal gradient: small weights become zero
        z = xt @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - rate * (xt.T @ (balance * (p - yt)) / len(yt))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * 2e-5, 0)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / nxt * (new - w)
        w, t = new, nxt
    model = LicenceModel(list(TEMPLATES), w, 1.0, 0.0)
    held = [texts[i] for i in np.flatnonzero(kept)]
    truth = y[kept]

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return float(-np.log(model.probabilities(held)[np.arange(len(truth)), truth] + 1e-9).mean())

    model.temperature = min(np.geomspace(0.2, 5, 25), key=loss)
    p = model.probabilities(held)
    sure = p[np.arange(len(truth)), truth][truth < k - 1]
    model.least = float(min(np.quantile(sure, 0.05), 0.9)) if len(sure) else 0.5
    return model


def find_licences(documents: DataFrame, model: LicenceModel) -> DataFrame:
    """Licence notices of every whole ``documents(doc_id, text)`` row.

    Output, one row per notice: ``doc_id, paragraph`` (from 0 among the document's notices), ``start, end`` (characters),
    ``family`` (``unknown`` for a notice of no known family), ``probability`` and ``template_share``. A null or empty text
    has no notice. Repeated rows give repeated notices, no rows none; a null ``doc_id`` passes; other columns are not
    read. One pass, nothing is shuffled."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, number, start, end, family, p, share = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                here = 0
                for lo, hi, words in paragraphs(text.as_py() or ""):
                    name, sure, alike = model.classify(words)
                    if name != NONE:
                        row.append(i)
                        number.append(here)
                        here += 1
                        start.append(lo)
                        end.append(hi)
                        family.append(name)
                        p.append(sure)
                        share.append(alike)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                 pa.array(family, pa.string()), pa.array(p, pa.float64()), pa.array(share, pa.float64())],
                names=["doc_id", "paragraph", "start", "end", "family", "probability", "template_share"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        read, f"doc_id {kind}, paragraph int, start long, end long, family string, probability double, template_share double")
