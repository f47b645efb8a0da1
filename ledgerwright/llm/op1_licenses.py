"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed against templates.

A paragraph is a run of lines that have words; comment marks have none, so a header in a source file is one. It is
read line by line and, where it has several lines, as a whole across their breaks, both in overlapping windows, so that
neither wrapping hides a notice nor its surroundings dilute it. Multinomial logistic regression over hashed word
n-grams gives each window a family, ``unknown`` (worded like a licence, but no known one) or ``none``. Its
probabilities are calibrated by a temperature on held-out examples, some of families that the examples it learns from
do not have. A predicted family holds only if the window also covers enough of one of the family's templates and, where
that names the licence, has one of the family's names unbroken; otherwise the notice is ``unknown``. Negative examples are paragraphs of the corpus itself.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .session import freeing, ship

TABLE = 1 << 16
GRAMS = 3
WINDOW, STRIDE = 32, 16
COVER = 0.6
LEAST = 0.5
#: Of the fit alone: documents whose paragraphs serve as negative examples, bytes of each, and paragraphs of all, at most;
#: words that are put around the made-up notices.
SAMPLE_TEXTS, SAMPLE_BYTES, SAMPLE_PARAGRAPHS = 400, 20_000, 4000
FILLER_WORDS = 20_000
#: Bytes of text at once; a word takes some 300 bytes of running sums.
_BLOCK = 1 << 19
_U = np.uint64

#: Short notices by which texts name their licence.
TEMPLATES = {
    "agpl": (
        "licensed under the GNU Affero General Public License version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "released under the AGPL-3.0 license",
    ),
    "apache": (
        "licensed under the Apache License Version 2.0",
        "you may not use this file except in compliance with the License you may obtain a copy of the License at http www.apache.org licenses LICENSE-2.0",
        "distributed under the terms of the Apache License 2.0",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the BSD 3-Clause License",
        "use of this source code is governed by a BSD-style license",
        "released under the 2-clause BSD license",
    ),
    "cc-by": ("licensed under a Creative Commons Attribution 4.0 International License", "licensed under CC BY 4.0", "available under the CC-BY 3.0 license"),
    "cc-by-nc": ("licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "available under the CC BY-NC-SA 3.0 license"),
    "cc-by-sa": ("licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc0": ("dedicated to the public domain under CC0 1.0", "to the extent possible under law the author has waived all copyright and related rights", "this is free and unencumbered software released into the public domain"),
    "gpl": (
        "this work is licensed under the GNU General Public License version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation either version 2 of the License or at your option any later version",
        "released under the GPL-2.0 license",
        "licensed under the GPLv3",
    ),
    "lgpl": ("licensed under the GNU Lesser General Public License version 2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "released under the LGPL-3.0 license"),
    "mit": (
        "released under the MIT License",
        "licensed under the MIT License",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "distributed under the terms of the MIT license see the LICENSE file for details",
    ),
    "mpl": ("this source code form is subject to the terms of the Mozilla Public License v 2.0", "licensed under the Mozilla Public License 2.0"),
    "proprietary": ("all rights reserved no part of this publication may be reproduced or distributed without prior written permission", "this document is confidential and proprietary unauthorized copying is strictly prohibited"),
}
#: What each family is called, # for any number. A template that has a name counts only where a window has
#: one of its family's names, word after word: one word more or less (Affero, Lesser, NC, SA) is another licence.
NAMES = {
    "agpl": ("GNU Affero General Public License", "AGPL", "AGPLv3"),
    "apache": ("Apache License", "apache org licenses", "Apache #"),
    "bsd": ("BSD",),
    "cc-by": ("CC BY #", "Creative Commons Attribution #"),
    "cc-by-nc": ("CC BY NC", "Creative Commons Attribution NonCommercial"),
    "cc-by-sa": ("CC BY SA", "Creative Commons Attribution ShareAlike"),
    "cc0": ("CC0",),
    "gpl": ("GNU General Public License", "GPL", "GPLv2", "GPLv3"),
    "lgpl": ("GNU Lesser General Public License", "LGPL", "LGPLv2", "LGPLv3"),
    "mit": ("MIT License",),
    "mpl": ("Mozilla Public License", "MPL"),
}
_LEADS = ("", "", "this work is ", "this project is ", "the code is ", "this file is ", "copyright 2019 the authors ", "note that all of it is ", "© 2021 ", "software ")
_TAILS = ("", "", " see the file LICENSE", " and later", " by its authors", " unless noted otherwise", " all other rights are kept")
_OTHER = ("licensed under the {} License version {}", "released under the {} Public License", "distributed under the terms of the {} license {}", "this work is made available under the {} Software License Agreement v{}", "use is subject to the {} community license {}")
_NAMES = ("Oakmoor", "Blue River", "Sleepcat", "Zed", "Artisan", "Quorum Foundation", "Elder", "Norvale", "Open Kitchen", "Harbour", "Velvet", "Common Field")
_PLAIN = ("the driver was licensed under state law to run a public bus", "a general public meeting is held on version control", "permission to park is granted by the office", "the apache tribe lived in the south west", "students of mit released a new version of their code", "all the rights of the members are listed in the rules", "the creative commons room is open to the public", "he holds a fishing license number 2 0", "free software is made by people all over the world", "copyright law is a part of private law", "the file is open and the license plate is read", "the terms of the agreement were public", "source code and binary forms of the program are slow", "the foundation has published any later work")

FAMILIES = (*sorted(TEMPLATES), "unknown", "none")
UNKNOWN, NONE = len(FAMILIES) - 2, len(FAMILIES) - 1
_KEEP = np.zeros(256, bool)
_KEEP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Windows:
    """Windows of words: first and end word, paragraph; n-gram table entries by order for each word."""

    first: np.ndarray
    end: np.ndarray
    para: np.ndarray
    slots: list[np.ndarray]


def paragraphs(block: tc.Block) -> tuple[tc.Block, np.ndarray, np.ndarray]:
    """The block's lines as documents of their own, each line's document, and its number in there."""
    line = np.flatnonzero(block.data == 0x0A) + 1
    at = np.unique(np.concatenate([block.at, line]))
    lines = tc.Block(0, len(at) - 1, block.data, at)
    doc = np.searchsorted(block.at, at[:-1], side="right") - 1
    number = np.arange(len(doc)) - np.searchsorted(doc, doc)
    return lines, doc, number


def windows(w: tc.Words) -> Windows:
    size = np.diff(w.first)
    n = np.where(size > WINDOW, -(-(size - WINDOW) // STRIDE) + 1, (size > 0).astype(np.int64))
    para = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(para)) - np.repeat(np.cumsum(n) - n, n)
    first = w.first[:-1][para] + k * STRIDE
    end = np.minimum(first + WINDOW, w.first[1:][para])
    slots, h = [], np.zeros(len(w.hash), _U)
    for i in range(GRAMS):
        h = h[: len(w.hash) - i] * _U(0x9E3779B97F4A7C15) + w.hash[i:]
        slots.append((tc.mix(h + _U(i)) >> _U(48)).astype(np.int64))
    return Windows(first, end, para, slots)


def _entries(x: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Table entries of all windows, those of each order TABLE apart, one window after another, and where each begins."""
    spans = [(x.first, np.maximum(x.end - i, x.first)) for i in range(GRAMS)]
    count = np.stack([b - a for a, b in spans])
    total = count.sum(axis=0)
    start = np.cumsum(total) - total
    out = np.empty(int(total.sum()), np.int64)
    base = start.copy()
    for g, ((a, _), c, slots) in enumerate(zip(spans, count, x.slots)):
        own = np.repeat(np.arange(len(c)), c)
        k = np.arange(len(own)) - np.repeat(np.cumsum(c) - c, c)
        out[base[own] + k] = slots[a[own] + k] + g * TABLE
        base = base + c
    return out, start


def _distinct(entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry of an order once a window, so that a word repeated on and on counts as one."""
    own = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(entries))))
    key = np.unique(own * (GRAMS * TABLE) + entries)
    return key % TABLE, np.searchsorted(key, np.arange(len(start)) * (GRAMS * TABLE))


@dataclass
class Classifier:
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, entries: np.ndarray, start: np.ndarray) -> np.ndarray:
        size = np.diff(np.append(start, len(entries)))
        return np.add.reduceat(self.weights[entries], start, axis=0) / np.sqrt(size)[:, None] + self.bias if len(start) else np.empty((0, len(FAMILIES)))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _block(texts: list[str]) -> tc.Block:
    data = [t.encode("utf-8") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)
    return tc.Block(0, len(texts), np.frombuffer(b"".join(data), np.uint8), at)


def _examples(negatives: list[str], seed: int) -> tuple[list[str], np.ndarray]:
    """Varied notices of every family, of made-up licences, and paragraphs without any."""
    r = random.Random(seed)
    filler = " ".join(negatives).split()[:FILLER_WORDS] or ["word"]
    some = lambda k: " ".join(r.choice(filler) for _ in range(r.randint(0, k)))
    texts, labels = [], []

    def vary(notice: str) -> str:
        words = notice.split()
        if len(words) > 12 and r.random() < 0.5:
            a = r.randint(0, len(words) - 10)
            words = words[a : a + r.randint(10, len(words))]
        t = " ".join(words)
        for old, new in (("version 3", "version 2"), ("4.0", "3.0"), ("2.0", "2"), ("licensed", "made available"), ("License", "licence")):
            if r.random() < 0.1:
                t = t.replace(old, new)
        t = r.choice(_LEADS) + t + r.choice(_TAILS)
        return f"{some(10)} {t} {some(10)}" if r.random() < 0.5 else t

    for k, family in enumerate(FAMILIES[:-2]):
        for i in range(150):
            notices = TEMPLATES[family]
            texts.append(vary(notices[i % len(notices)]))
            labels.append(k)
    for _ in range(400):
        name = r.choice(_NAMES) + r.choice(("", "", f" {r.choice(_NAMES)}"))
        texts.append(vary(r.choice(_OTHER).format(name, r.choice(("1.0", "2", "3", "2.1")))))
        labels.append(UNKNOWN)
    for t in negatives:
        words = t.split()
        for a in range(0, max(1, len(words) - WINDOW + 1), 4 * WINDOW):
            texts.append(" ".join(words[a : a + WINDOW]))
            labels.append(NONE)
    for _ in range(300):
        words = r.choice(_PLAIN).split()
        r.random() < 0.3 and r.shuffle(words)
        texts.append(f"{some(8)} {' '.join(words)} {some(8)}")
        labels.append(NONE)
    return texts, np.array(labels)


def train(negatives: list[str], seed: int = 3, epochs: int = 12, rate: float = 0.5, without: tuple[str, ...] = ()) -> Classifier:
    """Fit on made-up notices and on paragraphs without any. Notices of the families ``without`` are neither learned
    from nor calibrated on: what a fitted model then makes of them tells how it meets licences that it does not know."""
    negatives = [t for t in negatives[: 2 * SAMPLE_PARAGRAPHS] if not _covered([t]).any()][:SAMPLE_PARAGRAPHS]
    texts, y = _examples(negatives, seed)
    gone = [FAMILIES.index(f) for f in without]
    texts, y = [t for t, k in zip(texts, y) if k not in gone], y[~np.isin(y, gone)]
    w = tc.words(_block(texts), keep=_KEEP)
    size = np.diff(w.first)
    slots = windows(w).slots
    x = Windows(w.first[:-1][size > 0], np.minimum(w.first[1:], w.first[:-1] + 2 * WINDOW)[size > 0], np.flatnonzero(size > 0), slots)
    y = y[x.para]
    entries, start = _distinct(*_entries(x))
    stop = np.append(start[1:], len(entries))
    rng = np.random.Generator(np.random.PCG64(seed))
    held = rng.random(len(y)) < 0.2
    model = Classifier(np.zeros((TABLE, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES)), 1.0)
    speed, speed_b = np.full(TABLE, 1e-3, np.float32), np.full(len(FAMILIES), 1e-3)

    def batch(rows):
        n = stop[rows] - start[rows]
        first = np.cumsum(n) - n
        pos = np.repeat(start[rows] - first, n) + np.arange(int(n.sum()))
        return entries[pos], first, n

    learn = np.flatnonzero(~held)
    for _ in range(epochs):
        rng.shuffle(learn)
        for lo in range(0, len(learn), 256):
            rows = learn[lo : lo + 256]
            e, first, n = batch(rows)
            g = _softmax(model.logits(e, first))
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            touched, at = np.unique(e, return_inverse=True)
            own = np.repeat(np.arange(len(rows)), n)
            scaled = g / np.sqrt(n)[:, None]
            grad = np.stack([np.bincount(at, scaled[own, k], len(touched)) for k in range(len(FAMILIES))], axis=1)
            speed[touched] += (grad**2).sum(axis=1)
            model.weights[touched] -= rate * grad / np.sqrt(speed[touched])[:, None]
            speed_b += g.sum(axis=0) ** 2
            model.bias -= rate * g.sum(axis=0) / np.sqrt(speed_b)
    rows = np.flatnonzero(held)
    e, first, _ = batch(rows)
    z = model.logits(e, first)
    choices = np.geomspace(0.25, 4, 33)
    model.temperature = float(choices[np.argmin([-np.log(_softmax(z / t)[np.arange(len(rows)), y[rows]] + 1e-12).mean() for t in choices])])
    return model


def _templates() -> tuple[list[np.ndarray], np.ndarray]:
    """Words of each template, and its family."""
    flat = [(k, t) for k, f in enumerate(FAMILIES[:-2]) for t in TEMPLATES[f]]
    w = tc.words(_block([t for _, t in flat]), keep=_KEEP)
    return [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])], np.array([k for k, _ in flat])


def _hash(word: str) -> np.uint64:
    return tc.words(_block([word]), keep=_KEEP).hash[0]


def _plain(data: np.ndarray, w: tc.Words) -> np.ndarray:
    """The words' hashes with all numbers alike and one spelling of licence, as names are written."""
    digit = (data[w.start] >= 0x30) & (data[w.start] <= 0x39)
    return np.where(digit, _U(0), np.where(w.hash == _hash("licence"), _hash("license"), w.hash))


def _sequences(texts: list[str]) -> list[np.ndarray]:
    block = _block([t.replace("#", "0") for t in texts])
    w = tc.words(block, keep=_KEEP)
    plain = _plain(block.data, w)
    return [plain[a:b] for a, b in zip(w.first[:-1], w.first[1:])]


def _has(words: np.ndarray, name: np.ndarray) -> bool:
    """Whether the name's words follow one another somewhere."""
    n = len(words) - len(name) + 1
    return n > 0 and bool(np.logical_and.reduce([words[i : i + n] == x for i, x in enumerate(name)]).any())


def _names() -> tuple[list[list[np.ndarray]], list[bool]]:
    """Names of each family, and which templates have one, in the order of _templates()."""
    names = [_sequences(list(NAMES.get(f, ()))) for f in FAMILIES[:-2]]
    flat = [(k, t) for k, f in enumerate(FAMILIES[:-2]) for t in TEMPLATES[f]]
    return names, [any(_has(words, n) for n in names[k]) for (k, _), words in zip(flat, _sequences([t for _, t in flat]))]


def _pairs(words: np.ndarray) -> np.ndarray:
    return words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:]


def _cover(words: np.ndarray, template: np.ndarray) -> float:
    """Share of the template's word pairs, in order, that the words have."""
    p = np.unique(_pairs(template))
    return float(np.isin(p, _pairs(words)).mean()) if len(words) > 1 and len(p) else 0.0


def _covered(texts: list[str]) -> np.ndarray:
    w = tc.words(_block(texts), keep=_KEEP)
    known, _ = _templates()
    return np.array([max(_cover(w.hash[a:b], t) for t in known) >= COVER for a, b in zip(w.first[:-1], w.first[1:])], bool)


def _several(lines: tc.Block, doc: np.ndarray, w: tc.Words) -> tuple[tc.Words, np.ndarray]:
    """The same words by paragraph: lines with words that follow one another in a document; those of one line are empty.
    And the line of each word."""
    some = np.diff(w.first) > 0
    n = len(some)
    starts = np.flatnonzero(some & ~(np.append(False, some[:-1]) & np.append(False, doc[1:] == doc[:-1])))
    line = np.repeat(np.arange(n), np.diff(w.first))
    if not len(starts):
        return tc.Words(w.start, w.end, line, w.hash, np.zeros(1, np.int64)), line
    own = np.searchsorted(starts, np.arange(n), side="right") - 1
    several = np.bincount(own[some], minlength=len(starts)) > 1
    first = np.append(w.first[starts], len(w.hash))
    first = np.stack([first[:-1], np.where(several, first[1:], first[:-1])], axis=1).ravel()  # a place without words after each
    return tc.Words(w.start, w.end, line, w.hash, np.append(first, len(w.hash))), line


def _logits(x: Windows, model: Classifier) -> np.ndarray:
    """What Classifier.logits gives of the windows' distinct entries: sums over all of a window's entries by differences of
    running sums, less those of entries that the window has before."""
    m = len(x.first)
    total, size = np.zeros((m, len(FAMILIES))), np.zeros(m)
    for g, slots in enumerate(x.slots):
        n = len(slots)
        first = np.minimum(x.first, n)
        stop = np.clip(x.end - g, first, n)
        weights = model.weights[slots]
        sums = np.zeros((n + 1, len(FAMILIES)))
        np.cumsum(weights, axis=0, dtype=np.float64, out=sums[1:])
        total += sums[stop] - sums[first]
        size += stop - first
        del sums
        back = np.full(n, WINDOW, np.int8)  # to the same entry before, within a window's reach
        narrow = slots.astype(np.uint16)
        for k in range(min(WINDOW, n) - 1, 0, -1):
            back[k:][narrow[k:] == narrow[:-k]] = k
        again = np.flatnonzero(back < WINDOW)
        lo, hi = np.searchsorted(again, first), np.searchsorted(again, stop)
        own = np.repeat(np.arange(m), hi - lo)
        at = again[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(own))]
        inside = at - back[at] >= first[own]
        own, at = own[inside], at[inside]
        size -= np.bincount(own, minlength=m)
        for k in range(len(FAMILIES)):
            total[:, k] -= np.bincount(own, weights[at, k], m)
    return total / np.sqrt(np.maximum(size, 1))[:, None] + model.bias


def _judge(w: tc.Words, plain: np.ndarray, x: Windows, model: Classifier, least: float):
    """Window, probability of a notice, family or unknown, cover, and the first and last word that the template has."""
    if not len(x.first):
        return
    known, family = _templates()
    names, named = _names()
    p = _softmax(_logits(x, model) / model.temperature)
    for i in np.flatnonzero(1 - p[:, NONE] >= least).tolist():
        k = int(p[i, :NONE].argmax())
        a, b = int(x.first[i]), int(x.end[i])
        words = w.hash[a:b]
        called = k < UNKNOWN and any(_has(plain[a:b], n) for n in names[k])
        mine = [t for t, f, has in zip(known, family, named) if f == k and (called or not has)]
        covers = [_cover(words, t) for t in mine]
        best = int(np.argmax(covers)) if covers else -1
        cover = covers[best] if covers else 0.0
        if k != UNKNOWN and cover >= COVER:
            at = np.flatnonzero(np.isin(_pairs(words), _pairs(mine[best])))
            yield i, float(1 - p[i, NONE]), FAMILIES[k], cover, a + int(at[0]), a + int(at[-1]) + 1
        else:
            yield i, float(1 - p[i, NONE]), "unknown", cover, a, b - 1


def scan(block: tc.Block, model: Classifier, least: float = LEAST) -> list[tuple[int, int, int, int, str, float, float]]:
    """(document, line, first byte, end, family, probability, template cover) of each notice, in whole lines.

    A line has one notice at most, the known family before unknown and then the likelier one. Across lines a notice has
    the lines between the first and the last word that its template has; it counts where no line of it has that family by
    itself, and takes the place of what lines in it are unknown. Notices of one family that meet are one.
    """
    lines, doc, number = paragraphs(block)
    w = tc.words(lines, keep=_KEEP)
    plain = _plain(lines.data, w)
    best: dict[int, tuple[bool, float, str, float]] = {}
    x = windows(w)
    for i, chance, name, cover, _, _ in _judge(w, plain, x, model, least):
        q = int(x.para[i])
        best[q] = max(best.get(q, (False, 0.0, "", 0.0)), (name != "unknown", chance, name, cover))
    across: list[tuple[int, int, float, str, float]] = []
    joined, line = _several(lines, doc, w)
    x = windows(joined)
    whole = line[x.first] != line[x.end - 1] if len(x.first) else np.empty(0, bool)  # those inside a line are known by now
    x = Windows(x.first[whole], x.end[whole], x.para[whole], x.slots)
    for i, chance, name, cover, a, b in _judge(w, plain, x, model, least):
        lo, hi = int(line[a]), int(line[b])
        if hi > lo and (name != "unknown" or not any(q in best for q in range(lo, hi + 1))):
            if not any(best.get(q, (False, 0.0, "", 0.0))[2] == name for q in range(lo, hi + 1)):
                across.append((lo, hi, chance, name, cover))
    covered = {q for lo, hi, _, name, _ in across if name != "unknown" for q in range(lo, hi + 1)}
    found = [(q, q, chance, name, cover) for q, (known, chance, name, cover) in best.items() if known or q not in covered]
    found += [f for f in across if f[3] != "unknown" or not covered & set(range(f[0], f[1] + 1))]
    merged: list[list] = []
    for lo, hi, chance, name, cover in sorted(found, key=lambda f: (f[3], f[0], f[1])):
        last = merged[-1] if merged else None
        if last and last[3] == name and doc[lo] == doc[last[0]] and lo <= last[1] and hi > lo:
            merged[-1] = [last[0], max(hi, last[1]), max(chance, last[2]), name, max(cover, last[4])]
        else:
            merged.append([lo, hi, chance, name, cover])
    return [(int(doc[lo]), int(number[lo]), int(lines.at[lo] - block.at[doc[lo]]), int(lines.at[hi + 1] - block.at[doc[lo]]), name, chance, cover) for lo, hi, chance, name, cover in sorted(merged)]


def fit(docs: DataFrame) -> Classifier:
    """Train on templates and on the paragraphs of at most SAMPLE_TEXTS different texts, picked by a hash of their
    content; of a text beyond SAMPLE_BYTES its beginning. Nothing else is bounded: all texts are scanned whole."""
    ship(docs.sparkSession)
    texts = docs.where(F.octet_length("text") > 0).select(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 40)).alias("h"), F.when(F.octet_length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(F.substring("text", 1, SAMPLE_BYTES // 4)).alias("text"))
    different = texts.agg(F.approx_count_distinct("h", 0.02)).first()[0]  # copies share a hash
    share = min(1 << 40, (2 * SAMPLE_TEXTS << 40) // max(1, different) + 1)
    drawn = texts.where(F.col("h") < share).groupBy("h").agg(F.min("text").alias("text")).collect()  # some 2 * SAMPLE_TEXTS
    rows = sorted((r["h"], r["text"]) for r in drawn)[:SAMPLE_TEXTS]
    return train([p for _, text in rows for p in text.split("\n") if p.strip()])


_FOUND = "doc_id bigint, paragraph bigint, start bigint, end bigint, family string, probability double, cover double"


def find_licenses(docs: DataFrame, model: Classifier, least: float = LEAST) -> DataFrame:
    """A row for each licence notice: doc_id, paragraph (number of its first line), start and end (bytes, whole lines),
    family (or unknown), probability of being a notice, and cover of the family's best template.

    Null and empty texts have no notices. Rows are independent: equal or null doc_ids give rows each; other
    columns are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for b in tc.blocks(batch.column("text"), _BLOCK):
                rows = scan(b, held.value, least)
                if rows:
                    d, *rest = zip(*rows)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([b.lo + i for i in d])), *map(pa.array, rest)], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(freeing(run), _FOUND)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: licence notices in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_licenses(docs, fit(docs))
    return found.select("doc_id", "paragraph", "start", "end", "family", F.round("probability", 4).alias("probability"), F.round("cover", 4).alias("cover"))
