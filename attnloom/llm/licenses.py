"""Licence scan: a trained classifier of statements in paragraphs, confirmed by templates.

Features are hashed words and word pairs. A multinomial logistic regression over
the families of TEMPLATES, `unknown` (other licence statements) and `none`
(ordinary text) is fitted on templates with words dropped and foreign words
added, on short names of the families, on made licence statements of no family,
and on a bounded sample of the corpus as ordinary text. A temperature is
calibrated on examples set aside.

Paragraphs are blocks between blank lines. Within one, pieces end at line ends
and full stops; longer pieces than MOST_WORDS are cut anew. All windows of up to
RUN neighbouring pieces and MOST_WORDS words are classified, so that statements
wrapped over lines are seen whole. Where `none` is not the likeliest class, the
windows of most evidence that do not overlap are reported; a further piece has
to add some, and words that repeat count once in the end. The family is the likeliest licence class. If the calibrated
probability of that class is below CERTAIN, a template of the same family has to
confirm it by most of its word pairs; below SURE, or unconfirmed, the statement
counts as `unknown`.
"""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, stored
from .hashing import SIGNS, scramble, words

# Wordings that licence families are known by.
TEMPLATES = {
    "agpl": ["licensed under the GNU Affero General Public License", "GNU Affero General Public License, version 3"],
    "apache": ["Licensed under the Apache License, Version 2.0", "released under the terms of the Apache License 2.0"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "This software is released under the BSD 3-Clause License",
    ],
    "cc-by": ["licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc": ["licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "gpl": ["licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "lgpl": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl": ["subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "public-domain": ["This work is dedicated to the public domain", "released into the public domain under CC0 1.0 Universal"],
}
_UNKNOWN = ["licensed under the {} license", "released under the terms of the {} licence", "subject to the {} public license version {}", "use is governed by the {} license agreement"]
#: Names in short statements such as `License: MIT`; alone, they are ordinary text.
_NAMES = {
    "agpl": ["AGPL", "GNU AGPL v3", "AGPL-3.0"], "apache": ["Apache", "Apache 2.0", "Apache-2.0"], "bsd": ["BSD", "BSD 3-Clause", "BSD-2-Clause"],
    "cc-by": ["CC BY", "CC BY 4.0", "CC-BY-3.0"], "cc-by-nc": ["CC BY-NC", "CC BY-NC 4.0"], "cc-by-sa": ["CC BY-SA", "CC BY-SA 4.0"],
    "gpl": ["GPL", "GNU GPL", "GNU GPL v3", "GPL-2.0"], "lgpl": ["LGPL", "GNU LGPL v3", "LGPL-2.1"], "mit": ["MIT"], "mpl": ["MPL", "MPL 2.0", "Mozilla"],
    "public-domain": ["public domain", "CC0", "CC0 1.0"],
}
_SHORT = ["{} License", "License: {}", "Licence: {}", "licensed under {}", "under the {} license", "SPDX-License-Identifier: {}"]
#: Names that need no other word.
_ALONE = ("GPL", "CC BY", "CC-BY", "CC0", "public domain")
_COMMON = "the a of in at is was and to from by for with on".split()
FAMILIES = [*sorted(TEMPLATES), "unknown"]
CLASSES = [*FAMILIES, "none"]
PLACES = 1 << 17
_SHIFT = np.uint64(64 - 17)
#: Windows of pieces: most pieces, most words of more than one piece, and words of the parts of a longer piece.
RUN, MOST_WORDS, PART_WORDS = 6, 48, 4
#: Log-odds that a further piece has to add to a window.
ADDED = 1.0
BLOCK = 8000
MOST_ORDINARY = 4000
CONFIRMED = 0.6
#: Calibrated probabilities of a family that count without a template, and at least with one.
CERTAIN, SURE = 0.9, 0.5
_PART = re.compile(rf"\S+(?:\s+\S+){{0,{PART_WORDS - 1}}}")
_SENTENCE = re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|(?=\n)|\Z)")
_PAIR = np.uint64(0x9FB21C651E98DF25)


def features(sentences: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and place of every word and word pair, and the words per row."""
    hashes, first = words(sentences, SIGNS)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    same = row[1:] == row[:-1]
    pairs = scramble(hashes[:-1] * _PAIR + hashes[1:])[same]
    place = (np.concatenate([hashes, pairs]) >> _SHIFT).astype(np.int64)
    return np.concatenate([row, row[1:][same]]), place, counts


def _logits(weights: np.ndarray, sentences: pa.Array) -> np.ndarray:
    """Mean feature weights by class, plus the intercept in the last row of `weights`."""
    row, place, counts = features(sentences)
    n = len(counts)
    size = np.maximum(np.bincount(row, minlength=n), 1)
    return np.stack([np.bincount(row, weights[place, c], n) / np.sqrt(size) + weights[-1, c] for c in range(weights.shape[1])], axis=1)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _examples(ordinary: list[str]) -> tuple[list[str], list[int]]:
    chance = random.Random(3)
    pool = [w for s in ordinary for w in s.split()] or ["text"]
    out: list[tuple[str, int]] = [(s, len(CLASSES) - 1) for s in ordinary]
    bare = [n for names in _NAMES.values() for n in names if not any(a in n for a in _ALONE)]
    for _ in range(160):
        before, after = (chance.choices(chance.choice((pool, _COMMON)), k=chance.choice((0, 1, 4))) for _ in range(2))
        out.append((" ".join([*before, *[chance.choice(bare)] * chance.choice((1, 1, 2)), *after]), len(CLASSES) - 1))
    # names and words of statements are ordinary text by themselves
    wordings = [w for t in [*sum(TEMPLATES.values(), []), *_UNKNOWN, "This work is"] for w in t.split() if w not in ("{}", "CC0") and "licen" not in w.lower()]
    for word in [*bare, *sorted(set(wordings))]:
        for times in (1, 1, 2, 2, 3):
            out.append((" ".join([word] * times), len(CLASSES) - 1))
        for _ in range(2):
            out.append((" ".join([word, *chance.choices(chance.choice((pool, _COMMON)), k=2)]), len(CLASSES) - 1))
    glue = {(v, w) for t in [*sum(TEMPLATES.values(), []), *_UNKNOWN] for v, w in itertools.pairwise(t.split()) if v.islower() and w.islower() and "licen" not in v + w and w != "domain"}
    for pair in sorted(glue):
        for k in (0, 1, 1, 2, 3):
            out.append((" ".join([*pair, *chance.choices(pool, k=k)]), len(CLASSES) - 1))
    for number, family in enumerate(FAMILIES):
        for k in range(240):
            if family == "unknown":
                made = chance.choice(_UNKNOWN).format(*chance.choices(pool, k=2)).split()
            elif k % 3 == 0:
                name = chance.choice(_NAMES[family])
                made = (name if any(a in name for a in _ALONE) and k % 2 else chance.choice(_SHORT).format(name)).split()
            else:
                made = [w for w in chance.choice(TEMPLATES[family]).split() if chance.random() > 0.05]
            before, after = (chance.choices(pool, k=chance.choice((0, 0, 1, 3))) for _ in range(2))
            out.append((" ".join([*chance.choice((["This", "work", "is"], [], [])), *before, *made, *after]), number))
    chance.shuffle(out)
    return [s for s, _ in out], [c for _, c in out]


def train(ordinary: list[str]) -> tuple[np.ndarray, float]:
    """Weights (places and intercept by class) and the temperature, by gradient steps of adaptive size."""
    texts, labels = _examples(ordinary)
    cut = len(texts) * 4 // 5
    sentences, target = pa.array(texts, pa.string()), np.array(labels)
    row, place, _ = features(sentences.slice(0, cut))
    value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=cut), 1))[row]
    weights, seen = np.zeros((PLACES + 1, len(CLASSES))), np.full((PLACES + 1, len(CLASSES)), 1e-6)
    hot = np.eye(len(CLASSES))[target[:cut]]
    for _ in range(60):
        error = _softmax(_logits(weights, sentences.slice(0, cut))) - hot
        gradient = np.zeros_like(weights)
        for c in range(len(CLASSES)):
            gradient[:-1, c] = np.bincount(place, error[row, c] * value, PLACES)
        gradient[-1] = error.sum(axis=0)
        gradient = gradient / cut + 1e-6 * weights
        seen += gradient**2
        weights -= 0.5 * gradient / np.sqrt(seen)
    logits, held = _logits(weights, sentences.slice(cut)), target[cut:]
    heats = np.geomspace(0.25, 8, 31)
    losses = [-np.log(_softmax(logits / t)[np.arange(len(held)), held] + 1e-300).mean() for t in heats]
    return weights, float(heats[int(np.argmin(losses))])


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


_TEMPLATE_PAIRS = {f: [set(zip(w, w[1:], strict=False)) for w in map(_tokens, wordings)] for f, wordings in TEMPLATES.items()}


def _share(sentence: str, family: str) -> float:
    """The largest share of the word pairs of a template of `family` that the sentence holds; 0 for `unknown`."""
    w = _tokens(sentence)
    own = set(zip(w, w[1:], strict=False))
    return max((len(own & t) / len(t) for t in _TEMPLATE_PAIRS.get(family, ())), default=0.0)


def _family(sentence: str, chances: np.ndarray) -> tuple[str, float]:
    """The family by the calibrated probabilities of all classes, and its template share."""
    best = int(chances[:-1].argmax())
    share = _share(sentence, FAMILIES[best])
    sure = chances[best] >= CERTAIN or (chances[best] >= SURE and share >= CONFIRMED)
    return (FAMILIES[best] if sure else "unknown"), share


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    weights, heat = train(sorted(rows["sentence"].dropna()))
    place, kind = np.nonzero(weights)
    return pd.DataFrame({"place": np.append(place, -1), "kind": np.append(kind, 0), "weight": np.append(weights[place, kind], heat)})


def _pieces(text: str) -> list[tuple[int, int, int]]:
    """(start, end, paragraph) of the pieces of a text that are not blank."""
    out, paragraph, last = [], 0, 0
    for m in _SENTENCE.finditer(text):
        piece = m[0]
        if piece.isspace():
            continue
        start, end = m.span()
        paragraph += text.count("\n", last, start) > 1
        last = end
        if piece.count(" ") >= MOST_WORDS and len(piece.split()) > MOST_WORDS:
            out += [(start + p.start(), start + p.end(), paragraph) for p in _PART.finditer(piece)]
        else:
            out.append((start, end, paragraph))
    return out


def _windows(weights: np.ndarray, pieces: pa.Array, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First piece, end piece, logits and scale of every window of pieces that are licence statements; see `_logits`."""
    hashes, first = words(pieces, SIGNS)
    n, classes = len(hashes), weights.shape[1]
    of = np.repeat(paragraph, np.diff(first))
    single, double = np.zeros((n + 1, classes)), np.zeros((n + 1, classes))
    np.cumsum(weights[(hashes >> _SHIFT).astype(np.int64)], axis=0, out=single[1:])
    if n > 1:
        pairs = weights[(scramble(hashes[:-1] * _PAIR + hashes[1:]) >> _SHIFT).astype(np.int64)]
        pairs[of[1:] != of[:-1]] = 0
        np.cumsum(pairs, axis=0, out=double[1:n])
        double[n] = double[n - 1]
    starts, ends, logits, scales = [], [], [], []
    for size in range(1, RUN + 1):
        at = np.arange(max(0, len(paragraph) - size + 1))
        a, b = first[at], first[at + size]
        fits = (paragraph[at] == paragraph[at + size - 1]) & (b > a)
        if size > 1:
            fits &= b - a <= MOST_WORDS
        at, a, b = at[fits], a[fits], b[fits]
        scale = np.sqrt(2.0 * (b - a) - 1)
        found = (single[b] - single[a] + double[b - 1] - double[a]) / scale[:, None] + weights[-1]
        hit = found.argmax(axis=1) < len(FAMILIES)
        for out, values in ((starts, at[hit]), (ends, at[hit] + size), (logits, found[hit]), (scales, scale[hit])):
            out.append(values)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(logits), np.concatenate(scales)


def _statements(weights: np.ndarray, pieces: pa.Array, paragraph: np.ndarray) -> list[tuple[int, int]]:
    """(first piece, end piece) of the windows of most evidence that do not overlap, in order."""
    starts, ends, logits, scales = _windows(weights, pieces, paragraph)
    evidence = (logits[:, :-1].max(axis=1) - logits[:, -1]) * scales - ADDED * (ends - starts)
    taken, out = np.zeros(len(paragraph), bool), []
    for k in np.lexsort((starts, ends - starts, -evidence)):
        if not taken[starts[k] : ends[k]].any():
            taken[starts[k] : ends[k]] = True
            out.append((int(starts[k]), int(ends[k])))
    return sorted(out)


def fit(docs: DataFrame) -> tuple[np.ndarray, float]:
    """The model, with ordinary text from MOST_ORDINARY distinct texts, chosen by hash: middle pieces that do not mention a licence."""
    spark = docs.sparkSession
    total = docs.count()
    share = min(1.0, MOST_ORDINARY / max(total, 1))
    picked = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) / (1 << 20) < share).distinct()

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                spans = _pieces(text or "")
                own = spans[len(spans) // 2 :][: 1 + len(spans) % 3]
                found += [text[a:b] for a, b in [(own[0][0], own[-1][1])] if "licen" not in text[a:b].lower()] if own else []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["sentence"])

    ordinary = picked.mapInArrow(one, "sentence string")
    # one more row, so that there is a group even without texts
    ordinary = ordinary.unionByName(spark.sql("select cast(null as string) as sentence"))
    model = stored(ordinary.groupBy(F.lit(0).alias("one")).applyInPandas(_fit, "place long, kind long, weight double"), "licence-model").toPandas()
    weights = np.zeros((PLACES + 1, len(CLASSES)))
    inner = model[model["place"] >= 0]
    weights[inner["place"], inner["kind"]] = inner["weight"]
    return weights, float(model.loc[model["place"] == -1, "weight"].iloc[0])


def _distinct_logits(weights: np.ndarray, statement: str) -> np.ndarray:
    """Logits with every word and pair counted once, so that repeated words add no evidence."""
    place = np.unique(features(pa.array([statement], pa.string()))[1])
    return weights[place].sum(axis=0) / np.sqrt(max(1, len(place))) + weights[-1]


def _scan(weights: np.ndarray, heat: float, spans: list[tuple[int, int, int, int]], texts: list[str], found: list[list[dict]]) -> None:
    """Append the statements in `spans` (text, start, end, paragraph), which hold whole texts, to `found`."""
    if not spans:
        return
    keys = np.array([(i, p) for i, _, _, p in spans])
    paragraph = np.append(0, np.cumsum((keys[1:] != keys[:-1]).any(axis=1)))
    for first, end in _statements(weights, pa.array([texts[i][a:b] for i, a, b, _ in spans], pa.string()), paragraph):
        i, a, b = spans[first][0], spans[first][1], spans[end - 1][2]
        chances = _softmax(_distinct_logits(weights, texts[i][a:b])[None] / heat)[0]
        if chances.argmax() == len(FAMILIES):
            continue
        family, share = _family(texts[i][a:b], chances)
        found[i].append({"start": a, "end": b, "family": family, "probability": float(1 - chances[-1]), "template": share})


def _scanner(places: np.ndarray, rows: np.ndarray, heat: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((PLACES + 1, len(CLASSES)))
        scan = partial(_scan, weights, heat)
        weights[places] = rows
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("template", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found: list[list[dict]] = [[] for _ in texts]
                spans: list[tuple[int, int, int, int]] = []
                for i, text in enumerate(texts):
                    spans += [(i, *p) for p in _pieces(text)]
                    if len(spans) >= BLOCK or i == len(texts) - 1:
                        scan(spans, texts, found)
                        spans = []
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "licences"])

    return run


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (start, end, family, probability, template share) for every row of `docs` (doc_id, text).

    Positions are code points of statements, whole lines or sentences, end exclusive, in order. Null and
    empty texts have none; an empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights, heat = fit(docs)
    used = np.flatnonzero(weights.any(axis=1))
    schema = "doc_id long, licences array<struct<start:int,end:int,family:string,probability:double,template:double>>"
    return docs.mapInArrow(_scanner(used, weights[used], heat), schema)


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan(read_table(spark, sf_dir, "documents"))
    spans = F.concat_ws(",", F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string"))))
    families = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), families.alias("families"), spans.alias("spans"))
