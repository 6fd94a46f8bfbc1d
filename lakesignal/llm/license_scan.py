"""Licence scan: a paragraph classifier over sparse word n-grams.

Logistic regressions, one a family, are trained on the driver from short notices
and licence texts of each family, cut and mixed in many ways, and from
paragraphs that only sound like licences. Their weights form a table bounded by
these texts, so paragraphs are scored by a broadcast join and a sum. Each
family's scores are calibrated on notices that the scoring model has not seen,
in whole or in part; below an even chance a paragraph is unknown. A prediction is
confirmed if enough of one of the family's templates stands in the paragraph;
without that it must be surer to be reported.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import exp, inf, log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, computed, let

#: Short notices by family; the first of each is a template that is used most.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This software is distributed under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License, Version 2.0, January 2004.",
        "The code is available under the terms of the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "MIT License",
        "The source code is available under the MIT license.",
        "Licensed under the MIT License, see the LICENSE file in the project root for details.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Distributed under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License v3.0",
        "This library is licensed under the GNU Lesser General Public License, LGPL version 2.1.",
        "Licensed under the GPL, version 3.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD 2-Clause License",
        "The software is licensed under the terms of the BSD license.",
        "This project is distributed under the New BSD License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution ShareAlike License, CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This article is distributed under the terms of the Creative Commons Attribution License.",
        "Content is licensed under CC BY-SA 3.0.",
        "Creative Commons Attribution 4.0 International (CC BY 4.0)",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
        "Available under CC BY-NC-SA 4.0 for noncommercial use only.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International (CC BY-NC 4.0)",
        "Released under CC BY-NC-ND 4.0, no commercial use.",
        "This article is distributed under the Creative Commons Attribution NonCommercial License.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights, CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
        "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
        "The text of this book is in the public domain.",
        "The author has released this work into the public domain under CC0.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright by the author, all rights reserved, no part of this work may be reproduced without written permission.",
        "Proprietary and confidential, unauthorized copying of this file is prohibited, all rights reserved.",
        "This content is copyrighted and may not be republished or redistributed.",
        "Copyright 2020, all rights reserved.",
        "No part of this publication may be reproduced, stored or transmitted without the prior written permission of the publisher.",
        "All rights are reserved by the publisher.",
    ],
}
#: Paragraphs of the licence texts themselves.
BODIES = {
    "apache-2.0": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of the Work.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "bsd": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": [
        "You are free to share, copy and redistribute the material in any medium or format and adapt, remix, transform, and build upon the material for any purpose, even commercially, under the following terms: Attribution.",
    ],
    "cc-by-nc": [
        "You may not use the material for commercial purposes under the Creative Commons Attribution NonCommercial license.",
    ],
    "public-domain": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software for any purpose, in jurisdictions that recognize copyright laws the author dedicates any and all copyright interest in the software to the public domain.",
    ],
    "all-rights-reserved": [
        "No part of this book may be used or reproduced in any manner whatsoever without written permission except in the case of brief quotations embodied in critical articles and reviews.",
    ],
}
#: Paragraphs with the same words that state no licence of the families.
OTHERS = [
    "The driver lost the license after the accident and paid a fine.",
    "You need a fishing licence to go out on the lake.",
    "The library is open to the public on most days, free of charge.",
    "She asked for permission to leave early.",
    "Human rights are a matter of public debate.",
    "Copyright law was reformed in that year.",
    "The general opinion of the public changed under the new government.",
    "A table was reserved for all of us.",
    "Version 2 of the software adds a source view, see the following conditions.",
    "The work of the foundation is known without doubt.",
    "The seminar at the institute covers common creative methods and attribution of paintings.",
    "The use of this file is described in the associated documentation.",
    "The committee may license new commercial stations under the act.",
    "No part of the city was spared by the storm.",
    "Permission to build was granted by the city council in May.",
    "The conditions of the agreement were published by the newspaper.",
    "Free copies of the program were handed out at the door.",
    "The author gave his work to the museum under a private agreement.",
    "Commercial use of the river began in the last century.",
    "The international commons debate is about creative sharing of land.",
    "He was under the impression that all of it was released in May.",
    "The general public may apply for a license at the town hall.",
    "The new version of the game was released under great pressure.",
    "Software is written, tested and distributed in short cycles.",
    "Rights of way are shown on the map.",
    "The foundation published its report on free trade.",
    # other licences: none of the families
    "Licensed under the Mozilla Public License, version 2.0.",
    "SPDX-License-Identifier: MPL-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0.",
    "Licensed under the Eclipse Public License, version 1.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "Released under the ISC License.",
    "SPDX-License-Identifier: ISC",
    "Licensed under the Boost Software License, Version 1.0.",
    "Distributed under the terms of the zlib license.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This project is licensed under the terms of the Artistic License 2.0.",
]
#: A line with one of these, or with a licence's short name, is unknown if it reaches no family.
ANCHORS = ("licen", "copyright", "rights reserved", "permission", "redistribut", "public domain", "proprietary")
NAMES = r"(?i:\b(?:[al]?gpl(?:v?[0-9.]+)?|cc[ -]by|cc0|bsd|apache|spdx)\b)|\bMIT\b"
#: Words that decide nothing by themselves: n-grams of such words alone are no features, needed_words puts others on their other words.
COMMON = frozenset(
    "a all an and any are as at be been but by can for from had has have he her his if in into is it its may no not of on one only or she that the"
    " their there they this to under was we were which will with without you your".split()
)
NGRAMS = 3
STEPS, DECAY = 150, 5.0
#: Parts that the notices of a family are dealt into for calibration; words of a cut from a licence text.
FOLDS, CUT_WORDS = 4, 14
#: Calibrated probability from which on a confirmed prediction, and one without confirmation, is reported.
LEAST, SURE = 0.5, 0.8
#: Share of a template's words that a confirmed paragraph holds.
TEMPLATE_SHARE = 0.6


def ngrams(words: list[str]) -> set[str]:
    """Runs of one to NGRAMS words that hold a word that is not COMMON."""
    runs = (words[i : i + n] for n in range(1, NGRAMS + 1) for i in range(len(words) - n + 1))
    return {" ".join(r) for r in runs if not COMMON.issuperset(r)}


def _examples(notice: str) -> list[list[str]]:
    """A notice whole, without each of its words, and its longer beginnings and ends."""
    w = ascii_words(notice)
    out = [w] * 4 + [w[:i] + w[i + 1 :] for i in range(len(w)) if len(w) > 3]
    return out + [w[: len(w) - k] for k in range(1, len(w) // 4 + 1)] + [w[k:] for k in range(1, len(w) // 4 + 1)]


def _cuts(body: str) -> list[list[str]]:
    """A paragraph of a licence text whole, and in overlapping cuts as lines hold them."""
    w = ascii_words(body)
    return [w] * 2 + [w[i : i + CUT_WORDS] for i in range(0, max(1, len(w) - CUT_WORDS // 2), CUT_WORDS // 2)]


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]  # n-gram -> a weight for each family
    bias: list[float]
    least: list[float]  # probability from which on a family is reported

    def probabilities(self, words: list[str]) -> list[float]:
        sums = list(self.bias)
        for g in ngrams(words):
            for k, w in enumerate(self.weights.get(g, ())):
                sums[k] += w
        return [1 / (1 + exp(-max(-700.0, s))) for s in sums]


def _sources() -> list[tuple[int, int, list[list[str]]]]:
    """(family or -1, fold, examples) of each notice, paragraph of a licence text and other paragraph."""
    out = [(-1, i % FOLDS, [[], *_examples(text)]) for i, text in enumerate(OTHERS)]  # a text without any known word, too
    for k, f in enumerate(NOTICES):
        texts = [_examples(t) for t in NOTICES[f]] + [_cuts(t) for t in BODIES.get(f, ())]
        out += [(k, i % FOLDS, examples) for i, examples in enumerate(texts)]
    return out


def _fit(x: np.ndarray, y: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights (n-grams, families) and biases by accelerated gradient descent; same = x @ x.T.

    Weights are sums of examples, so only each example's share of them is searched for.
    """
    n = len(x)
    share, bias = np.zeros(y.shape), np.full(y.shape[1], -1.0)
    ahead, ahead_bias = share, bias
    rate = 4.0 / (np.trace(same) / n + 1)
    for step in range(STEPS):
        gap = 1 / (1 + np.exp(-np.clip(same @ ahead + ahead_bias, -30, 30))) - y
        new, new_bias = ahead - rate / n * (gap + DECAY * ahead), ahead_bias - rate * gap.mean(axis=0)
        push = step / (step + 3)
        ahead, ahead_bias = new + push * (new - share), new_bias + push * (new_bias - bias)
        share, bias = new, new_bias
    return x.T @ share, bias


def _calibrated(sums: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from unseen sums to labels, towards (n + 1) / (n + 2) as is usual."""
    n = y.sum()
    goal = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    share = 1 / len(y)

    def loss(slope: float, shift: float) -> float:
        z = slope * sums + shift
        return float((share * (np.logaddexp(0, z) - goal * z)).sum())

    slope, shift, now = 1.0, 0.0, loss(1.0, 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * sums + shift, -30, 30)))
        gap, bend = share * (p - goal), share * p * (1 - p)
        hess = np.array([[(bend * sums * sums).sum(), (bend * sums).sum()], [(bend * sums).sum(), bend.sum()]]) + 1e-6 * np.eye(2)
        d_slope, d_shift = np.linalg.solve(hess, [(gap * sums).sum(), gap.sum()])
        size = 1.0
        while size > 1e-6 and loss(max(0.05, slope - size * d_slope), shift - size * d_shift) > now:
            size /= 2
        slope, shift = max(0.05, slope - size * d_slope), shift - size * d_shift
        before, now = now, loss(slope, shift)
        if before - now < 1e-10:
            break
    return float(slope), float(shift)


@dataclass
class Training:
    """The examples as a table of n-grams, and each one's sums by a model that has not seen its notice."""

    words: list[list[str]]
    family: np.ndarray
    grams: list[str]
    unseen: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


def training() -> Training:
    sources = _sources()
    words = [w for _, _, examples in sources for w in examples]
    family = np.array([k for k, _, examples in sources for _ in examples])
    fold = np.array([f for _, f, examples in sources for _ in examples])
    grams = sorted({g for w in words for g in ngrams(w)})
    place = {g: i for i, g in enumerate(grams)}
    x = np.zeros((len(words), len(grams)))
    for i, w in enumerate(words):
        x[i, [place[g] for g in ngrams(w)]] = 1
    y = (family[:, None] == np.arange(len(NOTICES))[None]).astype(float)
    unseen, same = np.zeros_like(y), x @ x.T
    for f in range(FOLDS):
        seen = fold != f
        weights, bias = _fit(x[seen], y[seen], same[np.ix_(seen, seen)])
        unseen[~seen] = x[~seen] @ weights + bias
    return Training(words, family, grams, unseen, *_fit(x, y, same))


@lru_cache(maxsize=1)
def train() -> Model:
    """The model of all examples, each family's sums put on the curve that fits unseen notices."""
    t = training()
    n = len(NOTICES)
    curves = [_calibrated(t.unseen[:, k], (t.family == k).astype(float)) for k in range(n)]
    slopes, shifts = (np.array(x) for x in zip(*curves, strict=True))
    weights = t.weights * slopes
    return Model(list(NOTICES), {g: [round(float(v), 6) for v in w] for g, w in zip(t.grams, weights, strict=True)}, [float(x) for x in t.bias * slopes + shifts], [LEAST] * n)


def held_out_figures() -> dict[str, float]:
    """Precision and recall of the likeliest family at LEAST and SURE over notices that the scoring model has not seen."""
    t = training()
    p = np.stack([1 / (1 + np.exp(-(a * t.unseen[:, k] + b))) for k in range(len(NOTICES)) for a, b in [_calibrated(t.unseen[:, k], (t.family == k).astype(float))]], axis=1)
    best, out = p.argmax(axis=1), {}
    for name, least in (("least", LEAST), ("sure", SURE)):
        said = p.max(axis=1) >= least
        right = said & (best == t.family)
        out |= {f"precision_{name}": right.sum() / max(1, said.sum()), f"recall_{name}": right.sum() / (t.family >= 0).sum()}
    return out


def weight_table(spark: SparkSession, model: Model) -> DataFrame:
    """(gram, weights): as many rows as the notices have n-grams."""
    rows = sorted(model.weights.items())
    return spark.createDataFrame(rows, "gram string, weights array<double>")


def has_anchor(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for a in ANCHORS:
        out = out | low.contains(a)
    return out


def is_named(text: Column) -> Column:
    return has_anchor(text) | text.rlike(NAMES)


def bounds(model: Model) -> list[tuple[float, dict[str, float]]]:
    """For each family the sum that its least probability takes, and what lies on each word.

    Each n-gram of positive weight is put on one of its words, so a paragraph's
    sum is at most the sum over its distinct words of what lies on them.
    """
    out = []
    for f, least in enumerate(model.least):
        need = log(least / (1 - least)) - model.bias[f] - 1e-3 if least < 1 else inf  # weights and chances are rounded
        lies: dict[str, float] = {}
        for g, v in model.weights.items():
            if v[f] > 0:
                w = max(g.split(), key=lambda x: (x not in COMMON, model.weights.get(x, v)[f], x))
                lies[w] = lies.get(w, 0.0) + v[f]
        out.append((need, lies))
    return out


def needed_words(model: Model) -> list[str] | None:
    """Words of which a paragraph holds one at least if any family reaches its least probability; None if it needs none.

    For each family the words that together stay below the needed sum are left out.
    """
    out = set()
    for need, lies in bounds(model):
        if need <= 0:
            return None
        total = 0.0
        for w in sorted(lies, key=lambda x: (x not in COMMON, lies[x], x)):
            if total + lies[w] < need:
                total += lies[w]
            else:
                out.add(w)
    return sorted(out)


def can_reach(words: Column, model: Model) -> Column:
    """Whether the bound of any family comes up to its needed sum."""
    limits = bounds(model)
    known = sorted({w for _, lies in limits for w in lies})
    if not known:
        return F.lit(any(need <= 0 for need, _ in limits))
    table = F.lit([[float(lies.get(w, 0.0)) for _, lies in limits] for w in known])
    names = F.lit(known)

    def any_reaches(found: Column) -> Column:
        out = F.lit(False)
        for f, (need, _) in enumerate(limits):
            out = out | (F.aggregate(F.transform(found, lambda v: v[f]), F.lit(0.0), lambda t, x: t + x) >= need)  # noqa: B023
        return out

    held = F.transform(F.array_intersect(words, names), lambda w: F.element_at(table, F.array_position(names, w).cast("int")))
    return let(held, any_reaches)


def paragraphs(docs: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, doc, place, n, words, named) of the lines, and runs of n wrapped lines, that may hold a licence.

    A run holds no empty line, and its lines but the last have fewer words than the longest notice.
    """
    need, longest = needed_words(model), max(len(ascii_words(t)) for ts in NOTICES.values() for t in ts)
    text = F.col(text_col)
    held = docs.where(text.isNotNull())
    held = held.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc"), F.split(text_col, "\n").alias("lines"))
    words = F.transform("lines", lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != ""))
    held = computed(held, "all", words)
    held = computed(held, "sizes", F.transform("all", lambda w: F.size(w)))

    def lengths(i: Column) -> Column:
        """How many lines from line i on make a paragraph: one, and those of its runs."""
        here = F.get("sizes", i)
        counts = lambda n: F.slice("sizes", i + 1, n)
        most = F.least(F.size("all") - i, F.lit(longest))
        fits = lambda n: ~F.exists(counts(n), lambda c: c == 0) & (F.aggregate(counts(n - 1), F.lit(0), lambda t, c: t + c) < longest)
        one = F.array(F.lit(1))
        return F.when((here > 0) & (here < longest) & (most >= 2), F.concat(one, F.filter(F.sequence(F.lit(2), most), fits))).otherwise(one)

    def cut(i: Column) -> Column:
        run = lambda n: F.when(n == 1, F.get("all", i)).otherwise(F.flatten(F.slice("all", i + 1, n)))
        line = lambda n: F.when(n == 1, F.get("lines", i))
        return F.transform(lengths(i), lambda n: F.struct(i.alias("place"), n.alias("n"), run(n).alias("words"), line(n).alias("line")))

    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.size("all") - 1), cut))
    out = held.select("id", "doc", F.explode(parts).alias("part")).select("id", "doc", "part.*")
    out = computed(out, "named", F.coalesce(is_named(F.col("line")), F.lit(False)))
    asked = F.lit(True)
    if need is not None:
        asked = F.arrays_overlap("words", F.array(*map(F.lit, need)).cast("array<string>")) & can_reach(F.col("words"), model)
    return out.where(F.col("named") | asked).select("id", "doc", "place", "n", "words", "named")


def gram_columns(words: Column) -> Column:
    """All distinct n-grams of an array of words."""
    size = F.size(words)

    def runs(n: int) -> Column:
        starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.concat(words, *(runs(n) for n in range(2, NGRAMS + 1))))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence paragraphs: doc_id, place (first line from 0), family, probability, confirmed.

    Lines are the paragraphs, and runs of wrapped lines. One row for each
    distinct (doc_id, place, words) of a line whose likeliest family reaches
    its least probability, or that holds an anchor or a licence's name. Its
    family is the likeliest one if that is confirmed by a template or reaches
    SURE, else 'unknown'. A run gives a row if it is confirmed and
    holds more of a notice than any line or run of that family that
    overlaps it; its unconfirmed lines then give none. Equal
    probabilities go to the family named first. Null and empty texts have no
    paragraphs; texts of any length are scanned whole. An empty table gives an
    empty table. Rows that repeat an id are scanned each; equal ones give one
    row. A null id stays null. Extra columns are ignored.
    """
    spark = docs.sparkSession
    model = model or train()
    n = len(model.families)
    keys = ["id", "doc", "place", "n", "words", "named"]
    lines = paragraphs(docs, id_col, text_col, model).distinct()
    grams = lines.select(*keys, F.explode_outer(gram_columns(F.col("words"))).alias("gram"))
    table = F.broadcast(weight_table(spark, model))
    parts = grams.join(table, "gram", "left").groupBy(*keys)
    sums = parts.agg(*(F.coalesce(F.sum(F.get("weights", F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in range(n)))
    chances = F.array(*(F.round(1 / (1 + F.exp(-(F.col(f"s{k}") + model.bias[k]))), 9) for k in range(n)))
    scored = sums.select(*keys, chances.alias("p"))
    best = F.array_max("p")
    at = F.array_position("p", best).cast("int")
    least = F.element_at(F.array(*map(F.lit, model.least)), at)
    own = [(k + 1, sorted(set(ascii_words(notice)))) for k, f in enumerate(model.families) for notice in NOTICES.get(f, ())]
    templates = F.array(*(F.struct(F.lit(k).alias("at"), F.array(*map(F.lit, w)).alias("words"), F.lit(TEMPLATE_SHARE * len(w)).alias("least")) for k, w in own))
    mine = F.filter(templates, lambda t: t["at"] == at)
    common = F.transform(mine, lambda t: let(F.size(F.array_intersect(F.col("words"), t["words"])), lambda c: F.when(c >= t["least"], c).otherwise(0)))
    shared = F.coalesce(F.array_max(common), F.lit(0))  # the most words of a notice that confirms
    reached = best >= least
    known = reached & ((shared > 0) | (best >= SURE))
    family = F.when(known, F.element_at(F.array(*map(F.lit, model.families)), at)).otherwise("unknown")
    hits = scored.where(reached | F.col("named")).select(
        *keys, family.alias("family"), best.alias("probability"), F.when(reached, shared).otherwise(0).alias("shared")
    )
    hits = hits.where((F.col("n") == 1) | (F.col("shared") > 0))
    # A run stays if it is the best of its family at each line that it covers.
    covered = hits.withColumn("at", F.explode(F.sequence("place", F.col("place") + F.col("n") - 1)))
    rank = F.row_number().over(Window.partitionBy("id", "doc", "family", "at").orderBy(F.desc("shared"), "n", "place"))
    hit = [*keys, "family", "probability", "shared"]
    covered = covered.withColumn("first", rank == 1)
    wins = F.min("first").over(Window.partitionBy(*hit))
    covered = covered.withColumn("stays", wins & (F.col("n") > 1))
    covered = covered.withColumn("wrapped", F.max("stays").over(Window.partitionBy("id", "doc", "at")))
    covered = covered.where(F.col("at") == F.col("place"))
    alone = (F.col("n") == 1) & ((F.col("shared") > 0) | ~F.col("wrapped"))
    out = covered.where(F.col("stays") | alone).select("id", "place", "n", "words", "family", "probability", "shared").distinct()
    return out.select(
        F.col("id").alias("doc_id"),
        F.col("place").cast("long").alias("place"),
        "family",
        "probability",
        (F.col("shared") > 0).alias("confirmed"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every licence paragraph of every document."""
    from .common import table

    return scan(table(spark, sf_dir, "documents"))
