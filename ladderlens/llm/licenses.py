"""License scans: a trained paragraph classifier, with columns only.

Paragraphs are the lines of a text.  A sparse logistic regression over word
1- and 2-grams is trained on the templates below, on parts of them, on
other text and on single words of licences inside other text.  Its classes are the licence families, ``unknown`` (licence
language of no family) and ``none``.  Probabilities are calibrated by a
temperature on held-out examples, and a family's prediction below ``floor``
(set so that few held-out examples of other licences pass) is ``unknown``.  A
paragraph whose probability of being any licence is below ``detect`` (set so
that few held-out examples of other text pass) is ``none``.  A
prediction stands only if the paragraph shares enough of its word pairs with a
template of the family; otherwise it is ``unknown`` too.

The regression is small and fixed, as are the templates; its weights are a
small table.  All work on texts is DataFrame functions: lines are exploded,
those with a word that the model knows are candidates (others have no feature
but the constant, and that is ``none``), equal lines are scored once, and
scores go back to their lines.

Defined results: null and empty texts have no paragraph of a licence and give
no row.  Repeated rows give their rows again.  Columns other than doc_id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import random

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"

#: Notices of each licence family.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution License (CC BY)",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution NonCommercial License (CC BY-NC)",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc0": ["Dedicated to the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work (CC0 1.0 Universal)."],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
#: Licence language of no family.
OTHER = [
    "Licensed under the Example Community License, version 1.2.",
    "This work is licensed under the Open Data Commons terms of the archive.",
    "Released under the Artistic License.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Licensed under the Boost Software License.",
    "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
    "Use of this product is subject to the terms of the end user license agreement.",
    "Distributed under a proprietary license; see the vendor for terms.",
    "SPDX-License-Identifier: Zlib",
    "The dataset is released under a custom research license.",
    "Licensed under the Open Font License, version 1.1.",
]
#: Text of other kinds that shares words with licences.
PLAIN = [
    "The driver lost his license after the accident and may not use the car.",
    "The public library keeps a copy of the work in its general collection.",
    "She gave her permission for the software to be tested without a fee.",
    "Version 2.0 of the program was released in March and is distributed to schools.",
    "Students at MIT published the results of the source survey.",
    "The Apache helicopter landed behind the hill.",
    "A fishing license is required by law in the area, with conditions of any kind.",
    "The foundation published a free guide to modern terms of art.",
    "The creative team wrote commons sense rules for the public square.",
    "The warranty of the machine covers parts and any damage in transit.",
    "He may be reached in writing at the address above, provided that the office is open.",
    "The author of this work lives in the city and writes for the public.",
    "International rights groups met to talk about attribution of the attack.",
    "This is an ordinary paragraph of text without any special words in it.",
    "Der Hund geht mit dem Kind in den Park und kommt mit dem Bus wieder nach Hause.",
    "Mit der Zeit wird alles gut, und mit Geduld noch besser.",
    "Er fährt mit dem Zug.",
    "Le public attend la version originale dans la salle sous la pluie.",
    "El general no tiene licencia para usar la fuente original.",
]
#: Words that no feature starts from.
COMMON = set("a an and any are as at be but by can for from has have if in is it its may must no not of on or that the their this to was were with you your all under which who will into out only see".split())

SPLIT = r"[^\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    return [w for w in regex.split(SPLIT, text.lower()) if w]


def grams(tokens: list[str]) -> set[str]:
    return set(tokens) | {f"{a} {b}" for a, b in zip(tokens, tokens[1:])}  # noqa: B905


def telling(word: str) -> bool:
    """Whether features may start from this word: numbers and common words say nothing alone."""
    return word not in COMMON and not word.isdigit()


def examples(seed: int = 3) -> list[tuple[str, str]]:
    """(text, class): templates, parts of them, with words left out and inside other text."""
    r, out = random.Random(seed), []
    sources = [(t, f) for f, ts in TEMPLATES.items() for t in ts] + [(t, UNKNOWN) for t in OTHER] + [(t, NONE) for t in PLAIN]
    for text, label in sources:
        out.append((text, label))
        tokens = text.split()
        for _ in range(24):
            part = [w for w in tokens if r.random() > 0.08]
            if len(part) > 12:
                a = r.randint(0, len(part) - 10)
                part = part[a : a + r.randint(10, len(part))]
            if r.random() < 0.5:
                noise = r.choice(PLAIN).split()
                part = noise[: r.randint(0, 6)] + part + noise[r.randint(4, 9) :][: r.randint(0, 6)]
            out.append((" ".join(part), label))
        noise = [w for t in PLAIN for w in t.split()]
        out += [(" ".join(r.choice(noise) for _ in range(r.randint(3, 20))), NONE) for _ in range(3)]
    for word in sorted({w for t, label in sources if label != NONE for w in words(t) if telling(w)}):  # a word alone is no licence
        for _ in range(4):
            out.append((" ".join([r.choice(noise) for _ in range(r.randint(1, 12))] + [word] + [r.choice(noise) for _ in range(r.randint(1, 12))]), NONE))
    return out


class Model:
    """Classes, a weight for each (gram, class), constants, temperature, and the least probabilities of a family (floor) and of any licence (detect)."""

    def __init__(self, l1: float = 2e-4, steps: int = 400) -> None:
        rows = examples()
        self.classes = [*sorted(TEMPLATES), UNKNOWN, NONE]
        hold = np.arange(len(rows)) % 4 == 3
        features = [grams(words(t)) for t, _ in rows]
        known = sorted({g for t in [*(t for ts in TEMPLATES.values() for t in ts), *OTHER] for g in grams(words(t)) if any(map(telling, g.split()))})
        self.grams = known
        column = {g: i for i, g in enumerate(known)}
        x = np.zeros((len(rows), len(known)))
        for i, f in enumerate(features):
            x[i, [column[g] for g in f if g in column]] = 1
        y = np.array([self.classes.index(c) for _, c in rows])
        self.weights, self.constants = self._fit(x[~hold], y[~hold], l1, steps)
        logits = x[hold] @ self.weights + self.constants
        self.temperature = min((t / 20 for t in range(4, 61)), key=lambda t: -np.log(self._softmax(logits / t)[np.arange(hold.sum()), y[hold]] + 1e-12).mean())
        p = self._softmax(logits / self.temperature)[:, : len(TEMPLATES)].max(axis=1)
        other = p[y[hold] >= len(TEMPLATES)]
        self.floor = float(round(max(0.5, np.quantile(other, 0.99)), 4))
        held = self._softmax(logits / self.temperature)
        self.detect = float(round(max(0.5, np.quantile(1 - held[y[hold] == len(self.classes) - 1, -1], 0.99)), 4))
        used = np.abs(self.weights).sum(axis=1) > 0
        self.grams, self.weights = [g for g, u in zip(known, used, strict=True) if u], self.weights[used]
        if self.constants.argmax() != self.classes.index(NONE):
            raise ValueError("a text without features must be of no licence")

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Multinomial logistic regression with an L1 penalty, by accelerated proximal gradient."""
        w, b = np.zeros((x.shape[1], len(self.classes))), np.zeros(len(self.classes))
        b[-1] = 2.0
        target = np.eye(len(self.classes))[y]
        rate = 4 * len(x) / np.linalg.norm(x, 2) ** 2
        ahead, t = w.copy(), 1.0
        for _ in range(steps):
            gap = (self._softmax(x @ ahead + b) - target) / len(x)
            new = ahead - rate * (x.T @ gap)
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
        return np.round(w, 6), b

    def table(self) -> list[dict]:
        return [{"gram": g, **{f"w{i}": float(v) for i, v in enumerate(row)}} for g, row in zip(self.grams, self.weights, strict=True)]


def literal_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small DataFrame from rows, by one JSON literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _pairs(tokens: Column) -> Column:
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(tokens), F.lit(2))), lambda i: F.concat_ws(" ", F.get(tokens, i - 2), F.get(tokens, i - 1)))


def scan(docs: DataFrame, model: Model | None = None, confirm: float = 0.8) -> DataFrame:
    """A row for each line with licence language.

    doc_id, line (from 0), family (or ``unknown``), probability of the
    predicted class, predicted class, and similarity to its nearest template.
    """
    model = model or Model()
    spark, n = docs.sparkSession, len(model.classes)
    tokens = F.filter(F.split(F.lower("line_text"), SPLIT), lambda w: w != "")
    vocabulary = F.lit(sorted({w for g in model.grams for w in g.split() if telling(w)}))
    lines = (
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
        .where(F.length("line_text") > 0)
        .withColumn("tokens", tokens)
        .where(F.arrays_overlap("tokens", vocabulary))
        .select("doc_id", "line", "tokens", F.xxhash64("tokens").alias("h1"), F.xxhash64("tokens", F.lit(1)).alias("h2"))
    )
    weights = literal_table(spark, model.table(), "gram string, " + ", ".join(f"w{i} double" for i in range(n)))
    once = lines.groupBy("h1", "h2").agg(F.first("tokens").alias("tokens"))
    scored = (
        once.select("h1", "h2", F.explode(F.array_distinct(F.concat("tokens", _pairs(F.col("tokens"))))).alias("gram"))
        .join(F.broadcast(weights), "gram")  # as many rows as the model has features
        .groupBy("h1", "h2")
        .agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in range(n)))
    )
    logit = [(F.col(f"s{i}") + float(model.constants[i])) / model.temperature for i in range(n)]
    top = F.greatest(*logit)
    mass = sum((F.exp(z - top) for z in logit), F.lit(0.0))
    scored = scored.select(
        "h1",
        "h2",
        F.coalesce(*(F.when(z == top, F.lit(c)) for c, z in zip(model.classes, logit, strict=True))).alias("predicted"),
        (1 / mass).alias("probability"),
        (1 - F.exp(logit[-1] - top) / mass).alias("any"),
    ).where((F.col("predicted") != NONE) & (F.col("any") >= model.detect))
    templates = literal_table(spark, [{"family": f, "own": sorted(p for p in grams(words(t)) if " " in p)} for f, ts in TEMPLATES.items() for t in ts], "family string, own array<string>")
    near = (
        scored.join(once, ["h1", "h2"])
        .join(F.broadcast(templates), F.col("family") == F.col("predicted"), "left")  # the fixed templates
        .withColumn("pairs", F.array_distinct(_pairs(F.col("tokens"))))
        .withColumn("similar", F.size(F.array_intersect("pairs", "own")) / F.least(F.size("pairs"), F.size("own")))
        .groupBy("h1", "h2", "predicted", "probability")
        .agg(F.round(F.coalesce(F.max("similar"), F.lit(0.0)), 6).alias("similarity"))
    )
    sure = (F.col("probability") >= model.floor) & (F.col("similarity") >= confirm)
    return lines.join(near, ["h1", "h2"]).select(
        "doc_id",
        "line",
        F.when(sure, F.col("predicted")).otherwise(UNKNOWN).alias("family"),
        F.round("probability", 4).alias("probability"),
        "predicted",
        "similarity",
    )
