"""License scans: a trained paragraph classifier, confirmed by templates, scored in Spark.

A softmax regression over word unigrams and bigrams, with proximal steps that leave few weights, is trained on passages
of public license texts and notices, on notices of other licenses (unknown), and on a bounded sample of paragraphs that
are none. Temperature and threshold come from notices that the fold's classifier has not seen, so that what looks like a
license but not surely like one of the families is unknown. What is left must share most of its bigrams with a template
of its family: its name, or a passage of its text.

Paragraphs end at blank lines (comment marks count as blank) and at line breaks after a sentence's end, so that wrapped
lines are one paragraph. Paragraphs that only name the holder of a copyright are left out.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashed_sample, table

#: Most paragraphs without a license that the classifier is trained on.
MAX_OTHERS = 4_000
#: Least share of bigrams in common with a template, and the precision that the threshold aims at on unseen notices.
OVERLAP, PRECISION = 0.6, 0.98
#: A paragraph of so many bigrams that has this share in common with its family's text need not reach the threshold.
LONG, VERBATIM = 8, 0.9
FOLDS = 3
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Between paragraphs.
BREAK = r"(?:(?<=[.!?])|(?<=[.!?][\"')\]]))[\x20\x09\x0B-\x0D]*+\n|\n[\x20\x09\x0B-\x0D#*/;%-]*+\n"
#: A paragraph that is blank, or only names the holder of a copyright.
NO_PARAGRAPH = r"^[^\p{L}\p{N}(©]*+(?:$|(?i:copyright|©|\(c\))(?!.*(?i:licen|reserved))[^.\n]{0,120}\.?$)"

# Public license texts, a paragraph a string.
TEXTS = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "proprietary": ["This document is proprietary and confidential. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."],
}
# Names by which a family is known, beside its text.
NAMES = {
    "mit": ["MIT License", "License MIT", "MIT licensed", "Identifier MIT"],
    "apache-2.0": ["Apache License Version 2.0", "Apache 2.0", "Apache License"],
    "gpl": ["GNU General Public License", "GNU GPL", "Identifier GPL", "the GPL"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "Identifier LGPL", "the LGPL"],
    "bsd": ["BSD License", "BSD 3 Clause", "BSD 2 Clause", "BSD style license"],
    "mpl-2.0": ["Mozilla Public License", "MPL 2.0"],
    "cc-by": ["Creative Commons Attribution 4.0", "CC BY 4.0"],
    "cc-by-sa": ["Creative Commons Attribution ShareAlike", "CC BY SA"],
    "cc-by-nc": ["Creative Commons Attribution NonCommercial", "CC BY NC"],
    "cc0": ["CC0 1.0", "public domain dedication", "under CC0"],
    "unlicense": ["the Unlicense", "Identifier Unlicense"],
    "isc": ["ISC License", "License ISC", "Identifier ISC"],
    "proprietary": ["All rights reserved", "proprietary and confidential"],
}
# Short public notices of each family.
NOTICES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "License: MIT", "Available as open source under the terms of the MIT License.", "The code is MIT licensed, see the file LICENSE."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "This software is released under the Apache 2.0 license.", "Distributed under the Apache License 2.0, see LICENSE for details."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL version 2.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "You may use this program under the terms of the GPL.", "Distributed under the GNU General Public License v2 or later."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the GNU LGPL version 3.", "This library may be used under the terms of the LGPL."],
    "bsd": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-2-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "This package is licensed under the new BSD license."],
    "mpl-2.0": ["Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL 2.0.", "The contents of this file are subject to the Mozilla Public License."],
    "cc-by": ["Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "Text is available under the Creative Commons Attribution 4.0 License.", "Shared under a CC BY 4.0 license."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0", "Text is available under the Creative Commons Attribution-ShareAlike License.", "Shared under a CC BY-SA 3.0 license."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Figures are available under the Creative Commons Attribution-NonCommercial License.", "Shared under a CC BY-NC 3.0 license."],
    "cc0": ["Released under CC0 1.0 Universal, public domain dedication.", "SPDX-License-Identifier: CC0-1.0", "The data are made available under CC0.", "Dedicated to the public domain under CC0 1.0."],
    "unlicense": ["Released under the Unlicense.", "SPDX-License-Identifier: Unlicense", "For more information on the Unlicense, see unlicense.org.", "This project is dedicated to the public domain by the Unlicense."],
    "isc": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", "This module is licensed under the ISC license.", "License: ISC"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited.", "Copyright 2020 Example Ltd. All rights reserved.", "Proprietary and confidential.", "No part of this publication may be reproduced without permission. All rights reserved."],
}
# Notices of licenses outside the families.
UNKNOWN = [
    "Licensed under the Eclipse Public License 2.0.",
    "SPDX-License-Identifier: EPL-2.0",
    "Distributed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "This program is licensed under the Artistic License 2.0.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Released under the zlib License.",
    "SPDX-License-Identifier: Zlib",
    "Made available under the Open Database License.",
    "This code is released under the Microsoft Public License.",
    "Licensed under the Common Development and Distribution License.",
    "Use of this model is governed by the Community License Agreement.",
    "You may use this software under the license in the file COPYING.",
    "See the license that came with the program for the terms of use.",
]
# Sentences that name licenses without being one.
LOOKALIKES = [
    "He lost his driving license on the way to the station.",
    "The license plate of the car was covered with mud.",
    "The council may license new taxis next year.",
    "A general public meeting was held about the new library.",
    "The version of the story that she released differs from mine.",
    "Permission to enter the building was granted by the owner.",
    "Students of the institute met the software company in public.",
    "The work under way on the bridge is free of charge to the town.",
    "The apache helicopter flew under the clouds.",
    "You may not use this door except in an emergency.",
    "Copyright law protects the authors of books and songs.",
    "Lawyers discussed whether the license had been granted in writing.",
    "The court said that the rights reserved to the states were not at issue.",
    "Researchers at MIT published a new study of the oceans.",
    "The fishing licence costs ten pounds and lasts for a year.",
    "A warranty of two years is provided with the machine.",
    "The museum released its collection of maps to the public.",
    "The foundation gave a free copy of the book to any person who came.",
    "Which license should we choose for our code, she asked.",
    "The source of the river and the binary stars are subjects of the course.",
    "The mozilla developers met in Berlin.",
    "Creative people are common in this town.",
    "The gnu is a large antelope of Africa.",
    "Domain names of the public sector were moved in spring.",
]
# Words too common to point to a license by themselves.
COMMON = set("a all an and any are as at be by can for from in is it its may new not of on or that the this to use was which with without you your".split())
CLASSES = ["none", "unknown", *NOTICES]


def _found(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


def grams_of(text: str) -> list[str]:
    """The different unigrams that aren't common, and bigrams not of two common words."""
    found = _found(text)
    out = [w for w in found if w not in COMMON]
    out += [f"{a} {b}" for a, b in zip(found, found[1:]) if not (a in COMMON and b in COMMON)]
    return sorted(set(out))


def pairs_of(text: str) -> list[str]:
    """The different bigrams."""
    found = _found(text)
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:])})


def templates() -> dict[str, list[list[str]]]:
    """Bigrams of the names and of the text's paragraphs of each family; short notices aren't among them."""
    return {f: [pairs_of(t) for t in [*NAMES[f], *TEXTS[f]]] for f in NOTICES}


def overlap_with(pairs: set[str], family: list[list[str]]) -> float:
    """The greatest share of bigrams in common, of the shorter of text and template."""
    return max((len(pairs.intersection(t)) / max(min(len(t), len(pairs)), 1) for t in family), default=0.0)


@dataclass(frozen=True)
class Classifier:
    """Weights by gram for each class, biases, temperature, and the least probability of a family.

    unseen: on notices that the fold's classifier wasn't trained on, the share with the right class, the share of families
    among those that got one surely and rightly, and the mean distance of probabilities from shares (in ten bins).
    """

    grams: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    unseen: dict[str, float]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        index = {g: i for i, g in enumerate(self.grams)}
        z = np.array([self.bias + self.weights[[index[g] for g in grams_of(t) if g in index]].sum(axis=0) for t in texts]).reshape(len(texts), -1)
        return _soft(z / self.temperature)


def _soft(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _passages(seed: int) -> list[tuple[str, str, int]]:
    """(text, class, fold): whole and partial texts and notices with some words lost. All made of one notice are in one fold."""
    rng, out = random.Random(seed), []
    for family in NOTICES:
        for i, notice in enumerate([*TEXTS[family], *NOTICES[family]]):
            said = notice.split()
            for k in range(12):
                part = said if len(said) <= 14 or k % 3 == 0 else said[(a := rng.randrange(len(said) - 12)) : a + rng.randint(12, len(said))]
                out.append((" ".join(w for w in part if k == 0 or rng.random() > 0.06), family, i % FOLDS))
    vendors = ["Foo", "Example", "Community", "Open Model", "Vendor", "Acme", "Research", "Sample", "Evaluation"]
    for i, notice in enumerate(UNKNOWN):
        said = notice.split()
        out += [(" ".join(w for w in said if k == 0 or rng.random() > 0.06), "unknown", i % FOLDS) for k in range(12)]
    for k in range(90):
        name = rng.randrange(len(vendors))
        said = rng.choice(["Licensed under the", "Released under the", "Distributed under the terms of the", "This work is licensed under the"])
        out.append((f"{said} {vendors[name]} License, version {rng.randint(1, 9)}.", "unknown", name % FOLDS))
    return out


def _sums(rows: list[tuple[str, str, int]], grams: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different rows of grams found, with class, fold and number of rows each."""
    index, seen = {g: i for i, g in enumerate(grams)}, {}
    for text, name, fold in rows:
        key = (tuple(index[g] for g in grams_of(text) if g in index), CLASSES.index(name), fold)
        seen[key] = seen.get(key, 0) + 1
    x = np.zeros((len(seen), len(grams)), dtype=np.float32)
    for i, (found, _, _) in enumerate(seen):
        x[i, list(found)] = 1.0
    y, fold = (np.array([k[j] for k in seen]) for j in (1, 2))
    return x, y, fold, np.array(list(seen.values()), dtype=np.float32)


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int, sparsity: float) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by accelerated proximal steps; none weighs as much as all other classes, and these the same."""
    want = np.eye(len(CLASSES), dtype=np.float32)[y]
    share = n / np.maximum(want.T @ n, 1.0)[y] * np.where(y == 0, len(CLASSES) - 1, 1).astype(np.float32)
    share /= share.sum()
    w, b, step = np.zeros((x.shape[1], len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32), np.float32(0.5)
    last_w, last_b = w, b
    for k in range(rounds):
        ahead = np.float32(k / (k + 3))
        at_w, at_b = w + ahead * (w - last_w), b + ahead * (b - last_b)
        error = (_soft(x @ at_w + at_b) - want) * share[:, None]
        last_w, last_b = w, b
        w, b = at_w - step * (x.T @ error), at_b - step * error.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - step * np.float32(sparsity), 0)
    return w, b


def train(others: list[str], seed: int = 3, rounds: int = 400, sparsity: float = 1e-4, without: str | None = None) -> Classifier:
    """Trains on all passages and on other paragraphs; calibrates on folds of notices held out in turn.

    Other paragraphs are taken as none, those with license words too, unless they share a third of a template's bigrams or
    say to be licensed. A family named as `without` gives no training rows, to see what becomes of its notices.
    """
    known = [t for f in templates().values() for t in f]
    says = re.compile(r"licen[sc]ed under|licen[sc]e,? v|spdx-licen", re.I)
    plain = [x for x in others if not says.search(x) and overlap_with(set(pairs_of(x)), known) < 1 / 3]
    rows = [r for r in _passages(seed) if r[1] != without]
    rows += [(x, "none", i % FOLDS) for i, x in enumerate([*LOOKALIKES, *plain])]
    # Lookalikes weigh as much as all other paragraphs without a license together.
    rows += [(x, "none", i % FOLDS) for i, x in enumerate(LOOKALIKES)] * (len(plain) // len(LOOKALIKES))
    grams = sorted({g for text, name, _ in rows if name != "none" for g in grams_of(text)} | {g for x in LOOKALIKES for g in grams_of(x)})
    x, y, fold, n = _sums(rows, grams)
    z = np.zeros((len(y), len(CLASSES)), np.float32)
    for k in range(FOLDS):
        w, b = _fit(x[fold != k], y[fold != k], n[fold != k], rounds, sparsity)
        z[fold == k] = x[fold == k] @ w + b
    share = n / np.maximum(np.bincount(y, n, len(CLASSES)), 1.0)[y]

    def chosen(of: np.ndarray) -> tuple[float, float]:
        """The temperature that fits the rows weighed best, and the least threshold from which on precision among them is enough."""
        loss = lambda t: -(np.log(np.maximum(_soft(z / t)[np.arange(len(y)), y], 1e-12)) * of).sum()
        temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        p = _soft(z / temperature)
        best, sure = p.argmax(axis=1), p.max(axis=1)
        right = lambda t: (of * (best == y))[(best > 1) & (sure >= t)].sum() / max(of[(best > 1) & (sure >= t)].sum(), 1e-9)
        steps = np.arange(0.5, 0.95, 0.025)
        short = [t for t in steps if right(t) < PRECISION]
        return temperature, next((t for t in steps if not short or t > max(short)), 0.95)

    def judged(best: np.ndarray, sure: np.ndarray, above: np.ndarray) -> dict[str, float]:
        bins = np.minimum((sure * 10).astype(int), 9)
        off = sum(abs((share * ((best == y) - sure))[bins == k].sum()) for k in range(10)) / share.sum()
        return {"accuracy": (share * (best == y)).sum() / share.sum(), "precision": (share * (best == y))[above].sum() / max(share[above].sum(), 1e-9), "calibration_error": off}

    temperature, threshold = chosen(share)
    p = _soft(z / temperature)
    best, sure = p.argmax(axis=1), p.max(axis=1)
    unseen = judged(best, sure, (best > 1) & (sure >= threshold))  # by the weights only
    # Each fold once more by a temperature and a threshold that haven't seen it either.
    above = np.zeros(len(y), dtype=bool)
    for k in range(FOLDS):
        mine = fold == k
        t, limit = chosen(np.where(mine, 0.0, share))
        p = _soft(z[mine] / t)
        best[mine], sure[mine] = p.argmax(axis=1), p.max(axis=1)
        above[mine] = (best[mine] > 1) & (sure[mine] >= limit)
    unseen |= {f"{name}_by_all": value for name, value in judged(best, sure, above).items()}
    w, b = _fit(x, y, n, rounds, sparsity)
    w, b = np.round(w.astype(float) * 2**16) / 2**16, np.round(b.astype(float) * 2**16) / 2**16  # sums are then exact in any order
    keep = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    return Classifier(tuple(grams[i] for i in keep), w[keep], b, float(temperature), float(threshold), {k: float(v) for k, v in unseen.items()})


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text as an array."""
    return F.filter(F.split(text, BREAK), lambda x: ~x.rlike(NO_PARAGRAPH))


def _others(docs: DataFrame, at_most: int) -> list[str]:
    """Of the documents that a hash of doc_id puts first, up to eight paragraphs each, put first by a hash too: a bounded sample."""
    some = hashed_sample(docs.where("text is not null").select("doc_id", F.col("text").alias("t")), "doc_id", at_most // 8)
    each = F.array_sort(F.transform(F.array_distinct(paragraphs(F.col("t"))), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("part"))))
    return sorted(r["part"] for r in some.select(F.explode(F.slice(each, 1, 8)).alias("s")).select("s.part").collect())


def _words(name: str) -> Column:
    return F.array_remove(F.split(F.lower(name), NOT_WORD), "")


def _bigrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))


def scan(docs: DataFrame, model: Classifier, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, paragraph, n_paragraphs, family, probability, overlap, text of each notice.

    A notice is a run of paragraphs of one document with the same family; paragraph is the first one's number, from 0, in
    its document; probability and overlap are the run's greatest. family is unknown for what isn't surely one family (nor
    itself a long passage of the text of the likeliest), or doesn't share at least `overlap` of its bigrams with a template of it (of the shorter of the two). Paragraphs without
    a gram of the model score as none and give no row; so do null and empty texts and empty tables. Of classes that tie
    the first of CLASSES is said. Texts are read whole, however long. Repeated rows give their rows each, a null doc_id
    too; columns beside doc_id and text don't matter, whatever their names.
    """
    spark = docs.sparkSession
    lines = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    lines = lines.select("row", "doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "line"))
    telling = sorted({w for g in model.grams for w in g.split() if w not in COMMON})
    lines = lines.select("*", _words("line").alias("words"))
    lines = lines.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in telling])))
    grams = lines.select("row", "doc_id", "paragraph", "line", F.explode(F.array_distinct(F.concat("words", _bigrams(F.col("words"))))).alias("gram"))
    rows = [(g, [float(x) for x in w]) for g, w in zip(model.grams, model.weights)]
    weights = F.broadcast(spark.createDataFrame(rows, "gram string, w array<double>"))  # as many rows as the training passages have grams
    sums = [F.sum(F.get("w", k)).alias(f"z{k}") for k in range(len(CLASSES))]
    scored = grams.join(weights, "gram").groupBy("row", "doc_id", "paragraph", "line").agg(*sums)
    logits = F.array(*[(F.col(f"z{k}") + F.lit(float(model.bias[k]))) / F.lit(model.temperature) for k in range(len(CLASSES))])
    scored = scored.select("row", "doc_id", "paragraph", "line", logits.alias("z")).select("*", F.array_max("z").alias("top"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    best = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.array_position("z", F.col("top")).cast("int"))
    scored = scored.select("row", "doc_id", "paragraph", "line", best.alias("said"), F.round(1 / total, 6).alias("probability")).where("said <> 'none'")
    scored = scored.withColumn("pairs", _bigrams(_words("line")))  # once more for the few that are left, rather than shuffled for all
    known = F.broadcast(spark.createDataFrame(list(templates().items()), "said string, known array<array<string>>"))  # a row a family
    shared = lambda n: F.size(F.array_intersect(n, F.col("pairs"))) / F.greatest(F.least(F.size(n), F.size("pairs")), F.lit(1))
    scored = scored.join(known, "said", "left").select("*", F.round(F.coalesce(F.array_max(F.transform("known", shared)), F.lit(0.0)), 6).alias("overlap"))
    # Verbatim is a paragraph that is itself, nearly all of it, a passage of the family's text: not one that only names it.
    own = lambda n: F.when(F.size(n) >= LONG, F.size(F.array_intersect(n, F.col("pairs"))) / F.greatest(F.size("pairs"), F.lit(1))).otherwise(0.0)
    verbatim = (F.coalesce(F.array_max(F.transform("known", own)), F.lit(0.0)) >= VERBATIM) & (F.size("pairs") >= LONG)
    sure = ((F.col("probability") >= model.threshold) | verbatim) & (F.col("overlap") >= overlap)
    scored = scored.select("row", "doc_id", "paragraph", F.when(sure, F.col("said")).otherwise("unknown").alias("family"), "probability", "overlap", "line")
    # Runs: paragraph number less place among the paragraphs of the family is the same within a run.
    place = F.row_number().over(Window.partitionBy("row", "family").orderBy("paragraph"))
    runs = scored.withColumn("run", F.col("paragraph") - place).groupBy("row", "doc_id", "family", "run")
    told = runs.agg(F.sort_array(F.collect_list(F.struct("paragraph", "line"))).alias("parts"), F.max("probability").alias("probability"), F.max("overlap").alias("overlap"))
    text = F.array_join(F.transform("parts", lambda p: p["line"]), "\n")
    return told.select("doc_id", F.get("parts", F.lit(0))["paragraph"].alias("paragraph"), F.size("parts").alias("n_paragraphs"), "family", "probability", "overlap", text.alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, train(_others(docs, MAX_OTHERS)))
