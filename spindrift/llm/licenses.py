"""Licence notices in texts, paragraph by paragraph.

A multinomial logistic regression on word 1- and 2-grams, with a lasso that leaves few of them, tells licence families and
"unknown" apart. It is trained here, on notices put together from the phrases below and on paragraphs of other kinds,
those about licences of the driving and fishing sort among them. To calibrate, a quarter of the notices and of the other
paragraphs, with all that is made of them, is held out from a first fit: they give one temperature, and the least
probability at which a family is believed; below it a paragraph is unknown. The weights are those of a fit on all. A family is
reported only if its templates confirm it: enough of the paragraph's word pairs are in one, or of one in the paragraph.

A paragraph is a line; and, where no line of it is a notice by itself, all lines between two blank ones together, as of a
text that is wrapped. Paragraphs that have no n-gram in favour of any family are unknown whatever else they hold, and most
are passed over on that ground.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import WORD, read_table, texts, tune_arrow

SIMILARITY = 0.5
#: A paragraph of so many word pairs that shares so many of all with a template is that template, whatever the model believes.
SAME, SAME_PAIRS = 0.9, 10
LASSO = 4e-4
#: Weights that are smaller are dropped.
FAINT = 0.5
SEED = 31_337

#: Notices by family; {y} and {h} stand for a year and a holder.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "MIT licensed. Copyright (c) {y} {h}",
        "See the MIT license for details.",
        "Distributed under the MIT License, see LICENSE for more information.",
        "the Software is provided as is, without warranty of any kind, under the MIT License",
        "permission is granted free of charge under the terms of the MIT license",
        "MIT License",
        "The MIT License",
        "License: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License)",
        "you may not use this file except in compliance with the Apache License",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is licensed under the Apache 2.0 license.",
        "Released under the Apache License 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache Software License, Version 2.0",
        "Copyright {y} {h}. Licensed under the Apache License",
        "licensed to the Apache Software Foundation under contributor license agreements",
        "Apache License",
        "License: Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "Released under the GNU GPL v3.",
        "This program is free software; see the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program",
        "Licensed under the GNU General Public License, version 2 or later.",
        "License: GPLv3",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU General Public License",
        "License: GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "lgpl": [
        "under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; see the GNU Lesser General Public License",
        "Released under the LGPL v3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1",
        "GNU Lesser General Public License",
        "License: LGPL",
    ],
    "agpl": [
        "under the terms of the GNU Affero General Public License",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL v3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3",
        "GNU Affero General Public License",
        "License: AGPL",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Use of this source code is governed by a BSD-style license",
        "Redistributions of source code must retain the above copyright notice, this list of conditions",
        "Redistributions in binary form must reproduce the above copyright notice",
        "The 2-Clause BSD License, copyright {y} {h}",
        "BSD License",
        "BSD 3-Clause License",
        "License: BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Released under the MPL 2.0 license.",
        "If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org",
        "Mozilla Public License",
        "Mozilla Public License Version 2.0",
        "License: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Available under the Creative Commons Attribution License",
        "Text is available under CC BY 3.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Available under the Creative Commons Attribution-NonCommercial License",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "public-domain": [
        "Dedicated to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related rights",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "isc": ["SPDX-License-Identifier: ISC", "Licensed under the ISC License.", "ISC License, copyright {y} {h}", "Released under the terms of the ISC license.", "ISC License", "License: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "proprietary": [
        "All rights reserved. Copyright (c) {y} {h}. Unauthorized copying of this file is strictly prohibited.",
        "Proprietary and confidential. All rights reserved.",
        "This software is the confidential and proprietary information of {h}.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}

#: Paragraphs of no family.
OTHERS = [
    "You need a driver's license to rent a car, version or no version.",
    "The restaurant lost its liquor license after the third complaint.",
    "Licensed plumbers and electricians are hard to find in this town.",
    "She got her fishing license at the public office on the general's square.",
    "A license to practise medicine is issued by the state board.",
    "The copyright dispute between the two studios went to court.",
    "He released under pressure the terms of the contract.",
    "The software is the work of a foundation in the north.",
    "Which license should I choose for my project?",
    "The court held that copyright law protects the expression and not the idea.",
    "Please read the terms and the conditions of the sale with care.",
    "The general public was admitted free of charge.",
    "Version 2.0 of the game was released in April.",
    "This work is dedicated to my parents.",
    "Source code is written in a language and compiled into binary form.",
    "The apache helicopter landed under heavy fire.",
    "Students at MIT built a robot under the guidance of their professor.",
    "The Mozilla browser opens the file in a new window.",
    "The commons is a shared resource and open to all.",
    "To be or not to be, that is the question.",
    "The quick brown fox jumps over the lazy dog.",
    "In this paper we describe a method and show that it is better than the others.",
    "It was the best of times, it was the worst of times.",
    "Copy the file to the server and start the program with this command.",
    "The notice above the door says that you may not smoke.",
    "Her permission was granted without a word.",
    "Distributed systems fail in many ways, see the chapter for more details.",
    "As is well known, the warranty covers two years of use.",
    "El gato está en la casa y la licencia de conducir en el coche.",
    "Der Führerschein ist eine Lizenz zum Fahren, die man sich verdienen muss.",
    "Le permis de conduire est une licence que l'on obtient avec de la patience.",
    "Rights and duties of the citizen are set out in the law.",
    "All seats are reserved, no tickets are left for the show.",
    "This is the text of the letter that he received along with the parcel.",
    "The published version has the same conditions as the draft.",
    "The library is free and open on Sundays.",
    "Attribution of the painting to the master is doubtful.",
    "International flights are licensed by each state.",
    "Public transport in the city is better than its name.",
    "the of and to in is it for that was on are by this with from be as at an or",
    "der die das und zu den ist nicht von mit sich auf für im dem ein eine als auch an",
    "le la les de des et un une du en que qui est pour par dans sur avec pas au",
    "el la los de y en que un una por con para del se las no es al lo su",
]
UNKNOWN = "unknown"


def grams(paragraph: str) -> list[str]:
    ws = WORD.findall(paragraph.lower())
    return ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def pairs(paragraph: str) -> set[str]:
    """Word pairs; of a single word, the word."""
    ws = WORD.findall(paragraph.lower())
    return {f"{a} {b}" for a, b in zip(ws, ws[1:])} or set(ws)


def examples(rng: np.random.Generator) -> tuple[list[str], list[str], list[int]]:
    """Paragraphs, families, and the numbers of what they are made of: each template as it is and altered, as a rest of a
    sentence or among other words."""
    made, family, origin = [], [], []
    fill = [w for o in OTHERS for w in o.split()]

    def some(n: int) -> str:
        s = int(rng.integers(len(fill) - n))
        return " ".join(fill[s : s + n])

    for f, notices in [*TEMPLATES.items(), (UNKNOWN, OTHERS)]:
        for n in notices:
            n = n.replace("{y}", str(rng.integers(1990, 2026))).replace("{h}", some(2).title())
            ws = n.split()
            made += [n, n.upper(), f"{some(3)} {n}", f"{n} {some(6)}", f"{some(8)} {n} {some(8)}"]
            for _ in range(3):
                keep = rng.random(len(ws)) > 0.12
                made.append(" ".join(w for w, k in zip(ws, keep) if k) or n)
            family += [f] * (len(made) - len(family))
            origin += [origin[-1] + 1 if origin else 0] * (len(made) - len(origin))
    for _ in range(300):
        made.append(some(int(rng.integers(3, 30))))
        family.append(UNKNOWN)
        origin.append(origin[-1] + 1)
    return made, family, origin


class LicenseModel:
    """Sparse weights by n-gram, and what is needed to believe them."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        made, family, origin = examples(rng)
        self.families = [UNKNOWN, *TEMPLATES]
        y = np.array([self.families.index(f) for f in family])
        found = [set(grams(p)) for p in made]
        vocabulary = {g: i for i, g in enumerate(sorted(set().union(*found)))}
        x = np.zeros((len(made), len(vocabulary) + 1), np.float32)
        x[:, -1] = 1
        for i, gs in enumerate(found):
            x[i, [vocabulary[g] for g in gs]] = 1
        held = (rng.random(origin[-1] + 1) < 0.25)[origin]
        self.temperature, self.least = self._calibrate(x[held] @ self._fit(x[~held], y[~held]), y[held])
        w = self._fit(x, y)
        self.bias = w[-1]
        rows = [(g, w[i]) for g, i in vocabulary.items() if np.abs(w[i]).max() > 1e-6]
        self.weights = dict(rows)
        #: Without any of these words no family can outweigh unknown: its bias is below 0 and nothing speaks for it.
        self.triggers = frozenset(g.split(" ")[0] for g, v in rows if v.max() > 0) if (self.bias[1:] < 0).all() else None
        self.templates = {f: [pairs(n.replace("{y}", "").replace("{h}", "")) for n in notices] for f, notices in TEMPLATES.items()}

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> np.ndarray:
        t = np.eye(len(self.families), dtype=np.float32)[y]
        t = t / len(y)
        rate = 2 / (np.linalg.norm(x, 2) ** 2 / len(x))
        w = np.zeros((x.shape[1], len(self.families)), np.float32)
        v, k = w.copy(), 1.0
        for _ in range(steps):
            z = v - rate * (x.T @ (softmax(x @ v) / len(y) - t))
            z[:-1] = np.sign(z[:-1]) * np.maximum(np.abs(z[:-1]) - rate * LASSO, 0)
            k, before = (1 + (1 + 4 * k * k) ** 0.5) / 2, k
            v, w = z + (before - 1) / k * (z - w), z
        w = w - w[:, :1]  # against unknown, whose score is then always 0
        w[:-1][np.abs(w[:-1]) < FAINT] = 0
        return w

    def _calibrate(self, scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """The temperature of the least log loss, and the least probability at which 99 of 100 believed are right."""
        rows = np.arange(len(y))
        temperature = min(np.geomspace(0.1, 5, 40), key=lambda t: -np.log(softmax(scores / t)[rows, y] + 1e-12).mean())
        p = softmax(scores / temperature)
        best, top = p.argmax(axis=1), p.max(axis=1)
        for least in np.linspace(0.3, 0.9, 25):
            believed = (best > 0) & (top >= least)
            if believed.any() and (best[believed] == y[believed]).mean() >= 0.99:
                return float(temperature), float(least)
        return float(temperature), 0.9

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """Family, probability and similarity to the family's templates; unknown where the model or they don't agree."""
        score = self.bias.copy()
        for g in set(grams(paragraph)):
            if (v := self.weights.get(g)) is not None:
                score += v
        p = softmax(score[None] / self.temperature)[0]
        f = int(p.argmax())
        own = pairs(paragraph)
        if f == 0 or p[f] < self.least:
            for k, family in enumerate(self.families[1:], 1) if len(own) >= SAME_PAIRS else ():
                for t in self.templates[family]:
                    if SAME * len(t) <= len(own) <= len(t) / SAME and (same := len(own & t) / len(own | t)) >= SAME:
                        return family, float(p[k]), same
            return UNKNOWN, float(p[0]), 0.0
        alike = max(max(len(own & t) / len(t), len(own & t) / max(len(own), 1)) for t in self.templates[self.families[f]])
        return (self.families[f] if alike >= SIMILARITY else UNKNOWN), float(p[f]), float(alike)

    def scan(self, text: str | None) -> list[tuple[int, str, float, float]]:
        """(number of the paragraph, family, probability, similarity) of the licence notices in a text."""
        if not text:
            return []
        if not self._may_be(text):
            return []
        out, block, at = [], [], 0
        for i, line in enumerate([*text.split("\n"), ""]):
            if line.strip():
                if not block:
                    at = i
                block.append(line)
            elif block:
                out += self._notices(block, at)
                block = []
        return out

    def _may_be(self, text: str) -> bool:
        return self.triggers is None or not self.triggers.isdisjoint(WORD.findall(text.lower()))

    def _notices(self, block: list[str], at: int) -> list[tuple[int, str, float, float]]:
        told = [i for i, line in enumerate(block) if self._may_be(line)]
        found = [(at + i, *x) for i in told if (x := self.classify(block[i]))[0] != UNKNOWN]
        if not found and told and len(block) > 1 and (x := self.classify(" ".join(block)))[0] != UNKNOWN:
            return [(at, *x)]
        return found


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def license_model() -> LicenseModel:
    return LicenseModel()


def find_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity) for each licence notice; paragraph is the number of its first
    line, from 0.

    Each row is searched by itself, so repeated rows give repeated results and a null doc_id is kept. A null or empty
    text has no notice; one of any length is searched whole. A paragraph that names two families is reported under the likelier one. An empty table gives an
    empty result; other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model or license_model())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in sent.value.scan(t.as_py())]
            if hits:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*hits), kinds)], ["doc_id", "paragraph", "family", "probability", "similarity"])

    tune_arrow(docs.sparkSession)
    return texts(docs).mapInArrow(search, "doc_id long, paragraph long, family string, probability double, similarity double")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(read_table(spark, sf_dir, "documents"))
