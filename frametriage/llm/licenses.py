"""License scans: a trained paragraph classifier names the licence family, a template comparison confirms it.

Paragraphs are runs of lines up to a line that ends a sentence, or to one without words, so that wrapped notices are whole.
The classifier is multinomial logistic regression on sparse word n-grams (one and two words), trained here on paragraphs of
the licences' texts and on short notices, which are put together from ways of granting (`GRANTS`) and the licences' names;
for the class `none`, on filler, on sentences that speak of licences without granting one, and on grants of other things.
Whole notices are held out: every fourth way of granting or speaking, and the last paragraph of texts with more than two.
On these a temperature is fitted, and the bound for `none` above which a paragraph is no candidate.
A candidate is confirmed if it shares enough of its word pairs with a paragraph of the family's texts, in either direction,
or if a name of the family stands near a word of granting; other candidates count as unknown licences.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

NONE = "none"
#: Names of the families, as in notices and as identifiers.
NAMES = {
    "mit": ["MIT License", "MIT licence", "Expat License", "MIT/Expat", "MIT-Lizenz", "licencia MIT", "licence MIT"],
    "isc": ["ISC License", "ISC licence", "ISC-Lizenz"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "Simplified BSD License", "BSD-Lizenz"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0", "Apache-2.0", "Apache License v2", "Apache Software License", "Apache-Lizenz 2.0", "licence Apache 2.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPLv2", "GPLv3", "GPL-2.0-only", "GPL-3.0-or-later", "GPL version 2", "GPL v3"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1 or later", "GNU LGPL", "LGPLv3", "LGPL-2.1-or-later", "LGPL-3.0-only", "GNU Library General Public License"],
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPLv3", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 1.1", "MPL 2.0", "MPL-2.0"],
    "epl": ["Eclipse Public License", "Eclipse Public License v2.0", "EPL-2.0", "EPL 1.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0", "CC BY 4.0", "CC-BY-4.0", "CC BY", "Creative Commons Namensnennung 4.0", "Creative Commons Atribución 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike 3.0", "Creative Commons Namensnennung - Weitergabe unter gleichen Bedingungen 4.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC", "Creative Commons Namensnennung - Nicht kommerziell 4.0"],
    "cc0": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "Creative Commons Zero", "CC0 public domain dedication"],
    "unlicense": ["Unlicense", "The Unlicense"],
    "zlib": ["zlib License", "zlib/libpng License"],
    "boost": ["Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"],
}
#: Ways of granting. Every fourth is held out.
GRANTS = [
    "Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "Distributed under the terms of the {}.",
    "This software is available under the {}, see LICENSE for details.", "SPDX-License-Identifier: {}", "License: {}", "The code is made available under the {}.",
    "Published under {}.", "Use of this source code is governed by the {}.", "{} licensed.", "All files are covered by the {}.",
    "You may use this under the terms of the {}.", "Dieses Werk ist lizenziert unter {}.", "Veröffentlicht unter der {}.", "Este trabajo se distribuye bajo {}.",
    "Ce logiciel est distribué sous {}.", "Texts are provided under {} unless noted otherwise.", "Dual-licensed under the {} and a commercial license.", "Content is released under {}, with attribution.",
    "is free software, licensed under the {}", "The project uses the {}.", "Copyright (c) 2019 The Authors. Licensed under the {}.", "Contributions are accepted under the {}.",
]
#: Ways of speaking of something without granting it. Every fourth is held out.
MENTIONS = [
    "The {} was discussed at length in the meeting.", "He compared the {} with an older one.", "Lawyers argue about the {} in the second chapter.", "Why did they choose the {} at that time?",
    "Nobody had heard of the {} before the trial.", "A history of the {} appeared in print last year.", "She wrote her thesis about the {}.", "In the talk the {} came up twice.",
]
#: Other things that are granted, or that sound like a licence.
OTHERS = [
    "The driver lost his license after the accident and had to take the bus.", "Students at MIT presented their work on robots last week.",
    "The public was free to use the software of the library under certain terms.", "He reserved a table for all of them and was right to do so.",
    "The Apache helicopter was released to the army in version two.", "A creative person works in common with others and gives attribution.",
    "The foundation published a general report on public health.", "You can obtain a copy of the book at the following address.",
    "She granted them permission to leave without charge.", "The source of the river is in the mountains.",
    "The license fee for the radio was paid by every person.", "The conditions of the contract were met before the law changed.",
    "Copyright law is taught in the second year of the course.", "Version 3 of the program was slower than version 2.",
    "The album was released under a new name.", "The sale is governed by the laws of the state.", "Tickets are available under the terms of the club.",
    "The drug was licensed under strict conditions.", "The fishing license must be shown on request.", "Er hat unter der Brücke seine Lizenz verloren.",
    "La licencia de conducir es válida en todo el país.", "The warranty covers damages for two years without a fee.",
]
#: Paragraphs of the licences' texts.
TEXTS = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see the address of the licenses.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at the address of Mozilla.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    ],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution."],
    "cc-by": ["Attribution. You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "cc-by-sa": ["ShareAlike. If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc-by-nc": ["NonCommercial. You may not use the material for commercial purposes."],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
}
#: Words of granting; a family's name within NEAR words of one is a notice.
GRANTING = set("licensed license licence licences licenses released distributed available published governed covered provided terms under spdx redistribute lizenziert lizenz unter veröffentlicht bajo licencia sous distribué uses accepted".split())
NEAR = 8
#: Common words, which are no evidence alone.
COMMON = "a about all also an and any are as at be been but by can could did do for from had has have he her his i if in is it its may more most no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your".split()
COMMON += "auch auf das dem den der des die ein eine es für im ist mit nicht sich und von zu au avec dans de du elle en est et la le les ou par pas pour que qui sur un une como con del el las los para por se su sus y".split()
WORDS = re.compile(r"\w+").findall
#: Ends a paragraph.
STOPS = (".", "!", "?", ":", "…")


def words_of(paragraph: str) -> list[str]:
    return WORDS(paragraph.lower())


def grams(words: list[str]) -> set[str]:
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def paragraphs(text: str) -> Iterator[list[str]]:
    """The words of each paragraph: of lines up to one that ends a sentence, or to one without words."""
    own: list[str] = []
    for line in text.split("\n"):
        words = words_of(line)
        own += words
        if own and (not words or line.rstrip().endswith(STOPS)):
            yield own
            own = []
    if own:
        yield own


def _pairs(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(words, words[1:], strict=False)) or {tuple(words)}


def _around(r: random.Random, words: list[str], fillers: list[str]) -> list[str]:
    """Sometimes with a word left out or other words before and after."""
    words = [w for w in words if len(words) < 6 or r.random() > 0.03]
    if r.random() < 0.3:
        words = r.choices(fillers, k=r.randint(1, 8)) + words
    return words + r.choices(fillers, k=r.randint(1, 8)) if r.random() < 0.2 else words


def _part(r: random.Random, words: list[str]) -> list[str]:
    """Half of the time a third or more of the words, as they stand side by side."""
    if len(words) < 9 or r.random() < 0.5:
        return words
    n = r.randint(max(len(words) // 3, 8), len(words))
    at = r.randrange(len(words) - n + 1)
    return words[at : at + n]


class LicenseModel:
    """Trained once, on the driver; the same for every input."""

    def __init__(self, rows: int = 120, seed: int = 3, steps: int = 150, rate: float = 6.0, decay: float = 2e-4):
        r = random.Random(seed)
        syllables = ["an", "the", "er", "in", "of", "to", "re", "ti", "on", "ha", "nd", "st", "que", "de", "la", "en", "ung", "lich", "os", "es"]
        fillers = ["".join(r.choices(syllables, k=r.choice([1, 1, 2, 3]))) for _ in range(600)] + COMMON * 4
        self.classes = [NONE, *sorted(TEXTS)]
        self.names = {f: [tuple(words_of(n)) for n in own] for f, own in NAMES.items()}
        self.templates = {f: [_pairs(words_of(t)) for t in own] for f, own in TEXTS.items()}

        def sample(held: bool, n: int) -> list[tuple[list[str], int]]:
            """Of the notices that are held out, or of the others."""
            of = lambda all_: [x for i, x in enumerate(all_) if (i % 4 == 3) == held]
            grants, mentions = of(GRANTS), of(MENTIONS)
            out = []
            for k, name in enumerate(self.classes):
                if name == NONE:
                    every = [x for own in NAMES.values() for x in own]
                    out += [(r.choices(fillers, k=r.randint(1, 60)), k) for _ in range(4 * n)]
                    out += [(_around(r, words_of(r.choice(of(OTHERS))), fillers), k) for _ in range(4 * n)]
                    out += [(_around(r, words_of(r.choice(mentions).format(r.choice(every))), fillers), k) for _ in range(4 * n)]
                    out += [(_around(r, words_of(r.choice(grants).format(" ".join(r.choices(fillers, k=r.randint(1, 3))))), fillers), k) for _ in range(2 * n)]
                    continue
                own = TEXTS[name]
                own = (own[-1:] if held else own[:-1]) if len(own) > 2 else [] if held else own
                for _ in range(n):
                    if name in NAMES and (not own or r.random() < 0.6):
                        out.append((_around(r, words_of(r.choice(grants).format(r.choice(NAMES[name]))), fillers), k))
                    elif own:
                        out.append((_around(r, _part(r, words_of(r.choice(own))), fillers), k))
            return out

        train, held = sample(False, rows), sample(True, rows // 3)
        known: dict[str, int] = {}
        for own, k in train:
            if k:
                known.update({g: known.get(g, 0) + 1 for g in grams(own)})
        filler = set(fillers)
        kept = sorted(g for g, n in known.items() if n > 2 and not filler.issuperset(g.split()))
        self.column = {g: i for i, g in enumerate(kept)}
        x, y = self._matrix(train)
        w, b = np.zeros((len(kept), len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        share = (1 / np.bincount(y)[y]).astype(np.float32)
        share /= share.sum()
        move, shift = np.zeros_like(w), np.zeros_like(b)
        for _ in range(steps):
            p = self._softmax(x @ w + b)
            p[np.arange(len(y)), y] -= 1
            p *= share[:, None]
            move = 0.8 * move - rate * (x.T @ p + decay * w)
            shift = 0.8 * shift - rate * p.sum(axis=0)
            w, b = w + move, b + shift
        xh, self.held_labels = self._matrix(held)
        z = (xh @ w + b).astype(np.float64)
        yh = self.held_labels
        loss = [(-np.log(self._softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean(), t) for t in np.geomspace(0.2, 5, 41)]
        temperature = min(loss)[1]
        self.w, self.b = w.astype(np.float64) / temperature, b.astype(np.float64) / temperature
        self.held = self._softmax(z / temperature)
        none = self.held[:, 0]
        #: At and above this probability of `none` a paragraph is no candidate: most held-out paragraphs are on the right side of it.
        bounds = np.unique(np.concatenate([none, [0.5]]))
        right = [((none >= t) & (yh == 0)).sum() / (yh == 0).sum() + ((none < t) & (yh > 0)).sum() / (yh > 0).sum() for t in bounds]
        self.bound = float(bounds[int(np.argmax(right))])
        #: Every known n-gram has one of these.
        self.telling = {w for g in kept for w in g.split()} - filler

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def _matrix(self, rows: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.column)), np.float32)
        for i, (own, _) in enumerate(rows):
            hit = [self.column[g] for g in grams(own) if g in self.column]
            x[i, hit] = 1 / max(len(hit), 1) ** 0.5
        return x, np.array([k for _, k in rows])

    def classify(self, words: list[str]) -> tuple[str, float]:
        """The likeliest family and 1 minus the probability of `none`; (none, that) if it is no candidate."""
        hit = [] if self.telling.isdisjoint(words) else sorted(self.column[g] for g in grams(words) if g in self.column)
        if not hit:
            return NONE, 0.0
        p = self._softmax(self.b + self.w[hit].sum(axis=0) / len(hit) ** 0.5)
        if p[0] >= self.bound:
            return NONE, float(1 - p[0])
        return self.classes[1 + int(np.argmax(p[1:]))], float(1 - p[0])

    def confirm(self, name: str, words: list[str], least: float = 0.6) -> bool:
        """Whether a text of the family is mostly in the paragraph, the paragraph mostly in a text, or a name of it near a word of granting."""
        own = _pairs(words)
        if any(len(own & t) >= least * len(t) or len(own) >= 5 and len(own & t) >= least * len(own) for t in self.templates[name]):
            return True
        for n in self.names.get(name, []):
            for i in range(len(words) - len(n) + 1):
                if words[i] == n[0] and tuple(words[i : i + len(n)]) == n and not GRANTING.isdisjoint(words[max(i - NEAR, 0) : i] + words[i + len(n) : i + len(n) + NEAR]):
                    return not any(self._longer(other, n, words, i) for f, others in self.names.items() if f != name for other in others)
        return False

    @staticmethod
    def _longer(other: tuple[str, ...], n: tuple[str, ...], words: list[str], i: int) -> bool:
        """Whether a longer name of another family covers the one at i."""
        return len(other) > len(n) and any(j >= 0 and tuple(words[j : j + len(other)]) == other for j in range(i - len(other) + len(n), i + 1))


@functools.cache
def license_model() -> LicenseModel:
    return LicenseModel()


def scan(text: str, model: LicenseModel) -> tuple[int, list[str], int, int, float]:
    """Paragraphs, confirmed families, paragraphs of these, unconfirmed candidates, the highest score of a confirmed one."""
    n, families, confirmed, unknown, best = 0, set(), 0, 0, 0.0
    for words in paragraphs(text):
        n += 1
        name, score = model.classify(words)
        if name == NONE:
            continue
        if model.confirm(name, words):
            families.add(name)
            confirmed += 1
            best = max(best, score)
        else:
            unknown += 1
    return n, sorted(families), confirmed, unknown, best


def _scanned(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [scan(t, model.value) for t in texts_of(batch)]
        n, families, confirmed, unknown, best = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array([",".join(x) for x in families], pa.string()), pa.array(confirmed, pa.int32()), pa.array(unknown, pa.int32()), pa.array(best, pa.float64())],
            ["doc_id", "n_paragraphs", "licenses", "n_confirmed", "n_unknown", "score"],
        )


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, licenses (confirmed families, sorted, by commas), n_confirmed, n_unknown, score for each row.

    Null and empty texts have no paragraphs, no licence and score 0. Rows are scanned one by one, repeated ones alike;
    null ids are kept, an empty table gives an empty one. Of equally likely families the first by name is taken. Other
    columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(license_model())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(functools.partial(_scanned, model), "doc_id long, n_paragraphs int, licenses string, n_confirmed int, n_unknown int, score double")
