"""Licence scans by a trained paragraph classifier.

A paragraph is a run of lines with words: a line that ends no sentence runs on into the next, a blank line ends the run.
Each line is classified by itself, and wrapped notices are read in windows of `WINDOW` lines of their paragraph, each
begun `WINDOW // 2` lines after the last, so that other text of a long paragraph does not hide them. A window's finding
counts if it is confirmed and no earlier confirmed one of the family, a line's first, shares a line with it.

The features are hashed grams of one, two and three words, lower case, punctuation aside; a softmax regression over them
tells licence families from the unknown class, which stands for all other text. Probabilities are calibrated by a
temperature fitted on held-out paragraphs. A family that is predicted with at least `CONFIDENT` is confirmed by
comparison: the share of the word pairs of one of its templates, or of what was read, that the other holds must reach
`ALIKE`, and be above that of all other families (of equal shares, the one of more pairs). Predictions that no template confirms count as unconfirmed,
not as licences.

The weights are trained by train_licenses.py on templates with words dropped, swapped and put around them, against
invented text and prose about licences, and lie in models/licenses.npz.

Defined cases: a null, empty or wordless text has no paragraphs and no families; very long texts and lines are read
whole; repeated lines and rows count each time; a null doc_id is kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsafe.llm import _shared
from docsafe.llm._words import grams, words

BUCKETS = 1 << 13
CONFIDENT = 0.8
ALIKE = 0.6
WINDOW = 8
MODEL = Path(__file__).parent / "models" / "licenses.npz"

#: Short notices by which a text names its licence, and openings of the licences themselves. Fixed values.
TEMPLATES = {
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the AGPL.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This text is available under the Creative Commons Attribution License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "CC0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GPL.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Released under the LGPL.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: Unlicense",
    ],
}
FAMILIES = sorted(TEMPLATES)
PUNCTUATION = r"[!-/:-@\[-`{-~]+"
SENTENCE_END = r"[.!?:;][\"')\]]*\s*$"


def normal(texts: pa.Array) -> pa.Array:
    """Punctuation as spaces; case is folded where words are hashed."""
    return pc.replace_substring_regex(texts, PUNCTUATION, " ")


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of every gram of one to three words, and the grams of each text."""
    w = words(normal(texts))
    h, owner = w.hashes(fold=True), w.owner()
    out, of = [], []
    for k in (1, 2, 3):
        g = grams(h, k)
        inside = owner[: len(g)] == owner[k - 1 :] if len(g) else np.zeros(0, bool)
        out.append((g[inside] % np.uint64(BUCKETS)).astype(np.int64))
        of.append(owner[: len(g)][inside])
    bucket, text = np.concatenate(out), np.concatenate(of)
    return bucket, text, np.bincount(text, minlength=len(texts))


class Classifier:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights.astype(np.float32), bias.astype(np.float32), float(temperature)

    @classmethod
    @lru_cache(maxsize=1)
    def trained(cls) -> Classifier:
        with np.load(io.BytesIO(pkgutil.get_data(__package__, f"models/{MODEL.name}"))) as f:
            return cls(f["weights"], f["bias"], f["temperature"])

    def chances(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: the families in order, then unknown."""
        bucket, text, n = buckets(texts)
        z = np.empty((len(texts), self.weights.shape[1]), np.float32)
        for c in range(z.shape[1]):
            z[:, c] = np.bincount(text, self.weights[bucket, c], len(texts)) / np.maximum(np.sqrt(n), 1) + self.bias[c]
        z /= self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _pairs(text: str) -> set[tuple[str, str]]:
    w = re.sub(PUNCTUATION, " ", text.lower()).split()
    return set(zip(w, w[1:], strict=False))


@lru_cache(maxsize=1)
def _templates() -> dict[str, list[set[tuple[str, str]]]]:
    return {k: [_pairs(t) for t in v] for k, v in TEMPLATES.items()}


def likeness(text: str) -> dict[str, tuple[float, int]]:
    """Of each family, the best (share of shared word pairs, their number) over its templates; the share is of the
    template's or the text's pairs, whichever are fewer."""
    own = _pairs(text)
    return {k: max(((len(own & t) / min(len(own), len(t)), len(own & t)) for t in v if min(len(own), len(t)) > 1), default=(0.0, 0)) for k, v in _templates().items()}


def paragraphs(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(owner, line, run) of every line with a word; runs of lines are numbered over all texts."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    owner, flat = pc.list_parent_indices(lines).to_numpy(), lines.flatten()
    full = words(flat).counts > 0
    place, flat = np.flatnonzero(full), flat.filter(pa.array(full))
    owner = owner[place]
    ends = pc.match_substring_regex(flat, SENTENCE_END).to_numpy(zero_copy_only=False)
    first = np.ones(len(place), bool)
    first[1:] = ends[:-1] | (owner[1:] != owner[:-1]) | (np.diff(place) > 1)
    return owner, flat, np.cumsum(first) - 1


def windows(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first line and the number of lines of every window of the runs of two lines and more."""
    n = np.bincount(run)
    start, step = np.cumsum(n) - n, WINDOW // 2
    count = np.where(n > 1, 1 + np.maximum(0, -(-(n - WINDOW) // step)), 0)
    of = np.repeat(np.arange(len(n)), count)
    first = start[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
    return first, np.minimum(WINDOW, start[of] + n[of] - first)


def joined(flat: pa.Array, first: np.ndarray, n: np.ndarray) -> pa.Array:
    ends = np.cumsum(n)
    at = np.repeat(first - (ends - n), n) + np.arange(int(n.sum()))
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(0, ends), pa.int64()), flat.take(pa.array(at))), " ")


def findings(flat: pa.Array, run: np.ndarray) -> Iterator[tuple[int, int, dict]]:
    """(first line, lines, finding) of every confident prediction, the lines' before the windows'."""
    model = Classifier.trained()
    taken: set[tuple[int, str]] = set()
    for first, n in ((np.arange(len(flat)), np.ones(len(flat), int)), windows(run)):
        if not len(first):
            continue
        texts = flat if n.max() == 1 else joined(flat, first, n)
        p = model.chances(texts)
        for i in np.flatnonzero((p.argmax(axis=1) < len(FAMILIES)) & (p.max(axis=1) >= CONFIDENT)):
            family, at = FAMILIES[int(p[i].argmax())], range(int(first[i]), int(first[i] + n[i]))
            if any((x, family) in taken for x in at):
                continue
            near = likeness(texts[int(i)].as_py())
            sure = near[family][0] >= ALIKE and all(v < near[family] for k, v in near.items() if k != family)
            if sure:
                taken.update((x, family) for x in at)
            elif texts is not flat:
                continue
            yield at.start, len(at), {"family": family, "probability": float(p[i].max()), "likeness": near[family][0], "confirmed": sure}


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, licences (array of paragraph, line, lines, family, probability, likeness, confirmed) for every
    row; paragraphs and lines with words are numbered from 0 in their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in _shared.slices(texts, 2 << 20):
                owner, flat, paragraph = paragraphs(texts.slice(a, b - a))
                start = np.searchsorted(owner, np.arange(b - a + 1))
                found: list[list[dict]] = [[] for _ in range(b - a)]
                for line, lines, x in findings(flat, paragraph) if len(flat) else ():
                    of = owner[line]
                    found[of].append({"paragraph": int(paragraph[line] - paragraph[start[of]]), "line": int(line - start[of]), "lines": lines} | x)
                n = [int(paragraph[e - 1] - paragraph[s] + 1) if e > s else 0 for s, e in zip(start, start[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(found, TYPE)], ["doc_id", "n_paragraphs", "licences"])

    return _shared.mapped(docs.select("doc_id", text), run, "doc_id long, n_paragraphs long, licences array<struct<paragraph:int,line:int,lines:int,family:string,probability:double,likeness:double,confirmed:boolean>>")


TYPE = pa.list_(pa.struct([("paragraph", pa.int32()), ("line", pa.int32()), ("lines", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())]))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select("doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_licences"), (F.size("licences") - F.size(sure)).cast("long").alias("n_unconfirmed"), F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"))
