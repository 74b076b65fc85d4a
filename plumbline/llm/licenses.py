"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A unit of text is a vector of its words (letters, figures and inner points; ASCII letters
lower-cased) weighted tf * idf, with idf = 1 + ln((1 + N) / (1 + df)) over all documents; a word
that no template has gets the idf of df 0. Headers, the short notices by which a license is
named, are templates for every line and for every paragraph (lines with words that follow one another, as a
notice is wrapped); the licenses' own texts are templates for the whole text. A unit whose
cosine to a template is at least ``threshold`` carries that license; a text's license is
its best unit's.

A file whose name says so (LICENSE, LICENCE, COPYING, NOTICE, whatever the ending) licenses its
directory: files without a license of their own take that of the nearest directory above them
that has one. Directories are resolved once each, not once for each file.

Defined results: null or empty text has no license of its own; a null path neither gives nor
inherits one; of equal scores the whole text goes before a line and a line before a paragraph, then the earlier
one, then the first template by name; of several license files in a directory the best gives its license, then
the first by path; repeated rows are judged alike; an empty table gives no rows; other columns are
carried along unless an added column has their name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, small
from .tokens import BATCH_ROWS, _portions

#: The notices by which the licenses ask to be named, and the titles of long ones.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def license_texts() -> list[tuple[str, str]]:
    """The licenses' own texts, files named by SPDX identifiers beside this module."""
    return [(p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))]


def template_words(text: str) -> list[str]:
    _, code, _, words = _line_words(pa.array([text]))
    return [words[k] for k in code]


def _line_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of all words: the line they stand in and their code; of the lines: their text; the words by code."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    owner = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
    spaced = pc.replace_substring_regex(pc.ascii_lower(lines.flatten()), r"\.+([^0-9.]|$)", " \\1")
    words = pc.ascii_split_whitespace(pc.replace_substring_regex(spaced, r"[^a-z0-9.]+", " "))
    flat = pc.ascii_trim(words.flatten(), ".")
    line = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(some)).dictionary_encode()
    return line[some], coded.indices.to_numpy(zero_copy_only=False), owner, coded.dictionary.to_pylist()


def _paragraphs(line: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line its paragraph (-1: no word, or the paragraph has one line), of paragraphs their text and first line."""
    worded = np.zeros(len(owner), bool)
    worded[line] = True
    follows = np.zeros(len(owner), bool)
    follows[1:] = worded[1:] & worded[:-1] & (owner[1:] == owner[:-1])
    first = np.flatnonzero(worded & ~follows)
    of_line = np.where(worded, np.cumsum(worded & ~follows) - 1, -1)
    many = np.bincount(of_line[worded], minlength=len(first)) > 1
    number = np.where(many, np.cumsum(many) - 1, -1)
    return np.where(of_line >= 0, number[of_line], -1) if len(first) else of_line, owner[first[many]], first[many]


def _small_batches(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """The number of documents, and in how many each word of the templates stands."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in _portions(batch, "text"):
                line, code, owner, words = _line_words(part["text"])
                known = np.array([number.get(w, -1) for w in words], np.int64)[code] if len(words) else np.zeros(0, np.int64)
                pairs = np.unique(owner[line[known >= 0]] * len(vocabulary) + known[known >= 0])
                df += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([None, *vocabulary]), pa.array([n, *df.tolist()], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    rows = {r.word: r.n for r in counted.collect()}  # one row for each word of the templates
    return rows.pop(None, 0), rows


def own_licenses(
    docs: DataFrame, *, text_col: str = "text", headers: list[tuple[str, str]] | None = None, texts: list[tuple[str, str]] | None = None, threshold: float = 0.8,
) -> DataFrame:
    """``docs`` with own_license, own_score (its best unit's cosine) and own_line (the line, from 0, at which that unit
    begins; -1: the whole text). ``headers`` and ``texts`` are pairs (license, template)."""
    _small_batches(docs)
    kinds = [sorted(HEADERS if headers is None else headers), sorted(license_texts() if texts is None else texts)]
    tfs = [[Counter(template_words(text)) for _, text in kind] for kind in kinds]
    names = [np.array([name for name, _ in kind], object) for kind in kinds]
    vocabulary = sorted(set().union(*tfs[0], *tfs[1]))
    n_docs, df = document_frequencies(docs, vocabulary, text_col)
    idf = np.array([1 + math.log((1 + n_docs) / (1 + df.get(w, 0))) for w in vocabulary] + [1 + math.log(1 + n_docs)])
    number = {w: i for i, w in enumerate(vocabulary)}

    def matrix(tfs: list[Counter]) -> np.ndarray:
        out = np.zeros((len(tfs), len(vocabulary)))
        for k, tf in enumerate(tfs):
            for w, n in tf.items():
                out[k, number[w]] = n * idf[number[w]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    weights = [matrix(kind) for kind in tfs]
    keep = docs.drop(*[c for c in docs.columns if c.lower() in ("own_license", "own_score", "own_line")])

    def best(unit: np.ndarray, code: np.ndarray, known: np.ndarray, n: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each of n units its best cosine to a template, and that template; 0 where it can't reach the threshold."""
        score, which = np.zeros(n), np.zeros(n, np.int64)
        if not len(code) or not len(weights):
            return score, which
        width = int(code.max()) + 1
        keys, tf = np.unique(unit * width + code, return_counts=True)
        unit, at = keys // width, known[keys % width]
        w = tf * idf[at]
        norm = np.bincount(unit, w * w, n)
        inside = at < len(vocabulary)
        # templates have no other words, so the cosine is at most the share of the norm that theirs have
        able = np.bincount(unit[inside], w[inside] ** 2, n) >= threshold**2 * norm * (1 - 1e-9)
        able &= norm > 0
        some = inside & able[unit]
        number, of = np.flatnonzero(able), np.cumsum(able) - 1
        u, a, x = of[unit[some]], at[some], w[some]
        if len(number):
            dots = np.stack([np.bincount(u, x * row[a], len(number)) for row in weights], 1) / np.sqrt(norm[number])[:, None]
            score[number], which[number] = dots.max(1), dots.argmax(1)
        return score, which

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _portions(batch, text_col):
                line, code, owner, words = _line_words(part[text_col])
                known = np.array([number.get(w, len(vocabulary)) for w in words], np.int64)
                first = np.searchsorted(owner, np.arange(part.num_rows))
                of_line, par_text, par_line = _paragraphs(line, owner)
                in_par = of_line[line] >= 0
                whole, whole_which = best(owner[line], code, known, part.num_rows, weights[1])
                by_line, line_which = best(line, code, known, len(owner), weights[0])
                by_par, par_which = best(of_line[line[in_par]], code[in_par], known, len(par_text), weights[0])
                # units of a text in the order that settles ties: the whole, its lines, its paragraphs
                text = np.concatenate([np.arange(part.num_rows), owner, par_text])
                score = np.concatenate([whole, by_line, by_par])
                name = np.concatenate([names[1][whole_which] if len(names[1]) else np.full(part.num_rows, None), names[0][line_which] if len(names[0]) else np.full(len(owner), None), names[0][par_which] if len(names[0]) else np.full(len(par_text), None)])
                place = np.concatenate([np.full(part.num_rows, -1), np.arange(len(owner)) - first[owner], par_line - first[par_text]])
                order = np.lexsort([np.arange(len(text)), -np.round(score, 12), text])
                top = order[np.searchsorted(text[order], np.arange(part.num_rows))]
                hit = score[top] >= threshold - 1e-12
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.where(hit, name[top], None), pa.string()), pa.array(np.minimum(score[top], 1.0), mask=~hit), pa.array(place[top].astype(np.int64), mask=~hit)],
                    [*part.schema.names, "own_license", "own_score", "own_line"],
                )

    added = [T.StructField("own_license", T.StringType()), T.StructField("own_score", T.DoubleType()), T.StructField("own_line", T.LongType())]
    return keep.mapInArrow(scan, T.StructType([*keep.schema.fields, *added]))


def inherited_licenses(scanned: DataFrame, *, path_col: str = "path") -> DataFrame:
    """``scanned`` (with own_license and own_score) with license and licensed_by: its own path, or the
    license file's that it inherits from."""
    kept = [c for c in scanned.columns if c.lower() not in ("license", "licensed_by")]
    rows = scanned.select(F.struct(*kept).alias("row"), F.col(path_col).alias("path"), F.col("own_license").alias("own"), F.col("own_score").alias("score"))
    rows = saved(rows.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")), "scanned")
    grants = (
        rows.filter(F.col("own").isNotNull() & F.col("path").rlike(FILE_NAME)).groupBy("dir")
        .agg(F.min_by(F.struct("own", "path"), F.struct(-F.col("score"), F.col("path"))).alias("grant"))
    )
    grants = saved(grants.select(F.col("dir").alias("ancestor"), F.col("grant.own").alias("grant_own"), F.col("grant.path").alias("grant_path")), "grants")
    dirs = rows.filter("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("depth", "ancestor"))
    nearest = above.join(small(grants), "ancestor").groupBy("dir").agg(F.max_by(F.struct("grant_own", "grant_path"), "depth").alias("grant"))
    nearest = saved(nearest.select("dir", "grant.grant_own", "grant.grant_path"), "directories")
    out = rows.join(small(nearest), "dir", "left")
    return out.select(
        "row.*", F.coalesce("own", "grant_own").alias("license"),
        F.when(F.col("own").isNotNull(), F.col("path")).otherwise(F.col("grant_path")).alias("licensed_by"),
    )
