"""Licence scan: sparse TF-IDF cosine of every line, and every text as a whole, to licence templates; then the nearest licensed directory above.

Words are runs of letters and digits, lower-cased. Inverse document frequencies of the templates' words are counted over all texts; any other word counts as the
rarest. A text's own licence is that of its closest line (a header) or of itself (a licence file); an SPDX identifier states it outright, and "all rights reserved"
counts only where nothing else is found. A licence file covers its directory: every file without a
licence of its own takes that of the nearest directory above which has one, found by joining distinct directories with their ancestors."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.text import U64, blocks, char_table, code_points, span_hashes, spans
from barloom.session import cut_lineage

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_KEEP = """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
# The public notices of common licences, and the whole texts of the short ones.
TEMPLATES = [
    ("MIT", f"""MIT License
{_GRANT} (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}"""),
    ("BSD-2-Clause", f"{_BSD}:\n{_KEEP}\n{_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD}:\n{_KEEP}\n{_NAMES}\n{_DISCLAIMER}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", f"""This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
{_AS_IS}"""),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("Proprietary", "This software is proprietary and confidential"),
    ("Proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential"),
    ("All-Rights-Reserved", "All rights reserved"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
WEAK = {"All-Rights-Reserved"}         # stands beside other licences too
WHOLE = 0.9                            # cosine from which the text as a whole is that licence, whatever its lines
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*)", re.IGNORECASE)
FAMILY = re.compile(r"([AL]?GPL|CC-BY(?:-NC)?)-[\d.]+(?:-only|-or-later|\+)?")
LEAST = 0.6                            # cosine from which a line or text counts as a licence
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"
_WORD: list[np.ndarray] = []


def _words(texts: list[str]):
    """Word hashes of a block, each one's text and line, and each line's text."""
    if not _WORD:
        _WORD.append(char_table(str.isalnum))
    codes, offsets = code_points([t.lower() for t in texts])
    starts, ends = spans(_WORD[0][codes])
    line = np.append(0, np.cumsum(codes == 10))[starts] if len(starts) else starts
    return span_hashes(codes, starts, ends), np.searchsorted(offsets, starts, "right") - 1, line


def spdx(text: str) -> str | None:
    """The licence of the first SPDX identifier, under the templates' name where they have one; an expression of several stays as it is."""
    found = SPDX.search(text) if "identifier:" in text.lower() else None
    name = found.group(1).rstrip(".-") if found else ""
    family = FAMILY.fullmatch(name)
    return family.group(1) if family else name or None


class Vocabulary:
    """The templates' words in order of hash, and their counts in each template."""

    def __init__(self, templates):
        lists = [_words([t])[0] for _, t in templates]
        self.names = [n for n, _ in templates]
        self.strong = np.array([n not in WEAK for n in self.names])
        self.hashes = np.unique(np.concatenate(lists))
        self.counts = np.stack([np.bincount(np.searchsorted(self.hashes, w), minlength=len(self.hashes)) for w in lists], axis=1).astype(float)

    def places(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, -1)


def _frequencies(vocabulary: Vocabulary, at: int):
    """Partition sums: in how many texts each template word stands, and the texts."""
    def run(batches):
        total, n = np.zeros(len(vocabulary.hashes), dtype=np.int64), 0
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            n += len(texts)
            for a, b in blocks(texts):
                words, doc, _ = _words(texts[a:b])
                place = vocabulary.places(words)
                pair = np.unique(doc[place >= 0] * len(total) + place[place >= 0])
                total += np.bincount(pair % len(total), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"word": pa.array(np.arange(len(total) + 1), pa.int64()), "n": pa.array(np.append(total, n), pa.int64())})
    return run


def _closest(vocabulary: Vocabulary, weight: np.ndarray, rare: float, words, place, unit, n: int):
    """For each unit the largest cosine and its template."""
    order = np.lexsort((words, unit))
    words, place, unit = words[order], place[order], unit[order]
    first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (unit[1:] != unit[:-1]))) if len(words) else np.zeros(0, int)
    count = np.diff(np.append(first, len(words)))
    place, unit = place[first], unit[first]
    value = count * np.where(place >= 0, weight[place], rare)
    norm = np.sqrt(np.bincount(unit, value ** 2, n))
    of = vocabulary.counts * weight[:, None]
    of /= np.sqrt((of ** 2).sum(axis=0))
    known = place >= 0
    scores = np.stack([np.bincount(unit[known], value[known] * of[place[known], t], n) for t in range(of.shape[1])], axis=1) / np.maximum(norm, 1e-12)[:, None]
    return scores.max(axis=1, initial=0), scores.argmax(axis=1) if n else np.zeros(0, int)


def own_licences(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """`files` (file_id, path, text) as file_id, path, cosine, license (null below `least`), whole (the text as a whole is a licence). Null and empty texts have none."""
    spark, vocabulary = files.sparkSession, Vocabulary(templates)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = files.select("text").mapInArrow(_frequencies(vocabulary, 0), "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()     # one row a template word
    seen = np.zeros(len(vocabulary.hashes) + 1)
    for r in rows:
        seen[r.word] = r.n
    rare = float(np.log(seen[-1] + 1) + 1)
    weight = np.log((seen[-1] + 1) / (seen[:-1] + 1)) + 1

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in blocks(texts):
                k = b - a
                words, doc, line = _words(texts[a:b])
                place = vocabulary.places(words)
                used, unit = np.unique(line, return_inverse=True)
                owner = np.zeros(len(used), dtype=np.int64)
                owner[unit] = doc
                some = np.bincount(unit, place >= 0, len(used)) >= 2               # a line with one template word has no cosine near `least` unless it is that word
                pick = some[unit]
                line_cos, line_of = _closest(vocabulary, weight, rare, words[pick], place[pick], unit[pick], len(used))
                text_cos, text_of = _closest(vocabulary, weight, rare, words, place, doc, k)
                cosine, license_ = text_cos.copy(), text_of.copy()
                for i in np.argsort(line_cos, kind="stable")[np.searchsorted(np.sort(line_cos), least):].tolist():
                    o, strong = owner[i], vocabulary.strong
                    if (text_cos[o] < WHOLE or not strong[text_of[o]]) and (strong[line_of[i]], line_cos[i]) >= (cosine[o] >= least and strong[license_[o]], cosine[o]):
                        cosine[o], license_[o] = line_cos[i], line_of[i]
                stated = [spdx(t) for t in texts[a:b]]
                cosine = np.where([x is not None for x in stated], 1.0, cosine)
                names = [x or (vocabulary.names[t] if c >= least else None) for x, t, c in zip(stated, license_, cosine, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, k), batch.column(1).slice(a, k), pa.array(cosine), pa.array(names, pa.string()), pa.array(text_cos >= least)],
                                                 names=["file_id", "path", "cosine", "license", "whole"])
    return files.select(F.col("file_id").cast("bigint").alias("file_id"), "path", "text").mapInArrow(run, "file_id bigint, path string, cosine double, license string, whole boolean")


def _parent(path):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per row of `files` (file_id, path, text): file_id, path, own_license, cosine, license, found ("own", "inherited" or "none").

    A licence file is one of such a name with a licence, or a text that is a licence as a whole. Of several in a directory the closest counts, ties by name. A
    null path has no directory; null and empty texts have no licence of their own. Rows that repeat a file are files each. Empty tables give no rows."""
    own = cut_lineage(own_licences(files, templates, least), "licences").withColumn("dir", _parent(F.col("path")))
    holders = own.filter(F.col("license").isNotNull() & F.col("path").isNotNull() & (F.col("whole") | F.col("path").rlike(FILE_NAME)))
    given = holders.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("cosine")).alias("o"), "license")).alias("best")).select("above", F.col("best.license").alias("from_above"))
    dirs = own.filter("path is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    climb = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("above")))).alias("a")).select("dir", "a.depth", "a.above")
    nearest = climb.join(given, "above").groupBy("dir").agg(F.max(F.struct("depth", "from_above")).alias("n")).select("dir", F.col("n.from_above").alias("inherited"))
    return own.join(nearest, "dir", "left").select(
        "file_id", "path", F.col("license").alias("own_license"), "cosine", F.coalesce("license", F.when(F.col("path").isNotNull(), F.col("inherited"))).alias("license"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("path").isNotNull() & F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("found"))
