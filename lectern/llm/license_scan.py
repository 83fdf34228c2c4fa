"""License notices by MinHash bands over overlapping text windows, in DataFrame operations only.

A text becomes the hashes of its word five-grams. For each length class of templates, windows of that length and a half overlap so
that a whole notice lies in one of them; for the shortest classes windows are a word longer than the class and start at every word. A window's MinHash values (the
least of its grams' hashes under each of HASHES seeds) are bands of one value; a template and a window that share a band are a candidate. A notice that lies
in its window whole makes up a third of the window at least, so it is retrieved with a probability of 1 - (2/3)**HASHES at least (a loss of 2 in a
million). Candidates are verified by exact containment: the share of the template's distinct five-grams that the window holds.

Windows that hold no five-gram of any template have a Jaccard similarity of zero with all of them and are not hashed; the five-grams of all templates are a set
within the plan, built once, not data of a row. The templates are a parameter, bounded by MAX_TEMPLATES and MAX_WORDS in all, so their table is small: it goes to all tasks.

Words: runs of letters and digits, in lower case. Defined results: a null or empty text, and one of fewer than five words,
holds no notice; templates of fewer than five words are refused. Of a template's windows in a row the best containment counts, then the
first. Rows that repeat an id are scanned each. Texts of any length are read whole. An empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N, CONTAINMENT, HASHES, MAX_TEMPLATES, MAX_WORDS = 5, 0.75, 32, 5000, 200_000
#: Classes of templates up to this many words have a window at every word.
SHORT = 8

#: Public license notices and the openings of public license texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words(text: Column) -> Column:
    """The words of a text, as an array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def gram_hashes(w: Column) -> Column:
    """The hash of each run of N words of an array. Each slice is made once, so the cost is linear."""
    n = F.size(w)
    shifted = [F.slice(w, F.lit(j + 1), F.greatest(n - N + 1, F.lit(0))).alias(f"w{j}") for j in range(N)]
    return F.transform(F.arrays_zip(*shifted), lambda s: F.xxhash64(*[s[f"w{j}"] for j in range(N)]))


def minhash(grams: Column, hashes: int = HASHES) -> list[Column]:
    """The least hash of a set of grams under each seed."""
    return [F.array_min(F.transform(grams, lambda h: F.xxhash64(F.lit(seed), h))) for seed in range(hashes)]


def bands(grams: Column) -> Column:
    """The bands of a set of hashes: its MinHash values, each with its number."""
    return F.array(*[F.xxhash64(F.lit(k), v) for k, v in enumerate(minhash(grams))])


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    if sum(len(t.split()) for t in templates.values()) > MAX_WORDS:
        raise ValueError(f"templates of more than {MAX_WORDS} words in all")
    if short := [k for k, t in templates.items() if len(re.findall(r"[^\W_]+", t)) < N]:
        raise ValueError(f"templates of fewer than {N} words: {short}")
    rows = spark.createDataFrame(sorted(templates.items()), "license string, template string")
    rows = rows.select("license", words(F.col("template")).alias("w")).select("license", F.size("w").alias("n_words"), F.array_distinct(gram_hashes(F.col("w"))).alias("t_grams"))
    windows = F.array(*[F.struct(F.lit(top).alias("top"), F.lit(w).alias("window")) for w, _, top in lengths(templates)])
    return rows.withColumn("window", F.get(F.filter(windows, lambda c: c["top"] >= F.col("n_words")), F.lit(0))["window"])


def lengths(templates: dict[str, str]) -> list[tuple[int, int, int]]:
    """(window, stride, longest template) in words for each length class; a class reaches from one length to a quarter more."""
    out, top = [], 0
    for n in sorted({len(re.findall(r"[^\W_]+", t)) for t in templates.values()}):
        if n > top:
            top = max(n, n * 5 // 4)
            stride = 1 if top <= SHORT else (top + 1) // 2
            out.append((top + stride, stride, top))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word, n_words of every notice: where the first of its five-grams stands."""
    templates = TEMPLATES if templates is None else templates
    if not templates:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word"), F.lit(0).alias("n_words")).where("false")
    known = template_table(docs.sparkSession, templates)
    # the grams of the templates, MAX_WORDS at most
    vocabulary = sorted(r["g"] for r in known.select(F.explode("t_grams").alias("g")).distinct().collect())
    # the generator keeps the words of a text a value of their own, made once, where a projection would be inlined into each slice
    parted = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(words(F.col(text_col)))).alias("w"))
    hashed = parted.select("doc_id", F.explode(F.array(gram_hashes(F.col("w")))).alias("grams"))
    # the places of template grams in a text; windows are made around them only
    places = F.filter(F.transform("grams", lambda g, i: F.when(g.isin(vocabulary), i)), lambda i: i.isNotNull())
    likely = hashed.select("doc_id", "grams", F.explode(F.array(places)).alias("places")).where(F.size("places") > 0).withColumn("copy", F.monotonically_increasing_id())
    spans = F.array(*[F.struct(F.lit(w - N + 1).alias("size"), F.lit(w).alias("window"), F.lit(s).alias("stride")) for w, s, _ in lengths(templates)])
    by_class = likely.withColumn("span", F.explode(spans))
    stride, size = F.col("span.stride"), F.col("span.size")
    around = F.transform("places", lambda p: F.transform(F.sequence(F.ceil(F.greatest(p - size + 1, F.lit(0)) / stride).cast("int"), F.floor(p / stride).cast("int")), lambda k: k * stride))
    cut = F.transform(F.array_distinct(F.flatten(around)), lambda at: F.struct(at.alias("at"), F.slice("grams", at + 1, size).alias("grams")))
    windows = by_class.select("doc_id", "copy", "span.window", F.explode(cut).alias("cut")).select("doc_id", "copy", "window", "cut.at", "cut.grams")
    keyed = windows.withColumn("band", F.explode(bands(F.col("grams"))))
    retrieved = known.withColumn("band", F.explode(bands(F.col("t_grams"))))
    met = keyed.join(F.broadcast(retrieved), ["window", "band"])
    held = F.size(F.array_intersect("t_grams", "grams")) / F.size("t_grams")
    first = F.col("at") + F.array_position("grams", F.get(F.array_intersect("grams", "t_grams"), F.lit(0))).cast("int") - 1
    exact = met.select("doc_id", "copy", "license", "n_words", first.alias("first"), held.alias("containment")).where(F.col("containment") >= containment)
    best = exact.groupBy("doc_id", "copy", "license", "n_words").agg(F.max(F.struct(F.col("containment"), (-F.col("first")).alias("back"))).alias("best"))
    return best.select("doc_id", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("first_word"), "n_words")
