"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies, in DataFrame functions only.

Texts and templates are lower-cased and cut into runs of letters and digits.  Five-word shingles that occur in any
template are the hits of a text; others cannot lie in a match.  A template of n words is looked for in windows of
n + n // 4 words that start every max(1, n // 4) words, so that some window holds any whole occurrence.  Each window
that holds a hit has the MinHashes of its hits, and a hash join of (window class, band, MinHash) retrieves the
templates that share one.  With one row a band, a template whose resemblance to a window is s is retrieved with
probability 1 - (1 - s) ** BANDS: 1 - 2e-17 at s = 0.8, and 1 - 6e-8 at 0.5.  A retrieved template counts where at
least THRESHOLD of its shingles lie in the window.

Work after the search for hits grows with hits, not with texts.  Tables of templates go to all tasks: they are a
parameter, and their shingles and bands are checked against BROADCAST_ROWS.

Defined results: null and empty texts, and texts under five words, match nothing and are returned with no
licenses; repeated rows and null doc_id each get their own row; an empty table gives no rows; columns other than
doc_id and text are ignored.  Templates under five words are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered, tasks_for

SHINGLE, BANDS, THRESHOLD = 5, 24, 0.8
#: Template tables of more rows than this are joined by shuffles.
BROADCAST_ROWS = 200_000

_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
    "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
_NO_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)

#: Notices and whole texts of public licenses.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License",
    "MIT-text": _MIT,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "BSD-2-Clause-text": _BSD + _NO_WARRANTY,
    "BSD-3-Clause-text": _BSD
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _NO_WARRANTY,
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        'notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT-full": _MIT + (
        ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
        "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(w: Column) -> Column:
    """The five-word shingles of a word array, by position."""
    last = F.size(w) - SHINGLE
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(SHINGLE))))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<string>"))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """license, n_words, grams: one row per template."""
    rows = F.array(*(F.struct(F.lit(k).alias("license"), F.lit(v).alias("body")) for k, v in sorted(templates.items()))).cast("array<struct<license:string,body:string>>")
    table = spark.range(1).select(F.inline(rows)).select("license", tokens(F.col("body")).alias("w"))
    return table.select("license", F.size("w").alias("n_words"), F.array_distinct(shingles(F.col("w"))).alias("grams"))


_TOKEN = re.compile(r"[^\W_]+")


def _words_of(body: str) -> int:
    return len(_TOKEN.findall(body))


def anchors(templates: dict[str, str]) -> list[str]:
    """A few words of which every match holds at least one.

    A match holds THRESHOLD of a template's shingles; words are added until, in each template, the shingles
    without any of them are fewer than that.  So the filter by these words loses no match.
    """
    chosen: list[str] = []
    for body in templates.values():
        w = _TOKEN.findall(body.lower())
        grams = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
        while len(free := [g for g in grams if not set(g) & set(chosen)]) >= THRESHOLD * len(grams):
            count = {x: sum(x in g for g in free) for x in {x for g in free for x in g}}
            chosen.append(max(count, key=lambda x: (count[x] * min(len(x), 8), x)))
    return sorted(chosen)


def scan(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, licenses (sorted), matches (license, containment in thousandths, first word of the window)."""
    templates = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if _words_of(v) >= SHINGLE}
    known = cut(template_table(documents.sparkSession, templates), 1)
    every = known.select("license", "n_words", F.explode("grams").alias("g"))
    small = F.broadcast if every.count() * BANDS <= BROADCAST_ROWS else lambda df: df

    may = F.coalesce(F.lower("text"), F.lit("")).rlike("(?:" + "|".join(anchors(templates)) + ")") if templates else F.lit(False)
    w = F.when(may, tokens(F.col("text"))).otherwise(F.array().cast("array<string>"))
    # A row's shingles come from one task, so its number holds for them; only its hits are kept.
    grams = gathered(documents).select(F.monotonically_increasing_id().alias("row"), "doc_id", w.alias("w")).select("row", "doc_id", F.posexplode_outer(shingles(F.col("w"))).alias("pos", "g"))
    marked = grams.join(small(every.select(F.col("g").alias("t")).distinct()), F.col("g") == F.col("t"), "left")
    marked = marked.where("t is not null or coalesce(pos, 0) = 0")  # the hits, and one shingle for each row
    rows = cut(marked.groupBy("row", "doc_id").agg(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("pos", "g"))).alias("hits")).coalesce(tasks_for(documents)))
    hits = rows.select("row", F.inline("hits"))

    # The windows of each size that hold a hit, with their shingles and the MinHash of each band
    lengths = sorted(r["n_words"] for r in known.select("n_words").distinct().collect())  # as bounded as the templates
    placed = hits.withColumn("n_words", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")))
    placed = placed.withColumn("span", F.expr("n_words + n_words div 4")).withColumn("stride", F.expr("greatest(1, n_words div 4)"))
    placed = placed.withColumn("offset", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(span - 5) div stride").cast("long"))))
    placed = placed.withColumn("window", F.expr("pos div stride - offset")).where("window >= 0 and pos <= window * stride + span - 5")
    least = [F.min(F.xxhash64(F.lit(band), "g")).alias(f"b{band}") for band in range(BANDS)]
    windows = placed.groupBy("row", "n_words", "stride", "window").agg(F.collect_set("g").alias("inside"), *least)

    # Bands retrieve, containment verifies
    of = lambda df, *keep: df.select(*keep, F.inline(F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"b{b}").alias("least")) for b in range(BANDS)))))
    asked = of(windows, "row", "n_words", "stride", "window", "inside")
    table = of(every.groupBy("license", "n_words").agg(F.collect_set("g").alias("grams"), *least), "license", "n_words", "grams")
    met = asked.join(small(table), ["n_words", "band", "least"]).dropDuplicates(["row", "window", "license"])
    share = F.floor(F.size(F.array_intersect("inside", "grams")) * 1000 / F.size("grams")).cast("int")
    match = F.struct("license", share.alias("permille"), (F.col("window") * F.col("stride")).cast("int").alias("word"))
    found = met.select("row", match.alias("m")).where(F.col("m.permille") >= int(1000 * THRESHOLD))
    best = found.groupBy("row", "m.license").agg(F.min_by("m", F.struct(-F.col("m.permille"), F.col("m.word"))).alias("m"))
    per = best.groupBy("row").agg(F.array_sort(F.collect_list("m")).alias("matches"))
    out = rows.select("row", "doc_id").join(per, "row", "left")
    matches = F.coalesce("matches", F.array().cast("array<struct<license:string,permille:int,word:int>>"))
    return out.select("doc_id", F.transform(matches, lambda m: m["license"]).alias("licenses"), matches.alias("matches"))
