"""License notices by MinHash bands over overlapping text windows, by DataFrame functions only.

A template of L words is sought in windows of 2 L words that begin every L words, so a notice lies
wholly in one window wherever it stands. A window is a candidate if its minimum under one of the
template's hash functions equals the template's. A window that holds the share c of the template's
shingles has Jaccard similarity s = c |T| / (|W| + (1 - c) |T|) with it at least, so each template
has as many hash functions ("bands") as make 1 - (1 - s) ** bands reach `recall` at c =
`containment`: what verification would accept is a candidate with that probability. Candidates are
verified by exact containment of the template's shingles (five words, compared as strings).

A window can agree with a template in a band only if it holds the template's minimal shingle of
that band. So the minimum of a band is worked out just for windows around its shingle, with the
same outcome as for all windows; every text is scanned whole for them. A window is as wide as its
own template asks for, and a long text is worked through in overlapping blocks of words. All of it is a narrow pass; only the windows that agree are grouped. Templates are a dictionary or a table (license, notice) of up to `MOST` rows and
`MOST_CHARS` characters in all, notices or whole license texts: minimal shingles are broadcast, and
the templates' shingles once more for verification.

Defined results: null and empty texts match nothing; a template shorter than a shingle raises; a
row without an id keeps a null id; rows of one id are reported together; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

SHINGLE, MOST, MOST_CHARS = 5, 5000, 20_000_000
BLOCK = 8192  # words
#: Notices of public licenses, and the whole texts of short ones.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1.
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _shingle(w: Column, i: Column) -> Column:
    return F.concat_ws(" ", *[F.get(w, i + j) for j in range(SHINGLE)])


def shingles(w: Column) -> Column:
    return F.when(F.size(w) < SHINGLE, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: _shingle(w, i)))


def minima(strings: Column, bands: Column) -> Column:
    """The least value of each band's hash function over the shingles."""
    return F.transform(F.sequence(F.lit(1), bands), lambda band: F.array_min(F.transform(strings, lambda s: F.xxhash64(F.xxhash64(s), band))))


def bands_for(n: int, recall: float, containment: float) -> int:
    """Hash functions for a template of n words."""
    t, w = n - SHINGLE + 1, 2 * n - SHINGLE + 1
    least = containment * t / (w + (1 - containment) * t)
    return math.ceil(math.log(1 - recall) / math.log(1 - least))


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.9999, containment: float = 0.8) -> DataFrame:
    """A row per text and template found there: the best containment, the first word of the first
    matching window, and the number of matching windows."""
    spark = docs.sparkSession
    if isinstance(templates, DataFrame):
        templates = {r.license: r.notice for r in templates.select("license", "notice").limit(MOST + 1).collect()}
    if len(templates) > MOST:
        raise ValueError(f"more than {MOST} templates")
    if sum(map(len, templates.values())) > MOST_CHARS:
        raise ValueError(f"templates of more than {MOST_CHARS} characters")
    lengths = {name: len("".join(c if c.isalnum() else " " for c in t).split()) for name, t in templates.items()}
    if short := [name for name, n in lengths.items() if n < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    rows = [(name, t, bands_for(lengths[name], recall, containment)) for name, t in sorted(templates.items())]
    given = spark.createDataFrame(rows, "license string, notice string, bands int").withColumn("w", words(F.col("notice")))
    # A generator between two steps keeps the optimizer from repeating a step's work inside the next one's lambdas.
    once = lambda column: F.explode(F.array(column))
    known = given.select("license", "bands", F.size("w").alias("n"), once(F.array_distinct(shingles(F.col("w")))).alias("t")).withColumn("mins", once(minima(F.col("t"), F.col("bands"))))
    #: of each minimal shingle the bands it is minimal in
    own = lambda s: F.filter(F.transform("mins", lambda m, i: F.struct((i + 1).alias("band"), m.alias("least"))), lambda x: F.xxhash64(F.xxhash64(s), x["band"]) == x["least"])
    known = known.withColumn("anchors", once(F.filter(F.transform("t", lambda s: F.struct(s.alias("anchor"), own(s).alias("own"))), lambda a: F.size(a["own"]) > 0)))
    by_anchor = known.select("license", "n", F.inline("anchors"))
    rows = known.select("anchors.anchor").collect()  # as many rows as there are templates
    anchors = sorted({a for r in rows for a in r.anchor})
    first_words = sorted({a.split(" ")[0] for a in anchors})
    texts = docs.select(id_col, once(words(F.col(text_col))).alias("w")).where(F.size("w") >= SHINGLE)
    # Blocks bound what a task holds of a long text: each owns the hits in its first `core` words and has the widest window around them.
    widest = max(len("".join(c if c.isalnum() else " " for c in t).split()) for t in templates.values())
    core, b = max(BLOCK, 4 * widest), F.col("b")
    from_word = F.greatest(b - 2 * widest, F.lit(0))
    cut = texts.select(id_col, "w", F.explode(F.sequence(F.lit(0), F.size("w") - SHINGLE, F.lit(core))).alias("b"))
    blocks = cut.select(id_col, from_word.alias("base"), (b - from_word).alias("own_from"), F.slice("w", from_word + 1, b - from_word + core + 2 * widest).alias("w"))
    w, own_from = F.col("w"), F.col("own_from")
    at = F.filter(F.sequence(own_from, F.least(own_from + core - 1, F.size(w) - SHINGLE)), lambda i: F.get(w, i).isin(first_words) & _shingle(w, i).isin(anchors))
    found = blocks.select(id_col, "base", "w", once(F.transform(at, lambda p: F.struct(p.alias("p"), _shingle(w, p).alias("anchor")))).alias("hits")).where(F.size("hits") > 0)
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(_shingle(w, i)))  # once a block, for all of its windows
    hits = found.select(id_col, "base", "w", "hits", once(hashed).alias("x")).select(id_col, "base", "w", "x", F.explode("hits").alias("h"))
    # No step from the hits to the windows has a lambda, so they compile into one loop that copies windows only.
    place = F.col("base") + F.col("p")
    stride = F.floor(place / F.col("n")).cast("int") * F.col("n")
    first = F.col("start") - F.col("base") + 1
    windows = (
        hits.select(id_col, "base", "w", "x", "h.p", "h.anchor")
        .join(F.broadcast(by_anchor), "anchor")
        .withColumn("start", F.explode(F.array(stride, stride - F.col("n"))))
        .where((F.col("start") >= 0) & (place + SHINGLE <= F.col("start") + 2 * F.col("n")))
        .select(id_col, "base", "license", "start", "own", "n", "x", once(F.slice("w", first, 2 * F.col("n"))).alias("inside"))
        .select(id_col, "license", "start", "own", "inside", once(F.slice("x", first, 2 * F.col("n") - SHINGLE + 1)).alias("x"))
    )
    agrees = F.exists("own", lambda b: F.array_min(F.transform("x", lambda x: F.xxhash64(x, b["band"]))) == b["least"])
    # A window that agrees in several bands is verified once; the words are part of what is compared, as ids may repeat.
    return (
        windows.where(agrees)
        .select(id_col, "license", "start", "inside")
        .distinct()
        .select(id_col, "license", "start", once(shingles(F.col("inside"))).alias("s"))
        .join(F.broadcast(known.select("license", "t")), "license")
        .withColumn("containment", F.size(F.array_intersect("s", "t")) / F.size("t"))
        .where(F.col("containment") >= containment)
        .groupBy(id_col, "license")
        .agg(F.max("containment").alias("containment"), F.min("start").cast("long").alias("first_word"), F.count_distinct("start").alias("n_windows"))
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
