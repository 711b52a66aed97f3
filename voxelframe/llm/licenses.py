"""License scan: TF-IDF cosine of headers to templates, then inheritance down paths.

A header is a sentence, within a line or with the lines it is wrapped over,
that has two words of the header templates, one of them a word that names or
grants a licence; it reaches from its first such word to its last. A text with
several words of the full licence texts is compared as a whole too, however
long it is.
Words and pairs of neighbours are hashed to BUCKETS terms, so that the table of
document frequencies has a fixed bound. Weights are term frequency times inverse
document frequency over all headers and templates; similarity is the cosine of
the whole vectors. The best template at or over the threshold is the licence.

A licence file is a text that as a whole is like a full licence text, one that
opens with the title of a licence, one that is for the most part one header, or
one with a header and the file name of a licence. It rules its directory; a
file without a licence of its own takes that of its nearest ancestor directory.
DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Stage

#: Standard headers of public licences.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",),
    "GPL-2.0": ("This program is licensed under the GNU General Public License, version 2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    "GPL-3.0": ("This program is licensed under the GNU General Public License, version 3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3",),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "BSD-3-Clause": ("Released under the three clause BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0",),
    "ISC": ("Released under the ISC License", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0", "Creative Commons CC0 1.0 Universal"),
}
#: Template words that begin or end no header.
COMMON = set("a an and any are as at by for in is it of on or the this to under with without your".split())
#: Template words that on their own are no sign of a licence.
PLAIN = set("1.0 2 2.0 3 4.0 binary charge clause code copy dedicated distribute domain either fee form forms foundation free general international later library modification modify obtaining option permitted person program public published purpose released software source subject terms three universal use version".split())
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Terms are hashed to so many buckets.
BUCKETS = 1 << 18
#: A sentence ends at a full stop before a blank or the end, and at a line end or, where it is wrapped, an empty line.
_END = (r"\n|\.(?!\S)", r"\n[ \t\r]*\n|\.(?!\S)")
#: The titles that full licence texts open with; dates tell them from mentions.
_OPENING = r"(?is)^[\s#*/=-]*(?:the\s+)?"
TITLES = {
    "Apache-2.0": r"apache license\s+version 2\.0, january 2004",
    "GPL-2.0": r"gnu general public license\s+version 2, june 1991",
    "GPL-3.0": r"gnu general public license\s+version 3, 29 june 2007",
    "LGPL-3.0": r"gnu lesser general public license\s+version 3, 29 june 2007",
    "AGPL-3.0": r"gnu affero general public license\s+version 3, 19 november 2007",
    "MPL-2.0": r"mozilla public license,? version 2\.0\s+[=\s-]*1\. definitions",
    "CC-BY-4.0": r"(?:creative commons\s+)?attribution 4\.0 international",
    "CC-BY-SA-4.0": r"(?:creative commons\s+)?attribution-sharealike 4\.0 international",
    "CC-BY-NC-4.0": r"(?:creative commons\s+)?attribution-noncommercial 4\.0 international",
    "CC0-1.0": r"(?:creative commons legal code\s+)?cc0 1\.0 universal",
}
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
#: Full texts of short licences, without names and years.
FULL_TEXTS = {
    "MIT": f"""MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "ISC": f"""ISC License Copyright (c) Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
_FILE = r"(?i)(?:^|/)(?:licen[sc]es?|copying)(?:[.-](?:txt|md|rst|html|lesser|mit|apache|bsd|isc|mpl|gpl|lgpl|agpl|cc0)(?:-?[0-9.]+)?)*$"
#: Least cosine of a header to a template, and of a whole text to a full licence text.
THRESHOLD, FULL_THRESHOLD = 0.45, 0.7
#: Different words of the full texts that a text has to have to be compared as a whole.
FULL_WORDS = 8


def _words(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def bodies() -> list[tuple[str, bool, str]]:
    """(name, full, body) of every template: headers, the machine-readable line of each licence, and full texts."""
    headers = [(name, False, body) for name, many in TEMPLATES.items() for body in (*many, f"SPDX-License-Identifier: {name}")]
    return sorted(headers + [(name, True, body) for name, body in FULL_TEXTS.items()])


def _any_of(words: set[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + r")\b"


VOCABULARY = {w for _, full, body in bodies() if not full for w in _words(body)} - COMMON
NAMING = VOCABULARY - PLAIN
FULL_VOCABULARY = {w for body in FULL_TEXTS.values() for w in _words(body) if len(w) > 5}


def terms(text: Column) -> Column:
    """Buckets of the lower-case words of letters, digits and inner dots, and of the pairs of neighbours."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, F.lit(2))))
    # words worked out once, not for each pair
    both = F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.concat(w, pairs(w))).otherwise(w)))
    return F.transform(both, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))


def headers(lowered: Column) -> Column:
    """Distinct (body, size) of a lower-case text's headers; size is the sentence's length."""
    vocabulary = _any_of(VOCABULARY)

    def of(end):
        sentences = F.filter(F.split(lowered, end), lambda x: x.rlike(_any_of(NAMING)))
        told = F.transform(sentences, lambda x: F.struct(F.regexp_extract(x, f"(?s){vocabulary}.*{vocabulary}", 0).alias("body"), F.length(F.trim(x)).alias("size")))
        return F.filter(told, lambda h: F.size(F.array_distinct(F.regexp_extract_all(h["body"], F.lit(vocabulary), F.lit(0)))) > 1)

    return F.array_distinct(F.concat(*map(of, _END)))


def scan_licenses(docs: DataFrame, path: Column, text_col: str = "text", threshold: float = THRESHOLD, full_threshold: float = FULL_THRESHOLD) -> DataFrame:
    """(doc_id, path, license, similarity, is_license_file, inherited_license, inherited_from, effective_license).

    One row for each of docs. license: of a text that is a full licence text
    that licence, else the most similar template's of any header, ties by name;
    null without one. inherited_*: the licence
    of the nearest ancestor directory (the file's own included) that a licence
    file rules; of several in one directory the most similar, then the first
    by name. effective_license: the own one, else the inherited. A null or
    empty text has no header; a null path has no ancestors. Repeated rows are
    scanned each; other columns are ignored.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "licenses")
    text = F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select("doc_id", path.cast("string").alias("path"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    titled = F.coalesce(*[F.when(F.col("text").rlike(_OPENING + t), name) for name, t in TITLES.items()])
    legal = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(_any_of(FULL_VOCABULARY)), F.lit(0)))) >= FULL_WORDS
    shape = "array<struct<body:string,size:int>>"
    rows = rows.select(
        "doc_id", "path", "row", F.length(F.regexp_replace(F.trim("text"), r"\s+", " ")).alias("n"), titled.alias("titled"),
        F.when(F.col("text").rlike(_any_of(NAMING)), headers(F.col("text"))).otherwise(F.array()).cast(shape).alias("headers"),
        F.when(legal, F.col("text")).alias("whole"),
    )
    rows = stage.put(rows, "rows")

    # unit: a header, or the whole text as number -1
    units = rows.select("row", "n", F.posexplode("headers").alias("unit", "h")).select("row", "unit", (F.col("h.size") * 2 > F.col("n")).alias("most"), F.col("h.body").alias("body"))
    units = units.union(rows.where("whole is not null").select("row", F.lit(-1), F.lit(True), "whole"))
    counts = stage.put(units.select("row", "unit", "most", F.explode(terms(F.col("body"))).alias("term")).groupBy("row", "unit", "most", "term").agg(F.count("*").alias("tf")), "counts")
    templates = spark.createDataFrame([(k, *b) for k, b in enumerate(bodies())], "template int, name string, full boolean, body string")
    known = templates.select("template", "name", "full", F.explode(terms(F.col("body"))).alias("term")).groupBy("template", "name", "full", "term").agg(F.count("*").alias("tf"))
    n = counts.select("row", "unit").distinct().count() + len(bodies())
    df = counts.select("term").union(known.select("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.broadcast(stage.put(df.select("term", (F.log(F.lit(float(n + 1)) / F.col("df")) + 1).alias("idf")), "idf"))  # at most BUCKETS rows
    weight = (1 + F.log(F.col("tf"))) * F.col("idf")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")))
    vectors = counts.join(idf, "term").select("row", "unit", "most", "term", weight.alias("w"))
    known = stage.put(known.join(idf, "term").select("template", "name", "full", "term", weight.alias("w")), "templates")
    sizes = F.broadcast(known.groupBy("template").agg(norm.alias("known_norm")))
    shared = vectors.join(F.broadcast(known.select("template", "name", "full", "term", F.col("w").alias("v"))), "term").where(F.col("full") == (F.col("unit") == -1))
    shared = shared.groupBy("row", "unit", "most", "template", "name", "full").agg(F.sum(F.col("w") * F.col("v")).alias("dot")).join(sizes, "template")
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("known_norm")), 9)
    near = shared.join(vectors.groupBy("row", "unit").agg(norm.alias("norm")), ["row", "unit"]).withColumn("cosine", cosine)
    near = near.where(F.col("cosine") >= F.when(F.col("full"), full_threshold).otherwise(threshold))
    best = near.groupBy("row").agg(F.min(F.struct((~F.col("full")).alias("k"), (-F.col("cosine")).alias("c"), "name", (~F.col("most")).alias("part"))).alias("s"))
    own = rows.select("doc_id", "path", "row", "titled").join(best, "row", "left")
    is_file = F.col("titled").isNotNull() | F.coalesce(~F.col("s.part"), F.lit(False)) | (F.col("s").isNotNull() & F.coalesce(F.col("path").rlike(_FILE), F.lit(False)))
    own = own.select("doc_id", "path", "row", is_file.alias("is_license_file"), F.coalesce("titled", "s.name").alias("license"), F.when(F.col("titled").isNotNull(), 1.0).otherwise(-F.col("s.c")).alias("similarity"))
    own = stage.put(own, "own")

    parts = F.split(F.col("path"), "/")
    directory = lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    ruled = own.where("is_license_file and license is not null and path is not null").select(directory(F.size(parts) - 1).alias("dir"), F.struct((-F.col("similarity")).alias("c"), "license").alias("s"))
    ruled = ruled.groupBy("dir").agg(F.min("s.license").alias("first"), F.min("s").alias("s")).select("dir", F.col("s.license").alias("inherited_license"))
    # ancestors of each distinct directory, joined to the ruled ones by path
    dirs = own.where("path is not null").select(directory(F.size(parts) - 1).alias("own_dir")).distinct()
    own_parts = F.split(F.col("own_dir"), "/")
    ancestors = dirs.select("own_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(own_parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(own_parts, F.lit(1), k), "/").alias("dir")))).alias("a")).select("own_dir", "a.depth", "a.dir")
    nearest = ancestors.join(ruled, "dir").groupBy("own_dir").agg(F.max(F.struct("depth", "dir", "inherited_license")).alias("s")).select("own_dir", F.col("s.inherited_license").alias("inherited_license"), F.col("s.dir").alias("inherited_from"))
    out = own.withColumn("own_dir", directory(F.size(parts) - 1)).join(nearest, "own_dir", "left")
    return out.select("doc_id", "path", "license", "similarity", "is_license_file", "inherited_license", "inherited_from", F.coalesce("license", "inherited_license").alias("effective_license"))
