import textwrap

from pyspark.sql import functions as F

from voxelframe.llm.licenses import FULL_TEXTS, scan_licenses

PROSE = "Thntblere of then edtioner in inea that esly. " * 20
APACHE, GPL, NC = "Licensed under the Apache License, Version 2.0.", "This program is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."


def scan(spark, rows):
    df = spark.createDataFrame([(i, p, t, "x") for i, p, t in rows], "doc_id long, path string, text string, license string").repartition(3)
    return {r.doc_id: r for r in scan_licenses(df, F.col("path")).collect()}


def test_headers_and_inheritance(spark):
    got = scan(
        spark,
        [
            (1, "a/LICENSE", APACHE),
            (2, "a/b/c/x.txt", PROSE),
            (3, "a/b/LICENSE", GPL),
            (4, "a/b/y.txt", PROSE + NC + " " + PROSE),
            (5, "a/z.txt", PROSE),
            (6, "q/z.txt", PROSE),
            (7, "a/bb/z.txt", None),
            (8, None, PROSE + "\n" + APACHE),
            (9, "q/w.txt", ""),
            (10, "a/b/c/licence-talk.txt", PROSE + "They had no license to operate a boat there."),
        ],
    )
    assert len(got) == 10
    own = {i: r.license for i, r in got.items()}
    assert own == {1: "Apache-2.0", 2: None, 3: "GPL-3.0", 4: "CC-BY-NC-4.0", 5: None, 6: None, 7: None, 8: "Apache-2.0", 9: None, 10: None}
    assert {i for i, r in got.items() if r.is_license_file} == {1, 3}
    assert {i: r.effective_license for i, r in got.items()} == {1: "Apache-2.0", 2: "GPL-3.0", 3: "GPL-3.0", 4: "CC-BY-NC-4.0", 5: "Apache-2.0", 6: None, 7: "Apache-2.0", 8: "Apache-2.0", 9: None, 10: "GPL-3.0"}
    assert got[2].inherited_from == "a/b" and got[7].inherited_from == "a"


MIT = """MIT License

Copyright (c) 2019 Ada Example

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_FULL = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

      "Licensor" shall mean the copyright owner or entity authorized by
      the copyright owner that is granting the License.

      "Legal Entity" shall mean the union of the acting entity and all
      other entities that control, are controlled by, or are under common
      control with that entity. For the purposes of this definition,
      "control" means (i) the power, direct or indirect, to cause the
      direction or management of such entity, whether by contract or
      otherwise, or (ii) ownership of fifty percent (50%) or more of the
      outstanding shares, or (iii) beneficial ownership of such entity.
"""


def test_full_texts_rule_their_directories(spark):
    bsd, isc = (textwrap.fill(FULL_TEXTS[k].replace("(c)", "(c) 2019, Ada Example"), 80) for k in ("BSD-3-Clause", "ISC"))
    wrapped = "This program is distributed in the hope of use, under the GNU General Public License,\nversion 2. " + PROSE
    long = "word " * 300 + "is all licensed under the Apache License, Version 2.0, and " + "more " * 300
    texts = {"m": MIT, "b": bsd, "i": isc, "p": APACHE_FULL, "l": long, "h": "word " * 20_000 + APACHE}
    rows = [(10 * i, f"{d}/0", text) for i, (d, text) in enumerate(texts.items())] + [(10 * i + 1, f"{d}/x/1", PROSE) for i, d in enumerate(texts)]
    rows += [(90, "w/0", wrapped), (91, "c/0", "/* " + MIT + " */ " + PROSE * 20), (92, "c/1", PROSE), (93, "n/COPYING", PROSE + APACHE), (94, "n/1", PROSE)]
    got = scan(spark, rows)
    names = ["MIT", "BSD-3-Clause", "ISC", "Apache-2.0", "Apache-2.0", "Apache-2.0"]
    for i, name in enumerate(names):
        assert got[10 * i].license == name and got[10 * i].is_license_file, got[10 * i]
        assert got[10 * i + 1].effective_license == name, got[10 * i + 1]
    assert got[90].license == "GPL-2.0" and not got[90].is_license_file
    assert got[91].license == "MIT" and not got[91].is_license_file and got[92].effective_license is None
    assert got[94].effective_license == "Apache-2.0"


def test_no_rows_and_no_headers(spark):
    df = spark.createDataFrame([(1, "p", "t")], "doc_id long, path string, text string")
    assert scan_licenses(df, F.col("path")).first().license is None
    assert scan_licenses(df.limit(0), F.col("path")).count() == 0
    twice = scan_licenses(df.union(df), F.col("path"))
    assert twice.count() == 2


def test_sample_table(spark):
    """Every planted header line is found, and nothing without one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0", "CC-BY-NC-4.0": "CC BY-NC 4.0", "GPL-3.0": "GNU General Public License, version 3"}
    text = {r.doc_id: r.text for r in docs.collect()}
    got = scan_licenses(docs, F.concat_ws("/", "source", "doc_id")).collect()
    for r in got:
        has = {k for k, v in lines.items() if v in text[r.doc_id]}
        if len(has) == 1:
            assert r.license in has, (r, has)
        if r.license:
            assert "licen" in text[r.doc_id].lower()


def plain_scan(texts):
    """{doc_id: (license, similarity)} by plain TF-IDF over all headers and templates; titles and paths aside."""
    import math
    import re
    from collections import Counter

    import xxhash

    from voxelframe.llm import licenses as L

    def terms(text):
        w = re.findall(L._TOKEN, text.lower())
        both = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        signed = [xxhash.xxh64(t.encode(), seed=42).intdigest() for t in both]
        return Counter((h - (1 << 64) if h >> 63 else h) % L.BUCKETS for h in signed)

    units = []
    for i, text in texts.items():
        low, found = (text or "").lower(), set()
        for end in (r"\n|\.(?!\S)", r"\n[ \t\r]*\n|\.(?!\S)"):
            for sentence in re.split(end, low):
                hits = list(re.finditer(L._any_of(L.VOCABULARY), sentence))
                if re.search(L._any_of(L.NAMING), sentence) and len({h[0] for h in hits}) > 1:
                    found.add((sentence[hits[0].start() : hits[-1].end()], len(sentence.strip(" "))))
        units += [(i, False, terms(body)) for body, _ in found]
        if len(low) < 4 * max(map(len, L.FULL_TEXTS.values())) and len(set(re.findall(L._any_of(L.FULL_VOCABULARY), low))) >= L.FULL_WORDS:
            units.append((i, True, terms(low)))
    known = [(name, full, terms(body)) for name, full, body in L.bodies()]
    df = Counter(t for *_, c in units for t in c) + Counter(t for *_, c in known for t in c)
    n = len(units) + len(known)
    weigh = lambda c: {t: (1 + math.log(k)) * (math.log((n + 1) / df[t]) + 1) for t, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = {}
    for i, whole, c in units:
        v = weigh(c)
        for name, full, k in known:
            if full == whole:
                w = weigh(k)
                cosine = round(sum(v[t] * w[t] for t in v.keys() & w.keys()) / (norm(v) * norm(w)), 9)
                if cosine >= (L.FULL_THRESHOLD if full else L.THRESHOLD):
                    best[i] = min(best.get(i, (2,)), (not full, -cosine, name))
    return {i: (best[i][2], -best[i][1]) if i in best else (None, None) for i in texts}


def test_against_plain_tf_idf(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    lines = [
        APACHE, GPL, NC, MIT, "MIT License", "Released under the ISC license. And more. Released under the MIT License", "The software is licensed, see the version of the program",
        "Some public domain software is dedicated to the public. CC0 1.0 Universal", "SPDX-License-Identifier: BSD-3-Clause", "# SPDX-License-Identifier: GPL-2.0\nint main", "Copyright (c) permission of the general public",
        "This program is licensed under the GNU Lesser\nGeneral Public License, version 3 or later", "no license", None, "", "They met at MIT. The Apache tribe.", "license " * 50, "apache license " * 3000,
    ]
    texts |= {10_000 + k: t for k, t in enumerate(lines)}
    texts |= {20_000 + k: textwrap.fill(t, 60) for k, t in enumerate(FULL_TEXTS.values())}
    want = plain_scan(texts)
    got = scan(spark, [(i, f"d{i}/x.c", t) for i, t in texts.items()])
    for i, (name, similarity) in want.items():
        assert got[i].license == name and (name is None or abs(got[i].similarity - similarity) < 2e-9), (i, texts[i], got[i], name, similarity)
    assert sum(name is not None for name, _ in want.values()) > 12


def test_ties_and_repeated_rows(spark):
    """Equal cosines go by name; of two licence files in a directory the more similar rules, then the first by name; each repeated row is scanned."""
    both = "Released under the MIT License.\nReleased under the ISC License."
    rows = [(1, "a/one.c", both), (2, "b/LICENSE", "Released under the MIT License."), (3, "b/COPYING", "Released under the ISC License."), (4, "b/x.c", "plain"), (5, "c/LICENSE", GPL), (6, "c/COPYING", "MIT License"), (7, "c/x.c", "plain"), (7, "c/x.c", "plain")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    out = scan_licenses(df, F.col("path")).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 8 and got[1].license == "ISC" and got[4].effective_license == "ISC" and got[7].effective_license == "GPL-3.0"


def test_length_and_blanks_do_not_matter(spark):
    """A licence followed by thousands of blank lines, wrapped lines with wide blanks, and six licences in one file are licence files."""
    mit, bsd = FULL_TEXTS["MIT"], FULL_TEXTS["BSD-3-Clause"]
    rows = [(1, "b/notice", mit + "\n" * 6000), (2, "b/y.c", PROSE), (3, "c/notice", "\n\n".join([bsd] * 6)), (4, "c/y.c", PROSE), (5, "d/notice", mit.replace(" ", "    ") + " " * 9000), (6, "d/y.c", PROSE), (7, "e/LICENSE", APACHE + "\n" * 500), (8, "e/y.c", PROSE), (9, "f/notice", mit + "\n" + PROSE * 60), (10, "f/y.c", PROSE)]
    got = scan(spark, rows)
    assert {i: r.license for i, r in got.items()} == {1: "MIT", 2: None, 3: "BSD-3-Clause", 4: None, 5: "MIT", 6: None, 7: "Apache-2.0", 8: None, 9: "MIT", 10: None}
    assert {i for i, r in got.items() if r.is_license_file} == {1, 3, 5, 7}
    assert {i: got[i].inherited_license for i in (2, 4, 6, 8, 10)} == {2: "MIT", 4: "BSD-3-Clause", 6: "MIT", 8: "Apache-2.0", 10: None}
