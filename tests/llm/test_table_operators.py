"""Licences, top-k, WARC, URL filters against brute force; the pipeline; the queries against their SQL."""

import glob
import io
import math
import os
import random
import re
import time
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohort_spark.llm import licences, queries, topk, urls, warc
from cohort_spark.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


# -- licences ------------------------------------------------------------------

FILES = [
    ("a/LICENSE", "MIT License\nReleased under the MIT License."),
    ("a/x.py", "print(1)"),
    ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
    ("a/b/z.py", None),
    ("a/b/c/w.py", ""),
    ("d/one.py", "Released under the MIT License."),
    ("d/two.py", "Licensed under CC BY-NC 4.0."),
    ("d/three.py", "nothing"),
    ("top.py", "nothing here"),
    (None, "Released under the MIT License."),
    (None, None),
    ("a/x.py", "print(1)"),
    ("ab/x.py", "not below a"),
    ("e/long.py", "filler words " * 20000 + "\nThis work is licensed under the GNU General Public License, version 3.\n" + "more " * 20000),
    ("e/f/g/h.py", "licensed to drive, said the copyright lawyer of the long and winding road to nowhere"),
]


def commented(text, mark="# "):
    return "\n".join((mark + x).rstrip() for x in text.split("\n"))


MIT_FILE = """MIT License

Copyright (c) 2019 Some Person

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
SOFTWARE."""
GPL_NOTICE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
APACHE_NOTICE = """Copyright 2020 Some Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD_FILE = f"""Copyright (c) 2001, Some Person
All rights reserved.

{licences.BSD_GRANT}

{licences.BSD_NAMES}

{licences.BSD_DISCLAIMER.upper()}"""
REAL = [
    ("mit/LICENSE", MIT_FILE, "MIT"),
    ("mit/src/main.py", "import os\n", "MIT"),
    ("bsd3/LICENSE.txt", BSD_FILE, "BSD-3-Clause"),
    ("bsd2/COPYING", BSD_FILE.replace(licences.BSD_NAMES, ""), "BSD-2-Clause"),
    ("bsd3/lib/a.c", "/*\n" + commented(BSD_FILE, " * ") + "\n */\nint x;", "BSD-3-Clause"),
    ("gpl/LICENSE", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\nEveryone is permitted to copy.\n\n" + "terms of use " * 3000, "GPL-3.0"),
    ("gpl/x/y/z.sh", "echo", "GPL-3.0"),
    ("apache/LICENSE", "  Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS " + "of use " * 2000, "Apache-2.0"),
    ("h/a.py", "#!/usr/bin/python\n" + commented(GPL_NOTICE) + "\ncode()", "GPL-3.0"),
    ("h/b.js", commented(APACHE_NOTICE, "// ") + "\ncode()", "Apache-2.0"),
    ("h/lesser.c", commented(GPL_NOTICE.replace("General", "Lesser General"), "// "), "LGPL-3.0"),
    ("h/two.c", commented(GPL_NOTICE.replace("version 3", "version 2"), "-- "), "GPL-2.0"),
    ("s/a.c", "/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
    ("s/b.rs", "// SPDX-License-Identifier: MIT", "MIT"),
    ("s/c.rs", "// SPDX-License-Identifier: MIT OR Apache-2.0", None),
    ("s/d.rs", "# SPDX-License-Identifier: GPL-1.0", None),
    ("n/prose.txt", "# The copyright office\n# is closed on Monday", None),
]


def test_a_licence_file_of_a_megabyte(spark):
    words = " ".join(f"word{i % 20011} licence" for i in range(60_000))
    files = spark.createDataFrame([("big/LICENSE", words), ("small/LICENSE", MIT_FILE), ("small/x.py", "pass")], "path string, text string")
    began = time.time()
    found = {r.path: r._licence.name for r in licences.licensed_files(files).select("path", "_licence").collect()}
    assert len(words) > 900_000 and found == {"big/LICENSE": None, "small/LICENSE": "MIT", "small/x.py": "MIT"}
    assert time.time() - began < 60


def test_real_licence_texts(spark):
    df = spark.createDataFrame([(p, t) for p, t, _ in REAL], "path string, text string")
    out = {r.path: r._licence for r in licences.licensed_files(df).collect()}
    assert {p: out[p].name for p, _, _ in REAL} == {p: want for p, _, want in REAL}
    assert (out["mit/src/main.py"].origin, out["mit/src/main.py"].directory) == ("directory", "mit")
    assert out["h/b.js"].origin == "notice"


def test_licences(spark):
    df = spark.createDataFrame([(p, t, "n", "u", 1, 2) for p, t in FILES], "path string, text string, licence string, unit string, _path int, _own int")
    out = licences.licensed_files(df)
    assert out.columns == [*df.columns, "_licence"]
    found = Counter((r.path, (r.text or "")[:9], r._licence.name, r._licence.origin, r._licence.directory) for r in out.collect())
    assert sum(found.values()) == len(FILES)
    by = {k[:2]: k[2:] for k in found}
    assert by[("a/LICENSE", "MIT Licen")] == ("MIT", "notice", None)
    assert by[("a/x.py", "print(1)")] == ("MIT", "directory", "a") and found[("a/x.py", "print(1)", "MIT", "directory", "a")] == 2
    assert by[("a/b/y.py", "# License")] == ("Apache-2.0", "notice", None)
    assert by[("a/b/z.py", "")] == ("Apache-2.0", "directory", "a/b") == by[("a/b/c/w.py", "")]
    assert by[("d/three.py", "nothing")] == (None, None, None)  # d's files disagree
    assert by[("top.py", "nothing h")] == (None, None, None) == by[("ab/x.py", "not below")]
    assert by[(None, "Released ")] == ("MIT", "notice", None) and by[(None, "")] == (None, None, None)
    assert by[("e/long.py", "filler wo")] == ("GPL-3.0", "notice", None)
    assert by[("e/f/g/h.py", "licensed ")] == ("GPL-3.0", "directory", "e")
    assert licences.licensed_files(df.limit(0)).count() == 0


def test_cosines(spark):
    texts = ["Released under the MIT License.", "Licensed under the Apache License", "under the license"]
    units = spark.createDataFrame([(t, i + 1) for i, t in enumerate(texts)], "unit string, n long")
    words = lambda t: re.findall(licences.WORD, t.lower())
    total = 6
    df = Counter()
    for i, t in enumerate(texts):
        for w in set(words(t)):
            df[w] += i + 1
    vec = lambda t: {w: n * (math.log((total + 1) / (df[w] + 1)) + 1) for w, n in Counter(words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    found = {(r.unit, r.licence): r.score for r in licences.matched(units, least=0.0).collect()}
    for t in texts:
        u = vec(t)
        scores = {k: sum(u[w] * v[w] for w in u if w in v) / norm(u) / norm(v) for k, v in ((k, vec(x)) for k, x in licences.TEMPLATES)}
        best = min(scores, key=lambda k: (-round(scores[k], 6), k))
        assert abs(found[(t, best)] - scores[best]) < 1e-5


# -- top-k ---------------------------------------------------------------------


def brute_top(rows, k, step):
    own = {(i, tuple(math.floor(64.0 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for i, v in own:
        if i % step == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in own if j != i))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


@pytest.mark.parametrize("shape", ["clustered", "copies", "few", "large", "grown"])
def test_top_k(spark, shape, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8)) * 4
    n = {"clustered": 700, "copies": 400, "few": 12, "large": 60, "grown": 700}[shape]
    pivots = 4
    if shape == "grown":  # as many pivots as the table asks for
        monkeypatch.setattr(topk, "BLOCK", 2)
        pivots = None
    vectors = [(centres[i % 5] + rng.normal(size=8) * 0.3).tolist() for i in range(n)]
    if shape == "copies":
        vectors = [vectors[0] if i % 3 else v for i, v in enumerate(vectors)]
    if shape == "large":
        vectors = [[x * 2.0**17 for x in v] for v in vectors]
    rows = list(enumerate(vectors)) + [(5000, None), (None, vectors[0]), (5001, [float("nan")] * 8), (5020, [1.0, None] + [0.0] * 6), (5040, [float("inf")] * 8), (0, vectors[0]), (5060, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<double>, score int, query_id string")
    out = topk.top_k(topk.integer_vectors(df), F.col("id") % 20 == 0, k=20, pivots=pivots, rings=3)
    found = [(r.query_id, r.rank, r.id, r.score) for r in out.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_top(rows, 20, 20)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(topk.integer_vectors(df), F.col("id") % 20 == 0).count() == 0
    one = spark.createDataFrame([(20, [1.0])], df.schema)
    assert topk.top_k(topk.integer_vectors(one), F.col("id") % 20 == 0).count() == 0


def test_bounds_prune_without_loss():
    rng = np.random.default_rng(0)
    x = rng.integers(-100, 100, (200, 6))
    space = topk.Space(x[:4], float((x**2).sum(1).max()), 6)
    d, q = space.distances(x, False), x[:20]
    dq = space.distances(q, True)
    bound = ((q**2).sum(1)[:, None, None] + space.most - np.abs(dq[:, None, :] - d[None]) ** 2) / 2
    assert (bound + 1e-3 >= (q @ x.T)[:, :, None]).all()


# -- WARC ----------------------------------------------------------------------


@pytest.mark.parametrize("least, split, archive", [(0, 4 << 20, 1 << 28), (0, 97, 3000), (4, 1000, 1)])
def test_warc_round_trip(spark, least, split, archive):
    rng = random.Random(9)
    magic = b"\x1f\x8b\x08".decode("latin-1")
    pages = [(i, f"http://h/{i}", "x" * rng.randrange(400) + magic * rng.randrange(3)) for i in range(60)]
    pages += [(100 + i, "http://h/same page\r\n", "same é") for i in range(5)] + [(200, None, None), (201, "http://e", ""), (None, "http://n", "same é"), (104, "http://h/again", "same é"), (300, "u", "abc"), (301, "u", "abc")]
    pages += [(400, "http://big", "".join(chr(rng.randrange(32, 2000)) for _ in range(300_000)))]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, sha1 string, top int")
    manifest = warc.write_archives(df, fresh_path(spark, "warc"), least, archive_bytes=archive)
    out = warc.read_archives(spark, manifest, split).collect()
    top = {}
    for i, _, h in pages:
        raw = (h or "").encode()
        if i is not None and len(raw) >= least:
            top[raw] = max(top.get(raw, i), i)
    wanted = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = i is not None and i < top.get(raw, i)
        wanted[(i, len(raw), warc.base32_sha1(raw), "revisit" if revisit else "response", top[raw] if revisit else None, None if revisit else raw)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out) == wanted


def test_archive_paths_keep_their_scheme(spark, tmp_path, monkeypatch):
    from pyarrow import fs

    folder = f"file://{tmp_path}/with space %20"
    df = spark.createDataFrame([(1, "u", "x"), (2, None, None)], "page_id long, url string, html string")
    manifest = warc.write_archives(df, folder)
    assert all(r.path.startswith(folder + "/") for r in manifest.collect())
    assert {r.page_id for r in warc.read_archives(spark, manifest).collect()} == {1, 2}
    asked = []
    monkeypatch.setattr(fs, "FileSystem", SimpleNamespace(from_uri=asked.append))
    for uri in ("s3a://bucket/a", "s3n://bucket/a", "s3://bucket/a", "gs://bucket/a", "hdfs://host:1/a"):
        warc.file_system(uri)
    assert asked == ["s3://bucket/a"] * 3 + ["gs://bucket/a", "hdfs://host:1/a"]


def test_warc_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(spark, warc.write_archives(df, fresh_path(spark, "warc"))).count() == 0


def test_every_split_point_owns_each_record_once():
    members = [warc.record(i, "u", bytes(random.Random(i).randbytes(50)) + warc.MAGIC * (i % 3), "D") for i in range(6)]
    whole = b"".join(members)
    for cut in range(0, len(whole) + 1, 7):
        got = [x for a, b in ((0, cut), (cut, len(whole))) for x in warc.records_in(io.BytesIO(whole), a, b)]
        assert got == [zlib.decompress(m, 31) for m in members]


# -- URL filters ---------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda r: len(r[0]), default=(None, None)))


def test_urls(spark):
    rng = random.Random(12)
    rows = [(i, f"http{'s' * (i % 2)}://{rng.choice(['a', 'b', 'www', 'Bad'])}.{rng.choice(['x', 'spam'])}.org/{rng.choice(['en', 'de'])}/{i}.html?q=1") for i in range(400)]
    rows += [(1000 + i, u) for i, u in enumerate([None, "", "nothing", "http://", "http://Example.COM/en/1", "ftp://www.example.com/en/", "http://www.example.com/en", "x://net/es/1#a/b", "x://a.net/fr/", "x://anet/fr/", "x://com", "x://com?/", "x://u://v.com/z", "x://café.net/es/É\nq", "x://com/\n"])]
    rows += [(3, rows[3][1]), (None, "http://q.spam.org/en/1")]
    labels = [(i, 0 if i is not None and ".spam." in (u or "") and rng.random() < 0.9 else 1, 0) for i, u in rows if i is not None and i % 2 == 0] + [(None, 0, 0), (7, None, None)]
    df = spark.createDataFrame([(i, u, "h", "t") for i, u in rows], "page_id long, url string, host string, tokens string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = urls.judged_urls(df, lab).collect()
    assert len(out) == len(rows)
    found = Counter((r.page_id, r.host, r.path, r.rule) for r in out)
    assert found == Counter((i, *brute_rule(u)[:3]) for i, u in rows)
    for r in out:
        if r.rule is not None:
            assert r.verdict == next(v for h, p, v in urls.RULES if h + p == r.rule)
    spam = [r.verdict for r in out if r.rule is None and ".spam." in r.host]
    clean = [r.verdict for r in out if r.rule is None and ".x." in r.host]
    assert set(spam) == {"block"} and set(clean) == {"allow"}
    assert {r.verdict for r in urls.judged_urls(df, lab.limit(0)).where("rule is null").collect()} == {"allow"}
    assert urls.judged_urls(df.limit(0), lab).count() == 0


def test_mined_rules_equal_counting(spark):
    rng = random.Random(13)
    rows = [([t for t in "abcdef" if rng.random() < 0.5], rng.random() < 0.4) for _ in range(300)]
    found = {(tuple(r.tokens), round(r.confidence, 9)) for r in urls.mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 5, 0.45, 3).collect()}
    from itertools import combinations

    wanted = set()
    for k in (1, 2, 3):
        for c in combinations("abcdef", k):
            hit = [bad for tokens, bad in rows if set(c) <= set(tokens)]
            if len(hit) >= 6 and sum(hit) / len(hit) >= 0.45:
                wanted.add((c, round(sum(hit) / len(hit), 9)))
    assert found == wanted and wanted


def test_mined_rules_of_any_length(spark):
    from itertools import combinations

    every = "abcde"
    rows = [(list(every), True)] * 8 + [([t for t in every if t != gone], False) for gone in every for _ in range(9)]
    found = {tuple(r.tokens) for r in urls.mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    wanted = set()
    for c in (c for k in range(1, 6) for c in combinations(every, k)):
        hit = [bad for tokens, bad in rows if set(c) <= set(tokens)]
        if len(hit) >= urls.LEAST_URLS and sum(hit) / len(hit) >= urls.CONFIDENCE:
            wanted.add(c)
    assert found == wanted == {tuple(every)}  # every shorter combination is rather in good urls


def test_long_paths_shared_by_bad_urls(spark):
    deep = "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, f"http://deep.org/{deep}/{'abcdefgh'[i]}x") for i in range(8)] + [(10 + i, f"http://deep.org/{'abcdefgh'[i]}y") for i in range(8)]
    rows += [(30, "http://other.org/sca"), (31, "http://deep.org/none"), (32, "http://deep.org/saa"), (33, "http://other.org/" + "q" * 1_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    lab = spark.createDataFrame([(i, 0 if i < 10 else 1, 0) for i, _ in rows if i < 30], "doc_id long, quality int, toxic int")
    assert {r.page_id for r in urls.judged_urls(df, lab).where("verdict = 'block'").collect()} == {*range(8), 30, 32}


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_verdicts_equal_all_combinations(spark, seed):
    from itertools import combinations

    rng = random.Random(seed)
    paths = [[t for t in "abcdef" if rng.random() < 0.45] for _ in range(400)]
    paths = [p + ["twin", "tear"] * ("b" in p) + ["solo"] * (rng.random() < 0.1) for p in paths]
    paths += [[t for t in ("twin", "tear", "b", "a", "c", "solo") if rng.random() < 0.4] for _ in range(60)]
    bad = {i: rng.random() < (0.8 if {"a", "b"} <= set(p) else 0.35) for i, p in enumerate(paths) if i < 400}
    df = spark.createDataFrame([(i, "http://h.org/" + "/".join(p)) for i, p in enumerate(paths)], "page_id long, url string")
    lab = spark.createDataFrame([(i, int(not b), 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    sets = [frozenset(p) | {"host"} for p in paths]
    rules = []
    for c in (set(c) for k in range(1, 11) for c in combinations(sorted(set().union(*sets)), k)):
        hit = [b for i, b in bad.items() if c <= sets[i]]
        if len(hit) >= urls.LEAST_URLS and sum(hit) / len(hit) >= urls.CONFIDENCE:
            rules.append(c)
    wanted = {i for i, s in enumerate(sets) if any(c <= s for c in rules)}
    found = {r.page_id for r in urls.judged_urls(df, lab).where("verdict = 'block'").collect()}
    assert found == wanted and 0 < len(wanted) < len(paths)


# -- pipeline and queries ------------------------------------------------------


@needs_tables
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF).cache()
        assert out.columns == docs.columns and 0 < out.count()
        if name != "mix sources":
            assert out.count() <= seen.count()
            assert out.select("doc_id").subtract(seen.select("doc_id")).isEmpty()
        seen = out
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == seen.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    found, wanted = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    cols = sorted(found.columns)
    assert cols == sorted(wanted.columns)
    cell = lambda v: None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v
    rows = lambda df: sorted((tuple(cell(x) for x in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)
    assert rows(found) == rows(wanted)
