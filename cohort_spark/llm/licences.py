"""Licence scans: notices against templates by TF-IDF cosine, then inheritance along paths.

Only DataFrame functions: everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.llm.common import Own, checked_broadcast, saved

# Licence identifiers and the wording of their usual notices.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License. Redistribution and use in source and binary forms are permitted."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License. Redistribution and use in source and binary forms are permitted."),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
)
# The grants and conditions that licence texts and standard file headers consist of.
GPL_HEADER = "This program is free software; you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see https://www.gnu.org/licenses/."
GPL_FAMILY = (
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007"),
    ("GPL-2.0", "GNU General Public License", "2", "June 1991"),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007"),
)
MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_DISCLAIMER = "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software."
BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_DISCLAIMER = "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
TEXTS = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{BSD_GRANT} {BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{BSD_GRANT} {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("MIT", MIT_GRANT),
    ("MIT", f"{MIT_GRANT} {MIT_DISCLAIMER}"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
FAMILY = tuple(
    (licence, text)
    for licence, name, version, date in GPL_FAMILY
    for text in (f"{name} Version {version}, {date}", GPL_HEADER.format(name=name, version=version), f"{GPL_HEADER} {GPL_REST}".format(name=name, version=version))
)


def tag(identifier: str) -> str:
    """The one word that stands for an SPDX identifier."""
    return "spdx" + "".join(c for c in identifier.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


#: An identifier may be followed by these where the licence is of the GNU family.
SUFFIXES = ("", "-only", "-or-later")
TAGS = tuple((x, tag(x + more)) for x in sorted({k for k, _ in TEMPLATES + FAMILY}) for more in (SUFFIXES if "GPL" in x else SUFFIXES[:1]))
EVERY = TEMPLATES + TEXTS + FAMILY + TAGS
#: Templates are broadcast; more than these would need a shuffled join.
MOST_TEMPLATES = 1000
#: Lines that say an SPDX identifier, and what follows it.
SPDX = r"(?i)spdx-license-identifier:[ \t]*([^\n*]*)"
#: Starts of comment lines.
COMMENT = r"^[ \t]*(//+|#+|/?[*]+/?|--+|;+|<!--)"
#: Stands between comment blocks while they are cut apart.
GAP = "\x01"
#: Lines that may be notices.
NOTICE = r"(?i)licen[cs]e|copyright|public domain|redistribution|permission is hereby"
#: Names of files whose whole text is a licence.
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)([.-][^/]*)?$"
WORD = "[a-z0-9]+(?:[.][0-9]+)*"
#: Least cosine of a match.
SIMILAR = 0.8


def _words(text: str) -> F.Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def notice_units(text: str, is_file: F.Column) -> F.Column:
    """The distinct units of a text that may name a licence.

    Lines that ``NOTICE`` finds; blocks of two comment lines or more, without
    their markers, and the paragraphs of these, where ``NOTICE`` finds them; of
    a licence file its whole text and its paragraphs likewise. A line with an
    SPDX identifier gives its ``tag`` alone, an SPDX expression one tag a word,
    so that a choice of licences is like none of them.
    """
    lines = F.split(text, "\n")
    says = lambda x: x.rlike(NOTICE)
    trimmed = lambda x: F.btrim(x, F.lit(" \n\t\r"))
    named = lambda x: F.filter(F.split(F.regexp_replace(F.lower(F.regexp_extract(x, SPDX, 1)), "[^a-z0-9 ]", ""), " "), lambda w: w != "")
    tagged = lambda x: F.array_join(F.transform(named(x), lambda w: F.concat(F.lit("spdx"), w)), " ")
    single = F.transform(F.filter(lines, says), lambda x: F.when(x.rlike(SPDX), tagged(x)).otherwise(F.trim(x)))
    bare = F.transform(lines, lambda x: F.when(x.rlike(COMMENT), F.trim(F.regexp_replace(x, COMMENT, ""))).otherwise(GAP))
    blocks = F.filter(F.transform(F.split(F.array_join(bare, "\n"), GAP), trimmed), lambda b: b.contains("\n") & says(b))
    blocks = F.concat(blocks, F.flatten(F.transform(blocks, lambda b: F.filter(F.split(b, "\n\n+"), says))))
    whole = F.concat(F.array(trimmed(F.col(text))), F.filter(F.transform(F.split(text, "\n[ \t\r]*\n"), trimmed), says))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(single, blocks, F.when(is_file & F.col(text).isNotNull(), whole).otherwise(none)))


def matched(units: DataFrame, templates=TEMPLATES, least: float = SIMILAR) -> DataFrame:
    """(unit, licence, score): the best template of each distinct unit of text with a cosine of at least ``least``.

    A licence may have several templates.

    ``units`` is (unit, n), distinct, n its occurrences. A word's weight in a
    unit is its count times ln((N + 1) / (df + 1)) + 1 over all N occurrences.
    Cosines are rounded to 6 digits; ties go to the first licence by name.
    """
    keyed = units.withColumn("key", F.sha2("unit", 256))
    return matched_keys(keyed, templates, least).join(keyed.select("key", "unit"), "key").select("unit", "licence", "score")


def matched_keys(units: DataFrame, templates=TEMPLATES, least: float = SIMILAR) -> DataFrame:
    """``matched`` for (key, unit, n), as (key, licence, score): words go with their unit's key, never with its text."""
    spark = units.sparkSession
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    total = units.agg(F.sum("n")).first()[0] or 0
    counts = units.select("key", "n", F.explode(_words("unit")).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("tf"), F.first("n").alias("n"))
    df = counts.groupBy("word").agg(F.sum("n").alias("df"))
    idf = F.log((F.lit(total) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    known = spark.createDataFrame([(i, *x) for i, x in enumerate(templates)], "t int, licence string, unit string")
    given = known.select("t", "licence", F.explode(_words("unit")).alias("word")).groupBy("t", "licence", "word").agg(F.count(F.lit(1)).alias("tf"))
    given = given.join(df, "word", "left").select("t", "licence", "word", (F.col("tf") * idf).alias("w"))
    given = given.join(given.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "t").select("t", "licence", "word", (F.col("w") / F.col("norm")).alias("of"))
    own = counts.join(df, "word").select("key", "word", (F.col("tf") * idf).alias("w"))
    norms = own.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = own.join(F.broadcast(given), "word").groupBy("key", "t", "licence").agg(F.sum(F.col("w") * F.col("of")).alias("dot"))
    cosines = dots.join(norms, "key").select("key", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best")
    return cosines.where(F.col("score") >= least).groupBy("key").agg(best).select("key", "best.licence", (-F.col("best.minus")).alias("score"))


def directory_of(path: str) -> F.Column:
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(F.col(path).isNotNull(), ""))


def licensed_files(files: DataFrame, path_col: str = "path", text_col: str = "text", templates=EVERY, least: float = SIMILAR) -> DataFrame:
    """All rows and columns of ``files`` with the struct ``_licence``: name, origin, score, directory.

    A file's notices are its ``notice_units``: lines, comment blocks, SPDX tags,
    and a licence file's text. The best match of any gives the file's own
    licence (origin ``notice``); ties go to the first licence by name. Other files inherit (origin ``directory``) from their
    nearest ancestor directory that declares one: by licence files directly in
    it, else by its files' notices, if they agree on one licence.

    Null or empty texts have no notices; a null path has no directory. Files
    with none get nulls. Equal paths are judged row by row; repeated rows repeat.
    """
    own_names = Own(files)
    rows = own_names.frame.withColumn("_path", F.col(own_names[path_col])).withColumn("_text", F.col(own_names[text_col]))
    is_file = F.coalesce(F.col("_path").rlike(LICENCE_FILE), F.lit(False))
    noticed = rows.where(F.col("_text").rlike(NOTICE) | is_file).select("_path", F.sha2("_text", 256).alias("_sha"), is_file.alias("_is_file"), notice_units("_text", is_file).alias("_units"))
    noticed = noticed.withColumn("unit", F.explode("_units")).drop("_units").withColumn("key", F.sha2("unit", 256))
    noticed = saved(noticed, "notices")
    found = matched_keys(saved(noticed.groupBy("key").agg(F.any_value("unit").alias("unit"), F.count(F.lit(1)).alias("n")), "units"), templates, least)
    best = F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best")
    own = noticed.select("_path", "_sha", "_is_file", "key").join(checked_broadcast(saved(found, "matches"), 100_000), "key").groupBy("_path", "_sha").agg(best, F.first("_is_file").alias("_is_file"))
    own = saved(own.select("_path", "_sha", "_is_file", F.col("best.licence").alias("_own"), (-F.col("best.minus")).alias("_score")), "own")
    by = own.where("_path is not null").groupBy(directory_of("_path").alias("dir"), "_is_file").agg(F.min("_own").alias("low"), F.max("_own").alias("high"))
    declared = by.groupBy("dir").agg(F.max(F.struct(F.col("_is_file").alias("f"), "low", "high")).alias("d")).where("d.low = d.high").select("dir", F.col("d.low").alias("declared"))
    parts = F.split("_dir", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    climbed = rows.select(directory_of("_path").alias("_dir")).where("_dir is not null").distinct().withColumn("dir", F.explode(F.array_distinct(ancestors)))
    nearest = climbed.join(checked_broadcast(saved(declared, "declared")), "dir").groupBy("_dir").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "declared")).alias("n"))
    nearest = nearest.select("_dir", F.col("n.dir").alias("_from"), F.col("n.declared").alias("_declared"))
    own = own.select(F.col("_path").alias("_p"), F.col("_sha").alias("_s"), "_own", "_score")
    out = rows.withColumn("_dir", directory_of("_path")).withColumn("_sha", F.sha2("_text", 256))
    out = out.join(checked_broadcast(own), F.col("_path").eqNullSafe(F.col("_p")) & (F.col("_sha") == F.col("_s")), "left").join(checked_broadcast(saved(nearest, "nearest")), "_dir", "left")
    mine = F.col("_own").isNotNull()
    origin = F.when(mine, "notice").when(F.col("_declared").isNotNull(), "directory")
    licence = F.struct(F.coalesce("_own", "_declared").alias("name"), origin.alias("origin"), F.col("_score").alias("score"), F.when(~mine, F.col("_from")).alias("directory"))
    return own_names.restored(out, {"_licence": licence})


def op1_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory a source, below it one a digit of doc_id div 10."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    path = F.concat("source", F.regexp_replace(F.expr("doc_id div 10").cast("string"), "(.)", "/$1"), F.lit("/"), F.expr("doc_id % 10").cast("string"), F.lit(".txt"))
    return licensed_files(docs.withColumn("path", path)).select("doc_id", "path", F.col("_licence.name").alias("licence"), "_licence.origin", "_licence.score", "_licence.directory")


OP1_SQL = f"""
WITH f AS (
  SELECT doc_id, text, source || regexp_replace(CAST(doc_id // 10 AS VARCHAR), '(.)', '/\\1', 'g') || '/' || (doc_id % 10) || '.txt' AS path
  FROM documents),
g AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM f),
lines AS (SELECT doc_id, path, dir, string_split(text, chr(10)) AS ls FROM g WHERE regexp_matches(text, '{NOTICE}')),
blocks AS (
  SELECT doc_id, path, dir, trim(block, E' \\n\\t\\r') AS block FROM (
    SELECT doc_id, path, dir, unnest(string_split(array_to_string(list_transform(ls, lambda l:
      CASE WHEN regexp_matches(l, '{COMMENT}') THEN trim(regexp_replace(l, '{COMMENT}', ''), ' ') ELSE chr(1) END), chr(10)), chr(1))) AS block FROM lines)
  WHERE contains(trim(block, E' \\n\\t\\r'), chr(10))),
noticed AS (
  SELECT DISTINCT doc_id, path, dir, CASE WHEN regexp_matches(line, '{SPDX}') THEN array_to_string(list_transform(list_filter(
      string_split(regexp_replace(lower(regexp_extract(line, '{SPDX}', 1)), '[^a-z0-9 ]', '', 'g'), ' '), lambda w: w <> ''), lambda w: 'spdx' || w), ' ')
    ELSE trim(line, ' ') END AS unit
  FROM (SELECT doc_id, path, dir, unnest(ls) AS line FROM lines) WHERE regexp_matches(line, '{NOTICE}')
  UNION SELECT doc_id, path, dir, block FROM blocks WHERE regexp_matches(block, '{NOTICE}')
  UNION SELECT doc_id, path, dir, part FROM (SELECT doc_id, path, dir, unnest(regexp_split_to_array(block, '\\n\\n+')) AS part FROM blocks) WHERE regexp_matches(part, '{NOTICE}')),
units AS (SELECT unit, count(*) AS n FROM noticed GROUP BY unit),
total AS (SELECT coalesce(sum(n), 0) AS total FROM units),
counts AS (
  SELECT unit, n, word, count(*) AS tf
  FROM (SELECT unit, n, unnest(regexp_extract_all(lower(unit), '{WORD}')) AS word FROM units) GROUP BY ALL),
df AS (SELECT word, sum(n) AS df FROM counts GROUP BY word),
templates(t, licence, text) AS (VALUES {", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(EVERY))}),
tw AS (
  SELECT t, licence, word, count(*) AS tf
  FROM (SELECT t, licence, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM templates) GROUP BY ALL),
tv AS (SELECT t, licence, tw.word, tf * (ln((total + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM tw LEFT JOIN df USING (word), total),
tn AS (SELECT t, sqrt(sum(w * w)) AS norm FROM tv GROUP BY t),
uv AS (SELECT unit, counts.word, tf * (ln((total + 1) / (df + 1)) + 1) AS w FROM counts JOIN df USING (word), total),
un AS (SELECT unit, sqrt(sum(w * w)) AS norm FROM uv GROUP BY unit),
cosines AS (
  SELECT unit, licence, round(sum(uv.w * tv.w / tn.norm) / any_value(un.norm), 6) AS score
  FROM uv JOIN tv USING (word) JOIN tn USING (t) JOIN un USING (unit) GROUP BY unit, t, licence),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, licence) AS k FROM cosines WHERE score >= {SIMILAR}) WHERE k = 1),
own AS (
  SELECT doc_id, dir, licence, score FROM (
    SELECT doc_id, dir, licence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS k FROM noticed JOIN best USING (unit)) WHERE k = 1),
declared AS (SELECT dir AS anc, min(licence) AS declared FROM own GROUP BY dir HAVING min(licence) = max(licence)),
climbed AS (
  SELECT dir, array_to_string(list_slice(p, 1, i), '/') AS anc
  FROM (SELECT dir, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT DISTINCT dir, string_split(dir, '/') AS p FROM g))),
nearest AS (SELECT dir, anc, declared FROM (
  SELECT dir, anc, declared, row_number() OVER (PARTITION BY dir ORDER BY length(anc) DESC) AS k FROM climbed JOIN declared USING (anc)) WHERE k = 1)
SELECT g.doc_id, path, coalesce(own.licence, declared) AS licence,
       CASE WHEN own.licence IS NOT NULL THEN 'notice' WHEN declared IS NOT NULL THEN 'directory' END AS origin,
       score, CASE WHEN own.licence IS NULL THEN anc END AS directory
FROM g LEFT JOIN own ON g.doc_id = own.doc_id LEFT JOIN nearest ON g.dir = nearest.dir
"""
