"""Phrase collocations by relational mining: sorted occurrence relations merge-joined at adjacent positions."""

from __future__ import annotations

import string
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohort_spark.llm.common import CLEANUP, at_most, discard, fresh_path, saved, text_batches, word_slices

LONGEST, LEAST, TOP, COVERED = 3, 10, 2000, 50
#: Occurrences of a bucket, about, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 50_000
#: Frequent groups up to which they are broadcast to their occurrences: three numbers each.
BROADCAST_GROUPS = 1_000_000
#: Counted words and emitted rows of a task at once; groups into which a language's candidates are dealt.
WORDS_AT_ONCE, ROWS_AT_ONCE, RANK_GROUPS = 500_000, 200_000, 16
#: A-Z small; ends of pieces a full stop; tabs spaces.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
PIECE_BYTES = bytes(b + 32 if 65 <= b <= 90 else 46 if b in PIECE_ENDS else 32 if b == 9 else b for b in range(256))

#: Spark joins tables in buckets of some of the join's keys where they lie, where this is off.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def marked_words(text: bytes | None) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09]+`` of a text's pieces in lists, a full stop where a piece ends; A-Z lower-cased."""
    return word_slices(text.translate(PIECE_BYTES).replace(b".", b" . ")) if text else iter(())


def word_keys(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """A 64-bit number of each word of a language."""
    named = [lang.encode() + b" " + w for w in words]
    return pd.util.hash_array(np.array(named, object), hash_key=f"phrase words {seed:03d}", categorize=False).view(np.int64)


def word_counts(rows: DataFrame, seed: int) -> DataFrame:
    """(lang, word, key, n): occurrences of each word of (doc, lang, text), counted in tasks first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, words in found.items():
                words.pop(b".", None)
                keys = pa.array(word_keys(lang, list(words), seed))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()), keys, pa.array(list(words.values()), pa.int64())], ["lang", "word", "key", "n"])
            found.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for words in marked_words(text):
                    found.setdefault(lang, Counter()).update(words)
                    if sum(map(len, found.values())) > WORDS_AT_ONCE:
                        yield from flushed()
        yield from flushed()

    each = rows.select("lang", "text").mapInArrow(counted, "lang string, word binary, key long, n long")
    return each.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def keyed_counts(rows: DataFrame) -> tuple[DataFrame, int]:
    """(counts, seed): ``word_counts``, written, with the first seed that gives no two words one key."""
    seed = 0
    while True:
        counted = saved(word_counts(rows, seed), "word-counts")
        if counted.groupBy("key").agg(F.count(F.lit(1)).alias("words")).where("words > 1").isEmpty():
            return counted, seed
        discard(counted)
        seed += 1


def word_occurrences(rows: DataFrame, seed: int) -> DataFrame:
    """(doc, at, key): each word's key at its place in its text; between pieces a place stays free."""

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list, list, list]] = {}  # of each language: texts, their first places, their words, all words

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (docs, firsts, sizes, words) in held.items():
                coded = pa.array(words, pa.binary()).dictionary_encode()
                codes = coded.indices.to_numpy()
                distinct = coded.dictionary.to_pylist()
                kept = np.flatnonzero(codes != distinct.index(b".")) if b"." in distinct else np.arange(len(codes))
                at = np.arange(len(codes)) + np.repeat(np.array(firsts) - np.cumsum(sizes) + np.array(sizes), sizes)
                columns = [np.repeat(docs, sizes)[kept], at[kept].astype(np.int32), word_keys(lang, distinct, seed)[codes[kept]]]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["doc", "at", "key"])
            held.clear()

        size = 0
        for batch in batches:
            for doc, lang, text in zip(batch.column("doc").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                first = 0
                for part in marked_words(text):
                    if part:
                        own = held.setdefault(lang, ([], [], [], []))
                        for values, value in zip(own, (doc, first, len(part)), strict=False):
                            values.append(value)
                        own[3].extend(part)
                        first, size = first + len(part), size + len(part)
                    if size > ROWS_AT_ONCE:
                        yield from flushed()
                        size = 0
        yield from flushed()

    return rows.mapInArrow(occurring, "doc long, at int, key long")


@contextmanager
def joined_in_buckets(spark: SparkSession):
    """While this holds, a join on (doc, at) takes tables in buckets of doc as they lie."""
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        yield
    finally:
        spark.conf.set(CO_PARTITION, before)


def sorted_relation(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` (doc, at, code) written to the shared folder in buckets of doc, sorted by (doc, at)."""
    spark, name = df.sparkSession, f"occurrences_{uuid.uuid4().hex}"
    path, before = fresh_path(spark, "occurrences"), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.bucketBy(buckets, "doc").sortBy("doc", "at").option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.table(name)
    out.scratch_path, out.scratch_table = path, name
    return out


def adjacent(relation: DataFrame) -> DataFrame:
    """(doc, at, head, tail): occurrences with that at the next place, by a merge join of the sorted relation with itself.

    Of groups of k words the two overlap in k - 1 words, so they make one of k + 1.
    """
    right = relation.select(F.col("doc").alias("_doc"), (F.col("at") - 1).alias("_at"), F.col("code").alias("tail"))
    return relation.join(right.hint("merge"), (F.col("doc") == F.col("_doc")) & (F.col("at") == F.col("_at"))).select("doc", "at", F.col("code").alias("head"), "tail")


def kept_occurrences(occurrences: DataFrame, groups: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The occurrences of frequent groups, by the group's code, as a sorted relation.

    Groups are broadcast if they are counted few; beyond, both sides are
    shuffled, hot groups split by adaptive execution, and occurrences dealt back
    to the buckets of their texts.
    """
    few = at_most(groups, BROADCAST_GROUPS)
    found = occurrences.join(F.broadcast(groups) if few else groups, keys).select("doc", "at", "code")
    return sorted_relation(found if few else found.repartition(buckets, "doc"), buckets)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """(levels, totals): frequent phrases of 1 to ``longest`` words, and (lang, words) with all word occurrences.

    A level has (code, lang, phrase, a, head, tail, lefts, rights): phrase is a
    list of words; a its occurrences in its language; head and tail the codes of
    its first and last k - 1 words; lefts and rights the occurrences of its
    first, and of its last, 1 to k - 1 words.

    Each round merge-joins the sorted relation of frequent groups of k words
    with itself at adjacent places, counts the groups of k + 1, and keeps the
    occurrences of frequent ones as the next relation. A group's two parts are
    frequent where it is, so nothing is lost.
    """
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counted, seed = keyed_counts(rows)
    totals = saved(counted.groupBy("lang").agg(F.sum("n").alias("words")), "totals")
    number, none = F.monotonically_increasing_id().alias("code"), F.array().cast("array<long>")
    frequent = counted.where(F.col("n") >= least).select(number, "lang", "word", "key", F.col("n").alias("a"))
    words = saved(frequent, "frequent-words")
    levels = [words.select("code", "lang", F.array(F.col("word").cast("string")).alias("phrase"), "a", none.alias("lefts"), none.alias("rights"))]
    buckets = min(MOST_BUCKETS, 1 + (words.agg(F.sum("a")).first()[0] or 0) // BUCKET_ROWS)
    spread = rows.where("text is not null").repartition(buckets, "doc")
    relation = kept_occurrences(word_occurrences(spread, seed), words.select("key", "code"), ["key"], buckets)
    discard(counted)
    for k in range(2, longest + 1):
        with joined_in_buckets(spark):
            counts = adjacent(relation).groupBy("head", "tail").agg(F.count(F.lit(1)).alias("a")).where(F.col("a") >= least)
            groups = saved(counts.select(number, "head", "tail", "a"), f"groups-{k}")
            if k < longest:
                longer = kept_occurrences(adjacent(relation), groups.select("head", "tail", "code"), ["head", "tail"], buckets)
        levels.append(saved(grown(groups, levels[-1]), f"frequent-{k}"))
        discard(groups)
        dropped(relation)
        if k < longest:
            relation = longer
    return levels, totals


def grown(groups: DataFrame, level: DataFrame) -> DataFrame:
    """The level of ``groups`` (code, head, tail, a), which are of one word more than those of ``level``."""
    head = level.select(F.col("code").alias("head"), "lang", F.col("phrase").alias("_first"), F.col("a").alias("_left"), "lefts")
    tail = level.select(F.col("code").alias("tail"), F.element_at("phrase", -1).alias("_last"), F.col("a").alias("_right"), "rights")
    longer = {"phrase": F.concat("_first", F.array("_last")), "lefts": F.concat("lefts", F.array("_left")), "rights": F.concat("rights", F.array("_right"))}
    return groups.join(head, "head").join(tail, "tail").select("code", "lang", longer["phrase"].alias("phrase"), "a", "head", "tail", longer["lefts"].alias("lefts"), longer["rights"].alias("rights"))


def dropped(relation: DataFrame) -> None:
    """Forget and delete a sorted relation."""
    relation.sparkSession.sql(f"DROP TABLE IF EXISTS {relation.scratch_table}")
    discard(relation)


def weakest_cut(k: int) -> F.Column:
    """(score, cut, l, r) of the cut of a k-word phrase with the lowest score, of those with one score the first."""
    exact = lambda c: c.cast("decimal(19,0)")

    def cut(j: int) -> F.Column:
        left, right, a = F.element_at("lefts", j), F.element_at("rights", k - j), exact(F.col("a"))
        score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), exact(left) * exact(right))
        return F.struct(score.alias("score"), F.lit(j).alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.array(*[cut(j) for j in range(1, k)]))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to ``longest`` words.

    Texts are lower-cased in A-Z, split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
    these into words ``[^\\x20\\x09]+``. A phrase's occurrences a, overlaps
    included, must be at least ``least``. Cut into two parts that occur l and r
    times it scores floor(1000000 a a / (l r)), exactly; its lowest cut counts,
    ties to the first. Phrases inside a longer one with at least ``covered`` per
    cent of their occurrences are dropped. n is the language's words. Of equal
    scores the phrase with more occurrences comes first, then by bytes.

    A null language is ``und``; null and empty texts have no words; repeated
    rows count each; no rows, no phrases. Other columns are not read.
    """
    levels, totals = frequent_phrases(docs, lang_col, text_col, longest, least)
    found = None
    for k, level in enumerate(levels[1:], 2):
        kept = level
        if k < longest:
            longer = levels[k].select(F.explode(F.array("head", "tail")).alias("code"), F.col("a").alias("_a")).groupBy("code").agg(F.max("_a").alias("_most"))
            kept = level.join(longer, "code", "left").where(F.col("_most").isNull() | (100 * F.col("_most") < covered * F.col("a")))
        each = kept.select("lang", F.array_join("phrase", " ").alias("phrase"), "a", weakest_cut(k).alias("c"))
        found = each if found is None else found.union(each)
    order = [F.desc("c.score"), F.desc("a"), F.col("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    best = found.withColumn("_group", group).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))).where(F.col("_rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", F.col("words").alias("n"), "c.score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
WITH p AS (
  SELECT lang, row, unnest(range(len(ps))) AS piece, unnest(ps) AS t FROM (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row,
           string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
w AS (SELECT lang, row, piece, unnest(range(len(ws))) AS i, unnest(ws) AS x FROM (SELECT lang, row, piece, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p)),
o AS (SELECT lang, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM w WINDOW s AS (PARTITION BY row, piece ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
f1 AS (SELECT lang, x, count(*) AS a FROM o GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS a FROM o WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, x, y, z, count(*) AS a FROM o WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.a, [{{'l': u.a, 'r': v.a}}] AS cuts,
         NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND (f3.x = f2.x AND f3.y = f2.y OR f3.y = f2.x AND f3.z = f2.y) AND 100 * f3.a >= {COVERED} * f2.a) AS kept
  FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = f2.x JOIN f1 v ON v.lang = f2.lang AND v.x = f2.y
  UNION ALL
  SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.a, [{{'l': u.a, 'r': yz.a}}, {{'l': xy.a, 'r': v.a}}], true
  FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.x = f3.x JOIN f1 v ON v.lang = f3.lang AND v.x = f3.z
  JOIN f2 xy ON xy.lang = f3.lang AND xy.x = f3.x AND xy.y = f3.y JOIN f2 yz ON yz.lang = f3.lang AND yz.x = f3.y AND yz.y = f3.z),
s AS (
  SELECT lang, phrase, a, list_min(list_transform(cuts, lambda c, i: {{'score': CAST((1000000::HUGEINT * a * a) // (c.l::HUGEINT * c.r) AS BIGINT), 'k': i, 'l': c.l, 'r': c.r}})) AS c FROM c WHERE kept),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c.score DESC, a DESC, phrase) AS rank FROM s)
SELECT lang, rank, phrase, a, c.l AS l, c.r AS r, n, c.score AS score FROM r JOIN n USING (lang) WHERE rank <= {TOP}
"""
