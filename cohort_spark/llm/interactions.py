"""Filter interaction audit: what each filter removes in every order, counted in wide packed integers."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.llm.common import saved

#: Bits of a field: no table has 2**64 rows of a part, so no field runs over into the next one.
FIELD_BITS = 64
#: What is counted for each (order, step): a field each, in this order.
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: Groups into which the packed sums of a part's tasks are dealt before they meet.
MERGE_GROUPS = 64
FILTERS = "ABCDE"


def with_failures(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with booleans A to D for the failure conditions of a text, which must not be null; the text goes.

    A: under 100 words. B: distinct words under 80 %. C: capitals A-Z over 10 %
    of code points. D: holds any of ``#$%&*|``.
    """
    t, n, different = F.col(text), F.col("_words"), F.col("_distinct")
    words = F.filter(F.split(t, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    sized = rows.withColumn("_list", words).withColumn("_words", F.size("_list")).withColumn("_distinct", F.size(F.array_distinct("_list")))
    capitals = F.length(t) - F.length(F.translate(t, string.ascii_uppercase, ""))
    named = {"A": n < 100, "B": 100 * different < 80 * n, "C": 100 * capitals > 10 * F.length(t), "D": t.rlike("[#$%&*|]")}
    return sized.withColumns(named).drop("_list", "_words", "_distinct", text)


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic, n): rows by what fails and how they are labelled.

    Bits 0 to 3 of ``mask`` are A to D, bit 4 is E: the text is that of a row
    with a smaller id, anywhere in the table. Rows of a null id neither fail E
    nor let others fail; rows that share the smallest id all pass E. Labels of
    several rows of an id are united: good if any has quality 1.

    A text's rows are first counted where they are read, by (part, labels); one
    row a text and such a group remains when texts meet, however many copies.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mask = sum((F.col(c).cast("int") * (1 << i) for i, c in enumerate(FILTERS[:-1])), F.lit(0))
    rows = with_failures(texts.withColumn("digest", F.sha2("text", 256))).select("id", "part", "digest", mask.alias("mask"))
    marks = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("_id is not null and (good or toxic)")
    judged = rows.join(marks, F.col("id") == F.col("_id"), "left").drop("_id").fillna(False, ["good", "toxic"])
    by_id = judged.groupBy("digest", "part", "mask", "good", "toxic", "id").agg(F.count(F.lit(1)).alias("n"))
    by_text = by_id.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("at_least"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id")
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    passed = F.col("without_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    halves = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passed").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))))
    each = by_text.withColumn("first", first).withColumn("passed", passed).select("part", "good", "toxic", halves.alias("h")).select("part", "good", "toxic", "h.*")
    return each.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def outcomes(filters: str = FILTERS) -> list[tuple[str, int]]:
    """(order, step) of every field group, orders sorted."""
    return [("".join(order), step) for order in permutations(sorted(filters)) for step in range(1, len(filters) + 1)]


def packed_outcome(mask: int, good: bool, toxic: bool, filters: str = FILTERS) -> int:
    """One big integer with a field for each count of each (order, step): 1 where a row of this mask counts, else 0."""
    out, at = 0, 0
    for order in permutations(sorted(filters)):
        removed = False
        for letter in order:
            fails = bool(mask >> filters.index(letter) & 1)
            here = fails and not removed
            for counts in (not removed and not fails, here, fails and removed, here and good, here and toxic):
                out |= int(counts) << at
                at += FIELD_BITS
            removed = removed or fails
    return out


def fields(total: int, n: int) -> list[int]:
    """The first ``n`` fields of a packed sum."""
    raw = total.to_bytes(n * FIELD_BITS // 8, "little")
    return [int.from_bytes(raw[i : i + FIELD_BITS // 8], "little") for i in range(0, len(raw), FIELD_BITS // 8)]


def packed_sums(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, packed): the sum over a part's rows of the integers of their masks, as little-endian bytes.

    Each task sums the integers of its rows, a row that stands for n counting n
    times; the sums of tasks meet in ``MERGE_GROUPS`` groups a part, then a
    part's groups. A sum has as many bytes as fields, however many rows.
    """
    size = math.factorial(len(filters)) * len(filters) * len(COUNTS) * FIELD_BITS // 8

    def batch(sums: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.to_bytes(size, "little") for v in sums.values()], pa.binary())], ["part", "packed"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        sums: dict[str, int] = {}
        for b in batches:
            for part, mask, good, toxic, n in zip(*[b.column(c).to_pylist() for c in ("part", "mask", "good", "toxic", "n")], strict=True):
                kind = mask, good, toxic
                if kind not in known:
                    known[kind] = packed_outcome(mask, good, toxic, filters)
                sums[part] = sums.get(part, 0) + n * known[kind]
                if len(sums) >= 1000:
                    yield batch(sums)
                    sums = {}
        if sums:
            yield batch(sums)

    def merged(keys, group):
        total = sum(int.from_bytes(x, "little") for x in group.column("packed").to_pylist())
        return pa.Table.from_batches([batch({keys[0].as_py(): total})])

    schema = "part string, packed binary"
    tasks = counts.mapInArrow(summed, schema).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    return tasks.groupBy("part", "group").applyInArrow(merged, schema).groupBy("part").applyInArrow(merged, schema)


def interaction_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each of the filters A to E does at each step of each order, by part.

    One row for each part, filter_order (all permutations of ABCDE, applied left
    to right) and step: rows kept after the step and removed at it; redundant,
    which fail its filter but were removed before; unique_fails, which fail its
    filter only; good_lost and toxic_lost, removed here and labelled so; shapley,
    removed by the filter summed over all orders.

    A null part is the empty string; parts are compared as text. Null and empty
    texts fail A and are copies of each other. Repeated rows count once each; no
    rows, no result. Other columns are not read.
    """
    sums = packed_sums(saved(mask_counts(docs, labels, id_col, text_col, part_col), "masks"))
    steps = outcomes()
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, packed in zip(b["part"], b["packed"], strict=True):
                raw = fields(int.from_bytes(packed, "little"), len(steps) * len(COUNTS))
                rows = [dict(zip(COUNTS, raw[i : i + len(COUNTS)], strict=True)) for i in range(0, len(raw), len(COUNTS))]
                removed: dict[str, int] = {}
                last: dict[str, int] = {}
                for (order, step), r in zip(steps, rows, strict=True):
                    letter = order[step - 1]
                    removed[letter] = removed.get(letter, 0) + r["removed"]
                    if step == len(order):  # what the last filter removes fails no other
                        last[letter] = r["removed"]
                out = [(part, order, step, r["kept"], r["removed"], r["redundant"], last[order[step - 1]], r["good_lost"], r["toxic_lost"], removed[order[step - 1]]) for (order, step), r in zip(steps, rows, strict=True)]
                yield pd.DataFrame(out, columns=names)

    kinds = {"part": "string", "filter_order": "string", "step": "int"}
    return sums.mapInPandas(unpacked, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    return interaction_audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = """
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
         len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
         100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         w.doc_id > min(w.doc_id) OVER (PARTITION BY t) AS e
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
k AS (
  SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, coalesce(e, false)][i]) AS fails, count(*) AS n
  FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, string_split(substr(filter_order, 1, step - 1), '') AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (
  SELECT part, filter_order, step, letter,
         sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
         sum(n) FILTER (fails = [letter]) AS unique_fails, sum(n) FILTER (hit AND NOT gone AND good) AS good_lost, sum(n) FILTER (hit AND NOT gone AND toxic) AS toxic_lost
  FROM (SELECT k.*, s.*, list_contains(fails, letter) AS hit, list_has_any(fails, earlier) AS gone FROM k, s) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, letter), 0) AS BIGINT) AS shapley
FROM g
"""
