"""Ranking, de-duplication, sampling and caps."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.operators.aggregates import bucketed


def occurrence(keys: Sequence[str], order: Sequence) -> Column:
    """Running index from 0 within the keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1


#: Rows of a group that one window task numbers, about, and the most parts of a group.
ROWS_A_PART, MOST_PARTS = 1_000_000, 1024


def positioned(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int = ROWS_A_PART) -> DataFrame:
    """``df`` with gapless positions from 0 within the keys, in the order given, without one task for a large group.

    Groups of more than ``rows`` rows are cut into ranges of the first order
    column, a number, at sketched quantiles; rows are numbered within their range
    and shifted by the rows of the group's earlier ranges. Rows that share a
    value of that column stay together. Without such groups one window numbers
    all. A null group and null values are numbered, nulls first.
    """
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    by = [F.col(o) for o in order]
    if most <= rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)).cast("long") - 1)
    parts = min(MOST_PARTS, -(-most // rows))
    cuts = F.percentile_approx(F.col(order[0]).cast("double"), [i / parts for i in range(1, parts)], 10 * parts)
    names = [f"_g{i}" for i in range(len(keys))]
    large = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.when(F.count(F.lit(1)) > rows, F.array_distinct(cuts)).alias("_cuts")).where("_cuts is not null")
    same = lambda own, other: functools.reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(own, other, strict=True)], F.lit(True))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(order[0]).cast("double"))), F.lit(0))
    cut = df.join(large, same(keys, names), "left").withColumn("_part", part).drop("_cuts", *names)
    sizes = cut.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*names).orderBy("_p")) - F.col("_n")).drop("_n")
    inner = cut.withColumn("_inner", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*by)) - 1)
    return inner.join(before, same([*keys, "_part"], [*names, "_p"])).withColumn(name, F.col("_before") + F.col("_inner")).drop("_part", "_p", "_before", "_inner", *names)


def value_index(df: DataFrame, keys: Sequence[str], value: str, position: str, name: str = "value_index") -> DataFrame:
    """``df`` with the index of its value among the group's distinct values by first appearance."""
    first = df.groupBy(*keys, value).agg(F.min(position).alias("_p"))
    return df.join(first.withColumn(name, occurrence(keys, ["_p", value])).drop("_p"), [*keys, value])


def kept_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the order given."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def kept_last(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return kept_first(df, keys, [F.desc(position)])


def seeded(seed: int, *cols: str) -> Column:
    """A hash of the seed and the columns' text, to order by."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]), 256)


def sampled(df: DataFrame, keys: Sequence[str], key: str, n: int, seed: int = 7) -> DataFrame:
    """Up to ``n`` rows of each group, chosen by seeded hash."""
    return kept_first(df, keys, [seeded(seed, key), F.col(key)], n)


def sample(df: DataFrame, key: str, n: int, seed: int = 7, explicit: Sequence | None = None) -> DataFrame:
    """``n`` rows by seeded hash, or the explicit keys."""
    return df.where(F.col(key).isin(*explicit)) if explicit else df.orderBy(seeded(seed, key), key).limit(n)


def strided(df: DataFrame, slide: str, k: int, position: str = "row_idx", **named) -> DataFrame:
    """The first row of each spatial bucket, in the original order."""
    rows = bucketed(df, slide, k, position=position, **named)
    return kept_first(rows, [slide, "bucket_x", "bucket_y"], [F.col(position)]).drop("bucket_x", "bucket_y")


def evenly_spaced(df: DataFrame, slide: str, most: int, position: str = "row_idx", rounded: bool = False) -> DataFrame:
    """At most ``most`` rows of each slide, evenly spaced by position from first to last.

    Positions are 0..n-1. The i-th of m is i * ((n - 1) / (m - 1)), truncated or
    rounded half to even; the last is n - 1. A position is chosen if some i gives
    it, which is tested on the two candidates around it, without a join on i.
    """
    n = df.groupBy(F.col(slide).alias("_slide")).agg(F.count(F.lit(1)).alias("_n"))
    out = df.join(n, F.col(slide).eqNullSafe(F.col("_slide"))).drop("_slide")
    if most == 1:
        return out.where(F.col(position) == 0).drop("_n")
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    spot = lambda i: F.when(i == most - 1, F.col("_n") - 1).otherwise((F.rint(i * step) if rounded else F.floor(i * step)).cast("long"))
    near = F.floor(F.col(position) / step)
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        i = F.least(F.greatest(near + d, F.lit(0)), F.lit(most - 1))
        hit = hit | (spot(i) == F.col(position))
    return out.where((F.col("_n") <= most) | hit).drop("_n")


def held_out(df: DataFrame, group: str, fraction: float, seed: int = 7) -> DataFrame:
    """``df`` with ``part`` train or val: whole groups by seeded hash, at least one in val and one in train.

    val gets the max(1, round-half-even(n * fraction)) groups, at most n - 1, of
    the smallest hashes. Groups are counted by the first digits of their hash
    (65,536 counts at most); only those that share the last group's are sorted.
    """
    groups = df.select(group).distinct().withColumn("_h", seeded(seed, group))
    head = F.substring("_h", 1, 4)
    counts = sorted((r.head, r.n) for r in groups.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in counts)
    left, last = min(max(1, round(n * fraction)), max(n - 1, 0)), ""
    for last, c in counts:
        if left <= c:
            break
        left -= c
    val = groups.where(head < last).union(groups.where(head == last).orderBy("_h", group).limit(left)).select(F.col(group).alias("_g"), F.lit(True).alias("_val"))
    return df.join(val, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g").withColumn("part", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def capped(df: DataFrame, order: Sequence[str], per: Sequence[tuple[str, int]], total: int | None = None) -> DataFrame:
    """At most so many rows of each key, for one key after another, then in all."""
    out = df
    for key, n in per:
        out = kept_first(out, [key], [F.col(o) for o in order], n)
    return out.orderBy(*order).limit(total) if total else out


def top(df: DataFrame, text: str, k: int | None) -> DataFrame:
    """The first ``k`` by upper-cased text, all if there is no positive ``k``."""
    out = df.orderBy(F.upper(text), text)
    return out.limit(k) if k and k > 0 else out


def dropped_out(df: DataFrame, group: str, key: str, p: float, seed: int = 7) -> DataFrame:
    """Rows whose hash score is at least ``p``, and each group's highest scorer: of equal scores the smallest key's rows."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    scored = df.withColumn("_u", u)
    best = scored.groupBy(F.col(group).alias("_group")).agg(F.min(F.struct((-F.col("_u")).alias("minus"), F.col(key).alias("key"))).alias("_best"))
    both = scored.join(best, F.col(group).eqNullSafe(F.col("_group")))
    return both.where((F.col("_u") >= p) | F.col(key).eqNullSafe(F.col("_best.key"))).drop("_u", "_group", "_best")
