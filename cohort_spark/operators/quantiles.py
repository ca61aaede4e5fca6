"""Exact quantiles of groups of any size by distributed selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.sources.scratch import written

#: Values that one buffer may hold: groups, and ranges of values, up to this size are sorted at once.
MOST_VALUES = 100_000
#: Parts into which a range of values is cut in each round, and the sketch's accuracy.
CUTS, ACCURACY = 64, 2_000
#: Pending ranges up to which they are broadcast to the rows.
BROADCAST_RANKS = 50_000


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], most: int = MOST_VALUES) -> DataFrame:
    """(keys, quantiles): each group's exact, linearly interpolated quantiles of its non-null values, as doubles.

    Groups of at most ``most`` values are sorted in one buffer. For the others
    the values at the needed ranks are selected: a sketch cuts the range that
    holds ranks into ``CUTS`` parts, the rows of each part and of each cut value
    are counted exactly, and only the parts that hold ranks are cut again,
    until they fit. A rank that falls on a cut value, as it does where many rows
    share it, is found at once. A row is in one range at most, however many ranks
    that holds, and is counted where it is read; the driver sees how many ranges
    are pending, nothing else. Null keys are a group.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = written(df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("v")).where("v is not null"), "values")  # each round reads them, what led to them runs once
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    sizes = written(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "sizes")
    small = rows.join(matched(sizes.where(F.col("n") <= most), names), on_keys(names), "left_semi") if sizes.where(F.col("n") > most).limit(1).count() else rows
    out = small.groupBy(*names).agg(F.percentile("v", wanted).alias("quantiles"))
    if small is not rows:
        out = out.union(selected(rows, sizes.where(F.col("n") > most), names, probabilities, most))
    return out.toDF(*keys, "quantiles") if keys else out.where("quantiles is not null")


def on_keys(names: Sequence[str]) -> Column:
    return F.expr(" AND ".join([f"{n} <=> _{n}" for n in names]) or "true")


def matched(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with its keys under other names, to be joined by ``on_keys``."""
    return df.withColumnsRenamed({n: f"_{n}" for n in names})


def selected(rows: DataFrame, sizes: DataFrame, names: list[str], probabilities: Sequence[float], most: int) -> DataFrame:
    """(keys, quantiles) of the groups of ``sizes``, by rounds of cutting and counting."""
    spots = F.array(*[F.lit(float(p)) * (F.col("n") - 1) for p in probabilities])
    ranks = F.array_distinct(F.flatten(F.transform(spots, lambda s: F.array(F.floor(s).cast("long"), F.ceil(s).cast("long")))))
    none = F.lit(None).cast("double")
    pending = written(sizes.select(*names, none.alias("lower"), none.alias("upper"), F.lit(0).cast("long").alias("before"), "n", ranks.alias("ranks")), "ranges")
    left, found = pending.count(), []
    own = [*names, "before"]
    while left:
        few = left <= BROADCAST_RANKS

        def inside(ranges: DataFrame, *columns: str, few: bool = few) -> DataFrame:
            """(own, v, columns): rows of the ranges, with the named columns of theirs."""
            there = (F.col("lower").isNull() | (F.col("v") > F.col("lower"))) & (F.col("upper").isNull() | (F.col("v") < F.col("upper")))
            side = matched(ranges.select(*own, "lower", "upper", *columns), names)
            return rows.join(F.broadcast(side) if few else side, on_keys(names) & there).select(*own, "v", *columns)

        def again(counted: DataFrame, ranges: DataFrame, few: bool = few) -> DataFrame:
            """What was counted of ranges, with the ranges' columns."""
            side = matched(ranges, own)
            return counted.join(F.broadcast(side) if few else side, on_keys(own)).drop(*[f"_{c}" for c in own])

        fitting, wide = pending.where(F.col("n") <= most), pending.where(F.col("n") > most)
        held = inside(fitting).groupBy(*own).agg(F.array_sort(F.collect_list("v")).alias("vs"))
        at_rank = lambda r: F.struct(r.alias("rank"), F.element_at("vs", (r - F.col("before") + 1).cast("int")).alias("v"))
        found.append(again(held, fitting).select(*names, F.inline(F.transform("ranks", at_rank))))
        cuts = F.array_distinct(F.percentile_approx("v", [i / CUTS for i in range(1, CUTS)], ACCURACY))
        cut = written(again(inside(wide).groupBy(*own).agg(cuts.alias("cuts")), wide), "cuts")
        below = F.size(F.filter("cuts", lambda c: c < F.col("v")))
        part = 2 * below + F.array_contains("cuts", F.col("v")).cast("int")
        counts = inside(cut, "cuts").select(*own, part.alias("part")).groupBy(*own, "part").agg(F.count(F.lit(1)).alias("rows"))  # only numbers are kept of a row: cuts in the aggregate's buffer would make it sort the rows
        until = F.col("before") + F.sum("rows").over(Window.partitionBy(*own).orderBy("part"))
        parts = again(counts.withColumn("until", until), cut).withColumn("first", F.col("until") - F.col("rows")).withColumn("at", F.floor(F.col("part") / 2).cast("int"))
        ranks_in = F.filter("ranks", lambda r: (r >= F.col("first")) & (r < F.col("until")))
        holding = written(parts.withColumn("ranks", ranks_in).where(F.size("ranks") > 0), "holding")
        found.append(holding.where("part % 2 = 1").select(*names, F.explode("ranks").alias("rank"), F.element_at("cuts", F.col("at") + 1).alias("v")))
        lower = F.when(F.col("at") > 0, F.get("cuts", F.col("at") - 1)).otherwise(F.col("lower"))
        upper = F.coalesce(F.get("cuts", F.col("at")), "upper")
        pending = written(holding.where("part % 2 = 0").select(*names, lower.alias("lower"), upper.alias("upper"), F.col("first").alias("before"), F.col("rows").alias("n"), "ranks"), "ranges")
        left = pending.count()
    values = found[0]
    for more in found[1:]:
        values = values.union(more)
    by_rank = values.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    each = by_rank.join(matched(sizes, names), on_keys(names))

    def interpolated(p: float) -> Column:
        spot = F.lit(float(p)) * (F.col("n") - 1)
        low, high = (F.element_at("m", f(spot).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(spot) - spot) * low + (spot - F.floor(spot)) * high)

    return each.select(*names, F.array(*[interpolated(p) for p in probabilities]).alias("quantiles"))
