"""Operators that must hold for groups of any size, with their bounds set low."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_spark.operators import aggregates, projection, quantiles, windows
from cohort_spark.plans import cohort

PICK = np.random.default_rng(3)
GROUPS = {
    "spread": PICK.normal(size=3000),
    "hot": np.concatenate([np.full(4000, 7.0), PICK.normal(size=500)]),
    "equal": np.full(2500, -1.5),
    "two": np.repeat([1.0, 2.0], 700),
    "wide": PICK.normal(size=1500) * 10.0 ** PICK.integers(-300, 300, 1500),
    "small": np.array([3.0, 1.0]),
    "one": np.array([4.0]),
    None: PICK.integers(0, 40, 2000).astype(float),
}
SHARES = [0.0, 0.013, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("few", [0, 10**6])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "BROADCAST_RANKS", few)
    rows = [(k, float(x)) for k, xs in GROUPS.items() for x in xs] + [("small", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    found = {r.g: r.quantiles for r in quantiles.quantiles(df, ["g"], "x", SHARES, most=60).collect()}
    assert set(found) == set(GROUPS)
    for k, xs in GROUPS.items():
        assert np.allclose(found[k], np.quantile(xs, SHARES), rtol=1e-12, atol=0)


def test_quantiles_without_groups(spark):
    xs = PICK.integers(0, 1000, 5000).astype(float)
    df = spark.createDataFrame([(float(x),) for x in xs], "x double").repartition(5)
    assert np.allclose(quantiles.quantiles(df, [], "x", SHARES, most=50).first().quantiles, np.quantile(xs, SHARES))
    assert np.allclose(quantiles.quantiles(df, [], "x", SHARES).first().quantiles, np.quantile(xs, SHARES))
    assert quantiles.quantiles(df.limit(0), [], "x", SHARES).count() == 0


def test_quantile_rounds_neither_sort_rows_nor_repeat_them_by_rank(spark, monkeypatch):
    plans, tables, keep = {}, {}, quantiles.written

    def watched(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().toString())
        tables.setdefault(name, []).append(keep(df, name))
        return tables[name][-1]

    monkeypatch.setattr(quantiles, "written", watched)
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(4000)], "g int, x double").repartition(4)
    found = {r.g: r.quantiles for r in quantiles.quantiles(df, ["g"], "x", SHARES, most=60).collect()}
    assert all(np.allclose(found[g], np.quantile(np.arange(g, 4000, 2), SHARES)) for g in (0, 1))
    assert plans["holding"] and "SortAggregate" not in "".join(plans["holding"])
    assert tables["ranges"][0].count() == 2


def test_band_and_distribution_beyond_one_buffer(spark, monkeypatch):
    monkeypatch.setattr(quantiles.quantiles, "__defaults__", (40,))
    xs = PICK.integers(0, 300, 2000)
    df = spark.createDataFrame([(int(x) % 3, float(x)) for x in xs], "g int, x double")
    low, high = np.quantile(xs, [0.1, 0.8])
    assert projection.quantile_band(df, "x", 0.1, 0.8).count() == ((xs >= low) & (xs <= high)).sum()
    assert projection.quantile_band(df.limit(0), "x", 0.1, 0.8).count() == 0
    for r in aggregates.distribution(df, ["g"], "x", 50, 200).collect():
        own = xs[xs % 3 == r.g]
        assert np.allclose([r.n, r["mean"], r.q25, r["median"], r.q75, r.below], [len(own), own.mean(), *np.quantile(own, [0.25, 0.5, 0.75]), (own < 50).mean()])


def test_positions_of_a_hot_group_are_gapless_and_spread(spark):
    rows = [("hot", i * 3 % 1000, i) for i in range(4000)] + [(None, i, i) for i in range(900)] + [("small", 5, 1), ("small", None, 2)]
    df = spark.createDataFrame(rows, "g string, x int, y int").repartition(5)
    out = windows.positioned(df, ["g"], ["x", "y"], "at", rows=200)
    assert "_part" in out._jdf.queryExecution().toString()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        found = sorted((r.at, r.x, r.y) for r in out.where(F.col("g").eqNullSafe(F.lit(g))).collect())
        assert found == [(i, r[1], r[2]) for i, r in enumerate(own)]
    assert windows.positioned(df.limit(0), ["g"], ["x"], "at").count() == 0


def test_evenly_spaced_does_not_depend_on_how_positions_are_cut(spark):
    df = spark.createDataFrame([(0, i) for i in range(3000)] + [(1, i) for i in range(7)], "g int, x int")
    cut = windows.evenly_spaced(windows.positioned(df, ["g"], ["x"], "at", rows=100), "g", 16, "at")
    whole = windows.evenly_spaced(windows.positioned(df, ["g"], ["x"], "at"), "g", 16, "at")
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect())) and cut.where("g = 0").count() == 16


def test_mean_vectors_sum_whole_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("a", None), ("b", [None, 1.0]), ("c", None), (None, [5.0, 5.0])]
    out = aggregates.mean_vectors(spark.createDataFrame(rows, "g string, v array<double>"), ["g"], "v")
    found = {r.g: r.v for r in out.collect()}
    assert found["a"] == [2.0, 4.0] and np.isnan(found["b"][0]) and found["b"][1] == 1.0 and found[None] == [5.0, 5.0] and "c" not in found
    assert "explode" not in out._jdf.queryExecution().toString()


def test_dropout_keeps_a_row_of_each_group(spark):
    df = spark.createDataFrame([(g, i) for g in ("a", "b", None) for i in range(5)] + [("one", 1)], "g string, i int")
    assert {r.g for r in windows.dropped_out(df, "g", "i", 1.0).collect()} == {"a", "b", None, "one"}
    assert windows.dropped_out(df, "g", "i", 0.0).count() == 16


def test_assembled_sequences(spark):
    features = spark.createDataFrame([("s1", i, [float(i)]) for i in range(10)] + [("s2", i, [100.0 + i]) for i in range(2)], "slide string, row_idx int, embedding array<double>")
    rows = spark.createDataFrame([(1, ["s1", "s2"]), (2, [" s2 ", "", "s1", "s2"]), (3, []), (4, None), (5, ["gone"]), (6, [None, "s2"])], "row int, refs array<string>")
    out = cohort.assembled(rows, features, "row", "refs", "slide", most=3).collect()
    found = {k: [r.embedding[0] for r in sorted(out, key=lambda r: r.token) if r.row == k] for k in {r.row for r in out}}
    assert found == {1: [0.0, 4.0, 9.0, 100.0, 101.0], 2: [100.0, 101.0, 0.0, 4.0, 9.0, 100.0, 101.0], 6: [100.0, 101.0]}
    assert sorted(r.token for r in out if r.row == 2) == list(range(7))
