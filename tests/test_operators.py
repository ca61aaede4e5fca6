"""Operators on small literals: edge cases and expected values."""

import hashlib

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import Row
from pyspark.sql import functions as F

from cohort_spark.functions import arrays as A
from cohort_spark.functions import text as T
from cohort_spark.operators import aggregates, joins, projection, sets, windows
from cohort_spark.plans import artifacts, cohort
from cohort_spark.sources import files, registry


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, wanted",
    [
        (None, []),
        ("  ", []),
        ("[]", []),
        ("['slide-3.svs'\n 'slide-4.svs']", ["slide-3.svs", "slide-4.svs"]),
        ("['CT|MR']", ["CT|MR"]),
        ("[7, 9]", ["7", "9"]),
        ("[what", ["[what"]),
        (" a ", ["a"]),
        ('["a", "b"]', ["a", "b"]),
    ],
)
def test_parsed_list(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(A.parsed_list("t").alias("x")).first().x == wanted


def test_whole_numbers(spark):
    assert one(spark, A.whole_numbers(F.array(F.lit("7"), F.lit("9.9"), F.lit("x")))) == [7, 9]


def test_split_is_stable_and_degenerate_ratios_are_train(spark):
    assert one(spark, T.assigned_split(F.lit("s:p:1"))) == one(spark, T.assigned_split(F.lit("s:p:1")))
    assert one(spark, T.assigned_split(F.lit("g"), {"train": 0, "val": 0, "test": 0})) == "train"


@pytest.mark.parametrize("value, wanted", [("730.5", "2"), ("365", "365"), ("-3", ""), ("x", ""), ("2.5", "2"), (None, "")])
def test_age(spark, value, wanted):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(T.age_years("v").alias("x")).first().x == wanted


def test_survival_is_three_valued(spark):
    df = spark.createDataFrame([("5", "9"), (None, "9"), (None, None)], "d string, f string")
    assert [r.s.event for r in df.select(T.survival("d", "f").alias("s")).collect()] == [True, False, None]


def test_stem_and_series_parts(spark):
    assert one(spark, T.stem(F.lit("/a/b.tar.gz"))) == "b.tar"
    assert one(spark, T.stem(F.lit(".hidden"))) == ".hidden"
    s = one(spark, T.series_parts(F.lit("/r/radiology/c/p/s/u.zip")))
    assert tuple(s) == ("c", "p", "s", "u")
    assert tuple(one(spark, T.series_parts(F.lit("u.zip")))) == ("", "", "", "u")


def test_core_columns_and_normalisation(spark):
    df = spark.createDataFrame([("s", None, "['a' 'b']", 3)], "sample_id string, source string, pathology_wsi_paths string, extra int")
    out = registry.normalized(df)
    assert out.columns[: len(registry.CORE)] == registry.CORE and out.columns[-1] == "extra"
    r = out.first()
    assert r.source == "" and r.pathology_wsi_paths == ["a", "b"] and r.radiology_image_paths == []
    assert len(registry.CORE) == 43 and len(registry.LISTS) == 23
    registry.validated(out)
    with pytest.raises(ValueError):
        registry.validated(df)
    with pytest.raises(TypeError):
        registry.validated(df, required=["sample_id"])


def test_read_absent_registry(spark, tmp_path):
    assert registry.read_registry(spark, f"file://{tmp_path}/none").count() == 0


def test_replace_source_keeps_rows_without_source(spark):
    old = spark.createDataFrame([("a", "x", "k"), ("b", None, ""), ("c", "y", "")], "id string, source string, note string")
    new = spark.createDataFrame([("d",)], "id string")
    out = {r.id: (r.source, r.note) for r in sets.replace_source(old, new, "y").collect()}
    assert out == {"a": ("x", "k"), "b": (None, ""), "d": ("y", None)}


def test_upsert_keeps_later_position(spark):
    old = spark.createDataFrame([("r1", 1), ("r2", 2)], "id string, v int")
    new = spark.createDataFrame([("r1", 9), ("r3", 3)], "id string, v int")
    assert {tuple(r) for r in sets.upsert(old, new, "id").collect()} == {("r1", 9), ("r2", 2), ("r3", 3)}
    assert sets.upsert(old, new, "id", overwrite=True).count() == 2


def test_quantile_band(spark):
    df = spark.createDataFrame([(x,) for x in (10, 20, 30, 40, 50)] + [(None,)], "n int")
    assert sorted(r.n for r in projection.quantile_band(df, "n", 0.05, 0.95).collect()) == [20, 30, 40]
    assert projection.quantile_band(df, "n").count() == 6


def test_expansion_ids(spark):
    slides = spark.createDataFrame([("s", "a"), ("s", "b")], "k string, stem string")
    captions = spark.createDataFrame([("s ", 1, ""), ("s", 2, "x")], "k string, i int, instruction string")
    out = joins.expanded(slides, captions, ["k"], "default", "instruction")
    assert out.count() == 4 and {r.instruction for r in out.collect()} == {"default", "x"}


def test_fallback_only_without_an_entry(spark):
    cases = spark.createDataFrame([("c1", "p1"), ("c2", "p2"), ("c3", "p3")], "case string, patient string")
    links = spark.createDataFrame([("c1", "p1", "f1"), (None, "p1", "f2"), (None, "p2", "f3")], "case string, patient string, f string")
    out = {r.case: r.files for r in joins.with_fallback(cases, links, "case", "patient", "f", "files").collect()}
    assert out == {"c1": ["f1"], "c2": ["f3"], "c3": []}


def test_unique_keys(spark):
    with pytest.raises(ValueError, match="b"):
        joins.unique_keys(spark.createDataFrame([("a",), ("b",), ("b",), ("",), ("",)], "k string"), "k")


@pytest.mark.parametrize("n, m", [(1, 4), (5, 4), (100, 16), (257, 64), (1000, 7), (33, 32)])
@pytest.mark.parametrize("rounded", [False, True])
def test_even_spacing_equals_numpy(spark, n, m, rounded):
    df = spark.range(n).select(F.lit("s").alias("s"), F.col("id").alias("row_idx"))
    found = sorted(r.row_idx for r in windows.evenly_spaced(df, "s", m, rounded=rounded).collect())
    spots = np.linspace(0, n - 1, num=m)
    wanted = range(n) if n <= m else sorted({int(x) for x in (np.rint(spots) if rounded else spots.astype(np.int64))})
    assert found == list(wanted)


def test_mean_pool_expected(spark):
    rows = [Row(slide="s", row_idx=i, x=(i % 4) * 2, y=i // 4 * 2, embedding=[float(i), 1.0]) for i in range(8)]
    out = aggregates.spatial_mean_pool(spark.createDataFrame(rows), "slide", 2).orderBy("bucket_x").collect()
    assert [r.embedding for r in out] == [[2.5, 1.0], [4.5, 1.0]]
    same = spark.createDataFrame([Row(slide="s", row_idx=i, x=0, y=0, embedding=[float(i)]) for i in range(5)])
    assert sorted(r.embedding[0] for r in aggregates.spatial_mean_pool(same, "slide", 2).collect()) == [1.5, 4.0]


def test_stride_keeps_first_of_bucket(spark):
    rows = [Row(slide="s", row_idx=i, x=i, y=0) for i in range(6)]
    assert sorted(r.row_idx for r in windows.strided(spark.createDataFrame(rows), "slide", 2).collect()) == [0, 2, 4]


def test_merged_records_that_differ_are_an_error(spark):
    df = spark.createDataFrame([("h", 1, "f1"), ("h", 1, "f2")], "h string, v int, f string")
    assert aggregates.merged_records(df, "h", ["v"], "f").first().sources == ["f1", "f2"]
    bad = df.union(spark.createDataFrame([("h", 2, "f3")], df.schema))
    with pytest.raises(Exception, match="records differ"):
        aggregates.merged_records(bad, "h", ["v"], "f").collect()


def test_export_splits(spark):
    df = spark.createDataFrame([("a", None), ("b", " "), ("c", "test"), ("d", "odd")], "id string, split string")
    out = registry.export_splits(df, ["train", "test"]).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"train": 2, "test": 1}
    assert registry.export_splits(df, ["none-such"]).count() == 4


def test_new_features_reject_other_dimension(spark):
    stored = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id int, embedding array<double>")
    assert files.new_features(stored, spark.createDataFrame([(2, [1.0, 2.0])], stored.schema)).count() == 1
    with pytest.raises(Exception, match="dimension"):
        files.new_features(stored, spark.createDataFrame([(2, [1.0])], stored.schema)).collect()


def test_inventory_and_manifest(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    (tmp_path / ".hidden").write_bytes(b"1")
    rows = files.inventory(spark, f"file://{tmp_path}").collect()
    assert [(r.name, r.stem, r.size) for r in rows] == [("a.bin", "a", 5)]
    registry.append_manifest(spark, f"file://{tmp_path}/m", "src", 3, {"hits": 2})
    assert spark.read.json(f"file://{tmp_path}/m").first().rows == 3


def test_swap_version(spark, tmp_path, monkeypatch):
    pointer = f"file://{tmp_path}/pointer"
    assert registry.current_version(spark, pointer) is None
    assert registry.swap_version(spark, pointer, "v1") is None
    assert registry.swap_version(spark, pointer, "v2") == "v1"
    with monkeypatch.context() as m:  # it fails after the name is written, before it is put in place

        def broken(*_):
            raise OSError("stop")

        m.setattr(registry, "renamed", broken)
        with pytest.raises(OSError):
            registry.swap_version(spark, pointer, "v3")
    assert registry.current_version(spark, pointer) == "v2"
    with pytest.raises(Py4JJavaError):  # someone else saw the first version only
        registry.swap_version(spark, pointer, "v4", expected=1)
    assert registry.restore_version(spark, pointer, 1) == "v1"
    assert registry.pointers(spark, pointer) == [(1, "v1"), (2, "v2"), (3, "v1")]


def test_groups_stay_together(spark):
    df = spark.createDataFrame([(g, i) for g in "abcde" for i in range(3)], "g string, i int")
    out = windows.held_out(df, "g", 0.4)
    assert out.groupBy("g").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    assert out.where("part = 'val'").select("g").distinct().count() == 2
    alone = windows.held_out(df.where("g = 'a'"), "g", 0.9)
    assert {r.part for r in alone.collect()} == {"train"}


def test_training_set_plan(spark):
    reg = spark.createDataFrame([Row(source="s", sample_id="1", split="val", slides=["a-DX", "b-11A-DX", "c-TS"])])
    captions = spark.createDataFrame([Row(source="s", sample_id=" 1", split="train", caption="x", i=1), Row(source="s", sample_id="1", split="val", caption="y", i=2)])
    feats = spark.createDataFrame([Row(stem="a-DX", patches=10), Row(stem="c-TS", patches=20)])
    out = cohort.training_set(reg, captions, feats, kinds=["DX", "TS"], normal_source="s")
    assert {(r.stem, r.caption, r.split) for r in out.collect()} == {(s, c, "val") for s in ("a-DX", "c-TS") for c in ("x", "y")}
    assert cohort.split_mismatches(reg, captions).first().mismatches == 1


def test_column_choices():
    assert artifacts.first_matching_column(["ID", "Tumor_Purity", "purity2"], ["purity", "id"]) == "Tumor_Purity"
    assert artifacts.first_matching_column(["a"], ["b"]) is None


def test_path_columns(spark):
    assert registry.path_columns(spark.createDataFrame([(1, 2, 3)], "a_path int, b_paths int, paths_c int")) == ["a_path", "b_paths"]


def test_upsert_of_repeated_keys_is_settled(spark):
    old = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("b", 7), ("b", 9), (None, 1), (None, 2)], "id string, v int")
    for parts in (1, 7):
        out = sets.upsert(old.repartition(parts), new.repartition(parts), "id")
        assert {tuple(r) for r in out.collect()} == {("a", 5), ("b", 9), (None, 2)}
    placed = sets.upsert(old.withColumn("seq", -F.col("v")), new.withColumn("seq", -F.col("v")), "id")
    assert {(r.id, r.v) for r in placed.collect()} == {("a", 3), ("b", 7), (None, 1)}


def test_first_seen_merges_repeats(spark):
    rows = [("g", "x", 3), ("g", "y", 1), ("g", "x", 0), ("g", None, 2), ("h", None, 0)]
    df = spark.createDataFrame(rows * 3, "k string, v string, p int")
    assert {r.k: r.out for r in aggregates.first_seen(df, ["k"], "v", "p", "out").collect()} == {"g": ["x", "y"], "h": []}


def test_reference_audit_shows_few_examples(spark):
    rows = [("s", [f"/lost/{i:02d}" for i in range(9)] * 2), (None, ["/here", "/gone", "x://y", None]), ("t", [])]
    df = spark.createDataFrame(rows, "source string, paths array<string>")
    out = aggregates.reference_audit(df, "source", ["paths"], spark.createDataFrame([("/here",)], "path string"))
    found = {r.source: (r.refs, r.missing, r.unique_missing, r.examples) for r in out.collect()}
    assert found == {"s": (18, 18, 9, [f"/lost/{i:02d}" for i in range(5)]), None: (3, 1, 1, ["/gone"]), "t": (0, 0, 0, [])}


def test_held_out_takes_the_smallest_hashes(spark):
    df = spark.createDataFrame([(i // 2,) for i in range(400)] + [(None,)], "g int")
    out = windows.held_out(df, "g", 0.3)
    assert out.count() == 401
    hashes = {g: hashlib.sha256(f"7:{g}".encode() if g is not None else b"7").hexdigest() for g in [*range(200), None]}
    want = set(sorted(hashes, key=hashes.get)[: round(201 * 0.3)])
    assert {r.g for r in out.where("part = 'val'").collect()} == want
