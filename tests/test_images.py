"""Grey values against numpy; annotation tables of odd shapes; split records."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohort_spark.functions import arrays, images
from cohort_spark.operators import annotations, records

NAN, INF = float("nan"), float("inf")


def grey_by_hand(pixels, padding, low, high):
    x = np.array([NAN if v is None else v for v in pixels], float)
    pad = np.array([bool(p) for p in padding], bool)
    valid = x[np.isfinite(x) & ~pad]
    if not len(valid):
        return [0] * len(x)
    lo, hi = np.quantile(valid, [low, high])
    if hi <= lo:
        lo, hi = valid.min(), valid.max()
    if hi <= lo:
        return [0] * len(x)
    return [0 if p or np.isnan(v) else int(np.round((min(max(v, lo), hi) - lo) / (hi - lo) * 255)) for v, p in zip(x, pad, strict=True)]


def test_rescaled_equals_numpy(spark):
    pick = np.random.default_rng(4)
    rows = [([float(v) for v in pick.normal(size=n) * 100], [bool(b) for b in pick.random(n) < 0.3]) for n in (1, 2, 3, 40, 200)]
    rows += [([5.0] * 9, [False] * 9), ([1.0, 1.0, 1.0, 9.0, 1.0], [False] * 5), ([1.0, 2.0], [True, True]), ([], []), ([NAN, INF, -INF, None], [False] * 4), ([NAN, INF, -INF, None, 1.0, 3.0], [False, None, False, False, False, None])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x array<double>, p array<boolean>")
    for low, high in ((0.01, 0.99), (0.25, 0.75)):
        found = {r.i: r.g for r in df.select("i", images.rescaled("x", "p", low, high).alias("g")).collect()}
        assert found == {i: grey_by_hand(*r, low, high) for i, r in enumerate(rows)}
    plain = df.select("i", images.rescaled("x").alias("g")).collect()
    assert {r.i: r.g for r in plain} == {i: grey_by_hand(x, [False] * len(x), 0.01, 0.99) for i, (x, _) in enumerate(rows)}
    assert spark.range(1).select(images.rescaled(F.lit(None).cast("array<double>")).alias("g")).first().g is None


def test_windows_as_channels(spark):
    df = spark.createDataFrame([("thorax", [-1350.0, -600.0, 150.0, NAN, INF], [False, False, True, False, False]), ("?", [50.0], [None])], "region string, x array<double>, p array<boolean>")
    found = {r.region: r.c for r in df.select("region", images.region_channels("x", "region", "p").alias("c")).collect()}
    assert found["thorax"][0] == [0, 128, 0, 0, 255] and len(found["thorax"]) == 3
    assert found["?"] == [[128], [85], [128]]


def tables(spark, purity):
    frame = lambda rows, names: spark.createDataFrame([tuple(map(str, r)) for r in rows], [n for n in names])
    return {
        "subtypes": frame([("AA-BB-P1-02A", "late"), ("AA-BB-P1-01A", "Colon MSI-H"), ("AA.BB.P2.01", "  "), ("", "none"), ("AA-BB-XX-01", "other")], ["pan.SampleID", "Subtype_Selected"]),
        "scores": frame([("AA-BB-P1-01A", purity, "7.9"), ("AA-BB-P2-06", "NA", "x")], ["sample", "purity", "aneuploidy"]),
        "purity": frame([("AA-BB-P1-01A", "0.456"), ("AA-BB-P2-01", "0.999")], ["barcode", "ABSOLUTE purity"]),
        "hrd": frame([("AA-BB-P2-01", "42.7")], ["Sample", "HRD"]),
        "leukocytes": frame([("KIRC", "AA-BB-P2-01", "0.12345")], ["CancerType", "SampleID", "leukocyte_fraction"]),
    }


def test_annotation_tables_with_and_without_fallback(spark):
    cohort = spark.createDataFrame([("AA-BB-P1",), ("AA-BB-P2",), ("AA-BB-P3",), (None,), ("AA-BB-P1",)], "patient_id string")
    found = {r.patient_id: r for r in annotations.annotated_patients(cohort, tables(spark, "0.314159")).collect()}
    assert set(found) == {"AA-BB-P1", "AA-BB-P2"}
    one, two = found["AA-BB-P1"], found["AA-BB-P2"]
    assert (one.molecular_subtype, one.msi_status, one.tumor_purity, one.aneuploidy_score) == ("Colon MSI-H", "MSI", "0.31", "7")
    assert (two.molecular_subtype, two.tumor_purity, two.aneuploidy_score, two.hrd_score, two.leukocyte_fraction) == ("", "", "", "42", "0.123")
    found = {r.patient_id: r.tumor_purity for r in annotations.annotated_patients(cohort, tables(spark, "")).collect()}
    assert found == {"AA-BB-P1": "0.46", "AA-BB-P2": "1.00"}
    assert annotations.annotated_patients(cohort, {}).count() == 0
    assert annotations.annotated_patients(cohort, {"hrd": spark.createDataFrame([("a", 1)], "id string, HRD int")}).count() == 0


def test_paired_lists_must_be_of_one_length(spark):
    df = spark.createDataFrame([(1, [[1, 2]], [[3, 4]]), (2, [[1, 2]], None), (3, [[1, 2]], [[3]])], "i int, f array<array<int>>, c array<array<int>>")
    found = {r.i: tuple(r.p) for r in df.where("i < 3").select("i", arrays.paired("f", "c").alias("p")).collect()}
    assert found == {1: ([1, 2], [3, 4]), 2: ([1, 2], None)}
    with pytest.raises(PySparkException):
        df.select(arrays.paired("f", "c").alias("p")).collect()


def test_split_records(spark):
    record = "array<struct<f:string,reason:string,m:string>>"
    df = spark.createDataFrame([(1, [("a", None, " "), ("b", "bad", "CT"), (" ", "", "MR"), ("d", " ", None)]), (2, []), (3, None)], f"i int, r {record}")
    found = {r.i: r.s for r in df.select("i", arrays.split_records("r", "reason", "f", "m").alias("s")).collect()}
    assert found[1].usable_paths == ["a", "d"] and found[1].usable == 2 and found[1].modality == "CT" and [x.f for x in found[1].rejected] == ["b"] and len(found[1].accepted) == 3
    assert found[2].usable == 0 and found[2].modality == ""


def test_study_records_take_any_field_name(spark):
    rows = ['{"PatientId": 7, "StudyInstanceUid": "u", "Modalities": "MR,CT"}', '{"PatientID": null, "subject_id": " s ", "ModalitiesInStudy": ["b", "a", null]}', '{"PatientID": " "}', "broken", None, "[]"]
    found = [(r.patient_id, r.study_instance_uid, r.modalities_in_study) for r in records.study_records(spark.createDataFrame([(x,) for x in rows], "j string"), "j").collect()]
    assert sorted(found) == [("7", "u", ["CT", "MR"]), ("s", "", ["a", "b"])]


def test_series_records_are_parsed_once(spark):
    bodies = ['{"SeriesInstanceUid": " s1 ", "Modality": {"x": 1}, "modality": "CT", "BodyPart": 7}', '{"SeriesInstanceUID": " ", "seriesInstanceUid": 2.50, "Modality": ["a"]}', '{"SeriesInstanceUID": ["a"], "SeriesInstanceUid": {}}', '{"Modality": "MR"}', "broken", None, "[]"]
    docs = spark.createDataFrame([(i, "u", "own", b) for i, b in enumerate(bodies)] + [(9, "v", "own", bodies[0]), (10, "", "own", bodies[0])], "i int, study string, patient_id string, j string")
    studies = spark.createDataFrame([("u", "p2"), ("u", "p1"), ("w", "p3"), ("", "p4"), (None, "p5")], "study_instance_uid string, patient_id string")
    out = records.series_records(docs, "j", studies, "study", ["i"])
    assert out.columns == ["i", "study", "series_instance_uid", "modality", "body_part_examined", "series_description", "patient_id"]
    assert sorted(map(tuple, out.collect())) == [(0, "u", "s1", "CT", "7", "", "p1"), (1, "u", "2.5", "", "", "", "p1")]
    studies_out = records.study_records(docs, "j", ["i"])
    for df in (out, studies_out):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
