"""Numbers rounded and written as C and Python do it."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cohort_spark.functions.text import decimals_text, fixed_decimals, rounded
from cohort_spark.operators.aggregates import series_verdict

PICK = random.Random(5)
VALUES = [0.5625, -0.5625, 0.0005, 0.1235, 0.0625, 2.5, 3.5, -0.5, 0.9995, 9.9995, 0.99951171875, 123456.0005, 5e12 + 2**-10 * 3, 2.0**53 + 2, 1e17, -0.0, 0.0, -1e-9, 1e-300]
VALUES += [PICK.randrange(-(10**7), 10**7) / 10**4 for _ in range(2000)] + [PICK.randrange(-(2**20), 2**20) / 2**11 for _ in range(2000)] + [PICK.uniform(-1, 1) for _ in range(500)]


@pytest.mark.parametrize("digits", [0, 2, 3, 5])
def test_decimals_are_those_of_python(spark, digits):
    df = spark.createDataFrame([(x,) for x in VALUES] + [(None,)], "x double").repartition(3)
    for r in df.select("x", decimals_text(F.col("x"), digits).alias("found")).collect():
        assert r.found == (None if r.x is None else f"{r.x:.{digits}f}")
    text = spark.createDataFrame([("0.0625",), ("no",), (None,), ("NaN",)], "c string").select(fixed_decimals("c", 3).alias("t"))
    assert [r.t for r in text.collect()] == ["0.062", "", "", ""]


def test_rounded_is_that_of_sql_with_the_sign_of_zero(spark):
    df = spark.createDataFrame([(x,) for x in [*VALUES, -4e-6, 1.005, 1e305, float("inf"), float("nan")]], "x double").repartition(3)
    for digits in (2, 5):
        for r in df.select("x", rounded("x", digits).alias("found")).collect():
            wanted = duckdb.execute("SELECT round(?::DOUBLE, ?::INTEGER)", [r.x, digits]).fetchone()[0]
            assert (math.isnan(wanted) and math.isnan(r.found)) or (repr(r.found) == repr(wanted)), r.x


def test_rejected_share_of_a_verdict_rounds_halves_to_even(spark):
    bad = "IF(id % 16 < 9, 32, 512) AS rows"
    images = spark.range(16).selectExpr("'s' AS series_dir", "id AS file", "true AS readable_dicom", "CAST(null AS STRING) AS reject_reason", "'CT' AS modality", "'1.2' AS sop_class_uid", "'u' AS series_instance_uid", "'axial' AS series_description", "CAST(null AS STRING) AS protocol_name", "'ORIGINAL' AS image_type", "1 AS number_of_frames", bad, "512 AS cols", "16 AS bits_allocated")
    said = series_verdict(images, "series_dir", 3, 0.3, file="file").first().reject_details
    assert said.startswith("9 of 16 rejected (0.562), at most 0.300")
