"""Refreshes and one-time processing by streams: order, replays, lost versions, restarts."""

import glob
import os
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from cohort_spark.streaming import refresh

KIND = "k long, at long, v string"


def arrive(spark, rows, base):
    spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(f"{base}/in")


def refreshed(spark, base, **more):
    refresh.refresh(spark, f"{base}/in", KIND, f"{base}/out", f"{base}/done", "k", "at", buckets=8, **more)
    return sorted((tuple(r) for r in refresh.latest(spark, f"{base}/out").collect()), key=repr)


def test_refresh_does_not_depend_on_the_order_of_files(spark, tmp_path):
    parts = [[(k, 4 * k + p, f"e{p}") for k in range(5)] for p in range(3)]
    for order in ([2, 0, 1], [1, 2, 0]):
        base = f"{tmp_path}/{order[0]}"
        for p in order:
            arrive(spark, parts[p], base)
            found = refreshed(spark, base)
        assert found == sorted(parts[2])
        shutil.rmtree(f"{base}/out/v={refresh.versions(spark, f'{base}/out')[-1]}")  # a version is lost: the next one starts from those before
        arrive(spark, [(9, 0, "new")], base)
        assert {r[0] for r in refreshed(spark, base)} == {0, 1, 2, 3, 4, 9}


def test_refresh_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    base = str(tmp_path)
    arrive(spark, [(k, 0, "old") for k in range(400)] + [(None, 0, "null")], base)
    refreshed(spark, base)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{base}/out/v=0/bucket=*/*.parquet")}
    arrive(spark, [(7, 1, "new"), (7, 0, "older"), (None, 2, "newer")], base)
    found = refreshed(spark, base)
    assert len(found) == 401 and (7, 1, "new") in found and (None, 2, "newer") in found
    written = glob.glob(f"{base}/out/v=1/bucket=*")
    assert 1 <= len(written) <= 2
    assert {f: os.path.getmtime(f) for f in glob.glob(f"{base}/out/v=0/bucket=*/*.parquet")} == before
    bucket = os.path.basename(next(d for d in written if any(r[0] == 7 for r in spark.read.parquet(d).select("k").collect())))
    for i in range(3):
        arrive(spark, [(7, 2 + i, f"n{i}")], base)
        refreshed(spark, base)
    assert len(glob.glob(f"{base}/out/v=*/{bucket}")) == refresh.KEPT_VERSIONS
    assert (7, 4, "n2") in refreshed(spark, base)


def test_a_batch_that_fails_and_is_run_again_counts_once(spark, tmp_path):
    base, calls = str(tmp_path), []
    arrive(spark, [(k, 0, "a") for k in range(20)], base)
    refreshed(spark, base)
    arrive(spark, [(3, 1, "b"), (50, 0, "c")], base)

    def failing(df):
        calls.append(1)
        return df.withColumn("v", F.when(F.lit(len(calls) == 1), F.raise_error(F.lit("stop"))).otherwise(F.col("v")))

    with pytest.raises(StreamingQueryException):
        refreshed(spark, base, transform=failing)
    assert len(refresh.latest(spark, f"{base}/out").collect()) == 20
    found = refreshed(spark, base, transform=failing)
    assert len(found) == 21 and (3, 1, "b") in found and (50, 0, "c") in found


def test_work_that_is_broken_off_handles_each_input_once(spark, tmp_path):
    base = str(tmp_path)
    done = spark.createDataFrame([(1, "carried"), (2, "carried")], "k long, how string")
    for part in ([(1, 0, "a"), (3, 0, "b")], [(4, 0, "c"), (5, 0, "poison")], [(3, 1, "again"), (6, 0, "d"), (6, 0, "d"), (None, 0, "null")]):
        arrive(spark, part, base)

    def run(poisoned):
        bad = F.raise_error(F.lit("stop")).cast("string")
        work = lambda df: df.select("k", F.when((F.col("v") == "poison") & F.lit(poisoned), bad).otherwise(F.lit("fresh")).alias("how"))
        refresh.process_once(spark, f"{base}/in", KIND, "k", f"{base}/out", f"{base}/progress", work, done, files_per_batch=1)

    with pytest.raises(StreamingQueryException):
        run(True)
    run(False)
    arrive(spark, [(3, 9, "late"), (7, 0, "e"), (2, 0, "f")], base)
    run(False)
    found = sorted((tuple(r) for r in refresh.all_results(spark, f"{base}/out", done).collect()), key=repr)
    assert found == sorted([(1, "carried"), (2, "carried"), *[(k, "fresh") for k in (3, 4, 5, 6, 7, None)]], key=repr)
