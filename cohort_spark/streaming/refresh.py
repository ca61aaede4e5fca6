"""Incremental refresh with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.operators.windows import kept_last
from cohort_spark.sources.registry import exists

#: Buckets of keys of a refreshed table: what a batch does not touch is neither read nor written.
BUCKETS = 64
#: Versions of a bucket that stay: the newest, and the one before it for a batch that is run again.
KEPT_VERSIONS = 2


def refresh(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, position: str, transform: Callable[[DataFrame], DataFrame] | None = None, files_per_batch: int = 8, buckets: int = BUCKETS) -> None:
    """Read files of ``source`` that were not read before and upsert them into ``target``, then stop.

    The table lies in buckets of the key's hash. A batch reads the newest
    versions of its keys' buckets before its own number and writes these buckets
    again, below ``target/v=<batch>``; other buckets stay as they are. A batch
    that is run again after a failure overwrites its own version, and one that
    did not end is never read, so each batch counts once. Versions that nothing
    needs are deleted. The number of buckets must stay that of the first run.

    Of the rows of a key that with the largest ``position`` stays, so the result
    does not depend on the order in which files arrive; at equal positions the
    later batch wins.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def merge(batch: DataFrame, number: int) -> None:
        fresh = (transform(batch) if transform else batch).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).withColumn("_age", F.lit(1))
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
        newest = newest_buckets(spark, target, number)
        before = {b: newest[b] for b in touched if b in newest}
        if before:
            fresh = read_buckets(batch.sparkSession, target, before).withColumn("_age", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
        out = kept_last(fresh.withColumn("_order", F.struct(position, "_age")), ["bucket", key], "_order").drop("_age", "_order")
        out.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v={number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    vacuum(spark, target)


def folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of a folder's subfolders ``<prefix><number>``, ascending."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


def versions(spark: SparkSession, target: str) -> list[int]:
    """Numbers of the table's complete versions."""
    return [v for v in folders(spark, target, "v=") if exists(spark, f"{target}/v={v}/_SUCCESS")] if exists(spark, target) else []


def newest_buckets(spark: SparkSession, target: str, before: int | None = None) -> dict[int, int]:
    """{bucket: the newest complete version that holds it}, of versions before a number if one is given."""
    out = {}
    for v in versions(spark, target):
        if before is None or v < before:
            out |= dict.fromkeys(folders(spark, f"{target}/v={v}", "bucket="), v)
    return out


def read_buckets(spark: SparkSession, target: str, chosen: dict[int, int]) -> DataFrame:
    """The rows of buckets in the versions chosen, with their bucket."""
    parts = [(v, [f"{target}/v={v}/bucket={b}" for b, w in sorted(chosen.items()) if w == v]) for v in sorted(set(chosen.values()))]
    out = None
    for v, paths in parts:
        own = spark.read.option("basePath", f"{target}/v={v}").option("mergeSchema", "true").parquet(*paths)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The rows of a refreshed table."""
    return read_buckets(spark, target, newest_buckets(spark, target)).drop("bucket")


def vacuum(spark: SparkSession, target: str, keep: int = KEPT_VERSIONS) -> None:
    """Delete all but the newest ``keep`` versions of each bucket."""
    seen: dict[int, int] = {}
    for v in reversed(versions(spark, target)):
        for b in folders(spark, f"{target}/v={v}", "bucket="):
            seen[b] = seen.get(b, 0) + 1
            if seen[b] > keep:
                where = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={v}/bucket={b}")
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unprocessed(inputs: DataFrame, done: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(inputs still to process, finished rows carried through)."""
    return inputs.join(done, key, "left_anti"), done


def process_once(spark: SparkSession, source: str, schema: str, key: str, target: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], done: DataFrame | None = None, files_per_batch: int = 8) -> None:
    """Run ``work`` over inputs that arrive as files, each key once, and append the results to ``target``; then stop.

    The checkpoint holds which files were read and, in the state store, which
    keys were met; keys of ``done`` (a table with the column ``key``) are left
    out. The file sink commits a batch's files together, so a run that is broken
    off and started again neither repeats nor loses an input. Of inputs that
    share a key any one is taken.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    if done is not None:
        arriving = arriving.join(done.select(key).distinct(), key, "left_anti")
    fresh = work(arriving.dropDuplicates([key]))
    fresh.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start().awaitTermination()


def all_results(spark: SparkSession, target: str, done: DataFrame | None = None) -> DataFrame:
    """What ``process_once`` has committed, and the finished rows carried through."""
    out = spark.read.parquet(target)
    return out if done is None else done.unionByName(out, allowMissingColumns=True)
