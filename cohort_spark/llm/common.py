"""What the corpus operators share: scratch tables, checked broadcasts, words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two- or three-column side may be broadcast after counting.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    In local mode, where the setting may be absent, a fresh temporary folder is
    chosen once; on a cluster the setting is required.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark deletes a query's shuffle files as soon as the query has ended, where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it: lineage ends here.

    The shuffle files of the write go with it, so a chain of tables needs the
    disk of one step. They are still there while the write runs, for retries.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``saved`` that nothing reads any more: rounds of an iteration need room for two."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def at_most(df: DataFrame, most: int, entries: F.Column | None = None) -> bool:
    """Whether ``df`` has at most ``most`` rows, or entries where ``entries`` counts a row's."""
    if entries is None:
        return df.limit(most + 1).count() <= most
    return (df.agg(F.sum(entries)).first()[0] or 0) <= most


def checked_broadcast(df: DataFrame, most: int = BROADCAST_ROWS, entries: F.Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (or entries), else unchanged.

    Beyond the bound Spark plans a shuffled join, whose hot keys adaptive
    execution splits.
    """
    return F.broadcast(df) if at_most(df, most, entries) else df


#: Texts of one Arrow batch: what a Python worker holds of a task's rows at once.
TEXTS_AT_ONCE = 500


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold ``TEXTS_AT_ONCE`` rows at most, for columns of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > TEXTS_AT_ONCE:
        spark.conf.set(key, TEXTS_AT_ONCE)


class Own:
    """A frame's columns under names that no operator uses, and the way back.

    ``frame`` has columns u0, u1, ...; ``own[name]`` is the new name of a column.
    """

    def __init__(self, df: DataFrame):
        self.columns = df.columns
        self.named = [f"u{i}" for i in range(len(df.columns))]
        self.frame = df.toDF(*self.named)

    def __getitem__(self, name: str) -> str:
        return self.named[self.columns.index(name)]

    def restored(self, df: DataFrame, added: Mapping[str, F.Column] | None = None) -> DataFrame:
        """The original columns of ``df``, then the added ones; an added column replaces one of its name."""
        added = added or {}
        taken = {name.lower() for name in added}
        kept = [F.col(u).alias(c) for u, c in zip(self.named, self.columns, strict=True) if c.lower() not in taken]
        return df.select(*kept, *[column.alias(name) for name, column in added.items()])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; ``bytes.split`` cuts at exactly these."""
    return text.encode().split() if text else []


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_slices(data: bytes, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``most`` bytes."""
    at = 0
    while at < len(data):
        space = _SPACE.search(data, at + most)
        end = space.start() if space else len(data)
        yield data[at:end].split()
        at = end


#: Fixed keys of the two halves of a word's id.
HASH_KEYS = ("corpus words one", "corpus words two")


def word_ids(words: list[bytes]) -> np.ndarray:
    """(2, words) array: 128-bit ids of words, two keyed SipHash values each."""
    out = np.empty((2, len(words)), np.uint64)
    for i in range(0, len(words), 1 << 16):
        part = np.array(words[i : i + (1 << 16)], object)
        for half, key in enumerate(HASH_KEYS):
            out[half, i : i + len(part)] = pd.util.hash_array(part, hash_key=key, categorize=False)
    return out


def word_runs(column, lower: bool = False, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """An Arrow string column in slices of about ``most`` bytes: (first row, ids of all words, bounds of each row's words).

    ``bounds`` has one entry more than the slice has rows. A null text has no
    words; ``lower`` lower-cases A-Z first.
    """
    first, size, words, runs, bounds = 0, 0, [], [], [0]

    def slice_() -> tuple[int, np.ndarray, np.ndarray]:
        runs.append(word_ids(words))
        return first, np.concatenate(runs, axis=1), np.array(bounds)

    for row, data in enumerate(column.cast("binary").to_pylist()):
        data = (data.lower() if lower else data) if data else b""
        before = bounds[-1]
        for part in word_slices(data):
            words += part
            before += len(part)
            if len(words) > 1 << 20:
                runs.append(word_ids(words))
                words = []
        bounds.append(before)
        size += len(data)
        if size >= most:
            yield slice_()
            first, size, words, runs, bounds = row + 1, 0, [], [], [0]
    if len(bounds) > 1:
        yield slice_()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits are alike random."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolled(words: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries."""
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(base) + words[j : j + n]
        return mixed(h)
