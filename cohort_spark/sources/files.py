"""Scans and sinks of files: JSON lines, tables of text, inventories, feature stores."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cohort_spark.functions.text import file_name, stem


def read_splits(spark: SparkSession, paths: Mapping[str, str], schema: str) -> DataFrame:
    """JSON lines of several splits, each stamped with its name; a missing path is an error."""
    frames = [spark.read.schema(schema).json(p).withColumn("split", F.lit(name)) for name, p in paths.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_json_with_name(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON lines with the name of the file each came from; blank lines are skipped."""
    return spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("source_file"))


def read_tsv(spark: SparkSession, path: str, key: str = "sample", names: Sequence[str] | None = None) -> DataFrame:
    """A tab-separated table; with ``names`` it may lack a header, which shows in a first line without ``key``."""
    first = spark.read.text(path).first()
    header = names is None or (first is not None and key.lower() in first[0].lower())
    out = spark.read.option("sep", "\t").option("header", header).csv(path)
    return out.toDF(*names) if names and len(out.columns) == len(names) else out


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """Two-column value files, NA as missing, with the file each row came from."""
    return spark.read.schema("name string, value double").option("sep", "\t").option("nullValue", "NA").csv(path).select("*", F.col("_metadata.file_path").alias("file"))


def read_documents(spark: SparkSession, path: str, schema: str, filters: Mapping[str, Sequence[str]], order: Sequence[str], most: int | None = None) -> DataFrame:
    """Landed JSON pages: rows whose fields are in the given lists, sorted, optionally the first few."""
    df = spark.read.schema(schema).json(path)
    for field, values in filters.items():
        df = df.where(F.col(field).isin(*values))
    df = df.orderBy(*order)
    return df.limit(most) if most else df


def inventory(spark: SparkSession, path: str, glob: str = "*", folders: bool = False) -> DataFrame:
    """(path, name, stem, size, kind) of the visible files below a folder; contents are not read.

    Names that begin with a dot or an underscore are left out. Without
    ``folders`` Spark's own listing serves, on any store that Spark reads; it
    does not show files without bytes. With it, folders are rows of kind
    ``folder`` and size 0, empty or not, the root among them, and files without
    bytes are listed: a task for each subfolder of the root lists what is below
    it, so the store must be one that ``pyarrow.fs`` reaches.
    """
    if folders:
        spark.dataSource.register(FolderListing)
        df = spark.read.format(FolderListing.name()).option("root", qualified(spark, path)).load()
        shown = (F.col("kind") == "folder") | file_name("path").rlike("^" + fnmatch.translate(glob))
        df = df.where(shown)
    else:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
        df = read.select("path", F.col("length").alias("size"), F.lit("file").alias("kind"))
    return df.select("path", file_name("path").alias("name"), stem("path").alias("stem"), "size", "kind").where(~F.col("name").rlike("^[._]"))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as listings write it, with its scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


class FolderListing(DataSource):
    """(path, size, kind) of the files and folders below ``root``; a partition for each of its subfolders, and one for the rest."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, size long, kind string"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["root"].rstrip("/"))


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def listed(self, folder: str, recursive: bool) -> Iterator[tuple[str, int, str]]:
        """What a folder, named from the root, holds; a folder that is gone holds nothing."""
        from pyarrow import fs

        scheme, rest = self.root.split(":", 1)
        if scheme == "file":
            store, base = fs.LocalFileSystem(), "/" + rest.lstrip("/")
        else:
            store, base = fs.FileSystem.from_uri(self.root)
        chosen = fs.FileSelector(base + folder, recursive=recursive, allow_not_found=True)
        for info in store.get_file_info(chosen):
            kind = "folder" if info.type == fs.FileType.Directory else "file"
            yield info.path[len(base) :], info.size or 0, kind

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(None), *[InputPartition(p) for p, _, kind in self.listed("", False) if kind == "folder"]]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        if partition.value is None:
            yield self.root, 0, "folder"
        below = self.listed(partition.value or "", partition.value is not None)
        for path, size, kind in below:
            yield self.root + path, 0 if kind == "folder" else size, kind


def file_verdict(refs: DataFrame, files: DataFrame, ref: str = "ref", least: int = 1) -> DataFrame:
    """``refs`` with ``size`` and verdict missing, not_a_file, too_small or ok by a left join with an inventory (path, size, kind).

    A blank or null reference is missing; an inventory without ``kind`` lists files.
    """
    kind = F.col("kind") if "kind" in files.columns else F.lit("file")
    own = files.select(F.col("path").alias("_path"), F.col("size").alias("_size"), kind.alias("_kind"))
    verdict = F.when(F.col("_path").isNull(), "missing").when(F.col("_kind") != "file", "not_a_file").when(F.col("_size") < least, "too_small").otherwise("ok")
    size = F.when(F.col("_kind") == "file", F.col("_size")).otherwise(F.lit(0))
    return refs.join(own, F.col(ref) == F.col("_path"), "left").withColumn("size", size).withColumn("verdict", verdict).drop("_path", "_size", "_kind")


def write_details(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One JSON object a row in folders by the values of ``by``; ``by`` columns stand in the folders' names alone."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def read_details(spark: SparkSession, path: str, schema) -> DataFrame:
    """What ``write_details`` wrote, in the schema given."""
    return spark.read.schema(schema).json(path)


def write_sorted(df: DataFrame, path: str, order: Sequence[str], form: str = "parquet") -> None:
    """Sorted Parquet, JSON or CSV; lists become JSON text in CSV."""
    out = df.orderBy(*order)
    if form == "csv":
        out = out.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in out.dtypes])
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        getattr(out.write.mode("overwrite"), form)(path)


def write_unmatched(keys: DataFrame, found: DataFrame, on: str, path: str) -> DataFrame:
    """Keys without a match, sorted, one a line; returned too."""
    missing = keys.select(F.col(on).cast("string").alias(on)).distinct().join(found.select(F.col(on).cast("string").alias(on)), on, "left_anti").orderBy(on)
    missing.write.mode("overwrite").text(path)
    return missing


def feature_index(features: DataFrame, store: str, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, dim, reference) of stored features, by key."""
    reference = F.concat(F.lit(f"{store}::sample="), F.col(key).cast("string"))
    return features.select(key, F.size(vector).alias("dim"), reference.alias("embedding_ref")).orderBy(key)


def new_features(stored: DataFrame, incoming: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Incoming rows whose key is not stored; a dimension unlike the store's is an error where it is read."""
    dim = stored.select(F.size(vector).alias("_dim")).limit(1)
    fresh = incoming.join(stored.select(key), key, "left_anti").join(F.broadcast(dim), how="left")
    wrong = F.col("_dim").isNotNull() & (F.size(vector) != F.col("_dim"))
    return fresh.where(F.when(wrong, F.raise_error(F.lit("dimension mismatch")).cast("boolean")).otherwise(True)).drop("_dim")


def lazy_rows(df: DataFrame):
    """Rows one by one; a partition at a time reaches the driver."""
    return df.toLocalIterator(prefetchPartitions=True)
