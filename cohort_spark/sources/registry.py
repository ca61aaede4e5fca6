"""The registry: its schema, reading, validating and publishing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.functions.arrays import items, no_items, parsed_list, whole_numbers
from cohort_spark.functions.text import clean, export_split

# The core columns of the registry, in order; those in LISTS are lists of text.
CORE = [
    "sample_id", "source", "patient_id", "study_id", "split", "genomics_rna_bulk_paths", "genomics_rna_bulk_feature_path",
    "genomics_rna_bulk_file_ids", "genomics_rna_bulk_file_names", "genomics_rna_bulk_sample_types", "genomics_rna_bulk_workflow_types",
    "genomics_rna_bulk_molecular_subtype", "genomics_rna_bulk_subtype_mrna", "genomics_dna_methylation_subtype", "genomics_integrative_subtype",
    "genomics_msi_status", "genomics_rna_bulk_leukocyte_fraction", "genomics_rna_bulk_tumor_purity", "genomics_aneuploidy_score",
    "genomics_hrd_score", "genomics_rna_bulk_top_immune_cell_types", "genomics_rna_bulk_top_immune_cell_fractions", "genomics_dna_methylation_paths",
    "genomics_dna_methylation_feature_path", "genomics_cnv_paths", "genomics_cnv_feature_path", "pathology_wsi_paths", "radiology_image_paths",
    "radiology_image_modalities", "radiology_report_download_paths", "radiology_report_uri_paths", "radiology_report_series_descriptions",
    "pathology_mask_paths", "pathology_segmentation_slide_image_paths", "pathology_segmentation_overlay_paths",
    "pathology_segmentation_metadata_paths", "radiology_mask_paths", "pathology_tile_embedding_paths", "pathology_slide_embedding_paths",
    "radiology_embedding_paths", "biomarkers_text", "question", "answer",
]
LISTS = (
    "genomics_rna_bulk_paths", "genomics_rna_bulk_file_ids", "genomics_rna_bulk_file_names", "genomics_rna_bulk_sample_types",
    "genomics_rna_bulk_workflow_types", "genomics_rna_bulk_top_immune_cell_types", "genomics_rna_bulk_top_immune_cell_fractions",
    "genomics_dna_methylation_paths", "genomics_cnv_paths", "pathology_wsi_paths", "radiology_image_paths", "radiology_image_modalities",
    "radiology_report_download_paths", "radiology_report_uri_paths", "radiology_report_series_descriptions", "pathology_mask_paths",
    "pathology_segmentation_slide_image_paths", "pathology_segmentation_overlay_paths", "pathology_segmentation_metadata_paths",
    "radiology_mask_paths", "pathology_tile_embedding_paths", "pathology_slide_embedding_paths", "radiology_embedding_paths",
)
OPTIONAL_LISTS = ("radiology_mask_manifest_paths", "radiology_png_dirs", "radiology_download_paths")
OPTIONAL_INT_LISTS = ("radiology_series_slice_counts",)
SCHEMA = T.StructType([T.StructField(c, T.ArrayType(T.StringType()) if c in LISTS else T.StringType()) for c in CORE])


def with_core_columns(df: DataFrame, core: Sequence[str] = CORE, lists: Sequence[str] = LISTS) -> DataFrame:
    """Core columns first, those that are absent with their default; other columns after them."""
    have = set(df.columns)
    default = lambda c: (no_items() if c in lists else F.lit("")).alias(c)
    return df.select(*[F.col(f"`{c}`") if c in have else default(c) for c in core], *[F.col(f"`{c}`") for c in df.columns if c not in set(core)])


def normalized(df: DataFrame, core: Sequence[str] = CORE, lists: Sequence[str] = LISTS) -> DataFrame:
    """Core columns in their types: text without null, lists parsed from whatever they were."""
    wide = with_core_columns(df, core, lists)
    kinds = dict(wide.dtypes)

    def typed(c: str):
        if c in (*lists, *OPTIONAL_LISTS):
            return (items(c) if kinds[c].startswith("array") else parsed_list(F.col(c).cast("string"))).alias(c)
        if c in OPTIONAL_INT_LISTS:
            as_text = F.col(c).cast("array<string>") if kinds[c].startswith("array") else parsed_list(F.col(c).cast("string"))
            return F.coalesce(whole_numbers(as_text), no_items("bigint")).alias(c)
        if c in core:
            return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
        return F.col(f"`{c}`")

    return wide.select(*[typed(c) for c in wide.columns])


def validated(df: DataFrame, required: Sequence[str] = CORE, lists: Sequence[str] = LISTS) -> DataFrame:
    """``df`` if the required columns exist and list columns are lists, else an error; no job runs."""
    kinds = dict(df.dtypes)
    if missing := sorted(set(required) - set(kinds)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if wrong := sorted(c for c in lists if c in kinds and not kinds[c].startswith("array"))[:10]:
        raise TypeError(f"not lists: {', '.join(wrong)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_registry(spark: SparkSession, path: str, columns: Sequence[str] | None = None, split: str | None = None) -> DataFrame:
    """The normalised registry; an empty one where there is none; optionally some columns of one split."""
    df = normalized(spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA))
    df = df if split is None else df.where(F.col("split") == split)
    return df if columns is None else picked(df, columns)


def write_registry(df: DataFrame, path: str, validate: bool = True) -> None:
    """Write to ``path``; never the folder that ``df`` reads, so give each version its own."""
    (validated(df) if validate else df).write.mode("overwrite").parquet(path)


def picked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if unknown := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return df.select(*columns)


def path_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith(("_path", "_paths"))]


def export_splits(df: DataFrame, allowed: Sequence[str] | None = None, column: str = "split", default: str = "train") -> DataFrame:
    """Rows with their export split; rows outside the allowed splits go, unless nothing would stay."""
    if column not in df.columns:
        return df
    out = df.withColumn(column, export_split(column, default))
    kept = out.where(F.col(column).isin(*allowed)) if allowed else out
    return out if allowed and kept.isEmpty() else kept


def write_splits(df: DataFrame, path: str, rows_per_file: int = 1_000_000, column: str = "split") -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(column).parquet(path)


def append_manifest(spark: SparkSession, path: str, source: str, rows: int, counters: dict | None = None) -> None:
    """One JSON line about a run: UTC stamp, source, rows, counters."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")
    one = spark.createDataFrame([(source, rows, {k: str(v) for k, v in (counters or {}).items()})], "source string, rows long, counters map<string,string>")
    one.withColumn("stamp", stamp).write.mode("append").json(path)


def publish(spark: SparkSession, incoming: DataFrame, source: str, unified: str, staging: str, target: str, manifest: str) -> DataFrame:
    """Staging table, then the source's slice replaced in a new version of the registry, then the manifest."""
    from cohort_spark.operators.sets import replace_source

    write_registry(normalized(incoming), staging)
    fresh = spark.read.parquet(staging)
    write_registry(normalized(replace_source(read_registry(spark, unified), fresh, source)), target, validate=False)
    append_manifest(spark, manifest, source, fresh.count())
    return spark.read.parquet(target)


def pointers(spark: SparkSession, pointer: str) -> list[tuple[int, str]]:
    """(number, version) of all that the pointer ever named, oldest first; the last one counts, the others are backups."""
    if not exists(spark, pointer):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(pointer)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    numbers = sorted(int(n.removeprefix("to-")) for n in names if n.startswith("to-"))
    return [(n, spark.read.text(f"{pointer}/to-{n:08d}").first()[0]) for n in numbers]


def current_version(spark: SparkSession, pointer: str) -> str | None:
    known = pointers(spark, pointer)
    return known[-1][1] if known else None


def swap_version(spark: SparkSession, pointer: str, version: str, expected: int | None = None) -> str | None:
    """Point at a new version and return the one before, which stays as a backup.

    The name is written beside the pointer and put in place by one rename to the
    next number, which fails if that number is taken: a crash before it leaves
    the former version in effect, and of two writers that saw the same pointer
    one gets an error. ``expected`` is the number that the caller saw (0 for
    none); without it the newest one is taken.
    """
    known = pointers(spark, pointer)
    seen = expected if expected is not None else (known[-1][0] if known else 0)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{pointer}/{name}")
    fresh = at(f".new-{uuid.uuid4().hex}")
    store = fresh.getFileSystem(conf)
    out = store.create(fresh)
    out.write(bytearray(version.encode()))
    out.close()
    renamed(spark, fresh, at(f"to-{seen + 1:08d}"))
    before = dict(known)
    return before.get(seen)


def renamed(spark: SparkSession, source, target) -> None:
    """Rename a file; an error if the target is there."""
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    store = source.getFileSystem(spark._jsc.hadoopConfiguration())
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration()).rename(store.makeQualified(source), store.makeQualified(target), options)


def restore_version(spark: SparkSession, pointer: str, number: int) -> str:
    """Point again at an earlier version, by its number; it becomes the newest entry."""
    version = dict(pointers(spark, pointer))[number]
    swap_version(spark, pointer, version)
    return version


def is_blank(column: str, kind: str):
    """Null, NaN, blank text or an empty list; false and 0 are values."""
    c = F.col(f"`{column}`")
    if kind.startswith("array"):
        return c.isNull() | (F.size(c) == 0)
    if kind in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull() | (clean(c) == "") if kind == "string" else c.isNull()
