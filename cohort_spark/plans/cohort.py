"""Whole flows: training sets, registry rows from documents, series registration, sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.functions.arrays import unique
from cohort_spark.functions.text import clean, row_id, sample_id, slide_kind, split_alias, split_group, assigned_split
from cohort_spark.operators.aggregates import bucketed, collected, mean_vectors
from cohort_spark.operators.joins import expanded
from cohort_spark.operators.projection import allowed, quantile_band, without_normal_tissue
from cohort_spark.operators.windows import evenly_spaced, positioned, strided


def training_set(
    registry: DataFrame,
    captions: DataFrame,
    features: DataFrame,
    kinds: Sequence[str] = (),
    normal_source: str | None = None,
    low: float | None = None,
    high: float | None = None,
    done: DataFrame | None = None,
) -> DataFrame:
    """Slides x captions of each case, with the registry's split.

    Slides are exploded, kept by kind and feature, joined with captions on
    trimmed (source, sample_id), cleared of one source's normal tissue, kept
    within patch-count quantiles, and cleared of finished row ids.
    """
    slides = registry.select("source", "sample_id", "split", F.explode("slides").alias("stem"))
    slides = allowed(slides.withColumn("kind", slide_kind("stem")), "kind", list(kinds)).join(features, "stem")
    rows = expanded(slides, captions.drop("split"), ["source", "sample_id"])
    if normal_source is not None:
        rows = without_normal_tissue(rows, "stem", "source", normal_source)
    rows = quantile_band(rows, "patches", low, high)
    rows = rows.withColumn("row_id", row_id(("sample", "sample_id"), ("slide", "stem"), suffix=F.concat(F.lit("caption-"), F.col("i").cast("string"))))
    return rows if done is None else rows.join(done, "row_id", "left_anti")


def split_mismatches(registry: DataFrame, captions: DataFrame) -> DataFrame:
    """One row: caption rows whose split, after aliases, is not the registry's."""
    theirs = captions.select("source", "sample_id", F.col("split").alias("caption_split"))
    both = expanded(registry.select("source", "sample_id", "split"), theirs, ["source", "sample_id"])
    return both.agg(F.count_if(split_alias("split") != split_alias("caption_split")).alias("mismatches"))


def registry_rows(cases: DataFrame, files: DataFrame, source: str, ratios: dict | None = None) -> DataFrame:
    """Registry rows of case documents with their files.

    ``cases`` is (case_id, patient_id, project_id, study_id), ``files`` (case_id,
    path, kind). Lists are aggregated before the join, so cases are never multiplied.
    """
    lists = files.groupBy("case_id").agg(collected("path").alias("paths"), collected("kind").alias("kinds"))
    out = cases.join(lists, "case_id", "left").withColumn("source", F.lit(source))
    for c in ("paths", "kinds"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    out = out.withColumn("split_group_id", split_group("source", "project_id", "patient_id"))
    return out.withColumns({"sample_id": sample_id("source", "patient_id", "study_id", F.lit("case")), "split": assigned_split("split_group_id", ratios)})


def caption_registry(captions: DataFrame, source: str) -> DataFrame:
    """One registry row a sample from its captions: the first row's fields, the group id, the united lists."""
    first = F.min_by(F.struct("split", "project", "paths"), "seq")
    out = captions.groupBy(clean("sample_id").alias("sample_id")).agg(first.alias("f"))
    return out.select("sample_id", F.lit(source).alias("source"), split_alias("f.split").alias("split"), split_group(F.lit(source), "f.project", "sample_id").alias("split_group_id"), unique("f.paths").alias("paths"))


def compressed(features: DataFrame, slide: str, method: str = "none", k: int = 1, most: int | None = None, vector: str = "embedding", position: str = "row_idx") -> DataFrame:
    """A slide's sequence compressed (none, mean_pool, stride) and then capped evenly.

    Pooled rows keep their bucket (bucket_x, bucket_y), which orders them.
    """
    if method not in ("none", "mean_pool", "stride"):
        raise ValueError(f"unknown method {method}")
    out, order = features, [position]
    if method == "stride" and k > 1:
        out = strided(features, slide, k, position)
    elif method == "mean_pool" and k > 1:
        order = ["bucket_x", "bucket_y"]
        out = mean_vectors(bucketed(features, slide, k, position=position), [slide, *order], vector)
    if not most:
        return out
    return evenly_spaced(positioned(out, [slide], order, "_at"), slide, most, "_at").drop("_at")


def assembled(rows: DataFrame, features: DataFrame, row: str, refs: str, slide: str, method: str = "none", k: int = 1, most: int | None = None, vector: str = "embedding", position: str = "row_idx") -> DataFrame:
    """(row, ref_pos, ref, token, vector): each row's sequence, its references' sequences one behind the other.

    ``refs`` lists a row's references (slides), blank ones skipped. Each slide
    that is named is compressed and capped once, for however many rows name it,
    then its tokens are numbered; a row's token is that number after the tokens
    of its earlier references, whose counts alone meet in the row. A reference
    without features adds nothing; a row without any has no tokens. A reference
    that a row names twice comes twice.
    """
    each = rows.select(row, F.posexplode(refs).alias("ref_pos", "_ref")).select(row, "ref_pos", clean("_ref").alias("ref")).where("ref <> ''")
    asked = each.select(F.col("ref").alias("_asked")).distinct()
    own = features.withColumn("_own", clean(F.col(slide).cast("string"))).join(asked, F.col("_own") == F.col("_asked"), "left_semi")
    short = compressed(own.drop(slide).withColumnRenamed("_own", "ref"), "ref", method, k, most, vector, position)
    order = ["bucket_x", "bucket_y"] if method == "mean_pool" and k > 1 else [position]
    numbered = positioned(short, ["ref"], order, "_at").select("ref", "_at", vector)
    sizes = numbered.groupBy("ref").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(row).orderBy("ref_pos")) - F.col("_n")
    placed = each.join(sizes, "ref").withColumn("_before", earlier)
    return placed.join(numbered, "ref").select(row, "ref_pos", "ref", (F.col("_before") + F.col("_at")).alias("token"), vector)
