"""Aggregations per case, patient, series, slide and table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.functions.arrays import gcd_of
from cohort_spark.functions.text import decimals_text, frames, header_words, image_reject_reason, is_derived, is_localizer, is_secondary_capture, non_blank
from cohort_spark.operators.quantiles import quantiles


def collected(c) -> Column:
    """Sorted distinct non-blank values of a group."""
    return F.array_sort(F.collect_set(non_blank(c)))


def first_seen(df: DataFrame, keys: Sequence[str], value: str, position: str, name: str, separator: str | None = None) -> DataFrame:
    """(keys, name): each group's distinct values in the order of their first position; ties by value, none for nulls alone.

    Repeats are merged before a group's values meet in one list.
    """
    each = df.groupBy(*keys, value).agg(F.min(position).alias("_p"))
    pairs = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col("_p").alias("p"), F.col(value).alias("v")))))
    out = F.transform(pairs, lambda x: x["v"])
    return each.groupBy(*keys).agg((F.array_join(out, separator) if separator else out).alias(name))


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each group the row with the smallest order."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in df.columns if c not in keys]), rank).alias("_r")).select(*keys, "_r.*")


def case_assignments(manifest: DataFrame, order: Column) -> DataFrame:
    """Per (project, patient): sorted raw paths, the canonical feature and how many there are.

    ``order`` is the sample's rank; ties go by sample, file id and path. Groups
    without a feature go.
    """
    has = non_blank("feature_path")
    rank = F.struct(order.alias("code"), F.col("sample").alias("sample"), F.col("file_id").alias("file_id"), has.alias("path"))
    grouped = manifest.where(non_blank("patient").isNotNull()).groupBy("project", "patient")
    out = grouped.agg(collected("raw_path").alias("raw_paths"), F.min(F.when(has.isNotNull(), rank)).alias("_best"), F.count(has).alias("features"))
    return out.where("features > 0").select("project", "patient", "raw_paths", F.col("_best.path").alias("feature_path"), F.col("_best.sample").alias("selected_sample"), "features")


def series_verdict(
    images: DataFrame,
    series: str = "series_dir",
    least_usable: int = 1,
    most_rejected: float = 0.5,
    derived: bool = True,
    multiframe: bool = True,
    file: str | None = None,
    directories: DataFrame | None = None,
    **image_rules,
) -> DataFrame:
    """Per series: counts, distinct values joined with ``;``, and the first reason to reject it with details, or nulls.

    Reasons of rejected images are listed by count, ties by the first file that
    has them (``file`` orders them, else the reason does). Series of
    ``directories`` (series) without any image are empty directories; without
    that table only series with images are judged.
    """
    named = images.withColumn("_words", header_words())
    named = named.withColumn("_reason", image_reject_reason(multiframe=multiframe, derived=derived, words="_words", **image_rules)).withColumn("_readable", F.coalesce("readable_dicom", F.lit(False)))
    readable = F.col("_readable")
    values = lambda c: F.array_sort(F.collect_set(F.when(readable, non_blank(c))))
    counts = named.groupBy(series).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if("_readable").alias("readable"),
        F.count("_reason").alias("rejected"),
        F.count_if(readable & F.col("_reason").isNull()).alias("usable"),
        F.count_if(readable & is_localizer("_words")).alias("localizers"),
        F.count_if(readable & is_secondary_capture()).alias("captures"),
        F.count_if(readable & (frames() > 1)).alias("multiframes"),
        F.count_if(readable & is_derived("_words")).alias("deriveds"),
        values("modality").alias("modalities"),
        values("series_instance_uid").alias("series_uids"),
        values("series_description").alias("descriptions"),
        values("protocol_name").alias("protocols"),
    )
    listed = reason_histogram(named, [series], "_reason", file or "_reason").toDF("_series", "_reasons")
    counts = counts.join(listed, F.col(series).eqNullSafe(F.col("_series")), "left").drop("_series")
    if directories is not None:
        every = directories.select(F.col(series).alias("_series")).distinct()
        counts = counts.join(every, F.col(series).eqNullSafe(F.col("_series")), "full").withColumn(series, F.coalesce(series, "_series")).drop("_series")
        counts = counts.fillna(0, ["total_files", "readable", "rejected", "usable"])
    joined = {c: F.coalesce(F.array_join(c, ";"), F.lit("")) for c in ("modalities", "series_uids", "descriptions", "protocols")}
    n, share, reasons = F.col("readable"), F.col("rejected") / F.greatest("readable", F.lit(1)), F.coalesce("_reasons", F.lit(""))
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    all_are = lambda kind: said("all ", n, f" readable images are {kind}")
    cascade = [
        (F.col("total_files") == 0, "empty_directory", F.lit("no files")),
        (n == 0, "no_readable_dicom_files", said("none of ", F.col("total_files"), " files is readable")),
        (F.size("modalities") > 1, "mixed_modality_in_directory", said("modalities: ", joined["modalities"])),
        (F.size("series_uids") > 1, "mixed_series_instance_uid_in_directory", said("series uids: ", joined["series_uids"])),
        (F.col("localizers") == n, "series_is_localizer_or_scout", all_are("localizers")),
        (F.col("captures") == n, "series_is_secondary_capture", all_are("secondary captures")),
        (F.lit(multiframe) & (F.col("multiframes") == n), "series_is_multiframe", all_are("multiframe")),
        (F.lit(derived) & (F.col("deriveds") == n), "series_is_derived_or_reformatted", all_are("derived")),
        (F.col("usable") == 0, "all_images_rejected", said("reasons: ", reasons)),
        (F.col("usable") < least_usable, "too_few_usable_images", said(F.col("usable"), f" usable, at least {least_usable} needed")),
        (share > most_rejected, "rejected_fraction_too_high", said(F.col("rejected"), " of ", n, " rejected (", decimals_text(share, 3), f"), at most {most_rejected:.3f}; reasons: ", reasons)),
    ]
    first = F.coalesce(*[F.when(holds, F.struct(F.lit(reason).alias("reason"), detail.alias("details"))) for holds, reason, detail in cascade])
    judged = counts.withColumn("_first", first).withColumn("reject_reason", F.col("_first.reason")).withColumn("reject_details", F.col("_first.details"))
    return judged.withColumns(joined).drop("localizers", "captures", "multiframes", "deriveds", "_first", "_reasons")


def series_details(images: DataFrame, verdicts: DataFrame, series: str, file: str, fields: Sequence[str]) -> DataFrame:
    """One nested object a series: its verdict's columns and ``images``, its files in order with the named fields; a series without images has none."""
    listed = images.groupBy(F.col(series).alias("_series")).agg(F.array_sort(F.collect_list(F.struct(file, *fields))).alias("images"))
    out = verdicts.join(listed, F.col(series).eqNullSafe(F.col("_series")), "left").drop("_series")
    return out.withColumn("images", F.coalesce("images", F.array().cast(listed.schema["images"].dataType)))


def directory_verdict(files: DataFrame, archive: str, directory: str) -> DataFrame:
    """Per archive: none, one or several candidate directories."""
    n = F.count_distinct(directory)
    return files.groupBy(archive).agg(n.alias("directories"), F.when(n == 0, "no_directory").when(n == 1, "ok").otherwise("several_directories").alias("verdict"))


def reason_histogram(df: DataFrame, keys: Sequence[str], reason: str, position: str) -> DataFrame:
    """Per group ``reason:count, ...``, most first, ties by first seen."""
    counts = df.where(F.col(reason).isNotNull()).groupBy(*keys, reason).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "p", F.col(reason).alias("r"))))
    return counts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["r"], F.lit(":"), (-x["minus"]).cast("string"))), ", ").alias("reasons"))


def reference_audit(df: DataFrame, source: str, columns: Sequence[str], files: DataFrame, examples: int = 5) -> DataFrame:
    """Per source and path column: rows with references, references, local, URI, existing, missing, distinct missing, examples.

    ``columns`` hold lists. References are exploded once and meet the inventory
    (path) by a left join. Examples are the first missing paths by name.
    """
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("refs")) for c in columns]))
    rows = df.select(F.monotonically_increasing_id().alias("_row"), source, named.alias("_c")).select("_row", source, "_c.column", F.explode_outer("_c.refs").alias("ref"))
    known = files.select(F.col("path").alias("_path")).distinct()
    is_uri = F.col("ref").contains("://")
    joined = rows.join(known, F.col("ref") == F.col("_path"), "left").withColumn("_local", F.col("ref").isNotNull() & ~is_uri)
    missing = F.col("_local") & F.col("_path").isNull()
    by_name = Window.partitionBy(source, "column").orderBy("ref")
    first = joined.where(missing).select(source, "column", "ref").distinct().withColumn("_k", F.row_number().over(by_name)).where(F.col("_k") <= examples)
    first = first.groupBy(F.col(source).alias("_source"), F.col("column").alias("_column")).agg(F.array_sort(F.collect_list("ref")).alias("_examples"))
    counts = joined.groupBy(source, "column").agg(
        F.count_distinct(F.when(F.col("ref").isNotNull(), F.col("_row"))).alias("rows_with_refs"),
        F.count("ref").alias("refs"),
        F.count_if("_local").alias("local"),
        F.count_if(is_uri).alias("uri"),
        F.count_if(F.col("_local") & F.col("_path").isNotNull()).alias("existing"),
        F.count_if(missing).alias("missing"),
        F.count_distinct(F.when(missing, F.col("ref"))).alias("unique_missing"),
    )
    both = counts.join(first, F.col(source).eqNullSafe(F.col("_source")) & (F.col("column") == F.col("_column")), "left")
    return both.withColumn("examples", F.coalesce("_examples", F.array().cast("array<string>"))).drop("_source", "_column", "_examples")


def split_counts(df: DataFrame, column: str = "split") -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("")).alias(column)).agg(F.count(F.lit(1)).alias("rows")).orderBy(column)


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of named counts, by one aggregate."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def distribution(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    """Per group: count, mean, population deviation, quartiles and the shares below, between and above two bounds; finite values only."""
    v = F.col(value)
    ok = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    share = lambda c: F.avg(c.cast("int"))
    counts = ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("sd"),
        share(v < low).alias("below"),
        share(v.between(low, high)).alias("between"),
        share(v > high).alias("above"),
    )
    ranked = quantiles(ok, keys, value, [0.25, 0.5, 0.75]).toDF(*[f"_{i}" for i in range(len(keys))], "_q")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return counts.join(ranked, same).select(*keys, "n", "mean", "sd", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"), "below", "between", "above")


def merged_records(df: DataFrame, key: str, fields: Sequence[str], source: str) -> DataFrame:
    """One record a key with its sources united and sorted; records of a key that differ are an error where they are read."""
    same = F.count_distinct(F.struct(*fields))
    out = df.groupBy(key).agg(same.alias("_n"), F.first(F.struct(*fields)).alias("_f"), collected(source).alias("sources"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("records differ: "), F.col(key).cast("string"))).cast("boolean")).otherwise(True)
    return out.where(ok).select(key, "_f.*", "sources")


def collisions(df: DataFrame, target: str, key: str) -> DataFrame:
    """Targets that more than one key maps to."""
    return df.groupBy(target).agg(F.count_distinct(key).alias("keys")).where("keys > 1")


def coordinate_step(df: DataFrame, slide: str, x: str = "x", y: str = "y") -> DataFrame:
    """(slide, step): the greatest common divisor of all gaps between sorted distinct x and between sorted distinct y, null without gaps."""
    axes = df.select(slide, F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col(x).alias("v")), F.struct(F.lit(1).alias("axis"), F.col(y).alias("v")))).alias("a")).select(slide, "a.*").distinct()
    gap = F.col("v") - F.lag("v").over(Window.partitionBy(slide, "axis").orderBy("v"))
    return axes.withColumn("gap", gap).groupBy(slide).agg(gcd_of(F.collect_set("gap")).alias("step"))


def bucketed(df: DataFrame, slide: str, k: int, x: str = "x", y: str = "y", position: str = "row_idx") -> DataFrame:
    """``df`` with (bucket_x, bucket_y): k x k grid cells from the smallest coordinates.

    Without gaps, buckets are runs of k * k rows by position: (run, 0).
    """
    origin = df.groupBy(slide).agg(F.min(x).alias("_x0"), F.min(y).alias("_y0")).join(coordinate_step(df, slide, x, y), slide)
    out = df.join(origin, slide)
    cell = lambda c, o: F.floor(F.floor((F.col(c) - F.col(o)) / F.col("step")) / k)
    run = F.floor(F.col(position) / (k * k))
    return out.withColumn("bucket_x", F.coalesce(cell(x, "_x0"), run)).withColumn("bucket_y", F.when(F.col("step").isNull(), F.lit(0).cast("long")).otherwise(cell(y, "_y0"))).drop("_x0", "_y0", "step")


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean vector of each group; vectors are summed whole where they are read, so a group costs a vector a task.

    Null vectors do not count; a null component makes its group's mean NaN
    there; vectors of a group that differ in length are an error.
    """
    dense = array_to_vector(F.transform(vector, lambda x: F.coalesce(x.cast("double"), F.lit(float("nan")))))
    out = df.where(F.col(vector).isNotNull()).groupBy(*keys).agg(Summarizer.mean(dense).alias("_m"))
    return out.select(*keys, vector_to_array("_m").alias(vector))


def spatial_mean_pool(df: DataFrame, slide: str, k: int, vector: str = "embedding", **named) -> DataFrame:
    return mean_vectors(bucketed(df, slide, k, **named), [slide, "bucket_x", "bucket_y"], vector)


def contiguous_mean_pool(df: DataFrame, slide: str, size: int, vector: str = "embedding", position: str = "row_idx") -> DataFrame:
    """Mean of each run of ``size`` rows; the last may be shorter."""
    return mean_vectors(df.withColumn("run", F.floor(F.col(position) / size)), [slide, "run"], vector)


def label_histogram(df: DataFrame, slide: str, label: str) -> DataFrame:
    """Per slide a map label -> count and the share of labels over 0."""
    counts = df.groupBy(slide, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(slide).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(label, "n")))).alias("histogram"),
        (F.sum(F.when(F.col(label) > 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("foreground"),
    )


def gene_flags(df: DataFrame, genes: str, panel: Sequence[str], observed: str) -> DataFrame:
    """A boolean column for each gene of the panel; null everywhere where nothing was observed."""
    return df.withColumns({f"mutation_{g.lower()}": F.when(F.col(observed), F.array_contains(genes, g)) for g in panel})


def modalities_by_path(df: DataFrame, key: str, path: str, modality: str, position: str) -> DataFrame:
    """Per key two aligned lists: sorted paths and their modalities, first seen first, joined by a bar."""
    each = first_seen(df, [key, path], modality, position, "m", "|")
    pairs = F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), "m")))
    return each.groupBy(key).agg(pairs.alias("_p")).select(key, F.col("_p.p").alias("paths"), F.col("_p.m").alias("modalities"))


def grouped_records(df: DataFrame, patient: str, unique: str, fields: Sequence[str]) -> DataFrame:
    """Per patient its records, one a unique id, sorted; blank patients go. Of several records of an id the smallest by its fields stays."""
    least = F.min(F.struct(*fields)).alias("_r")
    kept = df.where(non_blank(patient).isNotNull()).groupBy(patient, unique).agg(least).select(patient, unique, "_r.*")
    return kept.groupBy(patient).agg(F.array_sort(F.collect_list(F.struct(unique, *fields))).alias("records"))


def driver_panel(first: DataFrame, second: DataFrame, kind: str, gene: str, q: str, both: float = 0.05, alone: float = 0.01) -> DataFrame:
    """(kind, panel): genes with q at most ``both`` in both tables, else those of the first at most ``alone``."""
    shared = first.where(F.col(q) <= both).select(kind, gene).join(second.where(F.col(q) <= both).select(kind, gene), [kind, gene], "left_semi")
    strict = first.where(F.col(q) <= alone).select(kind, gene).join(shared.select(kind).distinct(), kind, "left_anti")
    return shared.union(strict).groupBy(kind).agg(F.array_sort(F.collect_set(gene)).alias("panel"))


def usable_masks(df: DataFrame, mask: str, label: str, least: int = 1) -> DataFrame:
    """Masks with enough labelled pixels, at least one."""
    return df.groupBy(mask).agg(F.count_if(F.col(label) > 0).alias("pixels")).where(F.col("pixels") >= max(1, least))


def legacy_captions(slides: DataFrame, keys: Sequence[str], caption: str, reports: str, position: str) -> DataFrame:
    """Slide rows to case captions: distinct captions in order, numbered, with the group's report paths."""
    paths = slides.select(*keys, position, F.posexplode_outer(reports).alias("_i", "_path")).withColumn("_o", F.struct(position, "_i"))
    united = first_seen(paths, keys, "_path", "_o", reports)
    own = slides.where(non_blank(caption).isNotNull()).groupBy(*keys, caption).agg(F.min(position).alias("_p"))
    numbered = own.withColumn("variant", F.row_number().over(Window.partitionBy(*keys).orderBy("_p", caption)) - 1).drop("_p")
    return numbered.join(united, list(keys))
