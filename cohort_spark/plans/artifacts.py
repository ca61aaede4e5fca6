"""Work on artifacts of cases: candidates, rebuilt path lists, keyword maps, index records."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.functions.text import clean, non_blank, path_hash, slide_kind


def first_matching_column(columns: Sequence[str], patterns: Sequence[str]) -> str | None:
    """The first column that contains one of the ordered patterns, whatever the case."""
    for p in patterns:
        for c in columns:
            if p.lower() in c.lower():
                return c
    return None


def slide_candidates(cases: DataFrame, case: str, slides: str, done: DataFrame, files: DataFrame, sources: Sequence[str], kinds: Sequence[str] = ()) -> DataFrame:
    """(case, path, kind, state) of the allowed slides that are not done.

    ``state`` is local where the inventory has the path, unsupported_source for
    other sources, missing_ids without ids, else remote. ``cases`` has source and ids.
    """
    each = cases.select(case, "source", "ids", F.explode(slides).alias("path")).withColumn("kind", slide_kind("path"))
    each = each.where(F.col("kind").isin(*kinds)) if kinds else each
    each = each.join(done, [case, "path"], "left_anti").join(files.select("path", F.lit(True).alias("_here")), "path", "left")
    state = F.when(F.col("_here"), "local").when(~F.col("source").isin(*sources), "unsupported_source")
    return each.withColumn("state", state.when(F.coalesce(F.size("ids"), F.lit(0)) == 0, "missing_ids").otherwise("remote")).select(case, "path", "kind", "state")


def rebuilt_paths(cases: DataFrame, case: str, slides: str, files: DataFrame, build: Callable[[Column], Column], ready: Callable[[Column], Column] | None = None) -> DataFrame:
    """(case, paths): the artifacts of a case's slides that exist, in slide order, distinct.

    ``build`` gives an artifact's path from a slide's, ``ready`` may refuse
    inventory rows by their size; both are column expressions.
    """
    have = files.where(ready(F.col("size"))) if ready else files
    each = cases.select(case, F.posexplode(slides).alias("_p", "_s")).withColumn("path", build(F.col("_s"))).join(have.select("path"), "path", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_p", "path"))), lambda x: x["path"])
    out = cases.select(case).join(each.groupBy(case).agg(F.array_distinct(ordered).alias("paths")), case, "left")
    return out.withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def keyword_table(spark: SparkSession, nested: Mapping[str, Mapping[str, Sequence[str]]]) -> DataFrame:
    """(collection, modality, keywords): distinct non-blank keywords in order, from a nested mapping."""
    rows = [(c, m, list(dict.fromkeys(k.strip() for k in ks if k.strip()))) for c, by in nested.items() for m, ks in by.items()]
    return spark.createDataFrame(rows, "collection string, modality string, keywords array<string>")


def with_keywords(series: DataFrame, table: DataFrame) -> DataFrame:
    """``series`` with the keywords of its (collection, modality), none if the map has no entry; the map is a configuration, hence small."""
    out = series.join(F.broadcast(table), ["collection", "modality"], "left")
    return out.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def index_records(rows: DataFrame, root: str, nested: str = "file") -> DataFrame:
    """(sample, file_id, path, hash) of rows whose nested record has a path; relative paths are rooted."""
    path = clean(f"{nested}.path")
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    out = rows.where(F.col(nested).isNotNull() & non_blank(f"{nested}.path").isNotNull())
    return out.select(clean("sample").alias("sample"), clean(f"{nested}.id").alias("file_id"), rooted.alias("path")).withColumn("hash", path_hash("path"))


def linked_samples(cases: str) -> Column:
    """Distinct sample types of all linked cases, in order."""
    return F.array_distinct(F.filter(F.flatten(F.transform(cases, lambda c: F.transform(c["samples"], lambda s: clean(s["sample_type"])))), lambda x: x != ""))


def first_linked(cases: str) -> Column:
    """The first linked case that has an id."""
    return F.try_element_at(F.filter(cases, lambda c: (clean(c["case_id"]) != "") | (clean(c["submitter_id"]) != "")), F.lit(1))
