"""Joins: equi, fallback, cascading, semi and anti, updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.text import clean, non_blank


def expanded(rows: DataFrame, captions: DataFrame, keys: Sequence[str], default: str = "", instruction: str | None = None) -> DataFrame:
    """Rows x captions on trimmed keys; a blank instruction takes the default."""
    left, right = rows, captions
    for k in keys:
        left, right = left.withColumn(k, clean(k)), right.withColumn(k, clean(k))
    out = left.join(right, list(keys))
    return out.withColumn(instruction, F.coalesce(non_blank(instruction), F.lit(default))) if instruction else out


def with_fallback(cases: DataFrame, links: DataFrame, case: str, patient: str, value: str, name: str) -> DataFrame:
    """Each case's sorted distinct values: by case id, only without an entry there by patient id, else none.

    Both sides are aggregated before their join, so a case is one row throughout.
    """
    listed = F.array_sort(F.collect_set(value))
    by_case = links.where(F.col(case).isNotNull()).groupBy(case).agg(listed.alias("_by_case"))
    by_patient = links.where(F.col(patient).isNotNull()).groupBy(patient).agg(listed.alias("_by_patient"))
    out = cases.join(by_case, case, "left").join(by_patient, patient, "left")
    kind = f"array<{dict(links.dtypes)[value]}>"
    return out.withColumn(name, F.coalesce("_by_case", "_by_patient", F.array().cast(kind))).drop("_by_case", "_by_patient")


def annotated(cases: DataFrame, tables: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins of one-row-a-key tables; absent text becomes empty."""
    out = cases
    for table, key in tables:
        added = [c for c in table.columns if c != key]
        out = out.join(table, key, "left")
        texts = {c: F.coalesce(F.col(c), F.lit("")) for c, t in table.dtypes if c in added and t == "string"}
        out = out.withColumns(texts) if texts else out
    return out


def looked_up(key: Column, table: dict, default=None) -> Column:
    """Value of a small literal map."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, key), F.lit(default))


def matched_features(cases: DataFrame, case: str, paths: DataFrame, features: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Each case's aligned lists of features, ranked and distinct; without a match it keeps its own.

    ``paths`` is (case, stem), ``features`` (stem, path, valid, patch_count).
    Invalid files match nothing. ``order`` ranks the joined rows.
    """
    joined = paths.join(features.where("valid"), "stem").withColumn("_rank", F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    first = joined.groupBy(case, "path").agg(F.min("_rank").alias("_rank"), F.min_by("patch_count", "_rank").alias("patch_count"))
    ranked = first.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("_rank", "path", "patch_count"))).alias("_found"))
    out = cases.join(ranked, case, "left")
    return out.withColumns({"feature_paths": F.coalesce(F.col("_found.path"), F.array().cast("array<string>")), "patch_counts": F.coalesce(F.col("_found.patch_count"), F.array().cast("array<bigint>"))}).drop("_found")


def cascaded(refs: DataFrame, table: DataFrame, ref: str, keys: Sequence[str], value: str) -> DataFrame:
    """``refs`` with ``value`` from the first of several alternative keys that matches."""
    options = None
    for i, k in enumerate(keys):
        part = table.where(F.col(k).isNotNull()).select(F.col(k).alias(ref), F.lit(i).alias("_prio"), F.col(value).alias(value))
        options = part if options is None else options.union(part)
    best = options.groupBy(ref).agg(F.min(F.struct("_prio", value)).alias("_best"))
    return refs.join(best.select(ref, F.col(f"_best.{value}").alias(value)), ref, "left")


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """``df``, or an error that lists up to ten duplicated non-blank keys."""
    twice = [r[0] for r in df.where(non_blank(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(key).limit(10).collect()]
    if twice:
        raise ValueError(f"duplicate keys: {twice}")
    return df


def matched_and_lost(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched rows, left rows without a match, right rows without one)."""
    return left.join(right, key), left.join(right, key, "left_anti"), right.join(left, key, "left_anti")


def in_cohort(df: DataFrame, cohort: DataFrame, key: str) -> DataFrame:
    return df.join(cohort, key, "left_semi")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done, key, "left_anti")


def resolved_ids(candidates: DataFrame, files: DataFrame, key: str, name: str, ids: str) -> DataFrame:
    """``candidates`` (key, name, ids) with the id whose file has exactly that name.

    Several matches give the smallest; no match gives a single id itself; else null.
    """
    each = candidates.select(key, name, F.explode(ids).alias("file_id")).join(files.select("file_id", F.col("file_name").alias("_name")), "file_id", "left")
    hit = each.groupBy(key).agg(F.min(F.when(F.col("_name") == F.col(name), F.col("file_id"))).alias("_hit"))
    single = F.when(F.size(ids) == 1, F.element_at(ids, 1))
    return candidates.join(hit, key, "left").withColumn("file_id", F.coalesce("_hit", single)).drop("_hit")


def updated(table: DataFrame, changes: DataFrame, key: str, column: str, keep: bool = False) -> DataFrame:
    """``table`` with ``column`` from ``changes``; with ``keep`` non-blank values stay. Column ``outcome`` says what happened."""
    out = table.join(changes.select(key, F.col(column).alias("_new")), key, "left")
    hold = F.lit(keep) & non_blank(column).isNotNull()
    outcome = F.when(F.col("_new").isNull(), "unmatched").when(hold, "skipped").otherwise("updated")
    return out.withColumn("outcome", outcome).withColumn(column, F.when(F.col("outcome") == "updated", F.col("_new")).otherwise(F.col(column))).drop("_new")


def variants(cases: DataFrame, n: int, prompts: Sequence[str]) -> DataFrame:
    """Every case ``n`` times, with variant 0.. and its prompt in turn."""
    texts = F.array(*[F.lit(p) for p in prompts])
    return cases.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("prompt", F.element_at(texts, F.col("variant") % len(prompts) + 1))


def written_back(full: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """``full`` with the rows of ``part`` written over theirs by key; its new columns are null elsewhere."""
    own = [c for c in full.columns if c != key]
    new = [c for c in part.columns if c not in full.columns]
    changed = [c for c in own if c in part.columns]
    other = part.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in changed], *new)
    out = full.join(other, key, "left")
    return out.select(key, *[(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) if c in changed else F.col(c)).alias(c) for c in own], *new)


def list_or(first: str, second: str) -> Column:
    """The first list unless it is empty."""
    return F.when(F.coalesce(F.size(first), F.lit(0)) > 0, F.col(first)).otherwise(F.col(second))


def with_measure(df: DataFrame, measures: DataFrame, path: str, measure: str) -> DataFrame:
    """``df`` with a per-file measure: its own non-null value, else that of its path, looked up once a path."""
    found = df.select(path).distinct().join(measures.select(path, F.col(measure).alias("_found")), path)
    return df.join(found, path, "left").withColumn(measure, F.coalesce(measure, "_found")).drop("_found")


def first_existing(df: DataFrame, key: str, refs: str, files: DataFrame, name: str = "found") -> DataFrame:
    """``df`` with the first listed reference that is in the inventory, null if none is."""
    each = df.select(key, F.posexplode(refs).alias("_pos", "path")).join(files.select("path"), "path", "left_semi")
    return df.join(each.groupBy(key).agg(F.min_by("path", "_pos").alias(name)), key, "left")


def dereferenced(refs: DataFrame, features: DataFrame, on: Sequence[str]) -> DataFrame:
    """The stored rows of each reference, by its parsed parts."""
    return refs.join(features, list(on))
