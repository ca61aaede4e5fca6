"""Projections and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.text import boolean, clean, col, number
from cohort_spark.operators.quantiles import quantiles
from cohort_spark.sources.registry import is_blank


def typed_manifest(df: DataFrame, lists: Sequence[str] = (), texts: Sequence[str] = (), flags: Sequence[str] = (), counts: Sequence[str] = ()) -> DataFrame:
    """Columns of a series manifest in their types: flags from words, counts with default 0."""
    have = set(df.columns)
    value = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    new = {c: F.coalesce(value(c).cast("array<string>") if c in have else F.lit(None).cast("array<string>"), F.array().cast("array<string>")) for c in lists}
    new |= {c: clean(value(c)) for c in texts} | {c: boolean(value(c)) for c in flags}
    new |= {c: F.coalesce(number(value(c)).cast("int"), F.lit(0)) for c in counts}
    return df.withColumns(new)


def allowed(df: DataFrame, column: str, values: Sequence[str] | None) -> DataFrame:
    """Rows whose value is listed; no list means all."""
    return df.where(F.col(column).isin(*values)) if values else df


def chosen(found: DataFrame, column: str, explicit: Sequence[str] | None = None, excluded: Sequence[str] = ()) -> DataFrame:
    """Distinct values: the explicit ones or all that were found, without the excluded."""
    out = allowed(found.select(column).distinct(), column, explicit)
    return out.where(~F.col(column).isin(*excluded)) if excluded else out


def having(df: DataFrame, column: str) -> DataFrame:
    """Rows with a non-empty list or non-blank text."""
    kind = dict(df.dtypes)[column]
    return df.where(F.size(column) > 0) if kind.startswith("array") else df.where(clean(column) != "")


def with_existing(df: DataFrame, refs: str, files: DataFrame, key: str) -> DataFrame:
    """Rows of which at least one listed reference is in the inventory (path); distinct ``key``."""
    each = df.select(key, F.explode(refs).alias("path"))
    return df.join(each.join(files.select("path"), "path", "left_semi").select(key).distinct(), key, "left_semi")


def without_normal_tissue(df: DataFrame, stem: str, source: str, of: str) -> DataFrame:
    """Rows of one source whose stem has a sample type that starts with 11 go; other sources stay."""
    code = F.regexp_extract(F.upper(F.coalesce(col(stem), F.lit(""))), "-([0-9]{2})[A-Z]?(?:-|$)", 1)
    return df.where(~(F.col(source).eqNullSafe(of) & code.startswith("11")))


def quantile_band(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows within the exact, interpolated quantiles, inclusive; a missing bound is the extreme; nulls go if there is a bound."""
    if low is None and high is None:
        return df
    bounds = quantiles(df, [], column, [low or 0.0, 1.0 if high is None else high]).withColumnRenamed("quantiles", "_b")
    return df.join(F.broadcast(bounds)).where(F.col(column).between(F.col("_b")[0], F.col("_b")[1])).drop("_b")


def without_signature(df: DataFrame, texts: DataFrame, key: str, text: str, signatures: Sequence[str]) -> DataFrame:
    """Rows without those of which any text holds a signature (lower-cased); blank texts hold none."""
    held = F.lit(False)
    for s in signatures:
        held = held | F.lower(text).contains(s)
    return df.join(texts.where(held).select(key).distinct(), key, "left_anti")


def work_list(df: DataFrame, accepted: str, inputs: str, done: str, overwrite: bool = False) -> DataFrame:
    """Accepted rows with inputs that are not done yet, or all of those to overwrite."""
    ready = df.where(F.col(accepted) & (F.size(inputs) > 0))
    return ready if overwrite else ready.where(~F.coalesce(done, F.lit(False)))


def routed(df: DataFrame, column: str, reports: Sequence[str] = ("SR",), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows by modality: included, not excluded, and ``route`` report or image."""
    out = allowed(df, column, include)
    out = out.where(~F.col(column).isin(*exclude)) if exclude else out
    return out.withColumn("route", F.when(F.col(column).isin(*reports), "report").otherwise("image"))


def split_rows(df: DataFrame, split: str, column: str = "split", blank: str = "train") -> DataFrame:
    return df.where(F.lower(F.trim(F.coalesce(F.col(column), F.lit(blank)))) == split)


def reset(df: DataFrame, mask: Column, columns: Sequence[str]) -> DataFrame:
    """Columns of the masked rows back to their defaults."""
    kinds = dict(df.dtypes)
    default = lambda c: F.array().cast(kinds[c]) if kinds[c].startswith("array") else (F.lit("") if kinds[c] == "string" else F.lit(None).cast(kinds[c]))
    return df.withColumns({c: F.when(mask, default(c)).otherwise(F.col(c)) for c in columns})


def without_empty_columns(df: DataFrame, candidates: Sequence[str]) -> DataFrame:
    """``df`` without the candidate columns that are blank in every row; one aggregate tells."""
    kinds = dict(df.dtypes)
    named = [c for c in candidates if c in kinds]
    if not named:
        return df
    used = df.agg(*[F.max(~is_blank(c, kinds[c])).alias(c) for c in named]).first()
    return df.drop(*[c for c in named if not used[c]])


def evidence(columns: Sequence[str]) -> Column:
    """Whether any of the lists has an entry."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(F.size(c), F.lit(0)) > 0)
    return out


def reusable(df: DataFrame, wanted: str, recorded: str, count: str) -> Column:
    """Whether a recorded manifest matches: the same list in order and the same count."""
    return (F.col(wanted) == F.col(recorded)) & (F.size(wanted) == F.col(count))
