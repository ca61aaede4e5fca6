"""Slices, unions and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.operators.projection import without_empty_columns
from cohort_spark.operators.windows import kept_last


def replace_source(unified: DataFrame, incoming: DataFrame, source: str, column: str = "source") -> DataFrame:
    """``unified`` with the rows of one source replaced.

    Incoming rows get the source. A row without source belongs to others. Columns
    that the incoming slice lacks and that are blank in all kept rows go. With
    nothing kept the incoming rows alone remain.
    """
    fresh = incoming.withColumn(column, F.lit(source))
    kept = unified.where(~F.col(column).eqNullSafe(source))
    if kept.isEmpty():
        return fresh
    kept = without_empty_columns(kept, [c for c in kept.columns if c not in fresh.columns])
    return kept.unionByName(fresh, allowMissingColumns=True)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def upsert(existing: DataFrame, incoming: DataFrame, key: str, overwrite: bool = False, position: str = "seq") -> DataFrame:
    """Both tables, the later row of each key; with ``overwrite`` the incoming alone. A missing key column falls back to sample_id.

    Incoming rows are later than existing ones, then the larger position is later;
    rows alike in both, or without that column, go by all their columns, so the
    result does not depend on partitioning.
    """
    if overwrite:
        return incoming
    by = key if key in existing.columns and key in incoming.columns else "sample_id"
    both = existing.withColumn("_age", F.lit(0)).unionByName(incoming.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    rest = [c for c, kind in both.dtypes if c not in ("_age", position, by) and "map<" not in kind and kind != "variant"]
    order = F.struct("_age", *([position] if position in both.columns else []), *rest)
    return kept_last(both.withColumn("_order", order), [by], "_order").drop("_age", "_order")
