"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.common import Own, checked_broadcast

#: A Poisson draw is a sum of draws with means of at most this, so that no table grows long.
MEAN_STEP = 16.0
#: Code points of a partition of the result, about, and the most partitions.
PARTITION_CHARS, MOST_PARTITIONS = 32 << 20, 100_000
#: Entries of each inverse table; beyond them a draw of mean 16 has a chance under 2**-52.
TABLE = 80


def source_rates(docs: DataFrame, weights: Mapping[str, float], default: float, source: str, size: F.Column, epochs: float) -> tuple[DataFrame, float]:
    """(rates, everything): rates is (source, rate, draws, table), the mean repetition of each source's rows; everything, all sizes.

    rate = epochs * weight share * all sizes / the source's size. A null source
    is a source of its own with the default weight; a source without size gets
    rate 0. ``table`` is the distribution function of one draw.
    """
    named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
    weight = F.coalesce(F.element_at(named, F.col("source")), F.lit(float(default))) if named is not None else F.lit(float(default))
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    sizes = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    # as many rows as there are different weights, summed without rounding in between
    by_weight = sorted(sizes.groupBy("weight").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect())
    everything, shares = math.fsum(r.size or 0.0 for r in by_weight), math.fsum(r.weight * r.n for r in by_weight)
    rate = F.when((F.col("size") > 0) & F.lit(shares > 0), F.lit(epochs) * F.col("weight") * F.lit(everything) / (F.lit(shares or 1.0) * F.col("size"))).otherwise(0.0)
    rated = sizes.select("source", rate.alias("rate")).withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_STEP)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    none = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))
    step = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * mean / k)).alias("cdf"))
    return rated.withColumn("table", F.aggregate(F.sequence(F.lit(1), F.lit(TABLE)), none, step)["cdf"]), everything


def uniform(key: F.Column) -> F.Column:
    """A number in [0, 1) from 52 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed_documents(
    docs: DataFrame,
    weights: Mapping[str, float],
    default: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    epochs: float = 1.0,
    seed: int = 17,
    prefix: str = "_",
) -> DataFrame:
    """``docs`` repeated to the target weights and shuffled globally.

    The size of a row is the code points of its text, so that every source's
    share of text approaches its weight. Each row's count inverts a Poisson
    distribution at hash-seeded uniform numbers of (seed, id): the count is
    independent of partitioning and retries. Added columns, after ``prefix``:
    rate, copy (from 1) and shuffle (MD5 of seed, id and copy); columns of these
    names are replaced. Rows go to the partition that owns their range of the
    evenly spread MD5 and are sorted there, so the result is in the order of
    ``shuffle``, no partition depends on a source's share, and counts are drawn
    once. Partitions hold about ``PARTITION_CHARS`` code points.

    Null or empty texts have size 0 but are drawn at their source's rate. A row
    with a null id is known by its text instead, so such rows spread out, too;
    rows that share an id, or have none and share a text, share their count.
    Repetition has no bound of its own: a source with little text and a large
    weight is repeated as often as its target asks for.
    """
    own = Own(docs)
    source, text = own[source_col], own[text_col]
    rates, everything = source_rates(own.frame, weights, default, source, F.length(F.coalesce(text, F.lit(""))), epochs)
    rates = checked_broadcast(rates.toDF("_source", "_rate", "_draws", "_table"), 10_000)
    key = F.coalesce(F.col(own[id_col]).cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    numbers = F.transform(F.sequence(F.lit(1), F.col("_draws")), lambda i: uniform(F.concat_ws(":", F.lit(str(seed)), key, i.cast("string"))))
    drawn = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("_table", lambda c: c <= u)))
    rows = own.frame.join(rates, F.col(source).eqNullSafe(F.col("_source"))).withColumn("_count", F.when(F.col("_rate") > 0, drawn).otherwise(0))
    copies = rows.where("_count > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    shuffled = copies.withColumn("_shuffle", F.md5(F.concat_ws(":", F.lit(f"{seed}s"), key, F.col("_copy").cast("string"))))
    parts = min(MOST_PARTITIONS, 1 + int(epochs * everything / PARTITION_CHARS))
    owner = F.floor(F.conv(F.substring("_shuffle", 1, 8), 16, 10).cast("long") * parts / (1 << 32)).cast("int")
    dealt = shuffled.drop("_source", "_draws", "_table", "_count").repartitionById(parts, owner).sortWithinPartitions("_shuffle", own[id_col])
    return own.restored(dealt, {prefix + c: F.col(f"_{c}") for c in ("rate", "copy", "shuffle")})


#: The query's target weights; every other source has weight 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixed_documents(docs, WEIGHTS).select("doc_id", "source", "text", F.round("_rate", 9).alias("rate"), F.col("_copy").alias("copy"), F.col("_shuffle").alias("shuffle_key"))


OP2_SQL = f"""
WITH g AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
w AS (
  SELECT source, size, CASE WHEN size > 0 THEN
    CASE source {" ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in WEIGHTS.items())} ELSE CAST(1 AS DOUBLE) END
    ELSE CAST(0 AS DOUBLE) END AS weight FROM g),
t AS (SELECT sum(size) AS everything, sum(weight) AS shares FROM w),
r AS (SELECT source, CASE WHEN size > 0 AND shares > 0 THEN 1.0::DOUBLE * weight * everything / (shares * size) ELSE 0.0 END AS rate FROM w, t),
d AS (SELECT source, rate, greatest(1, CAST(ceil(rate / {MEAN_STEP}::DOUBLE) AS INTEGER)) AS draws FROM r),
k AS (SELECT source, rate, draws, rate / draws AS mean, exp(-rate / draws) AS p0 FROM d),
p AS (
  WITH RECURSIVE q(source, mean, i, p, c) AS (
    SELECT source, mean, 0, p0, p0 FROM k
    UNION ALL
    SELECT source, mean, i + 1, p * mean / (i + 1), c + p * mean / (i + 1) FROM q WHERE i < {TABLE})
  SELECT source, list(c ORDER BY i) AS cdf FROM q GROUP BY source),
u AS (
  SELECT x.doc_id, x.source, x.text, k.rate, p.cdf,
         unnest(range(1, k.draws + 1)) AS draw
  FROM documents x JOIN k ON x.source IS NOT DISTINCT FROM k.source JOIN p ON x.source IS NOT DISTINCT FROM p.source
  WHERE k.rate > 0),
n AS (
  SELECT doc_id, source, text, rate,
         CAST(sum(len(list_filter(cdf, lambda c: c <= CAST(('0x' || substr(md5('17:' || doc_id || ':' || draw), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496))) AS INTEGER) AS n
  FROM u GROUP BY ALL),
e AS (SELECT doc_id, source, text, rate, unnest(range(1, n + 1)) AS i FROM n WHERE n > 0)
SELECT doc_id, source, text, round(rate, 9) AS rate, CAST(i AS INTEGER) AS copy, md5('17s:' || doc_id || ':' || i) AS shuffle_key FROM e
"""
