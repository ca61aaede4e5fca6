"""Exact top-k inner products through a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.llm.common import discard, saved

#: Pivots of a table, at least and at most; between them cells of about ``BLOCK`` vectors.
PIVOTS, MOST_PIVOTS = 16, 1024
RINGS = 8
#: Vectors of a candidate block and queries of a query block, about.
BLOCK, QUERIES = 2048, 512
#: Cells that a query block visits in its first round; each later round may visit this many times more.
FIRST, MORE = 2, 4


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(id, vec): each component x as floor(scale * x), 64-bit little-endian binary.

    Left out: null ids, vectors that are null or hold null or non-finite
    components, and repeats of a row. An empty vector stays, as zeros; components
    are clipped at 2**62.
    """
    ok = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        return pd.Series([np.clip(np.floor(scale * np.asarray(v, np.float64)), -(2.0**62), 2.0**62).astype("<i8").tobytes() for v in vectors])

    named = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    return named.where(ok).select("id", packed("v").alias("vec")).distinct()


def matrix(vectors, width: int) -> np.ndarray:
    """Rows of ``width`` integers; shorter vectors end in zeros."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        row = np.frombuffer(v, "<i8")
        out[i, : len(row)] = row
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products, clipped to 64 bits; through floating point where no sum can reach 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2.0**62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.T.astype(object), -(2**63), 2**63 - 1).astype(np.int64)


class Space:
    """Inner products as distances: a candidate x is (x, sqrt(most - x.x)), a query q is (q, 0).

    Then |q - x|^2 = q.q + most - 2 q.x, so the largest products are the nearest
    candidates and the triangle inequality bounds them.
    """

    def __init__(self, pivots: np.ndarray, most: float, width: int):
        self.most, self.width = most, width
        self.pivots = np.column_stack([pivots, self.lift(pivots)]).astype(np.float64)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.most - (x.astype(np.float64) ** 2).sum(1)))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        a = np.column_stack([x, np.zeros(len(x)) if query else self.lift(x)]).astype(np.float64)
        square = (a**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * a @ self.pivots.T
        return np.sqrt(np.maximum(0.0, square))


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 20, pivots: int | None = None, rings: int = RINGS) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` largest inner products with all other ids, exact.

    ``vectors`` is (id, vec) from ``integer_vectors``; ``is_query`` picks queries
    among its rows. Ties go to smaller ids; with fewer candidates all come back.

    Index: a bounded sample gives the pivots, as many as the number of vectors
    asks for up to ``MOST_PIVOTS``, unless told. Every vector is keyed by its
    nearest pivot and a ring of its distance to it; these cells, at most pivots x
    (rings + 1), are the directory. Cells are cut into blocks of about ``BLOCK``
    rows. Search: query blocks go through the cells in order of the triangle
    inequality's bound, a few at first, more each round, until no cell left can
    beat a query's k-th best score. Rounds end at written tables.

    Rows that share an id and differ in their vectors are candidates of their
    own; as queries their answers are ranked together, under the one id.
    """
    spark = vectors.sparkSession
    own = saved(vectors.withColumn("query", is_query), "vectors")

    @F.pandas_udf("double")
    def square(vecs: pd.Series) -> pd.Series:
        return pd.Series([float((np.frombuffer(v, "<i8").astype(np.float64) ** 2).sum()) for v in vecs], dtype="float64")

    size = own.agg(F.max(square("vec")).alias("most"), F.max(F.octet_length("vec")).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.count_if("query").alias("queries")).first()
    schema = "query_id long, rank int, id long, score long"
    if not size.queries:
        return spark.createDataFrame([], schema)
    width = (size.bytes or 0) // 8
    pivots = pivots or min(max(PIVOTS, size.rows // (BLOCK * RINGS)), MOST_PIVOTS)
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vec").collect()
    space = Space(matrix([bytes(r.vec) for r in chosen], width), size.most or 0.0, width)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = matrix(f["vec"], width)
            d = space.distances(x, False)
            near = d.argmin(1) if len(d) else np.zeros(0, np.int64)
            yield f.assign(pivot=near.astype("int32"), distance=d[np.arange(len(d)), near])

    placed = saved(own.mapInPandas(place, "id long, vec binary, query boolean, pivot int, distance double"), "placed")
    far = placed.agg(F.max("distance")).first()[0] or 0.0
    cell = (F.col("pivot") * (rings + 1) + F.floor(F.col("distance") / F.lit(max(far, 1e-9) / rings))).cast("int")
    keyed = placed.withColumn("cell", cell)
    counted = keyed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"))
    counted = saved(counted.withColumn("parts", F.ceil(F.col("n") / BLOCK)), "cells")
    cells = counted.collect()
    names = np.array([c.cell for c in cells])
    low, high = np.array([c.low for c in cells]), np.array([c.high for c in cells])
    parted = keyed.join(F.broadcast(counted.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    blocks = parted.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "vec")).alias("rows"))
    blocks = saved(blocks.select("cell", F.col("rows.id").alias("ids"), F.col("rows.vec").alias("vecs")), "blocks")
    per_pivot = placed.where("query").groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    asked = placed.where("query").join(F.broadcast(per_pivot), "pivot")
    asked = saved(asked.select(F.concat_ws(":", "pivot", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / QUERIES))).alias("block"), F.col("id").alias("query_id"), "vec"), "queries")

    def wanted_by(visit: int | None):
        def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for block, vecs, kth, seen in zip(f["block"], f["vecs"], f["kth"], f["seen"], strict=True):
                    q = matrix(vecs, width)
                    d = space.distances(q, True)[:, names // (rings + 1)]
                    gap = np.maximum(0.0, np.maximum(d - high, low - d))
                    square = (q.astype(np.float64) ** 2).sum(1)[:, None]
                    bound = (square + space.most - gap**2) / 2
                    slack = 1e-6 * (square + space.most) + 1e-6
                    goal = np.array([-np.inf if x is None or x != x else float(x) for x in kth])[:, None]
                    best = np.where(bound + slack >= goal, bound, -np.inf).max(0)
                    best[np.isin(names, np.asarray([] if seen is None else seen, np.int64))] = -np.inf
                    order = np.argsort(-best, kind="stable")
                    order = order[best[order] > -np.inf][:visit]
                    out += [(block, int(names[c])) for c in order]
                yield pd.DataFrame(out, columns=["block", "cell"])

        return choose

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for ids, vecs, kth, others, xs in zip(f["ids"], f["vecs"], f["kth"], f["cand"], f["cand_vecs"], strict=True):
                s = products(matrix(vecs, width), matrix(xs, width))
                others = np.asarray(others, np.int64)
                out = []
                for i, (own_id, least) in enumerate(zip(ids, kth, strict=True)):
                    ok = others != own_id
                    if least is not None and least == least:
                        ok &= s[i] >= least
                    at = np.flatnonzero(ok)
                    at = at[np.lexsort((others[at], -s[i, at]))[:k]]
                    out.append(pd.DataFrame({"query_id": own_id, "id": others[at], "score": s[i, at]}))
                yield pd.concat(out, ignore_index=True)

    hits = visited = None
    visit: int | None = FIRST
    while True:
        state = asked
        if hits is not None:
            kth = hits.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            state = asked.join(kth, "query_id", "left")
        else:
            state = asked.withColumn("kth", F.lit(None).cast("long"))
        # a null k-th score must keep its place in the list
        group = state.groupBy("block").agg(F.collect_list(F.struct("query_id", "vec", "kth")).alias("rows"))
        group = saved(group.select("block", F.col("rows.query_id").alias("ids"), F.col("rows.vec").alias("vecs"), F.col("rows.kth").alias("kth")), "asking")
        seen = visited.groupBy("block").agg(F.collect_set("cell").alias("seen")) if visited is not None else spark.createDataFrame([], "block string, seen array<int>")
        wanted = saved(group.join(seen, "block", "left").select("block", "vecs", "kth", "seen").mapInPandas(wanted_by(visit), "block string, cell int"), "wanted")
        if wanted.isEmpty():
            break
        found = wanted.join(group, "block").join(blocks.select("cell", F.col("ids").alias("cand"), F.col("vecs").alias("cand_vecs")), "cell")
        found = found.mapInPandas(score, "query_id long, id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        every = found if hits is None else hits.drop("rank").union(found)
        before, hits = hits, saved(every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank"), "hits")
        discard(before, group)
        now = wanted.select("block", "cell")
        visited = now if visited is None else visited.union(now)
        visit = visit * MORE
    if hits is None:
        return spark.createDataFrame([], schema)
    return hits.select("query_id", "rank", "id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * x.e[i])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
