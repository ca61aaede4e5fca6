"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.common import mixed, saved, text_batches

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
#: Most labelled rows that a model is fitted on, chosen by hash; the only bound on training.
TRAIN_ROWS = 20_000
#: A bucket is a feature if its log-count ratio is this many standard errors from 0.
LEAST_Z = 3.0
MOST_FEATURES = 1 << 15
#: Buckets of one row of counts.
CHUNK = 1 << 14


def grams(text: str | None) -> np.ndarray:
    """Buckets of the lower-cased text's character n-grams, with repeats; white space counts as a space."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    points = np.where(points < 33, np.uint64(32), points)
    found = []
    with np.errstate(over="ignore"):
        h = points
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * np.uint64(0x100000001B3) + points[n - 1 :] if len(h) > 1 else h[:0]
            if n in SIZES:
                found.append(mixed(h + np.uint64(n)) >> np.uint64(44))
    return np.concatenate(found).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the distinct features present)))."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = grams(text)
        found = found[self.weights[found] != 0]
        z = self.bias + float(self.weights[np.unique(found)].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(labelled: DataFrame, rows: int, ridge: float = 1e-3, alpha: float = 1.0) -> Model:
    """A model of ``labelled`` (text, label 0/1), at most a few ten thousand rows.

    Presence counts by label give each bucket's log ratio; buckets whose ratio
    stands out are features, and logistic regression weighs the ratios. The
    driver gets the counts, which ``BUCKETS`` bounds. With one label only, or no
    rows, the score is the smoothed share of label 1.
    """
    spark = labelled.sparkSession
    text_batches(labelled.sparkSession)
    data = saved(labelled.repartition(max(1, min(16, rows // 500))), "labelled")
    classes = {r.label: r.n for r in data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = classes.get(1, 0), classes.get(0, 0)
    if not pos or not neg:
        share = (pos + 1) / (pos + neg + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, BUCKETS), np.int32)
        for frame in frames:
            for text, label in zip(frame["text"], frame["label"], strict=True):
                n[int(label), np.unique(grams(text))] += 1
        yield pd.DataFrame({"chunk": range(BUCKETS // CHUNK), "counts": [n[:, c : c + CHUNK].ravel().tolist() for c in range(0, BUCKETS, CHUNK)]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for frame in frames:
            for c, counts in zip(frame["chunk"], frame["counts"], strict=True):
                total[c] = total.get(c, 0) + np.asarray(counts, np.int64)
        if total:
            yield pd.DataFrame({"chunk": list(total), "counts": [np.asarray(x, "<i8").tobytes() for x in total.values()]})

    sums = data.select("text", "label").mapInPandas(count, "chunk int, counts array<int>").repartition("chunk").mapInPandas(add, "chunk int, counts binary")
    counts = np.zeros((2, BUCKETS), np.int64)
    for r in sums.toLocalIterator():
        counts[:, r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, "<i8").reshape(2, CHUNK)
    p, q = counts[1] + alpha, counts[0] + alpha
    ratio = np.log(p / (pos + 2 * alpha)) - np.log(q / (neg + 2 * alpha))
    z = np.abs(ratio) / np.sqrt(1 / p + 1 / q)
    z[counts.sum(0) < 3] = 0
    features = np.flatnonzero(z >= LEAST_Z)
    if len(features) > MOST_FEATURES:
        features = np.sort(np.argsort(-z, kind="stable")[:MOST_FEATURES])
    if not len(features):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(pos / neg)))
    place = np.full(BUCKETS, -1, np.int32)
    place[features] = np.arange(len(features))
    shared = spark.sparkContext.broadcast((place, ratio[features]))

    @F.udf(VectorUDT())
    def vector(text):
        where, scale = shared.value
        own = np.unique(where[grams(text)])
        own = own[own >= 0]
        return Vectors.sparse(len(scale), own.tolist(), scale[own].tolist())

    ready = saved(data.select(vector("text").alias("features"), F.col("label").cast("double").alias("label")), "vectors")
    fitted = LogisticRegression(regParam=ridge, standardization=False, maxIter=60).fit(ready)
    weights = np.zeros(BUCKETS, np.float32)
    weights[features] = fitted.coefficients.toArray() * ratio[features]
    return Model(weights, float(fitted.intercept))


def held_out(id_col: str = "doc_id", folds: int = 5) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == 0


def fit_on(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows outside the held-out fold, at most ``rows`` by hash of their id.

    Rows with a null id or label teach nothing; an id with several labels counts
    as 1 if one of them is.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("label"))
    chosen = saved(known.orderBy(F.xxhash64("_id"), "_id").limit(rows), "chosen")
    n = chosen.count()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return fit(texts.join(F.broadcast(chosen), "_id").select("text", "label"), n)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted; null and empty texts have no feature.

    A row with a null id is held out of nothing: held_out is false.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    out = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), score(text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
