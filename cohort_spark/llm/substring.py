"""Repeated word spans, by a De Bruijn graph of token windows.

Windows of ``k`` words are the graph's edges, their inner ``k - 1`` words its
nodes. Most windows occur once, so a filter that loses none comes first: each
window is represented by the smallest hash among its short word runs (its
minimizer); equal windows have equal minimizers, so only windows whose minimizer
occurs in two texts can repeat.

One aggregation over the remaining edges gives each repeated edge its source,
the first place where it occurs, and its degrees: whether all occurrences are
followed by the same edge and preceded by the same edge. Edges next to each
other at the source are joined where the node between them does not branch: all
occurrences of one go on to the other and all of the other come from the one. So
a compacted path occurs as a whole wherever it occurs, and a join on its first
edge finds all places. Each place is verified against the words at the source
coordinates before anything is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.llm.common import Own, discard, rolled, saved, split_words, text_batches, word_runs, word_slices

#: Words of a window.
WINDOW = 13
#: Words of the runs among which a window's minimizer is chosen.
RUN = 5
#: Id of rows without one: larger than any other, so that such rows yield to all others.
NO_ID = (1 << 63) - 1
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Rows of an Arrow batch of edges.
EDGES_AT_ONCE = 50_000


def _minimizers(words: np.ndarray, k: int, run: int) -> np.ndarray:
    """For each window of ``k`` words its smallest hash of ``run`` words."""
    low, n, have = rolled(words, run), max(0, len(words) - k + 1), 1
    want = k - run + 1
    while have < want and n:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:]) if step else low
        have += step
    return low[:n]


def _listed(lists: list[np.ndarray]) -> pa.Array:
    offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).view(np.int64) if lists else [], pa.int64()))


def anchors(docs: DataFrame, k: int = WINDOW, run: int = RUN) -> DataFrame:
    """(doc, same, anchors): the distinct minimizers of each row's windows; ``docs`` has doc, same and text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words, bounds in word_runs(batch.column("text")):
                n, low = len(bounds) - 1, _minimizers(words[0], k, run)
                lists = [np.unique(low[a : max(a, b - k + 1)]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(first, n), batch.column("same").slice(first, n), _listed(lists)], ["doc", "same", "anchors"])

    return docs.select("doc", "same", "text").mapInArrow(find, "doc long, same binary, anchors array<long>")


def edges(candidates: DataFrame, k: int = WINDOW, run: int = RUN) -> DataFrame:
    """(h1, h2, after, before, place, pos, doc) of the windows whose minimizer is in the row's list ``hot``.

    (h1, h2) is a window's 128-bit key; after and before are first halves of the
    keys of the next and the previous window, 0 at the text's ends. ``place`` is
    twice the node, plus 1 where the window occurred earlier in the text.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "after", "before", "place", "pos", "doc"]
        for batch in batches:
            nodes, docs, hot = (batch.column(c) for c in ("node", "doc", "hot"))
            for first, words, bounds in word_runs(batch.column("text")):
                low, parts = _minimizers(words[0], k, run), []
                h1, h2 = rolled(words[0], k, BASES[0]), rolled(words[1], k, BASES[1])
                for i in range(len(bounds) - 1):
                    a, b = bounds[i], bounds[i + 1] - k + 1
                    if b <= a:
                        continue
                    pos = np.flatnonzero(np.isin(low[a:b], hot[first + i].values.to_numpy().view(np.uint64)))
                    own, again = h1[a + pos], np.ones(len(pos), np.int64)
                    again[np.unique(own, return_index=True)[1]] = 0
                    ends = np.r_[np.uint64(0), h1[a:b], np.uint64(0)]
                    node, doc = nodes[first + i].as_py(), docs[first + i].as_py()
                    parts.append((own, h2[a + pos], ends[pos + 2], ends[pos], 2 * node + again, pos, np.full(len(pos), doc)))
                if parts:
                    cols = [np.concatenate(c).view(np.int64) for c in zip(*parts, strict=True)]
                    for at in range(0, len(cols[0]), EDGES_AT_ONCE):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + EDGES_AT_ONCE]) for c in cols], names)

    kinds = ", ".join(f"{c} long" for c in ("h1", "h2", "after", "before", "place", "pos", "doc"))
    return candidates.select("node", "doc", "hot", "text").mapInArrow(find, kinds)


def repeated_edges(every: DataFrame) -> DataFrame:
    """(h1, h2, source, source_pos, onward, back) of the edges in two texts or more.

    The source is the first node, and there the first position. ``onward`` says
    that the same edge follows every occurrence, ``back`` that the same one
    precedes every occurrence.
    """
    found = every.groupBy("h1", "h2").agg(
        F.min("place").alias("low"),
        F.max("place").alias("high"),
        F.min_by("pos", "place").alias("source_pos"),
        (F.min("after") == F.max("after")).alias("onward"),
        (F.min("before") == F.max("before")).alias("back"),
    )
    node = lambda c: F.shiftright(c, 1)
    return found.where(node("low") < node("high")).select("h1", "h2", node("low").alias("source"), "source_pos", "onward", "back")


def compact(repeated: DataFrame) -> DataFrame:
    """(source, paths): the nonbranching paths of repeated edges, as (start, edges, h1, h2) of their first edge.

    An edge joins the path of the edge just before it at the source where that
    one always goes on and this one always comes back. A source's paths are
    disjoint runs of its own windows, so a list is no longer than its text.
    """
    along = Window.partitionBy("source").orderBy("source_pos")
    joined = (F.lag("source_pos").over(along) == F.col("source_pos") - 1) & F.lag("onward").over(along) & F.col("back")
    runs = repeated.withColumn("first", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("first").over(along))
    paths = runs.groupBy("source", "run").agg(
        F.min("source_pos").alias("start"), F.count(F.lit(1)).alias("edges"), F.min_by("h1", "source_pos").alias("h1"), F.min_by("h2", "source_pos").alias("h2")
    )
    return paths.groupBy("source").agg(F.collect_list(F.struct("start", "edges", "h1", "h2")).alias("paths"))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def words_of_paths(sources: DataFrame, k: int = WINDOW) -> DataFrame:
    """(h1, h2, edges, source_doc, words): each path's first edge, and a 128-bit digest of its words at the source.

    ``sources`` has doc, text and paths.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, data, paths = batch.column("doc")[row].as_py(), batch.column("text")[row].as_py(), batch.column("paths")[row].as_py()
                words = [w for part in word_slices(data.encode()) for w in part]
                found = [(p["h1"], p["h2"], p["edges"], doc, _digest(words[p["start"] : p["start"] + p["edges"] + k - 1])) for p in paths]
                for at in range(0, len(found), EDGES_AT_ONCE):
                    cols = list(zip(*found[at : at + EDGES_AT_ONCE], strict=True))
                    yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], ["h1", "h2", "edges", "source_doc", "words"])

    return sources.select("doc", "text", "paths").mapInArrow(read, "h1 long, h2 long, edges long, source_doc long, words binary")


def repeated_spans(docs: DataFrame, k: int = WINDOW, run: int = RUN) -> DataFrame:
    """(same, doc, copied, spans) of what repeats: ``docs`` has doc (``NO_ID`` for none), same (the text's SHA-256) and text.

    Every distinct text is judged once, as the smallest doc that has it; rows of
    larger docs with the same text are ``copied``. ``spans`` are places of
    compacted paths whose source is a smaller doc, as (pos, edges, words), with
    the digest of the source's words. A list has at most as many entries as its
    text has windows. ``docs`` is read three times, so it should be a table.
    """
    found = saved(anchors(docs, k, run), "anchors")
    texts = found.groupBy("same").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
    # ids in the order of doc, so that the first node with an edge has the smallest doc
    texts = saved(texts.orderBy("doc", "same").withColumn("node", F.monotonically_increasing_id()), "texts")
    later = texts.where("doc < last").select("same", F.col("doc").alias("first"))
    copies = saved(found.select("same", "doc").distinct().join(later, "same").where("doc > first").select("same", "doc"), "copies")
    listed = found.join(texts.drop("last"), ["same", "doc"]).select("node", F.explode("anchors").alias("h"))
    hot = listed.groupBy("h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("h")
    hot = saved(hot, "hot")
    wanted = listed.join(hot, "h", "left_semi").distinct().groupBy("node").agg(F.collect_list("h").alias("hot"))
    wanted = saved(wanted.join(texts.drop("last"), "node"), "wanted")
    discard(found, hot)
    every = saved(edges(docs.join(wanted, ["same", "doc"]), k, run), "edges")
    discard(wanted)
    repeated = saved(repeated_edges(every), "repeated")
    paths = saved(compact(repeated).join(texts.select(F.col("node").alias("source"), "same", "doc"), "source"), "paths")
    discard(repeated)
    sources = words_of_paths(docs.join(paths, ["same", "doc"]), k)
    firsts = saved(sources.dropDuplicates(["h1", "h2"]), "firsts")
    discard(paths)
    places = every.select("h1", "h2", "place", "pos", "doc").join(firsts, ["h1", "h2"]).where("doc > source_doc")
    spans = places.groupBy(F.shiftright("place", 1).alias("node")).agg(F.collect_set(F.struct("pos", "edges", "words")).alias("spans"))
    spans = saved(spans.join(texts.select("node", "same", "doc"), "node").select("same", "doc", F.lit(False).alias("copied"), "spans"), "spans")
    discard(every, firsts, texts)
    return spans.unionByName(copies.withColumn("copied", F.lit(True)), allowMissingColumns=True)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, name: str = "_dedup") -> DataFrame:
    """All rows and columns of ``docs`` with the struct column ``name``: n_words, n_removed, kept, kept_sha256.

    A column of that name is replaced. Removed are the words covered by a window of ``k`` words that also starts in
    a row with a smaller id. Windows are judged on the input. ``kept`` is the
    text without the removed words (null if none are: the text stays as it is);
    kept_sha256 is over the kept words joined by one space. Null and empty texts
    have no words. Rows without an id yield to all others, and neither they nor
    rows that share an id (with equal or different texts) remove anything from
    each other. Repeated rows repeat. Texts are joined with their marks by a
    shuffle on (text, id) at every size.
    """
    text_batches(docs.sparkSession)
    own = Own(docs)
    text = own[text_col]
    rows = own.frame.withColumns({"_doc": F.coalesce(F.col(own[id_col]).cast("long"), F.lit(NO_ID)), "_same": F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))})
    marks = repeated_spans(rows.select(F.col("_doc").alias("doc"), F.col("_same").alias("same"), F.col(text).alias("text")), k)
    marks = marks.select(F.col("same").alias("_same"), F.col("doc").alias("_doc"), F.col("copied").alias("_copied"), F.col("spans").alias("_spans"))

    @F.pandas_udf("n_words long, n_removed long, kept string, kept_sha256 string")
    def cut(texts: pd.Series, spans: pd.Series, copied: pd.Series) -> pd.DataFrame:
        out = []
        for text, some, copy in zip(texts, spans, copied, strict=True):
            words = split_words(text)
            n = kept = len(words)
            if copy is True and n >= k:
                kept, words = 0, []
            elif some is not None and len(some):
                gone = np.zeros(n + 1, np.int64)
                for s in some:
                    a, b = s["pos"], s["pos"] + s["edges"] + k - 1
                    if _digest(words[a:b]) == s["words"]:
                        gone[a] += 1
                        gone[b] -= 1
                words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:n] == 0)]
                kept = len(words)
            joined = b" ".join(words)
            out.append((n, n - kept, joined.decode() if kept < n else None, hashlib.sha256(joined).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "kept_sha256"])

    marked = rows.join(marks, ["_same", "_doc"], "left")
    return own.restored(marked, {name: cut(F.col(text), "_spans", "_copied")})


def op4_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "_dedup.n_words", "_dedup.n_removed", "_dedup.kept_sha256")


OP4_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM win) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (
  SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS t
  FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p WHERE gone.p IS NULL GROUP BY pos.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
