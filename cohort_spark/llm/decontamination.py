"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.llm.common import checked_broadcast, discard, saved, text_batches, word_slices

#: Words of a window of the query.
WINDOW = 10
#: Words of an index segment, about: what one task holds of the index at once.
SEGMENT_WORDS = 1 << 21
#: Words by which the parts of a long text overlap, so that matches of at most one word more lie whole in a part.
OVERLAP = 63
#: Words of queries that meet a segment in one group, about; alignments that a task checks at once.
BLOCK_WORDS, ALIGNMENTS = 1 << 20, 1 << 20
#: What a byte of a word becomes: capitals small; signs, white space and control characters a space.
_KEPT = (string.ascii_lowercase + string.digits).encode()
WORD_BYTES = bytes(b if b >= 128 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def text_parts(text: bytes | None, step: int) -> Iterator[tuple[int, list[bytes], int]]:
    """(number of the first word, words, how many the next part starts after): a text in parts of about ``step`` words, one at least.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased. Each part
    but the last holds ``OVERLAP`` words of the next one, too.
    """
    at, held = 0, []
    for words in word_slices(text.translate(WORD_BYTES) if text else b""):
        held += words
        while len(held) > step + OVERLAP:
            yield at, held[: step + OVERLAP], step
            held = held[step:]
            at += step
    yield at, held, len(held)


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Postings of all words of all texts, written to the shared folder: (segment, term, n, positions, rows, ids, sizes, firsts, bases).

    A segment holds texts, or parts of long ones, of about ``segment_words``
    words. A word's position in it is its text's base plus its place; a position
    between texts stays free, so that no phrase reaches over. A term's row has
    its number of positions in the segment and these, ascending, as
    little-endian 32-bit integers. The row without a term is the segment's
    directory, with an entry for each text or part: its row in the table, its
    id, its words (those of the next part left out), the number of its first
    word, and its base.

    Null and empty texts have no words but an entry; ids may be null or shared.
    What a task writes depends on its own rows alone, in their order.
    """
    text_batches(docs.sparkSession)
    schema = f"segment long, term binary, n int, positions binary, rows array<long>, ids array<{docs.schema[id_col].dataType.simpleString()}>, sizes array<int>, firsts array<int>, bases array<int>"
    names = ["segment", "term", "n", "positions", "rows", "ids", "sizes", "firsts", "bases"]

    def batches_of(number: int, words: list[bytes], entries: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        rows, ids, sizes, firsts, lengths = zip(*entries, strict=True)
        bases = np.concatenate(([0], np.cumsum(np.array(lengths) + 1)[:-1])).astype(np.int32)
        kinds = [pa.list_(k) for k in (pa.int64(), id_type, pa.int32(), pa.int32(), pa.int32())]
        if words:
            place = np.arange(len(words), dtype=np.int32) + np.repeat(np.arange(len(entries), dtype=np.int32), lengths)
            coded = pa.array(words, pa.binary()).dictionary_encode()
            codes = coded.indices.to_numpy()
            counts = np.bincount(codes).astype(np.int32)
            bounds = np.concatenate(([0], np.cumsum(4 * counts))).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(place[np.argsort(codes, kind="stable")])])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), number)), coded.dictionary, pa.array(counts), lists, *[pa.nulls(len(counts), k) for k in kinds]], names)
        directory = [pa.array([list(v)], k) for v, k in zip((rows, ids, sizes, firsts, bases.tolist()), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.nulls(1, k) for k in (pa.binary(), pa.int32(), pa.binary())], *directory], names)

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = number = TaskContext.get().partitionId() << 33
        words: list[bytes] = []
        entries: list[tuple] = []
        id_type = pa.null()
        for batch in batches:
            id_type = batch.column("id").type
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for first, part, own in text_parts(text, segment_words):
                    if entries and len(words) + len(part) > segment_words:
                        yield from batches_of(number, words, entries, id_type)
                        number, words, entries = number + 1, [], []
                    entries.append((row, doc, own, first, len(part)))
                    words += part
                row += 1
        if entries:
            yield from batches_of(number, words, entries, id_type)

    return saved(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(indexed, schema), "postings")


def query_words(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query, item, words): the words of each row's text under a number of the row; rows without words go. Written."""
    text_batches(queries.sparkSession)
    kind = queries.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            words = [x.translate(WORD_BYTES).split() if x else [] for x in batch.column("text").cast(pa.binary()).to_pylist()]
            numbers = pa.array(range(row, row + len(words)), pa.int64())
            row += len(words)
            out = pa.RecordBatch.from_arrays([numbers, batch.column("item"), pa.array(words, pa.list_(pa.binary()))], ["query", "item", "words"])
            yield out.filter(pc.greater(pc.list_value_length(out.column("words")), 0))

    rows = queries.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return saved(rows.mapInArrow(split, f"query long, item {kind}, words array<binary>"), "query-words")


class Segment:
    """The posting lists of a segment, those of the queries' terms only, and its directory, inside a task."""

    def __init__(self, rows: pa.Table):
        lists = rows.filter(pc.is_valid(rows.column("term"))).combine_chunks()
        self.terms = lists.column("term")
        self.sizes = lists.column("n").to_numpy().astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.positions = np.frombuffer(b"".join(lists.column("positions").to_pylist()), "<i4").astype(np.int64)
        #: All postings as term << 32 | position, ascending.
        self.keys = (np.repeat(np.arange(len(self.sizes)), self.sizes) << 32) | self.positions
        self.entries = rows.filter(pc.is_null(rows.column("term"))).select(["rows", "ids", "firsts", "bases"]).to_pylist()[0]
        self.bases = np.array(self.entries["bases"], np.int64)

    def codes(self, words: pa.Array) -> np.ndarray:
        """The number of each word's list, -1 for words without one."""
        return pc.fill_null(pc.index_in(words, value_set=self.terms), -1).to_numpy().astype(np.int64)

    def posted(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``codes``, position): all postings of the terms."""
        sizes = self.sizes[codes]
        which = np.repeat(np.arange(len(codes)), sizes)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return which, self.positions[self.starts[codes][which] + inner]

    def holds(self, codes: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether each position has its term."""
        wanted = (codes << 32) | positions
        at = np.searchsorted(self.keys, wanted)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == wanted

    def after(self, code: int, positions: np.ndarray) -> np.ndarray:
        """The first posting of a term at or after each position; a large number if there is none."""
        own = self.positions[self.starts[code] : self.starts[code + 1]]
        return np.append(own, 1 << 40)[np.searchsorted(own, positions)]

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The directory entry of each position."""
        return np.searchsorted(self.bases, positions, side="right") - 1


def phrase_spans(segment: Segment, codes: np.ndarray, counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends): merged spans of the segment where ``window`` consecutive words of the query occur, or all of fewer.

    Each window's lists are moved back by their offsets and intersected, from
    the rarest term's on.
    """
    w = min(window, len(codes))
    windows = np.lib.stride_tricks.sliding_window_view(codes, w)
    there = np.flatnonzero((windows >= 0).all(axis=1))
    order = np.argsort(np.lib.stride_tricks.sliding_window_view(counts, w)[there], axis=1, kind="stable")
    rarest = windows[there, order[:, 0]] if len(there) else there
    cuts = np.flatnonzero(np.diff(np.cumsum(segment.sizes[rarest]) // ALIGNMENTS)) + 1
    found = []
    for part in np.split(np.arange(len(there)), cuts):
        which, positions = segment.posted(rarest[part])
        which = part[which]
        starts = positions - order[which, 0]
        which, starts = which[starts >= 0], starts[starts >= 0]
        for k in range(1, w):
            if not len(which):
                break
            offset = order[which, k]
            hit = segment.holds(windows[there[which], offset], starts + offset)
            which, starts = which[hit], starts[hit]
        found.append(np.unique(starts))
    starts = np.unique(np.concatenate(found))
    fresh = np.append(True, starts[1:] > starts[:-1] + w)[: len(starts)]
    last = np.append(fresh[1:], True)[: len(starts)]
    return starts[fresh], starts[last] + w


def proximity_spans(segment: Segment, codes: np.ndarray, counts: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends): smallest spans of at most ``within`` words of one text that hold every word of the query, in any order."""
    if (codes < 0).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    terms, first = np.unique(codes, return_index=True)
    terms = terms[np.argsort(counts[first], kind="stable")]
    starts = np.sort(segment.posted(terms)[1])
    ends = starts
    for term in terms:  # the rarest rules out most
        nearest = segment.after(term, starts)
        near = nearest < starts + within
        starts, ends = starts[near], np.maximum(ends[near], nearest[near])
    same = segment.text_of(starts) == segment.text_of(ends)
    starts, ends = starts[same], ends[same]
    least = np.append(ends[1:] != ends[:-1], True)[: len(ends)]
    return starts[least], ends[least] + 1


def matches(index: DataFrame, words: DataFrame, seeds: Callable[[DataFrame], DataFrame], spans: Callable, reach: int) -> DataFrame:
    """(row, id, query, item, start, until): spans of texts by ``spans`` for the queries of ``query_words``.

    ``seeds`` gives (query, term) from (query, pos, term, n, words): a segment is
    searched for a query only if it holds one of its seeds. Queries meet the
    lists of a segment in groups of about ``BLOCK_WORDS`` words of queries; lists
    of terms that no query has stay where they are.
    """
    if reach > OVERLAP + 1:
        raise ValueError(f"matches of more than {OVERLAP + 1} words may lie across two parts of a long text")
    postings, directory = index.where("term is not null"), index.where("term is null")
    terms = words.select("query", F.size("words").alias("words"), F.posexplode("words").alias("pos", "term"))
    vocabulary = checked_broadcast(terms.select("term").distinct())
    known = saved(postings.select("segment", "term", "n").join(vocabulary, "term", "left_semi"), "known-terms")
    counts = known.groupBy("term").agg(F.sum("n").alias("n"))
    counted = saved(terms.join(checked_broadcast(counts), "term", "left").fillna(0, ["n"]), "query-terms")
    blocks = 1 + (counted.count() // BLOCK_WORDS)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "term", "n")))
    full = counted.groupBy("query").agg(ordered.alias("o")).join(words.select("query", "item"), "query").select("query", "item", F.col("o.term").alias("words"), F.col("o.n").alias("counts"))
    found = known.select("segment", "term").join(checked_broadcast(seeds(counted)), "term").select("segment", "query").distinct()
    wanted = saved(found.join(full, "query").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))), "segment-queries")
    groups = wanted.select(F.col("segment").alias("part"), F.col("block").alias("group")).distinct()
    lists = postings.join(vocabulary, "term", "left_semi").select(*index.columns).union(directory).select("segment", "term", "n", "positions", "rows", "ids", "firsts", "bases")
    lists = lists.join(groups, F.col("segment") == F.col("part")).drop("segment")
    kinds = {c: wanted.schema["item"].dataType.simpleString() if c == "item" else index.schema["ids"].dataType.elementType.simpleString() for c in ("item", "id")}
    names = ["row", "id", "query", "item", "start", "until"]

    def searched(asked, held):
        out = []
        if asked.num_rows and held.num_rows:
            segment, asked = Segment(held), asked.combine_chunks()
            texts = asked.column("words").combine_chunks()
            bounds = texts.offsets.to_numpy()
            codes, counts = segment.codes(texts.values), asked.column("counts").combine_chunks().values.to_numpy()
            for i, (query, item) in enumerate(zip(asked.column("query").to_pylist(), asked.column("item").to_pylist(), strict=True)):
                own = slice(bounds[i], bounds[i + 1])
                starts, ends = spans(segment, codes[own], counts[own])
                for e, s, u in zip(segment.text_of(starts).tolist(), starts.tolist(), ends.tolist(), strict=True):
                    shift = segment.entries["firsts"][e] - segment.entries["bases"][e]
                    out.append((segment.entries["rows"][e], segment.entries["ids"][e], query, item, s + shift, u + shift))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        types = [pa.int64(), held.schema.field("ids").type.value_type, pa.int64(), asked.schema.field("item").type, pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    both = wanted.groupBy("segment", "block").cogroup(lists.groupBy("part", "group"))
    return both.applyInArrow(searched, ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))


def phrase_matches(index: DataFrame, words: DataFrame, window: int = WINDOW) -> DataFrame:
    """(row, id, query, item, start, until): merged spans of texts where ``window`` consecutive words of a query occur, or all of fewer.

    ``start`` and ``until`` count words of the text from 0. Spans of one query
    are merged within a part of a text; where parts overlap they may overlap.
    """
    ahead = Window.partitionBy("query").orderBy("pos").rowsBetween(0, window - 1)

    def seeds(counted: DataFrame) -> DataFrame:
        each = counted.withColumn("seed", F.min(F.struct("n", "pos", "term")).over(ahead))
        return each.where((F.col("pos") <= F.greatest(F.col("words") - window, F.lit(0))) & (F.col("seed.n") > 0)).select("query", "seed.term").distinct()

    return matches(index, words, seeds, lambda *x: phrase_spans(*x, window), window)


def proximity_matches(index: DataFrame, words: DataFrame, within: int) -> DataFrame:
    """(row, id, query, item, start, until): smallest spans of at most ``within`` words that hold every word of a query, in any order."""

    def seeds(counted: DataFrame) -> DataFrame:
        return counted.groupBy("query").agg(F.min(F.struct("n", "term")).alias("seed")).where("seed.n > 0").select("query", "seed.term")

    return matches(index, words, seeds, lambda *x: proximity_spans(*x, within), within).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items, contaminated.

    A word is hit if it lies in a place where ``window`` consecutive words of a
    benchmark text, or all of a shorter one, occur. ``items`` are the ids of such
    benchmark rows as text, distinct and sorted.

    Null texts have no words. Rows that share an id, or have none, are judged
    each for itself; benchmark rows that share an id are one item, those without
    an id hit words but are not listed. Other columns are not read.
    """
    index = positional_index(docs, id_col, text_col)
    words = query_words(benchmark, item_col, item_text)
    spans = saved(phrase_matches(index, words, window), "spans")
    before = Window.partitionBy("row").orderBy("start", "until")
    reached = F.coalesce(F.max("until").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = spans.select("row", "start", "until").distinct().withColumn("fresh", F.greatest(F.lit(0), F.col("until") - F.greatest("start", reached))).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    listed = spans.select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    entries = index.where("term is null").select(F.explode(F.arrays_zip("rows", "ids", "sizes")).alias("e")).select("e.*")
    whole = entries.groupBy(F.col("rows").alias("row")).agg(F.first("ids").alias("id"), F.sum("sizes").alias("n_words"))
    out = whole.join(hit, "row", "left").join(listed, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, ws, least(len(ws), {WINDOW}) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark)
  WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS i FROM b)),
g AS (SELECT DISTINCT k FROM b),
w AS (SELECT row, k, i, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase FROM (SELECT d.row, d.ws, g.k, unnest(range(1, len(d.ws) - g.k + 2)) AS i FROM d, g)),
m AS (SELECT w.row, q.item_id, w.i, w.k FROM w JOIN q ON w.phrase = q.phrase AND w.k = q.k),
h AS (SELECT row, count(DISTINCT spot) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS spot FROM (SELECT DISTINCT row, i, k FROM m)) GROUP BY row),
l AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (row) LEFT JOIN l USING (row)
"""
