"""SimHash near-duplicates: fingerprints, exact radius search, connected components; near-dedup by Jaccard similarity.

The search is exact for any radius. Fingerprints are cut into blocks; a pair
within the radius agrees on some set of whole blocks, so pairs meet in the
buckets of one of the tables. Keys are as long as the number of fingerprints
asks for. Inside buckets the fingerprints are compared bit-sliced: bit planes
hold 64 fingerprints of a bucket a word, carry-save counters add up 64 distances
at a time, and rows are abandoned once all their counters have run over. Small
buckets are compared many at once, each row with the planes of its own bucket.

Near-dedup judges pairs by the Jaccard similarity of their shingles. There
fingerprints only give the first pairs; a prefix filter over the shingles, which
loses no pair, gives all others.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from cohort_spark.llm.common import Own, checked_broadcast, discard, rolled, saved, split_words, text_batches, word_runs

#: Most fingerprints of one bucket that one task compares with as many others.
BLOCK = 2048
#: Fingerprints that share a bucket by chance, at most about, and most tables to get there.
BY_CHANCE, MOST_TABLES = 4, 300
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits within which near-dedup takes its first pairs if no radius is asked for.
NEAR = 6
#: Shingles are counted over all texts, in about so many hash buckets a text, at least and at most; counts are merged so many at once.
COUNTS_A_TEXT, LEAST_COUNTS, MOST_COUNTS, COUNTS_AT_ONCE = 16, 1 << 12, 1 << 24, 1 << 12
#: Hash classes by whose parities pairs are ruled out before their shingles are read; a multiple of 64.
PARITY_BITS = 1024
#: Buckets are compared with one of their texts each while over so many pairs a row are left and a round links this share of the rows.
PAIRS_A_ROW, FRUITFUL = 4, 0.02


def simhash(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of one text: bit set where over half the shingle hashes set it."""
    w = split_words(text)
    if not w:
        return 0
    w = [x.lower() for x in w]
    n = max(1, len(w) - words + 1)
    counts = np.zeros(64, np.int64)
    xxh = xxhash.xxh64_intdigest
    for i in range(0, n, 65536):
        m = min(n, i + 65536)
        h = np.fromiter((xxh(b" ".join(w[j : j + words]), seed) for j in range(i, m)), np.uint64, m - i)
        counts += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", words: int = 3) -> DataFrame:
    """``docs`` with its fingerprint as a signed long in column ``name``."""
    text_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, words) for t in texts], dtype="uint64").astype("int64")

    return docs.withColumn(name, fingerprints(F.col(text)))


def bit_planes(prints: np.ndarray, of: np.ndarray, lane: np.ndarray, lists: int, words: int) -> np.ndarray:
    """(64, lists, words) array; bit j of word w in plane p of a list is bit p of its fingerprint in lane 64 * w + j."""
    lanes = np.zeros((64, lists, 64 * words), np.uint8)
    lanes[:, of, lane] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(lanes, axis=2, bitorder="little").view("<u8").astype(np.uint64)


def within(planes: np.ndarray, of: np.ndarray, prints: np.ndarray, radius: int, ignore: np.ndarray) -> np.ndarray:
    """Packed matrix: bit j of row i is set where fingerprint i and lane j of its list differ in at most ``radius`` bits.

    ``of`` is each row's list, and ``ignore`` marks lanes that need no answer.
    Counters start so that they run over just beyond the radius; three planes
    enter by one carry-save step. Rows whose counters have all run over are
    abandoned.
    """
    width = radius.bit_length()
    start = (1 << width) - 1 - radius
    out = np.zeros_like(ignore)
    rows, over = np.arange(len(prints)), ignore.copy()
    counters = [np.full_like(over, ONES if start >> b & 1 else 0) for b in range(width)]

    def add(carry: np.ndarray, at: int) -> None:
        for b in range(at, width):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        np.bitwise_or(over, carry, out=over)

    def differs(p: int) -> np.ndarray:
        return planes[p][of] ^ np.where(prints >> np.uint64(p) & np.uint64(1), ONES, np.uint64(0))[:, None]

    for p in range(0, 63, 3):
        x, y, z = differs(p), differs(p + 1), differs(p + 2)
        xy = x ^ y
        add(xy ^ z, 0)
        add((x & y) | (z & xy), 1)
        if p % 6 == 3:
            left = (over != ONES).any(axis=1)
            if 2 * left.sum() <= len(left):
                rows, of, prints, over = rows[left], of[left], prints[left], over[left]
                counters = [c[left] for c in counters]
                if not len(rows):
                    return out
    add(differs(63), 0)
    out[rows] = ~over
    return out


def adjacencies(lists: list[np.ndarray], radius: int) -> Iterator[np.ndarray]:
    """For each bucket's fingerprints the packed matrix of the links among them, without those to themselves."""

    def compared(group: list[np.ndarray], words: int) -> np.ndarray:
        sizes = np.array([len(x) for x in group])
        prints, of = np.concatenate(group), np.repeat(np.arange(len(group)), sizes)
        lane = np.arange(len(prints)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        planes = bit_planes(prints, of, lane, len(group), words)
        pad = np.arange(64 * words) >= sizes[:, None]
        pad = np.packbits(pad, axis=1, bitorder="little").view("<u8").astype(np.uint64)
        out = []
        for i in range(0, len(prints), step := max(64, (1 << 15) // words)):
            some = slice(i, i + step)
            ignore = pad[of[some]]
            ignore[np.arange(len(ignore)), lane[some] // 64] |= np.uint64(1) << (lane[some] % 64).astype(np.uint64)
            out.append(within(planes, of[some], prints[some], radius, ignore))
        return np.concatenate(out)

    small = [x for x in lists if len(x) <= 64]
    near, at = compared(small, 1) if small else None, 0
    for x in lists:
        if len(x) <= 64:
            yield near[at : at + len(x)]
            at += len(x)
        else:
            yield compared([x], -(-len(x) // 64))


def local_links(near: np.ndarray) -> list[tuple[int, int]]:
    """Positions (root, member) that span the components of one bucket's links, a packed matrix."""
    left = np.full(near.shape[1], ONES)
    links = []
    for root in np.flatnonzero(near.any(axis=1)):
        bit = np.uint64(1) << np.uint64(root % 64)
        if not left[root // 64] & bit:
            continue
        left[root // 64] &= ~bit
        stack = [int(root)]
        while stack:
            fresh = near[stack.pop()] & left
            if fresh.any():
                left &= ~fresh
                found = np.flatnonzero(np.unpackbits(fresh.astype("<u8").view(np.uint8), bitorder="little"))
                stack += found.tolist()
                links += [(int(root), int(x)) for x in found]
    return links


def tables_for(radius: int, n: int) -> tuple[int, int]:
    """(blocks, blocks that agree) with blocks - agreeing >= radius, for ``n`` fingerprints.

    More agreeing blocks make longer keys and more tables; keys grow until a
    bucket has about ``BY_CHANCE`` of evenly spread fingerprints.
    """
    if not 0 <= radius <= 64:
        raise ValueError("radius must be from 0 to 64")
    if radius in (0, 64):
        return 1, int(radius == 0)
    agree = 1
    while agree < 64 - radius and (2.0 ** (64 * agree / (radius + agree))) * BY_CHANCE < n and comb(radius + agree + 1, agree + 1) <= MOST_TABLES:
        agree += 1
    return radius + agree, agree


def buckets(prints: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Column ``fps``: lists in which all pairs of ``prints`` (fp, distinct) within ``radius`` bits meet.

    A list is a bucket, or two blocks of one with over ``block`` fingerprints; so
    it holds about two blocks at most.
    """
    blocks, agree = tables_for(radius, prints.count())
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), agree):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    keyed = prints.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("at"),
    ).select("fp", "at.t", "at.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        keyed.join(sizes, ["t", "key"])
        .withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("t", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )


def fingerprint_links(prints: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that span every component of fingerprints linked at ``radius`` bits.

    ``prints`` has one long column ``fp``, distinct. A bucket of n fingerprints
    gives at most n edges a block pair, never all its pairs.
    """

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[tuple[int, int]] = []
            lists = [np.asarray(fps, np.int64) for fps in frame["fps"]]
            for signed, near in zip(lists, adjacencies([x.view(np.uint64) for x in lists], radius), strict=True):
                found += [(signed[a], signed[b]) for a, b in local_links(near)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return buckets(prints, radius, block).mapInPandas(compare, "a long, b long").distinct()


def near_pairs(prints: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Candidate pairs (a, b): each fingerprint with its smallest and its nearest neighbour in every bucket.

    All are within ``radius`` bits. A bucket of n gives at most 2 n pairs. The
    smallest neighbour is the same in all buckets of a dense group. Other pairs
    are left out, so near-dedup takes these as a start only and finds the rest by
    ``prefixes``.
    """

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: set[tuple[int, int]] = set()
            lists = [np.sort(np.asarray(fps, np.int64)) for fps in frame["fps"]]
            for signed, near in zip(lists, adjacencies([x.view(np.uint64) for x in lists], radius), strict=True):
                prints = signed.view(np.uint64)
                for i in np.flatnonzero(near.any(axis=1)):
                    own = np.flatnonzero(np.unpackbits(near[i].astype("<u8").view(np.uint8), bitorder="little"))
                    nearest = own[np.argmin(np.bitwise_count(prints[own] ^ prints[i]))]
                    found |= {(int(min(signed[i], signed[j])), int(max(signed[i], signed[j]))) for j in (own[0], nearest)}
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return buckets(prints, radius, block).mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), of any type that sorts; root is the component's smallest node.

    Alternating star joins: every node links its larger neighbours to its
    smallest one, then its smaller ones, until nothing changes. Each round is
    written to the shared folder, and neighbours are joined, never collected.
    """
    e = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, e = e, saved(small.union(least).distinct(), "edges")
        discard(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero, linked like any other. Rows with
    a null id get the component of their fingerprint; component_id is the
    smallest id in the component (null if it has none). Repeated rows repeat.
    """
    prints = saved(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), words=words).select("doc_id", F.col("fingerprint").alias("fp")), "fingerprints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = saved(components(fingerprint_links(prints.select("fp").distinct(), radius)), "linked")
    smallest = linked.join(least, linked.node == least.fp).groupBy("root").agg(F.min("least").alias("moved"))
    moved = linked.join(smallest, "root").select(F.col("node").alias("fp"), "moved")
    of = least.join(moved, "fp", "left").select("fp", F.coalesce("moved", "least").alias("component_id"))
    return prints.join(of, "fp").select(
        F.col("doc_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def shingle_set(text: str | None, words: int = 5) -> bytes:
    """The text's distinct shingle hashes, sorted, as 64-bit binary; a shorter text is one shingle."""
    w = [x.lower() for x in split_words(text)]
    n = max(1, len(w) - words + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[j : j + words])) for j in range(n)), np.uint64, n)
    return np.unique(h).tobytes()


def shingle_hashes(column, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingles as sorted hashes) of an Arrow string column; equal shingles have equal hashes."""
    for first, ids, bounds in word_runs(column, lower=True):
        runs = rolled(ids[0], words)
        for i in range(len(bounds) - 1):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= words:
                yield first + i, np.unique(runs[a : b - words + 1])
            else:  # one shingle
                yield first + i, rolled(ids[0][a:b], b - a) if b > a else np.zeros(1, np.uint64)


def dealt(counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """A block of counts as (a byte for each, or nothing; places; what is to be added there).

    A block with few counts is their places alone; in a fuller one a count over
    255 leaves its excess to a place.
    """
    full = 6 * np.count_nonzero(counts) > len(counts)
    low = np.minimum(counts, 255) if full else np.zeros_like(counts)
    at = np.flatnonzero(counts > low)
    return low.astype(np.uint8).tobytes() if full else b"", at.astype(np.uint16).tobytes(), (counts - low)[at].astype(np.uint32).tobytes()


def shingle_counts(texts: DataFrame, words: int, size: int) -> np.ndarray:
    """How many of ``texts`` (one column) have a shingle in each of ``size`` hash buckets.

    Every task counts its own texts and deals its counts in blocks, of which
    empty ones stay out; the blocks are added up as they arrive, so a task holds
    its own counts only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint32)
        for batch in batches:
            for _, h in shingle_hashes(batch.column(0), words):
                np.add.at(own, (h % np.uint64(size)).astype(np.int64), np.uint32(1))
        if own.any():
            blocks = own.reshape(-1, COUNTS_AT_ONCE)
            for i in range(0, len(blocks), 256):
                parts = [(j, *dealt(blocks[j])) for j in range(i, min(i + 256, len(blocks))) if blocks[j].any()]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*parts, strict=True)], ["block", "low", "at", "more"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, low, at, more in zip(*batch.to_pydict().values(), strict=True):
                total = sums.setdefault(block, np.zeros(COUNTS_AT_ONCE, np.int64))
                if low:
                    total += np.frombuffer(low, np.uint8)
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(more, np.uint32)
        for block, total in sums.items():
            part = np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part])], ["block", "counts"])

    dealt_counts = texts.mapInArrow(count, "block long, low binary, at binary, more binary")
    found = saved(dealt_counts.repartition("block").mapInArrow(add, "block long, counts binary"), "counts")
    out = np.zeros((size // COUNTS_AT_ONCE, COUNTS_AT_ONCE), np.uint32)
    for block, counts in zip(*found.toArrow().to_pydict().values(), strict=True):
        out[block] = np.frombuffer(counts, np.uint32)
    discard(found)
    return out.ravel()


def prefixes(rows: DataFrame, counts: np.ndarray, words: int, similarity: float) -> DataFrame:
    """(same, id, n, bits, prefix) of ``rows`` (same, id, text): its n shingles' first n - ceil(similarity n) + 1.

    ``bits`` says of each of ``PARITY_BITS`` hash classes whether an odd number
    of the shingles is in it, so two texts differ in at most as many bits as
    they have shingles that the other has not. All texts order their shingles alike, rare ones first. Two texts of at least
    this Jaccard similarity have at least ceil(similarity n) of either's shingles
    in common, so their prefixes share a shingle, in whatever order.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, lists, bits = [], [], []
            for _, h in shingle_hashes(batch.column("text"), words):
                order = np.lexsort((h, counts[(h % np.uint64(len(counts))).astype(np.int64)]))
                sizes.append(len(h))
                odd = np.bincount((h % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) % 2
                bits.append(np.packbits(odd.astype(bool), bitorder="little").view("<i8"))
                lists.append(h[order[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]])
            if sizes:
                offsets = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).view(np.int64)))
                parity = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * (PARITY_BITS // 64)), pa.array(np.concatenate(bits)))
                yield pa.RecordBatch.from_arrays([batch.column("same"), batch.column("id"), pa.array(sizes, pa.int32()), parity, found], ["same", "id", "n", "bits", "prefix"])

    longs = T.ArrayType(T.LongType())
    kinds = T.StructType([*rows.select("same", "id").schema, T.StructField("n", T.IntegerType()), T.StructField("bits", longs), T.StructField("prefix", longs)])
    return rows.mapInArrow(cut, kinds)


def may_be_similar(similarity: float) -> F.Column:
    """Whether rows a and b of one bucket (n, pos) can reach the similarity, by sizes and by the shingles before and after this one."""
    n, m = F.col("a.n"), F.col("b.n")
    common = F.least("a.pos", "b.pos") + F.least(n - F.col("a.pos"), m - F.col("b.pos"))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (common >= similarity / (1 + similarity) * (n + m) - 1e-6)


def parities_near(similarity: float, a: str, b: str, n: str, m: str) -> F.Column:
    """Whether texts of n and m shingles can reach the similarity by their parities; an expression without arrays, so it stays in generated code."""
    apart = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    return apart <= (1 - similarity) / (1 + similarity) * (F.col(n) + F.col(m)) + 1e-6


def share_enough(similarity: float) -> F.Column:
    """Whether texts of n and m shingles, k of them in both prefixes, can reach the similarity.

    A shingle in common that is not in both prefixes is behind the prefix that
    ends first, where at most ceil(similarity n) - 1 or ceil(similarity m) - 1 are.
    """
    behind = F.ceil(similarity * F.greatest("n", "m") - 1e-9) - 1
    return F.col("k") + behind >= similarity / (1 + similarity) * (F.col("n") + F.col("m")) - 1e-6


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int | None = None, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: one of each text, and of a group of near-duplicates the smallest id.

    A pair links if the Jaccard similarity of the texts' sets of ``words``-word
    shingles (A-Z lower-cased) is at least ``similarity``, and, if ``radius`` is
    given, their SimHash fingerprints differ in at most so many bits. Groups
    are the components of all such links. First each text is judged with its
    nearest and its smallest neighbour by SimHash, which joins most of a dense
    group. Then texts meet in the buckets of their ``prefixes``, where
    every pair of enough similarity meets: while many pairs are left, each bucket
    is judged against one of its texts; in the end all pairs that share a bucket
    and are not in one group yet. So no pair is missed, and a dense group need
    not give all its pairs. Pairs that the parities of their shingles rule out
    are dropped, exactly, before any text is read again.

    Null and empty texts count as one text. Null ids come after all others;
    of rows equal in id and text one stays.
    """
    own = Own(docs)
    id_, text = own[id_col], own[text_col]
    rows = own.frame.withColumn("_same", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))
    prints = with_fingerprint(rows, text, "_fp").select(F.col("_same").alias("same"), F.col(id_).alias("id"), F.col("_fp").alias("fp"))
    prints = saved(prints, "prints")
    ids = prints.groupBy("same", "id").agg(F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "same", "n")
    texts = ids.groupBy("same").agg(F.min(order).alias("ord"), F.first("fp").alias("fp"))
    texts = saved(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    discard(prints)

    named = rows.select(F.col("_same").alias("same"), F.col(id_).alias("id"), F.col(text).alias("text"))
    size = min(max(1 << (COUNTS_A_TEXT * texts.count()).bit_length(), LEAST_COUNTS), MOST_COUNTS)
    cut = prefixes(named, shingle_counts(named.select("text"), words, size), words, similarity)
    which = texts.select(F.col("same").alias("_s"), F.col("ord.id").alias("_id"), "node", "fp")
    cut = cut.join(checked_broadcast(which), (F.col("same") == F.col("_s")) & F.col("id").eqNullSafe(F.col("_id")))
    every = saved(cut.select("node", "n", "fp", "bits", "prefix").dropDuplicates(["node"]), "prefixes")
    facts = every.select("node", "n", "fp", "bits")
    shared = every.select("node", F.explode("prefix").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h")
    at = every.select("node", "n", F.posexplode("prefix").alias("pos", "h")).join(checked_broadcast(saved(shared, "shared")), "h")
    buckets_ = saved(at.select("h", "node", "n", "pos"), "buckets")

    @F.pandas_udf("binary")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words) for t in texts])

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
            out.append(common >= similarity * (len(x) + len(y) - common))
        return pd.Series(out, dtype=bool)

    judged, links = [], []

    def judge(pairs: DataFrame) -> int:
        """How many new pairs (x, y) link; they and their links are kept."""
        pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        if judged:
            pairs = pairs.join(functools.reduce(DataFrame.union, judged), ["x", "y"], "left_anti")
        judged.append(pairs := saved(pairs, "pairs"))
        if pairs.isEmpty():
            return 0
        left, right = (facts.select(*[F.col(c).alias(f"{c}_{side}") for c in facts.columns]) for side in "xy")
        close = pairs.join(left, F.col("x") == F.col("node_x")).join(right, F.col("y") == F.col("node_y"))
        close = close.where(parities_near(similarity, "bits_x", "bits_y", "n_x", "n_y"))
        if radius is not None:
            close = close.where(F.bit_count(F.col("fp_x").bitwiseXOR(F.col("fp_y"))) <= radius)
        close = saved(close.select("x", "y"), "close")
        met = close.select(F.col("x").alias("node")).union(close.select("y")).distinct()
        wanted = checked_broadcast(met.join(texts, "node").select(F.col("same").alias("_s"), F.col("ord.id").alias("_id"), "node"))
        one = rows.join(wanted, (F.col("_same") == F.col("_s")) & F.col(id_).eqNullSafe(F.col("_id")))
        shingled = saved(one.select("node", text).dropDuplicates(["node"]).select("node", sets(text).alias("set")), "sets")
        both = close.join(shingled.toDF("x", "set_x"), "x").join(shingled.toDF("y", "set_y"), "y")
        both = both.where(alike("set_x", "set_y"))
        links.append(saved(both.select(F.col("x").alias("a"), F.col("y").alias("b")), "links"))
        discard(shingled, close)
        return links[-1].count()

    def groups() -> DataFrame:
        return components(functools.reduce(DataFrame.union, links))

    leads = texts.groupBy("fp").agg(F.min("node").alias("lead"))
    twins = texts.join(leads, "fp").where("node <> lead").select(F.col("lead").alias("x"), F.col("node").alias("y"))
    ends = near_pairs(leads.select("fp"), NEAR if radius is None else radius)
    judge(twins.union(ends.join(leads.toDF("a", "x"), "a").join(leads.toDF("b", "y"), "b").select("x", "y")))

    turn, last, fruitful = 0, False, True
    while not last:
        if links:
            at = buckets_.join(groups().toDF("node", "root"), "node", "left").withColumn("c", F.coalesce("root", "node"))
        else:
            at = buckets_.withColumn("c", F.col("node"))
        at = saved(at.select("h", "node", "n", "pos", "c"), "grouped")
        sizes = at.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("r"), "node", "n", "pos", "c")).alias("lead"))
        open_ = sizes.groupBy("h").agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("same"), F.count(F.lit(1)).alias("groups"), F.min("lead").alias("lead")).where("groups > 1")
        open_ = saved(open_, "open")
        left = open_.agg(F.sum("k").alias("rows"), F.sum((F.col("k") * F.col("k") - F.col("same")) / 2).alias("pairs")).first()
        if not left.rows:
            break
        members = at.join(open_.select("h"), "h")
        last = not fruitful or left.pairs <= PAIRS_A_ROW * left.rows
        if last:  # parities come along, so that pairs which they rule out are never made
            members = paired = saved(members.join(facts.select("node", "bits"), "node"), "members")
        others = members.select("*").alias("a") if last else open_.select("h", "lead.*").alias("a")
        members = members.alias("b")
        apart = (F.col("a.h") == F.col("b.h")) & (F.col("a.c") != F.col("b.c")) & may_be_similar(similarity)
        if last:
            apart = apart & (F.col("a.node") < F.col("b.node")) & parities_near(similarity, "a.bits", "b.bits", "a.n", "b.n")
        pairs = others.join(members, apart)
        if last:  # all buckets that a pair shares are here, so their number bounds what it has in common
            met = pairs.groupBy(F.col("a.node"), F.col("b.node"), F.col("a.n").alias("n"), F.col("b.n").alias("m")).agg(F.count(F.lit(1)).alias("k"))
            pairs = met.where(share_enough(similarity))
        linked = judge(pairs.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")))
        if last:
            discard(paired)
        turn, fruitful = turn + 1, linked > FRUITFUL * left.rows
        discard(at, open_)
    stays = texts
    if links:
        grouped = groups().join(texts.select("node", "ord"), "node")
        first = grouped.groupBy("root").agg(F.min("ord").alias("first"))
        gone = saved(grouped.join(first, "root").where("ord <> first").select("node"), "gone")
        stays = texts.join(gone, "node", "left_anti")
    stays = saved(stays.select(F.col("same").alias("_s"), F.col("ord.id").alias("_id"), F.col("ord.n").alias("_n")), "stays")
    discard(texts, every, buckets_, *judged, *links)
    kept = rows.join(checked_broadcast(stays), (F.col("_same") == F.col("_s")) & F.col(id_).eqNullSafe(F.col("_id")))
    if stays.where("_n > 1").isEmpty():
        return own.restored(kept)
    return own.restored(kept.where("_n = 1")).union(own.restored(kept.where("_n > 1").dropDuplicates(["_same"])))
