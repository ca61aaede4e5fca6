"""Packing tokenised documents into fixed sequences, shortest pack first."""

from __future__ import annotations

import heapq
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.llm.common import saved, text_batches

CAPACITY = 2048
END_ID = 1
#: Pieces of a length that one task ranks, about.
RANK_ROWS = 1_000
#: Bytes, about, of the chunks that a Python worker holds with their ids; it then goes back to half, the first it met.
MEMO_BYTES = 128 << 20
#: Characters that are cut and looked up at once; ids of one batch that leave a task.
CHARS, ID_BYTES = 1 << 20, 4 << 20
#: Characters other than white space that every reader takes for such, ASCII, and Latin letters and signs.
ODD = re.compile("[^ \t\n\r!-~\xa1-\u024f]")
PLAIN_SPACE = re.compile(r"[ \t\n\r]+")


def text_slices(text: str, most: int = CHARS) -> Iterator[str]:
    """A text in slices of about ``most`` characters, cut at white space."""
    at = 0
    while at < len(text):
        space = PLAIN_SPACE.search(text, at + most)
        end = space.start() if space else len(text)
        yield text[at:end]
        at = end


def packed_ids(ids: list[int]) -> bytes:
    """Ids as little-endian 32-bit bytes."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes, one white-space chunk at a time.

    The tokenizer lower-cases, cuts at white space and between letters and other
    signs before anything else, so a text's ids are those of its chunks, and a
    chunk's that ends in a letter and a stop or comma are those of its word and
    of the sign, where the word lower-cased still ends in a letter. Texts of Latin letters, for which Python lower-cases alike, are
    lower-cased first. Words of such letters alone need no normalising and no
    cutting, so ``bare`` encodes them without. Chunks met before are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        plain = json.loads(self.tokenizer.to_str())
        plain |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}}
        self.bare = Tokenizer.from_str(json.dumps(plain))
        self.held: dict[str, bytes] = {}
        self.size = 0
        self.learn({".", ","})

    def learn(self, chunks: set[str]) -> None:
        """Hold the ids of chunks that are not held."""
        ended = {w for w in chunks if len(w) > 1 and w[-1] in ".," and w[-2] < "\u0250" and w[-2].lower()[-1].isalpha()}
        fresh = [w for w in (chunks - ended) | {w[:-1] for w in ended} if w not in self.held]
        words = [w for w in fresh if w.isalpha() and w.islower() and (w.isascii() or max(w) < "\u0250")]
        for own, tokenizer in ((words, self.bare), (list(set(fresh).difference(words)), self.tokenizer)):
            for i in range(0, len(own), 4096):
                part = own[i : i + 4096]
                for w, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.held[w] = packed_ids(e.ids)
                    self.size += 200 + 2 * len(w)
        for w in ended:
            self.held[w] = self.held[w[:-1]] + self.held[w[-1]]
            self.size += 200 + 2 * len(w)

    def looked_up(self, texts: list[str]) -> list[bytes]:
        parts = [PLAIN_SPACE.split(t) if ODD.search(t) else t.lower().split() for t in texts]
        if self.size > MEMO_BYTES:
            kept = dict(islice(self.held.items(), len(self.held) // 2))  # the first it met: mostly the common ones
            self.held, self.size = kept, sum(200 + 2 * len(w) for w in kept)
        self.learn(set().union(*parts).difference(self.held))
        return [b"".join(map(self.held.__getitem__, ws)) for ws in parts]

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; about ``CHARS`` characters are in work at once."""
        group, size = [], 0
        for t in texts:
            if len(t or "") > CHARS:
                yield from self.looked_up(group)
                group, size = [], 0
                yield b"".join(self.looked_up([part])[0] for part in text_slices(t))
                continue
            group.append(t or "")
            size += len(group[-1])
            if size > CHARS:
                yield from self.looked_up(group)
                group, size = [], 0
        yield from self.looked_up(group)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One tokenizer for each Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids_crc32, ids): each text's ids and id 1, cut into full pieces and a rest.

    ``ids`` holds the piece's ids as little-endian unsigned 32-bit binary; it is
    left out without ``with_ids``.
    """
    text_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:5]], *[pa.array(c, pa.binary()) for c in cols[5:]]], names + ["ids"] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer_of(vocabulary)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            out, size = [], 0
            for doc, raw in zip(batch.column("doc_id").to_pylist(), own.ids(batch.column("text").to_pylist()), strict=True):
                raw += end
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    piece = raw[4 * s : 4 * (s + capacity)]
                    out.append((doc, s, len(piece) // 4, n, zlib.crc32(piece), *[piece] * with_ids))
                    size += len(piece)
                    if size >= ID_BYTES:
                        yield batch_of(out)
                        out, size = [], 0
            if out:
                yield batch_of(out)

    kinds = ", ".join(f"{c} long" for c in names) + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, kinds)


def plan_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[dict]:
    """Shortest-pack-first over a histogram {length: count}; rows place ranks of a length in sequences.

    Lengths are placed longest first. Each goes to the open pattern with the
    shortest total that takes it, for as many of that pattern's sequences as
    there are pieces left; what remains of the pattern stays open as it was. The
    state is patterns with their counts, so the work depends on the number of
    lengths (at most ``capacity``), not on the number of pieces.

    A row (length, rank, until, per, first, offset) says: of this length, pieces
    ranked from ``rank`` to before ``until`` go ``per`` to a sequence, from
    sequence ``first`` on, one behind the other from ``offset``. An open pattern
    is a run of sequences, so that splitting it leaves earlier rows valid.
    """
    open_runs: list[tuple[int, int, int]] = []  # (total, first sequence, sequences)
    rows, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if open_runs and open_runs[0][0] + length <= capacity:
                total, first, n = heapq.heappop(open_runs)
                # raise the shortest run at most to where the next one is shortest
                nearest = open_runs[0][0] if open_runs else capacity
                per = max(1, min((capacity - total) // length, -(-(nearest - total) // length) or 1))
            else:
                total, first, n, per = 0, fresh, left, 1
                fresh += n
            whole = min(n, left // per)
            if not whole:  # the last few pieces take one sequence
                whole, per = 1, min(per, left)
            used = whole * per
            rows.append({"length": length, "rank": rank, "until": rank + used, "per": per, "first": first, "offset": total})
            heapq.heappush(open_runs, (total + per * length, first, whole))
            if n > whole:
                heapq.heappush(open_runs, (total, first + whole, n - whole))
            left, rank = left - used, rank + used
    return rows


def ranked(rows: DataFrame, by: str, order: list[str], buckets: str) -> DataFrame:
    """``rows`` with ``rank``, from 0 and gapless within ``by``, without one task for a value of ``by``.

    Rows are numbered within (value, bucket) and shifted by the rows of the
    value's earlier buckets; the column ``buckets`` says how many a value has.
    """
    salted = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col(buckets)))
    counts = salted.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    shift = counts.select(by, "_bucket", (F.sum("_n").over(Window.partitionBy(by).orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(by, "_bucket").orderBy(*order)) - 1
    return salted.withColumn("_inner", inner).join(shift, [by, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_inner")).drop("_bucket", "_inner", "_before")


def packed_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Every id of every text in exactly one piece, pieces packed into sequences of at most ``capacity``.

    Columns: doc_id, start, length, doc_tokens, ids_crc32, sequence_id, offset,
    and ids (binary) unless ``with_ids`` is off; other columns of ``docs`` are
    dropped. A null or empty text is its end id alone. Rows with a null id are
    packed like others. Repeated rows are packed once each; rows equal in all
    columns are interchangeable. Sequences are numbered from 0 and fill from
    offset 0 without gaps. No rows, no pieces.

    The histogram of piece lengths (at most ``capacity`` rows) is the only thing
    the driver sees; its plan has a few rows a length and is broadcast. Only
    narrow rows are ranked; the ids are joined to their places last.
    """
    cut = pieces(docs, vocabulary, id_col, text_col, capacity, with_ids).withColumn("piece", F.monotonically_increasing_id())
    cut = saved(cut, "pieces")
    spark = docs.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_patterns(histogram, capacity)
    schema = "length long, rank long, until long, per long, first long, offset long"
    slots = spark.createDataFrame([tuple(r.values()) for r in plan], schema)
    slots = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank", "until", "per", "first", "offset"))).alias("slots"))
    buckets = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in histogram.items()], "length long, buckets long")
    narrow = cut.drop("ids").join(F.broadcast(buckets), "length")
    placed = ranked(narrow, "length", ["doc_id", "start", "doc_tokens", "ids_crc32"], "buckets").join(F.broadcast(slots), "length")
    slot = F.try_element_at(F.filter("slots", lambda s: (F.col("rank") >= s["rank"]) & (F.col("rank") < s["until"])), F.lit(1))
    into = (F.col("rank") - F.col("slot.rank")).cast("long")
    placed = placed.withColumn("slot", slot).select(
        "piece",
        F.col("doc_id").alias(id_col),
        "start",
        "length",
        "doc_tokens",
        "ids_crc32",
        (F.col("slot.first") + F.floor(into / F.col("slot.per"))).cast("long").alias("sequence_id"),
        (F.col("slot.offset") + F.pmod(into, F.col("slot.per")) * F.col("length")).cast("long").alias("offset"),
    )
    return (placed.join(cut.select("piece", "ids"), "piece") if with_ids else placed).drop("piece")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
