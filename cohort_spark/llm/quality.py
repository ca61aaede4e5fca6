"""Quality rules per text, and host verdicts from shrunken failure rates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.common import Own, checked_broadcast, saved, split_words, text_batches

SYMBOLS = re.compile(r"[#*$%&|<>]")
WINDOW = 5
#: A host is rejected when its shrunken failure rate is over this.
HOST_LIMIT = 0.5
#: Pseudo-documents of the prior when host rates vary no more than chance, or only one host exists.
FLAT_PRIOR = 1000.0
SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words inside ``k``-word windows that occur twice or more, the first included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(k)), strict=False))
    seen: set = set()
    twice: set = set()
    for w in windows:
        if w in seen:
            twice.add(w)
        seen.add(w)
    if not twice:
        return 0
    covered = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + k - max(i, end)
            end = i + k
    return covered


def signals(text: str | None) -> tuple[int, int, int, int, int]:
    """The five signals of one text, in the order of ``SIGNALS``."""
    if not text:
        return 0, 0, 0, 0, 0
    words = split_words(text)
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode())
    lines = Counter(x for x in text.split("\n") if split_words(x)) if "\n" in text else {}
    return len(words), chars, len(SYMBOLS.findall(text)), sum(lines.values()) - len(lines) if lines else 0, repeated_words(words)


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with struct column ``_signals``; every text is read whole."""
    text_batches(docs.sparkSession)

    @F.pandas_udf(SIGNALS)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([signals(t) for t in texts], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")

    return docs.withColumn("_signals", measured(F.col(text)))


def base_failed(s: str = "_signals") -> F.Column:
    return (F.col(f"{s}.n_words") < 10) | (100 * F.col(f"{s}.n_repeat_words") > 20 * F.col(f"{s}.n_words"))


def host_rates(judged: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """(host, n, failures, rate): failure rates shrunk by a beta prior fitted to all hosts.

    The prior's mean is the overall rate m; its weight s comes from the spread
    of host rates beyond chance (method of moments over hosts weighted by size):
    between = sum n (p - m)^2 / N - (H - 1) / N * m (1 - m), and
    s = m (1 - m) / between - 1. Without such a spread s is ``FLAT_PRIOR``, so
    small hosts follow the overall rate. rate = (failures + m s) / (n + s).
    """
    return shrunken(judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures")))


def shrunken(hosts: DataFrame) -> DataFrame:
    """``hosts`` (host, n, failures) with the ``rate`` of ``host_rates``; counts may be as large as a long."""
    t = hosts.agg(
        F.sum("n").alias("rows"),
        F.sum("failures").alias("bad"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("failures").cast("double") * F.col("failures") / F.col("n")).alias("squares"),
    ).first()
    rows, bad = t.rows or 0, t.bad or 0
    mean = bad / rows if rows else 0.0
    chance = mean * (1 - mean)
    between = ((t.squares or 0.0) - rows * mean * mean - (t.hosts - 1) * chance) / rows if rows else 0.0
    weight = FLAT_PRIOR if between <= 0 or chance == 0 else min(FLAT_PRIOR, max(1e-3, chance / between - 1))
    return hosts.withColumn("rate", (F.col("failures") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight)))


def judge_hosts(judged: DataFrame, host: str = "host", failed: str = "failed", limit: float = HOST_LIMIT) -> DataFrame:
    """``judged`` with ``host_rejected``: its host's shrunken failure rate is over ``limit``.

    A null host is a host of its own. Only rejected hosts are joined back, by
    broadcast when counted few, otherwise shuffled with skew left to adaptive
    execution; all rows are kept.
    """
    bad = host_rates(judged, host, failed).where(F.col("rate") > limit).select(F.col("host").alias("_bad_host"), F.lit(True).alias("_bad"))
    return judged.join(checked_broadcast(bad), F.col(host).eqNullSafe(F.col("_bad_host")), "left").withColumn("host_rejected", F.coalesce("_bad", F.lit(False))).drop("_bad_host", "_bad")


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row of ``docs``: id, the five signals, base_failed, host_rejected, kept.

    Null and empty texts have no words, so they fail. Rows with a null id or a
    null host are judged like others; repeated rows repeat; no rows, no result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.col(text_col).alias("_text"))
    measured = with_signals(rows, "_text").select("_id", "_host", "_signals", base_failed().alias("_failed"))
    judged = judge_hosts(saved(measured, "signals"), "_host", "_failed", limit)
    return judged.select(
        F.col("_id").alias(id_col),
        "_signals.*",
        F.col("_failed").alias("base_failed"),
        "host_rejected",
        (~F.col("_failed") & ~F.col("host_rejected")).alias("kept"),
    )


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only."""
    own = Own(docs)
    host = own[host_col]
    flagged = with_signals(own.frame, own[text_col]).withColumn("_failed", base_failed()).drop("_signals")
    # the signals are computed again for the rows, which is cheaper than to keep a copy of all texts
    bad = host_rates(flagged, host, "_failed").where(F.col("rate") > limit).select(F.col("host").alias("_bad_host"))
    passed = flagged.where(~F.col("_failed"))
    return own.restored(passed.join(checked_broadcast(saved(bad, "bad-hosts")), F.col(host).eqNullSafe(F.col("_bad_host")), "left_anti"))


def op6_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge_documents(docs).drop("host_rejected")


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (
  SELECT doc_id, unnest(range(i, i + 5)) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM rep GROUP BY doc_id),
dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
t AS (SELECT sum(n) AS rows, sum(f) / sum(n) AS m, count(*) AS hosts, sum(f * f / n) AS sq FROM h),
v AS (SELECT m, m * (1 - m) AS c, (sq - rows * m * m - (hosts - 1) * m * (1 - m)) / rows AS between_ FROM t),
s AS (SELECT m, CASE WHEN between_ <= 0 OR c = 0 THEN {FLAT_PRIOR}
                     ELSE least({FLAT_PRIOR}, greatest(0.001, c / between_ - 1)) END AS w FROM v),
r AS (SELECT source, (f + m * w) / (n + w) > {HOST_LIMIT} AS rejected FROM h, s)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT r.rejected AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""
