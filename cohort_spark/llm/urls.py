"""URL filters: fixed host and path rules, then token combinations mined by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.llm.common import checked_broadcast, saved

#: Fixed rules: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A mined combination needs this share of the labelled urls, and this many of them.
SUPPORT, LEAST_URLS = 0.002, 5
#: It blocks where at least this share of its labelled urls is bad.
CONFIDENCE = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> F.Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: str) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: str, path: str, rules=RULES) -> F.Column:
    """The longest rule that fits, as struct (rule, verdict), or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col(host) == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(host: str, path: str) -> F.Column:
    """Distinct tokens: labels of the host and segments of the path, digits as 0."""
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "0"), "/"), lambda s: s != "")
    labels = F.filter(F.split(host, r"\."), lambda s: s != "")
    return F.array_distinct(F.concat(F.transform(labels, lambda s: F.concat(F.lit("h:"), s)), F.transform(segments, lambda s: F.concat(F.lit("p:"), s))))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST_URLS, confidence: float = CONFIDENCE, combined: int | None = None) -> DataFrame:
    """(rule_id, tokens, confidence) of the combinations that mark bad urls.

    ``labelled`` has tokens (distinct strings) and bad (boolean). FP-growth runs
    in Spark over the bad urls only: a rule for bad has no other antecedents.
    How often a combination occurs among all labelled urls is counted by the
    inverted index that also serves matching. Those with too small a support or
    confidence are pruned, and those of over ``combined`` tokens if it is given.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    most = max(least, -(-int(n * support * 1e6) // 1_000_000))
    bad = labelled.where("bad").select("tokens")
    m = bad.count()
    empty = spark.createDataFrame([], "rule_id long, tokens array<string>, confidence double")
    if m < most:
        return empty
    need = -(-int(most * confidence * 1e6) // 1_000_000)
    frequent = FPGrowth(itemsCol="tokens", minSupport=max(1, need - 0.5) / m).fit(bad).freqItemsets
    frequent = frequent if combined is None else frequent.where(F.size("items") <= combined)
    sets = frequent.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hits"))
    sets = saved(sets.withColumn("rule_id", F.xxhash64("tokens")), "itemsets")
    keyed = labelled.select(F.monotonically_increasing_id().alias("row"), "tokens")
    seen = matches(keyed, sets, "row").groupBy("rule_id").agg(F.count(F.lit(1)).alias("urls"))
    share = F.col("hits") / F.col("urls")
    return saved(sets.join(seen, "rule_id").where((F.col("urls") >= most) & (share >= confidence)).select("rule_id", "tokens", share.alias("confidence")), "mined")


def matches(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """(key, rule_id) of the rules whose tokens a row has all, by an inverted index token -> rules.

    Each rule is listed under the one of its tokens that the fewest rows have;
    a row that has this token is tested for the others. So a row and a rule meet
    once at most, and a common token lists only rules that have no rarer one.
    """
    seen = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    listed = rules.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))
    index = saved(listed.groupBy("rule_id").agg(rarest.alias("rarest"), F.first("tokens").alias("need")).select("rule_id", "rarest.token", "need"), "rule-index")
    met = rows.select(key, F.col("tokens").alias("own"), F.explode("tokens").alias("token")).join(checked_broadcast(index), "token")
    return met.where(F.size(F.array_except("need", "own")) == 0).select(key, "rule_id")


def token_groups(rows: DataFrame) -> DataFrame:
    """(token, group) of ``rows`` (row, tokens): tokens of exactly the same rows are a group, named by its smallest token.

    The rows of a token are told by their number and 128 bits of hashes.
    """
    seen = rows.select("row", F.explode("tokens").alias("token")).groupBy("token")
    seen = seen.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("y"))
    named = seen.groupBy("n", "x", "y").agg(F.min("token").alias("group"))
    return saved(seen.join(named, ["n", "x", "y"]).select("token", "group"), "token-groups")


def judged_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", bad: str = "quality = 0 or toxic = 1", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    Labels belong to the page of the same id; an id with several labels is bad
    if one of them is, and a label whose test is null counts as not bad. A url
    without a rule is blocked if a mined combination matches. Null urls and urls
    without ``://`` have empty host and path and no tokens: allowed.

    Tokens that occur in exactly the same labelled urls are one token to the
    miner, since n of them would make 2**n combinations of equal counts; a url
    matches where it has any one of them. The verdicts are those of all
    combinations.
    """
    parsed = pages.select(F.col(id_col).alias("_id"), host_of(url_col).alias("host"), path_of(url_col).alias("path"))
    parsed = parsed.withColumn("_rule", rule_of("host", "path", rules))
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).alias("_id")).agg(F.max(F.coalesce(F.expr(bad), F.lit(False))).alias("bad"))
    labelled = parsed.select("_id", tokens_of("host", "path").alias("tokens")).join(known, "_id")
    labelled = saved(labelled.select(F.monotonically_increasing_id().alias("row"), "tokens", "bad"), "labelled-urls")
    groups = token_groups(labelled)
    each = labelled.select("row", "bad", F.explode_outer("tokens").alias("token")).join(groups, "token", "left")
    mined = mined_rules(saved(each.groupBy("row", "bad").agg(F.collect_set("group").alias("tokens")), "grouped-urls"))
    used = saved(groups.join(mined.select(F.explode("tokens").alias("group")).distinct(), "group", "left_semi"), "mined-tokens")
    # each distinct (host, path) without a rule is matched once
    open_ = parsed.where("_rule is null").select("host", "path").distinct()
    met = open_.select("host", "path", F.explode(tokens_of("host", "path")).alias("token")).join(checked_broadcast(used), "token")
    keyed = met.groupBy("host", "path").agg(F.collect_set("group").alias("tokens")).select(F.struct("host", "path").alias("key"), "tokens")
    blocked = matches(keyed, mined, "key").select(F.col("key.host").alias("_host"), F.col("key.path").alias("_path")).distinct().withColumn("_blocked", F.lit(True))
    out = parsed.join(checked_broadcast(saved(blocked, "blocked")), (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    verdict = F.coalesce("_rule.verdict", F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def op8_url_rules(spark, sf_dir: str) -> DataFrame:
    return judged_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP8_SQL = f"""
WITH RECURSIVE parsed AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
ruled AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS k
  FROM parsed LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
r AS (SELECT page_id, host, path, rule, v FROM ruled WHERE k = 1),
tok AS (
  SELECT DISTINCT page_id, t FROM (
    SELECT page_id, 'h:' || unnest(string_split(host, '.')) AS t, host <> '' AS ok FROM r
    UNION ALL SELECT page_id, 'p:' || unnest(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/')), true FROM r)
  WHERE ok AND t NOT IN ('h:', 'p:')),
lab AS (SELECT doc_id AS page_id, bool_or(coalesce(quality = 0 OR toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
known AS (SELECT page_id, bad FROM lab WHERE page_id IN (SELECT page_id FROM r)),
n AS (SELECT greatest({LEAST_URLS}, CAST(ceil(count(*) * {SUPPORT}) AS BIGINT)) AS most FROM known),
often AS (
  SELECT page_id, t FROM tok JOIN known USING (page_id)
  WHERE t IN (SELECT t FROM tok JOIN known USING (page_id), n GROUP BY t, most HAVING count(*) >= most)),
combos AS (
  SELECT page_id, [t] AS c, t AS latest FROM often
  UNION ALL SELECT page_id, list_append(c, t), t FROM combos JOIN often USING (page_id) WHERE t > latest),
mined AS (
  SELECT c FROM combos JOIN known USING (page_id), n GROUP BY c, most
  HAVING count(*) >= most AND count(*) FILTER (bad) / count(*) >= {CONFIDENCE}),
lists AS (SELECT page_id, list(t) AS own FROM tok GROUP BY page_id),
hit AS (SELECT DISTINCT page_id FROM lists JOIN mined ON list_has_all(own, c))
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN page_id IN (SELECT page_id FROM hit) THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""
