"""Projections, filters, sets."""

from pyspark.sql import functions as F

from cohort_spark.operators import projection as P
from cohort_spark.operators import sets
from cohort_spark.queries.base import Registry
from cohort_spark.sources import registry as R

Q = Registry()


@Q("SELECT n_nationkey, n_name, '' AS study_id, [] :: VARCHAR[] AS paths, n_regionkey FROM nation")
def pf1_core_columns(t):
    """Absent core columns with typed defaults, core first."""
    return R.with_core_columns(t("nation"), ["n_nationkey", "n_name", "study_id", "paths"], ["paths"])


@Q("""SELECT CAST(o_orderkey AS VARCHAR) AS key, coalesce(o_orderstatus, '') AS status, [o_orderpriority, o_orderstatus] AS tags,
             [CAST(o_orderkey AS BIGINT), CAST(o_custkey AS BIGINT)] AS radiology_series_slice_counts FROM orders""")
def pf2_normalized(t):
    """Lists parsed from printed text, text without null."""
    o = t("orders").select(
        F.col("o_orderkey").alias("key"),
        F.col("o_orderstatus").alias("status"),
        F.concat(F.lit("['"), "o_orderpriority", F.lit("' '"), "o_orderstatus", F.lit("']")).alias("tags"),
        F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(", "), F.col("o_custkey").cast("string"), F.lit("]")).alias("radiology_series_slice_counts"),
    )
    return R.normalized(o, ["key", "status", "tags"], ["tags"])


@Q("SELECT doc_id, toxic = 1 AS accepted, CAST(quality AS INTEGER) AS slice_count, '' AS note, [] :: VARCHAR[] AS paths FROM labels")
def pf4_typed_manifest(t):
    l = t("labels").select("doc_id", F.when(F.col("toxic") == 1, "Yes").otherwise("no").alias("accepted"), F.col("quality").cast("string").alias("slice_count"))
    return P.typed_manifest(l, lists=["paths"], texts=["note"], flags=["accepted"], counts=["slice_count"])


@Q("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def pf5_allowed(t):
    return P.allowed(t("orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority")


@Q("SELECT DISTINCT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def pf6_chosen(t):
    """All found values but the excluded ones."""
    named = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.chosen(named.withColumn("n_name", F.when(F.col("r_name") == "ASIA", "out").otherwise(F.col("n_name"))), "n_name", excluded=["out"])


@Q("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def pf7_having(t):
    lists = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderkey").alias("orders"))
    both = t("customer").join(lists, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.array().cast("array<bigint>")))
    return P.having(P.having(both, "orders"), "c_name").select("c_custkey", "c_name")


@Q("""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare FROM pages),
      inv AS (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS path FROM pages WHERE page_id % 3 <> 0)
      SELECT page_id FROM p WHERE bare IN (SELECT path FROM inv) OR replace(bare, 'https:', 'http:') IN (SELECT path FROM inv)""")
def pf8_existing(t):
    """Rows of which a referenced path is in the inventory."""
    p = t("pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("bare"))
    rows = p.select("page_id", F.array("bare", F.replace("bare", F.lit("https:"), F.lit("http:"))).alias("refs"))
    files = p.where("page_id % 3 <> 0").select(F.col("bare").alias("path")).distinct()
    return P.with_existing(rows, "refs", files, "page_id").select("page_id")


@Q("SELECT doc_id FROM documents WHERE contains(text, 'License') OR contains(text, 'licensed')")
def pf9_containing(t):
    from cohort_spark.functions.arrays import containing

    d = t("documents").select("doc_id", containing(F.array("text"), ["License", "licensed"]).alias("hits"))
    return P.having(d, "hits").select("doc_id")


@Q("""SELECT page_id FROM pages WHERE NOT (regexp_extract(url, '://([^./]*)[.]', 1) = 'www' AND
             starts_with(regexp_extract('-' || regexp_extract(url, '/([0-9]{2})[0-9]*', 1), '-([0-9]{2})', 1), '11'))""")
def pf11_no_normal_tissue(t):
    """Rows of one source whose code starts with 11 go."""
    p = t("pages").select("page_id", F.regexp_extract("url", "://([^./]*)[.]", 1).alias("source"), F.concat(F.lit("-"), F.regexp_extract("url", "/([0-9]{2})[0-9]*", 1)).alias("stem"))
    return P.without_normal_tissue(p, "stem", "source", "www").select("page_id")


@Q("""WITH q AS (SELECT quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem, q WHERE l_quantity BETWEEN lo AND hi""")
def pf12_quantile_band(t):
    return P.quantile_band(t("lineitem"), "l_quantity", 0.05, 0.95).select("l_orderkey", "l_linenumber", "l_quantity")


@Q("SELECT doc_id, lang FROM documents WHERE NOT (contains(lower(text), 'idiot') OR contains(lower(text), 'mit license'))")
def pf13_signatures(t):
    """Rows whose text holds a signature go."""
    d = t("documents")
    return P.without_signature(d, d, "doc_id", "text", ["idiot", "mit license"]).select("doc_id", "lang")


@Q("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def pf14_work_list(t):
    l = t("labels").select("doc_id", (F.col("quality") == 1).alias("accepted"), F.array("doc_id").alias("inputs"), (F.col("toxic") == 1).alias("done"))
    return P.work_list(l, "accepted", "inputs", "done").select("doc_id")


@Q("""SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN 'report' ELSE 'image' END AS route
      FROM events WHERE event_type <> 'view'""")
def pf15_routed(t):
    return P.routed(t("events"), "event_type", reports=["click"], exclude=["view"]).select("event_id", "event_type", "route")


@Q("SELECT o_orderkey FROM orders WHERE lower(trim(o_orderstatus)) = 'f'")
def pf16_split_rows(t):
    return P.split_rows(t("orders"), "f", "o_orderstatus").select("o_orderkey")


@Q("SELECT s_suppkey, s_name FROM supplier")
def pf18_picked(t):
    return R.picked(t("supplier"), ["s_suppkey", "s_name"])


@Q("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS o_orderpriority,
             CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders""")
def pf20_reset(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return P.reset(o, F.col("o_orderstatus") == "F", ["o_orderpriority", "o_totalprice"]).drop("o_orderstatus")


@Q("SELECT o_orderkey, 0 AS zero FROM orders")
def pf21_no_empty_columns(t):
    """Columns that are blank everywhere go; zeros are values."""
    o = t("orders").select("o_orderkey", F.lit(None).cast("string").alias("gone"), F.lit("  ").alias("blank"), F.array().cast("array<string>").alias("none"), F.lit(0).alias("zero"))
    return P.without_empty_columns(o, ["gone", "blank", "none", "zero"])


@Q("SELECT o_orderkey, o_orderpriority = '1-URGENT' OR o_orderstatus = 'F' AS evidence FROM orders")
def pf22_evidence(t):
    lists = t("orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.array("o_orderkey")).alias("a"), F.when(F.col("o_orderstatus") == "F", F.array("o_orderkey")).alias("b"))
    return lists.select("o_orderkey", P.evidence(["a", "b"]).alias("evidence"))


@Q("""SELECT conv_id, list(role ORDER BY turn) = list(CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END ORDER BY turn) AS reusable
      FROM conversations GROUP BY conv_id""")
def pf23_reusable(t):
    """A recorded list must equal the wanted one in order and count."""
    by = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", c.alias("x")))), lambda s: s["x"])
    c = t("conversations").groupBy("conv_id").agg(by(F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")).alias("wanted"), by(F.col("role")).alias("recorded"), F.count(F.lit(1)).alias("n"))
    return c.select("conv_id", P.reusable(c, "wanted", "recorded", "n").alias("reusable"))


@Q("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'F'
      UNION ALL SELECT o_orderkey + 100000000, 'F', 0.5 FROM orders WHERE o_orderstatus = 'O'""")
def so1_replace_source(t):
    """One source's slice is replaced, stale columns go."""
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn("stale", F.lit(""))
    fresh = o.where("o_orderstatus = 'O'").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), "o_orderstatus", F.lit(0.5).alias("o_totalprice"))
    return sets.replace_source(o, fresh, "F", "o_orderstatus")


@Q("SELECT doc_id, CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'val' ELSE 'test' END AS split FROM documents")
def so2_union(t):
    d = t("documents")
    return sets.union_all([d.where(c).select("doc_id", F.lit(s).alias("split")) for c, s in (("lang = 'en'", "train"), ("lang = 'de'", "val"), ("coalesce(lang, '') not in ('en', 'de')", "test"))])


@Q("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS o_orderstatus FROM orders
      UNION ALL SELECT -o_orderkey - 1, 'new' FROM orders WHERE o_orderkey % 4 = 0""")
def so3_upsert(t):
    old = t("orders").select("o_orderkey", "o_orderstatus")
    hit = old.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("new").alias("o_orderstatus"))
    return sets.upsert(old, hit.union(hit.select(-F.col("o_orderkey") - 1, "o_orderstatus")), "o_orderkey")
