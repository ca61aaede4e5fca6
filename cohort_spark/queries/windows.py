"""Windows, samples, sorts."""

from pyspark.sql import functions as F

from cohort_spark.operators import windows as W
from cohort_spark.queries.aggregations import _STEP, grid
from cohort_spark.queries.base import Registry

Q = Registry()


@Q("SELECT conv_id, turn, conv_id || '::caption-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS row_id FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def w1_occurrence(t):
    c = t("conversations").select("conv_id", "turn").distinct()
    return c.withColumn("row_id", F.concat(F.col("conv_id").cast("string"), F.lit("::caption-"), (W.occurrence(["conv_id"], ["turn"]) + 1).cast("string")))


@Q("""WITH f AS (SELECT conv_id, role, min(turn) AS p FROM conversations GROUP BY 1, 2), n AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY p, role) - 1 AS i FROM f)
      SELECT conv_id, turn, CAST(i AS INTEGER) AS value_index FROM conversations JOIN n USING (conv_id, role)""")
def w2_value_index(t):
    return W.value_index(t("conversations"), ["conv_id"], "role", "turn").select("conv_id", "turn", "value_index")


@Q("SELECT l_orderkey, CAST(i - 1 AS INTEGER) AS pos, p[i] AS part FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey) FILTER (l_returnflag = 'R') AS p FROM lineitem GROUP BY 1) WHERE p IS NOT NULL)")
def w3_positions(t):
    """Positions after filtering a list."""
    items = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_returnflag"))).alias("a"))
    return items.select("l_orderkey", F.posexplode(F.filter("a", lambda s: s["l_returnflag"] == "R")).alias("pos", "s")).select("l_orderkey", "pos", F.col("s.l_partkey").alias("part"))


@Q("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def w4_kept_last(t):
    return W.kept_last(t("orders"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey")


@Q("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def w5_kept_first(t):
    return W.kept_first(t("orders"), ["o_custkey"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@Q("""WITH v AS (SELECT c_custkey, unnest([{'n': 'c_acctbal', 'v': c_acctbal}, {'n': 'c_nationkey', 'v': CAST(c_nationkey AS DOUBLE)}, {'n': 'c_custkey', 'v': CAST(c_custkey AS DOUBLE)}]) AS s FROM customer),
      r AS (SELECT c_custkey, s, row_number() OVER (PARTITION BY c_custkey ORDER BY s.v DESC, s.n) AS r FROM v WHERE s.v > 0)
      SELECT c_custkey, list(s.n ORDER BY r) AS names, list(s.v ORDER BY r) AS values FROM r WHERE r <= 2 GROUP BY 1""")
def w6_top_columns(t):
    """The two largest positive columns of each row."""
    from cohort_spark.functions.arrays import top_columns

    top = t("customer").select("c_custkey", top_columns(["c_acctbal", "c_nationkey", "c_custkey"], 2).alias("t")).where(F.size("t") > 0)
    return top.select("c_custkey", F.col("t.name").alias("names"), F.col("t.value").alias("values"))


@Q("""SELECT l_orderkey, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, -l_quantity, l_partkey, l_linenumber) - 1 AS INTEGER) AS rank FROM lineitem""")
def w7_ranked_files(t):
    order = [F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 1).otherwise(2), -F.col("l_quantity"), "l_partkey", "l_linenumber"]
    return t("lineitem").select("l_orderkey", "l_partkey", W.occurrence(["l_orderkey"], order).alias("rank"))


@Q("""SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('7:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 20""")
def w8_sampled(t):
    return W.sampled(t("orders"), ["o_orderstatus"], "o_orderkey", 20).select("o_orderstatus", "o_orderkey")


@Q(f"WITH {_STEP} SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label, bucket_x, bucket_y ORDER BY vec_id) AS r FROM b) WHERE r = 1")
def w9_strided(t):
    return W.strided(grid(t), "label", 3, position="vec_id").select("label", "vec_id")


@Q("""WITH p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
      k AS (SELECT DISTINCT label, n, CASE WHEN j = 15 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / CAST(15 AS DOUBLE))) AS BIGINT) END AS i FROM (SELECT DISTINCT label, n FROM p), (SELECT unnest(range(0, 16)) AS j))
      SELECT label, vec_id FROM p WHERE n <= 16 OR (label, i) IN (SELECT (label, i) FROM k)""")
def w10_evenly_spaced(t):
    """At most 16 evenly spaced rows of each label."""
    p = W.positioned(t("embeddings"), ["label"], ["vec_id"], "row_idx")
    return W.evenly_spaced(p, "label", 16).select("label", "vec_id")


@Q("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
      b AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS q FROM a WHERE r <= 2)
      SELECT o_orderkey FROM b WHERE q <= 300 ORDER BY o_orderkey LIMIT 1000""")
def w11_capped(t):
    """Caps for each customer, for each priority, and in all."""
    return W.capped(t("orders"), ["o_orderkey"], [("o_custkey", 2), ("o_orderpriority", 300)], 1000).select("o_orderkey")


@Q("""WITH g AS (SELECT DISTINCT conv_id FROM conversations), n AS (SELECT count(*) AS n FROM g),
      v AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('7:' || conv_id), conv_id) AS r FROM g)
      SELECT conv_id, turn, CASE WHEN r <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'val' ELSE 'train' END AS part FROM conversations JOIN v USING (conv_id), n""")
def w12_held_out(t):
    """Whole conversations go to one part."""
    return W.held_out(t("conversations"), "conv_id", 0.2).select("conv_id", "turn", "part")


@Q("SELECT o_custkey, o_orderdate, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def sl1_sorted(t):
    return t("orders").select("o_custkey", "o_orderdate", "o_orderkey").orderBy("o_custkey", "o_orderdate", "o_orderkey")


@Q("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 100")
def sl2_first_rows(t):
    return t("lineitem").orderBy("l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey").limit(100)


@Q("SELECT s_name FROM supplier ORDER BY upper(s_name), s_name LIMIT 25")
def sl3_top(t):
    return W.top(t("supplier").select("s_name"), "s_name", 25)


@Q("SELECT doc_id FROM documents ORDER BY sha256('3:' || doc_id), doc_id LIMIT 40")
def sl4_sample(t):
    return W.sample(t("documents"), "doc_id", 40, seed=3).select("doc_id")


@Q("""SELECT vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY u DESC, vec_id) AS r FROM (
        SELECT label, vec_id, CAST(('0x' || substr(md5('7:' || vec_id), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM embeddings)) WHERE u >= 0.4 OR r = 1""")
def ar14_dropped_out(t):
    """Seeded dropout that keeps each group's highest scorer."""
    return W.dropped_out(t("embeddings"), "label", "vec_id", 0.4).select("vec_id")
