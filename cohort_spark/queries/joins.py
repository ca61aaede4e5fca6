"""Joins."""

from pyspark.sql import functions as F

from cohort_spark.operators import joins as J
from cohort_spark.queries.base import Registry

Q = Registry()


@Q("""SELECT o_orderkey AS k, l_linenumber, CASE WHEN l_returnflag = 'N' THEN 'describe' ELSE l_returnflag END AS instruction
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def j1_expanded(t):
    """Rows x captions on trimmed keys, blank instructions filled."""
    rows = t("orders").select(F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("k"))
    captions = t("lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit(" ")).alias("k"), "l_linenumber", F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("instruction"))
    return J.expanded(rows, captions, ["k"], "describe", "instruction").withColumn("k", F.col("k").cast("long"))


@Q("""WITH links AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS case_id, o_custkey % 1000 AS patient, o_orderkey FROM orders),
      a AS (SELECT case_id, list_sort(list(DISTINCT o_orderkey)) AS v FROM links WHERE case_id IS NOT NULL GROUP BY 1),
      b AS (SELECT patient, list_sort(list(DISTINCT o_orderkey)) AS v FROM links GROUP BY 1)
      SELECT c_custkey AS case_id, coalesce(a.v, b.v, []) AS files
      FROM customer LEFT JOIN a ON c_custkey = case_id LEFT JOIN b ON c_custkey % 1000 = patient""")
def j2_fallback(t):
    """By case id, else by patient id."""
    cases = t("customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_custkey") % 1000).alias("patient"))
    links = t("orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("case_id"), (F.col("o_custkey") % 1000).alias("patient"), "o_orderkey")
    return J.with_fallback(cases, links, "case_id", "patient", "o_orderkey", "files").drop("patient")


@Q("""SELECT c_custkey, coalesce(n_name, '') AS n_name, coalesce(r_name, '') AS r_name
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'""")
def j3_annotated(t):
    nations = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    regions = t("region").where("r_name <> 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return J.annotated(t("customer").select("c_custkey", "c_nationkey"), [(nations, "c_nationkey"), (regions, "n_regionkey")]).select("c_custkey", "n_name", "r_name")


@Q("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'one' WHEN 'Brand#22' THEN 'two' ELSE 'none' END AS panel FROM part")
def j4_looked_up(t):
    return t("part").select("p_partkey", J.looked_up(F.col("p_brand"), {"Brand#11": "one", "Brand#22": "two"}, "none").alias("panel"))


@Q("""WITH paths AS (SELECT DISTINCT l_orderkey, 's' || l_partkey AS stem FROM lineitem),
      feats AS (SELECT 's' || p_partkey AS stem, 'f' || p_partkey AS path, CAST(p_size AS BIGINT) AS n FROM part WHERE p_size > 10),
      hit AS (SELECT l_orderkey, path, n FROM paths JOIN feats USING (stem))
      SELECT o_orderkey AS l_orderkey, coalesce(p, []) AS feature_paths, coalesce(c, []) AS patch_counts
      FROM orders LEFT JOIN (SELECT l_orderkey, list(path ORDER BY -n, path) AS p, list(n ORDER BY -n, path) AS c FROM hit GROUP BY 1) ON o_orderkey = l_orderkey""")
def j5_matched_features(t):
    """Aligned, ranked lists of matched features."""
    cases = t("orders").select(F.col("o_orderkey").alias("l_orderkey"))
    paths = t("lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("stem")).distinct()
    feats = t("part").select(F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("stem"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), (F.col("p_size") > 10).alias("valid"), F.col("p_size").cast("long").alias("patch_count"))
    return J.matched_features(cases, "l_orderkey", paths, feats, [-F.col("patch_count"), F.col("path")])


@Q("""WITH k AS (SELECT p_name AS ref, 0 AS prio, p_partkey FROM part WHERE p_partkey % 2 = 0
                 UNION ALL SELECT p_brand, 1, p_partkey FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 2, p_partkey FROM part),
      best AS (SELECT ref, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY prio, p_partkey) AS r FROM k) WHERE r = 1),
      refs AS (SELECT DISTINCT p_name AS ref FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT CAST(p_size AS VARCHAR) FROM part)
      SELECT ref, p_partkey FROM refs LEFT JOIN best USING (ref)""")
def j6_cascaded(t):
    """The first of three alternative keys that matches."""
    p = t("part")
    table = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("a"), F.col("p_brand").alias("b"), F.col("p_partkey").cast("string").alias("c"), "p_partkey")
    refs = p.select(F.col("p_name").alias("ref")).union(p.select("p_brand")).union(p.select(F.col("p_size").cast("string"))).distinct()
    return J.cascaded(refs, table, "ref", ["a", "b", "c"], "p_partkey")


@Q("""SELECT 'matched' AS side, doc_id FROM documents JOIN labels USING (doc_id)
      UNION ALL SELECT 'left', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
      UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def j7_matched_and_lost(t):
    d, l = t("documents").select("doc_id"), J.unique_keys(t("labels"), "doc_id").select("doc_id")
    parts = J.matched_and_lost(d, l, "doc_id")
    return parts[0].select(F.lit("matched").alias("side"), "doc_id").union(parts[1].select(F.lit("left"), "doc_id")).union(parts[2].select(F.lit("right"), "doc_id"))


@Q("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def j8_in_cohort(t):
    cohort = t("customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    return J.in_cohort(t("orders"), cohort, "o_custkey").select("o_orderkey")


@Q("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j9_not_done(t):
    return J.not_done(t("documents"), t("labels"), "doc_id").select("doc_id")


@Q("""WITH c AS (SELECT l_orderkey, min(l_partkey) AS k, list_sort(list(DISTINCT l_partkey)) AS ids FROM lineitem GROUP BY 1)
      SELECT l_orderkey, CASE WHEN p_size < 25 OR len(ids) = 1 THEN CASE WHEN p_size < 25 THEN k ELSE ids[1] END END AS file_id FROM c JOIN part ON p_partkey = k""")
def j12_resolved_ids(t):
    """The id whose file has exactly the wanted name, else a single id."""
    c = t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("k"), F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    files = t("part").select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("file_name"))
    wanted = c.join(t("part"), F.col("k") == F.col("p_partkey")).select("l_orderkey", F.when(F.col("p_size") < 25, F.concat(F.lit("n"), F.col("k").cast("string"))).otherwise("other").alias("name"), "ids")
    return J.resolved_ids(wanted, files, "l_orderkey", "name", "ids").select("l_orderkey", "file_id")


@Q("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'set' ELSE CASE WHEN o_orderstatus = 'F' THEN o_orderstatus ELSE '' END END AS v,
             CASE WHEN o_orderkey % 3 <> 0 THEN 'unmatched' WHEN o_orderstatus = 'F' THEN 'skipped' ELSE 'updated' END AS outcome FROM orders""")
def j13_updated(t):
    """Keyed update that leaves non-blank values, with what happened."""
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "F").otherwise("").alias("v"))
    return J.updated(o, o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("set").alias("v")), "o_orderkey", "v", keep=True)


@Q("SELECT c_custkey, CAST(v AS INTEGER) AS variant, CASE WHEN v % 2 = 0 THEN 'short' ELSE 'long' END AS prompt FROM customer, (SELECT unnest(range(0, 3)) AS v)")
def j14_variants(t):
    return J.variants(t("customer").select("c_custkey"), 3, ["short", "long"])


@Q("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
             CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS extra FROM orders""")
def j18_written_back(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    return J.written_back(o, o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), F.lit(1).alias("extra")), "o_orderkey")


@Q("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN [o_orderstatus] ELSE [o_orderpriority] END AS tags FROM orders""")
def j19_list_or(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>")).alias("a"), F.array("o_orderpriority").alias("b"))
    return o.select("o_orderkey", J.list_or("a", "b").alias("tags"))


@Q("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber = 1 THEN 0 END, p_size) AS patches FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def j20_with_measure(t):
    """A measure of its own wins, else it is looked up once a path."""
    rows = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path"), F.when(F.col("l_linenumber") == 1, F.lit(0)).alias("patches"))
    return J.with_measure(rows, t("part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("patches")), "path", "patches").drop("path")


@Q("""WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 30))
      SELECT o_orderkey AS l_orderkey, found FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, l_linenumber * 10000000 + l_partkey) AS found FROM e GROUP BY 1) ON o_orderkey = l_orderkey""")
def j21_first_existing(t):
    """The first listed reference that exists."""
    listed = t("lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda s: s["l_partkey"]).alias("refs"))
    rows = t("orders").select(F.col("o_orderkey").alias("l_orderkey")).join(listed, "l_orderkey", "left")
    return J.first_existing(rows, "l_orderkey", "refs", t("part").where("p_size > 30").select(F.col("p_partkey").alias("path"))).drop("refs")


@Q("SELECT label, vec_id FROM embeddings WHERE label IS NOT NULL")
def j16_dereferenced(t):
    """Stored rows of parsed references."""
    from cohort_spark.functions.text import feature_ref, ref_part

    refs = t("embeddings").where("label is not null").select(feature_ref(F.lit("store"), label=F.col("label").cast("string")).alias("ref")).distinct()
    return J.dereferenced(refs.withColumn("label", ref_part("ref", "label").cast("int")), t("embeddings").select("label", "vec_id"), ["label"]).drop("ref")


@Q("""SELECT a.doc_id, md5(trim(a.text)) AS hash FROM documents a WHERE a.doc_id % 2 = 0 AND md5(trim(a.text)) IN (SELECT md5(trim(text)) FROM documents WHERE doc_id % 2 = 1)""")
def j17_by_hash(t):
    """Matched by content hash."""
    d = t("documents").select("doc_id", F.md5(F.trim("text")).alias("hash"))
    return J.in_cohort(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "hash").select("doc_id", "hash")
