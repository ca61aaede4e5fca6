"""Flows and the remaining operators."""

from pyspark.sql import functions as F

from cohort_spark.functions.text import rounded
from cohort_spark.operators import joins as J
from cohort_spark.plans import artifacts, cohort
from cohort_spark.queries.aggregations import _STEP, grid
from cohort_spark.queries.base import Registry
from cohort_spark.queries.scans import scratch
from cohort_spark.sources import files as S
from cohort_spark.sources import registry as R

Q = Registry()


@Q("SELECT count(*) AS rows, sum(doc_id) AS ids, true AS named FROM documents")
def io4_read_with_name(t):
    """JSON lines with the name of the file each row came from."""
    d = t("documents").select("doc_id", "lang")
    d.repartition("lang").write.partitionBy("lang").json(path := scratch(d, "named"))
    back = S.read_json_with_name(d.sparkSession, path, "doc_id long")
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("ids"), F.bool_and(F.col("source_file").rlike("^part-.*json$")).alias("named"))


@Q("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, to_json([c_name, c_mktsegment]) AS tags FROM customer""")
def io9_sorted_csv(t):
    """A sorted sink whose lists are JSON text in CSV."""
    c = t("customer").select("c_custkey", F.array("c_name", "c_mktsegment").alias("tags"))
    S.write_sorted(c, path := scratch(c, "csv"), ["c_custkey"], "csv")
    return c.sparkSession.read.option("header", True).option("escape", "\\").csv(path)


@Q("SELECT event_id, event_type FROM events")
def io10_sorted_json(t):
    e = t("events").select("event_id", "event_type")
    S.write_sorted(e, path := scratch(e, "json"), ["event_type", "event_id"], "json")
    return e.sparkSession.read.schema("event_id long, event_type string").json(path)


@Q("SELECT 'orders' AS source, count(*) AS rows, CAST(count(*) FILTER (o_orderstatus = 'F') AS VARCHAR) AS finished FROM orders")
def io11_manifest(t):
    o = t("orders")
    n, f = o.count(), o.where("o_orderstatus = 'F'").count()
    R.append_manifest(o.sparkSession, path := scratch(o, "manifest"), "orders", n, {"finished": f})
    back = o.sparkSession.read.schema("source string, rows long, counters map<string,string>, stamp string").json(path)
    return back.where(F.col("stamp").rlike("^[0-9]{8}T[0-9]{6}Z$")).select("source", "rows", F.col("counters")["finished"].alias("finished"))


@Q("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def pf10_kinds(t):
    """Slides of allowed kinds by what their stems hold."""
    from cohort_spark.functions.text import slide_kind

    stem = F.concat(F.lit("s1-"), F.when(F.col("l_returnflag") == "A", "dx1").when(F.col("l_returnflag") == "R", "TS2").otherwise("BS3"))
    return t("lineitem").where(slide_kind(stem).isin("DX", "TS")).select("l_orderkey", "l_linenumber")


@Q("""SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def j10_excluded(t):
    """Excluded ids go from new rows and from what was written before."""
    out = t("customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    o = t("orders")
    new, old = J.not_done(o.where("o_orderkey % 4 = 0"), out, "o_custkey"), J.not_done(o.where("o_orderkey % 4 <> 0"), out, "o_custkey")
    return old.union(new).select("o_orderkey")


@Q("""SELECT count(*) FILTER (CASE o_orderstatus WHEN 'F' THEN 'test' ELSE 'train' END <> CASE WHEN l_returnflag = 'R' THEN 'test' ELSE 'train' END) AS mismatches
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def j15_split_mismatches(t):
    """The registry's split wins; differences are counted."""
    reg = t("orders").select(F.lit("s").alias("source"), F.col("o_orderkey").cast("string").alias("sample_id"), F.when(F.col("o_orderstatus") == "F", "test").otherwise("train").alias("split"))
    cap = t("lineitem").select(F.lit("s").alias("source"), F.col("l_orderkey").cast("string").alias("sample_id"), F.when(F.col("l_returnflag") == "R", " TEST").otherwise("").alias("split"))
    return cohort.split_mismatches(reg, cap)


@Q("""SELECT CAST(conv_id AS VARCHAR) AS sample_id, 'src' AS source, CASE WHEN r = 'user' THEN 'train' ELSE 'val' END AS split, 'src:unknown_project:' || conv_id AS split_group_id, [r] AS paths
      FROM (SELECT conv_id, arg_min(role, turn) AS r FROM conversations GROUP BY 1)""")
def a24_caption_registry(t):
    """One registry row a sample, from its first caption row."""
    c = t("conversations").select(F.col("conv_id").cast("string").alias("sample_id"), F.when(F.col("role") == "user", "train").otherwise("dev").alias("split"), F.lit("").alias("project"), F.array("role", "role").alias("paths"), F.col("turn").alias("seq"))
    return cohort.caption_registry(c, "src")


@Q("""SELECT n_name, CASE WHEN r_name = 'ASIA' AND n_nationkey % 2 = 0 THEN ['liver', 'lung'] WHEN r_name = 'EUROPE' AND n_nationkey % 2 = 1 THEN ['brain'] ELSE [] END AS keywords
      FROM nation JOIN region ON n_regionkey = r_regionkey""")
def ar15_keywords(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    series = n.select("n_name", F.col("r_name").alias("collection"), F.when(F.col("n_nationkey") % 2 == 0, "CT").otherwise("MR").alias("modality"))
    table = artifacts.keyword_table(n.sparkSession, {"ASIA": {"CT": ["liver", " lung", "liver", ""]}, "EUROPE": {"MR": ["brain"]}})
    return artifacts.with_keywords(series, table).select("n_name", "keywords")


@Q("""WITH e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 3 <> 2)
      SELECT l_orderkey, 'p' || l_partkey || CASE WHEN l_partkey % 3 = 0 THEN '-DX' ELSE '-TS' END AS path, CASE WHEN l_partkey % 3 = 0 THEN 'DX' ELSE 'TS' END AS kind,
             CASE WHEN p_size > 25 THEN 'local' WHEN l_orderkey % 5 = 0 THEN 'unsupported_source' WHEN l_orderkey % 7 = 0 THEN 'missing_ids' ELSE 'remote' END AS state
      FROM e JOIN part ON p_partkey = l_partkey WHERE NOT (l_partkey % 4 = 0)""")
def ar16_candidates(t):
    """Slides to work on, classed by where they are."""
    path = F.concat(F.lit("p"), "l_partkey", F.when(F.col("l_partkey") % 3 == 0, "-DX").when(F.col("l_partkey") % 3 == 1, "-TS").otherwise(""))
    rows = t("lineitem").select("l_orderkey", "l_partkey", path.alias("path"))
    k = F.col("l_orderkey")
    cases = rows.groupBy("l_orderkey").agg(F.collect_set("path").alias("slides")).select("l_orderkey", F.when(k % 5 == 0, "x").otherwise("gdc").alias("source"), F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("id"))).alias("ids"), "slides")
    done = rows.where("l_partkey % 4 = 0").select("l_orderkey", "path").distinct()
    big = t("part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    files = rows.select("l_partkey", "path").distinct().join(big, "l_partkey", "left_semi").select("path")
    return artifacts.slide_candidates(cases, "l_orderkey", "slides", done, files, ["gdc"], ["DX", "TS"])


@Q("""SELECT o_orderkey, coalesce(list(p ORDER BY n) FILTER (p IS NOT NULL), []) AS paths FROM orders LEFT JOIN (
        SELECT l_orderkey, 'out/' || l_partkey || '.pt' AS p, min(l_linenumber * 100000000 + l_partkey) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size >= 20) GROUP BY 1, 2) ON o_orderkey = l_orderkey GROUP BY 1""")
def u1_rebuilt_paths(t):
    """A caller's path builder and readiness test, as column expressions."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string"))
    cases = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(ordered.alias("slides"))
    files = t("part").select(F.concat(F.lit("out/"), "p_partkey", F.lit(".pt")).alias("path"), F.col("p_size").alias("size"))
    return artifacts.rebuilt_paths(cases, "o_orderkey", "slides", files, lambda s: F.concat(F.lit("out/"), s, F.lit(".pt")), lambda size: size >= 20)


@Q("""SELECT o_orderkey, list_sort(list_distinct(list(l_returnflag))) AS types, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS first_case FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def ar19_ar20_linked(t):
    """Sample types and the first identified case of nested links."""
    l = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("sample_type"))).alias("samples"))
    case = F.struct(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey").cast("string")).alias("case_id"), F.lit(" ").alias("submitter_id"), "samples")
    cases = t("orders").join(l, "o_orderkey").select("o_orderkey", F.array(F.struct(F.lit("").alias("case_id"), F.lit(None).cast("string").alias("submitter_id"), F.array().cast("array<struct<sample_type:string>>").alias("samples")), case).alias("cases"))
    return cases.select("o_orderkey", F.array_sort(artifacts.linked_samples("cases")).alias("types"), artifacts.first_linked("cases")["case_id"].alias("first_case"))


@Q("""SELECT CAST(event_id AS VARCHAR) AS sample, event_type AS file_id, CASE WHEN event_id % 2 = 0 THEN '/abs/' ELSE '/root/dir/' END || event_id AS path,
             md5(CASE WHEN event_id % 2 = 0 THEN '/abs/' ELSE '/root/dir/' END || event_id) AS hash FROM events WHERE event_id % 3 > 0""")
def ar22_index_records(t):
    """Index records from nested rows; rows without a path go."""
    i = F.col("event_id")
    path = F.when(i % 3 == 0, " ").when(i % 2 == 0, F.concat(F.lit("/abs/"), i)).otherwise(F.concat(i.cast("string"), F.lit(" ")))
    file = F.when(i % 9 != 0, F.struct(F.col("event_type").alias("id"), path.alias("path")))
    return artifacts.index_records(t("events").select(i.cast("string").alias("sample"), file.alias("file")), "/root/dir/")


@Q(f"""WITH {_STEP}, f AS (SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label, bucket_x, bucket_y ORDER BY vec_id) AS r FROM b) WHERE r = 1),
       p AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM f),
       k AS (SELECT DISTINCT label, n, CASE WHEN j = 7 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / CAST(7 AS DOUBLE))) AS BIGINT) END AS i FROM (SELECT DISTINCT label, n FROM p), (SELECT unnest(range(0, 8)) AS j))
       SELECT label, vec_id FROM p WHERE n <= 8 OR (label, i) IN (SELECT (label, i) FROM k)""")
def ar23_compressed(t):
    """Strided by grid cell, then at most eight evenly spaced rows."""
    return cohort.compressed(grid(t), "label", "stride", 3, 8, position="vec_id").select("label", "vec_id")


_REFS = """r AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['1'] WHEN 2 THEN ['3', '', '1'] ELSE ['2', 'none', '2'] END AS refs FROM customer),
  e AS (SELECT c_custkey, unnest(refs) AS ref, CAST(unnest(range(0, len(refs))) AS INTEGER) AS ref_pos FROM r),
  p AS (SELECT ref, i, n, v FROM (SELECT ref, v, row_number() OVER (PARTITION BY ref ORDER BY o) - 1 AS i, count(*) OVER (PARTITION BY ref) AS n FROM s)),
  k AS (SELECT DISTINCT n, CASE WHEN j = 4 THEN n - 1 ELSE CAST(floor(j * ((n - 1) / CAST(4 AS DOUBLE))) AS BIGINT) END AS i FROM (SELECT DISTINCT n FROM p), (SELECT unnest(range(0, 5)) AS j)),
  c AS (SELECT ref, v, row_number() OVER (PARTITION BY ref ORDER BY i) - 1 AS spot, count(*) OVER (PARTITION BY ref) AS m FROM p WHERE n <= 5 OR (n, i) IN (SELECT (n, i) FROM k)),
  z AS (SELECT e.*, coalesce(sum(m) OVER (PARTITION BY c_custkey ORDER BY ref_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e JOIN (SELECT DISTINCT ref, m FROM c) USING (ref))
  SELECT c_custkey, ref_pos, ref, CAST(before + spot AS BIGINT) AS token, round(v, 5) AS lead FROM z JOIN c USING (ref)"""


def referring(t):
    """Customers that refer to no, one, two, blank, missing and repeated slides."""
    refs = F.when(F.col("c_custkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 4 == 1, F.array(F.lit("1"))).when(F.col("c_custkey") % 4 == 2, F.array(F.lit("3"), F.lit(""), F.lit("1")))
    return t("customer").select("c_custkey", refs.otherwise(F.array(F.lit("2"), F.lit("none"), F.lit("2"))).alias("refs"))


def sequences(t, method: str, k: int):
    out = cohort.assembled(referring(t), grid(t), "c_custkey", "refs", "label", method, k, 5, position="vec_id")
    return out.select("c_custkey", "ref_pos", "ref", "token", rounded(F.col("embedding")[0], 5).alias("lead"))


@Q(f"WITH s AS (SELECT CAST(label AS VARCHAR) AS ref, vec_id AS o, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings), {_REFS}")
def ar23_assembled(t):
    """Sequences of several references, each capped for itself."""
    return sequences(t, "none", 1)


@Q(f"WITH {_STEP}, s AS (SELECT CAST(label AS VARCHAR) AS ref, vec_id AS o, CAST(embedding[1] AS DOUBLE) AS v FROM (SELECT *, row_number() OVER (PARTITION BY label, bucket_x, bucket_y ORDER BY vec_id) AS r FROM b) WHERE r = 1), {_REFS}")
def ar23_assembled_strided(t):
    return sequences(t, "stride", 3)


@Q(f"WITH {_STEP}, s AS (SELECT CAST(label AS VARCHAR) AS ref, [bucket_x, bucket_y] AS o, avg(CAST(embedding[1] AS DOUBLE)) AS v FROM b GROUP BY label, bucket_x, bucket_y), {_REFS}")
def ar23_assembled_pooled(t):
    return sequences(t, "mean_pool", 3)


@Q("""SELECT 'src-' || substr(sha256('src||' || c_name || '||st||case'), 1, 16) AS sample_id, coalesce(f, []) AS paths,
             CASE WHEN (CAST(('0x' || substr(sha256('src:' || c_mktsegment || ':' || c_name), 1, 8)) AS BIGINT) % 10000) / 10000.0::DOUBLE < 0.9::DOUBLE THEN 'train' ELSE 'test' END AS split
      FROM customer LEFT JOIN (SELECT o_custkey, list_sort(list(DISTINCT 'f' || o_orderkey)) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def flow_registry_rows(t):
    """Registry rows of case documents: links aggregated, joined, identified, split."""
    cases = t("customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("patient_id"), F.col("c_mktsegment").alias("project_id"), F.lit("st").alias("study_id"))
    files = t("orders").select(F.col("o_custkey").alias("case_id"), F.concat(F.lit("f"), "o_orderkey").alias("path"), F.col("o_orderstatus").alias("kind"))
    return cohort.registry_rows(cases, files, "src").select("sample_id", "paths", "split")


@Q("""WITH r AS (SELECT l_orderkey, l_partkey, p_size, o_orderstatus, i FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey, (VALUES (1), (2)) v(i)
                 WHERE l_partkey % 3 < 2),
      b AS (SELECT quantile_cont(p_size, 0.05) AS low, quantile_cont(p_size, 0.95) AS high FROM r)
      SELECT l_orderkey || '::p' || l_partkey || CASE l_partkey % 3 WHEN 0 THEN '-dx1' ELSE '-ts2' END || '::caption-' || i AS row_id, o_orderstatus AS split, CAST(p_size AS BIGINT) AS patches
      FROM r, b WHERE p_size BETWEEN low AND high""")
def training_set(t):
    """Slides of each case x its captions, by kind, feature and patch-count band."""
    stem = lambda c: F.concat(F.lit("p"), F.col(c), F.when(F.col(c) % 3 == 0, "-dx1").when(F.col(c) % 3 == 1, "-ts2").otherwise("-zz"))
    slides = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(stem("l_partkey")).alias("slides"))
    own = F.col("o_orderkey").cast("string").alias("sample_id")
    registry = t("orders").join(slides, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit("s").alias("source"), own, F.col("o_orderstatus").alias("split"), "slides")
    captions = t("orders").select(F.lit(" s").alias("source"), own, F.lit("train").alias("split"), F.explode(F.array(F.lit(1), F.lit(2))).alias("i"))
    features = t("part").select(stem("p_partkey").alias("stem"), F.col("p_size").cast("long").alias("patches"))
    return cohort.training_set(registry, captions, features, kinds=["DX", "TS"], low=0.05, high=0.95).select("row_id", "split", "patches")
