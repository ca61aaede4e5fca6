"""Arrays and structs."""

from pyspark.sql import functions as F

from cohort_spark.functions import arrays as A
from cohort_spark.operators.aggregates import collected
from cohort_spark.plans import artifacts
from cohort_spark.queries.base import Registry

Q = Registry()


@Q("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN [o_orderstatus, o_orderpriority] WHEN 1 THEN [CAST(o_orderkey AS VARCHAR), '9'] WHEN 2 THEN [o_orderpriority] ELSE [] END AS items,
             CASE o_orderkey % 4 WHEN 1 THEN [CAST(o_orderkey AS BIGINT), 9] ELSE [] END AS numbers FROM orders""")
def ar1_ar2_parsed_lists(t):
    """Printed lists of text and of numbers."""
    k = F.col("o_orderkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("['"), "o_orderstatus", F.lit("'\n '"), "o_orderpriority", F.lit("']"))).when(k % 4 == 1, F.concat(F.lit("["), k, F.lit(", 9]"))).when(k % 4 == 2, F.concat(F.lit(" "), "o_orderpriority")).otherwise("[]")
    parsed = t("orders").select("o_orderkey", A.parsed_list(text).alias("items"))
    return parsed.withColumn("numbers", F.filter(A.whole_numbers(F.col("items")), lambda x: x.isNotNull()))


@Q("SELECT conv_id, list_sort(list(DISTINCT role)) AS sorted, list(role ORDER BY p) AS seen FROM (SELECT conv_id, role, min(turn) AS p FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def ar3_ar4_unique(t):
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: F.concat(F.lit(" "), s["role"]))
    c = t("conversations").groupBy("conv_id").agg(roles.alias("roles"))
    return c.select("conv_id", A.sorted_unique("roles").alias("sorted"), A.unique("roles").alias("seen"))


@Q("SELECT l_orderkey, count(*) AS n, l_returnflag AS flag FROM lineitem GROUP BY 1, 3")
def ar5_exploded(t):
    lists = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return lists.select("l_orderkey", F.explode("flags").alias("flag")).groupBy("l_orderkey", "flag").agg(F.count(F.lit(1)).alias("n"))


@Q("SELECT l_orderkey, coalesce(min(l_partkey) FILTER (l_partkey % 7 = 0), min(l_partkey)) AS part, min(l_partkey) FILTER (l_partkey % 7 = 0) AS strict FROM lineitem GROUP BY 1")
def ar6_first_where(t):
    """The first listed item that fits, else the first."""
    l = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("p"))
    return l.select("l_orderkey", A.first_where("p", lambda x: x % 7 == 0).alias("part"), A.first_where("p", lambda x: x % 7 == 0, fallback=False).alias("strict"))


@Q("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 40.0 WHEN vec_id % 3 = 1 THEN -600.0 ELSE 300.0 END AS centre FROM embeddings")
def ar7_preferred_pair(t):
    """The pair whose explanation has the first preferred term, widths positive."""
    pair = lambda c, w, e: F.struct(F.lit(c).alias("centre"), w.alias("width"), F.lit(e).alias("explanation"))
    m = F.col("vec_id") % 3
    pairs = F.array(pair(300.0, F.lit(1500.0), "bone"), pair(40.0, F.when(m == 0, 400.0).otherwise(0.0), "Soft tissue"), pair(-600.0, F.when(m < 2, 1500.0).otherwise(-1.0), "LUNG"))
    return t("embeddings").select("vec_id", pairs.alias("p")).select("vec_id", A.preferred_pair("p", ["soft", "lung"])["centre"].alias("centre"))


@Q("SELECT l_orderkey, list(l_partkey ORDER BY l_quantity, l_partkey, l_linenumber) AS parts, list(l_quantity ORDER BY l_quantity, l_partkey, l_linenumber) AS quantities FROM lineitem GROUP BY 1")
def ar8_aligned(t):
    """Parallel lists from one sorted list of structs."""
    l = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_quantity", "l_partkey", "l_linenumber"))).alias("s"))
    return l.select("l_orderkey", A.field_of("s", "l_partkey").alias("parts"), A.field_of("s", "l_quantity").alias("quantities"))


@Q("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def ar9_ar21_nested(t):
    """Landed JSON under alternative envelopes is unwrapped and exploded."""
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"results": ['), "props", F.lit("]}"))).otherwise(F.concat(F.lit('{"data": ['), "props", F.lit("]}")))
    kind = "result array<struct<k:bigint>>, results array<struct<k:bigint>>, data array<struct<k:bigint>>"
    e = t("events").select("event_id", F.from_json(body, kind).alias("b"))
    return e.select("event_id", F.explode(A.envelope("b.result", "b.results", "b.data")).alias("r")).select("event_id", F.col("r.k").alias("k")).where("k is not null")


@Q("SELECT vec_id, embedding FROM embeddings")
def ar10_squeezed(t):
    return t("embeddings").select("vec_id", F.array("embedding").alias("e")).select("vec_id", A.squeezed("e").alias("embedding"))


@Q("""WITH g AS (SELECT p_brand, list_sort(list(DISTINCT p_size)) AS s FROM part GROUP BY 1)
      SELECT p_brand, list_concat(list_slice(list_filter([30, 7, 12, 5], lambda x: list_contains(s, x)), 1, 2), list_slice(list_filter(s, lambda x: x NOT IN (30, 7, 12, 5)), 1, 3)) AS genes FROM g""")
def ar11_so4_drivers(t):
    """Panel entries first, in panel order, then others."""
    p = t("part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_size")).alias("s"))
    return p.select("p_brand", A.drivers_then_others("s", [30, 7, 12, 5], 2, 3).alias("genes"))


@Q("SELECT l_orderkey, string_agg(f, ', ' ORDER BY f) AS shown FROM (SELECT DISTINCT l_orderkey, l_returnflag AS f FROM lineitem) GROUP BY 1")
def ar12_display(t):
    return t("lineitem").groupBy("l_orderkey").agg(collected("l_returnflag").alias("f")).select("l_orderkey", A.display("f").alias("shown"))


@Q("SELECT vec_id, embedding AS features, list_transform(embedding, lambda x, i: CAST(i AS INTEGER)) AS coords FROM embeddings")
def ar10_paired(t):
    """Features and coordinates, either wrapped once more or not, of equal length."""
    place = F.transform("embedding", lambda x, i: (i + 1).cast("int"))
    wrapped = t("embeddings").select("vec_id", F.array("embedding").alias("features"), F.array(place).alias("coords"))
    return wrapped.select("vec_id", A.paired("features", "coords").alias("p")).select("vec_id", "p.*")


@Q("""SELECT user_id, count(*) FILTER (event_type <> 'click' AND event_id % 7 > 0) AS usable, coalesce(list('/e/' || event_id ORDER BY event_id) FILTER (event_type <> 'click' AND event_id % 7 > 0), []) AS usable_paths,
             count(*) FILTER (event_type <> 'click') AS accepted, coalesce(list(event_id ORDER BY event_id) FILTER (event_type = 'click'), []) AS rejected, coalesce(arg_min(upper(event_type), event_id) FILTER (event_id % 3 > 0), '') AS modality FROM events GROUP BY 1""")
def ar13_accepted_and_rejected(t):
    """Records split into accepted and rejected, usable paths, the first modality that is there."""
    e = F.col("event_id")
    record = F.struct("event_id", F.when(F.col("event_type") == "click", "clicked").when(e % 2 == 0, " ").alias("reason"), F.when(e % 7 > 0, F.concat(F.lit("/e/"), e)).alias("path"), F.when(e % 3 > 0, F.upper("event_type")).otherwise(" ").alias("modality"))
    r = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(record)).alias("r")).select("user_id", A.split_records("r", "reason", "path", "modality").alias("s"))
    return r.select("user_id", F.col("s.usable").cast("long").alias("usable"), "s.usable_paths", F.size("s.accepted").cast("long").alias("accepted"), F.col("s.rejected.event_id").alias("rejected"), "s.modality")


@Q("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ['a'] ELSE [] END AS items, CASE WHEN page_id % 2 = 0 THEN [url] ELSE [] END AS one FROM pages")
def ar18_items(t):
    """Light coercion: trimmed, blanks dropped, nothing parsed."""
    even = F.col("page_id") % 2 == 0
    return t("pages").select("page_id", A.items(F.when(even, F.array(F.lit(" a "), F.lit(" ")))).alias("items"), A.item(F.when(even, F.col("url"))).alias("one"))


@Q("""WITH h AS (SELECT l_orderkey, '/out/s' || l_partkey || '.npy' AS path, min(l_linenumber) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 20 GROUP BY 1, 2)
      SELECT o_orderkey AS case_id, coalesce(list(path ORDER BY n, path) FILTER (path IS NOT NULL), []) AS paths FROM orders LEFT JOIN h ON o_orderkey = l_orderkey GROUP BY 1""")
def ar17_rebuilt_paths(t):
    """A case's artifacts that exist, in slide order."""
    slides = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("s"), F.col("l_partkey")).alias("slide")))).alias("s"))
    cases = t("orders").select(F.col("o_orderkey").alias("case_id")).join(slides, F.col("case_id") == F.col("l_orderkey"), "left").select("case_id", F.col("s.slide").alias("slides"))
    files = t("part").select(F.concat(F.lit("/out/s"), F.col("p_partkey"), F.lit(".npy")).alias("path"), F.col("p_size").alias("size"))
    return artifacts.rebuilt_paths(cases, "case_id", "slides", files, lambda s: F.concat(F.lit("/out/"), s, F.lit(".npy")), lambda size: size > 20)


@Q("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN ['/d/' || page_id] ELSE [] END AS local FROM pages""")
def pf17_local_paths(t):
    """Distinct local entries with a suffix."""
    i = F.col("page_id")
    refs = F.when(i % 2 == 0, F.array("url", F.concat(F.lit("/d/"), i, F.lit(".zip")), F.concat(F.lit("/d/"), i, F.lit(".zip ")))).otherwise(F.array(F.lit("/d/x.txt"), F.col("url")))
    return t("pages").select("page_id", F.transform(A.local_paths(refs, ".zip"), lambda x: F.regexp_replace(x, "[.]zip$", "")).alias("local"))
