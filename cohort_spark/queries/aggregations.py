"""Aggregations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohort_spark.functions.text import image_reject_reason, rounded
from cohort_spark.operators import aggregates as A
from cohort_spark.operators import annotations as N
from cohort_spark.operators import records as C
from cohort_spark.queries.base import Registry
from cohort_spark.queries.scans import scratch
from cohort_spark.sources import files as S

Q = Registry()


@Q("""SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list(DISTINCT l_partkey)) AS parts,
             count(*) AS files FROM lineitem GROUP BY l_orderkey""")
def a1_case_lists(t):
    """Per case sorted distinct lists."""
    return t("lineitem").groupBy("l_orderkey").agg(A.collected("l_returnflag").alias("flags"), F.array_sort(F.collect_set("l_partkey")).alias("parts"), F.count(F.lit(1)).alias("files"))


@Q("""SELECT o_custkey, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS r FROM orders) WHERE r = 1""")
def a2_best_row(t):
    o = t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return A.best_row(o, ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")]).drop("o_orderpriority")


@Q("""WITH m AS (SELECT l_returnflag AS project, CAST(l_orderkey AS VARCHAR) AS patient, 'r' || l_partkey AS raw, 's' || l_linenumber AS sample,
                        CAST(l_suppkey AS VARCHAR) AS file_id, CASE WHEN l_linenumber % 2 = 1 THEN 'f' || l_partkey END AS feature, l_linenumber % 3 AS code FROM lineitem),
      f AS (SELECT *, row_number() OVER (PARTITION BY project, patient ORDER BY code, sample, file_id, feature) AS r FROM m WHERE feature IS NOT NULL)
      SELECT project, patient, list_sort(list(DISTINCT raw)) AS raw_paths, any_value(b.feature) AS feature_path, any_value(b.sample) AS selected_sample, count(m.feature) AS features
      FROM m JOIN (SELECT project, patient, feature, sample FROM f WHERE r = 1) b USING (project, patient) GROUP BY project, patient""")
def a3_case_assignments(t):
    """The canonical feature of each case with all raw paths."""
    m = t("lineitem").select(
        F.col("l_returnflag").alias("project"), F.col("l_orderkey").cast("string").alias("patient"), F.concat(F.lit("r"), "l_partkey").alias("raw_path"), F.concat(F.lit("s"), "l_linenumber").alias("sample"),
        F.col("l_suppkey").cast("string").alias("file_id"), F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("f"), "l_partkey")).otherwise(" ").alias("feature_path"), (F.col("l_linenumber") % 3).alias("code"))
    return A.case_assignments(m, F.col("code"))


_VERDICTS = """WITH i AS (SELECT 's' || (user_id % 300) AS series_dir, event_id AS file, user_id % 300 % 11 AS k, user_id % 300 % 2 AS odd, event_id % 3 AS e3, event_id % 4 AS e4 FROM events),
  h AS (SELECT *, k <> 1 AND NOT (k = 0 AND event_id_13) AS readable, CASE WHEN k = 2 AND e3 = 0 THEN 'MR' ELSE 'CT' END AS modality, CASE WHEN k = 3 THEN 'u' || e3 ELSE 'u' END AS uid, k = 4 AS localizer, k = 5 AS capture,
               k = 6 OR k = 8 AND e3 = 2 AS multi, k = 7 AS derived, k = 8 AND e3 < 2 OR k = 9 AND rank > 2 OR k = 10 AND e4 < 2 AS tiny
        FROM (SELECT *, file % 13 = 0 AS event_id_13, row_number() OVER (PARTITION BY series_dir ORDER BY file) AS rank FROM i)),
  r AS (SELECT *, CASE WHEN NOT readable THEN 'unreadable_dicom_header' WHEN capture THEN 'secondary_capture_sop' WHEN localizer THEN 'localizer_or_scout' WHEN multi THEN 'multiframe_instance' WHEN tiny THEN 'tiny_matrix'
                       WHEN derived THEN 'derived_or_reformatted_image' END AS reason FROM h),
  q AS (SELECT series_dir, string_agg(reason || ':' || c, ', ' ORDER BY c DESC, p) AS reasons FROM (SELECT series_dir, reason, count(*) AS c, min(file) AS p FROM r WHERE reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  g AS (SELECT series_dir, k, count(*) AS total_files, count(*) FILTER (readable) AS readable, count(reason) AS rejected, count(*) FILTER (readable AND reason IS NULL) AS usable,
               coalesce(string_agg(DISTINCT modality, ';' ORDER BY modality) FILTER (readable), '') AS modalities, coalesce(string_agg(DISTINCT uid, ';' ORDER BY uid) FILTER (readable), '') AS uids,
               count(DISTINCT modality) FILTER (readable) AS n_modalities, count(DISTINCT uid) FILTER (readable) AS n_uids, count(*) FILTER (readable AND multi) AS multis FROM r GROUP BY 1, 2),
  v AS (SELECT d.series_dir, coalesce(total_files, 0) AS total_files, coalesce(readable, 0) AS readable, coalesce(rejected, 0) AS rejected, coalesce(usable, 0) AS usable, coalesce(modalities, '') AS modalities, coalesce(reasons, '') AS reasons,
         CASE WHEN total_files IS NULL THEN ['empty_directory', 'no files'] WHEN readable = 0 THEN ['no_readable_dicom_files', 'none of ' || total_files || ' files is readable']
              WHEN n_modalities > 1 THEN ['mixed_modality_in_directory', 'modalities: ' || modalities] WHEN n_uids > 1 THEN ['mixed_series_instance_uid_in_directory', 'series uids: ' || uids]
              WHEN k = 4 THEN ['series_is_localizer_or_scout', 'all ' || readable || ' readable images are localizers'] WHEN k = 5 THEN ['series_is_secondary_capture', 'all ' || readable || ' readable images are secondary captures']
              WHEN multis = readable THEN ['series_is_multiframe', 'all ' || readable || ' readable images are multiframe'] WHEN k = 7 THEN ['series_is_derived_or_reformatted', 'all ' || readable || ' readable images are derived']
              WHEN usable = 0 THEN ['all_images_rejected', 'reasons: ' || reasons] WHEN usable < 3 THEN ['too_few_usable_images', usable || ' usable, at least 3 needed']
              WHEN rejected / greatest(readable, 1) > 0.3 THEN ['rejected_fraction_too_high', rejected || ' of ' || readable || ' rejected (' || printf('%.3f', rejected / readable) || '), at most 0.300; reasons: ' || reasons] END AS first
        FROM (SELECT series_dir FROM g UNION SELECT 's' || (c_custkey % 330) FROM customer) d LEFT JOIN g USING (series_dir) LEFT JOIN q USING (series_dir))"""


def header_rows(events: DataFrame) -> DataFrame:
    """Events as image headers; the series' number decides what is wrong with its images."""
    series, e = F.col("user_id") % 300, F.col("event_id")
    k, rank = series % 11, F.row_number().over(Window.partitionBy(series).orderBy("event_id"))
    tiny = (k == 8) & (e % 3 < 2) | (k == 9) & (rank > 2) | (k == 10) & (e % 4 < 2)
    return events.select(
        F.concat(F.lit("s"), series).alias("series_dir"),
        e.alias("file"),
        ((k != 1) & ~((k == 0) & (e % 13 == 0))).alias("readable_dicom"),
        F.lit(None).cast("string").alias("reject_reason"),
        F.when((k == 2) & (e % 3 == 0), "MR").otherwise("CT").alias("modality"),
        F.when(k == 5, "1.2.840.10008.5.1.4.1.1.7").otherwise("1.2").alias("sop_class_uid"),
        F.when(k == 3, F.concat(F.lit("u"), e % 3)).otherwise("u").alias("series_instance_uid"),
        F.when(k == 4, "head Scout/AP").otherwise("axial").alias("series_description"),
        F.lit(None).cast("string").alias("protocol_name"),
        F.when(k == 7, "DERIVED\\PRIMARY").otherwise("ORIGINAL").alias("image_type"),
        F.when((k == 6) | (k == 8) & (e % 3 == 2), 3).otherwise(1).alias("number_of_frames"),
        F.when(tiny, 32).otherwise(512).alias("rows"),
        F.lit(512).alias("cols"),
        F.lit(16).alias("bits_allocated"),
    )


def verdicts(t) -> DataFrame:
    directories = t("customer").select(F.concat(F.lit("s"), F.col("c_custkey") % 330).alias("series_dir"))
    return A.series_verdict(header_rows(t("events")), least_usable=3, most_rejected=0.3, file="file", directories=directories)


@Q(_VERDICTS + " SELECT series_dir, total_files, readable, rejected, usable, modalities, first[1] AS reject_reason, first[2] AS reject_details FROM v")
def a4_series_verdict(t):
    """Series quality with details from image header rows: every reason occurs, empty directories too."""
    return verdicts(t).select("series_dir", "total_files", "readable", "rejected", "usable", "modalities", "reject_reason", "reject_details")


@Q(_VERDICTS + """ SELECT v.series_dir, coalesce(first[1], 'accepted') AS verdict, first[2] AS reject_details, CAST(count(file) AS INTEGER) AS images, coalesce(min(file), -1) AS first_file, coalesce(string_agg(reason, ',' ORDER BY file), '') AS image_reasons
      FROM v LEFT JOIN r USING (series_dir) GROUP BY ALL""")
def io10_series_details(t):
    """One nested object a series, written by verdict and read back."""
    images = header_rows(t("events"))
    judged = images.withColumn("reason", image_reject_reason())
    details = A.series_details(judged, verdicts(t).withColumn("verdict", F.coalesce("reject_reason", F.lit("accepted"))), "series_dir", "file", ["reason", "modality"])
    S.write_details(details, path := scratch(images, "details"), ["verdict"])
    back = S.read_details(images.sparkSession, path, details.schema)
    reasons = F.array_join(F.col("images.reason"), ",")
    return back.select("series_dir", "verdict", "reject_details", F.size("images").alias("images"), F.coalesce(F.try_element_at("images.file", F.lit(1)), F.lit(-1)).alias("first_file"), reasons.alias("image_reasons"))


@Q("""SELECT regexp_extract(url, '://([^/?#]*)', 1) AS archive, count(DISTINCT split_part(url, '/', 4)) AS directories,
             CASE count(DISTINCT split_part(url, '/', 4)) WHEN 0 THEN 'no_directory' WHEN 1 THEN 'ok' ELSE 'several_directories' END AS verdict FROM pages GROUP BY 1""")
def a5_directory_verdict(t):
    p = t("pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("archive"), F.split_part("url", F.lit("/"), F.lit(4)).alias("directory"))
    return A.directory_verdict(p, "archive", "directory")


@Q("""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS p FROM events GROUP BY 1, 2)
      SELECT user_id, string_agg(event_type || ':' || n, ', ' ORDER BY n DESC, p) AS reasons FROM c GROUP BY user_id""")
def a6_reason_histogram(t):
    return A.reason_histogram(t("events"), ["user_id"], "event_type", "event_id")


@Q("""WITH r AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, CASE WHEN page_id % 4 = 0 THEN url WHEN page_id % 4 = 3 THEN NULL ELSE '/d/' || page_id % 100 END AS ref FROM pages),
      i AS (SELECT DISTINCT '/d/' || page_id % 100 AS path FROM pages WHERE page_id % 100 < 50),
      j AS (SELECT r.*, ref IS NOT NULL AND NOT contains(ref, '://') AS loc, path FROM r LEFT JOIN i ON ref = path)
      SELECT host, 'ref_paths' AS "column", count(DISTINCT page_id) FILTER (ref IS NOT NULL) AS rows_with_refs, count(ref) AS refs, count(*) FILTER (loc) AS local,
             count(*) FILTER (contains(ref, '://')) AS uri, count(*) FILTER (loc AND path IS NOT NULL) AS existing, count(*) FILTER (loc AND path IS NULL) AS missing,
             count(DISTINCT ref) FILTER (loc AND path IS NULL) AS unique_missing,
             coalesce(list_slice(list_sort(list(DISTINCT ref) FILTER (loc AND path IS NULL)), 1, 5), []) AS examples FROM j GROUP BY host""")
def a7_reference_audit(t):
    """References per source and column against an inventory."""
    p = t("pages")
    ref = F.when(F.col("page_id") % 4 == 0, F.array("url")).when(F.col("page_id") % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("/d/"), F.col("page_id") % 100)))
    rows = p.select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), ref.alias("ref_paths"))
    files = p.where("page_id % 100 < 50").select(F.concat(F.lit("/d/"), F.col("page_id") % 100).alias("path")).distinct()
    return A.reference_audit(rows, "host", ["ref_paths"], files)


@Q("SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1")
def a8_split_counts(t):
    return A.split_counts(t("orders"), "o_orderstatus")


@Q("SELECT count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 0 AND toxic = 1) AS both FROM labels")
def a9_counters(t):
    return A.counters(t("labels"), good=F.col("quality") == 1, toxic=F.col("toxic") == 1, both=(F.col("quality") == 0) & (F.col("toxic") == 1))


@Q("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q75, round(avg(CASE WHEN value < 20 THEN 1 ELSE 0 END), 6) AS below,
             round(avg(CASE WHEN value BETWEEN 20 AND 80 THEN 1 ELSE 0 END), 6) AS between_, round(avg(CASE WHEN value > 80 THEN 1 ELSE 0 END), 6) AS above
      FROM events WHERE isfinite(value) GROUP BY event_type""")
def a10_distribution(t):
    d = A.distribution(t("events"), ["event_type"], "value", 20, 80).withColumnRenamed("between", "between_")
    return d.withColumns({c: rounded(c, 6) for c in ("mean", "sd", "below", "between_", "above")})


@Q("""SELECT md5(text) AS hash, any_value(text) AS text, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY 1""")
def a11_merged_records(t):
    return A.merged_records(t("documents").select(F.md5("text").alias("hash"), "text", "source"), "hash", ["text"], "source")


@Q("SELECT n_chars, count(DISTINCT md5(text)) AS keys FROM documents GROUP BY 1 HAVING count(DISTINCT md5(text)) > 1")
def a23_collisions(t):
    return A.collisions(t("documents").select("n_chars", F.md5("text").alias("h")), "n_chars", "h")


def grid(t):
    """Embeddings as slide rows: every slide a grid of its own step with gaps."""
    v, step = F.col("vec_id"), F.col("label") + 2
    return t("embeddings").select("label", "vec_id", F.floor(v / 3).alias("row_idx"), (v % 17 * step).alias("x"), (F.floor(v / 17) % 23 * step).alias("y"), "embedding")


_GRID = "SELECT label, vec_id, vec_id // 3 AS row_idx, vec_id % 17 * (label + 2) AS x, vec_id // 17 % 23 * (label + 2) AS y, embedding FROM embeddings"
_STEP = f"""g AS ({_GRID}), ax AS (SELECT DISTINCT label, 0 AS a, x AS v FROM g UNION SELECT DISTINCT label, 1, y FROM g),
  gap AS (SELECT label, v - lag(v) OVER (PARTITION BY label, a ORDER BY v) AS d FROM ax),
  step AS (SELECT label, max(c) AS step FROM (SELECT label, unnest(range(1, (SELECT max(d) FROM gap) + 1)) AS c FROM (SELECT DISTINCT label FROM g)) s
           WHERE NOT EXISTS (SELECT 1 FROM gap WHERE gap.label = s.label AND d IS NOT NULL AND d % c <> 0) GROUP BY label),
  o AS (SELECT label, min(x) AS x0, min(y) AS y0 FROM g GROUP BY label),
  b AS (SELECT g.*, CAST((x - x0) // step // 3 AS BIGINT) AS bucket_x, CAST((y - y0) // step // 3 AS BIGINT) AS bucket_y FROM g JOIN o USING (label) JOIN step USING (label))"""


@Q(f"WITH {_STEP} SELECT label, CAST(step AS BIGINT) AS step FROM step")
def a14_coordinate_step(t):
    return A.coordinate_step(grid(t), "label")


@Q(f"""WITH {_STEP}, e AS (SELECT label, bucket_x, bucket_y, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM b) GROUP BY ALL)
      SELECT label, bucket_x, bucket_y, list(round(m, 5) ORDER BY i) AS embedding FROM e GROUP BY label, bucket_x, bucket_y""")
def a12_spatial_mean_pool(t):
    """Mean vector of each 3 x 3 cell of every slide's own grid."""
    return A.spatial_mean_pool(grid(t), "label", 3).withColumn("embedding", F.transform("embedding", lambda x: rounded(x, 5)))


@Q("""WITH e AS (SELECT label, vec_id // 16 AS run, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY ALL)
      SELECT label, run, list(round(m, 5) ORDER BY i) AS embedding FROM e GROUP BY label, run""")
def a13_contiguous_mean_pool(t):
    return A.contiguous_mean_pool(t("embeddings"), "label", 16, position="vec_id").withColumn("embedding", F.transform("embedding", lambda x: rounded(x, 5)))


@Q("""WITH c AS (SELECT vec_id % 10 AS slide, label, count(*) AS n FROM embeddings GROUP BY 1, 2)
      SELECT slide, list(label ORDER BY label) AS labels, list(n ORDER BY label) AS counts, sum(CASE WHEN label > 0 THEN n ELSE 0 END) / sum(n) AS foreground FROM c GROUP BY slide""")
def a15_label_histogram(t):
    h = A.label_histogram(t("embeddings").withColumn("slide", F.col("vec_id") % 10), "slide", "label")
    return h.select("slide", F.map_keys("histogram").alias("labels"), F.map_values("histogram").alias("counts"), "foreground")


@Q("""SELECT user_id, CASE WHEN user_id % 4 > 0 THEN list_contains(list(DISTINCT event_type), 'click') END AS mutation_click,
             CASE WHEN user_id % 4 > 0 THEN list_contains(list(DISTINCT event_type), 'view') END AS mutation_view FROM events GROUP BY user_id""")
def a16_gene_flags(t):
    g = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("genes"), F.first(F.col("user_id") % 4 > 0).alias("seen"))
    return A.gene_flags(g, "genes", ["click", "view"], "seen").drop("genes", "seen")


@Q("""WITH f AS (SELECT l_orderkey, 'p' || l_partkey % 4 AS path, l_returnflag AS m, min(l_linenumber) AS p FROM lineitem GROUP BY 1, 2, 3),
      g AS (SELECT l_orderkey, path, string_agg(m, '|' ORDER BY p, m) AS m FROM f GROUP BY 1, 2)
      SELECT l_orderkey, list(path ORDER BY path) AS paths, list(m ORDER BY path) AS modalities FROM g GROUP BY 1""")
def a17_modalities_by_path(t):
    l = t("lineitem").withColumn("path", F.concat(F.lit("p"), F.col("l_partkey") % 4))
    return A.modalities_by_path(l, "l_orderkey", "path", "l_returnflag", "l_linenumber")


@Q("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def a18_grouped_records(t):
    r = A.grouped_records(t("orders"), "o_custkey", "o_orderkey", ["o_orderstatus"])
    return r.select("o_custkey", F.col("records.o_orderkey").alias("orders"))


@Q("""WITH a AS (SELECT p_brand AS kind, p_type AS gene, min(p_size) / 1000 AS q FROM part GROUP BY 1, 2), b AS (SELECT p_brand AS kind, p_type AS gene, max(p_size) / 1000 AS q FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2),
      s AS (SELECT kind, gene FROM a WHERE q <= 0.02 AND (kind, gene) IN (SELECT (kind, gene) FROM b WHERE q <= 0.02)),
      u AS (SELECT * FROM s UNION SELECT kind, gene FROM a WHERE q <= 0.005 AND kind NOT IN (SELECT kind FROM s))
      SELECT kind, list_sort(list(gene)) AS panel FROM u GROUP BY kind""")
def a20_driver_panel(t):
    p = t("part").select(F.col("p_brand").alias("kind"), F.col("p_type").alias("gene"), "p_size", "p_partkey")
    a = p.groupBy("kind", "gene").agg((F.min("p_size") / 1000).alias("q"))
    b = p.where("p_partkey % 2 = 0").groupBy("kind", "gene").agg((F.max("p_size") / 1000).alias("q"))
    return A.driver_panel(a, b, "kind", "gene", "q", 0.02, 0.005)


_SAMPLES = """s AS (SELECT 'AA-BB-C' || o_custkey AS patient, 'AA.BB.C' || o_custkey || '.' || printf('%02d', o_orderkey % 4 + 1) || 'A.' || o_orderkey AS sample, o_orderkey % 4 + 1 AS code, o_orderkey AS k, o_totalprice AS price, o_orderpriority AS priority FROM orders),
  c AS (SELECT 'AA-BB-C' || c_custkey AS patient, c_nationkey AS nation FROM customer WHERE c_nationkey < 20),
  w AS (SELECT * FROM (SELECT s.*, nation, row_number() OVER (PARTITION BY patient ORDER BY code, sample) AS r FROM s JOIN c USING (patient)) WHERE r = 1),
  z AS (SELECT * FROM (SELECT s.*, nation, row_number() OVER (PARTITION BY patient ORDER BY code, sample) AS r FROM s JOIN c USING (patient) WHERE k % 3 = 0) WHERE r = 1)"""


def sample_tables(t, scored: bool) -> dict[str, DataFrame]:
    """Orders as annotation tables with columns named as they come; ``scored`` tells whether the score table has purities."""
    o = t("orders")
    k, code = F.col("o_orderkey"), F.format_string("%02dA", F.col("o_orderkey") % 4 + 1)
    sample = F.concat_ws(".", F.lit("AA"), F.lit("BB"), F.concat(F.lit("C"), "o_custkey"), code, k.cast("string"))
    third, price = o.where(k % 3 == 0), F.col("o_totalprice")
    return {
        "subtypes": o.select(sample.alias("my SampleID"), F.when(k % 5 > 0, F.concat(F.col("o_orderpriority"), F.when(k % 2 == 0, "-MSI-H").otherwise(""))).alias("Subtype_Selected"), F.lit(" m ").alias("Subtype_mRNA"), F.lit(None).cast("string").alias("Subtype_DNAmeth")),
        "leukocytes": third.select(F.lit("x").alias("CancerType"), sample.alias("SampleID"), (price / 1e6).alias("leukocyte_fraction")),
        "scores": o.select(sample.alias("sample"), (F.when(k % 7 > 0, price / 1e6) if scored else F.lit("NA")).cast("string").alias("purity"), (price / 1000).alias("Aneuploidy Score")),
        "purity": third.select(sample.alias("barcode"), (price / 2e6).alias("Purity")),
        "hrd": o.select(sample.alias("sampleID"), F.when(k % 2 == 0, price / 100).otherwise(float("nan")).alias("HRD")),
    }


@Q(f"""WITH {_SAMPLES}, m AS (SELECT unnest([true, false]) AS scored),
  v AS (SELECT scored, w.patient, CASE WHEN w.k % 5 > 0 THEN w.priority || CASE WHEN w.k % 2 = 0 THEN '-MSI-H' ELSE '' END ELSE '' END AS molecular_subtype, coalesce(printf('%.3f', z.price / 1e6), '') AS leukocyte_fraction,
               CASE WHEN scored THEN CASE WHEN w.k % 7 > 0 THEN printf('%.2f', w.price / 1e6) ELSE '' END ELSE coalesce(printf('%.2f', z.price / 2e6), '') END AS tumor_purity,
               CAST(CAST(trunc(w.price / 1000) AS BIGINT) AS VARCHAR) AS aneuploidy_score, CASE WHEN w.k % 2 = 0 THEN CAST(CAST(trunc(w.price / 100) AS BIGINT) AS VARCHAR) ELSE '' END AS hrd_score FROM m, w LEFT JOIN z USING (patient))
  SELECT *, CASE WHEN contains(lower(molecular_subtype), 'msi') THEN 'MSI' ELSE '' END AS msi_status, 'm' AS subtype_mrna, '' AS methylation_subtype, '' AS integrative_subtype FROM v""")
def a25_annotated_patients(t):
    """Five annotation tables by patient, once with purities of the score table and once with the fallback's."""
    cohort = t("customer").where("c_nationkey < 20").select(F.concat(F.lit("AA-BB-C"), "c_custkey").alias("patient"))
    each = [N.annotated_patients(cohort, sample_tables(t, s), "patient").withColumn("scored", F.lit(s)) for s in (True, False)]
    return each[0].union(each[1])


@Q("""WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 9 = 0 THEN '' ELSE 'p' || o_custkey END AS p, 'u' || (o_orderkey % 500) AS u, o_orderstatus AS m FROM orders),
  g AS (SELECT p, u, min(k) AS k FROM s WHERE p <> '' GROUP BY 1, 2) SELECT p AS patient_id, count(*) AS studies, list_sort(list(g.u)) AS uids, list(CASE WHEN k % 3 = 0 THEN ['CT', 'MR'] WHEN k % 3 = 1 THEN ['CT'] ELSE [] END ORDER BY u) AS modalities FROM g GROUP BY 1""")
def a18_study_records(t):
    """Study records under three sets of field names, one a study and patient, grouped by patient."""
    k, who = F.col("o_orderkey"), F.when(F.col("o_custkey") % 9 == 0, " ").otherwise(F.concat(F.lit("p"), "o_custkey"))
    uid = F.concat(F.lit("u"), k % 500)
    forms = [F.to_json(F.struct(who.alias("PatientID"), uid.alias("StudyInstanceUID"), F.array(F.lit("MR"), F.lit("CT")).alias("ModalitiesInStudy"))), F.to_json(F.struct(F.lit(" ").alias("PatientID"), who.alias("subject_id"), uid.alias("studyInstanceUid"), F.lit("CT").alias("Modality"))), F.to_json(F.struct(who.alias("patientId"), uid.alias("StudyInstanceUid")))]
    docs = t("orders").select(k, F.element_at(F.array(*forms), (k % 3 + 1).cast("int")).alias("body"))
    studies = C.study_records(docs, "body", ["o_orderkey"])
    grouped = A.grouped_records(studies, "patient_id", "study_instance_uid", ["o_orderkey", "modalities_in_study"])
    r = F.col("records")
    return grouped.select("patient_id", F.size("records").cast("long").alias("studies"), r["study_instance_uid"].alias("uids"), r["modalities_in_study"].alias("modalities"))


@Q("""WITH s AS (SELECT 'u' || (o_orderkey % 500) AS u, min('p' || o_custkey) AS p FROM orders GROUP BY 1)
      SELECT 'u' || (l_orderkey % 700) AS study, p AS patient_id, 'x' || l_partkey AS series_instance_uid, l_returnflag AS modality, l_linenumber FROM lineitem JOIN s ON u = 'u' || (l_orderkey % 700) WHERE l_partkey % 4 > 0""")
def a18_series_records(t):
    """Series records of known studies under two sets of field names."""
    uid = F.when(F.col("l_partkey") % 4 > 0, F.concat(F.lit("x"), "l_partkey"))
    body = F.when(F.col("l_partkey") % 2 == 0, F.to_json(F.struct(uid.alias("SeriesInstanceUID"), F.col("l_returnflag").alias("Modality")))).otherwise(F.to_json(F.struct(uid.alias("seriesInstanceUid"), F.col("l_returnflag").alias("modality"))))
    docs = t("lineitem").select(F.concat(F.lit("u"), F.col("l_orderkey") % 700).alias("study"), "l_linenumber", body.alias("body"))
    studies = t("orders").select(F.concat(F.lit("u"), F.col("o_orderkey") % 500).alias("study_instance_uid"), F.concat(F.lit("p"), "o_custkey").alias("patient_id"))
    return C.series_records(docs, "body", studies, "study", ["l_linenumber"]).select("study", "patient_id", "series_instance_uid", "modality", "l_linenumber")


@Q("SELECT vec_id % 50 AS mask, count(*) FILTER (label > 3) AS pixels FROM embeddings GROUP BY 1 HAVING count(*) FILTER (label > 3) >= 4")
def a26_usable_masks(t):
    return A.usable_masks(t("embeddings").select((F.col("vec_id") % 50).alias("mask"), F.when(F.col("label") > 3, 1).otherwise(0).alias("l")), "mask", "l", 4)


@Q("""WITH c AS (SELECT conv_id, role AS caption, min(turn) AS p FROM conversations GROUP BY 1, 2), r AS (SELECT conv_id, 't' || turn % 3 AS path, min(turn) AS p FROM conversations GROUP BY 1, 2)
      SELECT conv_id, caption, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY c.p, caption) - 1 AS INTEGER) AS variant, u.reports
      FROM c JOIN (SELECT conv_id, list(path ORDER BY p) AS reports FROM r GROUP BY 1) u USING (conv_id)""")
def a22_legacy_captions(t):
    """Distinct captions numbered by first appearance, report paths united."""
    c = t("conversations").select("conv_id", F.col("role").alias("caption"), F.array(F.concat(F.lit("t"), F.col("turn") % 3)).alias("reports"), "turn")
    return A.legacy_captions(c, ["conv_id"], "caption", "reports", "turn")


@Q("SELECT count(*) FILTER (trim(text) <> '') AS complete FROM documents")
def a21_complete(t):
    return A.counters(t("documents"), complete=F.trim("text") != "")
