"""Text, identity and numeric expressions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions import images as I
from cohort_spark.functions import text as T
from cohort_spark.queries.base import Registry

Q = Registry()


@Q("SELECT doc_id, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS clean FROM documents")
def s1_clean(t):
    return t("documents").select("doc_id", F.md5(T.clean(F.concat(F.lit(" \t"), "text", F.lit("\n ")))).alias("clean"))


@Q("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS name FROM customer")
def s2_first_non_blank(t):
    blank = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name"))
    return t("customer").select("c_custkey", T.first_non_blank(blank, F.lit(None), "c_mktsegment").alias("name"))


@Q("SELECT p_partkey, list_sort(list_distinct(string_split(p_name, ' '))) AS words FROM part")
def s3_text_list(t):
    return t("part").select("p_partkey", T.text_list(F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(",")), ",").alias("words"))


@Q("""SELECT event_id, CASE event_type WHEN 'click' THEN 'MR' WHEN 'view' THEN 'PT' ELSE upper(event_type) END AS modality,
             CASE event_type WHEN 'click' THEN ['CT', 'MR'] WHEN 'view' THEN ['CT', 'PT'] ELSE list_sort(list_distinct(['CT', upper(replace(replace(event_type, '-', ''), ' ', ''))])) END AS modalities
      FROM events""")
def s4_modality(t):
    name = F.when(F.col("event_type") == "click", "m-r i").when(F.col("event_type") == "view", " Pet").otherwise(F.col("event_type"))
    return t("events").select("event_id", T.modality(name).alias("modality"), T.modality_list(F.concat(name, F.lit("/ct\\CT"))).alias("modalities"))


@Q("SELECT page_id, array_to_string(list_slice(string_split(replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '-'), '-'), 1, 3), '-') AS patient FROM pages")
def s5_patient_of_barcode(t):
    return t("pages").select("page_id", T.patient_of_barcode(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("patient"))


@Q("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 99 END AS priority, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 999 END AS code,
             CASE WHEN p_size % 2 = 1 THEN 'sample type code unknown' WHEN p_size = 6 THEN 'metastatic tumor' WHEN p_size = 10 THEN 'blood-derived normal' WHEN p_size = 2 THEN 'recurrent tumor'
                  ELSE 'sample type code ' || lpad(CAST(p_size AS VARCHAR), 2, '0') END AS label
      FROM part""")
def s6_s7_sample_codes(t):
    code = F.when(F.col("p_size") % 2 == 0, F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("a"))).otherwise("zz")
    barcode = F.concat(F.lit("AB-CD-12-"), code)
    return t("part").select("p_partkey", T.sample_priority(barcode).alias("priority"), T.sample_code(barcode).alias("code"), T.sample_type_label(barcode).alias("label"))


@Q("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'DX' WHEN p_size % 3 = 1 THEN 'TS' ELSE '' END AS kind, CAST(CASE WHEN p_size % 3 < 2 THEN p_size % 3 ELSE 2 END AS INTEGER) AS rank FROM part""")
def s8_slide_kind(t):
    stem = F.concat(F.lit("q-"), F.when(F.col("p_size") % 3 == 0, "dx1").when(F.col("p_size") % 3 == 1, "ts2").otherwise("zz"))
    return t("part").select("p_partkey", T.slide_kind(stem).alias("kind"), T.slide_rank(stem).alias("rank"))


@Q("""SELECT page_id, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe,
             regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages""")
def s9_safe_name(t):
    return t("pages").select("page_id", T.safe_name("url").alias("safe"), T.slug("url").alias("slug"))


@Q("""SELECT page_id, regexp_extract(bare, '([^/]*)/*$', 1) AS name, regexp_extract(bare, '^(.*)/[^/]*$', 1) AS parent,
             CASE WHEN starts_with(p, '/data/en/') THEN substr(p, 10) ELSE regexp_replace(p, '^/+', '') END AS relative
      FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, '/data/' || regexp_extract(url, '://[^/?#]*/([^?#]*)', 1) AS p FROM pages)""")
def s10_paths(t):
    p = t("pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("bare"), F.concat(F.lit("/data/"), F.regexp_extract("url", "://[^/?#]*/([^?#]*)", 1)).alias("p"))
    return p.select("page_id", T.file_name("bare").alias("name"), T.parent("bare").alias("parent"), T.relative_to(F.concat(F.lit("'"), "p", F.lit("'")), "/data/en").alias("relative"))


@Q("""SELECT page_id, 'h' || page_id % 7 AS collection, 'p' || page_id % 5 AS patient, 'st' AS study, CAST(page_id AS VARCHAR) AS series FROM pages WHERE page_id % 2 = 0
      UNION ALL SELECT page_id, '' AS collection, '' AS patient, 'only' AS study, CAST(page_id AS VARCHAR) AS series FROM pages WHERE page_id % 2 = 1""")
def s11_series_parts(t):
    """Four parts after ``radiology``, else the last four, padded on the left."""
    i = F.col("page_id")
    path = F.when(i % 2 == 0, F.concat(F.lit("/x/radiology/h"), i % 7, F.lit("/p"), i % 5, F.lit("/st/"), i, F.lit(".zip"))).otherwise(F.concat(F.lit("only/"), i, F.lit(".zip")))
    return t("pages").select("page_id", T.series_parts(path).alias("s")).select("page_id", "s.*")


@Q("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 's3a://' || substr(url, 9) ELSE url END AS moved FROM pages")
def s12_replace_prefix(t):
    return t("pages").select("page_id", T.replace_prefix("url", "https://", "s3a://").alias("moved"))


@Q("SELECT page_id, 'store' AS store, CAST(page_id AS VARCHAR) AS sample, url AS image, CAST(NULL AS VARCHAR) AS none FROM pages")
def s13_feature_refs(t):
    ref = t("pages").select("page_id", T.feature_ref(F.lit("store"), sample=F.col("page_id").cast("string"), image=F.col("url")).alias("r"))
    return ref.select("page_id", T.ref_store("r").alias("store"), T.ref_part("r", "sample").alias("sample"), T.ref_part("r", "image").alias("image"), T.ref_part("r", "series").alias("none"))


@Q("SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'unknown-sample' ELSE CAST(conv_id AS VARCHAR) END || '::' || role || '::caption-' || turn AS row_id FROM conversations")
def s14_row_ids(t):
    sample = F.when(F.col("turn") == 0, " ").otherwise(F.col("conv_id").cast("string"))
    return t("conversations").select("conv_id", "turn", T.row_id(("sample", sample), ("slide", "role"), suffix=F.concat(F.lit("caption-"), "turn")).alias("row_id"))


@Q("SELECT c_custkey, 'src-' || substr(sha256('src||' || c_name || '||' || c_mktsegment || '||case'), 1, 16) AS sample_id, md5(c_name) AS hash FROM customer")
def s15_stable_ids(t):
    return t("customer").select("c_custkey", T.sample_id(F.lit("src"), "c_name", "c_mktsegment", F.lit("case")).alias("sample_id"), T.path_hash("c_name").alias("hash"))


@Q("""WITH g AS (SELECT c_custkey, 'src:' || c_mktsegment || ':' || c_name AS g FROM customer),
      u AS (SELECT *, (CAST(('0x' || substr(sha256(g), 1, 8)) AS BIGINT) % 10000) / 10000.0::DOUBLE AS u FROM g)
      SELECT c_custkey, g AS split_group_id, CASE WHEN u < CAST(0.7 AS DOUBLE) THEN 'train' WHEN u < CAST(0.7 AS DOUBLE) + CAST(0.2 AS DOUBLE) THEN 'val' ELSE 'test' END AS split FROM u""")
def s16_assigned_split(t):
    g = t("customer").select("c_custkey", T.split_group(F.lit("src"), "c_mktsegment", "c_name").alias("split_group_id"))
    return g.withColumn("split", T.assigned_split("split_group_id", {"train": 0.7, "val": 0.2, "test": 0.1}))


@Q("SELECT c_custkey, 'name: ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '; segment: ' || c_mktsegment ELSE '' END AS biomarkers FROM customer")
def s17_labelled_text(t):
    seg = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("")
    return t("customer").select("c_custkey", T.labelled_text([("name", "c_name"), ("none", F.lit(None)), ("segment", seg)]).alias("biomarkers"))


@Q("""SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'unreadable_dicom_header' WHEN event_id % 7 = 0 THEN 'unsupported_modality' WHEN event_id % 5 = 0 THEN 'secondary_capture_sop'
             WHEN event_type = 'click' THEN 'localizer_or_scout' WHEN event_id % 3 = 0 THEN 'multiframe_instance' WHEN event_id % 11 = 0 THEN 'missing_required_image_tags'
             WHEN user_id % 8 = 0 THEN 'tiny_matrix' WHEN event_type = 'view' THEN 'derived_or_reformatted_image' END AS reason FROM events""")
def s18_image_reject_reason(t):
    e, u = F.col("event_id"), F.col("user_id")
    rows = t("events").select(
        "event_id",
        (e % 13 != 0).alias("readable_dicom"),
        F.lit(None).cast("string").alias("reject_reason"),
        F.when(e % 7 == 0, "US").otherwise("CT").alias("modality"),
        F.when(e % 5 == 0, T.SECONDARY_CAPTURES[2]).otherwise("1.2").alias("sop_class_uid"),
        F.when(F.col("event_type") == "click", "ORIGINAL\\localizer").when(F.col("event_type") == "view", "x\\MIP").otherwise("ORIGINAL").alias("image_type"),
        F.lit(None).cast("string").alias("series_description"),
        F.lit("sublime").alias("protocol_name"),
        F.when(e % 3 == 0, 9).alias("number_of_frames"),
        F.when(u % 8 == 0, 16).otherwise(512).alias("rows"),
        F.lit(512).alias("cols"),
        F.when(e % 11 != 0, 16).alias("bits_allocated"),
    )
    return rows.select("event_id", T.image_reject_reason().alias("reason"))


@Q("""SELECT doc_id, CASE lang WHEN 'en' THEN 'val' WHEN 'de' THEN 'test' ELSE 'train' END AS split, CASE lang WHEN 'en' THEN 'Dev' WHEN 'de' THEN 'TEST' WHEN 'fr' THEN 'train' ELSE 'odd' END AS export FROM documents""")
def s19_split_alias(t):
    s = F.when(F.col("lang") == "en", " Dev ").when(F.col("lang") == "de", "TEST").when(F.col("lang") == "fr", "NaN").otherwise("odd")
    return t("documents").select("doc_id", T.split_alias(s).alias("split"), T.export_split(s).alias("export"))


@Q("SELECT o_orderkey, printf('%.2f', o_totalprice) AS price, CAST(CAST(trunc(o_totalprice) AS BIGINT) AS VARCHAR) AS whole, '' AS none FROM orders")
def s20_fixed_decimals(t):
    return t("orders").select("o_orderkey", T.fixed_decimals(F.col("o_totalprice").cast("string"), 2).alias("price"), T.integer_text(F.col("o_totalprice").cast("string")).alias("whole"), T.fixed_decimals(F.lit("n/a"), 2).alias("none"))


@Q("SELECT c_custkey, substr('name: ' || c_name || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'segment: ' || c_mktsegment ELSE '' END, 1, 40) AS prompt FROM customer")
def s21_metadata_lines(t):
    seg = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("Not_Available")
    return t("customer").select("c_custkey", T.metadata_lines([("name", "c_name"), ("segment", seg)], 40).alias("prompt"))


@Q("SELECT p_partkey, trim(regexp_replace(regexp_replace(p_type, '[._]', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM part")
def s22_label_text(t):
    return t("part").select("p_partkey", T.label_text(F.concat(F.lit("_"), F.replace("p_type", F.lit(" "), F.lit(".")), F.lit("__"))).alias("label"))


@Q("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) WHEN page_id % 3 = 1 THEN 'img.' || page_id ELSE 'store' END AS stem FROM pages")
def s23_series_stem(t):
    i = F.col("page_id").cast("string")
    explicit = F.when(F.col("page_id") % 3 == 0, i)
    image = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("a/img."), i, F.lit(".png")))
    return t("pages").select("page_id", T.first_non_blank(explicit, T.stem(image), T.stem(F.lit("x/store.h5"))).alias("stem"))


@Q("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, CAST(json_extract_string(props, '$.k') AS BIGINT) AS whole, event_type = 'click' AS flag, CAST(NULL AS DOUBLE) AS bad FROM events")
def s25_parsed(t):
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", T.number(k).alias("number"), T.integer(k).alias("whole"), T.boolean(F.when(F.col("event_type") == "click", " YES").otherwise("0")).alias("flag"), T.number(F.lit("inf")).alias("bad"))


@Q("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 400 > 365 THEN CAST(CAST(round_even(l_quantity * 400 / 365.25::DOUBLE, 0) AS BIGINT) AS VARCHAR) END AS age FROM lineitem""")
def s26_age_years(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", T.age_years(F.col("l_quantity") * 400).alias("age"))


@Q("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN 5.0 END AS days, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS event FROM orders""")
def s27_survival(t):
    death = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    follow = F.when(F.col("o_orderstatus").isin("F", "O"), "5")
    return t("orders").select("o_orderkey", T.survival(death, follow).alias("s")).select("o_orderkey", "s.*")


@Q("""SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'head_neck' WHEN p_size % 6 = 1 THEN 'thorax' WHEN p_size % 6 = 2 THEN 'abdomen_pelvis' WHEN p_size % 6 = 3 THEN 'mixed_sarc' ELSE 'generic' END AS region FROM part""")
def s28_region(t):
    m = F.col("p_size") % 6
    text = F.when(m == 0, "xx laryngeal chest").when(m == 1, "chest kidney").when(m == 2, "renal bone").when(m == 3, "left femur").otherwise("zz")
    return t("part").select("p_partkey", T.region(text, T.REGION_WORDS).alias("region"))


@Q("""SELECT event_id, CAST(round_even((least(greatest(value, 30 - 20.0::DOUBLE), 30 + 20.0::DOUBLE) - 10) / 40.0::DOUBLE * 255, 0) AS INTEGER) AS grey,
             CAST(255 - round_even((least(greatest(value, 30 - 20.0::DOUBLE), 30 + 20.0::DOUBLE) - 10) / 40.0::DOUBLE * 255, 0) AS INTEGER) AS inverse FROM events WHERE value IS NOT NULL""")
def s29_s33_windowed(t):
    g = t("events").where("value is not null").select("event_id", T.windowed("value", 30, 40).alias("grey"), F.lit("MONOCHROME1").alias("p"))
    return g.select("event_id", "grey", T.inverted("grey", "p").alias("inverse"))


_PIXELS = """p AS (SELECT vec_id, i, (vec_id + i) % 5 = 0 OR vec_id % 10 = 1 AS pad, CASE WHEN (vec_id + i) % 11 = 0 THEN 'nan'::DOUBLE WHEN (vec_id + i) % 13 = 0 THEN 'inf'::DOUBLE WHEN vec_id % 10 = 0 THEN 5.0::DOUBLE
     WHEN vec_id % 10 = 2 THEN CASE WHEN i = 3 THEN 9.0::DOUBLE ELSE 2.0::DOUBLE END ELSE CAST(embedding[i + 1] AS DOUBLE) * 1000 END AS x FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings))"""


def pixel_rows(t) -> DataFrame:
    """Embeddings as images with padding, NaN and infinite pixels; some are constant, all padding, or all but one pixel alike."""
    v = F.col("vec_id")
    value = lambda x, i: F.when(v % 10 == 0, 5.0).when(v % 10 == 2, F.when(i == 3, 9.0).otherwise(2.0)).otherwise(x.cast("double") * 1000)
    pixel = lambda x, i: F.when((v + i) % 11 == 0, float("nan")).when((v + i) % 13 == 0, float("inf")).otherwise(value(x, i))
    return t("embeddings").select("vec_id", F.transform("embedding", pixel).alias("pixels"), F.transform("embedding", lambda x, i: ((v + i) % 5 == 0) | (v % 10 == 1)).alias("padding"))


@Q(f"""WITH {_PIXELS}, b AS (SELECT vec_id, quantile_cont(x, 0.25) AS lo, quantile_cont(x, 0.75) AS hi, min(x) AS least, max(x) AS most FROM p WHERE NOT pad AND isfinite(x) GROUP BY 1),
      c AS (SELECT vec_id, CASE WHEN hi > lo THEN lo ELSE least END AS lo, CASE WHEN hi > lo THEN hi ELSE most END AS hi FROM b)
      SELECT vec_id, list(CAST(CASE WHEN pad OR isnan(x) OR NOT coalesce(hi > lo, false) THEN 0 ELSE round_even((least(greatest(x, lo), hi) - lo) / (hi - lo) * 255, 0) END AS INTEGER) ORDER BY i) AS grey FROM p LEFT JOIN c USING (vec_id) GROUP BY vec_id""")
def s30_rescaled(t):
    """Each image between quantiles of its own valid pixels, falling back to its extremes, then to zeros."""
    return pixel_rows(t).select("vec_id", I.rescaled("pixels", "padding", 0.25, 0.75).alias("grey"))


@Q(f"""WITH {_PIXELS}, w AS (SELECT CASE vec_id % 3 WHEN 0 THEN [-600.0, 50.0, 300.0] WHEN 1 THEN [50.0, 60.0, 300.0] ELSE [50.0, 300.0, 50.0] END AS c, CASE vec_id % 3 WHEN 0 THEN [1500.0, 400.0, 1500.0] WHEN 1 THEN [350.0, 180.0, 1500.0] ELSE [400.0, 1500.0, 800.0] END AS w, vec_id FROM embeddings),
      g AS (SELECT vec_id, k, i, CASE WHEN pad OR isnan(x) THEN 0 ELSE round_even((least(greatest(x, CAST(c[k] AS DOUBLE) - CAST(w[k] AS DOUBLE) / 2), CAST(c[k] AS DOUBLE) + CAST(w[k] AS DOUBLE) / 2) - (CAST(c[k] AS DOUBLE) - CAST(w[k] AS DOUBLE) / 2)) / CAST(w[k] AS DOUBLE) * 255, 0) END AS grey
            FROM p JOIN w USING (vec_id), (SELECT unnest([1, 2, 3]) AS k))
      SELECT vec_id, list(CAST(grey AS INTEGER) ORDER BY k, i) AS grey FROM g GROUP BY vec_id""")
def s29_window_channels(t):
    """Three windows of the body region as three channels."""
    region = F.when(F.col("vec_id") % 3 == 0, "thorax_abdomen").when(F.col("vec_id") % 3 == 1, "head_neck").otherwise("elsewhere")
    return pixel_rows(t).select("vec_id", F.flatten(I.region_channels("pixels", region, "padding")).alias("grey"))


@Q("SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))), 6)) AS unit FROM embeddings")
def s31_normalised(t):
    return t("embeddings").select("vec_id", F.transform(T.normalised("embedding"), lambda x: T.rounded(x, 6)).alias("unit"))


@Q("SELECT n_nationkey, 'gdc://nation/' || n_name || '/' || n_regionkey AS uri FROM nation")
def s32_uri(t):
    return t("nation").select("n_nationkey", T.uri("gdc", F.lit("nation"), "n_name", F.col("n_regionkey").cast("string")).alias("uri"))
