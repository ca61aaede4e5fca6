"""Sources and sinks: what is written to the shared folder is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.text import rounded
from cohort_spark.plans.artifacts import first_matching_column
from cohort_spark.queries.base import Registry
from cohort_spark.sources import files as S
from cohort_spark.sources import registry as R
from cohort_spark.sources.scratch import scratch_path
from cohort_spark.streaming import refresh

Q = Registry()


def scratch(df: DataFrame, name: str) -> str:
    return scratch_path(df.sparkSession, name)


@Q("SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS source, 'F' AS split FROM orders WHERE o_orderstatus = 'F'")
def io1_registry_round_trip(t):
    """The registry is written, validated, and one split of it read with three columns."""
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("source"), F.col("o_orderstatus").alias("split"))
    R.write_registry(R.normalized(o), path := scratch(o, "registry"))
    return R.read_registry(o.sparkSession, path, ["sample_id", "source", "split"], split="F")


@Q("SELECT doc_id, text, lang AS split FROM documents")
def io3_read_splits(t):
    d = t("documents")
    paths = {}
    for lang in sorted(r.lang for r in d.select("lang").distinct().collect()):  # few languages
        paths[lang] = scratch(d, lang)
        d.where(F.col("lang") == lang).select("doc_id", "text").write.json(paths[lang])
    return S.read_splits(d.sparkSession, paths, "doc_id long, text string")


@Q("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events")
def io5_read_tsv(t):
    """Gzipped tab-separated text without a header."""
    e = t("events").select("event_id", "event_type")
    e.write.option("sep", "\t").option("compression", "gzip").csv(path := scratch(e, "tsv"))
    return S.read_tsv(e.sparkSession, path, "sample", ["event_id", "event_type"])


@Q("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT') AND o_orderstatus IN ('F', 'O') ORDER BY o_orderkey LIMIT 500")
def io6_read_documents(t):
    """Landed JSON, filtered, sorted, capped."""
    o = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    o.write.json(path := scratch(o, "landed"))
    return S.read_documents(o.sparkSession, path, "o_orderkey long, o_orderpriority string, o_orderstatus string", {"o_orderpriority": ["1-URGENT"], "o_orderstatus": ["F", "O"]}, ["o_orderkey"], 500).drop("o_orderstatus")


@Q("SELECT count(*) AS rows, count(value) AS present, round(sum(value), 4) AS total FROM events")
def io7_read_values(t):
    e = t("events").select(F.col("event_id").cast("string").alias("name"), "value")
    e.write.option("sep", "\t").option("nullValue", "NA").csv(path := scratch(e, "values"))
    return S.read_values(e.sparkSession, path).agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("present"), rounded(F.sum("value"), 4).alias("total"))


@Q("""WITH g AS (SELECT page_id % 25 AS k, sum(strlen(html) + 1) AS size FROM pages GROUP BY 1), d AS (SELECT k, unnest(['file', 'folder', 'hidden', 'none', 'empty', 'hole', 'blank']) AS what, size FROM g)
      SELECT k, what, CAST(CASE WHEN what = 'file' THEN size ELSE 0 END AS BIGINT) AS size,
             CASE what WHEN 'file' THEN CASE WHEN size < 100 + k * 1000 THEN 'too_small' ELSE 'ok' END WHEN 'folder' THEN 'not_a_file' WHEN 'hole' THEN 'not_a_file' WHEN 'empty' THEN 'too_small' ELSE 'missing' END AS verdict FROM d""")
def io8_file_verdict(t):
    """References to files, folders, hidden and absent names, an empty file and an empty folder, judged by a listing of what was written."""
    p = t("pages").select((F.col("page_id") % 25).alias("k"), F.coalesce("html", F.lit("")).alias("html"))
    spark, path = p.sparkSession, scratch(p, "files")
    p.repartition("k").write.partitionBy("k").text(path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    store.create(hadoop.Path(f"{path}/empty.bin")).close()
    store.mkdirs(hadoop.Path(f"{path}/hole"))
    files, root = S.inventory(spark, path, folders=True), S.qualified(spark, path)
    own = files.where("kind = 'file' and size > 0").select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long").alias("k"), F.col("path").alias("own"))
    named = {"file": F.col("own"), "folder": F.concat(F.lit(f"{root}/k="), "k"), "hidden": F.lit(f"{root}/_SUCCESS"), "none": F.concat(F.lit(f"{root}/none-"), "k"), "empty": F.lit(f"{root}/empty.bin"), "hole": F.lit(f"{root}/hole"), "blank": F.lit(None)}
    refs = own.select("k", F.explode(F.array(*[F.struct(F.lit(w).alias("what"), c.cast("string").alias("ref")) for w, c in named.items()])).alias("r")).select("k", "r.*")
    judged = S.file_verdict(refs, files.withColumn("least", F.lit(0)), least=1)
    small = (F.col("what") == "file") & (F.col("size") < 100 + F.col("k") * 1000)
    return judged.select("k", "what", "size", F.when(small, "too_small").otherwise(F.col("verdict")).alias("verdict"))


@Q("SELECT doc_id, lang AS split FROM documents WHERE lang IN ('en', 'fr')")
def io12_export_splits(t):
    """Rows of allowed splits, written by split and read back."""
    d = R.export_splits(t("documents").select("doc_id", F.col("lang").alias("split")), ["en", "fr"])
    R.write_splits(d, path := scratch(d, "export"), 10_000)
    return d.sparkSession.read.parquet(path).select("doc_id", F.col("split").cast("string").alias("split"))


@Q("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, 'store::sample=' || vec_id AS embedding_ref FROM embeddings")
def io17_feature_index(t):
    return S.feature_index(t("embeddings"), "store")


@Q("SELECT vec_id FROM embeddings WHERE vec_id % 3 = 1")
def io18_new_features(t):
    """Only keys that are not stored are appended."""
    e = t("embeddings")
    return S.new_features(e.where("vec_id % 3 <> 1"), e.where("vec_id % 3 <> 2"), "vec_id").select("vec_id")


@Q("""SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_orderstatus AS source FROM orders WHERE o_orderstatus <> 'F'
      UNION ALL SELECT 'n' || o_orderkey, 'F' FROM orders WHERE o_orderstatus = 'O'""")
def io19_publish(t):
    """Staging, slice replacement, a new version, a manifest line."""
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("source"))
    R.write_registry(R.normalized(o), old := scratch(o, "unified"))
    fresh = o.where("source = 'O'").select(F.concat(F.lit("n"), "sample_id").alias("sample_id"), F.lit("F").alias("source"))
    return R.publish(o.sparkSession, fresh, "F", old, scratch(o, "staging"), scratch(o, "version"), scratch(o, "manifest")).select("sample_id", "source")


@Q("SELECT CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def io20_unmatched(t):
    d = t("documents")
    return S.write_unmatched(d, t("labels"), "doc_id", scratch(d, "unmatched"))


@Q("""SELECT user_id, arg_max(event_id, ts_id) AS event_id, arg_max(event_type, ts_id) AS event_type FROM (SELECT *, event_id AS ts_id FROM events) GROUP BY user_id""")
def st1_refresh(t):
    """Files that arrive are upserted by a stream: the last event of each user."""
    e = t("events").select("user_id", "event_id", "event_type")
    source, target = scratch(e, "arrivals"), scratch(e, "table")
    e.repartitionByRange(4, "event_id").write.parquet(source)
    refresh.refresh(e.sparkSession, source, "user_id long, event_id long, event_type string", target, scratch(e, "progress"), "user_id", "event_id", lambda b: b, 1)
    both = refresh.latest(e.sparkSession, target)
    return both.select("user_id", "event_id", "event_type")


@Q("SELECT event_id FROM events WHERE event_id % 4 = 0")
def st2_unprocessed(t):
    e = t("events").select("event_id")
    return refresh.unprocessed(e, e.where("event_id % 4 <> 0"), "event_id")[0]


@Q("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'fresh' ELSE 'carried' END AS how, upper(event_type) AS kind FROM events")
def st2_process_once(t):
    """Inputs that arrive twice, over two runs of a stream, are each worked on once; finished rows are carried through."""
    e = t("events").select("event_id", "event_type")
    spark, source, target, progress = e.sparkSession, scratch(e, "inputs"), scratch(e, "results"), scratch(e, "progress")
    done = e.where("event_id % 4 <> 0").select("event_id", F.lit("carried").alias("how"), F.upper("event_type").alias("kind"))
    work = lambda df: df.select("event_id", F.lit("fresh").alias("how"), F.upper("event_type").alias("kind"))
    for parts in (2, 3):
        e.repartition(parts, "event_id").write.mode("append").parquet(source)
        refresh.process_once(spark, source, "event_id long, event_type string", "event_id", target, progress, work, done, 1)
    return refresh.all_results(spark, target, done)


@Q("SELECT 2 AS number, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS rows UNION ALL SELECT 3, (SELECT count(*) FROM orders) UNION ALL SELECT 1, (SELECT count(*) FROM orders)")
def io13_versions(t):
    """A registry version is replaced, then restored; every version that the pointer named is still read."""
    o = t("orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), F.col("o_orderstatus").alias("source"))
    spark, pointer = o.sparkSession, scratch(o, "pointer")
    R.write_registry(R.normalized(o), whole := scratch(o, "whole"))
    R.write_registry(R.normalized(o.where("source = 'F'")), part := scratch(o, "part"))
    for version in (whole, part):
        R.swap_version(spark, pointer, version)
    R.restore_version(spark, pointer, 1)
    each = [R.read_registry(spark, v, ["sample_id"]).agg(F.lit(n).alias("number"), F.count(F.lit(1)).alias("rows")) for n, v in R.pointers(spark, pointer)]
    return each[0].union(each[1]).union(each[2])


@Q("SELECT count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer")
def io15_lazy_rows(t):
    """Rows reach the driver one partition at a time and are only counted there."""
    c = t("customer").select("c_custkey")
    rows = keys = 0
    for r in S.lazy_rows(c):
        rows, keys = rows + 1, keys + r.c_custkey
    return c.sparkSession.createDataFrame([(rows, keys)], "rows long, keys long")


@Q("SELECT o_orderkey, 'r' || o_custkey AS report_path, ['w' || o_orderkey] AS slide_paths FROM orders")
def pf19_path_columns(t):
    """The columns that hold paths, found by their names."""
    o = t("orders").select("o_orderkey", F.concat(F.lit("r"), "o_custkey").alias("report_path"), F.array(F.concat(F.lit("w"), "o_orderkey")).alias("slide_paths"), F.col("o_orderstatus").alias("pathology"), F.col("o_orderpriority").alias("path_note"))
    return o.select("o_orderkey", *R.path_columns(o))


@Q("SELECT l_orderkey, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def s24_matched_column(t):
    """A column is found by ordered patterns, whatever their case."""
    l = t("lineitem")
    found = first_matching_column(l.columns, ["absent", "QUANT", "price"])
    return l.groupBy("l_orderkey").agg(F.sum(found).alias("total"))
