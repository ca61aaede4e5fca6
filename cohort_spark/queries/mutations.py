"""Nested mutation documents, built from the events, and their index, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort_spark.operators import mutations as M
from cohort_spark.queries.base import Registry, spread

Q = Registry()


def documents(events: DataFrame) -> DataFrame:
    """Each event as a mutation document in one of five shapes: cases below occurrences, one case, several, none named, null levels."""
    events = spread(events.select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")))
    n, k, user = F.col("event_id"), F.col("k"), F.col("user_id")
    case = F.struct(F.concat(F.lit("c"), user % 40).alias("case_id"), F.concat(F.lit("P"), user % 15).alias("submitter_id"), F.struct(F.concat(F.lit("J"), user % 3).alias("project_id")).alias("project"))
    gene = F.struct(F.concat(F.lit("gene"), k % 7).alias("symbol"))
    deep = F.struct(F.struct(F.struct(gene.alias("gene"), F.col("event_type").alias("consequence_type")).alias("transcript")).alias("effect"))
    shallow = F.struct(gene.alias("gene"), F.array("event_type", F.concat(F.lit("t"), k % 2)).alias("vep_consequence"))
    named = F.concat(F.lit("s"), k).alias("ssm_id")
    kind = F.when(k % 3 > 0, F.concat(F.lit("type"), k % 3))
    flat = F.struct(F.concat(F.lit("c"), user % 40).alias("caseId"), F.concat(F.lit("P"), user % 15).alias("patientId"))
    shapes = [
        F.to_json(F.struct(named, kind.alias("mutation_type"), F.array(F.struct(case.alias("case")), F.struct(case.alias("case"))).alias("occurrence"), F.array(deep).alias("consequence"))),
        F.to_json(F.struct(named, kind.alias("mutationSubtype"), case.alias("case"), F.array(shallow).alias("consequence"))),
        F.to_json(F.struct(F.lit(" ").alias("ssm_id"), kind.alias("variant_type"), F.array(case, F.struct(F.lit("").alias("case_id"), F.lit("P99").alias("submitter_id"), F.lit(None).cast("struct<project_id:string>").alias("project"))).alias("cases"), deep.alias("effects"))),
        F.to_json(F.struct(named, F.struct(F.struct(flat.alias("found"), gene.alias("gene")).alias("where")).alias("body"), F.lit("a, b").alias("consequence_type"))),
        F.concat(F.lit('{"ssm_id": null, "occurrence": null, "case": [], "consequence": [null, {"transcript": null}], "symbol": null, "note": "{[", "k": '), k, F.lit("}")),
    ]
    body = F.coalesce(*[F.when(n % 5 == i, shape) for i, shape in enumerate(shapes)])  # of the five only one is written
    return events.select("event_id", body.alias("body"))


_RECORDS = """
WITH e AS (SELECT event_id, event_id % 5 AS shape, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id, event_type FROM events),
r AS (
  SELECT event_id, shape, CASE WHEN shape = 2 THEN '' ELSE 's' || k END AS ssm_id,
         CASE WHEN shape < 3 AND k % 3 > 0 THEN 'type' || (k % 3) ELSE '' END AS mutation_type, ['GENE' || (k % 7)] AS gene_symbols,
         CASE shape WHEN 1 THEN list_sort(list_distinct([event_type, 't' || (k % 2)])) WHEN 3 THEN ['a', 'b'] ELSE [event_type] END AS consequence_terms,
         list_concat([{'case_id': 'c' || (user_id % 40), 'patient_id': 'P' || (user_id % 15), 'project_id': CASE WHEN shape = 3 THEN '' ELSE 'J' || (user_id % 3) END}],
           CASE WHEN shape = 2 THEN [{'case_id': '', 'patient_id': 'P99', 'project_id': ''}] ELSE [] END) AS links
  FROM e WHERE shape < 4 AND k IS NOT NULL)"""
_ENTRIES = (
    _RECORDS
    + """, l AS (SELECT r.*, unnest(links) AS link FROM r),
i AS (SELECT 'case' AS kind, link.case_id AS key, * FROM l WHERE link.case_id <> '' UNION ALL SELECT 'patient', link.patient_id, * FROM l WHERE link.patient_id <> ''),
s AS (
  SELECT kind, key, count(*) AS events, list_sort(list_distinct(flatten(list(gene_symbols)))) AS gene_symbols, list_sort(list_distinct(list(nullif(ssm_id, '')))) AS ssm_ids,
         list_sort(list_distinct(list(nullif(mutation_type, '')))) AS mutation_types, list_sort(list_distinct(flatten(list(consequence_terms)))) AS consequence_terms
  FROM i GROUP BY 1, 2)"""
)


@Q(_RECORDS + " SELECT event_id, ssm_id, mutation_type, gene_symbols, consequence_terms, list_transform(links, lambda x: x.case_id || '/' || x.patient_id || '/' || x.project_id) AS links FROM r")
def ar9_mutation_records(t):
    """Genes, terms and case links of documents of unknown depth in five shapes."""
    records = M.mutation_records(documents(t("events").where(F.get_json_object("props", "$.k").isNotNull())), "body", ["event_id"])
    return records.withColumn("links", F.transform("links", lambda x: F.concat_ws("/", x["case_id"], x["patient_id"], x["project_id"])))


@Q(_ENTRIES + " SELECT kind, key, events, CAST(len(gene_symbols) AS INTEGER) AS genes, gene_symbols, ssm_ids, mutation_types, consequence_terms FROM s")
def a19_mutation_index(t):
    """The index's summary by case and by patient."""
    return M.mutation_summary(M.mutation_entries(M.mutation_records(documents(t("events").where(F.get_json_object("props", "$.k").isNotNull())), "body")))


@Q(
    _ENTRIES
    + """ SELECT c_custkey, coalesce(a.events, b.events, 0) AS mutation_events, CAST(coalesce(len(a.gene_symbols), len(b.gene_symbols), 0) AS INTEGER) AS mutation_genes, coalesce(a.gene_symbols, b.gene_symbols, []) AS mutation_gene_symbols
      FROM customer LEFT JOIN s a ON a.kind = 'case' AND a.key = 'c' || (c_custkey % 60) LEFT JOIN s b ON b.kind = 'patient' AND b.key = 'P' || (c_custkey % 20)"""
)
def a19_cases_with_mutations(t):
    """Cases with the summary of the case, or of the patient where the case has none."""
    summary = M.mutation_summary(M.mutation_entries(M.mutation_records(documents(t("events").where(F.get_json_object("props", "$.k").isNotNull())), "body")))
    cases = t("customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey") % 60).alias("case"), F.concat(F.lit("P"), F.col("c_custkey") % 20).alias("patient"))
    return M.with_mutations(cases, summary, "case", "patient").select("c_custkey", "mutation_events", "mutation_genes", "mutation_gene_symbols")
