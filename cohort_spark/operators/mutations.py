"""Mutation documents: what each says, and an index of them by case and by patient."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.nested import document, elements, fields, held, no_nodes, objects, text_of, texts_in
from cohort_spark.functions.text import let
from cohort_spark.sources.scratch import written

#: Names under which sources give the same field, the first that is there counting.
ID_NAMES = ("ssm_id", "id")
TYPE_NAMES = ("mutation_type", "mutationType", "mutation_subtype", "mutationSubtype", "variant_type")
GENE_NAMES = ("gene_symbol", "symbol")
CONSEQUENCE_NAMES = ("vep_consequence", "consequence_type", "consequenceType")
CASE_NAMES = ("case_id", "caseId")
PATIENT_NAMES = ("submitter_id", "submitterId", "patient_id", "patientId")
PROJECT_NAMES = ("project_id", "projectId")


def case_links(root: Column, objects: Column) -> Column:
    """Distinct (case_id, patient_id, project_id) of a document, in order of appearance; its objects are maps.

    Cases stand in ``occurrence`` (each entry or its ``case``), in ``case`` or in
    ``cases``, one or a list; a document with none of these is searched whole. A
    place without case and patient is no link.
    """
    maps = lambda nodes: F.filter(F.transform(nodes, fields), lambda m: m.isNotNull())
    occurring = F.transform(maps(F.coalesce(elements(root["occurrence"]), no_nodes())), lambda m: F.when(m["case"].isNull(), m).otherwise(fields(m["case"])))
    direct = [maps(F.coalesce(elements(root[n]), F.filter(F.array(root[n]), lambda x: x.isNotNull()))) for n in ("case", "cases")]
    named = F.filter(F.concat(occurring, *direct), lambda m: m.isNotNull())
    link = lambda m: F.struct(text_of(m, *CASE_NAMES).alias("case_id"), text_of(m, *PATIENT_NAMES).alias("patient_id"), text_of(fields(m["project"]), *PROJECT_NAMES).alias("project_id"))
    places = let(named, lambda n: F.when(F.size(n) > 0, n).otherwise(objects))
    return F.array_distinct(F.filter(F.transform(places, link), lambda x: (x["case_id"] != "") | (x["patient_id"] != "")))


def mutation_records(docs: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, ssm_id, mutation_type, gene_symbols, consequence_terms, links) of each document.

    Genes (upper-cased) and consequence terms are gathered at any depth, sorted
    and distinct. Documents that cannot be read, and those with neither gene nor
    id, go. JSON nulls are missing values.
    """

    def record(root: Column, found: Column) -> Column:
        return F.struct(
            text_of(root, *ID_NAMES).alias("ssm_id"),
            text_of(root, *TYPE_NAMES).alias("mutation_type"),
            F.sort_array(F.array_distinct(F.transform(texts_in(held(found, GENE_NAMES)), F.upper))).alias("gene_symbols"),
            texts_in(held(found, CONSEQUENCE_NAMES)).alias("consequence_terms"),
            case_links(root, found).alias("links"),
        )

    walk = let(document(json), lambda root: F.struct(fields(root).alias("root"), objects(root, json).alias("objects")))
    # exploded, so that Spark parses, walks and reads a document once
    read = docs.select(*keep, F.explode(F.array(let(walk, lambda w: record(w["root"], w["objects"])))).alias("_r")).select(*keep, "_r.*")
    return read.where((F.size("gene_symbols") > 0) | (F.col("ssm_id") != ""))


def mutation_entries(records: DataFrame) -> DataFrame:
    """(kind, key, ssm_id, mutation_type, gene_symbols, consequence_terms): every record under each case and each patient that it links to.

    One exploded row for each of a link's two keys: the index's entries, to be
    written partitioned by kind or joined on (kind, key).
    """
    keys = F.array(F.struct(F.lit("case").alias("kind"), F.col("link.case_id").alias("key")), F.struct(F.lit("patient").alias("kind"), F.col("link.patient_id").alias("key")))
    each = records.withColumn("link", F.explode("links")).withColumn("k", F.explode(keys)).where(F.col("k.key") != "")
    return each.select("k.kind", "k.key", "ssm_id", "mutation_type", "gene_symbols", "consequence_terms")


def mutation_summary(entries: DataFrame) -> DataFrame:
    """(kind, key, events, genes, gene_symbols, ssm_ids, mutation_types, consequence_terms): what each case and patient has.

    Entries are counted as they stand; lists are sorted and distinct. Values are
    merged where they are read, before a key's meet.
    """
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    named = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
    out = entries.groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("events"),
        united("gene_symbols").alias("gene_symbols"),
        named("ssm_id").alias("ssm_ids"),
        named("mutation_type").alias("mutation_types"),
        united("consequence_terms").alias("consequence_terms"),
    )
    return out.withColumn("genes", F.size("gene_symbols"))


def with_mutations(cases: DataFrame, summary: DataFrame, case: str, patient: str) -> DataFrame:
    """``cases`` with the summary of its case, or of its patient where the case has no entry; missing counts are 0, lists empty."""
    lists = ["gene_symbols", "ssm_ids", "mutation_types", "consequence_terms"]
    summary = written(summary, "mutations")  # read twice, computed once
    of = lambda kind, key: summary.where(F.col("kind") == kind).select(F.col("key").alias(f"_{key}"), F.struct("events", "genes", *lists).alias(f"_of_{kind}"))
    both = cases.join(of("case", "c"), F.col(case) == F.col("_c"), "left").join(of("patient", "p"), F.col(patient) == F.col("_p"), "left")
    own = F.coalesce("_of_case", "_of_patient")
    added = {f"mutation_{c}": F.coalesce(own[c], F.lit(0)) for c in ("events", "genes")} | {f"mutation_{c}": F.coalesce(own[c], F.array().cast("array<string>")) for c in lists}
    return both.withColumns(added).drop("_c", "_p", "_of_case", "_of_patient")
