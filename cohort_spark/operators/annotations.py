"""Annotation tables of samples, reduced to one set of values for each patient of a cohort."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.text import clean, fixed_decimals, integer_text, patient_of_barcode, sample_priority
from cohort_spark.plans.artifacts import first_matching_column

# By table, where its sample and its fields stand (the first column that contains a pattern) and how a field is written.
TEXT, THREE, TWO, WHOLE = "text", "three decimals", "two decimals", "whole"
TABLES = {
    "subtypes": (("sampleid", "sample"), {"molecular_subtype": (("Subtype_Selected", "Subtype"), TEXT), "subtype_mrna": (("Subtype_mRNA",), TEXT), "methylation_subtype": (("Subtype_DNAmeth",), TEXT), "integrative_subtype": (("Subtype_Integrative",), TEXT)}),
    "leukocytes": (("sampleid", "sample"), {"leukocyte_fraction": (("leukocyte_fraction", "leukocyte"), THREE)}),
    "scores": (("sampleid", "sample"), {"tumor_purity": (("purity",), TWO), "aneuploidy_score": (("aneuploidy",), WHOLE)}),
    "purity": (("sampleid", "sample", "barcode"), {"fallback_purity": (("purity",), TWO)}),
    "hrd": (("sampleid", "sample", "barcode"), {"hrd_score": (("hrd",), WHOLE)}),
}
FIELDS = ("molecular_subtype", "msi_status", "subtype_mrna", "methylation_subtype", "integrative_subtype", "leukocyte_fraction", "tumor_purity", "aneuploidy_score", "hrd_score")
WRITTEN = {TEXT: clean, THREE: lambda c: fixed_decimals(c, 3), TWO: lambda c: fixed_decimals(c, 2), WHOLE: integer_text}


def sample_rows(table: DataFrame, name: str) -> DataFrame | None:
    """(patient, table, order, fields): a table's rows by patient; None if it has no sample column. Blank samples go."""
    samples, fields = TABLES[name]
    sample = first_matching_column(table.columns, samples)
    if sample is None:
        return None
    named = {f: (first_matching_column(table.columns, patterns), WRITTEN[form]) for f, (patterns, form) in fields.items()}
    values = [(write(F.col(f"`{c}`").cast("string")) if c else F.lit("")).alias(f) for f, (c, write) in named.items()]
    barcode = clean(F.col(f"`{sample}`"))
    order = F.struct(sample_priority(barcode).alias("priority"), barcode.alias("sample"), *[F.concat_ws("\x00", *values).alias("tie")])
    return table.where(barcode != "").select(patient_of_barcode(barcode).alias("patient"), F.lit(name).alias("table"), order.alias("order"), F.struct(*values).alias(name))


def annotated_patients(cohort: DataFrame, tables: Mapping[str, DataFrame], patient: str = "patient_id") -> DataFrame:
    """(patient, FIELDS): for each cohort patient whom any table knows, the values of its best sample in each table.

    ``tables`` holds any of subtypes, leukocytes, scores, purity and hrd, with
    columns as they come. A patient's best sample has the smallest sample code,
    ties by barcode and values; a value that is blank or no number there is
    empty. A subtype that mentions msi sets ``msi_status``. Purity comes from
    scores; only if scores gives no cohort patient a purity does the purity table
    count, whole: a one-row aggregate in the plan says so, no driver job. All
    tables are reduced in one pass over their rows by patient.
    """
    rows = [r for name, table in tables.items() if (r := sample_rows(table, name)) is not None]
    wanted = cohort.select(F.col(patient).alias("patient")).where("patient is not null").distinct()
    kinds = {name: "struct<" + ",".join(f"{f}:string" for f in fields) + ">" for name, (_, fields) in TABLES.items()}
    whole = lambda r: r.select("patient", "table", F.col("order").cast("struct<priority:int,sample:string,tie:string>").alias("order"), *[(F.col(n) if n in r.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])
    every = cohort.sparkSession.createDataFrame([], f"patient string, table string, order struct<priority:int,sample:string,tie:string>, {', '.join(f'{n} {k}' for n, k in kinds.items())}")
    for r in rows:
        every = every.union(whole(r))
    best = every.join(wanted, "patient", "left_semi").groupBy("patient").agg(*[F.min_by(n, F.when(F.col("table") == n, F.col("order"))).alias(n) for n in TABLES])
    field = lambda n, f: F.nullif(F.col(f"{n}.{f}"), F.lit(""))
    known = best.agg(F.coalesce(F.bool_or(field("scores", "tumor_purity").isNotNull()), F.lit(False)).alias("_scored"))
    chosen: dict[str, Column] = {f: field(n, f) for n, (_, fields) in TABLES.items() for f in fields}
    chosen["tumor_purity"] = F.when(F.col("_scored"), chosen["tumor_purity"]).otherwise(chosen.pop("fallback_purity"))
    chosen["msi_status"] = F.when(F.lower(chosen["molecular_subtype"]).contains("msi"), "MSI")
    out = best.join(F.broadcast(known)).select(F.col("patient").alias(patient), *[F.coalesce(chosen[f], F.lit("")).alias(f) for f in FIELDS])
    return out.where(F.concat(*FIELDS) != "")
