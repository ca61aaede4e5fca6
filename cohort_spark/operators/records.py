"""Studies and series from records of several sources, which name the same field differently."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohort_spark.functions.nested import document, field, texts_in
from cohort_spark.sources.scratch import written

# The names under which records give a field, the first that is there and not blank counting.
STUDY_FIELDS = {
    "patient_id": ("PatientID", "PatientId", "patientId", "SubjectID", "subject_id"),
    "study_instance_uid": ("StudyInstanceUID", "StudyInstanceUid", "studyInstanceUid"),
    "study_date": ("StudyDate", "studyDate"),
    "study_description": ("StudyDescription", "studyDescription"),
    "study_series_count": ("NumberOfStudyRelatedSeries", "numberOfStudyRelatedSeries", "SeriesCount"),
    "study_instance_count": ("NumberOfStudyRelatedInstances", "numberOfStudyRelatedInstances", "ImageCount"),
}
STUDY_MODALITIES = ("ModalitiesInStudy", "modalitiesInStudy", "Modalities", "Modality")
SERIES_FIELDS = {
    "series_instance_uid": ("SeriesInstanceUID", "SeriesInstanceUid", "seriesInstanceUid"),
    "modality": ("Modality", "modality"),
    "body_part_examined": ("BodyPartExamined", "bodyPartExamined", "BodyPart"),
    "series_description": ("SeriesDescription", "seriesDescription"),
}


def read_fields(docs: DataFrame, json: str, names: Mapping[str, Sequence[str]], needed: str, keep: Sequence[str], **more: Column) -> DataFrame:
    """``keep``, then a text column for each named field of a JSON record; records without the field ``needed`` go.

    That field is a generator's output, below which its condition is not moved:
    a record is parsed once, and its other fields are read only if it stays.
    """
    root = docs.select(*keep, document(json).alias("_root"))
    found = root.select(*keep, "_root", field(F.col("_root"), *names[needed]).alias("_needed"))
    stay = found.select(*keep, "_root", F.explode(F.array("_needed")).alias("_found")).where("_found <> ''")
    text = {f: field(F.col("_root"), *n) for f, n in names.items()} | {needed: F.col("_found")}
    return stay.select(*keep, *[c.alias(f) for f, c in (text | more).items()])


def study_records(docs: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row a study record: ``keep``, the study's fields and its modalities, a sorted list; records without a patient go."""
    first = F.filter(F.array(*[F.try_variant_get("_root", f"$.{n}", "variant") for n in STUDY_MODALITIES]), lambda v: v.isNotNull())
    return read_fields(docs, json, STUDY_FIELDS, "patient_id", keep, modalities_in_study=texts_in(F.slice(first, 1, 1)))


def series_records(docs: DataFrame, json: str, studies: DataFrame, study: str = "study_instance_uid", keep: Sequence[str] = ()) -> DataFrame:
    """Series records of the studies, each study visited once under its first patient; records without a series uid go.

    ``docs`` has the study's uid in the column ``study``. The studies are written
    once, so that few of them are known to be few and meet the records, before
    those are parsed, without a shuffle.
    """
    named = [*keep, study]
    once = studies.where(F.col("study_instance_uid") != "").groupBy(F.col("study_instance_uid").alias("_study")).agg(F.min("patient_id").alias("_patient"))
    known = docs.select(*dict.fromkeys([*named, json])).join(written(once, "studies"), F.col(study) == F.col("_study"))
    rows = read_fields(known, json, SERIES_FIELDS, "series_instance_uid", [*named, "_patient"])
    return rows.select(*named, *SERIES_FIELDS, F.col("_patient").alias("patient_id"))
