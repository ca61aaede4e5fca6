"""Series verdicts with details, and verdicts on listed files."""

import os

from pyspark.sql import functions as F

from cohort_spark.operators import aggregates as A
from cohort_spark.sources import files as S

HEADER = "series_dir string, file int, readable_dicom boolean, reject_reason string, modality string, sop_class_uid string, series_instance_uid string, series_description string, protocol_name string, image_type string, number_of_frames int, rows int, cols int, bits_allocated int"


def header(series, file, **more):
    row = {"readable_dicom": True, "reject_reason": None, "modality": "CT", "sop_class_uid": "1.2", "series_instance_uid": "u", "series_description": "axial", "protocol_name": None, "image_type": "ORIGINAL", "number_of_frames": 1, "rows": 512, "cols": 512, "bits_allocated": 16} | more
    return (series, file, *row.values())


def test_every_reason_with_its_details(spark):
    rows = [
        header("ok", 1), header("ok", 2, rows=8),
        header("unread", 1, readable_dicom=False), header("unread", 2, readable_dicom=None),
        header("mixed", 1), header("mixed", 2, modality="MR"),
        header("uids", 1), header("uids", 2, series_instance_uid="v"),
        header("scout", 1, series_description="Scout"), header("scout", 2, protocol_name="x/LOCALIZER"),
        header("capture", 1, sop_class_uid="1.2.840.10008.5.1.4.1.1.7.2"),
        header("multi", 1, number_of_frames=2),
        header("derived", 1, image_type="DERIVED\\PRIMARY"),
        header("all", 1, rows=8), header("all", 2, number_of_frames=4), header("all", 3, cols=8),
        header("few", 1), *[header("few", i, bits_allocated=None) for i in (2, 3, 4)],
        header("share", 1), header("share", 2), header("share", 3, rows=8), header("share", 4, rows=8), header("share", 5, rows=8),
    ]
    images = spark.createDataFrame(rows, HEADER)
    directories = spark.createDataFrame([("empty",), ("ok",), ("empty",)], "series_dir string")
    verdicts = A.series_verdict(images, least_usable=1, most_rejected=0.5, file="file", directories=directories)
    found = {r.series_dir: (r.reject_reason, r.reject_details) for r in verdicts.collect()}
    assert found == {
        "ok": (None, None),
        "empty": ("empty_directory", "no files"),
        "unread": ("no_readable_dicom_files", "none of 2 files is readable"),
        "mixed": ("mixed_modality_in_directory", "modalities: CT;MR"),
        "uids": ("mixed_series_instance_uid_in_directory", "series uids: u;v"),
        "scout": ("series_is_localizer_or_scout", "all 2 readable images are localizers"),
        "capture": ("series_is_secondary_capture", "all 1 readable images are secondary captures"),
        "multi": ("series_is_multiframe", "all 1 readable images are multiframe"),
        "derived": ("series_is_derived_or_reformatted", "all 1 readable images are derived"),
        "all": ("all_images_rejected", "reasons: tiny_matrix:2, multiframe_instance:1"),
        "few": ("rejected_fraction_too_high", "3 of 4 rejected (0.750), at most 0.500; reasons: missing_required_image_tags:3"),
        "share": ("rejected_fraction_too_high", "3 of 5 rejected (0.600), at most 0.500; reasons: tiny_matrix:3"),
    }
    few = {r.series_dir: r.reject_reason for r in A.series_verdict(images, least_usable=2, multiframe=False, derived=False).collect()}
    assert few["few"] == "too_few_usable_images" and few["multi"] == few["derived"] == "too_few_usable_images" and "empty" not in few
    details = {r.series_dir: r for r in A.series_details(images, verdicts, "series_dir", "file", ["modality"]).collect()}
    assert [i.file for i in details["all"].images] == [1, 2, 3] and details["empty"].images == []


def test_details_read_back_hold_the_share_as_sql_writes_it(spark, tmp_path):
    images = spark.createDataFrame([header("half", i, rows=8 if i < 9 else 512) for i in range(16)], HEADER)
    verdicts = A.series_verdict(images, most_rejected=0.3, file="file").withColumn("verdict", F.coalesce("reject_reason", F.lit("accepted")))
    details = A.series_details(images, verdicts, "series_dir", "file", ["modality"])
    S.write_details(details, str(tmp_path / "details"), ["verdict"])
    back = S.read_details(spark, str(tmp_path / "details"), details.schema).collect()
    assert [(r.series_dir, r.verdict, r.reject_details, [i.file for i in r.images]) for r in back] == [("half", "rejected_fraction_too_high", "9 of 16 rejected (0.562), at most 0.300; reasons: tiny_matrix:9", list(range(16)))]


def test_verdicts_on_listed_files(spark, tmp_path):
    for name, text in (("a/one.txt", "12345"), ("a/b/two.txt", "1"), ("a/empty.txt", ""), (".hidden", "x"), ("_made", "x"), ("a b/ü %20.txt", "123")):
        os.makedirs(os.path.dirname(tmp_path / name), exist_ok=True)
        (tmp_path / name).write_text(text)
    os.makedirs(tmp_path / "hollow")
    files, root = S.inventory(spark, str(tmp_path), folders=True), S.qualified(spark, str(tmp_path))
    names = ["a/one.txt", "a/b/two.txt", "a/empty.txt", ".hidden", "_made", "a b/ü %20.txt", "a", "a/b", "hollow", "gone", "a b"]
    refs = spark.createDataFrame([(n, f"{root}/{n}") for n in names] + [("null", None), ("blank", ""), ("root", root)], "n string, ref string")
    found = {r.n: r.verdict for r in S.file_verdict(refs, files, least=2).collect()}
    assert found == {
        "a/one.txt": "ok", "a/b/two.txt": "too_small", "a/empty.txt": "too_small", ".hidden": "missing", "_made": "missing", "a b/ü %20.txt": "ok",
        "a": "not_a_file", "a/b": "not_a_file", "hollow": "not_a_file", "gone": "missing", "a b": "not_a_file", "null": "missing", "blank": "missing", "root": "not_a_file",
    }
    assert S.inventory(spark, str(tmp_path)).count() == 3  # without folders, files without bytes are not shown
    assert {r.name for r in S.inventory(spark, str(tmp_path), "t*.txt", folders=True).where("kind = 'file'").collect()} == {"two.txt"}
