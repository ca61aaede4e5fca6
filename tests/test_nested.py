"""Nested documents: the walk, and mutation records of odd documents."""

import json

from pyspark.sql import functions as F

from cohort_spark.functions.nested import nesting, walked
from cohort_spark.operators import mutations as M


def nodes(value):
    """All nodes, level by level."""
    out, last = [], [value]
    while last:
        out += last
        last = [y for x in last for y in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else [])]
    return out


DOCUMENTS = [{"a": {"b": [1, {"c": ["q", None, 2.5, True]}]}, "d": []}, [1, [2, [3, [4, [5]]]]], "text {[", {"a\"]": "\\\"[{"}, 7, None, {}]


def test_walk_reaches_every_node(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCUMENTS)] + [(90, "{broken"), (91, None), (92, "")], "i int, j string")
    found = {r.i: r for r in df.select("i", nesting("j").alias("depth"), F.transform(walked("j"), lambda n: F.to_json(n)).alias("n")).collect()}
    order = lambda xs: sorted(json.dumps(x, sort_keys=True) for x in xs)
    for i, d in enumerate(DOCUMENTS):
        assert order(json.loads(x) for x in found[i].n) == order(nodes(d))
    assert [found[i].n for i in (90, 91, 92)] == [[], [], []]
    assert found[1].depth == 5 and found[2].depth == 0


def records(spark, *documents):
    df = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)], "i int, j string")
    return {r.i: r for r in M.mutation_records(df, "j", ["i"]).collect()}


def test_records_of_both_case_forms(spark):
    project = {"project_id": "TCGA-KIRC"}
    found = records(
        spark,
        {"ssm_id": "a", "occurrence": [{"case": {"case_id": "c1", "submitter_id": "P1", "project": project}}, {"case_id": "c2"}, None, 3], "consequence": [{"transcript": {"gene": {"symbol": "vhl"}, "consequence_type": "missense"}}]},
        {"ssm_id": "b", "case": {"case_id": "c1", "submitter_id": "P1", "project": None}, "cases": [{"caseId": "c3", "patient_id": " "}, {"case_id": "c1", "submitter_id": "P1"}]},
        {"id": 12, "occurrence": None, "case": [], "deep": {"er": [{"patientId": "P9", "x": 1}]}},
        {"symbol": ["tp53", "VHL"], "gene_symbol": None, "consequenceType": "b, a,,b"},
        {"nothing": {"symbol": {"x": 1}}},
        "{broken",
        {"ssm_id": "z"},
    )
    assert set(found) == {0, 1, 2, 3, 6}
    links = {i: [tuple(x) for x in r.links] for i, r in found.items()}
    assert links[0] == [("c1", "P1", "TCGA-KIRC"), ("c2", "", "")]
    assert links[1] == [("c1", "P1", ""), ("c3", "", "")]
    assert links[2] == [("", "P9", "")] and found[2].ssm_id == "12"
    assert found[0].gene_symbols == ["VHL"] and found[0].consequence_terms == ["missense"]
    assert found[3].gene_symbols == ["TP53", "VHL"] and found[3].consequence_terms == ["a", "b"] and found[3].links == []
    assert found[6].links == [] and found[6].gene_symbols == []


def test_index_counts_events_and_genes_under_both_keys(spark):
    docs = [
        {"ssm_id": "a", "case": {"case_id": "c1", "submitter_id": "P1"}, "gene": {"symbol": "vhl"}},
        {"ssm_id": "a", "case": {"case_id": "c1", "submitter_id": "P1"}, "gene": {"symbol": "VHL"}},
        {"ssm_id": "b", "case": {"case_id": "c2", "submitter_id": "P1"}, "symbol": "TP53"},
        {"ssm_id": "c", "case": {"submitter_id": "P2"}},
    ]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs], "j string")
    summary = M.mutation_summary(M.mutation_entries(M.mutation_records(df, "j")))
    found = {(r.kind, r.key): (r.events, r.genes, r.gene_symbols, r.ssm_ids) for r in summary.collect()}
    assert found == {("case", "c1"): (2, 1, ["VHL"], ["a"]), ("case", "c2"): (1, 1, ["TP53"], ["b"]), ("patient", "P1"): (3, 2, ["TP53", "VHL"], ["a", "b"]), ("patient", "P2"): (1, 0, [], ["c"])}
    cases = spark.createDataFrame([("c1", "P1"), ("c9", "P2"), ("c9", None)], "case string, patient string")
    joined = {(r.case, r.patient): (r.mutation_events, r.mutation_genes) for r in M.with_mutations(cases, summary, "case", "patient").collect()}
    assert joined == {("c1", "P1"): (2, 1), ("c9", "P2"): (1, 0), ("c9", None): (0, 0)}


def test_objects_come_level_by_level_as_maps(spark):
    from cohort_spark.functions.nested import document, objects

    texts = ['{"a": [{"b": 1}, [{"c": "[{"}]], "d": {"e": null}}', "[1, {}]", "7", '"{"', "{", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, j string")
    found = {r.i: r.keys for r in df.select("i", F.transform(objects(document("j"), "j"), lambda m: F.array_join(F.map_keys(m), "")).alias("keys")).collect()}
    assert found == {0: ["ad", "e", "b", "c"], 1: [""], 2: [], 3: [], 4: [], 5: []}
