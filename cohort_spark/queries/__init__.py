"""The registry operators' queries over the given tables, each with its SQL."""

from cohort_spark.queries import aggregations, arrays, flows, joins, mutations, projections, scans, texts, windows

_MODULES = (scans, projections, joins, aggregations, windows, texts, arrays, mutations, flows)
QUERIES = {name: q for m in _MODULES for name, q in m.Q.queries.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.Q.sql.items()}
FLAGSHIP = "a1_case_lists"
