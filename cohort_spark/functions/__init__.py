"""Column expressions: text, ids, numbers, arrays. No Python UDF anywhere."""
