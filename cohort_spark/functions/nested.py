"""Expressions on nested JSON documents of unknown depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort_spark.functions.text import clean, col, let


def document(json) -> Column:
    """A JSON text as a variant; null where it is none."""
    return F.try_parse_json(col(json))


def nesting(json) -> Column:
    """How deep a JSON text's lists and objects nest; brackets inside its strings do not count."""
    marks = F.regexp_extract_all(F.regexp_replace(col(json), r'"(?:\\.|[^"\\])*"', ""), F.lit(r"[\[\]{}]"), F.lit(0))
    step = lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1)
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(marks, none, lambda s, c: F.struct((s["now"] + step(c)).alias("now"), F.greatest(s["most"], s["now"] + step(c)).alias("most")))["most"]


def fields(node: Column) -> Column:
    """A variant object as a map of variants; null for anything else."""
    return node.try_cast("map<string,variant>")


def elements(node: Column) -> Column:
    """A variant list as an array of variants; null for anything else."""
    return node.try_cast("array<variant>")


def no_nodes() -> Column:
    return F.array().cast("array<variant>")


def walked(json) -> Column:
    """All nodes of a JSON document, the document itself, every list, object and value in it, level by level; none where it cannot be read.

    Each level is the children of the one before, for as many levels as the
    text nests, so no schema and no depth is assumed.
    """
    children = lambda node: F.coalesce(F.map_values(fields(node)), elements(node), no_nodes())
    root = F.filter(F.array(document(json)), lambda n: n.isNotNull())
    start = F.struct(root.alias("all"), root.alias("last"))

    def deeper(seen: Column, _) -> Column:
        below = F.flatten(F.transform(seen["last"], children))
        return F.transform(F.array(below), lambda n: F.struct(F.concat(seen["all"], n).alias("all"), n.alias("last")))[0]

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), nesting(json))), start, deeper)["all"]


def field(node: Column, *names: str) -> Column:
    """The first of the named fields of an object that is a text, number or flag and not blank, cleaned; else an empty text. Each is looked up once."""
    found = F.array(*[F.try_variant_get(node, f"$.{n}", "variant") for n in names])
    text = lambda v: F.when(v.isNotNull(), F.when(fields(v).isNull() & elements(v).isNull(), clean(v.try_cast("string"))))
    return F.coalesce(F.try_element_at(F.filter(F.transform(found, text), lambda x: x != ""), F.lit(1)), F.lit(""))


def values_of(nodes, names: Sequence[str]) -> Column:
    """The variants that objects among the nodes hold under any of the names."""
    held = lambda node: F.filter(F.array(*[F.try_variant_get(node, f"$.{n}", "variant") for n in names]), lambda v: v.isNotNull())
    return F.flatten(F.transform(F.filter(col(nodes), lambda n: fields(n).isNotNull()), held))


def texts_in(values: Column) -> Column:
    """Sorted distinct texts of variants that are texts, comma-separated texts or lists of texts."""
    each = lambda v: F.coalesce(F.transform(elements(v), lambda x: x.try_cast("string")), F.when(fields(v).isNull(), F.split(v.try_cast("string"), ",")), F.array().cast("array<string>"))
    return F.sort_array(F.array_distinct(F.filter(F.transform(F.flatten(F.transform(values, each)), clean), lambda x: x != "")))


def objects(root: Column, json) -> Column:
    """All objects of a parsed document as maps, level by level; ``json`` is its text.

    Each container is opened once: its map is kept and its values are the next
    level. A text has no more levels than opening brackets; without a next level
    nothing more is done.
    """
    none = F.array().cast("array<map<string,variant>>")
    start = F.struct(none.alias("all"), F.filter(F.array(root), lambda n: n.isNotNull()).alias("last"))
    brackets = F.length(col(json)) - F.length(F.translate(col(json), "[{", ""))

    def deeper(seen: Column, _) -> Column:
        opened = F.transform(seen["last"], lambda n: F.struct(fields(n).alias("map"), elements(n).alias("list")))
        found = lambda o: F.struct(F.concat(seen["all"], F.filter(F.transform(o, lambda x: x["map"]), lambda m: m.isNotNull())).alias("all"), F.flatten(F.transform(o, lambda x: F.coalesce(F.map_values(x["map"]), x["list"], no_nodes()))).alias("last"))
        return F.when(F.size(seen["last"]) == 0, seen).otherwise(let(opened, found))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), brackets)), start, deeper)["all"]


def held(objects: Column, names: Sequence[str]) -> Column:
    """The variants that objects, as maps, hold under any of the names."""
    return F.flatten(F.transform(objects, lambda m: F.filter(F.array(*[m[n] for n in names]), lambda v: v.isNotNull())))


def text_of(node: Column, *names: str) -> Column:
    """``field`` of an object as a map."""
    alone = lambda v: clean(F.when(fields(v).isNull() & elements(v).isNull(), v.try_cast("string")))
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.array(*[node[n] for n in names]), alone), lambda x: x != ""), F.lit(1)), F.lit(""))
