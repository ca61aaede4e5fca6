"""Array and struct expressions of the cohort registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohort_spark.functions.text import clean, col


def no_items(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def items(c) -> Column:
    """Light coercion of a list column: null is empty, items are cleaned, blanks dropped."""
    return F.coalesce(F.filter(F.transform(col(c), clean), lambda x: x != ""), no_items())


def item(c) -> Column:
    """Light coercion of a text column: one item, none if blank; nothing is parsed."""
    return F.when(clean(c) != "", F.array(clean(c))).otherwise(no_items())


def parsed_list(c) -> Column:
    """A list from text that may be a printed list.

    Blank is empty; ``['a' 'b']``, ``["a", "b"]`` and one item a line give the
    quoted items; ``[7, 9]`` its numbers as text; brackets that are neither, and
    all other text, are one item.
    """
    t = clean(c)
    inner = F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))
    quoted = F.regexp_extract_all(t, F.lit("'([^']*)'|\"([^\"]*)\""), F.lit(0))
    quoted = F.transform(quoted, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    quoted = F.filter(quoted, lambda x: F.trim(x) != "")
    numbers = F.transform(F.filter(F.split(inner, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x))
    numeric = inner.rlike(r"^\s*[-+]?[0-9.]+(\s*,\s*[-+]?[0-9.]+)*\s*,?\s*$")
    listed = F.when(F.trim(inner) == "", no_items()).when(F.size(quoted) > 0, quoted).when(numeric, numbers).otherwise(F.array(t))
    return F.when(t == "", no_items()).when(t.startswith("[") & t.endswith("]"), listed).otherwise(F.array(t))


def whole_numbers(list_column: Column) -> Column:
    """Items as truncated whole numbers; those that are none are skipped."""
    return F.filter(F.transform(list_column, lambda x: x.try_cast("double").cast("bigint")), lambda x: x.isNotNull())


def sorted_unique(c) -> Column:
    return F.array_sort(F.array_distinct(items(c)))


def unique(c) -> Column:
    """Distinct items in the order of their first appearance."""
    return F.array_distinct(items(c))


def containing(c, needles: Sequence[str]) -> Column:
    """Items that contain one of the needles; no needles means all."""
    if not needles:
        return col(c)
    return F.filter(col(c), lambda x: _any(x.contains(n) for n in needles))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def first_where(c, keep: Callable[[Column], Column], fallback: bool = True) -> Column:
    """The first item that ``keep`` accepts, else (with ``fallback``) the first item."""
    found = F.try_element_at(F.filter(col(c), keep), F.lit(1))
    return F.coalesce(found, F.try_element_at(col(c), F.lit(1))) if fallback else found


def local_paths(c, suffix: str = "") -> Column:
    """Distinct entries without ``://``, with the suffix if one is given."""
    keep = lambda x: ~x.contains("://") & (x.endswith(suffix) if suffix else F.lit(True))
    return F.array_distinct(F.filter(items(c), keep))


def display(c, separator: str = ", ") -> Column:
    return F.array_join(items(c), separator)


def field_of(structs, field: str) -> Column:
    """One field of a list of structs as a parallel list."""
    return F.transform(col(structs), lambda s: s[field])


def top_columns(names: Sequence[str], k: int = 3, skip: Sequence[str] = ("p-value", "correlation", "rmse")) -> Column:
    """(name, value) of the ``k`` largest positive numeric columns, ties by name; row-local."""
    used = [n for n in names if not any(s in n.lower() for s in skip)]
    pairs = F.array(*[F.struct((-F.col(n).cast("double")).alias("minus"), F.lit(n).alias("name")) for n in used])
    best = F.slice(F.array_sort(F.filter(pairs, lambda p: p["minus"] < 0)), 1, k)
    return F.transform(best, lambda p: F.struct(p["name"].alias("name"), (-p["minus"]).alias("value")))


def ordered_intersection(panel: Sequence[str], c) -> Column:
    """Panel entries that occur in the list, in panel order."""
    return F.array_intersect(F.array(*[F.lit(g) for g in panel]), col(c))


def drivers_then_others(c, drivers: Sequence[str], n: int, m: int) -> Column:
    """Up to ``n`` drivers in panel order, then up to ``m`` other distinct items."""
    own = ordered_intersection(drivers, c)
    rest = F.array_except(col(c), F.array(*[F.lit(g) for g in drivers]))
    return F.concat(F.slice(own, 1, n), F.slice(rest, 1, m))


def preferred_pair(pairs, terms: Sequence[str]) -> Column:
    """First (centre, width, explanation) whose explanation has a term, by term order, else the first; widths must be positive."""
    good = F.filter(col(pairs), lambda p: p["width"] > 0)

    def with_term(term: str) -> Column:
        return F.try_element_at(F.filter(good, lambda p: F.lower(p["explanation"]).contains(term)), F.lit(1))

    by_term = [with_term(t) for t in terms]
    return F.coalesce(*by_term, F.try_element_at(good, F.lit(1)))


def squeezed(nested) -> Column:
    """The inner list of a list of one list."""
    return F.when(F.size(col(nested)) == 1, F.element_at(col(nested), 1))


def paired(features, coords) -> Column:
    """(features, coords), both squeezed; lists of unlike length are an error, missing ones are null."""
    both = F.struct(squeezed(features).alias("features"), squeezed(coords).alias("coords"))
    alike = lambda b: F.when(F.coalesce(F.size(b["features"]) != F.size(b["coords"]), F.lit(False)), F.raise_error(F.concat_ws(" ", F.lit("rows differ:"), F.size(b["features"]), F.size(b["coords"]))).cast("boolean")).otherwise(True)
    return F.element_at(F.filter(F.array(both), alike), 1)


def split_records(records, reason: str, path: str, modality: str) -> Column:
    """(accepted, rejected, usable_paths, usable, modality) of a list of records.

    A record is rejected if its ``reason`` is there and not blank. Paths are
    those of accepted records that have one; the modality is the first that is
    not blank, rejected records included.
    """
    refused = lambda r: F.coalesce(F.trim(r[reason]) != "", F.lit(False))
    filled = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False)))
    accepted = F.filter(col(records), lambda r: ~refused(r))
    paths = filled(F.transform(accepted, lambda r: r[path]))
    modalities = filled(F.transform(col(records), lambda r: r[modality]))
    return F.struct(
        accepted.alias("accepted"),
        F.filter(col(records), refused).alias("rejected"),
        paths.alias("usable_paths"),
        F.size(paths).alias("usable"),
        F.coalesce(F.try_element_at(modalities, F.lit(1)), F.lit("")).alias("modality"),
    )


def step_of(coords) -> Column:
    """Greatest common divisor of the gaps between sorted distinct numbers, null without gaps."""
    xs = F.array_sort(F.array_distinct(col(coords)))
    gaps = F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), lambda b, a: b - a)
    return gcd_of(gaps)


def gcd_of(numbers) -> Column:
    """Greatest common divisor of positive whole numbers, by Euclid's steps; null for none."""
    zero = F.lit(0).cast("bigint")

    def gcd(a: Column, b: Column) -> Column:
        start = F.struct(F.greatest(a, b).cast("bigint").alias("a"), F.least(a, b).cast("bigint").alias("b"))
        steps = F.sequence(F.lit(1), F.lit(92))  # Euclid ends sooner for 64-bit numbers
        done = F.aggregate(steps, start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, F.lit(1)).otherwise(s["b"])).alias("b"))))
        return done["a"]

    return F.nullif(F.aggregate(col(numbers), zero, gcd), zero)


def envelope(*alternatives) -> Column:
    """The first list that is there among an envelope's fields."""
    return F.coalesce(*[col(a) for a in alternatives])
