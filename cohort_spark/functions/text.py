"""Text, identity and numeric expressions of the cohort registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c) -> Column:
    """Without leading and trailing Unicode white space; null becomes empty."""
    return F.coalesce(F.regexp_replace(col(c).cast("string"), r"(?U)^\s+|(?U)\s+$", ""), F.lit(""))


def non_blank(c) -> Column:
    """The cleaned text, or null if nothing is left."""
    return F.nullif(clean(c), F.lit(""))


def first_non_blank(*cols) -> Column:
    """The first non-blank of several aliases, cleaned; empty if all are blank."""
    return F.coalesce(*[non_blank(c) for c in cols], F.lit(""))


def text_list(c, separator: str = ",") -> Column:
    """Separated text as a sorted list of distinct non-blank items."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), separator), clean)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


# Names of one modality.
MODALITY_ALIASES = {"MRI": "MR", "MAMMOGRAPHY": "MG", "PET": "PT"}


def modality(c) -> Column:
    """Upper case without spaces and hyphens, aliases replaced."""
    bare = F.regexp_replace(F.upper(clean(c)), "[ -]", "")
    out = bare
    for name, short in MODALITY_ALIASES.items():
        out = F.when(bare == name, short).otherwise(out)
    return out


def modality_list(c) -> Column:
    """Modalities separated by comma, slash or backslash, sorted and distinct."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[,/\\]"), modality)
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def patient_of_barcode(c) -> Column:
    """The first three non-empty parts of a barcode with dots or hyphens; with fewer the text itself."""
    text = F.replace(clean(c), F.lit("."), F.lit("-"))
    parts = F.filter(F.split(text, "-"), lambda x: x != "")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 1, 3), "-")).otherwise(text)


def sample_priority(c) -> Column:
    """The two-digit code that starts the barcode's fourth part, else 99."""
    parts = F.split(F.replace(clean(c), F.lit("."), F.lit("-")), "-")
    code = F.regexp_extract(F.coalesce(F.try_element_at(parts, F.lit(4)), F.lit("")), "^([0-9]{2})", 1)
    return F.coalesce(F.nullif(code, F.lit("")).cast("int"), F.lit(99))


def sample_code(c) -> Column:
    """The two digits that start the last part of a barcode, else 999."""
    code = F.regexp_extract(F.element_at(F.split(clean(c), "-"), -1), "^([0-9]{2})", 1)
    return F.coalesce(F.nullif(code, F.lit("")).cast("int"), F.lit(999))


# Sample types by code.
SAMPLE_TYPES = {
    "01": "primary tumor",
    "02": "recurrent tumor",
    "03": "primary blood-derived cancer",
    "05": "additional new primary",
    "06": "metastatic tumor",
    "07": "additional metastatic tumor",
    "10": "blood-derived normal",
    "11": "solid tissue normal",
}


def sample_type_code(c) -> Column:
    """The code NNA that ends a barcode, upper case, else empty."""
    return F.regexp_extract(F.upper(clean(c)), "-([0-9]{2}[A-Z])$", 1)


def sample_type_label(c) -> Column:
    """Label of a barcode's sample type; others keep their code in the text."""
    code = F.substring(sample_type_code(c), 1, 2)
    out = F.concat(F.lit("sample type code "), F.when(code == "", "unknown").otherwise(code))
    for k, label in SAMPLE_TYPES.items():
        out = F.when(code == k, label).otherwise(out)
    return out


def slide_kind(c) -> Column:
    """DX, TS or BS where the upper-cased stem holds it, else empty."""
    up = F.upper(clean(c))
    return F.when(up.contains("DX"), "DX").when(up.contains("TS"), "TS").when(up.contains("BS"), "BS").otherwise("")


def slide_rank(c) -> Column:
    up = F.upper(clean(c))
    return F.when(up.contains("-DX"), 0).when(up.contains("-TS"), 1).otherwise(2)


def safe_name(c, fallback: str = "unknown") -> Column:
    """Runs outside ``[A-Za-z0-9._-]`` as one underscore, no dots or underscores at the ends."""
    bare = F.regexp_replace(F.regexp_replace(clean(c), "[^A-Za-z0-9._-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit(fallback))


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_name(c) -> Column:
    return F.regexp_extract(col(c), r"([^/]*)/*$", 1)


def stem(c) -> Column:
    """File name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(file_name(c), r"(?<=[^/])\.[^./]+$", "")


def parent(c) -> Column:
    return F.when(col(c).contains("/"), F.regexp_replace(col(c), "/[^/]*$", "")).otherwise(F.lit("."))


def relative_to(c, root: str) -> Column:
    """Path below ``root``; URIs stay, other absolute paths lose their first slash; quotes go."""
    p = F.regexp_replace(clean(c), "^[\"']+|[\"']+$", "")
    base = root.rstrip("/") + "/"
    return F.when(p.contains("://"), p).when(p.startswith(base), F.substring(p, len(base) + 1, 1 << 30)).otherwise(F.regexp_replace(p, "^/+", ""))


def series_parts(c) -> Column:
    """(collection, patient, study, series) of a series archive's path.

    The four parts after ``radiology``, else the last four, padded with empty
    text on the left; ``.zip`` is removed.
    """
    parts = F.filter(F.split(F.regexp_replace(clean(c), r"\.zip$", ""), "/"), lambda x: x != "")
    at = F.array_position(parts, "radiology")
    after = F.slice(parts, F.greatest(at + 1, F.lit(1)).cast("int"), 4)
    tail = F.slice(parts, F.greatest(F.size(parts) - 3, F.lit(1)), 4)
    four = F.when((at > 0) & (F.size(parts) >= at + 4), after).otherwise(tail)
    four = F.concat(F.array_repeat(F.lit(""), F.lit(4) - F.size(four)), four)
    return F.struct(*[F.element_at(four, i + 1).alias(n) for i, n in enumerate(("collection", "patient", "study", "series"))])


def replace_prefix(c, old: str, new: str) -> Column:
    p = col(c)
    return F.when(p.startswith(old), F.concat(F.lit(new), F.substring(p, len(old) + 1, 1 << 30))).otherwise(p)


def feature_ref(store, **parts) -> Column:
    """``store::key=value::...`` from columns."""
    return F.concat(col(store), *[F.concat(F.lit(f"::{k}="), col(v)) for k, v in parts.items()])


def ref_store(c) -> Column:
    return F.element_at(F.split(col(c), "::"), 1)


def ref_part(c, key: str) -> Column:
    """The value of ``key`` in a feature reference, null if it has none."""
    return F.nullif(F.regexp_extract(col(c), f"::{key}=(.*?)(?:::|$)", 1), F.lit(""))


def row_id(*parts, suffix: Column | None = None) -> Column:
    """Parts joined by ``::``; a blank part is ``unknown-<name>``."""
    own = [F.coalesce(non_blank(c), F.lit(f"unknown-{name}")) for name, c in parts]
    return F.concat_ws("::", *own, *([suffix] if suffix is not None else []))


def sample_id(source, patient, study, scope) -> Column:
    """source-<first 16 hex digits of the SHA-256 of the four parts>."""
    return F.concat(col(source), F.lit("-"), F.substring(F.sha2(F.concat_ws("||", *[F.coalesce(col(c), F.lit("")) for c in (source, patient, study, scope)]), 256), 1, 16))


def path_hash(c) -> Column:
    return F.md5(clean(c))


def split_group(source, project, patient) -> Column:
    named = [F.coalesce(non_blank(c), F.lit(f"unknown_{n}")) for n, c in (("source", source), ("project", project), ("patient", patient))]
    return F.concat_ws(":", *named)


def assigned_split(group, ratios: Mapping[str, float] | None = None) -> Column:
    """train, val or test from the group's hash; stable for a group whatever else is in the table.

    The first 8 hex digits of its SHA-256 modulo 10000 are compared with the
    cumulative ratios (train .9, val 0, test .1 where not given). Ratios that sum
    to nothing give train.
    """
    r = {"train": 0.9, "val": 0.0, "test": 0.1} | dict(ratios or {})
    total = sum(r[k] for k in ("train", "val", "test"))
    if total <= 0:
        return F.lit("train")
    u = F.conv(F.substring(F.sha2(col(group), 256), 1, 8), 16, 10).cast("long") % 10000 / F.lit(10000.0)
    return F.when(u < r["train"] / total, "train").when(u < (r["train"] + r["val"]) / total, "val").otherwise("test")


def labelled_text(pairs: Sequence[tuple[str, Column | str]], separator: str = "; ") -> Column:
    """``key: value`` for each non-blank value, joined."""
    return F.concat_ws(separator, *[F.when(non_blank(c).isNotNull(), F.concat(F.lit(f"{k}: "), clean(c))) for k, c in pairs])


def split_alias(c) -> Column:
    s = F.lower(clean(c))
    return F.when(s.isin("validation", "valid", "val", "dev"), "val").when(s == "test", "test").otherwise("train")


def export_split(c, default: str = "train") -> Column:
    s = clean(c)
    return F.when(F.lower(s).isin("", "nan", "none", "null"), default).otherwise(s)


def number(c) -> Column:
    """Text as a finite double, else null."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def integer(c) -> Column:
    """Text as a whole number, truncated, else null."""
    return number(c).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def decimals_text(x: Column, digits: int) -> Column:
    """``%.Nf`` text of a double as C and Python write it: the binary value itself is rounded, exact halves to even.

    The fraction times 10^N is its rounded product and that product's exact error
    (Dekker), so the comparison with one half is exact. Java's formatter rounds the
    shortest decimal text up instead; it serves from 2^63 on only.
    """
    scale = 10**digits

    def exact(v: Column) -> Column:
        whole = F.floor(F.abs(v))
        fraction = F.abs(v) - whole.cast("double")
        high = fraction * 134217729.0 - (fraction * 134217729.0 - fraction)
        product = fraction * float(scale)
        error = (high * float(scale) - product) + (fraction - high) * float(scale)
        parts = F.struct(whole.alias("whole"), F.floor(product).alias("last"), (product - F.floor(product).cast("double") - 0.5 + error).alias("over"))

        def units(p: Column) -> Column:
            odd = (p["last"] if digits else p["whole"]) % 2 == 1
            return F.struct(p["whole"], (p["last"] + ((p["over"] > 0) | (p["over"] == 0) & odd).cast("long")).alias("last"))

        written = lambda p: F.concat((p["whole"] + F.floor(p["last"] / scale)).cast("string"), *([F.lit("."), F.lpad((p["last"] % scale).cast("string"), digits, "0")] if digits else []))
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        return F.when(F.abs(v) < 2.0**63, F.concat(sign, let(let(parts, units), written))).otherwise(F.format_string(f"%.{digits}f", v))

    return let(x.cast("double"), lambda v: F.when(v.isNotNull(), exact(v)))


def rounded(x, digits: int) -> Column:
    """A double rounded as SQL engines in C do it: scaled, halves away from zero, scaled back, the sign of zero kept."""
    x, scale = col(x).cast("double"), 10.0**digits
    return F.when(F.abs(x * scale) == float("inf"), x).otherwise(F.signum(x) * F.round(F.abs(x * scale)) / scale)


def fixed_decimals(c, digits: int) -> Column:
    """``%.Nf`` text, empty where the value is no number."""
    return F.coalesce(decimals_text(number(c), digits), F.lit(""))


def integer_text(c) -> Column:
    return F.coalesce(integer(c).cast("string"), F.lit(""))


TRUE_WORDS = ("1", "true", "yes", "y")


def boolean(c) -> Column:
    return F.lower(clean(c)).isin(*TRUE_WORDS)


def label_text(c) -> Column:
    """Dots and underscores as spaces, runs of space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean(c), "[._]", " "), r"\s+", " "))


def age_years(c) -> Column:
    """Whole years; over 365 counts as days; halves round to even; empty unless positive."""
    x = number(c)
    years = F.bround(F.when(x > 365, x / 365.25).otherwise(x)).cast("long")
    return F.when(years > 0, years.cast("string")).otherwise("")


def survival(death_days, follow_days) -> Column:
    """(days, event): death wins; no days at all gives null and null."""
    d, f = number(death_days), number(follow_days)
    return F.struct(F.coalesce(d, f).alias("days"), F.when(d.isNotNull(), True).when(f.isNotNull(), False).alias("event"))


def metadata_lines(pairs: Sequence[tuple[str, Column | str]], most: int | None = None) -> Column:
    """``key: value`` lines in order; blanks and nan, none, null, not_available are left out; cut at ``most`` characters."""
    kept = [F.when(~F.lower(clean(c)).isin("", "nan", "none", "null", "not_available"), F.concat(F.lit(f"{k}: "), clean(c))) for k, c in pairs]
    text = F.concat_ws("\n", *kept)
    return F.substring(text, 1, most) if most else text


def region(c, groups: Sequence[tuple[str, str]], default: str = "generic") -> Column:
    """The first region whose pattern occurs in the text."""
    out = F.lit(default)
    for name, pattern in reversed(groups):
        out = F.when(col(c).rlike(pattern), name).otherwise(out)
    return out


def windowed(value, centre: float, width: float) -> Column:
    """Clip to the intensity window and scale to 0..255, halves to even."""
    lo, hi = centre - width / 2, centre + width / 2
    clipped = F.least(F.greatest(col(value).cast("double"), F.lit(lo)), F.lit(hi))
    return F.rint((clipped - F.lit(lo)) / F.lit(max(hi - lo, 1e-6)) * 255).cast("int")


def inverted(value, photometric) -> Column:
    return F.when(col(photometric) == "MONOCHROME1", 255 - col(value)).otherwise(col(value))


def normalised(vector) -> Column:
    """The vector divided by its Euclidean length; a zero vector stays."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def uri(scheme: str, *parts) -> Column:
    return F.concat(F.lit(f"{scheme}://"), F.concat_ws("/", *[col(p) for p in parts]))


# Header words and classes that mark images to reject.
LOCALIZER_WORDS = ("LOCALIZER", "SCOUT", "TOPOGRAM", "SCANOGRAM", "SURVEY", "LOCATOR", "PILOT")
DERIVED_WORDS = ("DERIVED", "SECONDARY", "REFORMATTED", "MPR", "MIP", "MINIP", "AVERAGE", "SUB")
SECONDARY_CAPTURES = ("1.2.840.10008.5.1.4.1.1.7", "1.2.840.10008.5.1.4.1.1.7.1", "1.2.840.10008.5.1.4.1.1.7.2", "1.2.840.10008.5.1.4.1.1.7.3", "1.2.840.10008.5.1.4.1.1.7.4")
HEADER_TEXTS = ("image_type", "series_description", "protocol_name")


def tokens(*cols) -> Column:
    """Upper-cased words of several columns."""
    text = F.upper(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in cols]))
    return F.filter(F.split(F.regexp_replace(text, "[^A-Z0-9]+", " "), " "), lambda x: x != "")


def header_words() -> Column:
    """Upper-cased words of an image's header texts, to be projected once where several tests need them."""
    return tokens(*HEADER_TEXTS)


def is_localizer(words=None) -> Column:
    return F.arrays_overlap(header_words() if words is None else col(words), F.array(*[F.lit(w) for w in LOCALIZER_WORDS]))


def is_derived(words=None) -> Column:
    return F.arrays_overlap(header_words() if words is None else col(words), F.array(*[F.lit(w) for w in DERIVED_WORDS]))


def is_secondary_capture() -> Column:
    return F.coalesce(F.col("sop_class_uid").isin(*SECONDARY_CAPTURES), F.lit(False))


def frames() -> Column:
    return F.when(F.col("number_of_frames") > 0, F.col("number_of_frames")).otherwise(1)


def image_reject_reason(modalities: Sequence[str] = ("CT", "MR"), least_rows: int = 64, least_cols: int = 64, multiframe: bool = True, derived: bool = True, words=None) -> Column:
    """The first reason to reject an image header row, or null; ``words`` names projected ``header_words``."""
    out = F.when(~F.coalesce("readable_dicom", F.lit(False)), F.coalesce("reject_reason", F.lit("unreadable_dicom_header")))
    out = out.when(~F.coalesce(F.col("modality").isin(*modalities), F.lit(False)), "unsupported_modality")
    out = out.when(is_secondary_capture(), "secondary_capture_sop").when(is_localizer(words), "localizer_or_scout")
    if multiframe:
        out = out.when(frames() > 1, "multiframe_instance")
    out = out.when(F.col("rows").isNull() | F.col("cols").isNull() | F.col("bits_allocated").isNull(), "missing_required_image_tags")
    out = out.when((F.col("rows") < least_rows) | (F.col("cols") < least_cols), "tiny_matrix")
    return out.when(is_derived(words), "derived_or_reformatted_image") if derived else out


# Body regions by words of the header text, first match wins.
REGION_WORDS = (
    ("head_neck", "thyroid|neck|c-spine|cervical|laryn|pharyn"),
    ("thorax", "lung|thorax|chest|mediast|pulmo|pleura"),
    ("thorax_abdomen", "esoph|esophagus"),
    ("abdomen_pelvis", "abd|abdomen|pelvis|liver|hepatic|kidney|renal|bladder|prostate|ovar|uter|endometr|colon|rect|stomach|gastric|pancre|adrenal|testi"),
    ("mixed_sarc", "sarcoma|extrem|arm|leg|femur|tibia|fibula|humerus|shoulder|pelvic bone|osseous|bone|soft tissue mass"),
)
