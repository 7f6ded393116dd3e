"""Scalar functions on columns: sizes, samples, names, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"KB": 1_000, "MB": 1_000_000, "GB": 1_000_000_000}


def to_bytes(value: Column, unit: Column) -> Column:
    """A size in decimal units as whole bytes, rounded half to even; null where it is not positive or the unit unknown."""
    factor = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])[F.upper(F.trim(unit))]
    out = F.bround(value * factor).cast("long")
    return F.when(out > 0, out)


def format_size(n: Column) -> Column:
    """A size for people; the digits are rounded half to even before they are printed."""
    shown = lambda digits, divisor: F.format_string(f"%.{digits}f", F.bround(n.cast("double") / divisor, digits))
    return (
        F.when(n.isNull(), "-")
        .when(n >= 1_000_000_000, F.concat(shown(2, 1e9), F.lit(" GB")))
        .when(n >= 1_000_000, F.concat(shown(1, 1e6), F.lit(" MB")))
        .when(n >= 1_000, F.concat(shown(0, 1e3), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" bytes")))
    )


def format_bytes_exact(n: Column) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(" bytes"))


def even_sample(start: Column, n: Column, k: Column) -> Column:
    """Up to k evenly spaced positions of a run of n that begins at ``start``, ends included."""
    top = F.greatest(F.least(k, n), F.lit(1))
    step = lambda i: (start + F.bround(i * (n - 1) / F.greatest(top - 1, F.lit(1)))).cast("int")
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), top - 1), step)))


def safe_name_part(name: Column, default: str = "Document", limit: int = 60) -> Column:
    """A file-name fragment of ASCII letters, digits, underscore and hyphen."""
    base = F.regexp_replace(F.regexp_extract(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "([^/]*)$", 1), r"(?i)\.pdf$", "")
    clean = F.regexp_replace(base, "[^A-Za-z0-9_-]+", "_")
    edges = F.regexp_replace(F.regexp_replace(clean, "^[_-]+|[_-]+$", ""), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(edges, 1, limit), "^[_-]+|[_-]+$", ""), F.lit("")), F.lit(default))


def file_name(path: Column, limit: int = 200) -> Column:
    return F.substring(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "([^/]*)$", 1), 1, limit)


def is_id(value: Column) -> Column:
    return value.rlike("^[a-f0-9]{32}$")


def volume_id(value: Column) -> tuple[Column, Column]:
    """Job and number of a volume id; null where it is none."""
    pattern = r"^([a-f0-9]{32})-(\d{1,4})$"
    ok = value.rlike(pattern)
    return F.when(ok, F.regexp_extract(value, pattern, 1)), F.when(ok, F.regexp_extract(value, pattern, 2).cast("int"))


def new_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def clamp(value: Column, low: Column | int, high: Column | int) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(as_col(low), F.least(as_col(high), value))


def short_list(values: Column, limit: int = 12) -> Column:
    """The first items joined, and how many more there are."""
    shown = F.array_join(F.slice(values, 1, limit), ", ")
    return F.when(F.size(values) > limit, F.concat(shown, F.lit(" … (+"), (F.size(values) - limit).cast("string"), F.lit(" more)"))).otherwise(shown)


def page_fingerprint(text: Column) -> Column:
    """The first 16 hex digits of the SHA-1 of a text without white space."""
    return F.substring(F.sha1(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")), 1, 16)


def fingerprint(width: Column, height: Column, text: Column) -> Column:
    """What is compared of a page: its measures to one place, halves to even, and its text's fingerprint."""
    return F.struct(F.bround(width, 1).alias("w"), F.bround(height, 1).alias("h"), page_fingerprint(text).alias("t"))


def has_magic(content: Column) -> Column:
    """Whether a file's first 1024 bytes hold the PDF mark."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def volume_file_name(client: Column, number: Column, total: Column) -> Column:
    width = F.when(total > 99, 3).otherwise(2)
    return F.concat(safe_name_part(client), F.lit("_Audit_Report_Volume_"), F.lpad(number.cast("string"), width, F.lit("0")), F.lit(".pdf"))
