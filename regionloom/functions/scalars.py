"""Scalar column functions: coercion, text rules, dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Date layouts with the shape of a text that may have them, tried in this order.
DATE_FORMATS = {
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$",
    "yyyy/MM/dd": r"^\d{4}/\d{2}/\d{2}$",
    "MM/dd/yyyy HH:mm:ss": r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}$",
    "MM/dd/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "yyyyMMdd": r"^\d{8}$",
}


def as_col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def to_numeric(c) -> Column:
    """Double, or NULL for anything that is not a number (NaN too)."""
    return known(as_col(c).try_cast("double"))


def known(c) -> Column:
    """A number, with NaN as NULL."""
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def blank_to_null(c) -> Column:
    """Trimmed text with the empty string as NULL."""
    return F.nullif(F.trim(as_col(c).cast("string")), F.lit(""))


def to_time(c, formats=DATE_FORMATS) -> Column:
    """Timestamp from text by the layout whose shape it has, else by Spark's own reading, else NULL.

    The shape is tested first: a parser that fails on every row is slow.
    """
    text = blank_to_null(c)
    other = F.when(text.rlike("^[0-9]"), text.try_cast("timestamp"))
    for layout, shape in reversed(formats.items()):
        other = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))).otherwise(other)
    return other


def epoch_seconds(c) -> Column:
    return F.unix_timestamp(as_col(c))


def to_year(c) -> Column:
    """Whole year from messy text such as ``2021.0``."""
    return to_numeric(c).try_cast("int")


def days_between(start, end) -> Column:
    """Whole days, rounded down."""
    return F.floor((F.unix_timestamp(as_col(end)) - F.unix_timestamp(as_col(start))) / 86400).cast("bigint")


def iso_date(c) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd")


def round_half_even(c, digits: int) -> Column:
    return F.bround(as_col(c), digits)


def at_least(c, floor: float) -> Column:
    return F.greatest(as_col(c), F.lit(floor))


def currency(c) -> Column:
    """``$1,234.50`` as a double."""
    return known(F.regexp_replace(F.trim(as_col(c).cast("string")), "[$,]", "").try_cast("double"))


def looks_numeric(c) -> Column:
    """True when the text is digits after dropping one dot and one minus, wherever they stand."""
    return as_col(c).cast("string").rlike(r"^(?=.*[0-9])([0-9]*\.?[0-9]*-?[0-9]*|[0-9]*-?[0-9]*\.?[0-9]*)$")


def title_label(c, names: dict[str, str] | None = None) -> Column:
    """Display name of a key: the given name, else words in title case."""
    c = as_col(c)
    fallback = F.initcap(F.translate(c, "_", " "))
    if not names:
        return fallback
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), fallback)


# Unit endings of column names.
UNIT_SUFFIXES = ("ft", "m", "in", "cm", "km", "mi", "ft2", "ft3", "m2", "m3")


def unit_suffix(c) -> Column:
    """Unit at the end of a column name, lower case, or NULL."""
    pattern = "(?i)_(" + "|".join(UNIT_SUFFIXES) + ")$"
    return F.nullif(F.lower(F.regexp_extract(as_col(c), pattern, 1)), F.lit(""))


# Size of one unit in the base unit of its dimension (m, m2, m3).
UNIT_FACTORS = {
    "m": ("length", 1.0),
    "ft": ("length", 0.3048),
    "in": ("length", 0.0254),
    "cm": ("length", 0.01),
    "km": ("length", 1000.0),
    "mi": ("length", 1609.344),
    "m2": ("area", 1.0),
    "ft2": ("area", 0.09290304),
    "m3": ("volume", 1.0),
    "ft3": ("volume", 0.028316846592),
}


def convert_unit(c, source: str, target: str) -> Column:
    """Value of ``c`` carried from one unit to another of the same dimension."""
    kind_a, a = UNIT_FACTORS[source]
    kind_b, b = UNIT_FACTORS[target]
    if kind_a != kind_b:
        raise ValueError(f"{source} and {target} measure different things")
    return as_col(c) * (a / b)


def entropy(probabilities) -> Column:
    """-sum p log(p + 1e-9) of an array of probabilities."""
    return F.aggregate(as_col(probabilities), F.lit(0.0), lambda acc, p: acc - p * F.log(p + F.lit(1e-9)))


def header_row_map(payload) -> Column:
    """Two arrays (names, values) to a map."""
    payload = as_col(payload)
    return F.map_from_arrays(F.get(payload, F.lit(0)), F.get(payload, F.lit(1)))
