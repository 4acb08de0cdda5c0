"""Column helpers for text, rounding and dates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def title_case(text: Column | str) -> Column:
    """Trim and capitalise every word; a hyphen starts a word too (``non-binary`` -> ``Non-Binary``)."""
    return F.array_join(F.transform(F.split(F.trim(_col(text)), "-"), F.initcap), "-")


def is_all_upper(text: Column | str) -> Column:
    c = _col(text)
    return (c == F.upper(c)) & (c != F.lower(c))


def is_all_lower(text: Column | str) -> Column:
    c = _col(text)
    return (c == F.lower(c)) & (c != F.upper(c))


def dec_round(x: Column | str, digits: int = 2) -> Column:
    """Round half-up on a fixed-point value, so the result does not hang on the last bit of a double."""
    return F.round(_col(x).cast("decimal(28,8)"), digits).cast("double")


def ratio(part: Column | str, whole: Column | str) -> Column:
    """Double division that is NULL, not an error, on a zero divisor."""
    return F.try_divide(_col(part).cast("double"), _col(whole).cast("double"))


def pct(part: Column | str, whole: Column | str, digits: int = 2) -> Column:
    return dec_round(F.try_divide(F.lit(100.0) * _col(part).cast("double"), _col(whole).cast("double")), digits)


def safe_divide(part: Column | str, whole: Column | str) -> Column:
    """BI-style division: 0 on a zero or missing divisor."""
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def month_label(d: Column | str) -> Column:
    return F.date_format(_col(d), "yyyy-MM")


def month_start(d: Column | str) -> Column:
    return F.trunc(_col(d), "month")
