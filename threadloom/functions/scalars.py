"""Numbers, tags, elapsed time and rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.ids import valid_timestamp


def optional_integer(c: Column | str) -> Column:
    """int64 of an optional sign and digits within blanks; null for null and ''. Bad text is null too, see bad_integer."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("bigint"))


def bad_integer(c: Column | str, negative_ok: bool = True) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    value = optional_integer(c)
    bad = c.isNotNull() & (c != "") & value.isNull()
    return bad if negative_ok else bad | F.coalesce(value < 0, F.lit(False))


def elapsed_microseconds(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


@F.pandas_udf(T.DoubleType())
def half_even_6(x: pd.Series) -> pd.Series:
    """Six decimals, halves of the binary value to even."""
    return x.map(lambda v: round(v, 6), na_action="ignore")


def elapsed_hours(later: Column, earlier: Column) -> Column:
    """Hours with six decimals; null unless later is not before earlier."""
    us = elapsed_microseconds(later, earlier)
    return half_even_6(F.when(us >= 0, us / F.lit(1_000_000.0) / F.lit(3600.0)))


def day(c: Column | str) -> Column:
    return F.to_date(valid_timestamp(c))


def tag_names(c: Column | str) -> Column:
    """All runs in angle brackets without inner brackets, as they stand."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("<([^<>]+)>"), F.lit(1))


def split_tags(c: Column | str, separator: str = ";") -> Column:
    """Trimmed, non-empty, distinct parts of a joined list."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda t: F.trim(t)), lambda t: t != ""))


def mismatch(platform: Column, own: Column) -> Column:
    """They differ; an unknown platform value never does."""
    return platform.isNotNull() & (platform != own)


def label_number(value: float) -> str:
    """Grouped without decimals from a thousand on, whole numbers plain, others with one decimal."""
    if abs(value) >= 1000:
        return f"{value:,.0f}"
    return f"{int(value)}" if float(value).is_integer() else f"{value:.1f}"


def number_label(c: Column | str) -> Column:
    """label_number() as an expression."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(F.abs(c) >= 1000, F.format_number(c, 0)).when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(F.format_number(c, 1))


def word_count(c: Column | str) -> Column:
    """Words of plain text in the JVM, by the rule of functions.html."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*(?![\p{L}\p{N}_])")).cast("bigint")
