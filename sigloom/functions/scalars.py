"""Scalar functions on text, numbers and flags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a flag that is set or not, and as an empty segment.
TRUE_WORDS = ("true", "1", "yes", "y", "valid")
REPORT_TRUE_WORDS = ("true", "1", "yes", "valid")
FALSE_WORDS = ("false", "0", "no", "bad", "invalid", "0.0")
EMPTY_SEGMENTS = ("", "nan", "NaN", "None", "none", "null", "Null")
FULL_SEGMENTS = ("record", "full_record", "whole", "all")


def to_number(c: Column) -> Column:
    """As double; NULL where it is no number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def decimal_number(c: Column) -> Column:
    """Like to_number, with a comma or a point before the decimals."""
    return to_number(F.replace(F.trim(c), F.lit(","), F.lit(".")))


def flag(c: Column) -> Column:
    """Whether a flag of any type is set; never NULL."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def report_flag(c: Column) -> Column:
    """The stricter rule of reports: no blanks around the word, and no `y`."""
    return F.coalesce(F.lower(c.cast("string")).isin(*REPORT_TRUE_WORDS), F.lit(False))


def is_false(c: Column) -> Column:
    """Whether a flag of any type is there and says no."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*FALSE_WORDS), F.lit(False))


def segment_name(label: Column, window: Column) -> Column:
    """A name for files: window_07 for a numbered window, else the label with all but letters and digits as `_`."""
    return F.when(window.isNotNull(), F.format_string("window_%02d", window.cast("int"))).otherwise(F.regexp_replace(label, r"[^\p{L}\p{N}]", "_"))


def normal_segment(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(s.isNull() | s.isin(*EMPTY_SEGMENTS) | s.isin(*FULL_SEGMENTS), F.lit("full")).otherwise(s)


def normal_record(c: Column) -> Column:
    return F.replace(F.trim(c.cast("string")), F.lit(".csv"), F.lit(""))


def half_even(c: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.rint(c)


def sniff_numeric(df: DataFrame, skip: tuple[str, ...] = (), min_ratio: float = 0.7, max_colons: float = 0.3) -> list[str]:
    """The text columns that hold numbers: one pass of counts over all columns, one row to the driver."""
    text = [c for c, kind in df.dtypes if kind == "string" and c not in skip]
    if not text:
        return []
    asked = []
    for k, name in enumerate(text):
        s = F.trim(F.col(f"`{name}`"))
        full = s.isNotNull() & (s != "")
        asked += [
            F.count(F.when(full, 1)).alias(f"n{k}"),
            F.count(F.when(full & decimal_number(s).isNotNull(), 1)).alias(f"p{k}"),
            F.count(F.when(full & s.contains(":"), 1)).alias(f"c{k}"),
        ]
    got = df.agg(*asked).first()
    return [name for k, name in enumerate(text) if got[f"n{k}"] and got[f"c{k}"] <= max_colons * got[f"n{k}"] and got[f"p{k}"] >= min_ratio * got[f"n{k}"]]


def with_numbers(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """df with the columns found by sniff_numeric() as doubles."""
    found = set(sniff_numeric(df, skip))
    return df.select(*[decimal_number(F.col(f"`{c}`")).alias(c) if c in found else F.col(f"`{c}`") for c in df.columns])


_SUSPICIOUS = re.compile(r"unnamed|nan|none|\s", re.I)


def suspicious_names(columns: list[str]) -> list[str]:
    return [c for c in columns if _SUSPICIOUS.search(c)]
