"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import INCIDENT_SCHEMA, UNKNOWN
from . import vocab

_PLAIN = re.compile(r"[a-z0-9 -]+")


def with_fields(df: DataFrame, *names: str) -> DataFrame:
    """Add absent incident fields as typed nulls, so that a narrower table gives defaults instead of errors."""
    missing = [f for f in INCIDENT_SCHEMA.fields if f.name in names and f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing]) if missing else df


def first_present(df: DataFrame, *names: str) -> str:
    """The first of the names that is a column; the first name when none is."""
    return next((n for n in names if n in df.columns), names[0])


#: White space as text tools outside SQL strip it.
WHITE_SPACE = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column | str) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def as_double(c: Column) -> Column:
    """Finite number or null; text that is no number, and infinities, become null."""
    number = c.try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def as_date(c: Column) -> Column:
    """ISO date or month/day/year date; anything else becomes null."""
    text = strip(c.cast("string"))
    us_date = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_timestamp(text, F.lit("M/d/yyyy")))
    return F.coalesce(text.try_cast("date"), us_date.cast("date"))


def year_of(c: Column) -> Column:
    """Year of a date text, else the first four digits in a row."""
    digits = F.nullif(F.regexp_extract(c.cast("string"), r"(\d{4})", 1), F.lit(""))
    return F.coalesce(F.year(as_date(c)), digits.cast("int"))


def month_of(c: Column, default: int = 6) -> Column:
    return F.coalesce(F.month(as_date(c)), F.lit(default))


def fatality_rate(fatalities: Column, aboard: Column) -> Column:
    """Not clipped: reports can name more victims than people aboard."""
    return F.when(aboard > 0, fatalities / aboard)


def severity_label(rate: Column, fatalities: Column, thresholds: Sequence[float] = (0.10, 0.50)) -> Column:
    low, high = thresholds
    return (
        F.when(rate.isNull(), F.lit(UNKNOWN))
        .when(fatalities == 0, "Minor")
        .when(rate < low, "Moderate")
        .when(rate < high, "Severe")
        .otherwise("Fatal")
    )


def decade_of(year: Column) -> Column:
    return year - year % 10


def decade_label(year: Column) -> Column:
    return F.concat(decade_of(year).cast("string"), F.lit("s"))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Case-insensitive: does the text hold one of the words?"""
    pattern = "|".join(re.escape(w).replace(r"\ ", " ") for w in words)
    return F.coalesce(F.lower(c).rlike(pattern), F.lit(False))


def operator_category(c: Column, preset: str = "full") -> Column:
    military, private = vocab.OPERATOR_WORDS[preset]
    return (
        F.when(contains_any(c, military), "Military")
        .when(contains_any(c, private), "Private")
        .otherwise("Commercial")
    )


def split_pattern(pattern: str) -> tuple[list[str], list[str]]:
    """The alternatives without any pattern syntax, and the others."""
    parts = pattern.split("|") if "(" not in pattern else [pattern]
    plain = [p for p in parts if _PLAIN.fullmatch(p)]
    return plain, [p for p in parts if p not in plain]


def matches_found(lowered: Column, bits: Column, places: Mapping[str, int], pattern: str, needs: Sequence[str] = ()) -> Column:
    """``matches`` where ``bits`` already say which of the plain texts in ``places`` occur."""
    plain, rest = split_pattern(pattern)

    def any_of(words: Sequence[str]) -> Column:
        return bits.bitwiseAND(F.lit(sum(places[w] for w in set(words))).cast("long")) != 0

    tests = [any_of(plain)] if plain else []
    if rest:
        regex = lowered.rlike("(?dU)" + "|".join(rest))
        tests.append(any_of(needs) & regex if needs else regex)
    return F.coalesce(reduce(or_, tests), F.lit(False))


def matches(lowered: Column, pattern: str, needs: Sequence[str] = ()) -> Column:
    """Search a pattern in lower-cased text; null counts as no match.

    Alternatives without any pattern syntax are plain substring tests, which are
    far cheaper than a regex on long texts. In the rest the flags make ``.`` stop
    at ``\\n`` only and let ``\\d`` and ``\\b`` cover Unicode; the regex is tried only
    where one of ``needs`` occurs, the words without which it cannot match.
    """
    plain, rest = split_pattern(pattern)
    tests = [lowered.contains(p) for p in plain]
    if rest:
        regex = lowered.rlike("(?dU)" + "|".join(rest))
        tests.append(reduce(or_, [lowered.contains(w) for w in needs]) & regex if needs else regex)
    return F.coalesce(reduce(or_, tests), F.lit(False))


def first_value(c: Column) -> Column:
    """Part before the first ``|``, trimmed; single values stay untouched."""
    return F.when(c.contains("|"), strip(F.substring_index(c, "|", 1))).otherwise(c)


def era_bin(year: Column) -> Column:
    return (
        F.when(year.isNull(), 2.0).when(year < 1940, 0.0).when(year < 1958, 1.0)
        .when(year < 1970, 2.0).when(year < 1990, 3.0).otherwise(4.0)
    )


def aboard_bin(aboard: Column) -> Column:
    """Right-closed bins (-1,4], (4,19], (19,99], (99,inf) -> 3, 2, 1, 0."""
    return (
        F.when(aboard <= -1, None).when(aboard <= 4, 3.0).when(aboard <= 19, 2.0)
        .when(aboard <= 99, 1.0).otherwise(0.0)
    )


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def or_text(c: Column, default: str) -> Column:
    """Default for null and for empty text."""
    return F.when(not_blank(c), c).otherwise(F.lit(default))


def total(c: Column) -> Column:
    """Sum with 0 instead of null for a group without values."""
    return F.coalesce(F.sum(c), F.lit(0.0))


def ratio_of_sums(top: Column, bottom: Column) -> Column:
    """Sum over sum, each over its own non-null rows; null when the bottom is 0."""
    return F.try_divide(F.sum(top), F.sum(bottom))


def percent_text(ratio: Column, digits: int = 1) -> Column:
    """``0.3125`` -> ``31.2%``, rounded on the exact binary value; meant for small result tables."""
    @F.pandas_udf(T.StringType())
    def render(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}%}")

    return render(ratio)
