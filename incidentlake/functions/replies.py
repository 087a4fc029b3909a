"""Reading model replies: JSON recovery, value normalisation, list cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .columns import strip

_NO_STRINGS = "array<string>"


def strict_json(c: Column) -> Column:
    """The text as one JSON value; null when it is none or when anything follows the value.

    The parser stops after the first value, so the text is read as the first of
    two list items: leftovers then break the list or change its length.
    """
    items = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), c, F.lit(', "end"]'))), "$", "array<variant>"
    )
    return F.when(F.size(items) == 2, F.get(items, F.lit(0)))


def reply_json(raw: Column) -> Column:
    """The reply as a JSON value: as it is, without a code fence, or between the outermost braces.

    Null when none of the three can be read.
    """
    unfenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[strict_json(c) for c in (raw, unfenced, braces)])


def field(reply: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(reply, f"$.{name}", kind)


def _first_valid(c: Column, valid: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """First comma- or bar-separated part that is a known value, else ``Unknown``."""
    parts = F.transform(F.split(c, r"[,|]"), lambda x: F.initcap(strip(x)))
    if aliases:
        names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        parts = F.transform(parts, lambda x: F.coalesce(names[x], x))
    known = F.filter(parts, lambda x: x.isin(*valid))
    return F.coalesce(F.get(known, F.lit(0)), F.lit("Unknown"))


def normal_cause(c: Column) -> Column:
    return _first_valid(c, vocab.CAUSES, vocab.CAUSE_ALIASES)


def normal_phase(c: Column) -> Column:
    return _first_valid(c, vocab.PHASES)


def clean_list(items: Column, cap: int | None) -> Column:
    """Drop missing and empty items, strip the rest, keep the first ``cap`` (all if null); no list gives none."""
    kept = F.transform(F.filter(items, lambda x: x.isNotNull() & (x != "")), lambda x: strip(x))
    return F.coalesce(kept if cap is None else F.slice(kept, 1, cap), F.array().cast(_NO_STRINGS))


def clean_text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def _split_trimmed(c: Column, separator: str) -> Column:
    parts = F.transform(F.split(c, separator), lambda x: strip(x))
    return F.filter(parts, lambda x: x != "")


def factor_list(c: Column) -> Column:
    """A stored factor field as a list.

    JSON list, JSON scalar (one element), lines, comma-separated, or one value;
    missing, empty and JSON null give no element.
    """
    parsed = strict_json(c)
    return (
        F.when(c.isNull() | F.is_variant_null(parsed) | (c == ""), F.array().cast(_NO_STRINGS))
        .when(F.try_variant_get(parsed, "$", "array<variant>").isNotNull(),
              F.try_variant_get(parsed, "$", _NO_STRINGS))
        .when(parsed.isNotNull(), F.array(F.try_variant_get(parsed, "$", "string")))
        .when(c.contains("\n"), _split_trimmed(c, r"\r?\n"))
        .when(c.contains(","), _split_trimmed(c, ","))
        .otherwise(F.array(c))
    )


def json_strings(c: Column) -> Column:
    """A JSON list of strings; anything else gives an empty list."""
    return F.coalesce(
        F.try_variant_get(strict_json(c), "$", _NO_STRINGS), F.array().cast(_NO_STRINGS)
    )
