"""The 46 model features, one column expression each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vocab
from ..functions.phrases import phrase_bits, place_of
from ..schema import UNKNOWN


def plain_texts(patterns: Mapping[str, str], needs: Mapping[str, Sequence[str]]) -> tuple[str, ...]:
    """The plain texts that decide the patterns or whether their regexes are tried."""
    return tuple(dict.fromkeys(w for name, p in patterns.items() for w in (*C.split_pattern(p)[0], *needs.get(name, ()))))


#: Searched column -> patterns and the words without which their regexes cannot match.
SEARCHED = {"summary": (vocab.SUMMARY_PATTERNS, vocab.PHRASE_NEEDS), "aircraft_type": (vocab.AIRCRAFT_PATTERNS, {})}
PLAIN = {c: plain_texts(*how) for c, how in SEARCHED.items()}


def lowered(df: DataFrame) -> DataFrame:
    """Lower-case the searched texts once, before many patterns read them.

    The plain texts of a column's patterns are looked for together, in one pass over its
    bytes. Written out as tests of their own they are slower, and make a generated method
    too long for the JVM to compile.
    """
    have = set(df.columns)
    texts = df.select("*", *[
        (F.lower(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")).alias(f"_{c}_lower") for c in SEARCHED
    ])
    return texts.select("*", *[
        (phrase_bits(F.col(f"_{c}_lower"), PLAIN[c]) if c in have else F.lit(0).cast("long")).alias(f"_{c}_found") for c in SEARCHED
    ])


def feature_columns(df: DataFrame) -> dict[str, Column]:
    """Feature name -> expression over ``lowered(df)``. Columns the input lacks behave like nulls."""
    have = set(df.columns)

    def source(name: str, kind: str) -> Column:
        return F.col(name).try_cast(kind) if name in have else F.lit(None).cast(kind)

    year, aboard = source("year", "double"), source("aboard", "double")
    ground = F.coalesce(source("ground", "double"), F.lit(0.0))
    operator = source("operator", "string")
    category = C.operator_category(operator)
    if "operator_category" in have:
        category = F.coalesce(F.col("operator_category"), category)
    summary = F.coalesce(source("summary", "string"), F.lit(""))
    cause = F.coalesce(source("extracted_cause_category", "string"), F.lit(UNKNOWN))
    phase = F.coalesce(source("extracted_phase_of_flight", "string"), F.lit(UNKNOWN))
    people = F.coalesce(aboard, F.lit(0.0))

    out: dict[str, Column] = {
        "year": year,
        "aboard": aboard,
        "log_aboard": F.log1p(people),
        "ground": ground,
        "ground_flag": C.flag(ground > 0),
        "cluster_id": F.coalesce(source("cluster_id", "double"), F.lit(-1.0)),
        "decade": (F.floor(year / 10) * 10).cast("double"),
        "month": C.month_of(source("date", "string")).cast("double"),
        "has_route": C.flag(C.strip(F.coalesce(source("route", "string"), F.lit(""))) != ""),
        "is_military": C.flag(category == "Military"),
        "is_private": C.flag(category == "Private"),
        "has_summary": C.flag(summary != ""),
        "aircraft_era": C.era_bin(year),
        "aboard_severity_bin": C.aboard_bin(F.coalesce(aboard, F.lit(1.0))),
        "is_solo": C.flag(people == 1.0),
    }
    def searched(column: str) -> dict[str, Column]:
        text, found = F.col(f"_{column}_lower"), F.col(f"_{column}_found")
        patterns, needs = SEARCHED[column]
        places = place_of(PLAIN[column])
        return {name: C.flag(C.matches_found(text, found, places, p, needs.get(name, ()))) for name, p in patterns.items()}

    out |= searched("aircraft_type")
    for value in vocab.CAUSE_FEATURES:
        out["cause_" + value.lower().replace(" ", "_")] = C.flag(C.first_value(cause) == value)
    for value in vocab.PHASE_FEATURES:
        out["phase_" + value.lower()] = C.flag(C.first_value(phase) == value)
    out |= searched("summary")
    out["has_cause_extracted"] = C.flag(cause != UNKNOWN)
    out["has_phase_extracted"] = C.flag(phase != UNKNOWN)
    return out


def build_features(df: DataFrame, *keep: str) -> DataFrame:
    """The feature table, after the kept columns.

    The phrase flags are evaluated once and then reused by the death signal, so
    every pattern reads the text a single time.
    """
    df = lowered(df)
    flags = feature_columns(df)
    signal = sum(
        (F.col(f"f_{name}") * weight for name, weight in vocab.DEATH_SIGNAL_WEIGHTS.items()), F.lit(0.0)
    )
    first = df.select(*keep, *[c.alias(f"f_{name}") for name, c in flags.items()])
    # Prefixed until the end: a kept column may carry the name of a feature.
    return first.select(
        *keep,
        *[
            (F.greatest(signal, F.lit(0.0)) if name == "death_signal_score" else F.col(f"f_{name}"))
            .alias(name if name not in keep else f"f_{name}")
            for name in vocab.MODEL_FEATURES
        ],
    )
