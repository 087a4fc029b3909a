"""Correlations, contingency tables and tests of independence."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

CORRELATED = ("aboard", "fatalities", "ground", "year", "fatality_rate", "survival_count")
PAIRWISE = ("fatalities", "aboard", "year")

#: Parts that the cells of one key are dealt to.
SALTS = 32


def correlation_matrix(df: DataFrame, cols: Sequence[str] = CORRELATED, complete: bool = True) -> DataFrame:
    """Pearson r of every column pair as rows (var1, var2, r), from one aggregate.

    ``complete`` uses rows without any null in ``cols``; otherwise each pair uses
    the rows where both are present.
    """
    if "survival_count" in cols and "survival_count" not in df.columns:
        df = df.withColumn("survival_count", F.col("aboard") - F.col("fatalities"))
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    if complete:
        values = values.na.drop(subset=list(cols))
    pairs = list(combinations(cols, 2))

    def both(x: str, y: str):
        if complete:
            return F.col(x), F.col(y)
        present = F.col(x).isNotNull() & F.col(y).isNotNull()
        return F.when(present, F.col(x)), F.when(present, F.col(y))

    row = values.agg(
        *[F.corr(*both(a, b)).alias(f"{a}|{b}") for a, b in pairs],
        *[F.when(F.max(c) > F.min(c), F.lit(1.0)).alias(f"{c}|{c}") for c in cols],
    )
    cells = [
        F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                 F.round(F.col(f"{a}|{b}" if (a, b) in pairs or a == b else f"{b}|{a}"), 4).alias("r"))
        for a in cols for b in cols
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.var1", "c.var2", "c.r")


def correlation_insights(matrix: DataFrame, cols: Sequence[str] = CORRELATED) -> DataFrame:
    """Pairs with |r| > 0.1, strongest first."""
    at = {c: F.lit(i) for i, c in enumerate(cols)}
    position = F.create_map(*[x for c, i in at.items() for x in (F.lit(c), i)])
    size = F.abs("r")
    return (
        matrix.where((position[F.col("var1")] < position[F.col("var2")]) & (size > 0.1))
        .select(
            "var1", "var2", "r",
            F.when(size > 0.7, "strong").when(size > 0.4, "moderate").otherwise("weak").alias("strength"),
            F.when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"),
        )
        .orderBy(size.desc(), "var1", "var2")
    )


def contingency(df: DataFrame, row: str, column: str, weight: str | None = None) -> DataFrame:
    """Counts per value pair in long form; rows with a null key are left out.

    ``weight`` names a count column of rows that are already aggregated.
    """
    n = F.count("*") if weight is None else F.sum(weight)
    return (
        df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(F.col(row).cast("string").alias("row_key"), F.col(column).cast("string").alias("col_key"))
        .agg(n.alias("n"))
    )


def with_margin(cells: DataFrame, key: str, other: str, name: str) -> DataFrame:
    """Add the sum of n over equal ``key``, summed apart and joined by key and salt.

    A key that most cells have (a severity among many operators) is so dealt to ``SALTS`` tasks.
    """
    margin = cells.groupBy(key).agg(F.sum("n").alias(name)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cells.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).join(margin, [key, "_salt"]).drop("_salt")


def _chi2_tail(chi2: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for a whole number of degrees of freedom.

    A finite sum: Poisson terms for an even number, half-step terms beside erfc for an odd one.
    """
    if dof <= 0 or chi2 <= 0:
        return 1.0
    half, step = chi2 / 2.0, 0.5 * (dof % 2)
    powers = [i + step for i in range(dof // 2)]
    terms = [math.exp(q * math.log(half) - half - math.lgamma(q + 1.0)) for q in powers]
    return min(1.0, math.fsum(terms) + (math.erfc(math.sqrt(half)) if dof % 2 else 0.0))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(x) or pd.isna(k) else _chi2_tail(float(x), int(k)) for x, k in zip(chi2, dof)
    ])


def chi_square(
    df: DataFrame, row: str, column: str, name: str | None = None, weight: str | None = None
) -> DataFrame:
    """Test of independence for two columns as one row.

    Only cells that occur are stored. A missing cell adds exactly its expected
    count, and the expected counts of all cells add up to the total, so the
    statistic needs no full grid. With one degree of freedom the continuity
    correction is applied, which moves every cell by the same amount.
    """
    cells = contingency(df, row, column, weight)
    marked = with_margin(with_margin(cells, "row_key", "col_key", "row_n"), "col_key", "row_key", "col_n")
    total = cells.agg(F.sum("n")).scalar()
    expected = F.col("row_n") * F.col("col_n") / total
    gap = F.abs(F.col("n") - F.col("e"))
    sums = marked.withColumn("e", expected).agg(
        F.sum(gap * gap / F.col("e")).alias("plain"),
        F.sum("e").alias("seen"), F.sum("n").alias("total"),
        F.max(gap).alias("gap"),
        F.countDistinct("row_key").alias("r"), F.countDistinct("col_key").alias("c"),
        F.min("row_n").alias("row_n"), F.min("col_n").alias("col_n"),
    )
    dof = ((F.col("r") - 1) * (F.col("c") - 1)).cast("bigint")
    # In a 2x2 table every cell is off by the same gap; sum(1/e) follows from the margins.
    total_d = F.col("total").cast("double")
    inverse = F.try_divide(
        total_d * total_d * total_d,
        F.col("row_n") * (total_d - F.col("row_n")) * F.col("col_n") * (total_d - F.col("col_n")),
    )
    moved = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    chi2 = (
        F.when(dof == 0, F.lit(0.0))
        .when(dof == 1, moved * moved * inverse)
        .otherwise(F.col("plain") + (F.col("total") - F.col("seen")))
    )
    tested = sums.where(F.col("total") > 0).select(chi2.alias("raw"), dof.alias("dof"))
    p = chi2_p_value(F.col("raw"), F.col("dof"))
    verdict = F.when(F.col("p") < 0.05, "Significant").otherwise("No significant")
    return tested.withColumn("p", p).select(
        F.lit(name or f"{row} vs {column}").alias("test"),
        F.round("raw", 4).alias("chi2"), F.round("p", 6).alias("p_value"), "dof",
        (F.col("p") < 0.05).alias("significant"),
        F.format_string(f"%s association between {row} and {column} (p=%.4f)", verdict, F.col("p"))
        .alias("interpretation"),
    )


def top_operator_rows(df: DataFrame, n: int = 10, weight: str | None = None) -> DataFrame:
    """Rows of the ``n`` most frequent operators (at most ``n`` keys are matched)."""
    count = F.count("*") if weight is None else F.sum(weight)
    top = (
        df.where(F.col("operator").isNotNull()).groupBy("operator").agg(count.alias("count"))
        .orderBy(F.col("count").desc(), "operator").limit(n).select("operator")
    )
    return df.join(top, "operator", "left_semi")


def chi_square_suite(df: DataFrame) -> DataFrame:
    """Severity against operator category, decade and the ten most frequent operators.

    The table is scanned once and counted per (severity, operator, decade); all
    tests work on those counts.
    """
    decade = C.decade_label(F.col("year")).alias("decade")
    counts = (
        df.where(F.col("severity_label").isNotNull()).groupBy("severity_label", "operator", decade)
        .agg(F.count("*").alias("k"))
        .withColumn("operator_category", C.operator_category(F.col("operator"), "short"))
    )
    top = top_operator_rows(counts, weight="k")
    return (
        chi_square(counts, "severity_label", "operator_category", "Severity vs Operator Category", "k")
        .unionByName(chi_square(counts, "severity_label", "decade", "Severity vs Decade", "k"))
        .unionByName(chi_square(top, "severity_label", "operator", "Severity vs Top 10 Operators", "k"))
    )


def chi_square_decade(df: DataFrame) -> DataFrame:
    """The severity by decade test alone, as figures without a sentence."""
    rows = df.select("severity_label", C.decade_label(F.col("year")).alias("decade"))
    return chi_square(rows, "severity_label", "decade", "severity_vs_decade").select(
        "test", "chi2", "p_value", F.col("dof").alias("degrees_of_freedom"), "significant"
    )
