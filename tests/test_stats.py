import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from incidentlake import (
    chi_square,
    chi_square_suite,
    correlation_insights,
    correlation_matrix,
    decade_trends,
    overview_all,
    severity_distribution,
    top_groups,
    top_groups_share,
    yearly_trends,
)
from incidentlake.operators.stats import _chi2_tail


def table(spark, counts):
    rows = [(f"r{i}", f"c{j}") for i, row in enumerate(counts) for j, n in enumerate(row) for _ in range(n)]
    return spark.createDataFrame(rows, "a string, b string")


def test_tail_values():
    # Table values of the distribution.
    assert _chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert _chi2_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert _chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert _chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert _chi2_tail(0.0, 4) == 1.0 and _chi2_tail(5.0, 0) == 1.0
    assert 0.0 <= _chi2_tail(50_000.0, 40) < 1e-300


def test_two_by_two_is_corrected(spark):
    got = chi_square(table(spark, [[10, 20], [30, 5]]), "a", "b").first()
    e = [30 * 40 / 65, 30 * 25 / 65, 35 * 40 / 65, 35 * 25 / 65]
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip([10, 20, 30, 5], e))
    assert got["chi2"] == pytest.approx(want, abs=1e-4) and got["dof"] == 1 and got["significant"]
    assert got["p_value"] == pytest.approx(math.erfc(math.sqrt(want / 2)), abs=1e-6)


def test_small_gaps_are_not_overcorrected(spark):
    got = chi_square(table(spark, [[10, 10], [10, 11]]), "a", "b").first()
    assert got["chi2"] == 0.0 and got["p_value"] == 1.0 and not got["significant"]


def test_missing_cells_count(spark):
    counts = [[5, 0, 7], [0, 9, 2]]
    got = chi_square(table(spark, counts), "a", "b").first()
    o = np.array(counts, float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    assert got["chi2"] == pytest.approx(((o - e) ** 2 / e).sum(), abs=1e-4) and got["dof"] == 2


def test_one_value_gives_no_evidence(spark):
    got = chi_square(table(spark, [[5, 6, 7]]), "a", "b").first()
    assert (got["chi2"], got["dof"], got["p_value"]) == (0.0, 0, 1.0)


def test_agrees_with_the_library_beyond_one_degree(spark):
    df = table(spark, [[12, 5, 9], [3, 14, 6], [8, 8, 2]])
    got = chi_square(df, "a", "b").first()
    rows = [(float(r["a"][1:]), Vectors.dense(float(r["b"][1:]))) for r in df.collect()]
    ref = ChiSquareTest.test(spark.createDataFrame(rows, ["label", "features"]), "features", "label").first()
    assert got["chi2"] == pytest.approx(ref["statistics"][0], abs=1e-4)
    assert got["p_value"] == pytest.approx(ref["pValues"][0], abs=1e-6)


def test_suite_rows(spark):
    rows = [("Fatal" if i % 3 else "Minor", f"Op {i % 14}", 1950 + i % 40) for i in range(300)]
    got = chi_square_suite(spark.createDataFrame(rows, "severity_label string, operator string, year int"))
    names = [r["test"] for r in got.collect()]
    assert len(names) == 3 and names[2] == "Severity vs Top 10 Operators"


def test_correlations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    x[:, 1] += 2 * x[:, 0]
    rows = [(float(a), float(b), None if i % 10 == 0 else float(c)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    cols = ("a", "b", "c")
    full = {(r["var1"], r["var2"]): r["r"] for r in correlation_matrix(df, cols).collect()}
    kept = x[[i for i in range(200) if i % 10]]
    assert full[("a", "b")] == pytest.approx(np.corrcoef(kept[:, 0], kept[:, 1])[0, 1], abs=1e-4)
    pair = {(r["var1"], r["var2"]): r["r"] for r in correlation_matrix(df, cols, complete=False).collect()}
    assert pair[("b", "a")] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1], abs=1e-4)
    assert len(full) == 9 and full[("c", "c")] == 1.0
    insight = correlation_insights(correlation_matrix(df, cols), cols).first()
    assert (insight["var1"], insight["var2"], insight["strength"], insight["direction"]) == ("a", "b", "strong", "positive")


def test_trailing_mean_counts_rows_not_years(spark):
    years = [2000] * 4 + [2001] * 2 + [2010] * 6
    df = spark.createDataFrame([(y, 1.0, 2.0) for y in years], "year int, fatalities double, aboard double")
    assert [r["rolling_avg_incidents"] for r in yearly_trends(df).collect()] == [4.0, 3.0, 4.0]


def test_ties_are_broken_by_name(spark):
    df = spark.createDataFrame([(n, 1.0, 2.0) for n in "gfedcba" * 2], "operator string, fatalities double, aboard double")
    assert [r["operator"] for r in top_groups(df, "operator", 5).collect()] == list("abcde")
    with pytest.raises(ValueError):
        top_groups(df, "operator", 4)
    zero = df.withColumn("aboard", F.lit(0.0))
    assert {r["fatality_rate"] for r in top_groups(zero, "operator", 5).collect()} == {0.0}


def test_narrow_tables_give_defaults(spark):
    df = spark.createDataFrame([("A",), ("A",), ("B",)], "airline string")
    row = overview_all(df).first()
    assert (row["total_incidents"], row["total_fatalities"], row["overall_fatality_rate_ratio"], row["year_min"]) == (3, 0, 0.0, None)
    assert row["severity_distribution"] == {} and row["unique_operators"] == 0
    assert yearly_trends(df).count() == 0 and decade_trends(df).count() == 0
    assert severity_distribution(df, None).count() == 0
    assert [tuple(r) for r in top_groups_share(df, "operator").collect()] == [("A", 2, 66.7, 0), ("B", 1, 33.3, 0)]
