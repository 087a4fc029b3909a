import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from incidentlake import (
    class_report,
    classification_metrics,
    confusion,
    confusion_from_json,
    importance_rows,
    label_index,
    metrics_full,
    metrics_history,
    metrics_summary,
    row_shares,
    rounded_report,
)
from incidentlake.schema import SEVERITY_INDEX

MATRIX = [[550, 25, 138, 90], [1, 5, 5, 0], [24, 11, 56, 15], [67, 4, 41, 17]]


@pytest.fixture(scope="module")
def cm(spark):
    rows = [(a, p, MATRIX[i][j]) for i, a in enumerate(SEVERITY_INDEX) for j, p in enumerate(SEVERITY_INDEX)]
    return spark.createDataFrame(rows, "actual string, predicted string, n long")


def test_known_matrix(cm):
    m = classification_metrics(cm).first()
    assert (m["accuracy"], m["precision_weighted"], m["recall_weighted"], m["f1_weighted"], m["test_samples"]) == (
        0.5987, 0.6977, 0.5987, 0.6340, 1049)
    got = {r["label"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in rounded_report(cm).collect()}
    assert got == {
        "Fatal": (0.8567, 0.6849, 0.7612, 803), "Minor": (0.1111, 0.4545, 0.1786, 11),
        "Moderate": (0.2333, 0.5283, 0.3237, 106), "Severe": (0.1393, 0.1318, 0.1355, 129),
    }


def test_against_the_library(spark, cm):
    rows = cm.where("n > 0").select(
        label_index(F.col("actual")).alias("label"), label_index(F.col("predicted")).alias("prediction"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))),
    )
    m = classification_metrics(cm).first()
    for name, ours in (("accuracy", "accuracy"), ("weightedPrecision", "precision_weighted"), ("f1", "f1_weighted")):
        assert MulticlassClassificationEvaluator(metricName=name).evaluate(rows) == pytest.approx(m[ours], abs=1e-4)


def test_missing_class(spark):
    df = spark.createDataFrame([("Fatal", "Fatal"), ("Fatal", "Severe"), ("Minor", "Fatal")], "a string, p string")
    cm = confusion(df, "a", "p")
    assert cm.count() == 16 and cm.agg(F.sum("n")).first()[0] == 3
    report = {r["label"]: r for r in class_report(cm).collect()}
    assert report["Moderate"]["precision"] == 0.0 and report["Moderate"]["support"] == 0
    # Mean F1 over the classes that occur: Fatal 1/2, Minor 0, Severe 0.
    assert classification_metrics(cm).first()["f1_macro"] == pytest.approx(0.5 / 3, abs=1e-4)
    shares = {(r["actual"], r["predicted"]): (r["row_max"], r["share"]) for r in row_shares(cm).collect()}
    assert shares[("Moderate", "Fatal")] == (1, 0.0) and shares[("Fatal", "Severe")] == (1, 1.0)


def test_stored_matrix_forms(spark):
    df = spark.createDataFrame(
        [(1, str(MATRIX)), (2, '{"matrix": [[1, 2], [3, 4]], "classNames": ["x", "y"]}'), (3, "oops"), (4, None), (5, "[[1]] x")],
        "run int, j string",
    )
    got = [tuple(r) for r in confusion_from_json(df, "j").collect()]
    assert (1, "Fatal", "Severe", 90) in got and (2, "y", "x", 3) in got
    assert {r[0] for r in got} == {1, 2} and len(got) == 20


def test_importances_and_history(spark):
    df = spark.createDataFrame([({"a": 0.1, "b": 0.7, "c": 0.1234567},)], "feature_importances map<string,double>")
    assert [tuple(r) for r in importance_rows(df, n=2).collect()] == [("b", 0.7), ("c", 0.123457)]
    cols = (
        "run_id long, model_type string, model_path string, accuracy double, f1_weighted double, precision_weighted double,"
        " recall_weighted double, n_estimators int, training_samples long, test_samples long, created_at timestamp,"
        " classification_report string"
    )
    runs = spark.createDataFrame([(i, "m", "p", 0.5, 0.5, 0.5, 0.5, 9, 10, 5, None, "r") for i in (3, 9, 4)], cols)
    assert [r["run_id"] for r in metrics_history(runs).collect()] == [9, 4, 3]
    assert metrics_summary(runs, 77).count() == 0 and metrics_summary(runs, 9).count() == 1
    assert "classification_report" in metrics_full(runs, 9).columns
