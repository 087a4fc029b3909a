"""Confusion tables and the classification figures read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.replies import strict_json
from ..schema import SEVERITY_INDEX


def confusion(
    df: DataFrame, actual: str, predicted: str, classes: Sequence[str] = SEVERITY_INDEX, count: str | None = None
) -> DataFrame:
    """Counts for every class pair (zeros included) as rows (actual, predicted, n).

    ``count`` names the column of rows that were counted before.
    """
    names = F.array(*[F.lit(c) for c in classes])
    # Other labels drop out at the join with the grid. A filter on the predicted
    # label would make Spark compute the prediction a second time below it.
    counted = (
        df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
        .agg((F.sum(count) if count else F.count("*")).alias("n"))
    )
    grid = (
        df.sparkSession.range(1).select(F.explode(names).alias("actual"))
        .select("actual", F.explode(names).alias("predicted"))
    )
    return grid.join(counted, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def class_report(cm: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined figures are 0."""
    marked = cm.select(
        "actual", "predicted", "n",
        F.sum("n").over(Window.partitionBy("actual")).alias("support"),
        F.sum("n").over(Window.partitionBy("predicted")).alias("claimed"),
    ).where(F.col("actual") == F.col("predicted"))
    precision = F.coalesce(F.try_divide("n", "claimed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("n", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("n"), F.col("support") + F.col("claimed")), F.lit(0.0))
    return marked.select(
        F.col("actual").alias("label"), precision.alias("precision"), recall.alias("recall"),
        f1.alias("f1"), "support", "claimed", F.col("n").alias("hits"),
    )


def rounded_report(cm: DataFrame, digits: int = 4) -> DataFrame:
    return class_report(cm).select(
        "label", *[F.round(c, digits).alias(c) for c in ("precision", "recall", "f1")], "support"
    )


def classification_metrics(cm: DataFrame) -> DataFrame:
    """Accuracy, support-weighted precision, recall and F1, and the plain mean F1."""
    report = class_report(cm)

    def weighted(c: str):
        mean = F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support"))
        return F.round(F.coalesce(mean, F.lit(0.0)), 4)

    occurs = (F.col("support") > 0) | (F.col("claimed") > 0)
    return report.agg(
        F.round(F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0)), 4).alias("accuracy"),
        weighted("precision").alias("precision_weighted"), weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        F.round(F.avg(F.when(occurs, F.col("f1"))), 4).alias("f1_macro"),
        F.sum("support").alias("test_samples"),
    )


def row_shares(cm: DataFrame) -> DataFrame:
    """Largest count of each actual class (at least 1) and every cell's share of it."""
    peak = F.greatest(F.max("n").over(Window.partitionBy("actual")), F.lit(1))
    return cm.withColumn("row_max", peak).withColumn("share", F.round(F.col("n") / F.col("row_max"), 4))


def confusion_from_json(df: DataFrame, column: str, classes: Sequence[str] = SEVERITY_INDEX) -> DataFrame:
    """Long confusion rows from a stored matrix, either bare or with its class names.

    A missing or broken value gives no rows.
    """
    parsed = strict_json(F.col(column))
    bare = F.try_variant_get(parsed, "$", "array<array<bigint>>")
    matrix = F.coalesce(F.try_variant_get(parsed, "$.matrix", "array<array<bigint>>"), bare)
    names = F.coalesce(
        F.try_variant_get(parsed, "$.classNames", "array<string>"), F.array(*[F.lit(c) for c in classes])
    )
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, names.alias("_names"), F.posexplode(matrix).alias("_i", "_row"))
    cells = rows.select(*rest, "_names", "_i", F.posexplode("_row").alias("_j", "n"))
    return cells.select(
        *rest, F.get("_names", F.col("_i")).alias("actual"), F.get("_names", F.col("_j")).alias("predicted"), "n"
    )


def importance_rows(df: DataFrame, column: str = "feature_importances", n: int = 30) -> DataFrame:
    """A feature -> importance map as rows, largest first."""
    return (
        df.select(F.explode(column).alias("feature", "importance"))
        .select("feature", F.round("importance", 6).alias("importance"))
        .orderBy(F.col("importance").desc(), "feature").limit(n)
    )


METRICS_SUMMARY = (
    "run_id", "model_type", "model_path", "accuracy", "f1_weighted", "precision_weighted",
    "recall_weighted", "n_estimators", "training_samples", "test_samples",
)
METRICS_HISTORY = (
    "run_id", "model_type", "accuracy", "f1_weighted", "precision_weighted", "recall_weighted",
    "training_samples", "test_samples", "created_at",
)


def metrics_summary(metrics: DataFrame, run_id: int) -> DataFrame:
    """Figures of one run; no row when the run was never stored."""
    return metrics.where(F.col("run_id") == run_id).select(*METRICS_SUMMARY)


def metrics_full(metrics: DataFrame, run_id: int) -> DataFrame:
    wanted = [c for c in METRICS_SUMMARY if c != "model_path"] + ["classification_report"]
    return metrics.where(F.col("run_id") == run_id).select(*wanted)


def metrics_history(metrics: DataFrame) -> DataFrame:
    """All runs, newest first."""
    return metrics.select(*[c for c in METRICS_HISTORY if c in metrics.columns]).orderBy(F.col("run_id").desc())
