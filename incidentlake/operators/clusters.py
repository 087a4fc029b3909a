"""Statistics, cards and labels of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.replies import factor_list, json_strings
from ..schema import NOISE
from .ranking import top_rows_per_group, top_values_of
from .search import cluster_name


def cluster_stats(df: DataFrame, label: str = "cluster_id", run_id: int | None = None) -> DataFrame:
    """One row per cluster label, noise included.

    Two scans: one for the figures, one that counts the values of the three text
    columns together. Both combine per task before the shuffle, and their results
    have one row per cluster.
    """
    base = df.groupBy(label).agg(
        F.count("*").alias("incident_count"),
        F.round(F.avg("fatality_rate"), 4).alias("avg_fatality_rate"),
        F.round(F.avg("fatalities"), 2).alias("avg_fatalities"),
        F.min("year").alias("year_range_start"), F.max("year").alias("year_range_end"),
    )
    names = top_values_of(df, label, {
        "dominant_severity": ("severity_label", 1), "top_operators": ("operator", 5),
        "top_aircraft_types": ("aircraft_type", 5),
    })
    joined = base.join(names, label, "left")
    none = F.array().cast("array<string>")
    stats = joined.select(
        F.col(label).alias("cluster_label"), "incident_count", "avg_fatality_rate", "avg_fatalities",
        F.get("dominant_severity", F.lit(0)).alias("dominant_severity"), F.coalesce("top_operators", none).alias("top_operators"),
        F.coalesce("top_aircraft_types", none).alias("top_aircraft_types"),
        "year_range_start", "year_range_end",
    )
    return stats if run_id is None else stats.withColumn("run_id", F.lit(run_id).cast("bigint"))


def with_summary_columns(clusters: DataFrame) -> DataFrame:
    """Add the still empty summary fields to fresh cluster statistics."""
    empty = {
        "root_cause_summary": "string", "key_contributing_factors": "array<string>",
        "recommendations": "string", "summarized_at": "timestamp",
    }
    return clusters.select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in empty.items() if c not in clusters.columns]
    )


def real_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters without the noise entry, by label."""
    return clusters.where(F.col("cluster_label") != NOISE).orderBy("cluster_label")


def by_size(clusters: DataFrame) -> DataFrame:
    """Clusters without the noise entry, largest first."""
    return clusters.where(F.col("cluster_label") != NOISE).orderBy(
        F.col("incident_count").desc(), F.col("cluster_label").asc()
    )


def summarised(clusters: DataFrame) -> DataFrame:
    return by_size(clusters.where(F.col("root_cause_summary").isNotNull()))


def _factors(clusters: DataFrame) -> Column:
    """Stored factors, from an array column or from text in one of the older forms."""
    kind = clusters.schema["key_contributing_factors"].dataType.simpleString()
    column = F.col("key_contributing_factors")
    return F.coalesce(column, F.array().cast("array<string>")) if kind.startswith("array") else factor_list(column)


def _strict_list(clusters: DataFrame, name: str) -> Column:
    """An array column as it is, a text column as the JSON list it holds; anything else is an empty list."""
    kind = clusters.schema[name].dataType.simpleString()
    column = F.col(name)
    return (F.coalesce(column, F.array().cast("array<string>")) if kind.startswith("array") else json_strings(column)).alias(name)


def cluster_summary(clusters: DataFrame, label: int) -> DataFrame:
    """The summary of one cluster; no row if it has none."""
    return cluster_summaries(clusters.where(F.col("cluster_label") == label))


def cluster_cards(clusters: DataFrame) -> DataFrame:
    """Display cards: missing rates as 0, placeholder texts, factors as a list."""
    return real_clusters(clusters).select(
        "cluster_label", cluster_name(F.col("cluster_label")).alias("name"), "incident_count",
        F.coalesce("avg_fatality_rate", F.lit(0.0)).alias("avg_fatality_rate"),
        F.coalesce("avg_fatalities", F.lit(0.0)).alias("avg_fatalities"),
        "dominant_severity", "top_operators", "top_aircraft_types", "year_range_start", "year_range_end",
        F.coalesce(F.nullif("root_cause_summary", F.lit("")), F.lit(vocab.NO_SUMMARY_YET)).alias("root_cause_summary"),
        _factors(clusters).alias("key_contributing_factors"),
        F.coalesce(F.nullif("recommendations", F.lit("")), F.lit(vocab.NO_RECOMMENDATIONS_YET))
        .alias("recommendations"),
    )


def cluster_summaries(clusters: DataFrame) -> DataFrame:
    """Summarised clusters, largest first, with their year range as text."""
    return summarised(clusters).select(
        "cluster_label", "incident_count", year_range().alias("year_range"), "dominant_severity",
        "avg_fatality_rate", _strict_list(clusters, "top_operators"), _strict_list(clusters, "top_aircraft_types"),
        "root_cause_summary", _strict_list(clusters, "key_contributing_factors"), "recommendations",
        F.date_format("summarized_at", "yyyy-MM-dd'T'HH:mm:ss").alias("summarized_at"),
    )


def year_range() -> Column:
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    return F.concat(text("year_range_start"), F.lit("–"), text("year_range_end"))


def cluster_samples(df: DataFrame, clusters: DataFrame, n: int = vocab.SAMPLES_PER_CLUSTER) -> DataFrame:
    """The deadliest reports with text of every real cluster, ranked."""
    best = top_rows_per_group(
        df.where(F.col("summary").isNotNull() & (F.col("cluster_id") != NOISE)),
        "cluster_id", "fatalities", n, columns=("summary",),
    )
    labels = clusters.select(F.col("cluster_label").alias("cluster_id"))
    return best.join(labels, "cluster_id", "left_semi")
