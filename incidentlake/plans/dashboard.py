"""Figures that combine several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import decade_trends, overview, severity_distribution, yearly_trends
from ..schema import NOISE


def dashboard_header(df: DataFrame, clusters: DataFrame, metrics: DataFrame) -> DataFrame:
    """Overview figures with the number of clusters and the latest model scores; missing sides give 0."""
    n_clusters = clusters.where(F.col("cluster_label") != NOISE).agg(F.count("*")).scalar()

    # Largest run id wins; one value comes back whatever the number of runs.
    scores = metrics.agg(F.max_by(F.struct("accuracy", "f1_weighted"), "run_id").alias("s")).scalar()
    return overview(df).select(
        "*", F.coalesce(n_clusters, F.lit(0)).alias("total_clusters"),
        *[F.coalesce(scores[c], F.lit(0.0)).alias(c) for c in ("accuracy", "f1_weighted")],
    )


def dashboard_summary(df: DataFrame) -> DataFrame:
    """Overview, yearly, severity and decade sections as one row of JSON texts.

    Each section is a short report (one row per year, label or decade).
    """
    narrow = df.select("year", "operator", "aircraft_type", "location", "aboard", "fatalities", "severity_label")
    return as_sections(overview(narrow), yearly_trends(narrow), severity_distribution(narrow), decade_trends(narrow))


def as_sections(head: DataFrame, yearly: DataFrame, severity: DataFrame, decade: DataFrame) -> DataFrame:
    """One row of JSON texts from the reports of the dashboard."""
    def section(report: DataFrame, *order: str):
        rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in report.columns if c not in order])))
        return report.agg(F.to_json(rows)).scalar()

    return head.select(
        F.to_json(F.struct(*head.columns)).alias("overview"), section(yearly, "year").alias("yearly"),
        section(severity, "severity").alias("severity"), section(decade, "decade").alias("decade"),
    )
