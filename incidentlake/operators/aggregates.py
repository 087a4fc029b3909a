"""Overview figures, trends, rankings and distributions.

Every aggregate groups on its key directly: Spark combines per task before the
shuffle, so a key that holds a third of the rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import NOISE, UNKNOWN
from .search import check_range


OVERVIEW_FIELDS = ("fatalities", "aboard", "year", "operator", "aircraft_type", "location", "severity_label")
NAME_COLUMNS = {"operator": ("operator", "airline"), "aircraft_type": ("aircraft_type", "aircraft")}


def _rate(scale: float, digits: int) -> Column:
    ratio = C.ratio_of_sums(F.col("fatalities"), F.col("aboard"))
    return F.round(ratio * scale if scale != 1 else ratio, digits)


def overview(df: DataFrame) -> DataFrame:
    """Headline figures over rows with known fatalities and people aboard; rates in percent."""
    df = C.with_fields(df, *OVERVIEW_FIELDS)
    rows = df.where(F.col("fatalities").isNotNull() & (F.col("aboard") > 0))
    survivors = F.sum(F.col("aboard") - F.col("fatalities"))
    return rows.agg(
        F.count("*").alias("total_incidents"),
        C.total(F.col("fatalities")).cast("bigint").alias("total_fatalities"),
        C.total(F.col("aboard")).cast("bigint").alias("total_aboard"),
        F.coalesce(_rate(100, 2), F.lit(0.0)).alias("overall_fatality_rate_pct"),
        F.coalesce(F.round(F.try_divide(survivors, F.sum("aboard")) * 100, 2), F.lit(0.0))
        .alias("overall_survival_rate_pct"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.countDistinct("operator").alias("unique_operators"),
        F.countDistinct("aircraft_type").alias("unique_aircraft_types"),
        F.countDistinct("location").alias("unique_locations"),
    )


def overview_all(df: DataFrame) -> DataFrame:
    """Headline figures over all rows; rates as ratios, plus the severity counts as a map."""
    df = C.with_fields(df, *OVERVIEW_FIELDS)
    severities = (
        df.where(F.col("severity_label").isNotNull()).groupBy("severity_label").count()
        .agg(F.map_from_entries(F.collect_list(F.struct("severity_label", "count"))).alias("m")).scalar()
    )
    fatalities, aboard = C.total(F.col("fatalities")), C.total(F.col("aboard"))
    figures = df.agg(
        F.count("*").alias("total_incidents"),
        fatalities.cast("bigint").alias("total_fatalities"), aboard.cast("bigint").alias("total_aboard"),
        F.coalesce(F.round(F.try_divide(fatalities, aboard), 4), F.lit(0.0)).alias("overall_fatality_rate_ratio"),
        F.coalesce(F.round(F.try_divide(aboard - fatalities, aboard), 4), F.lit(0.0))
        .alias("overall_survival_rate_ratio"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"),
        F.countDistinct("operator").alias("unique_operators"),
        F.countDistinct("aircraft_type").alias("unique_aircraft_types"),
        F.countDistinct("location").alias("unique_locations"),
    )
    return figures.withColumn("severity_distribution", severities)


def yearly_trends(df: DataFrame, unit: str = "ratio", window: int = 5) -> DataFrame:
    """Counts and fatality rate per year.

    ``ratio`` adds the trailing mean over the last ``window`` rows (years without
    incidents are skipped, not counted as zero); ``percent`` gives the rate in
    percent with 0 for years without people aboard.
    """
    per_year = C.with_fields(df, "year", "fatalities", "aboard").where(F.col("year").isNotNull()).groupBy("year")
    fatalities = C.total(F.col("fatalities")).cast("bigint")
    if unit == "percent":
        return per_year.agg(
            F.count("*").alias("incident_count"), fatalities.alias("total_fatalities"),
            C.total(F.col("aboard")).cast("bigint").alias("total_aboard"),
            F.coalesce(_rate(100, 2), F.lit(0.0)).alias("avg_fatality_rate_pct"),
        ).orderBy("year")
    if unit != "ratio":
        raise ValueError(f"unit must be ratio or percent, got {unit!r}")
    yearly = per_year.agg(
        F.count("*").alias("incident_count"), fatalities.alias("total_fatalities"),
        F.coalesce(_rate(1, 4), F.lit(0.0)).alias("avg_fatality_rate"),
        F.round(C.total(F.col("aboard")), 1).alias("total_aboard"),
    )
    # One row per year is left here, so the unpartitioned window stays tiny.
    trailing = Window.orderBy("year").rowsBetween(1 - window, 0)
    return yearly.withColumn(
        "rolling_avg_incidents", F.round(F.avg("incident_count").over(trailing), 2)
    ).orderBy("year")


def decade_trends(df: DataFrame, unit: str = "ratio") -> DataFrame:
    """Counts and fatality rate per decade, labelled like ``1980s``."""
    dated = C.with_fields(df, "year", "fatalities", "aboard").where(F.col("year").isNotNull())
    per_decade = dated.groupBy(C.decade_of(F.col("year")).alias("decade_start"))
    if unit == "percent":
        rows = per_decade.agg(
            F.count("*").alias("incident_count"),
            C.total(F.col("fatalities")).cast("bigint").alias("total_fatalities"),
            C.total(F.col("aboard")).alias("total_aboard"),
            F.coalesce(_rate(100, 2), F.lit(0.0)).alias("avg_fatality_rate_pct"),
        )
    elif unit == "ratio":
        rows = per_decade.agg(
            F.count("*").alias("incidents"),
            F.round(C.total(F.col("fatalities")), 1).alias("fatalities"),
            F.coalesce(F.round(F.avg("fatalities"), 2), F.lit(0.0)).alias("avg_fatalities"),
            F.coalesce(_rate(1, 4), F.lit(0.0)).alias("fatality_rate"),
        )
    else:
        raise ValueError(f"unit must be ratio or percent, got {unit!r}")
    label = F.concat(F.col("decade_start").cast("string"), F.lit("s")).alias("decade")
    return rows.orderBy("decade_start").select(label, *[c for c in rows.columns if c != "decade_start"])


def yearly_chart(yearly: DataFrame) -> DataFrame:
    """Chart rows of the yearly trend."""
    return yearly.select(
        "year", F.col("incident_count").alias("incidents"), F.col("total_fatalities").alias("fatalities"),
        F.col("avg_fatality_rate").alias("fatality_rate"),
    )


def decade_chart(decades: DataFrame) -> DataFrame:
    """Chart rows of the decade trend, with the fatality rate of the decade."""
    return decades.select("decade", "incidents", "fatalities", F.col("fatality_rate").alias("avg_fatality_rate"))


def top_groups(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent non-blank values of ``key`` with their fatality figures."""
    check_range("n", n, 5, 50)
    return (
        df.where(C.not_blank(F.col(key))).groupBy(key)
        .agg(
            F.count("*").alias("incidents"),
            F.round(C.total(F.col("fatalities")), 1).alias("fatalities"),
            F.coalesce(_rate(1, 4), F.lit(0.0)).alias("fatality_rate"),
            F.coalesce(F.round(F.avg("fatalities"), 2), F.lit(0.0)).alias("avg_fatalities_per_incident"),
        )
        .orderBy(F.col("incidents").desc(), F.col(key).asc()).limit(n)
    )


def top_groups_share(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values with their share of all rows (null keys count in the total)."""
    check_range("n", n, 1)
    source = C.first_present(df, *NAME_COLUMNS.get(key, (key,)))
    df = C.with_fields(df.withColumnRenamed(source, key), key, "fatalities")
    groups = df.groupBy(key).agg(F.count("*").alias("incident_count"), C.total(F.col("fatalities")).alias("f"))
    total = groups.agg(F.sum("incident_count")).scalar()
    return (
        groups.where(F.col(key).isNotNull())
        .orderBy(F.col("incident_count").desc(), F.col(key).asc()).limit(n)
        .select(
            key, "incident_count",
            F.round(F.col("incident_count") / total * 100, 1).alias("percentage"),
            F.col("f").cast("bigint").alias("fatalities"),
        )
    )


def label_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; null stays a value of its own."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def quick_stats(df: DataFrame) -> DataFrame:
    """Rows per severity label next to the total."""
    counts = label_counts(df, "severity_label")
    return counts.withColumn("total", counts.agg(F.sum("n")).scalar())


def severity_distribution(df: DataFrame, null_as: str | None = UNKNOWN, digits: int = 2) -> DataFrame:
    """Count and percentage per severity; ``null_as=None`` drops unlabelled rows."""
    df, label = C.with_fields(df, "severity_label"), F.col("severity_label")
    rows = df.where(label.isNotNull()) if null_as is None else df
    severity = label if null_as is None else F.coalesce(label, F.lit(null_as))
    counts = rows.groupBy(severity.alias("severity")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        "severity", F.col("n").alias("count"), F.round(F.col("n") / total * 100, digits).alias("percentage")
    ).orderBy(F.col("count").desc(), "severity")


def distribution_shares(df: DataFrame, column: str = "severity_label") -> DataFrame:
    """Share of each value in the grand total of the non-null counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", total.alias("total"), F.round(F.col("n") / total, 6).alias("share"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), column)
    )


def extraction_coverage(df: DataFrame) -> DataFrame:
    """How many reports have extracted fields."""
    done = F.count("extracted_cause_category")
    return df.agg(
        F.count("*").alias("total_incidents"), done.alias("extracted_count"),
        (F.count("*") - done).alias("pending_count"),
        F.coalesce(F.round(F.try_divide(done, F.count("*")) * 100, 1), F.lit(0.0)).alias("coverage_pct"),
    )


def extraction_distribution(df: DataFrame) -> DataFrame:
    """Cause and phase counts in one long table, from one scan.

    Rows are counted per (cause, phase) before the pairs are unfolded.
    """
    counts = df.groupBy("extracted_cause_category", "extracted_phase_of_flight").agg(F.count("*").alias("k"))
    pairs = F.explode(F.array(
        F.struct(F.lit("cause").alias("field"), F.col("extracted_cause_category").alias("value")),
        F.struct(F.lit("phase").alias("field"), F.col("extracted_phase_of_flight").alias("value")),
    ))
    return (
        counts.select("k", pairs.alias("p")).select("p.field", "p.value", "k").where(F.col("value").isNotNull())
        .groupBy("field", "value").agg(F.sum("k").alias("n"))
    )


def summary_coverage(df: DataFrame) -> DataFrame:
    """Percentage of rows whose summary holds more than blanks."""
    has_text = C.strip(F.coalesce("summary", F.lit(""))) != ""
    return df.agg(F.round(F.avg(F.when(has_text, 1.0).otherwise(0.0)) * 100, 1).alias("summary_coverage_pct"))


def cluster_coverage(df: DataFrame, label: str = "cluster_id") -> DataFrame:
    """Number of clusters, noise rows and the share of rows inside clusters.

    Counts per label first, so no distinct pass over the rows is needed.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    noise = F.coalesce(F.sum(F.when(F.col(label) == NOISE, F.col("n"))), F.lit(0))
    return counts.agg(
        F.count(F.when(F.col(label) != NOISE, 1)).alias("n_clusters"), noise.alias("n_noise"),
        F.round((1 - F.try_divide(noise, F.sum("n"))) * 100, 1).alias("coverage_pct"),
    )
