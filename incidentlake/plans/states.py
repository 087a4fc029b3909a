"""A dashboard kept up to date: mergeable figures of each stored batch, summed when it is read.

The state of a batch has one row per year, severity, operator, aircraft and place, with
counts and sums. States of any batches add up; distinct values are exact, because the
values themselves are kept. A new batch adds its state and nothing else is scanned; a
batch that is stored again replaces its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import UNKNOWN
from ..sources.sinks import read_runs, replace_run
from .dashboard import as_sections

KINDS = {"year": "year", "severity": "severity_label", "operator": "operator", "aircraft": "aircraft_type", "location": "location"}
SUMS = ("n", "fatalities", "aboard", "with_fatalities", "n_known", "fatalities_known", "aboard_known")


def batch_state(df: DataFrame) -> DataFrame:
    """(kind, key, sums): figures per value, from one scan. A null value is a key of its own.

    ``known`` sums cover rows with fatalities and people aboard, as the overview does.
    """
    df = C.with_fields(df, *KINDS.values(), "fatalities", "aboard")
    known = F.col("fatalities").isNotNull() & (F.col("aboard") > 0)
    keys = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")) for kind, c in KINDS.items()])
    rows = df.select("fatalities", "aboard", F.coalesce(known, F.lit(False)).alias("known"), F.inline(keys))
    return rows.groupBy("kind", "key").agg(
        F.count("*").alias("n"), C.total(F.col("fatalities")).alias("fatalities"), C.total(F.col("aboard")).alias("aboard"),
        F.count("fatalities").alias("with_fatalities"), F.count_if("known").alias("n_known"),
        C.total(F.when(F.col("known"), F.col("fatalities"))).alias("fatalities_known"), C.total(F.when(F.col("known"), F.col("aboard"))).alias("aboard_known"))


def add_batch(df: DataFrame, path: str, batch: int) -> None:
    """Store the state of a batch; storing it again replaces it. Other batches are not read."""
    replace_run(batch_state(df), path, batch)


def merged(states: DataFrame) -> DataFrame:
    """States of several batches as one."""
    return states.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in SUMS])


def overview_of(state: DataFrame) -> DataFrame:
    """The figures of ``aggregates.overview``, from a state."""
    of = {kind: F.col("kind") == kind for kind in KINDS}
    seen = (F.col("n_known") > 0) & F.col("key").isNotNull()
    sums = {c: F.coalesce(F.sum(F.when(of["year"], F.col(c))), F.lit(0)) for c in ("n_known", "fatalities_known", "aboard_known")}
    year = F.when(of["year"] & seen, F.col("key").cast("int"))
    lost, aboard = sums["fatalities_known"], sums["aboard_known"]
    return state.agg(
        sums["n_known"].cast("bigint").alias("total_incidents"), lost.cast("bigint").alias("total_fatalities"), aboard.cast("bigint").alias("total_aboard"),
        F.coalesce(F.round(F.try_divide(lost, aboard) * 100, 2), F.lit(0.0)).alias("overall_fatality_rate_pct"),
        F.coalesce(F.round(F.try_divide(aboard - lost, aboard) * 100, 2), F.lit(0.0)).alias("overall_survival_rate_pct"),
        F.min(year).alias("year_min"), F.max(year).alias("year_max"),
        *[F.count_if(of[kind] & seen).alias(name) for kind, name in (
            ("operator", "unique_operators"), ("aircraft", "unique_aircraft_types"), ("location", "unique_locations"))])


def yearly_of(state: DataFrame, window: int = 5) -> DataFrame:
    """The rows of ``aggregates.yearly_trends``, from a state."""
    trailing = Window.orderBy("year").rowsBetween(1 - window, 0)  # one row per year
    return state.where("kind = 'year' and key is not null").select(
        F.col("key").cast("int").alias("year"), F.col("n").alias("incident_count"), F.col("fatalities").cast("bigint").alias("total_fatalities"),
        F.coalesce(F.round(F.try_divide("fatalities", "aboard"), 4), F.lit(0.0)).alias("avg_fatality_rate"), F.round("aboard", 1).alias("total_aboard")) \
        .withColumn("rolling_avg_incidents", F.round(F.avg("incident_count").over(trailing), 2)).orderBy("year")


def severity_of(state: DataFrame) -> DataFrame:
    """The rows of ``aggregates.severity_distribution``, from a state."""
    counts = state.where("kind = 'severity'").groupBy(F.coalesce("key", F.lit(UNKNOWN)).alias("severity")).agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("severity", F.col("n").alias("count"), F.round(F.col("n") / total * 100, 2).alias("percentage"))


def decades_of(state: DataFrame) -> DataFrame:
    """The rows of ``aggregates.decade_trends``, from a state."""
    start = C.decade_of(F.col("key").cast("int"))
    rows = state.where("kind = 'year' and key is not null").groupBy(start.alias("start")).agg(*[F.sum(c).alias(c) for c in SUMS])
    return rows.select(
        F.concat(F.col("start").cast("string"), F.lit("s")).alias("decade"), F.col("n").alias("incidents"), F.round("fatalities", 1).alias("fatalities"),
        F.coalesce(F.round(F.try_divide("fatalities", "with_fatalities"), 2), F.lit(0.0)).alias("avg_fatalities"),
        F.coalesce(F.round(F.try_divide("fatalities", "aboard"), 4), F.lit(0.0)).alias("fatality_rate"))


def stored_dashboard(spark: SparkSession, path: str) -> DataFrame:
    """``dashboard.dashboard_summary`` of all stored batches, from their states alone."""
    state = merged(read_runs(spark, path))
    return as_sections(overview_of(state), yearly_of(state), severity_of(state), decades_of(state))
