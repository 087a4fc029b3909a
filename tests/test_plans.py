"""The physical plans keep what makes them work on large tables."""

import pytest
from pyspark.sql import functions as F

from incidentlake import (
    build_features,
    cluster_samples,
    search_incidents,
    severity_distribution,
    sizing,
    stratified_split,
    top_groups,
    yearly_trends,
)
from incidentlake.operators.ranking import ranked_rows
from incidentlake.operators.severity_model import assemble
from incidentlake.operators.text import TfidfModel
from incidentlake.schema import INCIDENT_SCHEMA


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "incidents")
    spark.createDataFrame([], INCIDENT_SCHEMA).write.parquet(path)
    return spark.read.schema(INCIDENT_SCHEMA).parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(stored):
    text = plan(yearly_trends(stored))
    assert "ReadSchema: struct<aboard:double,fatalities:double,year:int>" in text
    assert "PushedFilters: [IsNotNull(year)]" in text
    assert "summary" not in plan(top_groups(stored, "operator"))


def test_filters_reach_the_scan(stored):
    text = plan(search_incidents(stored, severity="Fatal", decade="1980s"))
    assert "EqualTo(severity_label,Fatal)" in text and "GreaterThanOrEqual(year,1980)" in text
    assert "TakeOrderedAndProject" in text


def test_rank_filter_runs_before_the_shuffle_and_without_texts(spark, stored):
    ranked = plan(ranked_rows(stored, "cluster_id", "fatalities", 12))
    assert "Partial" in ranked and ranked.count("WindowGroupLimit") == 2 and "summary" not in ranked
    clusters = spark.createDataFrame([(0,)], "cluster_label int")
    text = plan(cluster_samples(stored, clusters))
    assert "Window" not in text and "BroadcastHashJoin" in text


def test_aggregates_combine_first(stored):
    assert "partial_count" in plan(severity_distribution(stored))


def test_no_cartesian_products(stored):
    for df in (severity_distribution(stored), stratified_split(stored, "severity_label"), build_features(stored, "id")):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_features_and_text_vectors_need_no_exchange(spark, stored):
    words = spark.createDataFrame([("engine", 0, 2, 3, 1.5)], "term string, idx int, document_count long, frequency long, idf double")
    ready = assemble(stored, {"year": 1970.0, "aboard": 9.0, "decade": 1970.0}, TfidfModel(words, 10))
    assert "Exchange" not in plan(ready.select("id", F.col("features")))


def test_sizing_grows_with_the_table():
    small, large = sizing(10 * 1024**3, 64), sizing(100 * 1024**4, 4000)
    assert small["spark.sql.shuffle.partitions"] == "192" and small["spark.sql.files.maxPartitionBytes"] == "128m"
    assert large["spark.sql.shuffle.partitions"] == "40000" and large["spark.sql.files.maxPartitionBytes"] == "525m"
