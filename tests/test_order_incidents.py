"""Incident rows from the order tables: texts are joined last."""

import pytest
from incidentlake.plans.catalog import QUERIES
from incidentlake.sources.order_incidents import COLUMNS, incidents
from pyspark.sql import functions as F


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")  # nation and region alone are sent to the tasks
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def above(plan: str, column: str) -> list[str]:
    """The operators between the top of a plan and the scan of a column."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and column in x)
    depth, found = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for x in reversed(lines[:at]):
        here = len(x) - len(x.lstrip(" :+-"))
        if here < depth:
            depth = here
            found.append(x.lstrip(" :+-"))
    return found


def test_texts_are_moved_once(spark, sf_dir, shuffled_joins):
    plan = incidents(spark, sf_dir, *COLUMNS)._jdf.queryExecution().executedPlan().toString()
    moves = [x for x in above(plan, ",text#") if x.startswith("Exchange")]
    # before, a text went with its row through the exchanges for its vector and its customer
    assert len(moves) == 1 and "doc_key" in moves[0]


def test_rows_stay_the_same(spark, sf_dir, shuffled_joins):
    rows = incidents(spark, sf_dir, "id", "location", "cluster_id", "summary")
    apart = incidents(spark, sf_dir, "id", "summary").join(incidents(spark, sf_dir, "id", "location"), "id").join(incidents(spark, sf_dir, "id", "cluster_id"), "id")
    assert rows.exceptAll(apart.select(rows.columns)).count() == 0 and rows.count() == apart.count() > 1000
    assert rows.where(F.col("summary").isNotNull()).count() > 1000


def test_dashboard_totals_need_no_broadcast(spark, sf_dir):
    want = QUERIES["dashboard_totals"](spark, sf_dir).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "5000")
    try:
        assert QUERIES["dashboard_totals"](spark, sf_dir).collect() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
