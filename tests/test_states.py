"""Dashboard from stored states."""

import json

import pytest
from incidentlake.plans.dashboard import dashboard_summary
from incidentlake.plans.states import add_batch, batch_state, stored_dashboard

FIELDS = "id long, year int, operator string, aircraft_type string, location string, aboard double, fatalities double, severity_label string"


def incidents(spark):
    rows = [(i, None if i % 11 == 0 else 1950 + i % 37, None if i % 7 == 0 else f"op{i % 5}", f"air{i % 3}", f"loc{i % 13}",
             None if i % 6 == 0 else float(i % 9), None if i % 8 == 0 else float(i % 4), [None, "Fatal", "Minor"][i % 3]) for i in range(400)]
    rows += [(1000, 2001, "only unknown", "x", "y", 0.0, 1.0, "Fatal"), (1001, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, FIELDS)


def parsed(df):
    return {k: json.loads(v) if v else v for k, v in df.first().asDict().items()}


def test_states_of_parts_give_the_figures_of_the_whole(spark, tmp_path):
    df, path = incidents(spark), str(tmp_path)
    add_batch(df.where("id % 2 = 0").limit(50), path, 7)  # an unfinished batch, stored again below
    add_batch(df.where("id % 2 = 0"), path, 7)
    before = parsed(stored_dashboard(spark, path))
    assert before == parsed(dashboard_summary(df.where("id % 2 = 0")))
    add_batch(df.where("id % 2 = 1"), path, 8)
    assert parsed(stored_dashboard(spark, path)) == parsed(dashboard_summary(df))


def test_only_states_are_read(spark, tmp_path):
    add_batch(incidents(spark), str(tmp_path), 1)
    plan = stored_dashboard(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "n_known" in plan


@pytest.mark.parametrize("rows", [0, 1])
def test_small_batches(spark, tmp_path, rows):
    df = incidents(spark).where("id = 1001").limit(rows)
    add_batch(df, str(tmp_path), 1)
    assert parsed(stored_dashboard(spark, str(tmp_path))) == parsed(dashboard_summary(df))
    assert batch_state(df).count() == 5 * rows
