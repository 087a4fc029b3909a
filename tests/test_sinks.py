"""Runs with an atomic switch, and back-fill of bucketed tables."""

import pytest
from incidentlake import backfill, backfill_bucketed, delete_unnamed, forget_run, open_bucketed, read_runs, replace_run, store_bucketed
from incidentlake.operators.stats import chi_square
from incidentlake.sources import sinks
from pyspark.sql import functions as F


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def seen(df):
    return sorted((r["run_id"], r["v"]) for r in df.collect())


def test_runs_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path)
    replace_run(numbers(spark, 1, 2), path, 1)
    replace_run(numbers(spark, 3), path, 2)
    before = read_runs(spark, path)
    replace_run(read_runs(spark, path, 1).withColumn("v", F.col("v") * 10), path, 1)  # reads what it replaces
    assert seen(read_runs(spark, path)) == [(1, 10), (1, 20), (2, 3)] and seen(read_runs(spark, path, 1)) == [(1, 10), (1, 20)]
    assert seen(before) == [(1, 1), (1, 2), (2, 3)]  # a reader at work keeps its rows
    assert read_runs(spark, path, 9).count() == 0


def test_a_failed_write_leaves_the_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    replace_run(numbers(spark, 1), path, 1)
    with pytest.raises(Exception, match="broken"):
        replace_run(numbers(spark, 1, 2).select(F.raise_error(F.lit("broken")).alias("v")), path, 1)
    assert seen(read_runs(spark, path)) == [(1, 1)]
    monkeypatch.setattr(sinks, "_name_run", lambda *a: (_ for _ in ()).throw(OSError("no manifest")))
    with pytest.raises(OSError):
        replace_run(numbers(spark, 5), path, 1)
    assert seen(read_runs(spark, path)) == [(1, 1)]


def test_retention_deletes_what_no_manifest_names(spark, tmp_path):
    path = str(tmp_path)
    for v in (1, 2):
        replace_run(numbers(spark, v), path, 1)
    replace_run(numbers(spark, 3), path, 2)
    replace_run(numbers(spark, 4), path, 3)
    forget_run(spark, path, 3)
    numbers(spark, 9).write.parquet(f"{path}/data/run-7-unfinished")
    assert delete_unnamed(spark, path) == []
    gone = delete_unnamed(spark, path, hours=-1)
    assert len(gone) == 3 and "run-7-unfinished" in gone
    assert seen(read_runs(spark, path)) == [(1, 2), (2, 3)] and delete_unnamed(spark, path, hours=-1) == []
    with pytest.raises(Exception):
        read_runs(spark, f"{path}/nowhere")


def exchanges_above(df, table):
    """Plan lines from the scan of a table up to the root that are exchanges, and whether rows are merged there."""
    lines, depth, above = df._jdf.queryExecution().executedPlan().toString().split("\n"), None, []
    scan = next(i for i, line in enumerate(lines) if table in line)
    for line in reversed(lines[:scan + 1]):
        level = len(line) - len(line.lstrip(" :+-"))
        if depth is None or level < depth:
            above.append(line)
            depth = level
    return sum("Exchange" in line for line in above), any("SortMergeJoin" in line for line in above)


def test_bucketed_back_fill_leaves_the_wide_table_in_place(spark, tmp_path):
    wide = spark.range(2000).select("id", F.repeat(F.lit("x"), 50).alias("text"), F.lit("old").alias("label"))
    updates = spark.createDataFrame([(i, f"new{i}") for i in range(0, 2000, 3)] + [(3, "last"), (5000, "no row")], "id long, label string")
    spark.sql("DROP TABLE IF EXISTS wide_rows")
    store_bucketed(wide, "wide_rows", str(tmp_path / "wide"), "id", 8)
    filled = backfill_bucketed(open_bucketed(spark, "wide_rows", str(tmp_path / "wide"), "id", 8), updates, "id", ["label"], 8)
    assert exchanges_above(filled, "wide_rows") == (0, True)
    want = backfill(wide, updates, "id", ["label"])
    assert filled.exceptAll(want.select(*filled.columns)).count() == 0 and filled.count() == 2000
    spark.sql("DROP TABLE wide_rows")  # the files stay; another session opens them
    again = backfill_bucketed(open_bucketed(spark, "wide_rows", str(tmp_path / "wide"), "id", 8), updates, "id", ["label"], 8)
    assert again.count() == 2000 and exchanges_above(again, "wide_rows") == (0, True)


def test_margins_need_no_window(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", f"w{i % 700}") for i in range(5000)], "kind string, word string")
    plan = chi_square(rows, "kind", "word")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
