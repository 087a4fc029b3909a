import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentlake import (
    SeverityModel,
    backfill,
    build_clusters,
    dashboard_header,
    dashboard_summary,
    extract_offline,
    fill_unknown,
    fit_medians,
    prepare_prompts,
    read_table,
    replace_table,
    score_unknown,
    stratified_split,
    train_and_score,
    train_severity,
)
from incidentlake import read_runs
from incidentlake.functions import vocab
from incidentlake.operators.features import build_features
from incidentlake.schema import INCIDENT_SCHEMA, SEVERITY_CLASSES

PHRASES = {
    "Fatal": "There were no survivors, all 12 passengers were killed.", "Minor": "No fatalities, the crew walked away.",
    "Moderate": "Several injured, most were rescued and survived.", "Severe": "Wing separated and the aircraft broke apart.",
}


def test_split_is_exact_for_a_dominant_label(spark):
    labels = ["Fatal"] * 3000 + ["Minor"] * 7 + ["Severe"] * 100 + ["Other"] * 50
    df = spark.createDataFrame(list(enumerate(labels)), "id long, severity_label string")
    got = stratified_split(df, "severity_label").groupBy("severity_label", "split").count().collect()
    n = {(r[0], r[1]): r[2] for r in got}
    assert n[("Fatal", "test")] == 600 and n[("Fatal", "val")] == 360 and n[("Fatal", "train")] == 2040
    assert n[("Minor", "test")] == 1 and n[("Minor", "val")] == 1 and n[("Minor", "train")] == 5
    assert not [k for k in n if k[0] == "Other"]
    again = stratified_split(df.repartition(5), "severity_label")
    assert again.exceptAll(stratified_split(df, "severity_label")).count() == 0
    other = stratified_split(df, "severity_label", seed=7)
    assert other.exceptAll(again).count() > 0


def test_split_of_tiny_labels(spark):
    df = spark.createDataFrame([(1, "Fatal"), (2, "Minor")], "id long, severity_label string")
    assert {r["split"] for r in stratified_split(df, "severity_label").collect()} == {"train"}


@pytest.mark.parametrize("n", [1, 2, 5, 100, 1001])
def test_medians_are_exact(spark, n):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=n), rng.integers(0, 5, size=n).astype(float)
    rows = [(float(x), None if i % 3 == 2 else float(y), None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = fit_medians(df, ["a", "b", "c"])
    assert got == {"a": statistics.median(a.tolist()), "b": statistics.median([r[1] for r in rows if r[1] is not None])}


def test_medians_of_skewed_values(spark):
    values = [0.0] * 700 + [10.0 ** (i % 30) * (1 + i / 1000) for i in range(1501)] + [-1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert fit_medians(df, ["v"]) == {"v": statistics.median(values)}


def test_features_of_a_bare_table(spark):
    row = build_features(spark.createDataFrame([(1,)], "id long"), "id").first().asDict()
    assert set(row) == {"id", *vocab.MODEL_FEATURES}
    assert [k for k, v in row.items() if v is None] == ["year", "aboard", "decade"]
    assert row["month"] == 6.0 and row["cluster_id"] == -1.0 and row["aircraft_era"] == 2.0
    assert row["aboard_severity_bin"] == 3.0 and row["has_summary"] == 0.0 and row["has_cause_extracted"] == 0.0


@pytest.fixture(scope="module")
def reports(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(900):
        label = SEVERITY_CLASSES[int(rng.integers(0, 4))]
        rows.append((
            i, f"{1950 + i % 60}-0{1 + i % 9}-11", f"Operator {i % 6}", f"Plane {i % 4}",
            None if i % 12 == 0 else float(rng.integers(1, 200)), PHRASES[label] + f" Report number {i}",
            None if i % 15 == 0 else 1950 + i % 60, label if i % 9 else "Unknown", label,
        ))
    df = spark.createDataFrame(
        rows, "id long, date string, operator string, aircraft_type string, aboard double, summary string, year int,"
        " severity_label string, truth string")
    have = set(df.columns)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in INCIDENT_SCHEMA.fields if f.name not in have]
    return df.select("*", *rest).withColumn("fatalities", F.col("aboard") / 2).withColumn("fatality_rate", F.lit(0.5)).cache()


@pytest.fixture(scope="module")
def training(reports):
    return train_severity(reports, num_trees=20)


def test_learns_the_phrases(spark, training):
    m = training.metrics.first()
    assert m["accuracy"] > 0.95 and training.split_counts["train"] > training.split_counts["test"]
    conf = [r["confidence"] for r in training.predictions.collect()]
    assert min(conf) >= 0.25 and max(conf) <= 1.0
    top = training.model.importances(spark).collect()
    assert len(top) == 30 and [r["importance"] for r in top] == sorted((r["importance"] for r in top), reverse=True)
    assert any(r["feature"].startswith("kw_") for r in top)


def test_scores_only_the_unknown(reports, training):
    scored = score_unknown(training.model, reports)
    assert scored.count() == 100
    right = scored.join(reports, "id").where(F.col("truth") == scored["predicted_severity"]).count()
    assert right > 95
    assert score_unknown(training.model, reports.where("severity_label <> 'Unknown'")).count() == 0


def test_filling_in_place_equals_the_join(reports, training):
    filled = fill_unknown(training.model, reports)
    cols = ["predicted_severity", "prediction_confidence"]
    joined = backfill(reports.drop(*cols), score_unknown(training.model, reports), "id", cols)
    assert filled.select(*joined.columns).exceptAll(joined).count() == 0 and filled.count() == joined.count()
    assert "Exchange" not in filled._jdf.queryExecution().executedPlan().toString().replace("InMemory", "")


def test_model_survives_storage(spark, reports, training, tmp_path):
    training.model.save(spark, str(tmp_path))
    again = SeverityModel.load(spark, str(tmp_path))
    assert score_unknown(again, reports).exceptAll(score_unknown(training.model, reports)).count() == 0
    with pytest.raises(FileNotFoundError, match="settings"):
        SeverityModel.load(spark, str(tmp_path / "nothing"))


def test_too_few_rows(reports):
    with pytest.raises(ValueError, match="insufficient"):
        train_severity(reports.where("id < 60"))


def test_boosted(reports):
    boosted = train_severity(reports, kind="boosted", max_rounds=3, max_depth=3, max_features=50)
    assert boosted.metrics.first()["accuracy"] > 0.9 and boosted.model.model_type == "GBTClassifier"
    assert len(boosted.model.trees) == 4
    with pytest.raises(ValueError, match="kind"):
        train_severity(reports, kind="other")


def test_training_job(spark, reports, tmp_path):
    out = str(tmp_path)
    train_and_score(reports.drop("truth"), out, 3, num_trees=10, max_features=60)
    _, filled = train_and_score(reports.drop("truth"), out, 3, num_trees=10, max_features=60)
    assert filled.count() == 900
    assert filled.where("predicted_severity is not null").count() == 100
    stored = read_runs(spark, f"{out}/model_metrics").collect()
    assert len(stored) == 1
    row = stored[0]
    assert row["run_id"] == 3 and row["n_estimators"] == 10 and len(row["classification_report"]) == 4
    assert len(row["confusion_matrix"]) == 16 and len(row["feature_importances"]) == 30
    assert row["training_samples"] + row["test_samples"] < 800


def test_cluster_job_and_prompts(spark, reports, tmp_path):
    out = str(tmp_path)
    stored, clusters = build_clusters(reports.drop("truth"), out, 5)
    assert stored.count() == 900 and stored.where("cluster_id is null or proj_x is null").count() == 0
    found = clusters.where("cluster_label >= 0").collect()
    assert found and all(r["incident_count"] >= 15 and r["run_id"] == 5 for r in found)
    assert clusters.agg(F.sum("incident_count")).first()[0] == 900
    assert read_runs(spark, f"{out}/coordinates").count() == 900
    prompts, cluster_prompts = prepare_prompts(stored, clusters, out, 5, limit=40)
    assert read_runs(spark, prompts).count() == 40
    assert read_runs(spark, cluster_prompts).count() == len(found)
    extracted = extract_offline(stored, out, 5)
    assert extracted.where("extracted_cause_category is null").count() == 0
    assert extracted.where("extracted_cause_category = 'Structural'").count() > 100
    header = dashboard_header(stored, clusters, spark.createDataFrame([], "run_id long, accuracy double, f1_weighted double")).first()
    assert header["total_clusters"] == len(found) and header["accuracy"] == 0.0
    sections = dashboard_summary(stored).first()
    assert all(sections[c] for c in ("overview", "yearly", "severity", "decade"))


def test_backfill(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], "id long, x string, cluster_id int")
    updates = spark.createDataFrame([(1, None), (3, 9), (4, 7)], "id long, cluster_id int")
    got = {r["id"]: (r["x"], r["cluster_id"]) for r in backfill(df, updates, "id", ["cluster_id"]).collect()}
    assert got == {1: ("a", None), 2: ("b", 2), 3: ("c", 9)}


def test_failed_replacement_keeps_the_first_version(spark, tmp_path):
    path = str(tmp_path / "t")
    replace_table(spark.range(3), path)
    with pytest.raises(Exception, match="broken"):
        replace_table(spark.range(5).select(F.raise_error(F.lit("broken")).cast("long").alias("id")), path)
    assert read_table(spark, path).count() == 3
    replace_table(read_table(spark, path).where("id > 0"), path)
    assert sorted(r["id"] for r in read_table(spark, path).collect()) == [1, 2]


def test_doubled_updates_give_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    updates = spark.createDataFrame([(1, "p", 5), (1, "q", 4), (1, "q", 4)], "id long, y string, order int")
    assert {(r["id"], r["y"]) for r in backfill(df, updates, "id", ["y"]).collect()} == {(1, "p"), (2, None)}
    assert backfill(df, updates.drop("order"), "id", ["y"]).where("id = 1").collect()[0]["y"] == "q"


def test_medians_end_on_any_values(spark):
    wide = [10.0 ** (3 * k) for k in range(100)] + [-(10.0 ** (3 * k)) for k in range(50)]
    rows = [(v,) for v in wide] + [(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (1.7e308,), (-1.7e308,)]
    df = spark.createDataFrame(rows, "v double")
    assert fit_medians(df, ["v"]) == {"v": statistics.median([*wide, 1.7e308, -1.7e308])}
