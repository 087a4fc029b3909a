import pytest
from pyspark.sql import functions as F

from incidentlake import (
    apply_cluster_replies,
    apply_replies,
    cluster_prompts,
    extraction_prompts,
    parse_cluster_replies,
    parse_replies,
)
from incidentlake.functions import replies as R
from incidentlake.functions import vocab

GOOD = '{"cause_category":"Fire","phase_of_flight":"cruise","contributing_factors":["a"],"is_human_error":true}'
FENCE = "`" * 3


@pytest.mark.parametrize("raw, cause", [
    (GOOD, "Fire"),
    (f"{FENCE}json\n{GOOD}\n{FENCE}", "Fire"),
    (f"{FENCE}\n{GOOD}\n{FENCE}", "Fire"),
    (f"Sure: {GOOD} - done", "Fire"),
    ("not JSON", "Unknown"),
    ("{broken", "Unknown"),
    ('["Fire"]', "Unknown"),
    ("", "Unknown"),
    (None, "Unknown"),
    (f"{GOOD} and {GOOD}", "Unknown"),
])
def test_reply_forms(spark, raw, cause):
    row = parse_replies(spark.createDataFrame([(raw,)], "reply string")).first()
    assert row["cause_category"] == cause
    if cause == "Fire":
        assert row["phase_of_flight"] == "Cruise" and row["contributing_factors"] == ["a"] and row["is_human_error"]
    else:
        assert row["contributing_factors"] == [] and not row["is_human_error"]


@pytest.mark.parametrize("raw, want", [
    ("Pilot Error", "Human Error"), ("weather, fire", "Weather"), ("sabotage", "Unknown"), ("mechanical|fire", "Mechanical"),
    ("", "Unknown"), (None, "Unknown"), ("x | human ERROR", "Human Error"), ("Structural failure", "Structural"),
])
def test_causes(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(R.normal_cause(F.col("c"))).first()[0] == want


def test_phases(spark):
    df = spark.createDataFrame([("taxi",), ("approach",), ("hold, LANDING",)], "c string")
    assert [r[0] for r in df.select(R.normal_phase(F.col("c"))).collect()] == ["Unknown", "Approach", "Landing"]


def test_lists(spark):
    items = ["a", "", None, " b ", "c", "d", "e", "f", "g"]
    df = spark.createDataFrame([(items,), (None,)], "x array<string>")
    assert [r[0] for r in df.select(R.clean_list(F.col("x"), 5)).collect()] == [["a", "b", "c", "d", "e"], []]
    reply = '{"root_cause_summary": " s ", "key_contributing_factors": ["1","2","3","4","5","6","7"], "recommendations": null}'
    row = parse_cluster_replies(spark.createDataFrame([(reply,)], "reply string")).first()
    assert (row["root_cause_summary"], len(row["key_contributing_factors"]), row["recommendations"]) == ("s", 6, "")
    row = parse_cluster_replies(spark.createDataFrame([('{"key_contributing_factors": "none"}',)], "reply string")).first()
    assert row["key_contributing_factors"] == []


@pytest.mark.parametrize("raw, want", [
    ('["a", "b"]', ["a", "b"]), ('"one"', ["one"]), ("5", ["5"]), ("first\n second \n\n", ["first", "second"]),
    ("a, b,", ["a", "b"]), ("word", ["word"]), ("12 monkeys", ["12 monkeys"]), ("5, 6", ["5", "6"]), ("", []), (None, []),
    ("null", []), ("a\nb, c", ["a", "b, c"]),
])
def test_factor_field(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(R.factor_list(F.col("c"))).first()[0] == want


def test_extraction_prompts(spark):
    rows = [(1, "  " + "x" * 900, None, 3.0), (2, "   ", None, 9.0), (3, "short {summary}", None, None), (4, "done", "Fire", 9.0)]
    df = spark.createDataFrame(rows, "id long, summary string, extracted_cause_category string, fatalities double")
    got = {r["id"]: r["prompt"] for r in extraction_prompts(df, chars=800).collect()}
    assert set(got) == {1, 3}
    assert "x" * 900 in extraction_prompts(df).where("id = 1").first()["prompt"]
    assert got[1].count("x" * 800) == 1 and "x" * 801 not in got[1]
    assert "INCIDENT REPORT:\nshort {summary}\n\nJSON response:" in got[3]
    assert extraction_prompts(df, 0).count() == 0
    assert {r["id"] for r in extraction_prompts(df, 2).collect()} == {1}


def test_cluster_prompts(spark):
    stats = spark.createDataFrame(
        [(0, 20, 0.3125, "Fatal", ["Op"] * 60, [], 1950, 1960), (1, 15, None, "Minor", ["B"], ["C"], None, None), (-1, 9, 0.5, "x", [], [], 1, 2)],
        "cluster_label int, incident_count long, avg_fatality_rate double, dominant_severity string, top_operators array<string>,"
        " top_aircraft_types array<string>, year_range_start int, year_range_end int",
    )
    rows = [(i, 0, float(i), f"Report {i} " + "y" * (400 if i == 19 else 5)) for i in range(20)] + [(99, -1, 1.0, "noise")]
    df = spark.createDataFrame(rows, "id long, cluster_id int, fatalities double, summary string")
    got = {r["cluster_label"]: r for r in cluster_prompts(stats, df, sample_chars=vocab.SAMPLE_CHARS, name_chars=vocab.NAME_LIST_CHARS).collect()}
    assert set(got) == {0, 1}
    text = got[0]["prompt"]
    assert "CLUSTER PROFILE (20 incidents, 1950-1960)" in text and "fatality rate: 31.2%" in text
    assert "[1] Report 19 " in text and "...\n\n[2] Report 18" in text and "[12] Report 8 " in text and "[13]" not in text
    assert "aircraft types: Various" in text
    operators = text.split("Common operators: ")[1].split("\n")[0]
    assert len(operators) == vocab.NAME_LIST_CHARS
    assert got[1]["prompt"] is None and got[1]["default_summary"].startswith("Cluster 1 contains")
    assert got[1]["default_recommendations"] == vocab.NO_TEXT_RECOMMENDATION


def test_apply(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "Fire")], "id long, summary string, extracted_cause_category string")
    replies = spark.createDataFrame([(1, "nonsense")], "id long, reply string")
    got = {r["id"]: r for r in apply_replies(df, replies).collect()}
    assert got[1]["extracted_cause_category"] == "Unknown" and got[1]["extracted_at"] is not None
    assert got[1]["extracted_contributing_factors"] == []
    assert got[2]["extracted_cause_category"] == "Fire" and got[2]["extracted_at"] is None

    clusters = spark.createDataFrame([(0, 5), (1, 6)], "cluster_label int, incident_count long")
    answer = spark.createDataFrame([(0, '{"root_cause_summary": "why"}')], "cluster_label int, reply string")
    got = {r["cluster_label"]: r for r in apply_cluster_replies(clusters, answer).collect()}
    assert got[0]["root_cause_summary"] == "why" and got[0]["summarized_at"] is not None
    assert got[1]["root_cause_summary"] is None


def test_one_reply_per_key_and_blank_reports(spark):
    df = spark.createDataFrame([(1, "a", None), (2, " \t\n", None), (3, None, None)], "id long, summary string, extracted_cause_category string")
    replies = spark.createDataFrame([(1, '{"cause_category": "fire\\n"}', 2), (1, '{"cause_category": "weather"}', 1)], "id long, reply string, order int")
    got = {r["id"]: r["extracted_cause_category"] for r in apply_replies(df, replies).collect()}
    assert got == {1: "Fire", 2: "Unknown", 3: None}
    assert apply_replies(df, replies.drop("order")).count() == 3
