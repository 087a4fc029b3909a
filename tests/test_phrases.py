"""Phrases looked for together against tests one by one."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from incidentlake.functions import columns as C
from incidentlake.functions import phrases as P
from incidentlake.functions import vocab
from incidentlake.operators.features import SEARCHED, build_features
from incidentlake.plans.catalog import stored_metrics


@pytest.mark.parametrize("step", [7, 64, P.STEP])
def test_phrases_are_those_of_single_tests(monkeypatch, step):
    monkeypatch.setattr(P, "STEP", step)
    rng = random.Random(step)
    phrases = ["abc", "abca", "bca b", "é a", "aaa", "zzz", "a b c a"]
    texts = ["", "abc", "ab", "c", "aaaa", None] + ["".join(rng.choice("abc é") for _ in range(rng.randrange(40))) for _ in range(300)]
    wanted = [p.encode() for p in phrases]
    for column in (pa.array(texts), pa.array(texts).slice(3, 200), pa.chunked_array([texts]).combine_chunks().slice(5), pa.array([], pa.string()), pa.array([""])):
        got = P.found_in(column, wanted).tolist()
        assert got == [sum(1 << i for i, p in enumerate(phrases) if p in (t or "")) for t in column.to_pylist()]


def test_features_are_those_of_patterns_one_by_one(spark):
    rng = random.Random(5)
    pieces = [w for how in SEARCHED.values() for p in how[0].values() for w in C.split_pattern(p)[0]] + [
        "None of the crew survived", "all 12 passengers were killed", "both men died", "FIRE", "firearm", "struck the ground", "wing had separated", "in-flight break",
        "no deaths", "no one was killed", "hospitalised", "non-fatal", "Bell 206", "DC-3", "A320", "dhc-8", "ÉTÉ", ""]
    rows = [(i, rng.choice([None, ""]) if i % 9 == 0 else " ".join(rng.choice(pieces) for _ in range(rng.randrange(6))), rng.choice([None, *pieces])) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, summary string, aircraft_type string").repartition(3)
    names = [n for how in SEARCHED.values() for n in how[0]]
    single = [C.flag(C.matches(F.lower(c), p, how[1].get(n, ()))).alias(n) for c, how in SEARCHED.items() for n, p in how[0].items()]
    want, got = df.select("id", *single), build_features(df, "id").select("id", *names)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert all(r[0] for r in want.select(*[F.max(n) > 0 for n in names]).collect())


def test_plain_texts_are_looked_for_in_one_pass(spark):
    df = spark.createDataFrame([], "id long, summary string, aircraft_type string, severity_label string")
    plan = build_features(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "Contains(" not in plan and plan.count("ArrowEvalPython") == 1
    assert set(vocab.SUMMARY_PATTERNS) == set(SEARCHED["summary"][0])


def test_two_stored_runs_read_the_texts_once(spark):
    df = spark.createDataFrame([(i, "no survivors" if i % 3 else "engine failure, crew survived", "Fatal" if i % 2 else "Severe") for i in range(40)],
                               "id long, summary string, severity_label string")
    runs = stored_metrics(df)
    assert [r["test_samples"] for r in runs.orderBy("run_id").collect()] == [40, 40]
    runs.collect()
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or plan.split("Initial Plan")[0].count("ArrowEvalPython") == 1
