import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from incidentlake import embed_text, fit_tfidf, project_2d, reduce_dimensions
from incidentlake.functions import vocab
from incidentlake.operators import text as X

TEXTS = [
    "The engine failed after takeoff, engine fire reported.", "Engine fire. ENGINE fire! The crew escaped",
    "Flugzeug stürzte über München ab; das Flugzeug brannte", "no", "", None, "the of and", "crew error and engine failure",
    "fire fire fire crew crew", "naïve_token 12 a bb engine",
]


def brute_tfidf(texts, max_features=600, min_df=2):
    docs = []
    for t in texts:
        words = [w for w in re.findall(r"\w{2,}", (t or "").lower()) if w not in vocab.STOP_WORDS]
        docs.append(Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])]))
    df, tf = Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        tf.update(d)
    terms = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-tf[t], t))[:max_features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in terms}
    out = {}
    for i, d in enumerate(docs):
        w = {t: (1 + math.log(d[t])) * idf[t] for t in terms if d[t]}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): v / norm for t, v in w.items()})
    return terms, idf, out


@pytest.mark.parametrize("limit", [600, 4])
def test_tfidf(spark, limit):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    terms, idf, want = brute_tfidf(TEXTS, limit)
    model = fit_tfidf(df, "text", limit)
    listed = model.vocabulary.collect()
    assert {r["term"]: r["idf"] for r in listed} == pytest.approx(idf) and set(terms) == set(idf)
    got = {(r["id"], r["term"]): r["weight"] for r in model.weights(df, "id", "text").collect()}
    assert got == pytest.approx(want)
    sizes = {len(r["text_vector"]) for r in model.vectors(df, "text").collect()}
    assert sizes == {limit}


def test_tfidf_save_and_load(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    model = fit_tfidf(df, "text")
    model.save(str(tmp_path / "v"))
    again = type(model).load(spark, str(tmp_path / "v"))
    assert again.terms == model.terms


def test_embedding(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in embed_text(df, "text", 64).collect()}
    assert len(got) == len(TEXTS) and all(len(v) == 64 for v in got.values())
    assert np.linalg.norm(got[0]) == pytest.approx(1.0, abs=1e-6) and np.linalg.norm(got[5]) == 0.0
    assert got[0] @ got[1] > got[0] @ got[2]


def test_embedding_with_an_encoder(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")

    def build():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    got = {r["id"]: r["embedding"] for r in embed_text(df, "text", encoder=build).collect()}
    assert got[3] == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)], abs=1e-6)


def test_components_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * np.array([5, 3, 2, 1, 1, 0.5, 0.5, 0.2])
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, embedding array<double>")
    got = np.array([r["reduced"] for r in reduce_dimensions(df, k=3).orderBy("id").collect()])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    vt = np.linalg.svd(unit - unit.mean(0), full_matrices=False)[2][:3]
    vt *= np.sign(vt[np.arange(3), np.abs(vt).argmax(1)])[:, None]
    assert np.allclose(got, unit @ vt.T, atol=1e-8)
    flat = np.array([[r["proj_x"], r["proj_y"]] for r in project_2d(df).orderBy("id").collect()])
    assert np.allclose(flat, got[:, :2], atol=1e-8)


@pytest.mark.parametrize("frequent", [None, frozenset(["fire", "été", "wing"])])
def test_terms_are_counted_like_single_words_and_pairs(frequent):
    rng = random.Random(3)
    texts = [[rng.choice(["fire", "wing", "été", "a_1", "gear"]) for _ in range(rng.randrange(7))] for _ in range(90)] + [[], ["fire"]]
    want = {}
    for words in texts:
        kept = [w if frequent is None or w in frequent else None for w in words]
        terms = [w for w in kept if w] + [f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False) if a and b]
        for t in terms:
            n, uses = want.get(t, (0, 0))
            want[t] = (n, uses + 1)
        for t in set(terms):
            want[t] = (want[t][0] + 1, want[t][1])
    column = pa.array([["zz"], *texts], pa.large_list(pa.string()))[1:]
    got = X.term_counts(column, frequent).to_pylist()
    assert {r["term"]: (r["texts"], r["uses"]) for r in got} == want and len(got) == len(want)
    assert X.term_counts(column[:0], frequent).num_rows == 0


def test_batches_are_worked_on_in_slices(monkeypatch):
    column = pa.array([["zz"] * 9, ["a"] * 3, ["b"] * 8, [], [], ["c"], ["d"] * 2], pa.large_list(pa.string()))[1:]
    monkeypatch.setattr(X, "STEP_WORDS", 4)
    monkeypatch.setattr(X, "STEP_TEXTS", 2)
    assert [(s.start, s.stop) for s in X.slices(column)] == [(0, 1), (1, 2), (2, 4), (4, 6)]


def test_occurrences_of_terms():
    texts = [["b", "a", "b", "a"], [], ["a", "zz", "b"], ["b"], ["zz"]]
    column = pa.array([["a", "b"], *texts], pa.large_list(pa.string()))[1:]
    got = X.occurrences(column, ["a", "b a", "a q", "b", "a b"], 7)
    assert got.tolist() == [[2, 2, 0, 2, 1, 0, 0], [0] * 7, [1, 0, 0, 1, 0, 0, 0], [0, 0, 0, 1, 0, 0, 0], [0] * 7]
    assert X.occurrences(column, ["q"], 2).sum() == 0 and X.occurrences(column[:0], ["a"], 3).shape == (0, 3)
