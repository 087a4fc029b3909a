"""Learned text vectors: counts and factors against dense arithmetic, planted synonyms."""

import random
from collections import Counter

import numpy as np
import pytest
from incidentlake.operators import word_vectors as W


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)


def counted(texts, vocabulary, window):
    out = Counter()
    for words in texts:
        for i, a in enumerate(words):
            for b in words[i + 1:i + 1 + window]:
                if a in vocabulary and b in vocabulary:
                    out[tuple(sorted((vocabulary.index(a), vocabulary.index(b))))] += 1
    return out


def dense(pairs, size):
    m = np.zeros((size, size))
    for (a, b), n in pairs.items():
        m[a, b] += n
        m[b, a] += n
    total, margin = m.sum(), m.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.maximum(np.log(m * total / np.outer(margin, margin)), 0), nan=0, posinf=0, neginf=0)


def random_texts(seed=1, n=200):
    rng = random.Random(seed)
    return [[f"w{int(rng.paretovariate(0.8)) % 40:02d}" for _ in range(rng.randrange(25))] for _ in range(n)]


@pytest.mark.parametrize("step", [W.STEP_WORDS, 40])
def test_pairs_and_information_against_brute_force(spark, monkeypatch, step):
    monkeypatch.setattr(W, "STEP_WORDS", step)
    texts = random_texts()
    vocabulary = [f"w{i:02d}" for i in range(30)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ([],)], "words array<string>")
    pairs = W.cooccurrences(df, "words", vocabulary, 3)
    want = counted(texts, vocabulary, 3)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == want
    matrix = np.zeros((30, 30))
    for r in W.mutual_information(pairs).collect():
        matrix[r["i"], r["j"]] = r["value"]
    assert np.allclose(matrix, dense(want, 30))


def test_leading_part_against_dense_factors(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 6)) * np.array([9, 7, 5, 3, 2, 1.5])
    m = base @ np.diag([1, 1, -1, 1, 1, 1]) @ base.T + 0.01 * (lambda x: x + x.T)(rng.normal(size=(60, 60)))
    m[5] = m[:, 5] = 0
    rows = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(60) for j in range(60) if m[i, j]], "i int, j int, value double")
    vectors, values = W.leading_part(rows, 60, 6)
    all_values, all_vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(all_values))[:6]
    assert np.allclose(values, all_values[order])
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, all_vectors[:, order] @ np.diag(all_values[order]) @ all_vectors[:, order].T, atol=1e-3)


def test_planted_synonyms_are_neighbours(spark, tmp_path):
    rng = random.Random(3)
    topics = {k: [f"{k}{i}" for i in range(8)] for k in ("wing", "fire", "fuel", "crew")}
    texts = []
    for _ in range(1500):
        topic = rng.choice(list(topics))
        words = [rng.choice(topics[topic]) for _ in range(9)] + [rng.choice(["plane", "flight"])]
        words[rng.randrange(9)] = rng.choice([f"{topic}same", f"{topic}equal"])  # never side by side, always in the same company
        texts.append(" ".join(words))
    df = frame(spark, texts)
    fitted = W.fit_word_vectors(df, "text", dims=8, stop_words=())
    for topic in topics:
        near = [w for w, _ in fitted.neighbours(f"{topic}same", 4)]
        assert f"{topic}equal" in near[:2] and not any(w.startswith(other) for w in near for other in topics if other != topic)
    fitted.save(spark, str(tmp_path))
    again = W.WordVectors.load(spark, str(tmp_path), ())
    asked = frame(spark, ["wing1 wing2 wingsame", "wingequal wing5", "fire1 fire2", "", None, "unknown words"])
    got = {r["id"]: np.array(r["embedding"]) for r in again.embed(asked, "text").collect()}
    assert got[0] @ got[1] > 0.9 > 0.5 > got[0] @ got[2]
    assert all(np.abs(got[i]).sum() == 0 for i in (3, 4, 5)) and np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-6)
    assert all(np.allclose(got[r["id"]], r["embedding"]) for r in fitted.embed(asked, "text").collect())


def test_odd_tables(spark):
    assert W.fit_word_vectors(frame(spark, []), "text").words == []
    few = W.fit_word_vectors(frame(spark, ["aa bb aa bb", None, ""]), "text", least_uses=1)
    assert few.words == ["aa", "bb"] and few.vectors.shape == (2, 2) and few.neighbours("zz") == []
    alone = W.fit_word_vectors(frame(spark, ["aa", "bb"]), "text", least_uses=1)
    assert alone.embed(frame(spark, ["aa", "x"]), "text").count() == 2
