import resource

import numpy as np
from conftest_llm import SF
from incidentlake.llm import common, language, quality
from incidentlake.llm.queries import QUERIES


def test_held_out_languages(spark, docs):
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op1_language_mixture"](spark, SF).collect() if r["held_out"]]
    assert len(rows) > 20
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 and abs(sum(r["shares"].values()) - 1) < 1e-6 for r in rows)


def test_odd_rows_have_a_language(odd, none):
    model = language.train(odd)
    rows = [(r["id"], r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()]
    assert len(rows) == 10 and {r[1] for r in rows if r[0] in (2, 3, 4, 5)} == {"und"}
    assert {r[1] for r in rows if r[0] == 6} == {"de"} and all(r[2] == 0 for r in rows if r[1] == "und")
    assert language.predict(none, model).count() == 0
    unknown = language.train(none)
    assert {r["lang_pred"] for r in language.predict(odd, unknown).collect()} == {"und"}


def test_mixture_is_the_best_found_by_a_grid():
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(40), 3).T)
    counts = rng.multinomial(400, np.exp(logs) @ np.array([0.55, 0.45, 0.0]))
    shares, gain = language.mixtures(np.zeros(40, np.int64), logs, counts, 1, penalty=1.0)
    grid = [(a, b, 1 - a - b) for a in np.linspace(0, 1, 51) for b in np.linspace(0, 1 - a, 51)]
    best = max(counts @ np.log(np.exp(logs) @ np.array(g)) - 0.5 * np.log(400) * (sum(x > 1e-9 for x in g) - 1) for g in grid)
    single = max(counts @ logs)
    assert shares[0, 2] == 0 and abs(shares[0].sum() - 1) < 1e-9
    assert gain[0] + single >= best - 0.2


def test_quality_separates_held_out_rows(spark):
    rows = QUERIES["op2_compression_quality"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    good = [r["score"] for r in rows if r["held_out"] and truth.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if r["held_out"] and truth.get(r["doc_id"]) == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (8, 1), (6, 0), (7, 0), (None, 1), (3, None), (3, 0)], "doc_id long, quality int")
    model = quality.train(odd, labels)
    rows = quality.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["id"] in (2, 3)}) == 1
    assert quality.score(none, model).count() == 0
    alone = quality.train(odd, labels.where("quality = 1"))
    assert len({r["score"] for r in quality.score(odd, alone).collect()}) == 1


def test_a_sample_is_never_empty():
    for rows in (1, 3999, 10**6, 10**11, 10**15):
        share = common.share_of(4000, rows)
        assert 0 < share <= common.PLACES and share * rows >= min(rows, 4000) * common.PLACES
    assert common.share_of(4000, 10) == common.PLACES


def test_short_texts_take_little_memory():
    letters = language.letters_table()
    texts = [f"some words {i}"[:20] for i in range(10_000)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    slices = list(common.chunks(texts))
    for a, b in slices:
        language.trigram_counts(texts[a:b], letters)
    assert [a for a, _ in slices[1:]] == [b for _, b in slices[:-1]] and slices[-1][1] == len(texts)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000
