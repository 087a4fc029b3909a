import corpus_pipeline
import numpy as np
from incidentlake.llm import contamination, lines
from conftest_llm import SF


def test_every_stage_decides(spark, docs):
    kept, counts = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        last = k == len(corpus_pipeline.STAGES) - 1
        after = stage(spark, kept, SF).cache()
        assert last or after.columns == docs.columns
        counts.append(after.count())
        if k == 1:
            assert lines.line_decisions(after).where("not kept and distance = 0").count() == 0
        if k == 3:
            assert contamination.leaks(after, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
        if last:
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = after
    assert docs.count() >= counts[0] >= counts[1] >= counts[2] >= counts[3] > 0.8 * docs.count()


def test_stages_take_odd_rows(spark, odd, none):
    for first in (odd, none):
        kept = first
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, SF)
        assert (kept.count() > 0) == (first is odd)


def test_language_stage_rejects_what_it_does_not_know(spark, docs):
    rng = np.random.default_rng(0)
    own = {r["lang"]: r["text"] for r in docs.where("length(text) > 1500").orderBy("doc_id").collect()}
    planted = {
        -1: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 3,
        -2: "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. " * 3,
        -3: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan. " * 3,
        -4: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 2000)), -5: "12 !!",
        -11: own["de"][:700] + "\n" + own["fr"][:700], -12: own["en"][:900] + "\n" + own["es"][:400], -13: own["en"][:40], -14: own["de"][100:700]}
    rows = spark.createDataFrame([(i, t, None) for i, t in planted.items()], "doc_id long, text string, lang string")
    kept = corpus_pipeline.identify_language(spark, docs.select("doc_id", "text", "lang").union(rows), SF)
    assert {r["doc_id"] for r in kept.where("doc_id < 0").collect()} == {-11, -12, -13, -14}
    assert kept.where("doc_id >= 0").count() == docs.where(r"text rlike '\\p{L}'").count()


def test_least_share_can_be_missed():
    assert all(1 / n < corpus_pipeline.least_share(n) < 0.4 for n in range(3, 6)) and corpus_pipeline.least_share(2) <= 0.5
