"""Words as numbers against the regex, and vectors from packs against Spark's assembler."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from incidentlake.operators import text as X
from incidentlake.operators import words as W
from incidentlake.session import cut_lineage, drop_cut
from pyspark.ml.feature import Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

PIECES = ["fire", "a", "é", "ß", "été", "ΣΑΣ", "日本", "日", "😀", "𝐀𝐁", "𝐀", "_", "_x", "x_1", "٣٤", "Ⅷ", "½x", "́", "ée", "the", " ", " ", "  ", ",", "-", "\0", "\n", " ", "ª", "ǅ"]
STOP = ("the", "été")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 3 > 0], None if i % 17 == 0 else "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))) for i in range(400)]
    return spark.createDataFrame(rows, "id long, part string, text string").repartition(3).cache()


def listed(words: pa.LargeListArray) -> list[list[str]]:
    return words.cast(pa.large_list(pa.string())).to_pylist()


@pytest.mark.parametrize("stop", [(), STOP])
def test_words_are_those_of_the_regex(spark, texts, stop):
    rows = texts.select(F.lower("text").alias("low"), X.tokens(F.col("text"), stop).alias("words")).collect()
    ranges = W.word_ranges(spark)
    column = pa.array(["zz", *[r["low"] for r in rows], "zz"], pa.string())[1:-1]
    assert listed(W.words_of(column, ranges, stop)) == [r["words"] for r in rows]
    assert listed(W.words_of(column[:0], ranges, stop)) == []
    assert listed(W.words_of(pa.array(["", None], pa.string()), ranges, stop)) == [[], []]


def test_letters_and_digits_are_those_of_the_session(spark):
    first, last = W.word_ranges(spark)
    points = [p for p in [*range(128, 0x3000), *range(0xFF00, 0x10400), 0x1F600, 0x20000, 0x10FFFF] if not 0xD800 <= p < 0xE000]
    got = [bool(((first <= p) & (p <= last)).any()) for p in points]
    want = spark.createDataFrame([(chr(p),) for p in points], "c string").select(F.col("c").rlike(r"[\p{L}\p{N}]")).collect()
    assert got == [r[0] for r in want]


def test_packs_hold_rows_in_their_order(spark, texts, monkeypatch):
    monkeypatch.setattr(W, "PACK_BYTES", 60)
    low = texts.select("id", "part", F.lower("text").alias("_text"))
    packs = W.word_packs(low, "_text", "part", STOP)
    got = W.from_packs(packs, lambda rows: (pa.RecordBatch.from_arrays([r.column(0), r.column(1), r.column(2).cast(pa.large_list(pa.string())).cast(pa.list_(pa.string()))], names=["id", "part", "words"]) for r in rows),
                       "id long, part string, words array<string>", "id", "part", "words")
    # of each part, the rows of a partition stay in their order
    key = [F.spark_partition_id().alias("p"), "id", "part"]
    for part in "ab":
        a = [tuple(r) for r in got.where(F.col("part") == part).select(*key, "words").collect()]
        b = [tuple(r) for r in texts.where(F.col("part") == part).select(*key, X.tokens(F.col("text"), STOP)).collect()]
        assert a == b and a
    assert {r["part"]: r["n"] for r in packs.groupBy("part").agg(F.sum("n").alias("n")).collect()} == {"a": 134, "b": 266}
    assert packs.count() > 100


@pytest.mark.parametrize(("limit", "most"), [(3, 1 << 24), (40, 1 << 24), (500, 1 << 24), (40, 0)])
def test_packed_vocabulary_equals_that_of_the_words(spark, texts, monkeypatch, limit, most):
    monkeypatch.setattr(W, "MOST_PAIRS", most)
    low = texts.select("id", "part", F.lower("text").alias("_text"))
    got = X.fit_packed_tfidf(W.word_packs(low, "_text", "part", STOP), limit, stop_words=STOP)
    want = X.fit_tfidf(texts, "text", limit, stop_words=STOP)
    assert sorted(map(tuple, got.vocabulary.collect())) == sorted(map(tuple, want.vocabulary.collect()))


@pytest.mark.parametrize("most", [1 << 24, 0])
def test_vectors_equal_those_of_the_assembler(spark, monkeypatch, most):
    monkeypatch.setattr(W, "MOST_PAIRS", most)
    rng, names = random.Random(8), ["fire", "wing", "fire wing", "gear", "gear gear", "wing fire"]
    terms, size = [(t, 1 + i / 7) for i, t in enumerate(names)], 8
    rows = []
    for i in range(300):
        words = [rng.choice(["fire", "wing", "gear", "other"]) for _ in range(rng.randrange(14))] if i % 5 else []
        tf = [0.0] * size
        for j, t in enumerate(names):
            n = sum(" ".join(words[k:k + 1 + t.count(" ")]) == t for k in range(len(words)))
            tf[j] = (1 + float(np.log(float(n)))) * terms[j][1] if n else 0.0
        rows.append((i, words, [rng.choice([0.0, 1.0, 2.5, None]), *[float(i % 4 > 2)] * 3], tf))
    df = spark.createDataFrame([(i, [2.0 if x is None else x for x in v], tf) for i, _, v, tf in rows], "id long, v array<double>, tf array<double>")
    unit = Normalizer(p=2.0, inputCol="t", outputCol="u").transform(df.select("id", array_to_vector("v").alias("f"), array_to_vector("tf").alias("t")))
    want = [r[0] for r in VectorAssembler(inputCols=["f", "u"], outputCol="o").transform(unit).orderBy("id").select("o").collect()]
    words = W.words_of(pa.array([" ".join(w) for _, w, _, _ in rows], pa.string()), W.word_ranges(spark))
    values = np.ma.MaskedArray([[math.nan if x is None else x for x in v] for _, _, v, _ in rows], [[x is None for x in v] for _, _, v, _ in rows])
    got = W.Assembler(terms, size, {0: 2.0}).vectors(words, values).to_pylist()
    assert {type(w).__name__ for w in want} == {"SparseVector", "DenseVector"}
    for g, w in zip(got, want, strict=True):
        assert g["values"] == w.values.tolist() and (g["type"] == 1 or (g["size"], g["indices"]) == (w.size, w.indices.tolist()))
        assert (g["type"] == 1) == (type(w).__name__ == "DenseVector")
    with pytest.raises(ValueError, match="no value"):
        W.Assembler(terms, size, {}).vectors(words, values)


def test_spent_tables_leave_no_files(spark):
    kept = cut_lineage(spark.range(10))
    path = kept._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path)
    drop_cut(kept)
    assert not os.path.exists(path)
