"""Search over stored postings against a scan of all texts."""

import os
import random

import pytest
from incidentlake.operators import search as S
from incidentlake.sources import postings as P
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["Engine", "ENGINE fire", "straße", "İstanbul", "日本語の", "a", "100%", "under_score", "b\0c", "the end", "ΣΑΣ", "😀😀😀x"]
    rows = []
    for i in range(600):
        text = None if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(9)))
        rows.append((None if i == 7 else i * 311 - 5000, rng.choice(words + [None]), rng.choice(words), None, text))
    rows.append((99_999_999, "x" * 5000 + "needle", "", "", ""))
    df = spark.createDataFrame(rows, "id long, operator string, aircraft_type string, location string, summary string").repartition(4)
    path = str(tmp_path_factory.mktemp("postings"))
    P.write_searchable(df, path)
    return df, path


@pytest.mark.parametrize("escape", [False, True])
@pytest.mark.parametrize("term", ["engine", "Fire Engine", "strasse", "STRASSE", "straße", "i̇stanbul", "本語", "日本語", "100%", "er_s", "r%sc", "en", "%", "", None, "σας",
                                  "😀😀😀X", "e end", "needle", "absent word", "  the END ", "a%b", "end%engine", "b\0c", "xxxxxx"])
def test_matches_are_those_of_a_scan(spark, stored, term, escape):
    df, path = stored
    want = sorted((r["id"] is None, r["id"] or 0) for r in S.by_term(df, term, escape).collect())
    plain = P.term_grams(spark, (term or "").strip(), escape)
    got = sorted((r["id"] is None, r["id"] or 0) for r in P.stored_matches(spark, path, term, escape=escape).collect())
    # a row without a key has no postings: it is found by a scan only
    assert got == (want if not plain else [w for w in want if not w[0]])


def test_only_postings_and_candidate_blocks_are_read(spark, stored, capsys):
    _, path = stored
    P.candidates(spark, path, P.term_grams(spark, "needle", False)).explain("formatted")
    P.stored_matches(spark, path, "needle").explain("formatted")
    plan = capsys.readouterr().out
    scans = [x for x in plan.split("\n\n") if ") Scan parquet" in x]
    assert scans and all("PartitionFilters" in x and ("bucket" in x or "block" in x) for x in scans)
    assert any("PushedFilters: [In(gram" in x or "PushedFilters: [IsNotNull(gram" in x for x in scans)
    assert P.candidates(spark, path, P.term_grams(spark, "needle", False)).collect() == [(99_999_999 // P.SPAN, 99_999_999)]


def test_lists_are_bounded_by_block(spark, stored):
    _, path = stored
    lists = P.read_table(spark, f"{path}/postings")
    assert lists.where(F.size("keys") > P.SPAN).count() == 0
    assert lists.groupBy("gram", "block").count().where("count > 1").count() == 0


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "id long, operator string, aircraft_type string, location string, summary string")
    P.write_searchable(df, str(tmp_path))
    assert P.stored_matches(spark, str(tmp_path), "engine").count() == 0 and P.stored_matches(spark, str(tmp_path), "").count() == 0


def test_grams_of_slices():
    text, gram = P.grams(["abcab", "", "ab", "xabc"])
    code = lambda s: (ord(s[0]) << 42) | (ord(s[1]) << 21) | ord(s[2])
    assert sorted(zip(text.tolist(), gram.tolist(), strict=True)) == sorted([(0, code(g)) for g in ("abc", "bca", "cab")] + [(3, code(g)) for g in ("xab", "abc")])


def test_keys_at_block_borders(spark, tmp_path):
    keys = [-(1 << 40) - 1, -P.SPAN, -1, 0, 1, P.SPAN // 2, P.SPAN - 1, P.SPAN, 1 << 53, (1 << 60) - 1, 1 << 60, 5, 5]
    df = spark.createDataFrame([(k, "an engine" if i % 3 else "a wing") for i, k in enumerate(keys)], "id long, summary string").repartition(3)
    P.write_searchable(df, str(tmp_path))
    for term in ("engine", "wing", "an engine"):
        want = sorted(r["id"] for r in df.where(F.col("summary").contains(term)).collect())
        assert sorted(r["id"] for r in P.stored_matches(spark, str(tmp_path), term).collect()) == want
    # two bytes a key, whatever the key
    assert dict(P.read_table(spark, f"{tmp_path}/postings").dtypes)["keys"] == "array<smallint>"


@pytest.mark.parametrize("few", [0, 1_000])
def test_texts_are_not_moved_to_meet_their_candidates(spark, stored, monkeypatch, few):
    df, path = stored
    monkeypatch.setattr(P, "FEW_KEYS", few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hits = P.stored_matches(spark, path, "engine")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and ("BroadcastHashJoin" in plan) == (few > 0)
        want = S.by_term(df, "engine").where("id is not null").count()
        assert hits.count() == want > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shuffles_of_the_store_are_spent(spark, tmp_path):
    def kept():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return sum(os.path.getsize(f) for f in files if "/shuffle_" in f and os.path.exists(f))

    df = spark.range(2000).select("id", F.concat(F.lit("an engine "), "id", F.sha2(F.col("id").cast("string"), 512)).alias("summary"))
    before, setting = kept(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting)
    P.write_searchable(df, str(tmp_path))
    assert kept() < before + 10_000 and spark.conf.get(setting) == was
    assert P.stored_matches(spark, str(tmp_path), "an engine").count() == 2000


def test_packs_hold_all_rows_and_take_less(spark, monkeypatch):
    monkeypatch.setattr(P, "HELD_BYTES", 1000)
    rows = [(None if i % 7 == 0 else i % 3, None if i % 5 == 0 else f"some text that comes again {i % 4} " * 9, [i, None]) for i in range(500)] * 2
    df = spark.createDataFrame(rows, "block long, text string, more array<int>").repartition(3).cache()
    packs = P.packed(df, "block")
    got = P.unpacked(packs.repartition(2, "block"), df.schema)
    assert got.schema == df.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, df.collect()))
    assert packs.agg(F.sum(F.length("rows"))).first()[0] < df.agg(F.sum(F.length("text"))).first()[0] / 2
    assert P.packed(df.limit(0), "block").count() == 0
    df.unpersist()


def test_lists_of_packs_are_merged(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(-P.SPAN, 2 * P.SPAN), rng.choice([1, 5, 1 << 62])) for _ in range(3000)]
    pairs += pairs[:500] + [(k, 9) for k in (-P.SPAN, -1, 0, P.SPAN - 1)]
    parts = [P.lists_of(P.np.array([k for k, _ in p]), P.np.array([g for _, g in p])) for p in (pairs[:1000], pairs[1000:1001], pairs[1001:])]
    lists = spark.createDataFrame([r for p in parts for r in p.to_pylist()], "gram long, block long, keys array<smallint>").withColumn("bucket", F.lit(3)).repartition(3)
    got = P.packed(lists, "bucket", "block").groupBy("bucket", "block").applyInArrow(P.merged_lists, P.POSTINGS).collect()
    want = {}
    for k, g in set(pairs):
        want.setdefault((g, k // P.SPAN), []).append(k % P.SPAN - P.SPAN // 2)
    assert {(r["gram"], r["block"]): r["keys"] for r in got} == {x: sorted(v) for x, v in want.items()}
    assert len(got) == len(want) and {r["bucket"] for r in got} == {3}


def test_folders_are_those_of_the_search(spark):
    gram = [0, 1, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, *(random.Random(1).getrandbits(63) for _ in range(500))]
    want = spark.createDataFrame([(g,) for g in gram], "gram long").select(F.pmod(F.xxhash64("gram"), F.lit(P.BUCKETS)).cast("int")).collect()
    assert P.bucket_of(P.np.array(gram)).tolist() == [r[0] for r in want]


@pytest.mark.parametrize(("most", "cells"), [(P.MOST_CELLS, P.CELLS), (P.MOST_CELLS, 0), (0, 0)])
def test_grams_on_a_grid_and_sorted(monkeypatch, most, cells):
    monkeypatch.setattr(P, "MOST_CELLS", most)
    monkeypatch.setattr(P, "CELLS", cells)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc\0é日😀") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "a", "ab", ""]
    gram, size, text = P.gram_lists(texts)
    want = {((ord(t[j]) << 42) | (ord(t[j + 1]) << 21) | ord(t[j + 2]), i) for i, t in enumerate(texts) for j in range(len(t) - 2)}
    assert list(zip(P.np.repeat(gram, size).tolist(), text.tolist(), strict=True)) == sorted(want)
    assert [len(x) for x in P.gram_lists(["", "ab"])] == [0, 0, 0]


def test_lists_of_a_block_without_a_sort():
    rng = random.Random(6)
    steps = [P.gram_lists(["".join(rng.choice("abcd") for _ in range(rng.randrange(9))) for _ in range(50)]) for _ in range(3)]
    steps = [(g, n, -P.SPAN + 50 * i + t) for i, (g, n, t) in enumerate(steps)]
    got = P.lists_in_block(-1, steps).to_pylist()
    want = P.lists_of(P.np.concatenate([k for _, _, k in steps]), P.np.concatenate([P.np.repeat(g, n) for g, n, _ in steps])).to_pylist()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(want) > 20
    folders = P.bucket_of(P.np.array([r["gram"] for r in got])).tolist()
    assert folders == sorted(folders)
