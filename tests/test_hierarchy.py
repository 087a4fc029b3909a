"""Vector clusters: planted groups, and a version that works top-down over all pairs."""

import math
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from incidentlake import vector_clusters
from incidentlake.operators import hierarchy as H
from incidentlake.plans.catalog import QUERIES
from incidentlake.session import cut_lineage
from pyspark.sql import functions as F


def clusters(spark, vectors, size, *args, **kw):
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    return {r["id"]: r["cluster_id"] for r in vector_clusters(df, "v", size, *args, **kw).collect()}


def rand_index(a, b):
    pairs = lambda counts: sum(comb(x, 2) for x in counts.values())
    both, one, two = pairs(Counter(zip(a, b, strict=True))), pairs(Counter(a)), pairs(Counter(b))
    expected = one * two / comb(len(a), 2)
    return (both - expected) / ((one + two) / 2 - expected)


def planted(groups, each, size, spread, noise=0, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, size))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.concatenate([rng.normal(c, spread, size=(each, size)) for c in centres] + [rng.uniform(-1, 1, size=(noise, size))])
    return {i: x.tolist() for i, x in enumerate(rows)}, [g for g in range(groups) for _ in range(each)] + [-1] * noise


@pytest.mark.parametrize(("groups", "each", "spread", "noise", "leaf"), [
    (5, 300, 0.1, 300, 1024), (5, 300, 0.06, 300, 1024), (20, 100, 0.1, 0, 1024), (5, 300, 0.1, 0, 400)])
def test_planted_groups_come_back(spark, monkeypatch, groups, each, spread, noise, leaf):
    monkeypatch.setattr(H, "LEAF", leaf)
    vectors, truth = planted(groups, each, 50, spread, noise)
    found = clusters(spark, vectors, 50)
    assert rand_index([found[i] for i in range(len(truth))], truth) >= 0.95
    assert Counter(found.values())[-1] >= 0.95 * noise


def brute(vectors, size, min_samples, min_size, single=False):
    """All pairs, components at each level by search, clusters from the top down."""
    spots = defaultdict(list)
    for i, v in vectors.items():
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            spots[tuple(v)].append(i)
    points = list(spots)
    rows = [len(spots[p]) for p in points]
    n = len(points)
    d = np.array([[float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())) for b in points] for a in points]).reshape(n, n)
    core = []
    for i in range(n):
        near = sorted([0.0] * (rows[i] - 1) + [d[i, j] for j in range(n) if j != i for _ in range(rows[j])])
        core.append(near[min_samples - 1] if len(near) >= min_samples else np.inf)
    level = np.array([[int(H.level_of(np.array([max(core[i], core[j], d[i, j])]))[0]) if max(core[i], core[j]) < np.inf else 10**9 for j in range(n)]
                      for i in range(n)]).reshape(n, n)
    known = sorted({int(level[i, j]) for i in range(n) for j in range(i) if level[i, j] < 10**9})
    least = min((x for x in known if x > H.ZERO), default=0) - H.STEPS
    level = np.maximum(level, least)
    known = sorted({max(x, least) for x in known})

    def parts(inside, at):
        if at is None:
            return [[i] for i in inside]
        left, out = set(inside), []
        while left:
            stack, part = [left.pop()], []
            while stack:
                i = stack.pop()
                part.append(i)
                more = [j for j in left if level[i, j] <= at]
                left -= set(more)
                stack += more
            out.append(part)
        return out

    weigh = lambda at: 2.0 ** (-(least if at is None else at) / H.STEPS)
    total = lambda part: sum(rows[i] for i in part)

    def follow(part, k, birth):
        """(excess of mass, chosen clusters) of the cluster that is ``part`` at level number k."""
        mass, now, whole = 0.0, part, list(part)
        while True:
            at = known[k] if k >= 0 else None
            inner = [x for x in parts(now, known[k - 1] if k > 0 else None) if total(x) >= min_size] if k >= 0 else []
            if len(inner) == 1:
                mass += (total(now) - total(inner[0])) * (weigh(at) - birth)
                now, k = inner[0], k - 1
                continue
            mass += total(now) * (weigh(at) - birth)
            below = [follow(x, k - 1, weigh(at)) for x in inner]
            if mass >= sum(b[0] for b in below):
                return mass, [whole]
            return sum(b[0] for b in below), [c for b in below for c in b[1]]

    def below(part, k):
        """Chosen clusters inside the one that holds all."""
        if k < 0:
            return []
        inner = [x for x in parts(part, known[k - 1] if k > 0 else None) if total(x) >= min_size]
        return below(inner[0], k - 1) if len(inner) == 1 else [c for x in inner for c in follow(x, k - 1, weigh(known[k]))[1]]

    tops = [p for p in parts(range(n), known[-1] if known else None) if total(p) >= min_size]
    chosen = below(tops[0], len(known) - 1) if len(tops) == 1 and not single else [c for p in tops for c in follow(p, len(known) - 1, 0.0)[1]]
    ids = sorted(([i for p in part for i in spots[points[p]]] for part in chosen), key=lambda m: (-len(m), min(m)))
    label = {i: k for k, m in enumerate(ids) for i in m}
    return {i: label.get(i, -1) for i in vectors}


def cases():
    rng = np.random.default_rng(5)
    blobs = {i: x.tolist() for i, x in enumerate(np.concatenate([rng.normal(c, s, size=(m, 3)) for c, s, m in (
        (0, 0.3, 60), (1.5, 0.2, 50), (6, 0.5, 70), (6.8, 0.05, 30), (-5, 2.0, 40), (20, 0.1, 9))]))}
    spots = dict(blobs) | {1000 + i: [9.0, 9.0, 9.0] for i in range(40)} | {2000 + i: [0.0, 0.0, 0.0] for i in range(8)} | {3000: None, 3001: [1.0, 2.0], 3002: [1.0, float("nan"), 2.0]}
    two = {i: [float(i % 2)] * 3 for i in range(60)}
    chain = {i: [i * 0.1, 0.0, 0.0] for i in range(60)}
    few = {i: [float(i), 0.0, 0.0] for i in range(4)}
    return {"blobs": blobs, "spots": spots, "two": two, "chain": chain, "few": few, "one": {i: [1.0, 1.0, 1.0] for i in range(30)}}


@pytest.mark.parametrize("name", list(cases()))
@pytest.mark.parametrize("single", [False, True])
def test_clusters_against_brute_force(spark, name, single):
    vectors = cases()[name]
    want = brute(vectors, 3, 4, 12, single)
    assert clusters(spark, vectors, 3, 4, 12, single=single) == want
    if name in ("blobs", "spots", "two") and not single:
        assert len(set(want.values())) > 1


@pytest.mark.parametrize("name", ["spots", "two"])
def test_levels_by_joins_give_the_same(spark, monkeypatch, name):
    vectors = cases()[name]
    monkeypatch.setattr(H, "STEPS", 2)
    want = brute(vectors, 3, 4, 12)
    monkeypatch.setattr(H, "FEW_LINKS", 0)
    monkeypatch.setattr(H.chosen_clusters, "__defaults__", (0,))
    assert clusters(spark, vectors, 3, 4, 12) == want and len(set(want.values())) > 1


def test_leaves_are_bounded_and_whole(spark, monkeypatch):
    monkeypatch.setattr(H, "LEAF", 50)
    rng = np.random.default_rng(1)
    rows = [(i, 1, rng.normal(size=4).tolist()) for i in range(2000)] + [(i, 1, [1.0] * 4) for i in range(2000, 2300)]
    points = spark.createDataFrame(rows, "node long, n long, vector array<double>")
    got = H.leaves(points, 4)
    assert got.groupBy("tree", "leaf").count().agg(F.max("count")).first()[0] <= 60
    assert got.groupBy("tree").agg(F.countDistinct("node").alias("k"), F.count("*").alias("n")).where("k <> 2300 or n <> 2300").count() == 0


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert vector_clusters(df, "v", 3).count() == 0
    rows = spark.createDataFrame([(i, [float(i % 2)] * 3) for i in range(60)], "id long, v array<float>").withColumns(
        {c: F.lit("clash") for c in ("node", "n", "cell", "vector", "level", "cluster_id")})
    got = vector_clusters(rows, "v", 3)
    assert set(got.columns) == set(rows.columns) and {r["cluster_id"] for r in got.collect()} == {0, 1}


def test_named_query_against_brute_force(spark, sf_dir):
    vectors = {r["vec_id"]: [float(x) for x in r["embedding"]] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(250).collect()}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["cluster_id"] for r in vector_clusters(df, "embedding", 64, key="vec_id").collect()}
    assert got == brute(vectors, 64, 5, 15)
    assert QUERIES["embedding_groups"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_thinned_links_connect_the_same(spark):
    rng = np.random.default_rng(6)
    links = {}
    for a, b, level in zip(rng.integers(0, 300, 2500).tolist(), rng.integers(0, 300, 2500).tolist(), rng.integers(-5, 12, 2500).tolist(), strict=True):
        if a != b and (a < 200) == (b < 200):
            links.setdefault((min(a, b), max(a, b)), level)
    df = spark.createDataFrame([(a, b, x) for (a, b), x in links.items()], "a long, b long, level int")

    def parts(rows, at):
        low = list(range(300))
        for a, b, level in rows:
            if level <= at and low[a] != low[b]:
                low = [min(low[a], low[b]) if x in (low[a], low[b]) else x for x in low]
        return low

    every = [(a, b, x) for (a, b), x in links.items()]
    assert sorted(map(tuple, H.thinned(df, 10_000).collect())) == sorted(every)
    for few in (0, 1000):
        rows = list(map(tuple, H.thinned(df, few).collect()))
        assert len(rows) < len(every) and set(rows) <= set(every) and (len(rows) <= 1000)
        assert all(parts(rows, at) == parts(every, at) for at in range(-5, 12))
    assert len(H.thinned(df, 0).collect()) == 300 - len(set(parts(every, 12)))


def test_estimates_do_not_grow_with_the_rounds(spark):
    # the digits of the estimated size doubled with every round
    path = spark.range(2000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    roots = H.components(path.union(path.select("dst", "src")), spark.range(2001).select(F.col("id").alias("node")))
    assert math.log10(roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 60
    assert roots.agg(F.max("root")).first()[0] == 0


def test_points_stay_where_they_are_while_leaves_are_cut(spark, monkeypatch):
    rng, plans = np.random.default_rng(3), []
    points = spark.createDataFrame([(i, 1, rng.normal(size=4).tolist()) for i in range(300)], "node long, n long, vector array<double>")
    monkeypatch.setattr(H, "LEAF", 20)
    monkeypatch.setattr(H, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut_lineage(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = H.leaves(points, 4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dealt.count() == 300 * H.TREES and dealt.groupBy("tree", "leaf").count().agg({"count": "max"}).first()[0] <= 20
    moved = [p for p in plans if "Join" in p]
    assert moved and not any("SortMergeJoin" in p for p in moved)


def test_clusters_of_a_path_of_equal_and_growing_links():
    # points alone, a group that grows, and groups that meet
    sizes, a, b, levels = [1] * 9, [0, 1, 3, 4, 6, 2], [1, 2, 4, 5, 7, 3], [0, 0, 0, 0, 3, 20]
    got = H.cluster_of_each(sizes, a, b, levels, -16, 3, False)
    assert got[0] == got[1] == got[2] and got[3] == got[4] == got[5] and got[0] != got[3] and got[6:] == [None] * 3
