import zlib
from collections import Counter, defaultdict, deque
from itertools import product
from math import floor

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentlake import cluster_coverage, cluster_stats, density_clusters
from incidentlake.operators import density as D


def brute_force(points, eps, min_samples, min_size):
    """The same definition, cell by cell in plain Python."""
    cell = {k: tuple(floor(x / eps) for x in p) for k, p in points.items() if None not in p}
    n = Counter(cell.values())
    dense = {c for c, k in n.items() if k >= min_samples}

    def around(c):
        return [tuple(a + s for a, s in zip(c, step)) for step in product((-1, 0, 1), repeat=len(c)) if any(step)]

    root = {}
    for start in sorted(dense):
        if start not in root:
            todo = deque([start])
            root[start] = start
            while todo:
                for other in around(todo.popleft()):
                    if other in dense and other not in root:
                        root[other] = start
                        todo.append(other)
    for c in set(n) - dense:
        best = sorted((-n[o], o) for o in around(c) if o in dense)
        if best:
            root[c] = root[best[0][1]]
    members = defaultdict(list)
    for k, c in cell.items():
        if c in root:
            members[root[c]].append(k)
    kept = sorted((m for m in members.values() if len(m) >= min_size), key=lambda m: (-len(m), min(m)))
    label = {k: i for i, m in enumerate(kept) for k in m}
    return {k: label.get(k, -1) for k in points}


def run(spark, points, eps, min_samples=5, min_size=15):
    dims = len(next(iter(points.values())))
    names = [f"x{i}" for i in range(dims)]
    schema = "id long, " + ", ".join(f"{c} double" for c in names)
    df = spark.createDataFrame([(k, *p) for k, p in points.items()], schema)
    got = density_clusters(df, names, eps, min_samples, min_size)
    return {r["id"]: r["cluster_id"] for r in got.collect()}


def blobs(rng, centers, n, spread):
    rows = np.concatenate([rng.normal(c, spread, size=(n, len(c))) for c in centers])
    return {i: tuple(float(x) for x in p) for i, p in enumerate(rows)}


@pytest.mark.parametrize("dims, eps", [(1, 0.3), (2, 0.4), (3, 0.8)])
def test_against_brute_force(spark, dims, eps):
    rng = np.random.default_rng(dims)
    points = blobs(rng, rng.uniform(-6, 6, size=(5, dims)), 120, 0.6)
    points[10_000] = (None,) * dims
    assert run(spark, points, eps) == brute_force(points, eps, 5, 15)


def test_planted_groups_and_noise(spark):
    rng = np.random.default_rng(1)
    points = blobs(rng, [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)], 200, 0.5)
    points.update({1000 + i: (30.0 + 5 * i, -40.0) for i in range(20)})
    got = run(spark, points, 0.6)
    assert {got[i] for i in range(1000, 1020)} == {-1}
    for g in range(3):
        assert len({got[i] for i in range(g * 200, g * 200 + 200)} - {-1}) == 1
    assert len(set(got.values())) == 4


def test_no_side_given(spark):
    rng = np.random.default_rng(1)
    points = blobs(rng, [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0)], 200, 0.5)
    points.update({1000 + i: (40.0 + 9 * i, -40.0) for i in range(5)})
    got = run(spark, points, None)
    assert {got[1000 + i] for i in range(5)} == {-1}
    assert [len({got[i] for i in range(g * 200, g * 200 + 200)} - {-1}) for g in range(3)] == [1, 1, 1]
    assert len({v for v in got.values() if v >= 0}) == 3
    same = {i: (3.0, 3.0) for i in range(40)}
    assert set(run(spark, same, None).values()) == {0}


def test_one_spot_holds_most_rows(spark, monkeypatch):
    points = {i: (1.0, 1.0) for i in range(4000)}
    points.update({4000 + i: (50.0 + (i % 3) * 0.01, 50.0) for i in range(30)})
    want = {k: 0 if k < 4000 else 1 for k in points}
    assert run(spark, points, 0.5) == want
    points[9999] = (None, 2.0)
    want[9999] = -1
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert run(spark, points, 0.5) == want


@pytest.mark.parametrize("crowded", [1, 5, 10_000])
def test_join_without_broadcasting_the_table(spark, monkeypatch, crowded):
    rng = np.random.default_rng(8)
    points = blobs(rng, rng.uniform(-6, 6, size=(4, 2)), 150, 0.6)
    points[10_000] = (None, None)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "CROWDED", crowded)
    assert run(spark, points, 0.4) == brute_force(points, 0.4, 5, 15)


def test_long_chain_is_one_group(spark):
    points = {i: (float(i // 5), float((i // 5) % 2)) for i in range(1500)}
    assert set(run(spark, points, 1.0).values()) == {0}


def test_shuffled_chain_settles(spark):
    rng = np.random.default_rng(5)
    names = rng.permutation(800)
    edges = [(int(a), int(b)) for a, b in zip(names, names[1:]) if (a + b) % 97]
    df = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long")
    nodes = spark.createDataFrame([(int(v),) for v in names], "node long")
    got = {r["node"]: r["root"] for r in D.components(df, nodes).collect()}
    group, current = {}, []
    linked = set(edges)
    for a, b in zip(names, list(names[1:]) + [None]):
        current.append(int(a))
        if b is None or (int(a), int(b)) not in linked:
            group.update({v: min(current) for v in current})
            current = []
    assert got == group


def test_small_groups_are_noise_and_sizes_order_labels(spark):
    points = {i: (0.0, 0.0) for i in range(14)}
    points.update({100 + i: (9.0, 9.0) for i in range(20)})
    points.update({200 + i: (-9.0, 9.0) for i in range(20)})
    points.update({300 + i: (9.0, -9.0) for i in range(40)})
    got = run(spark, points, 1.0)
    assert (got[0], got[100], got[200], got[300]) == (-1, 1, 2, 0)


def brute_vectors(vectors, width, min_samples, min_size):
    """The definition of the vector clusters, pair by pair in plain Python."""
    size = len(next(v for v in vectors.values() if v))
    signs = [[1 if zlib.crc32(f"{j}:{i}".encode()) & 1 else -1 for i in range(size)] for j in range(D.PROJECTIONS)]
    cell = {k: tuple(floor(sum(x * s for x, s in zip(v, row)) / width + 0.5) for row in signs) for k, v in vectors.items() if v and None not in v}
    n = Counter(cell.values())
    low = {c: min(k for k in cell if cell[k] == c) for c in n}
    part = D.PROJECTIONS // D.GROUPS

    def near(a, b):
        return any(a[:g * part] + a[(g + 1) * part:] == b[:g * part] + b[(g + 1) * part:] for g in range(D.GROUPS))

    dense, root = {c for c, k in n.items() if k >= min_samples}, {}
    for start in sorted(dense):
        if start not in root:
            todo, root[start] = deque([start]), start
            while todo:
                here = todo.popleft()
                for other in dense:
                    if other not in root and near(here, other):
                        root[other] = start
                        todo.append(other)
    for c in set(n) - dense:
        best = sorted((-n[o], low[o], o) for o in dense if near(c, o))
        if best:
            root[c] = root[best[0][2]]
    members = defaultdict(list)
    for k, c in cell.items():
        if c in root:
            members[root[c]].append(k)
    kept = sorted((m for m in members.values() if len(m) >= min_size), key=lambda m: (-len(m), min(m)))
    label = {k: i for i, m in enumerate(kept) for k in m}
    return {k: label.get(k, -1) for k in vectors}


def run_vectors(spark, vectors, size, width=None, min_samples=5, min_size=15):
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<double>")
    return {r["id"]: r["cluster_id"] for r in D.signature_clusters(df, "v", size, width, min_samples, min_size).collect()}


def planted_vectors(rng, groups=5, each=120, size=20, spread=0.15):
    centers = rng.normal(size=(groups, size)) * 2
    rows = np.concatenate([rng.normal(c, spread, size=(each, size)) for c in centers] + [rng.normal(size=(40, size)) * 6])
    return {i: [float(x) for x in v] for i, v in enumerate(rows)}


def test_vectors_against_brute_force(spark):
    vectors = planted_vectors(np.random.default_rng(4))
    vectors.update({10_000: None, 10_001: [1.0] * 19 + [None]})
    want = brute_vectors(vectors, 2.5, 3, 10)
    assert run_vectors(spark, vectors, 20, 2.5, 3, 10) == want
    assert len(set(want.values())) > 3 and want[10_000] == want[10_001] == -1


def test_vectors_outside_the_leading_components_count(spark):
    rng = np.random.default_rng(6)
    vectors = {i: [0.0] * 15 + [(20.0 if i % 2 else -20.0) + float(x) for x in rng.normal(0, 0.05, 5)] for i in range(200)}
    got = run_vectors(spark, vectors, 20)
    assert {got[i] for i in range(0, 200, 2)} == {0} and {got[i] for i in range(1, 200, 2)} == {1}


def test_a_table_repeated_keeps_its_vector_clusters(spark):
    vectors = planted_vectors(np.random.default_rng(7))
    once = run_vectors(spark, vectors, 20)
    many = run_vectors(spark, {i + 1000 * k: v for i, v in vectors.items() for k in range(10)}, 20, None, 50, 150)
    assert {i: many[i] for i in vectors} == once and len(set(once.values())) > 1
    df = spark.createDataFrame([], "id long, v array<double>")
    assert D.signature_clusters(df, "v", 20).count() == 0


def test_too_many_dimensions(spark):
    with pytest.raises(ValueError):
        density_clusters(spark.range(1), ["a", "b", "c", "d", "e"])


def test_statistics_and_coverage(spark):
    rows = [(0, "A", "X", "Fatal", 0.5, 4.0, 1950)] * 3 + [(0, "B", None, "Minor", None, None, None)] * 3 + [
        (-1, None, None, None, None, None, None)]
    df = spark.createDataFrame(
        rows, "cluster_id int, operator string, aircraft_type string, severity_label string, fatality_rate double,"
        " fatalities double, year int")
    got = {r["cluster_label"]: r for r in cluster_stats(df, run_id=4).collect()}
    assert got[0]["top_operators"] == ["A", "B"] and got[0]["dominant_severity"] == "Fatal"
    assert got[0]["top_aircraft_types"] == ["X"] and got[0]["run_id"] == 4
    assert got[-1]["avg_fatalities"] is None and got[-1]["top_operators"] == [] and got[-1]["incident_count"] == 1
    assert cluster_coverage(df).first().asDict() == {"n_clusters": 1, "n_noise": 1, "coverage_pct": 85.7}
    assert cluster_coverage(df.where(F.col("cluster_id") == 0)).first()["n_noise"] == 0
