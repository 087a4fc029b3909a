"""Plot coordinates: placement against loops, neighbours kept better than by a projection."""

import numpy as np
import pytest
from incidentlake.operators import layout as Y
from incidentlake.operators.reduction import project_2d


def trust(rows, flat, k=10):
    """How far neighbours on the plot are neighbours of the vectors (1: all)."""
    n = len(rows)
    d = ((rows[:, None] - rows) ** 2).sum(2)
    e = ((flat[:, None] - flat) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = np.empty((n, n), int)
    order = d.argsort(1)
    rank[np.arange(n)[:, None], order] = np.arange(1, n + 1)
    near = e.argsort(1)[:, :k]
    far = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return 1 - 2 * far / (n * k * (2 * n - 3 * k - 1))


def test_places_against_loops():
    rng = np.random.default_rng(1)
    layout = Y.Layout(rng.normal(size=(30, 5)), rng.normal(size=(30, 2)), 4)
    rows = np.concatenate([rng.normal(size=(50, 5)), layout.landmarks[:3]])
    for row, got in zip(rows, layout.places(rows), strict=True):
        d = [float(((row - x) ** 2).sum()) for x in layout.landmarks]
        near = sorted(range(30), key=lambda i: (d[i], i))[:4]
        w = [1.0 if d[i] == min(d) else 0.0 for i in near] if min(d) == 0 else [1 / d[i] ** 2 for i in near]
        assert np.allclose(got, sum(a * layout.coordinates[i] for a, i in zip(w, near, strict=True)) / sum(w))


def test_landmarks_are_far_apart():
    rng = np.random.default_rng(2)
    rows = np.concatenate([rng.normal(c * 10, 0.1, size=(50, 3)) for c in range(6)])
    assert {int(i) // 50 for i in Y.far_apart(rows, 6)} == set(range(6))
    assert len(Y.far_apart(np.zeros((5, 2)), 4)) == 1


def test_neighbours_are_kept_better_than_by_projection(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    placed = Y.fit_layout(df, "embedding", 64).place(df, "embedding").orderBy("vec_id").collect()
    flat = project_2d(df).orderBy("vec_id").collect()
    rows = np.array([r["embedding"] for r in placed])
    mine = trust(rows, np.array([(r["proj_x"], r["proj_y"]) for r in placed]))
    other = trust(rows, np.array([(r["proj_x"], r["proj_y"]) for r in flat]))
    assert mine > other + 0.05


def test_planted_groups_stay_apart_with_few_landmarks(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.normal(c, 0.2, size=(120, 20)) for c in rng.normal(size=(8, 20))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, v array<double>")
    layout = Y.fit_layout(df, "v", 20, landmarks=80)
    layout.save(spark, str(tmp_path))
    again = Y.Layout.load(spark, str(tmp_path))
    got = {r["id"]: (r["proj_x"], r["proj_y"]) for r in again.place(df, "v").collect()}
    flat = np.array([got[i] for i in range(len(rows))])
    near = ((flat[:, None] - flat) ** 2).sum(2)
    np.fill_diagonal(near, np.inf)
    assert (np.arange(960) // 120 == near.argmin(1) // 120).mean() > 0.95


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_and_odd_tables(spark, n):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)] + [(10, None), (11, [1.0]), (12, [float("nan"), 1.0]), (13, [None, 1.0])], "id long, v array<float>")
    got = {r["id"]: r["proj_x"] for r in Y.fit_layout(df, "v", 2).place(df, "v").collect()}
    assert [got[i] for i in (10, 11, 12, 13)] == [None] * 4 and all(got[i] is not None for i in range(n))
