"""Plot coordinates that keep neighbours together: a layout of landmarks and the place of every row among them.

Landmarks are chosen far apart from a sample of bounded size and laid out by stochastic
neighbour embedding, which follows neighbourhoods where a linear projection mixes them.
Every row is then placed by its nearest landmarks, row by row in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows whose distances to the landmarks are held at once.
STEP = 2000
PLACES = 1 << 62
LANDMARK = "number int, vector array<double>, x double, y double"


def far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """Numbers of ``count`` rows: the one farthest from the mean, then always the one farthest from those chosen."""
    gap = ((rows - rows.mean(0)) ** 2).sum(1)
    chosen = [int(gap.argmax())]
    gap = ((rows - rows[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(rows)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def affinities(squares: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric neighbour probabilities: each row's Gaussian is as wide as gives it ``perplexity`` neighbours."""
    n = len(squares)
    low, high, beta = np.zeros(n), np.full(n, np.inf), 1 / np.maximum(squares.mean(1), 1e-300)
    others = squares.copy()
    np.fill_diagonal(others, np.inf)
    others -= others.min(1, keepdims=True)
    for _ in range(60):
        p = np.exp(-others * beta[:, None])
        p /= p.sum(1, keepdims=True)
        wide = -(p * np.log(np.maximum(p, 1e-300))).sum(1) > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    return (p + p.T) / (2 * n)


def neighbour_embedding(rows: np.ndarray, perplexity: float = 15.0, rounds: int = 500) -> np.ndarray:
    """Two coordinates per row by t-distributed neighbour embedding, from the first two principal components on."""
    n = len(rows)
    if n < 4:
        return np.column_stack([np.arange(n, dtype=float), np.zeros(n)])
    centred = rows - rows.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:2] * np.where(axes[:2][np.arange(len(axes[:2])), np.abs(axes[:2]).argmax(1)] < 0, -1.0, 1.0)[:, None]
    y = centred @ axes.T
    if y.shape[1] < 2:
        y = np.column_stack([y, np.zeros(n)])
    y = y / max(y[:, 0].std(), 1e-300) * 1e-2
    squares = (centred**2).sum(1)
    p = affinities(np.maximum(squares[:, None] + squares - 2 * centred @ centred.T, 0), min(perplexity, (n - 1) / 3))
    speed, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 12, 50.0)
    for k in range(rounds):
        gap = y[:, None] - y
        near = 1 / (1 + (gap**2).sum(2))
        np.fill_diagonal(near, 0)
        pull = (p * (12 if k < 100 else 1) - near / near.sum()) * near
        slope = 4 * (pull[:, :, None] * gap).sum(1)
        gain = np.maximum(np.where(np.sign(slope) == np.sign(speed), gain * 0.8, gain + 0.2), 0.01)
        speed = (0.5 if k < 100 else 0.8) * speed - rate * gain * slope
        y = y + speed
    return y - y.mean(0)


@dataclass
class Layout:
    """Landmarks (n x size) and their coordinates (n x 2)."""

    landmarks: np.ndarray
    coordinates: np.ndarray
    nearest: int = 6

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates of rows: the mean of their nearest landmarks, weighted by the inverse fourth power of the distance.

        A row that is a landmark has its place; of equally far landmarks the first count.
        """
        k = min(self.nearest, len(self.landmarks))
        out = np.zeros((len(rows), 2))
        own = (self.landmarks**2).sum(1)
        for at in range(0, len(rows), STEP):
            part = rows[at:at + STEP]
            rough = (part**2).sum(1)[:, None] + own - 2 * part @ self.landmarks.T
            order = np.sort(np.argsort(rough, axis=1, kind="stable")[:, :k], axis=1)
            squares = ((part[:, None] - self.landmarks[order]) ** 2).sum(2)
            least = squares.min(1, keepdims=True)
            weight = np.where(least > 0, (least / np.maximum(squares, 1e-300)) ** 2, squares == 0)
            first = np.cumsum(squares == 0, 1) * (squares == 0) == 1
            weight = np.where(least > 0, weight, first)
            out[at:at + STEP] = (self.coordinates[order] * weight[:, :, None]).sum(1) / weight.sum(1, keepdims=True)
        return out

    def place(self, df: DataFrame, vector: str, x: str = "proj_x", y: str = "proj_y") -> DataFrame:
        """Add the coordinates of each row; null for vectors that are null, of another size or not finite. Row by row."""
        size = self.landmarks.shape[1]
        sent = df.sparkSession.sparkContext.broadcast((self.landmarks, self.coordinates, self.nearest))

        @F.arrow_udf("struct<x:double,y:double>")
        def locate(column: pa.Array) -> pa.Array:
            column = column.cast(pa.large_list(pa.float64()))
            lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), -1)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
            good = np.flatnonzero(lengths == size) if len(sent.value[0]) else np.zeros(0, np.int64)
            rows = flat[starts[good][:, None] + np.arange(size)] if len(good) else np.zeros((0, size))
            finite = np.isfinite(rows).all(1)
            found = np.full((len(column), 2), np.nan)
            found[good[finite]] = Layout(*sent.value).places(rows[finite])
            return pa.StructArray.from_arrays([pa.array(found[:, 0], from_pandas=True), pa.array(found[:, 1], from_pandas=True)], names=["x", "y"])

        placed = df.withColumn("_place", locate(F.col(vector).cast("array<double>")))
        return placed.withColumns({x: F.col("_place.x"), y: F.col("_place.y")}).drop("_place")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, v, *c) for i, (v, c) in enumerate(zip(self.landmarks.tolist(), self.coordinates.tolist(), strict=True))]
        spark.createDataFrame(rows, LANDMARK).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Layout:
        rows = spark.read.schema(LANDMARK).parquet(path).orderBy("number").collect()
        return cls(np.array([r["vector"] for r in rows], float), np.array([(r["x"], r["y"]) for r in rows], float))


def fit_layout(df: DataFrame, vector: str, size: int, landmarks: int = 600, sample: int = 20_000) -> Layout:
    """Layout of the vectors of ``size`` finite components.

    The landmarks come from about ``sample`` different vectors, chosen by a hash of the
    vector; what reaches the driver does not grow with the rows. Without vectors the
    layout is empty and places nothing.
    """
    v = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(v.alias("v")).where((F.size("v") == size) & finite)
    count = rows.count()
    place = F.shiftrightunsigned(F.xxhash64("v"), 2)
    chosen = rows.where(place < F.lit(min(PLACES, -(-PLACES * sample // max(count, 1))))).distinct()
    found = np.array(sorted(r["v"] for r in chosen.limit(4 * sample).collect()), float).reshape(-1, size)
    if not len(found):
        return Layout(np.zeros((0, size)), np.zeros((0, 2)))
    picked = found[far_apart(found, landmarks)]
    return Layout(picked, neighbour_embedding(picked))
