"""Density clusters without a preset number of clusters.

Rows are counted per grid cell first; everything after that works on cells, so
the cost follows the number of occupied cells and a spot that holds a third of
all rows is a single counted cell. No pairs of rows are ever formed.

A cell with at least ``min_samples`` rows is dense. Dense cells that touch
(corners included) belong together. A sparse cell that touches a dense one joins
the fullest of its dense neighbours; all other rows, and clusters with fewer
than ``min_cluster_size`` rows, are noise.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import NOISE
from ..session import cut_lineage, cut_round

MAX_DIMENSIONS = 4  # of the grid; for vectors of any size see ``hierarchy``
# Projections of a vector, and the groups of them of which linked micro-clusters may differ in one.
PROJECTIONS, GROUPS = 12, 3
BROADCAST_ROWS = 500_000  # a key and two numbers each, well below 100 MB
CROWDED = 10_000


def _cell(coords: Sequence[str], eps: float) -> Column:
    """Grid position as a struct of whole numbers; null when a coordinate is missing."""
    missing = F.lit(False)
    for c in coords:
        missing = missing | F.col(c).isNull()
    position = F.struct(*[F.floor(F.col(c) / eps).cast("bigint").alias(f"d{i}") for i, c in enumerate(coords)])
    return F.when(~missing, position)


def _touching(cell: Column, dimensions: int) -> Column:
    """The surrounding cells, a fixed number per cell (8 in two dimensions)."""
    steps = [s for s in product((-1, 0, 1), repeat=dimensions) if any(s)]
    return F.array(*[
        F.struct(*[(cell[f"d{i}"] + step).alias(f"d{i}") for i, step in enumerate(s)]) for s in steps
    ])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable node per node, as (node, root).

    ``edges`` (src, dst) holds both directions. Every round hooks roots onto
    smaller neighbours and halves the paths, so the number of rounds grows with
    the logarithm of the path lengths. The tables are checkpointed per round:
    plans stay short and a lost executor costs one round at most. A root that
    many nodes point to only meets in aggregates, which combine before the
    shuffle, and in ``bring``; nodes that were counted and found few are broadcast.
    """
    edges = cut_round(edges)
    parents = cut_round(nodes.select("node", F.col("node").alias("root")))
    few = parents.count() <= BROADCAST_ROWS
    while True:
        best = (
            edges.join(parents, F.col("dst") == F.col("node"))
            .groupBy("src").agg(F.min("root").alias("low"))
        )
        offers = parents.join(best, F.col("node") == F.col("src"), "left").select(
            "node", "root", F.least("root", F.coalesce("low", "root")).alias("low")
        )
        hooked = cut_round(
            offers.select("node", "low", F.col("root").alias("before"))
            .union(offers.select(F.col("root").alias("node"), "low", F.lit(None).cast(nodes.schema["node"].dataType)))
            .groupBy("node").agg(F.min("low").alias("next"), F.min("before").alias("before"))
        )
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("root"))
        if few:
            stepped = hooked.join(F.broadcast(jump), "next")
        else:
            pointed = hooked.groupBy("next").agg(F.count("*").alias("uses"))
            stepped = bring(hooked, jump.join(pointed, "next"), "next", "uses")
        parents = cut_round(stepped.select("node", "root", (F.col("root") != F.col("before")).alias("moved")))
        if parents.where("moved").limit(1).count() == 0:
            return parents.select("node", "root")
        parents = parents.select("node", "root")


def default_eps(df: DataFrame, coords: Sequence[str], share: float = 0.25) -> float:
    """Cell side as a share of the geometric mean of the standard deviations.

    It does not depend on the number of rows, and is rounded to two digits so
    that the order of summation cannot move the grid.
    """
    row = df.agg(*[F.stddev_pop(c).alias(c) for c in coords]).first()
    spread = [row[c] for c in coords if row[c]]
    return float(f"{share * math.prod(spread) ** (1 / len(spread)):.1e}") if spread else 1.0


def density_clusters(
    df: DataFrame, coords: Sequence[str] = ("proj_x", "proj_y"), eps: float | None = None,
    min_samples: int = 5, min_cluster_size: int = 15, key: str = "id", label: str = "cluster_id",
) -> DataFrame:
    """Add the cluster label: 0, 1, ... by size (ties: lowest key), -1 for noise.

    ``eps`` is the side of a grid cell; without it one is taken from the spread of
    the coordinates. Rows without coordinates are noise. The
    rows themselves are only scanned: once to count the cells and once to take
    the label of their cell.
    """
    if not 1 <= len(coords) <= MAX_DIMENSIONS:
        raise ValueError(f"between 1 and {MAX_DIMENSIONS} coordinates, got {len(coords)}")
    eps = eps or default_eps(df, coords)
    located = df.drop(label).withColumn("_cell", _cell(coords, eps))
    cells = cut_lineage(
        located.where(F.col("_cell").isNotNull()).groupBy(F.col("_cell").alias("cell"))
        .agg(F.count("*").alias("n"), F.min(key).alias("low_key")).withColumn("node", F.monotonically_increasing_id())
    )
    dense = F.col("n") >= min_samples
    links = cut_lineage(cells.select(
        F.col("node").alias("src"), dense.alias("src_dense"), F.explode(_touching(F.col("cell"), len(coords))).alias("cell"),
    ).join(cells.where(dense).select("cell", F.col("node").alias("dst"), F.col("n").alias("dst_n")), "cell"))

    roots = components(links.where("src_dense").select("src", "dst"), cells.where(dense).select("node"))
    # Fullest dense neighbour of a sparse cell, ties to the lowest position.
    fullest = F.min_by("dst", F.struct(-F.col("dst_n"), "cell"))
    border = (
        links.where(~F.col("src_dense")).groupBy("src").agg(fullest.alias("node"))
        .join(roots, "node").select(F.col("src").alias("node"), "root")
    )
    member = cells.join(roots.unionByName(border), "node").select("cell", "n", "low_key", "root")
    return label_members(located, member, min_cluster_size, label)


def projected(vector: Column, size: int) -> Column:
    """``PROJECTIONS`` sums over all components, each with fixed signs; null unless all are finite.

    The sign of component i in projection j is the lowest bit of the CRC-32 of the text "j:i".
    """
    def total(j: int) -> Column:
        signs = F.array(*[F.lit(1.0 if zlib.crc32(f"{j}:{i}".encode()) & 1 else -1.0) for i in range(size)])
        return F.aggregate(F.zip_with(vector, signs, lambda x, s: x.cast("double") * s), F.lit(0.0), lambda a, x: a + x)

    sums = F.array(*[total(j) for j in range(PROJECTIONS)])
    finite = F.forall(sums, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(vector) == size) & finite, sums)


def default_width(df: DataFrame, vector: str, size: int) -> float:
    """Mean standard deviation of the projections, rounded to two digits; it does not depend on the number of rows."""
    sums = df.select(projected(F.col(vector), size).alias("sums")).where("sums is not null")
    spread = [x for x in sums.agg(*[F.stddev_pop(F.col("sums")[j]).alias(f"d{j}") for j in range(PROJECTIONS)]).first() if x]
    return float(f"{sum(spread) / len(spread):.1e}") if spread else 1.0


def signature_clusters(
    df: DataFrame, vector: str, size: int, width: float | None = None, min_samples: int = 5, min_cluster_size: int = 15,
    key: str = "id", label: str = "cluster_id",
) -> DataFrame:
    """Add a coarse cluster label of vectors of ``size`` components in a few passes: 0, 1, ... by size, -1 for noise.

    The borders of a grid of signatures may cut a group; ``hierarchy.vector_clusters`` follows the groups.

    The signature of a vector is the nearest multiple of ``width`` of each projection;
    rows with equal signatures are one counted micro-cluster. Those of at least
    ``min_samples`` rows are dense, and two that agree in all projections outside one of
    the ``GROUPS`` are linked. A sparse one joins the fullest dense one it agrees with in
    that way (ties: lowest key). Every band of equal numbers links its members to one of
    them, so links grow with the micro-clusters and no pairs are formed. Null vectors,
    other sizes and components that are null or not finite are noise; keys are unique.
    """
    width = width or default_width(df, vector, size)
    signature = F.transform(projected(F.col(vector), size), lambda x: F.floor(x / width + 0.5).cast("bigint"))
    located = df.drop(label).withColumn("_cell", signature)
    cells = cut_lineage(
        located.where(F.col("_cell").isNotNull()).groupBy(F.col("_cell").alias("cell"))
        .agg(F.count("*").alias("n"), F.min(key).alias("low_key")).withColumn("node", F.monotonically_increasing_id())
    )
    part = PROJECTIONS // GROUPS
    bands = F.array(*[
        F.struct(F.lit(g).alias("group"), F.concat(
            F.slice("cell", 1, g * part), F.slice("cell", (g + 1) * part + 1, PROJECTIONS)).alias("rest"))
        for g in range(GROUPS)
    ])
    banded = cells.select("node", "n", "low_key", F.explode(bands).alias("band"))
    dense = F.col("n") >= min_samples
    first = F.struct((-F.col("n")).alias("rank"), "low_key")
    hubs = banded.where(dense).groupBy("band").agg(F.min_by("node", first).alias("hub"), F.min(first).alias("first"))
    near = cut_lineage(banded.join(hubs, "band").select("node", "n", "hub", "first"))
    spokes = near.where(dense & (F.col("node") != F.col("hub"))).select(F.col("node").alias("src"), F.col("hub").alias("dst"))
    roots = components(spokes.union(spokes.select("dst", "src")).distinct(), cells.where(dense).select("node"))
    border = (
        near.where(~dense).groupBy("node").agg(F.min_by("hub", "first").alias("via"))
        .join(roots.withColumnRenamed("node", "via"), "via").select("node", "root")
    )
    member = cells.join(roots.unionByName(border), "node").select("cell", "n", "low_key", "root")
    return label_members(located, member, min_cluster_size, label)


def label_members(located: DataFrame, member: DataFrame, min_cluster_size: int, label: str) -> DataFrame:
    """Rows with the label of their ``_cell``; ``member`` has (cell, n, low_key, root)."""
    sizes = (
        member.groupBy("root")
        .agg(F.sum("n").alias("size"), F.min("low_key").alias("low_key"), F.count("*").alias("n_cells"))
        .where(F.col("size") >= min_cluster_size)
    )
    labelled = bring(member.select("cell", "n", "root"), _number(sizes), "root", "n_cells")
    cell_label = labelled.where(F.col("label").isNotNull()).select(
        F.col("cell").alias("_cell"), F.col("n").alias("_n"), F.col("label").alias("_label")
    )
    rows = bring(located, cell_label, "_cell", "_n")
    return rows.withColumn(label, F.coalesce("_label", F.lit(NOISE)).cast("int")).drop("_cell", "_n", "_label")


def bring(rows: DataFrame, table: DataFrame, on: str, weight: str) -> DataFrame:
    """Left join with a table that has each key once and states how many rows carry it.

    A table that was counted and found small is broadcast. Otherwise the crowded
    keys, each with more than 1 / CROWDED of all rows and so never more than
    CROWDED of them, are broadcast, and only the remaining rows are shuffled: no
    task receives the rows of a dominant key. Rows without a key are not shuffled.
    """
    table = cut_lineage(table)
    size = table.agg(F.count("*").alias("n"), F.sum(weight).alias("total")).first()
    if size["n"] <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), on, "left")
    limit = size["total"] / CROWDED
    crowded, others = table.where(F.col(weight) > limit), table.where(F.col(weight) <= limit)
    keyed = rows.where(F.col(on).isNotNull())
    alone = keyed.join(F.broadcast(crowded.select(on)), on, "left_anti")
    found = keyed.join(F.broadcast(crowded), on).unionByName(alone.join(others, on, "left"))
    rest = [c for c in table.columns if c != on]
    missing = rows.where(F.col(on).isNull()).select(
        "*", *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in rest]
    )
    return found.unionByName(missing.select(*found.columns))


def _number(sizes: DataFrame) -> DataFrame:
    """Consecutive labels by size, then lowest key.

    Clusters are dealt by ranges of both, so that many of one size are no hot task;
    a range numbers its own members and starts after all earlier ranges.
    """
    order = [F.col("size").desc(), F.col("low_key").asc()]
    placed = cut_lineage(sizes.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("k"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("_part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row per range.
    return placed.join(F.broadcast(start), "_part").select("root", "n_cells", (F.col("start") + inside - 1).alias("label"))
