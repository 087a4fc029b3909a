"""Density clusters of vectors from a hierarchy of neighbourhoods, without a preset number or distance.

Equal vectors are one counted point. Several random trees deal the points into leaves
of bounded size; neighbours and links are looked for inside leaves only, so the work
grows with the points. The radius that holds ``min_samples`` other rows is a point's
core distance; two points reach each other at the largest of their core distances and
their own distance, rounded up to a geometric grid of levels. What is linked at a
level forms its components; those of ``min_cluster_size`` rows are clusters, which
grow level by level and end where two or more of them meet. Of nested clusters those
with the largest excess of mass are chosen.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_round
from .density import BROADCAST_ROWS, bring, components, label_members

#: Points of a leaf at most, and trees where one leaf does not hold all points.
LEAF, TREES = 1024, 4
#: Cuts of a leaf in one round: 2 ** CUTS leaves come of it at most.
CUTS = 6
#: Levels per doubling of the distance: neighbouring levels are 4.4 % apart.
STEPS = 16
#: The level of distance zero until the smallest other one is known.
ZERO = -1_000_000
#: Links up to which the hierarchy is built in one task, which holds about 600 bytes for each with its point.
FEW_LINKS = 4_000_000


def usable(vector: Column, size: int) -> Column:
    """The vector as doubles; null unless it has ``size`` finite components."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.when((F.size(v) == size) & finite, v)


def vector_clusters(
    df: DataFrame, vector: str, size: int, min_samples: int = 5, min_cluster_size: int = 15, key: str = "id",
    label: str = "cluster_id", single: bool = False,
) -> DataFrame:
    """Add the cluster label of vectors of ``size`` components: 0, 1, ... by size (ties: lowest key), -1 for noise.

    With at most ``LEAF`` different vectors all pairs are considered; with more, pairs
    that share a leaf of one of ``TREES`` trees. The cluster that all others end up in
    counts only if ``single`` says so. Null vectors, other sizes, and components that
    are null or not finite are noise; keys are unique. No rows give no rows.
    """
    located = df.drop(label).withColumn("_vector", usable(F.col(vector), size))
    identity = F.struct(F.xxhash64("_vector").alias("a"), F.xxhash64(F.lit(1), "_vector").alias("b"))
    located = located.withColumn("_cell", F.when(F.col("_vector").isNotNull(), identity))
    points = cut_lineage(
        located.where("_cell is not null").groupBy(F.col("_cell").alias("cell"))
        .agg(F.count("*").alias("n"), F.min(key).alias("low_key"), F.first("_vector").alias("vector"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    links = reach_links(points.select("node", "n", "vector"), size, min_samples)
    roots = chosen_clusters(points.select("node", "n"), links, min_cluster_size, single)
    member = points.select("node", "cell", "n", "low_key").join(roots, "node").drop("node")
    return label_members(located.drop("_vector"), member, 1, label)


# --- neighbourhoods ---------------------------------------------------------------

def reach_links(points: DataFrame, size: int, min_samples: int) -> DataFrame:
    """(a, b, level): links that connect, at every level, all points (node, n, vector) that reach each other within a leaf."""
    dealt = leaves(points, size)

    def near(rows: pd.DataFrame) -> pd.DataFrame:
        """The nearest points of each point, as many as may hold ``min_samples`` rows."""
        nodes, counts, vectors = rows["node"].to_numpy(), rows["n"].to_numpy(), np.stack(rows["vector"].to_numpy())
        k = min(min_samples, len(nodes) - 1)
        if not k:
            return pd.DataFrame({"node": nodes, "n": counts, "near": [[] for _ in nodes]})
        d = distances(vectors)
        np.fill_diagonal(d, np.inf)
        others = np.argpartition(d, k - 1, axis=1)[:, :k]
        gap = vectors[:, None] - vectors[others]
        exact = np.sqrt((gap * gap).sum(2))
        found = [[{"d": x, "other": int(nodes[j]), "n": int(counts[j])} for x, j in zip(ds, js, strict=True)]
                 for ds, js in zip(exact.tolist(), others.tolist(), strict=True)]
        return pd.DataFrame({"node": nodes, "n": counts, "near": found})

    lists = dealt.groupBy("tree", "leaf").applyInPandas(near, "node long, n long, near array<struct<d:double,other:long,n:long>>")
    known = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
    start = F.struct(F.lit(0).cast("long").alias("rows"), F.lit(None).cast("double").alias("core"))
    within = F.aggregate("known", start, lambda s, x: F.struct(
        (s["rows"] + x["n"]).alias("rows"),
        F.when(s["core"].isNull() & (s["rows"] + x["n"] >= min_samples + 1 - F.col("n")), x["d"]).otherwise(s["core"]).alias("core")))["core"]
    cores = lists.groupBy("node", "n").agg(known.alias("known")) \
        .select("node", F.when(F.col("n") > min_samples, F.lit(0.0)).otherwise(within).alias("core")).where("core is not null")

    def tree_of(rows: pd.DataFrame) -> pd.DataFrame:
        """The minimum spanning tree of a leaf: it links at each level what all its pairs would."""
        nodes, cores_, vectors = rows["node"].to_numpy(), rows["core"].to_numpy(), np.stack(rows["vector"].to_numpy())
        reach = np.maximum(np.maximum(distances(vectors), cores_[:, None]), cores_)
        a, b = spanning_tree(reach)
        gap = vectors[a] - vectors[b]
        exact = np.maximum(np.sqrt((gap * gap).sum(1)), np.maximum(cores_[a], cores_[b]))
        return pd.DataFrame({"a": np.minimum(nodes[a], nodes[b]), "b": np.maximum(nodes[a], nodes[b]), "level": level_of(exact)})

    linked = dealt.join(cores, "node").groupBy("tree", "leaf").applyInPandas(tree_of, "a long, b long, level int")
    return cut_lineage(linked.groupBy("a", "b").agg(F.min("level").alias("level")))


def distances(vectors: np.ndarray) -> np.ndarray:
    centred = vectors - vectors.mean(0)
    squares = (centred * centred).sum(1)
    return np.sqrt(np.maximum(squares[:, None] + squares - 2 * (centred @ centred.T), 0))


def level_of(distance: np.ndarray) -> np.ndarray:
    """The lowest level that is not below the distance."""
    with np.errstate(divide="ignore"):
        found = np.ceil(STEPS * np.log2(distance))
    return np.where(distance > 0, found, ZERO).astype(np.int32)


def spanning_tree(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a minimum spanning tree of a complete graph, grown from its first vertex."""
    n = len(weights)
    a, b = np.zeros(max(n - 1, 0), np.int64), np.zeros(max(n - 1, 0), np.int64)
    best, via = weights[0].copy(), np.zeros(n, np.int64)
    best[0] = np.inf
    inside = np.zeros(n, bool)
    inside[0] = True
    for i in range(n - 1):
        new = int(np.argmin(best))
        a[i], b[i] = via[new], new
        inside[new] = True
        closer = (weights[new] < best) & ~inside
        best[closer], via[closer] = weights[new][closer], new
        best[new] = np.inf
    return a, b


def leaves(points: DataFrame, size: int) -> DataFrame:
    """(tree, leaf, node, n, vector): the points dealt by each tree into leaves of at most ``LEAF``.

    A round cuts every large leaf at the medians of random projections, as often as its
    size asks for. Where that no longer makes a large leaf smaller, it is dealt at random.
    """
    count = points.count()
    trees = 1 if count <= LEAF else TREES
    dealt = points.select(F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"), F.lit(0).cast("long").alias("leaf"), "node", "n", "vector")
    largest, number = count, 0
    while largest > LEAF:
        directions = np.random.default_rng(number).normal(size=(trees, CUTS, size))

        def project(batches, directions=directions):
            for rows in batches:
                vectors = np.stack(rows["vector"].to_numpy()) if len(rows) else np.zeros((0, size))
                sums = np.einsum("ij,ikj->ik", vectors, directions[rows["tree"].to_numpy()]) if len(rows) else np.zeros((0, CUTS))
                yield rows.assign(sums=list(sums))

        shown = dealt.mapInPandas(project, "tree int, leaf long, node long, n long, vector array<double>, sums array<double>")
        sums = [F.col("sums")[j] for j in range(CUTS)]
        large = cut_lineage(shown.groupBy("tree", "leaf").agg(
            F.count("*").alias("rows"), F.array(*[F.percentile_approx(s, 0.5) for s in sums]).alias("cuts")).where(F.col("rows") > LEAF)) \
            .withColumn("times", F.least(F.lit(CUTS), F.ceil(F.log2(F.col("rows") / LEAF)).cast("int")))
        bits = [F.when((F.col("times") > j) & (s > F.col("cuts")[j]), 1 << j).otherwise(0) for j, s in enumerate(sums)]
        cut = sum(bits[1:], bits[0]).cast("long")
        cuts = large.drop("rows")
        # few leaves are sent to the tasks, so that the points stay where they are
        dealt = cut_lineage(shown.join(F.broadcast(cuts) if large.count() <= BROADCAST_ROWS else cuts, ["tree", "leaf"], "left")
                            .select("tree", (F.col("leaf") * (1 << CUTS) + F.coalesce(cut, F.lit(0))).alias("leaf"), "node", "n", "vector"))
        before, largest, number = largest, dealt.groupBy("tree", "leaf").count().agg(F.max("count")).first()[0], number + 1
        if largest > 0.75 * before:
            parts = math.ceil(largest / LEAF) * 2
            return dealt.withColumn("leaf", F.xxhash64("leaf", F.pmod(F.xxhash64("tree", "node"), F.lit(parts))))
    return dealt


# --- hierarchy ---------------------------------------------------------------------

def weight(level: int) -> float:
    """How much a row counts for a cluster that it belongs to from this level on: one over the distance."""
    return 2.0 ** (-level / STEPS)


def chosen_clusters(nodes: DataFrame, links: DataFrame, min_size: int, single: bool, few_links: int = FEW_LINKS) -> DataFrame:
    """(node, root): the chosen cluster of each point (node, n); points in none have no row.

    Distance zero counts as half the smallest other distance; a point of ``min_size``
    equal rows is a cluster from there on. Links are thinned until they are few, then
    worked through in one task; those that stay many, level by level by joins. Both
    give the same clusters.
    """
    first = links.where(F.col("level") > ZERO).agg(F.min("level")).first()[0]
    least = (first if first is not None else 0) - STEPS
    links = thinned(links.withColumn("level", F.greatest(F.col("level"), F.lit(least))), few_links)
    linked = links.select(F.col("a").alias("node")).union(links.select("b")).union(nodes.where(F.col("n") >= min_size).select("node")).distinct()
    nodes = cut_lineage(nodes.join(linked, "node", "left_semi"))
    if links.count() <= few_links:
        rows = links.withColumn("n", F.lit(None).cast("long")).unionByName(
            nodes.select(F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("int").alias("level"), "n"))

        def run(part: pd.DataFrame) -> pd.DataFrame:
            point, link = part[part["n"].notna()], part[part["n"].isna()].sort_values("level")
            names = point["a"].to_numpy()
            order = np.argsort(names)
            ends = [order[np.searchsorted(names, link[c].to_numpy().astype(np.int64), sorter=order)].tolist() for c in "ab"]
            roots = cluster_of_each(point["n"].astype(int).tolist(), *ends, link["level"].astype(int).tolist(), least, min_size, single)
            inside = np.array([r is not None for r in roots], bool)
            return pd.DataFrame({"node": names[inside], "root": [r for r in roots if r is not None]})

        return cut_lineage(rows.groupBy(F.lit(0).alias("all")).applyInPandas(run, "node long, root long"))
    return clusters_by_levels(nodes, links, least, min_size, single)


def thinned(links: DataFrame, few_links: int) -> DataFrame:
    """Links (a, b, level) that connect the same points at every level, at most ``few_links`` where so few can.

    Every component keeps its lowest link, and what these connect becomes one component;
    of the links between two components the lowest one stays. In the end a minimum
    spanning forest is left.
    """
    lowest = F.struct("level", "x", "y", "a", "b")  # x and y are the points, a and b their components
    left = links.select(F.col("a").alias("x"), F.col("b").alias("y"), "level", "a", "b")
    kept, total = None, links.count()
    while total > few_links:
        left = cut_round(left)
        ends = left.select(F.col("a").alias("node"), lowest.alias("low")).union(left.select("b", lowest))
        picks = cut_round(ends.groupBy("node").agg(F.min("low").alias("low"), F.count("*").alias("uses")))
        chosen = picks.select("low.*").distinct()
        kept = chosen.select("x", "y", "level") if kept is None else kept.unionByName(chosen.select("x", "y", "level"))
        kept = cut_round(kept)
        both = chosen.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        roots = components(both.union(both.select("dst", "src")), picks.select("node"))
        known = cut_round(roots.join(picks.select("node", "uses"), "node"))
        for end in "ab":
            left = bring(left, known.withColumnsRenamed({"node": end, "root": "_to"}), end, "uses").withColumn(end, F.col("_to")).drop("_to", "uses")
        pair = {"a": F.least("a", "b"), "b": F.greatest("a", "b")}
        left = cut_round(left.where("a <> b").withColumns(pair).groupBy("a", "b").agg(F.min(F.struct("level", "x", "y")).alias("low"))
                         .select("low.*", "a", "b"))
        between = left.count()
        total = kept.count() + between
        if not between:
            break
    if kept is None:
        return links
    return kept.unionByName(left.select("x", "y", "level")).withColumnsRenamed({"x": "a", "y": "b"})


def cluster_of_each(sizes: list[int], a: list[int], b: list[int], levels: list[int], least: int, min_size: int,
                    single: bool) -> list[int | None]:
    """The number of each point's chosen cluster; ``levels`` of the links a-b ascend from ``least`` on."""
    above, size = list(range(len(sizes))), list(sizes)
    members: list[list[int] | None] = [None] * len(sizes)  # of components that are no cluster yet; None is the point alone
    cluster: list[int | None] = [None] * len(sizes)  # of a component
    first: list[int | None] = [None] * len(sizes)  # of a point
    score: list[float] = []
    inner: list[float] = []
    parent: list[int | None] = []

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def enter(component: int, number: int) -> None:
        for i in within(component):
            first[i] = number
        members[component] = []

    def within(component: int) -> list[int]:
        known = members[component]
        return [component] if known is None else known

    def new(mass: float, below: float) -> int:
        score.append(mass)
        inner.append(below)
        parent.append(None)
        return len(score) - 1

    for i, s in enumerate(sizes):
        if s >= min_size:
            cluster[i] = new(s * weight(least), 0.0)
            enter(i, cluster[i])
    at = 0
    while at < len(levels):
        level, meeting = levels[at], {}
        while at < len(levels) and levels[at] == level:
            x, y = top(a[at]), top(b[at])
            if x != y:
                x, y = (x, y) if size[x] >= size[y] else (y, x)
                parts = meeting.pop(x, None) or [(x, size[x])]
                parts += meeting.pop(y, None) or [(y, size[y])]
                above[y], size[x] = x, size[x] + size[y]
                meeting[x] = parts
            at += 1
        mass = weight(level)
        for x, parts in meeting.items():
            # clusters that meet, each with its number of rows before
            grown = [(cluster[p], s) for p, s in parts if cluster[p] is not None]
            if len(grown) == 1:
                number = grown[0][0]
                score[number] += (size[x] - grown[0][1]) * mass
            elif grown:
                for number, s in grown:
                    score[number] -= s * mass
                number = new(size[x] * mass, sum(max(score[c], inner[c]) for c, _ in grown))
                for c, _ in grown:
                    parent[c] = number
            elif size[x] >= min_size:
                number = new(size[x] * mass, 0.0)
            else:
                members[x] = [i for p, _ in parts for i in within(p)]
                continue
            for p, _ in parts:
                enter(p, number)
            cluster[x] = number
    ends = [c for c in range(len(score)) if parent[c] is None]
    barred = set() if single or len(ends) > 1 else set(ends)
    best: list[int | None] = [None] * len(score)
    for c in reversed(range(len(score))):  # a parent has a higher number than what is in it
        held = best[parent[c]] if parent[c] is not None else None
        best[c] = held if held is not None else c if c not in barred and score[c] >= inner[c] else None
    return [None if c is None else best[c] for c in first]


def clusters_by_levels(nodes: DataFrame, links: DataFrame, least: int, min_size: int, single: bool) -> DataFrame:
    """The same by joins: at every level its links merge components, which are kept as tables."""
    levels = [r[0] for r in links.select("level").distinct().orderBy("level").collect()]  # follows the range of distances
    number, spot = "struct<at:int,node:long>", F.col("n") >= min_size
    alone = F.when(spot, F.struct(F.lit(-1).alias("at"), "node"))
    place = cut_round(nodes.select("node", F.col("node").alias("part"), alone.alias("first")))
    parts = cut_round(nodes.select(F.col("node").alias("part"), F.col("n").alias("size"), alone.alias("cluster"),
                                     F.when(spot, F.col("n") * weight(least)).otherwise(0.0).alias("score"), F.lit(0.0).alias("inner")))
    links, ended = cut_round(links), None
    for at, level in enumerate(levels):
        mass = weight(level)
        now = links.where(F.col("level") == level).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        both = cut_round(now.union(now.select("dst", "src")).distinct())
        moves = components(both, both.select(F.col("src").alias("node")).distinct()).select(F.col("node").alias("part"), F.col("root").alias("to"))
        moved = cut_round(parts.join(moves, "part"))
        grown = F.col("cluster").isNotNull()
        met = moved.groupBy("to").agg(
            F.sum("size").alias("size"), F.count("cluster").alias("clusters"), F.max("cluster").alias("cluster"), F.sum("score").alias("score"),
            F.sum("inner").alias("inner"), F.sum(F.when(grown, F.col("size"))).alias("before"),
            F.sum(F.when(grown, F.greatest(F.col("score") - F.col("size") * mass, F.col("inner")))).alias("best"))
        own = F.struct(F.lit(at).alias("at"), F.col("to").alias("node"))
        many, one, born = F.col("clusters") > 1, F.col("clusters") == 1, F.col("size") >= min_size
        fresh = cut_round(met.select(
            F.col("to").alias("part"), "size", F.when(many, own).when(one, F.col("cluster")).when(born, own).alias("cluster"),
            F.when(one, F.col("score") + (F.col("size") - F.col("before")) * mass).when(many | born, F.col("size") * mass).otherwise(0.0).alias("score"),
            F.when(many, F.col("best")).when(one, F.col("inner")).otherwise(0.0).alias("inner"), many.alias("many")))
        over = moved.where(grown).join(fresh.where("many").select(F.col("part").alias("to"), F.col("cluster").alias("parent")), "to") \
            .select("cluster", "parent", (F.col("score") - F.col("size") * mass).alias("score"), "inner")
        ended = cut_round(over if ended is None else ended.unionByName(over))
        parts = cut_round(parts.join(moves, "part", "left_anti").unionByName(fresh.drop("many")))
        # a component may hold most points, so its rows are not brought together
        table = moved.groupBy("part", "to").agg(F.first("size").alias("size")).join(fresh.select(F.col("part").alias("to"), F.col("cluster").alias("got")), "to")
        place = cut_round(bring(place, table, "part", "size").select(
            "node", F.coalesce("to", "part").alias("part"), F.coalesce("first", "got").alias("first")))
        ends = links.where(F.col("level") > level)
        uses = ends.select(F.col("a").alias("part")).union(ends.select("b")).groupBy("part").agg(F.count("*").alias("uses"))
        known = cut_round(moves.join(uses, "part"))
        for end in "ab":
            ends = bring(ends, known.withColumnsRenamed({"part": end, "to": "_to"}), end, "uses").withColumn(end, F.coalesce("_to", end)).drop("_to", "uses")
        links = cut_round(ends.where("a <> b"))
    left = parts.where("cluster is not null").select("cluster", F.lit(None).cast(number).alias("parent"), "score", "inner")
    every = cut_round(left if ended is None else ended.unionByName(left))
    barred = not single and left.limit(2).count() == 1
    good = (F.col("score") >= F.col("inner")) & (F.col("parent").isNotNull() | F.lit(not barred))
    front = every.where("parent is null").select("cluster", F.when(good, F.col("cluster")).alias("best"))
    done = front
    while front.limit(1).count():
        front = cut_round(every.join(front.withColumnsRenamed({"cluster": "parent", "best": "held"}), "parent")
                            .select("cluster", F.coalesce("held", F.when(good, F.col("cluster"))).alias("best")))
        done = cut_round(done.unionByName(front))
    used = place.groupBy("first").agg(F.count("*").alias("uses"))
    best = done.where("best is not null").withColumnRenamed("cluster", "first").join(used, "first")
    return bring(place, best, "first", "uses").where("best is not null").select("node", F.col("best").alias("root"))
