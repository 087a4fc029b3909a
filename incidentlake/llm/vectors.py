"""Near-duplicate vectors through a robust-pruned flat graph built on overlapping shards."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, linked_groups

#: Vectors one task compares in a block; a larger shard is dealt out in pairs of blocks.
BLOCK = 2048
#: Vectors per shard aimed at, most shards, and sampled vectors per shard.
SHARD_ROWS, MOST_SHARDS, SAMPLE_PER_SHARD = 1500, 65_536, 40
#: Vectors (and, where they are long, components) that come to the driver for the upper centres, and sampled vectors one task clusters.
FIRST_SAMPLE, FIRST_COMPONENTS, PART = 50_000, 8_000_000, 8192
#: Overlap from which on vectors are compared in full instead of searched wider, and the blocks of that comparison.
WIDEST, EXACT_BLOCK = 64, 8192
#: Vectors drawn at most for the audit where few have links.
MOST_DRAWN = 3200

LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Shards:
    """Two levels of centres, as unit vectors; ``parent`` is the upper centre of each lower one."""

    upper: np.ndarray
    lower: np.ndarray
    parent: np.ndarray

    def nearest(self, vectors: np.ndarray, overlap: int, reach: int = 4) -> np.ndarray:
        """The ``overlap`` nearest lower centres of each vector, among those of its ``reach`` nearest upper ones."""
        reach, overlap = min(reach, len(self.upper)), min(overlap, len(self.lower))
        tops = np.argsort(-(vectors @ self.upper.T), axis=1, kind="stable")[:, :reach]
        best = np.full((len(vectors), overlap), -np.inf)
        names = np.full((len(vectors), overlap), -1, np.int64)
        for top in np.unique(tops).tolist():
            rows, children = np.flatnonzero((tops == top).any(1)), np.flatnonzero(self.parent == top)
            sims = np.concatenate((best[rows], vectors[rows] @ self.lower[children].T), axis=1)
            own = np.concatenate((names[rows], np.broadcast_to(children, (len(rows), len(children)))), axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
            best[rows], names[rows] = np.take_along_axis(sims, order, 1), np.take_along_axis(own, order, 1)
        return names


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled by the largest component first, so that squares do not overflow."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def centres(vectors: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from evenly spaced starts; empty centres are dropped."""
    k = min(k, len(vectors))
    found = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (vectors @ found.T).argmax(1)
        used = np.unique(own)
        sums = np.stack([vectors[own == c].sum(0) for c in used])
        norms = np.sqrt((sums * sums).sum(1, keepdims=True))
        found = np.where(norms > 0, sums / np.maximum(norms, 1e-300), found[used])
    return found, (vectors @ found.T).argmax(1)


def fit_shards(rows: DataFrame, n: int, length: int, shards: int) -> Shards:
    """Centres of (id, vector) rows, ``n`` vectors of one length.

    A sample of bounded size on the driver gives the upper centres. The lower ones are
    fitted in the tasks, on ``SAMPLE_PER_SHARD`` vectors per shard: each goes to its upper
    centre, the members of an upper centre are dealt in parts of about ``PART``, and each
    part gives centres by its share of the sample. Only centres come back.
    """

    def sampled(most: int) -> DataFrame:
        return rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(min(1_000_000, -(-1_000_000 * most // n))))

    tops = max(1, int(np.ceil(np.sqrt(shards))))
    first = sampled(min(SAMPLE_PER_SHARD * shards, FIRST_SAMPLE, max(4 * tops, FIRST_COMPONENTS // length))).toPandas().sort_values("id")
    if not len(first):  # few vectors, none in the sample: one shard
        return Shards(np.eye(1, length), np.eye(1, length), np.zeros(1, np.int64))
    top, _ = centres(np.stack(first["vector"].to_numpy()), tops)
    if shards == 1:
        return Shards(top, top, np.zeros(1, np.int64))

    def parent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy().reshape(-1, length)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((vectors @ top.T).argmax(1))], names=["id", "vector", "top"])

    def lower(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        found = centres(np.stack(part["vector"].to_numpy()), max(1, round(shards * len(part) / total)))[0]
        return pd.DataFrame({"top": part["top"].iloc[0], "part": part["part"].iloc[0], "centre": list(found)})

    placed = sampled(SAMPLE_PER_SHARD * shards).mapInArrow(parent, "id long, vector array<double>, top long")
    sizes = {r["top"]: r["n"] for r in placed.groupBy("top").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    parts = F.element_at(F.create_map(*(F.lit(x) for t, m in sizes.items() for x in (t, -(-m // PART)))), F.col("top"))
    below = placed.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("long")).groupBy("top", "part") \
        .applyInPandas(lower, "top long, part long, centre array<double>").orderBy("top", "part").toPandas()
    bare = np.setdiff1d(np.arange(len(top)), below["top"])  # upper centres without a sampled vector are lower ones too
    return Shards(top, np.concatenate((np.stack(below["centre"].to_numpy()), top[bare])), np.concatenate((below["top"].to_numpy(), bare)))


def usable(vector: Column) -> Column:
    """Vectors with at least one component, none null or not finite, and not zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def graph(vectors: np.ndarray, degree: int = 24, pool: int = 64, alpha: float = 1.2) -> np.ndarray:
    """Adjacency (n x degree, padded with -1): nearest candidates of each vector after robust pruning.

    A candidate stays unless one that stays already is by ``alpha`` closer to it than the
    vector itself, so that edges point in different directions.
    """
    n = len(vectors)
    pool, out = min(pool, n - 1), np.full((n, degree), -1, np.int64)
    step = max(1, 512 * 64 // pool)
    for at in range(0, n, step):
        sims = vectors[at:at + step] @ vectors.T
        rows = np.arange(len(sims))
        sims[rows, at + rows] = -np.inf
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool] if pool < n else np.tile(np.arange(n), (len(sims), 1))
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
        near = np.take_along_axis(near, order, 1)
        own = 2 - 2 * np.take_along_axis(sims, near, 1)  # squared distances
        alive, taken, cloud = np.ones(near.shape, bool), np.zeros(len(near), np.int64), vectors[near]
        for _ in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            chosen = near[rows, pick]
            out[at + rows[some], taken[some]] = chosen[some]
            taken[some] += 1
            between = 2 - 2 * (cloud @ vectors[chosen][:, :, None])[:, :, 0]
            alive &= alpha * alpha * between > own
            alive[rows, pick] = False
    return out


def both_ways(n: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) and their reverse as one list of ends, and where each vertex begins in it."""
    pairs = np.unique(np.concatenate((edges[:, 0] * n + edges[:, 1], edges[:, 1] * n + edges[:, 0])))
    return np.searchsorted(pairs // n, np.arange(n + 1)), pairs % n


def medoids(vectors: np.ndarray, k: int) -> np.ndarray:
    """The vector nearest to the centre of each of at most ``k`` clusters."""
    middle, own = centres(vectors, k, rounds=4)
    sims = vectors @ middle.T
    return np.unique([np.where(own == c, sims[:, c], -np.inf).argmax() for c in np.unique(own)])


def range_search(vectors: np.ndarray, edges: tuple[np.ndarray, np.ndarray], threshold: float, beam: int, slack: float = 0.05, starts: int = 16) -> np.ndarray:
    """Which vectors each vector finds within the threshold, as a symmetric table without itself.

    Every vector is a query. A greedy search with a beam starts at the query's own vertex
    and at the medoids of ``starts`` clusters, so that a dense group does not hide the
    others; from what it found within reach of the threshold the search goes on along the
    edges, in both directions, until no new vector is within reach. Similarities are
    computed in double precision.
    """
    n = len(vectors)
    first = medoids(vectors, starts)
    found = np.zeros((n, n), bool)
    for at in range(0, n, 512):
        queries = vectors[at:at + 512]
        q = np.arange(len(queries))
        seen = np.zeros((len(q), n), bool)
        ids = np.concatenate((at + q[:, None], np.broadcast_to(first, (len(q), len(first))), np.full((len(q), beam), -1)), 1)
        sims = np.concatenate((np.ones((len(q), 1)), queries @ vectors[first].T, np.full((len(q), beam), -np.inf)), 1)
        ids[:, 1:][ids[:, 1:] == ids[:, :1]] = -1  # a medoid's own search
        sims[ids < 0] = -np.inf
        seen[:, first], seen[q, at + q] = True, True
        done = np.zeros(ids.shape, bool)
        row, slot = np.nonzero(sims >= threshold - slack)
        near = [(row, ids[row, slot])]
        while True:
            waiting = np.where(done | (ids < 0), -np.inf, sims)
            pick = waiting.argmax(1)
            active = np.flatnonzero(waiting[q, pick] > -np.inf)
            if not len(active):
                break
            done[active, pick[active]] = True
            rows, fresh = expand(active, ids[active, pick[active]], edges, seen)
            if not len(rows):
                continue
            value = np.einsum("ij,ij->i", queries[rows], vectors[fresh])
            close = value >= threshold - slack
            near.append((rows[close], fresh[close]))
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)  # rows ascend
            width = int(place.max()) + 1
            more_ids, more = np.full((len(q), width), -1, np.int64), np.full((len(q), width), -np.inf)
            more_ids[rows, place], more[rows, place] = fresh, value
            all_ids, all_sims = np.concatenate((ids, more_ids), 1), np.concatenate((sims, more), 1)
            all_done = np.concatenate((done, np.zeros(more.shape, bool)), 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_done))
        rows, nodes = (np.concatenate(x) for x in zip(*near, strict=True))
        while len(rows):
            close = np.einsum("ij,ij->i", queries[rows], vectors[nodes]) >= threshold
            found[at + rows[close], nodes[close]] = True
            rows, nodes = expand(rows, nodes, edges, seen)
            reach = np.einsum("ij,ij->i", queries[rows], vectors[nodes]) >= threshold - slack
            rows, nodes = rows[reach], nodes[reach]
    np.fill_diagonal(found, False)
    return found | found.T


def expand(rows: np.ndarray, nodes: np.ndarray, edges: tuple[np.ndarray, np.ndarray], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each query's nodes that it has not seen, marked as seen; sorted by query."""
    begins, ends = edges
    width = begins[nodes + 1] - begins[nodes]
    rows, fresh = np.repeat(rows, width), ends[np.arange(width.sum()) + np.repeat(begins[nodes] - np.cumsum(width) + width, width)]
    new = ~seen[rows, fresh]
    both = np.unique(rows[new] * seen.shape[1] + fresh[new])
    rows, fresh = both // seen.shape[1], both % seen.shape[1]
    seen[rows, fresh] = True
    return rows, fresh


def dealt(members: DataFrame, block: int) -> DataFrame:
    """Rows of a shard as pairs of blocks (shard, x, y), each a task's work of bounded size."""
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other")).drop("other", "blocks")


def build_edges(pairs: DataFrame, wider: int = 1) -> DataFrame:
    """(id, edges): adjacency lists of the graphs of all shards, united per vector; ``wider`` times the usual pool and degree."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids = rows["id"].to_numpy()
        edges = graph(np.stack(rows["vector"].to_numpy()), 24 * wider, 64 * wider) if len(ids) > 1 else np.full((1, 1), -1)
        return pd.DataFrame({"id": ids, "edges": [ids[e[e >= 0]] for e in edges]})

    lists = pairs.groupBy("shard", "x", "y").applyInPandas(build, "id long, edges array<long>")
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges"))


def search_shards(pairs: DataFrame, threshold: float, beam: int) -> DataFrame:
    """(id, n, other): links found for each vector, each pair counted once, and one link towards its part.

    A pair that shares several shards is counted in the first of them. Links that connect
    the found parts are returned, never all pairs.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, copies = rows["id"].to_numpy(), rows["copies"].to_numpy()
        here, x, y = int(rows["shard"].iloc[0]), int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
        vectors, lists = np.stack(rows["vector"].to_numpy()), rows["edges"].tolist()
        ends = np.concatenate(lists).astype(np.int64)
        at = np.minimum(np.searchsorted(ids, ends), len(ids) - 1)
        edges = np.stack((np.repeat(np.arange(len(ids)), [len(e) for e in lists]), at), 1)[ids[at] == ends]
        found = range_search(vectors, both_ways(len(ids), edges), threshold, beam) if len(ids) > 1 else np.zeros((1, 1), bool)
        if x != y:
            block = rows["block"].to_numpy()
            found &= block[:, None] != block[None, :]
        shards = np.stack(rows["shards"].to_numpy())
        earlier = np.zeros(found.shape, bool)
        for a in range(shards.shape[1]):
            for b in range(shards.shape[1]):
                earlier |= (shards[:, a][:, None] == shards[:, b][None, :]) & ((shards[:, a] >= 0) & (shards[:, a] < here))[:, None]
        n = ((found & ~earlier) * copies[None, :]).sum(1)
        label = np.arange(len(ids))
        while True:
            least = np.minimum(label, np.where(found, label[None, :], len(ids)).min(1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        return pd.DataFrame({"id": ids, "n": n, "other": ids[label]})[(n > 0) | (label != np.arange(len(ids)))]

    return pairs.groupBy("shard", "x", "y").applyInPandas(solve, "id long, n long, other long")


def exact_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, n, other) as of ``search_shards``, by comparing all vectors of a length with each other in pairs of blocks."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, copies, block = (rows[c].to_numpy() for c in ("id", "copies", "block"))
        within, vectors = rows["x"].iloc[0] == rows["y"].iloc[0], np.stack(rows["vector"].to_numpy())
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for at in range(0, len(ids), 256):
            near = vectors[at:at + 256] @ vectors.T >= threshold
            near[np.arange(len(near)), at + np.arange(len(near))] = False
            if not within:
                near &= block[at:at + 256, None] != block[None, :]
            n[at:at + 256] = near @ copies
            for i in np.flatnonzero(near.any(1)).tolist():
                parts = np.unique(np.append(label[near[i]], label[at + i]))
                if len(parts) > 1:
                    label[np.isin(label, parts)] = parts[0]
        return pd.DataFrame({"id": ids, "n": n, "other": ids[label]})[n > 0]

    pairs = dealt(classes.select("id", "copies", "vector", F.col("length").alias("shard")), EXACT_BLOCK)
    return cut_lineage(pairs.groupBy("shard", "x", "y").applyInPandas(compare, "id long, n long, other long"))


def true_links(classes: DataFrame, queries: list[tuple[int, list[float]]], threshold: float) -> dict[int, int]:
    """Brute force for a few queries: how many other vectors each links with, its own copies left out."""
    ids, wanted = np.array([q[0] for q in queries]), [np.array(q[1]) for q in queries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            own, vectors, copies = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for length in {len(v) for v in vectors}:
                use = np.array([i for i, v in enumerate(vectors) if len(v) == length])
                asked = np.array([i for i, v in enumerate(wanted) if len(v) == length], np.int64)
                queried = np.stack([wanted[i] for i in asked]).T if len(asked) else None
                for at in range(0, len(use) if len(asked) else 0, 1024):
                    some = use[at:at + 1024]
                    near = np.array([vectors[i] for i in some]) @ queried >= threshold
                    total[asked] += copies[some] @ (near & (own[some][:, None] != ids[asked][None, :]))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])

    return {r["id"]: r["n"] for r in classes.select("id", "vector", "copies").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def drawn_links(classes: DataFrame, threshold: float, queries: int) -> tuple[dict[int, int], int]:
    """True numbers of links of the drawn vectors that have any, and how many were drawn.

    Vectors are drawn by a hash of their id, ``queries`` at first and then four times as
    many, until a quarter of ``queries`` have links or ``MOST_DRAWN`` or all are drawn.
    """
    truth: dict[int, int] = {}
    drawn, order = 0, classes.select("id", "vector").orderBy(F.xxhash64("id"), "id")
    while drawn < MOST_DRAWN and 4 * len(truth) < queries:
        wanted = min(MOST_DRAWN, 4 * drawn if drawn else queries) - drawn
        rows = [(r["id"], r["vector"]) for r in order.offset(drawn).limit(wanted).collect()]
        if rows:
            truth |= {i: n for i, n in true_links(classes, rows, threshold).items() if n > 0}
        drawn += len(rows)
        if len(rows) < wanted:
            break
    return truth, drawn


def link_recall(truth: dict[int, int], found: dict[int, int]) -> float:
    """Share of a vector's links that was found, as the mean over the vectors with links, each counting alike."""
    return sum(min(found.get(i, 0), n) / n for i, n in truth.items()) / len(truth) if truth else 1.0


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, overlap: int = 3, beam: int = 16,
                 least_recall: float = 0.95, audit_queries: int = 200) -> DataFrame:
    """(id, n_links, component_id, kept): vectors linked by cosine similarity of at least the threshold.

    Equal vectors are one class throughout. Centres come from a sample of at most
    ``SAMPLE_PER_SHARD`` vectors per shard, fitted in the tasks; every class goes to its ``overlap`` nearest
    shards. Each shard builds its graph, adjacency lists are united, and each shard's
    members are searched over the united lists. The recall is audited by brute force: the
    share of its links with other vectors that a drawn vector finds, as the mean over those
    that have any, see ``drawn_links``. Below ``least_recall`` the search is repeated with
    twice the overlap, beam, pool, degree and upper centres looked at, and where that does not reach it up to an overlap of
    ``WIDEST`` all vectors are compared with each other. The figure is logged. Links are
    verified in double precision.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing; so do vectors of different lengths with each other. A null id has no links and
    a null component. Rows with a repeated id and vector count as copies. An empty table
    gives no rows; other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("raw"))
    good = rows.where(F.col("id").isNotNull() & usable(F.col("raw")))
    classes = good.groupBy(F.transform("raw", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))).alias("raw")) \
        .agg(F.min("id").alias("id"), F.count("*").alias("copies"))

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [unit(np.array([v]))[0] for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(vectors, pa.list_(pa.float64())), batch.column(0)],
                                             names=["id", "copies", "vector", "raw"])

    classes = cut_lineage(classes.mapInArrow(scaled, "id long, copies long, vector array<double>, raw array<double>")
                          .withColumn("length", F.size("vector")))
    sizes = {r["length"]: r["n"] for r in classes.groupBy("length").agg(F.count("*").alias("n")).collect()}
    wider = 1
    links = linked_counts(classes, sizes, threshold, overlap, beam, wider)
    truth, drawn = drawn_links(classes, threshold, audit_queries)
    own = classes.where(F.col("id").isin(*truth)).select("id") if truth else None
    while own is not None:
        found = {r["id"]: r["n"] for r in own.join(links, "id").groupBy("id").agg(F.sum("n").alias("n")).collect()}
        recall = link_recall(truth, found)
        LOG.info("recall %.4f at overlap %d, mean of %d vectors with links among %d drawn", recall, overlap, len(truth), drawn)
        if recall >= least_recall:
            break
        if overlap >= WIDEST:
            LOG.info("all vectors are compared with each other")
            links = exact_links(classes, threshold)
            break
        overlap, beam, wider = overlap * 2, beam * 2, wider * 2
        links = linked_counts(classes, sizes, threshold, overlap, beam, wider)
    if not truth:
        LOG.info("recall not measured: none of %d drawn vectors has a link", drawn)
    groups = linked_groups(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("id").agg(F.sum("n").alias("n"))
    named = cut_lineage(classes.join(counted, "id", "left").join(groups, "id", "left")
                        .select("raw", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("group", "id").alias("component_id")))
    keyed = rows.withColumn("key", F.when(F.col("id").isNotNull() & usable(F.col("raw")),
                                          F.transform("raw", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))))
    return keyed.join(named.withColumnRenamed("raw", "key"), "key", "left") \
        .select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")) \
        .withColumn("kept", F.col("id") == F.col("component_id"))


def linked_counts(classes: DataFrame, sizes: dict[int, int], threshold: float, overlap: int, beam: int, wider: int = 1) -> DataFrame:
    """(id, n, other) of ``search_shards`` for all classes; vectors of each length have shards of their own.

    Candidates, degree and upper centres looked at are ``wider`` times the usual.
    """
    models: dict[int, tuple[int, Shards]] = {}
    base = 0
    for length, n in sorted(sizes.items()):
        shards = max(1, min(MOST_SHARDS, -(-n * overlap // SHARD_ROWS)))
        models[length] = (base, fit_shards(classes.where(F.col("length") == length).select("id", "vector"), n, length, shards))
        base += len(models[length][1].lower)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            out = np.full((len(vectors), overlap), -1, np.int64)
            for length in {len(v) for v in vectors}:
                use = [i for i, v in enumerate(vectors) if len(v) == length]
                first, model = models[length]
                names = model.nearest(np.array([vectors[i] for i in use]), overlap, 4 * wider)
                out[use, :names.shape[1]] = np.where(names >= 0, names + first, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.tolist(), pa.list_(pa.int64()))], names=["id", "copies", "vector", "shards"])

    placed = cut_lineage(classes.select("id", "copies", "vector").mapInArrow(assign, "id long, copies long, vector array<double>, shards array<long>"))
    members = placed.withColumn("shard", F.explode(F.filter(F.array_distinct("shards"), lambda s: s >= 0)))
    pairs = dealt(members, BLOCK)
    edges = cut_lineage(build_edges(pairs.select("shard", "x", "y", "id", "vector"), wider))
    return cut_lineage(search_shards(pairs.join(edges, "id"), threshold, beam))
