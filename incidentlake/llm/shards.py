"""Shards of equal bytes by k-d tree partitioning, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage

#: Steps of a dimension, of the order of texts within a step, and of ids within one of those.
STEPS, TEXT_STEPS, ID_STEPS = 1024, 4096, 4096
#: Part of a shard's bytes that may lie on the wrong side of a cut before it is cut finer.
TOLERANCE = 0.002
#: Rows that are numbered together, and the most such blocks of a shard.
BLOCK_ROWS, MOST_BLOCKS = 50_000, 16_384


@dataclass
class Node:
    """A box of the tree; leaves have one shard, others a cut (dimension, step, text step, id step)."""

    first: int
    shards: int
    number: int
    cut: tuple[int, int, int, int] | None = None
    below: list[Node] = field(default_factory=list)


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, text_crc32, text_key, dimensions): what a shard is chosen by; equal texts are equal in all but the id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, chars = F.octet_length(text).cast("long"), F.length(text)
    return docs.select(
        F.col(id_col).cast("long").alias("id"), (size + 16).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_key"),
        F.array(F.log2((size + 16).cast("double")), F.when(chars > 0, size / chars).otherwise(F.lit(1.0)),
                (F.length(F.translate(text, " \n", "")) / F.greatest(chars, F.lit(1))).cast("double")).alias("dims"))


def stepped(rows: DataFrame, dims: int) -> DataFrame:
    """Every dimension as a step number between its least and largest value, and the steps of texts and ids."""
    ends = rows.agg(*(f(F.col("dims")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    steps = []
    for d in range(dims):
        lo, hi = ends[f"lo{d}"], ends[f"hi{d}"]
        flat = lo is None or not lo < hi
        steps.append(F.lit(0) if flat else F.least(F.width_bucket(F.col("dims")[d], F.lit(lo), F.lit(hi), F.lit(STEPS)), F.lit(STEPS)).cast("int"))
    return rows.select("id", "size", "text_crc32", F.array(*steps).alias("steps"), F.pmod("text_key", F.lit(TEXT_STEPS)).cast("int").alias("text_step"),
                       F.pmod(F.xxhash64("id", "text_key"), F.lit(ID_STEPS)).cast("int").alias("id_step"))


def into_boxes(rows: DataFrame, cuts: list[tuple[int, ...]]) -> DataFrame:
    """Move rows of a cut box into one of its halves; the order is step of the dimension, of the text, of the id.

    ``cuts``: (box, dimension, step, text step, id step, left, right) for every box of a level.
    """
    names = ("box", "dim", "cut", "cut_text", "cut_id", "left_box", "right_box")
    table = rows.sparkSession.sql(f"select * from values {', '.join(map(str, cuts))} as t({', '.join(names)})")
    at = F.col("steps")[F.col("dim")]
    before = (at < F.col("cut")) | ((at == F.col("cut")) & ((F.col("text_step") < F.col("cut_text")) | (
        (F.col("text_step") == F.col("cut_text")) & (F.col("id_step") < F.col("cut_id")))))
    # a row for each box of the level
    return rows.join(F.broadcast(table), "box", "left") \
        .withColumn("box", F.when(F.col("dim").isNull(), F.col("box")).when(before, F.col("left_box")).otherwise(F.col("right_box"))).drop(*names[1:])


def crossing(weights: list[tuple[int, int]], goal: float) -> tuple[int, float, int]:
    """The step in which the running sum reaches the goal, the sum before it and its weight."""
    before = 0
    for step, weight in sorted(weights):
        if before + weight >= goal:
            return step, before, weight
        before += weight
    return weights and max(weights)[0] or 0, before, 0


def kd_tree(rows: DataFrame, dims: int, shards: int) -> DataFrame:
    """Rows with their shard: boxes are cut at weighted medians until each is one shard.

    All boxes of a level are cut together. One job sums the bytes of each step of each
    dimension of each box; the widest dimension is cut where the running sum reaches the
    part its left side is due. If the step that holds the cut is heavy, a second job sums
    it by the texts' order, and a third, only where one text's copies are heavy, by ids,
    so that equal texts part only where they must. What comes back is bounded by boxes
    times steps.
    """
    root = Node(0, shards, 0)
    number, level, leaves = 1, [root] if shards > 1 else [], [root] if shards == 1 else []
    rows = rows.withColumn("box", F.lit(0))
    while level:
        open_ = {n.number: n for n in level}
        boxed = rows.where(F.col("box").isin(*open_))
        sums: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r in boxed.select("box", "size", F.posexplode("steps").alias("dim", "step")).groupBy("box", "dim", "step").agg(F.sum("size").alias("w")).collect():
            sums.setdefault((r["box"], r["dim"]), []).append((r["step"], r["w"]))
        goals: dict[int, float] = {}
        unsure: dict[int, tuple[int, int, float, float]] = {}  # box: dimension, step, goal within the step, allowed error
        for number_, node in open_.items():
            widths = [(max(s for s, _ in sums[number_, d]) - min(s for s, _ in sums[number_, d]) if (number_, d) in sums else 0, -d) for d in range(dims)]
            dim = -max(widths)[1]
            own = sums.get((number_, dim), [])
            total = sum(w for _, w in own)
            goals[number_] = total * (node.shards // 2) / node.shards
            step, before, _ = crossing(own, goals[number_])
            node.cut = (dim, step, 0, 0)
            unsure[number_] = (dim, step, goals[number_] - before, TOLERANCE * total / node.shards)
        for column, place in (("text_step", 2), ("id_step", 3)):
            if not unsure:
                break
            inside = F.lit(False)
            for number_, (dim, step, _, _) in unsure.items():
                here = (F.col("box") == number_) & (F.col("steps")[dim] == step)
                inside = inside | (here & (F.col("text_step") == open_[number_].cut[2]) if place == 3 else here)
            parts: dict[int, list[tuple[int, int]]] = {}
            for r in boxed.where(inside).groupBy("box", column).agg(F.sum("size").alias("w")).collect():
                parts.setdefault(r["box"], []).append((r[column], r["w"]))
            rest = {}
            for number_, (dim, step, goal, allowed) in unsure.items():
                at, before, weight = crossing(parts.get(number_, []), goal)
                if weight > allowed and place == 2:
                    rest[number_] = (dim, step, goal - before, allowed)
                elif goal - before > weight / 2:
                    at += 1
                cut = list(open_[number_].cut)
                cut[place] = at
                open_[number_].cut = tuple(cut)
            unsure = rest
        fresh, cuts = [], []
        for node in level:
            left = node.shards // 2
            node.below = [Node(node.first, left, number), Node(node.first + left, node.shards - left, number + 1)]
            cuts.append((node.number, *node.cut, number, number + 1))
            number += 2
            fresh += [n for n in node.below if n.shards > 1]
            leaves += [n for n in node.below if n.shards == 1]
        rows, level = into_boxes(rows, cuts), fresh
    first = {n.number: n.first for n in leaves}
    named = rows.sparkSession.sql(f"select * from values {', '.join(map(str, first.items()))} as t(box, shard)")
    return rows.join(F.broadcast(named), "box")


def numbered(rows: DataFrame, count: int, shards: int) -> DataFrame:
    """A gapless slot for every row of a shard, without bringing a shard into one task."""
    blocks = max(64, min(MOST_BLOCKS, count // (shards * BLOCK_ROWS)))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(blocks)).cast("int"))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    before = sizes.select("shard", "block", (F.sum("rows").over(W.partitionBy("shard").orderBy("block")) - F.col("rows")).alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")) - 1
    # at most shards * MOST_BLOCKS rows
    return placed.withColumn("within", within).join(F.broadcast(before), ["shard", "block"]) \
        .withColumn("slot", (F.col("before") + F.col("within")).cast("long")).drop("block", "within", "before")


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot): documents in shards of nearly equal bytes.

    Either the number of shards or the bytes each should reach. A document's size is its
    text's UTF-8 bytes plus 16. The tree's dimensions are the size, the bytes per character
    and the share of characters that are not blanks; equal texts are equal in all of them
    and keep together, unless a cut falls into a group of copies that is too heavy for one
    side. A null text counts as empty, a null id is an id like any other, repeated rows
    take a slot each. An empty table gives no rows; other columns are not read.
    """
    raw = describe(docs, id_col, text_col)
    rows = cut_lineage(stepped(raw, 3))
    totals = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    if shards is None:
        if not target_bytes or target_bytes < 1:
            raise ValueError("give the number of shards or the bytes of one")
        shards = max(1, -(-(totals["bytes"] or 0) // target_bytes))
    placed = kd_tree(rows, 3, shards if totals["n"] else 1).select("id", "size", "text_crc32", F.col("shard").cast("int"))
    return numbered(placed, totals["n"], shards).select("id", "size", "text_crc32", "shard", "slot")
