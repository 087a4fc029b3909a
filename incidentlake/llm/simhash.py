"""SimHash near-duplicates through a hierarchical index over Gray-ordered fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, linked_groups

#: Rows of one upper node that one task compares; a larger node is dealt out in pairs of blocks.
BLOCK = 8192
#: Fingerprints in a leaf, and children of an inner node.
LEAF, FANOUT = 32, 32
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(rb"[\x20\x09-\x0d]+")


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the shingles of ``words`` words; 0 for a text without words."""
    if not text:
        return 0
    parts = BLANK.split(text.encode("utf-8", "replace").translate(LOWER))
    parts = parts[not parts[0]:len(parts) - (not parts[-1])]
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(words, len(parts)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)])
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 20):
        ones += np.unpackbits(np.frombuffer(raw[at:at + (1 << 20)], np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of each whole text; null and empty texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def masks(bits: int, segments: int | None = None) -> list[int]:
    """Masks such that two fingerprints within ``bits`` agree on all bits of at least one.

    The 64 bits fall into ``bits + 2`` segments; at least two of them are untouched,
    so each pair of segments is a mask.
    """
    parts = segments or bits + 2
    cuts = [64 * i // parts for i in range(parts + 1)]
    whole = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(x) for x in combinations(whole, parts - bits)]


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in the reflected Gray sequence."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over fingerprints in Gray order; a node is what its members share.

    Level 0 holds the fingerprints. Above it each node has a mask of the bits on which
    its up to ``FANOUT`` children agree, and their pattern on these bits.
    """

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        pattern, mask = fps[self.order], np.full(len(fps), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.levels, self.widths = [(pattern, mask)], []
        while len(pattern) > 1:
            width = LEAF if len(self.levels) == 1 else FANOUT
            starts = np.arange(0, len(pattern), width)
            ones, zeros = np.bitwise_and.reduceat(pattern, starts), np.bitwise_or.reduceat(pattern, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & ~(ones ^ zeros)
            pattern = ones & mask
            self.levels.append((pattern, mask))
            self.widths.append(width)

    def pairs(self, other: GrayIndex, bits: int, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of fingerprints of both indexes that differ in at most ``bits`` bits.

        Pairs of nodes go down level by level; a pair is dropped, with all below it,
        as soon as the shared patterns differ in more bits. Wide fronts are cut into
        slices, so that a step holds a bounded number of pairs.
        """
        top_a, top_b = len(self.levels) - 1, len(other.levels) - 1
        stack = [(top_a, top_b, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            la, lb, x, y = stack.pop()
            if len(x) > 1 << 15:
                stack += [(la, lb, x[i:i + (1 << 15)], y[i:i + (1 << 15)]) for i in range(0, len(x), 1 << 15)]
                continue
            (pa_, ma), (pb, mb) = self.levels[la], other.levels[lb]
            near = np.bitwise_count((pa_[x] ^ pb[y]) & ma[x] & mb[y]) <= bits
            if itself:
                near &= (x <= y) if la == lb else near
            x, y = x[near], y[near]
            if not len(x):
                continue
            if la == 0 and lb == 0:
                if itself:
                    x, y = x[x < y], y[x < y]
                yield self.order[x], other.order[y]
                continue
            if la >= lb:
                x, y = down(x, y, self.widths[la - 1], len(self.levels[la - 1][0]))
            if lb >= la:
                y, x = down(y, x, other.widths[lb - 1], len(other.levels[lb - 1][0]))
            stack.append((la - (la >= lb), lb - (lb >= la), x, y))


def down(nodes: np.ndarray, others: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace each node by its children, repeating what it is paired with."""
    children = (nodes[:, None] * width + np.arange(width)).ravel()
    inside = children < n
    return children[inside], np.repeat(others, width)[inside]


def forest(fps: np.ndarray, bits: int, blocks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is within ``bits`` among these fingerprints, at most one per fingerprint.

    With ``blocks`` (False and True) only pairs between the two blocks are compared.
    """
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    if blocks is None:
        index = GrayIndex(fps)
        found = index.pairs(index, bits, True)
    else:
        first, second = np.flatnonzero(~blocks), np.flatnonzero(blocks)
        if not len(first) or not len(second):
            return []
        found = ((first[x], second[y]) for x, y in GrayIndex(fps[first]).pairs(GrayIndex(fps[second]), bits, False))
    links = []
    for x, y in found:
        apart = root[x] != root[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def node_links(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b): links within each upper node (part, node, x, y) of (id, fp, block)."""

    def solve(ids: np.ndarray, fps: np.ndarray, blocks: np.ndarray, x: int, y: int) -> Iterator[tuple[int, int]]:
        for i, j in forest(fps, bits, None if x == y else blocks == y):
            yield int(ids[i]), int(ids[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        out: list[tuple[int, int]] = []

        def flush(rest: bool) -> np.ndarray | None:
            """Compare all nodes that ended; return the rows of the last one, which may go on."""
            rows = np.concatenate(held)
            cuts = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            bounds = [0, *cuts.tolist(), len(rows)]
            last = len(bounds) - 1 - (not rest)
            for a, b in zip(bounds[:last], bounds[1:last + 1], strict=True):
                if b - a == 2:  # most nodes hold a pair
                    near = (int(rows[a, 5]) ^ int(rows[a + 1, 5])) & 0xFFFFFFFFFFFFFFFF
                    if near.bit_count() <= bits and (rows[a, 2] == rows[a, 3] or rows[a, 6] != rows[a + 1, 6]):
                        out.append((int(rows[a, 4]), int(rows[a + 1, 4])))
                elif b - a > 2:
                    one = rows[a:b]
                    out.extend(solve(one[:, 4], one[:, 5].view(np.uint64) if one[:, 5].flags.c_contiguous else one[:, 5].copy().view(np.uint64),
                                     one[:, 6], int(one[0, 2]), int(one[0, 3])))
            return None if rest else rows[bounds[last]:]

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(i).to_numpy() for i in range(7)], axis=1))
                tail = flush(False)
                held = [tail]
                if out:
                    yield pairs_batch(out)
                    out.clear()
        if held:
            flush(True)
            if out:
                yield pairs_batch(out)

    return rows.select(*(F.col(c).cast("long") for c in ("part", "node", "x", "y", "id", "fp", "block"))).mapInArrow(run, "a long, b long")


def pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(pairs, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def near_links(distinct: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (id, fp) within ``bits`` bits.

    The root level of the index are the fixed masks of ``masks``: each pair within the
    bound shares a node there. Nodes with one fingerprint end at once. A node of more
    than ``block`` rows is dealt out as pairs of blocks, each a task's work of bounded
    size, so nothing is left out. Below the node the index of ``GrayIndex`` searches,
    and only links that join parts are returned, never all pairs.
    """
    parts = masks(bits)
    nodes = distinct.select("id", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in parts]))
                            .alias("part", "node"))
    sizes = nodes.groupBy("part", "node").agg(F.count("*").alias("n")).where("n > 1")
    rows = nodes.join(sizes, ["part", "node"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")) \
        .withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("part", "node", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "id", "fp", "block")
    spread = dealt.repartition("part", "node", "x", "y").sortWithinPartitions("part", "node", "x", "y", "id")
    return node_links(spread, bits)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(id, fingerprint, component_id): near-duplicate groups of all documents.

    Texts without words (null, empty, blank) have the fingerprint zero and link like
    any other. A null id takes part in no group: its row has its fingerprint and a null
    component. Repeated rows give repeated rows. An empty table gives no rows. Other
    columns of the input are not read.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    distinct = cut_lineage(prints.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    groups = linked_groups(near_links(distinct, bits))
    named = distinct.join(groups, "id", "left").select("fp", F.coalesce("group", "id").alias("component_id"))
    joined = prints.join(named, "fp", "left")
    return joined.select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                         F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents whose id is the smallest of its group, once each; null ids stay.

    Of rows that repeat an id the one with the smallest text stays, a null text counting as empty.
    """
    leaders = groups.where("id = component_id").select(F.col("id").alias(id_col)).distinct()
    named = docs.where(F.col(id_col).isNotNull()).join(leaders, [id_col], "left_semi").groupBy(F.col(id_col).alias("_id")) \
        .agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col(text_col), F.lit(""))).alias("_row")).select("_row.*")
    return docs.where(F.col(id_col).isNull()).unionByName(named)
