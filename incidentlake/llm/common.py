"""Helpers shared by the corpus operators: tables, text chunks, hashing of words, linked groups."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

__all__ = ["table", "crc_of", "chunks", "code_points", "kept_in_worker", "matching_points", "Spans", "linked_groups", "cut_lineage"]

#: Characters and texts that one step over texts holds at once; a longer text is a step of its own.
CHUNK_CHARS, CHUNK_ROWS = 400_000, 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of(key: str) -> Column:
    """CRC-32 of a key written as text; a null key counts as the text "null"."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null")).cast("binary"))


#: Places that the rows of a sample are chosen from.
PLACES = 1 << 62


def place_of(key: str) -> Column:
    """Place of a row among ``PLACES`` by a hash of its key; a null key counts as the text "null"."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null"))), 2)


def share_of(wanted: int, rows: int) -> int:
    """Places below which about ``wanted`` of ``rows`` rows lie; never none, whatever the number of rows."""
    return min(PLACES, -(-PLACES * wanted // rows))


def chunks(texts: list[str], limit: int = CHUNK_CHARS, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Consecutive slices of at most ``rows`` texts that have about ``limit`` characters together."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and (held + len(text) > limit or i - start >= rows):
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each text after a 0, and the place of each text's 0."""
    joined = "\0" + "\0".join(t.replace("\0", " ") if "\0" in t else t for t in texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.flatnonzero(points == 0)


def kept_in_worker(name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, made once in a Python worker and kept from task to task."""
    shelf = sys.modules.setdefault("_incidentlake_shelf", types.ModuleType("_incidentlake_shelf"))
    if not hasattr(shelf, name):
        setattr(shelf, name, build())
    return getattr(shelf, name)


def matching_points(kind: str, library: Any = re) -> np.ndarray:
    """Which code points match a class of characters (a pattern of ``library``), found a slice at a time."""
    known, width = np.zeros(0x110000, bool), 1 << 14
    runs = library.compile(f"(?:{kind})+")
    for at in range(0, 0x110000, width):
        for m in runs.finditer("".join(map(chr, range(at, at + width)))):
            known[at + m.start():at + m.end()] = True
    return known


def powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor % (1 << 64), np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Spans:
    """64-bit hashes of spans of ``values``, equal for equal spans.

    Prefix sums of a polynomial with an odd base, shifted to the span's start: the cost
    of a hash does not depend on the length of the span. Results are mixed afterwards.
    """

    def __init__(self, values: np.ndarray, base: int = 0x9E3779B97F4A7C15):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        with np.errstate(over="ignore"):
            self.powers = powers(base, len(values) + 1)
            np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.powers[:-1], out=self.sums[1:])
        self.back = powers(pow(base, -1, 1 << 64), len(values) + 1)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
            return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def hash_without(self, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the spans with ``values[a:b]`` cut out; equal to those of spans that read the same."""
        with np.errstate(over="ignore"):
            raw = (self.sums[a] - self.sums[starts]) * self.back[starts]
            raw = raw + (self.sums[ends] - self.sums[b]) * self.back[b] * self.powers[a - starts]
            return mixed(raw + (ends - starts - (b - a)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; different values stay different."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def linked_groups(links: DataFrame) -> DataFrame:
    """Groups of linked ids: (id, group), group being the smallest id of the group.

    ``links`` has long columns a and b. Each round moves every link's larger end to
    the smallest neighbour, once among larger and once among smaller neighbours, so
    that chains shrink by a constant factor and each group ends as a star. All steps
    are joins and combined minima over ids; a round is kept in the shared folder and
    the loop ends when a round changes nothing. Ids without a link are not returned;
    links with a null end or between equal ids are ignored; no links give no rows.
    """
    edges = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")) \
        .where("a is not null and b is not null and a <> b") \
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = cut_lineage(edges), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        # towards larger neighbours: v's neighbours above v hang on v's smallest neighbour
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # towards smaller neighbours: all of them and u itself hang on the smallest
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u")
        edges = cut_lineage(down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .union(low.select("u", F.col("m").alias("v"))).distinct())
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("group"))
    return stars.union(edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())
