"""Product codes of vectors, with entries found by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

#: Rows whose parts are searched at once.
STEP = 4096
#: Labels whose sums are sent to every task at most; more are joined by salted keys, of so many salts.
MOST_SENT, SALTS = 50_000, 64


def most_component(width: int) -> int:
    """Largest size of an integer component for which squared distances, and their sums over 16 parts, are exact in 64 bits."""
    return (1 << 28) // max(width, 1)


class Codebook:
    """Entries of one part, in the order of their component sums."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.width = entries, entries.shape[1]
        sums = entries.sum(1)
        self.order = np.argsort(sums, kind="stable")
        self.sums = sums[self.order]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each point, of equally near ones the first, and its squared distance.

        The search starts at the entry whose sum is next to the point's and goes outward to
        both sides. The squared gap of two sums is at most ``width`` times the squared
        distance, so a side is done once it exceeds ``width`` times the best distance; at
        equality an entry as near may follow, so the search goes on.
        """
        own = points.sum(1)
        at = np.minimum(np.searchsorted(self.sums, own), len(self.sums) - 1)
        best = self.order[at]
        least = self.distance(points, best)
        for step in (-1, 1):
            rows, place = np.arange(len(points)), at + step
            while len(rows):
                inside = (place >= 0) & (place < len(self.sums))
                rows, place = rows[inside], place[inside]
                gap = own[rows] - self.sums[place]
                near = gap * gap <= self.width * least[rows]
                rows, place = rows[near], place[near]
                entry = self.order[place]
                found = self.distance(points[rows], entry)
                better = (found < least[rows]) | ((found == least[rows]) & (entry < best[rows]))
                best[rows[better]], least[rows[better]] = entry[better], found[better]
                place = place + step
        return best, least

    def distance(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = points - self.entries[entry]
        return np.einsum("ij,ij->i", gap, gap)


def integers(column: pa.Array, scale: int, length: int, most: int) -> np.ndarray:
    """floor(scale * x) of each component, rows filled with zeros up to ``length``."""
    column = column.cast(pa.large_list(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), length), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = \
        np.clip(np.floor(scale * flat), -most, most).astype(np.int64)
    return out


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the vectors without a null or non-finite component."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")) \
        .where(F.col("vector").isNotNull()).where(~bad)


def part_sums(rows: DataFrame, books: list[Codebook], scale: int, length: int) -> DataFrame:
    """(part, entry, place, total, n): sums of the parts that each entry is nearest to, combined per task and by Spark."""
    parts, width = len(books), length // len(books)
    most = most_component(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(books[0].entries)
        totals, counts = np.zeros((parts, size, width), np.int64), np.zeros((parts, size), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                found = integers(batch.column(0).slice(a, STEP), scale, length, most)
                for p, book in enumerate(books):
                    part = found[:, p * width:(p + 1) * width]
                    best, _ = book.nearest(part)
                    np.add.at(totals[p], best, part)
                    counts[p] += np.bincount(best, minlength=size)
        part, entry = np.nonzero(counts)
        place = np.tile(np.arange(width), len(part))
        part, entry = np.repeat(part, width), np.repeat(entry, width)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(place.astype(np.int32)),
                                          pa.array(totals[part, entry, place]), pa.array(counts[part, entry])], names=["part", "entry", "place", "total", "n"])

    return rows.select("vector").mapInArrow(run, "part int, entry int, place int, total long, n long") \
        .groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def fit_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """Codebooks (entries x width) of all parts, from (id, label, vector) rows without bad components.

    They start as the parts of the ``entries`` smallest ids, equal ids in the order of
    their vectors and null ids last. Each round reads all rows; only the sums of the
    entries come back, which do not grow with the rows.
    """
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return []
    width = -(-longest // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).toArrow().column("vector").combine_chunks()
    start = integers(first, scale, parts * width, most_component(width))
    books = [start[:, p * width:(p + 1) * width].copy() for p in range(parts)]
    if not width:
        return books
    for _ in range(rounds):
        for part, entry, place, total, n in part_sums(rows, [Codebook(b) for b in books], scale, parts * width).collect():
            books[part][entry, place] = total // n
    return books


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256): product codes of all vectors.

    A component x counts as floor(scale * x); vectors are cut into ``parts`` equal parts,
    each with a codebook of at most ``entries`` (at most 256) entries, fitted in
    ``rounds`` rounds. A code has two hex digits per part, ``error`` is the squared
    distance to the entries, ``label_error`` its sum over equal labels (nulls together).

    Vectors that are null or hold a null or non-finite component have no row. Vectors
    shorter than the longest, or a length that ``parts`` does not divide, count as filled
    up with zeros; empty ones alone have error 0. Components beyond ``most_component``
    (262,144 before scaling where a part has 4) count as that. Repeated rows and ids are
    coded one by one, fewer vectors than entries make fewer entries, ties go to the first
    entry; other columns are not read; an empty table gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = kept_vectors(vectors, id_col, vector_col, label_col)
    fitted = fit_codebooks(rows, parts, entries, rounds, scale)
    digest = codebooks_digest(fitted)
    width = fitted[0].shape[1] if fitted else 0
    most = most_component(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(b) for b in fitted]
        hexes = np.array([f"{i:02x}" for i in range(256)], "U2")
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                found = integers(batch.column(2).slice(a, STEP), scale, parts * width, most)
                chosen, error = np.zeros((len(found), parts), np.int64), np.zeros(len(found), np.int64)
                for p, book in enumerate(books):
                    chosen[:, p], distance = book.nearest(found[:, p * width:(p + 1) * width])
                    error += distance
                code = np.ascontiguousarray(hexes[chosen]).view(f"U{2 * parts}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, STEP), batch.column(1).slice(a, STEP), pa.array(code, pa.string()), pa.array(error)],
                                                 names=["id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    coded = cut_lineage(rows.mapInArrow(run, f"id long, label {kind}, code string, error long"))
    sums = cut_lineage(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    if sums.count() <= MOST_SENT:
        named = coded.join(F.broadcast(sums.withColumnRenamed("label", "of_label")), F.col("label").eqNullSafe(F.col("of_label")))
    else:
        salted = sums.withColumnRenamed("label", "of_label").withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        named = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")) \
            .join(salted, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("salt") == F.col("of_salt")))
    return named.select("id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
