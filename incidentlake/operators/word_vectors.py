"""Learned text vectors: words by the company they keep, texts by their words.

Words are counted, neighbours within a window are counted in pairs, and the positive
pointwise mutual information of the pairs is a symmetric matrix over the vocabulary.
Its leading part is found by randomised block power iteration: every round multiplies
the stored rows of the matrix with a block of vectors in the tasks. What reaches the
driver follows the vocabulary, whose size is a parameter, not the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..session import cut_lineage
from .text import tokens

#: Words that one step over texts holds at once, and rows of the matrix in a block.
STEP_WORDS, BLOCK_ROWS = 200_000, 512
VECTORS = "word string, idx int, uses bigint, vector array<double>"


def frequent_words(df: DataFrame, words: str, most_words: int, least_uses: int) -> list[tuple[str, int]]:
    """The ``most_words`` most frequent words used ``least_uses`` times (ties: alphabetical), by name."""
    counts = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("uses")).where(F.col("uses") >= least_uses)
    best = counts.orderBy(F.col("uses").desc(), "word").limit(most_words).collect()
    return sorted((r["word"], r["uses"]) for r in best)


def cooccurrences(df: DataFrame, words: str, vocabulary: Sequence[str], window: int = 5) -> DataFrame:
    """(a, b, n): how often two words of the vocabulary, as numbers a <= b, stand at most ``window`` places apart.

    All words of a text hold a place, also those outside the vocabulary. Pairs are summed
    in the task before they are shuffled. Null lists have no pairs.
    """
    known, size = pa.array(list(vocabulary), pa.string()), len(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).cast(pa.large_list(pa.string()))
            bounds, words_ = column.offsets.to_numpy(), column.values
            at = 0
            while at < len(column):
                # whole texts, about STEP_WORDS words at a time
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + STEP_WORDS, side="right")) - 1)
                coded = words_.slice(int(bounds[at]), int(bounds[to] - bounds[at])).dictionary_encode()
                place = pc.index_in(coded.dictionary, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int64)
                text = np.repeat(np.arange(to - at), np.diff(bounds[at:to + 1]))
                keys = []
                for gap in range(1, window + 1):
                    x, y = ids[:-gap], ids[gap:]
                    use = (x >= 0) & (y >= 0) & (text[:-gap] == text[gap:])
                    keys.append(np.minimum(x[use], y[use]) * size + np.maximum(x[use], y[use]))
                found, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((found // size).astype(np.int32)), pa.array((found % size).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])
                at = to

    rows = df.select(F.coalesce(F.col(words).cast("array<string>"), F.array().cast("array<string>")).alias("words"))
    return rows.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def mutual_information(pairs: DataFrame) -> DataFrame:
    """(i, j, value): positive pointwise mutual information of the pairs (a, b, n), in both directions.

    A pair of a word with itself counts once for each of its two places. Pairs that meet
    no more often than words at random have no row.
    """
    twice = F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))
    both = pairs.select(F.col("a").alias("i"), F.col("b").alias("j"), twice.alias("n")) \
        .unionByName(pairs.where("a <> b").select(F.col("b").alias("i"), F.col("a").alias("j"), "n"))
    both = cut_lineage(both)
    margins = cut_lineage(both.groupBy("i").agg(F.sum("n").alias("total")))
    whole = margins.agg(F.sum("total")).first()[0] or 0
    # one row per word of the vocabulary
    joined = both.join(F.broadcast(margins), "i").join(F.broadcast(margins.select(F.col("i").alias("j"), F.col("total").alias("other"))), "j")
    value = F.log(F.col("n").cast("double") * whole / (F.col("total").cast("double") * F.col("other")))
    return joined.select("i", "j", value.alias("value")).where("value > 0")


def leading_part(matrix: DataFrame, size: int, dims: int, spare: int = 10, rounds: int = 6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (size x dims) and values of the ``dims`` largest eigenvalues by size of a symmetric matrix (i, j, value).

    ``rounds`` products with a block of ``dims + spare`` vectors turn a random block into
    the leading space; the matrix seen from there is small and solved on the driver. Signs
    are fixed by the largest entry of each vector.
    """
    width = min(size, dims + spare)
    rows = cut_lineage(matrix.groupBy(F.floor(F.col("i") / BLOCK_ROWS).alias("block")).agg(
        F.collect_list("i").alias("i"), F.collect_list("j").alias("j"), F.collect_list("value").alias("value")))

    def times(block: np.ndarray) -> np.ndarray:
        sent = matrix.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    i, j, v = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in range(1, 4))
                    names, own = np.unique(i, return_inverse=True)
                    out = np.zeros((len(names), block.shape[1]))
                    for at in range(0, len(i), 1 << 16):
                        part = slice(at, at + (1 << 16))
                        np.add.at(out, own[part], sent.value[j[part]] * v[part, None])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))],
                                                     names=["i", "row"])

        found = rows.mapInArrow(run, "i int, row array<double>").toArrow()
        out = np.zeros_like(block)
        if found.num_rows:
            out[found.column("i").to_numpy()] = np.stack(found.column("row").to_numpy())
        sent.destroy()
        return out

    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(rounds):
        block = np.linalg.qr(times(block))[0]
    small = block.T @ times(block)
    values, inner = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:dims]
    vectors = block @ inner[:, order]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])] if len(vectors) else np.ones(0)
    return vectors * np.where(largest < 0, -1.0, 1.0), values[order]


@dataclass
class WordVectors:
    """Words, their uses and their vectors (words x dims)."""

    words: list[str]
    uses: np.ndarray
    vectors: np.ndarray
    stop_words: tuple[str, ...] = vocab.STOP_WORDS
    rare: float = 1e-3

    @property
    def dims(self) -> int:
        return self.vectors.shape[1]

    def embed(self, df: DataFrame, text: Column | str, output: str = "embedding") -> DataFrame:
        """Add the unit-length vector (array<float>) of each text: its words' vectors, rare words weighing more.

        A word's weight is rare / (rare + its share of all uses). Texts without a known
        word, null and empty ones have the zero vector. Row by row, in Arrow batches; the
        vectors of the vocabulary are sent to the tasks once.
        """
        known = pa.array(self.words, pa.string())
        weight = self.rare / (self.rare + self.uses / max(self.uses.sum(), 1))
        sent = df.sparkSession.sparkContext.broadcast(np.vstack([self.vectors * weight[:, None], np.zeros((1, self.dims))]))
        dims = self.dims

        @F.arrow_udf("array<float>")
        def encode(column: pa.Array) -> pa.Array:
            column = column.cast(pa.large_list(pa.string()))
            coded = column.flatten().dictionary_encode()
            place = pc.index_in(coded.dictionary, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = place[coded.indices.to_numpy()] if len(place) else np.zeros(0, np.int64)
            text = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
            out = np.zeros((len(column), dims))
            for at in range(0, len(ids), STEP_WORDS):
                part = slice(at, at + STEP_WORDS)
                cells, n = np.unique(text[part] * (len(known) + 1) + ids[part], return_counts=True)
                np.add.at(out, cells // (len(known) + 1), sent.value[cells % (len(known) + 1)] * n[:, None])
            length = np.sqrt((out * out).sum(1, keepdims=True))
            unit = (out / np.where(length > 0, length, 1)).astype(np.float32)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * dims), pa.array(unit.ravel()))

        column = F.col(text) if isinstance(text, str) else text
        return df.withColumn(output, encode(tokens(column, self.stop_words)))

    def neighbours(self, word: str, n: int = 10) -> list[tuple[str, float]]:
        """The ``n`` most similar other words by cosine (ties: alphabetical)."""
        if word not in self.words:
            return []
        length = np.sqrt((self.vectors**2).sum(1))
        own = self.words.index(word)
        near = self.vectors @ self.vectors[own] / np.maximum(length * length[own], 1e-300)
        order = [i for i in sorted(range(len(self.words)), key=lambda i: (-near[i], self.words[i])) if i != own]
        return [(self.words[i], float(near[i])) for i in order[:n]]

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(w, i, int(u), v) for i, (w, u, v) in enumerate(zip(self.words, self.uses.tolist(), self.vectors.tolist(), strict=True))]
        spark.createDataFrame(rows, VECTORS).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, stop_words: Sequence[str] = vocab.STOP_WORDS) -> WordVectors:
        rows = spark.read.schema(VECTORS).parquet(path).orderBy("idx").collect()
        vectors = np.array([r["vector"] for r in rows], float) if rows else np.zeros((0, 0))
        return cls([r["word"] for r in rows], np.array([r["uses"] for r in rows], np.int64), vectors, tuple(stop_words))


def fit_word_vectors(
    df: DataFrame, text: Column | str, dims: int = 100, most_words: int = 20_000, least_uses: int = 5, window: int = 5,
    stop_words: Sequence[str] = vocab.STOP_WORDS, seed: int = 0,
) -> WordVectors:
    """Word vectors from all texts: the texts are read into words once and kept in the shared folder.

    A word's vector is its row of the leading part, scaled by the root of the eigenvalues'
    size. With fewer words than ``dims`` vectors are as long as there are words; without
    any word there are no vectors.
    """
    column = F.col(text) if isinstance(text, str) else text
    words = cut_lineage(df.select(tokens(column, stop_words).alias("words")))
    vocabulary = frequent_words(words, "words", most_words, least_uses)
    names = [w for w, _ in vocabulary]
    uses = np.array([u for _, u in vocabulary], np.int64)
    if not names:
        return WordVectors([], uses, np.zeros((0, 0)), tuple(stop_words))
    matrix = mutual_information(cooccurrences(words, "words", names, window))
    vectors, values = leading_part(matrix, len(names), min(dims, len(names)), seed=seed)
    return WordVectors(names, uses, vectors * np.sqrt(np.abs(values)), tuple(stop_words))

