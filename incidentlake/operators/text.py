"""TF-IDF terms and text vectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab
from ..session import cut_lineage
from . import words
from .words import Ranges, frequent_terms, from_packs, numbered, parts_of, word_ranges, word_uses, words_of

VOCABULARY = "term string, idx int, document_count bigint, frequency bigint, idf double"
COUNTS = "term string, texts long, uses long"
#: Texts and words of an Arrow batch that are worked on at once.
STEP_TEXTS, STEP_WORDS = 1000, 500_000
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased words of two and more letters or digits, without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def neighbours(words: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Combine every word with the next one."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), combine)


def unigrams_and_bigrams(words: Column) -> Column:
    return F.concat(words, neighbours(words, pair))


def term_counts(part: pa.LargeListArray, frequent: frozenset[str] | None) -> pa.RecordBatch:
    """(term, texts, uses) of the words and word pairs of some texts; of all words, or of the frequent ones and the pairs they form."""
    coded = part.flatten().dictionary_encode()
    names, word = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    text = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
    known = np.array([frequent is None or w in frequent for w in names.to_pylist()], bool)[word] if len(word) else np.zeros(0, bool)
    both = known[:-1] & known[1:] & (text[:-1] == text[1:])
    # a word counts as a pair with nothing
    size = len(names) + 1
    code = np.concatenate((word[known] * size, word[:-1][both] * size + word[1:][both] + 1))
    terms, place = np.unique(code, return_inverse=True)
    uses = np.bincount(place, minlength=len(terms))
    where = np.unique(place * max(len(part), 1) + np.concatenate((text[known], text[:-1][both])))
    texts = np.bincount(where // max(len(part), 1), minlength=len(terms))
    first, second = np.divmod(terms, size)
    single = names.take(pa.array(first))
    pairs = pc.binary_join_element_wise(single, names.take(pa.array(second - 1, mask=second == 0)), " ")
    return pa.RecordBatch.from_arrays([pc.if_else(pa.array(second == 0), single, pairs), pa.array(texts), pa.array(uses)], names=["term", "texts", "uses"])


def occurrences(part: pa.LargeListArray, terms: Sequence[str], size: int) -> np.ndarray:
    """How often each text holds each term, a word or a pair: one row per text, ``size`` columns."""
    coded = part.flatten().dictionary_encode()
    names = {w: i for i, w in enumerate(coded.dictionary.to_pylist())}
    word, n = coded.indices.to_numpy().astype(np.int64), len(names) + 1
    text = np.repeat(np.arange(len(part)), np.diff(part.offsets.to_numpy()))
    # a word counts as a pair with nothing
    found = {}
    for i, term in enumerate(terms):
        first, _, second = term.partition(" ")
        if first in names and (not second or second in names):
            found[names[first] * n + (names[second] + 1 if second else 0)] = i
    if not found:
        return np.zeros((len(part), size))
    wanted = np.array(sorted(found), np.int64)
    column = np.array([found[c] for c in wanted.tolist()], np.int64)
    near = text[:-1] == text[1:]
    code = np.concatenate((word * n, (word[:-1] * n + word[1:] + 1)[near]))
    place = np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)
    hit = wanted[place] == code
    cells = np.concatenate((text, text[:-1][near]))[hit] * size + column[place[hit]]
    return np.bincount(cells, minlength=len(part) * size).reshape(-1, size).astype(float)


def _term_uses(words: DataFrame, frequent: Sequence[str] | None = None) -> DataFrame:
    """(term, texts, uses) of the words and pairs.

    Words are counted as numbers, some texts of an Arrow batch at a time, and only the
    counts are shuffled: no exchange of texts and no grouping per text.
    """
    wanted = None if frequent is None else frozenset(frequent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).cast(pa.large_list(pa.string()))
            for rows in slices(column):
                yield term_counts(column[rows], wanted)

    return _summed(words.mapInArrow(count, COUNTS))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("uses").alias("uses"))


def _most_used(counts: DataFrame, n: int, min_df: int) -> list[tuple[str, int, int]]:
    """The ``n`` most frequent words and pairs that occur in ``min_df`` texts, as (term, texts, uses)."""
    best = counts.where(F.col("texts") >= min_df).orderBy(F.col("uses").desc(), F.col("term").asc()).limit(n)
    return [tuple(r) for r in best.collect()]


@dataclass
class TfidfModel:
    """Fitted vocabulary: at most ``max_features`` rows (term, idx, document_count, frequency, idf)."""

    vocabulary: DataFrame
    max_features: int
    stop_words: tuple[str, ...] = vocab.STOP_WORDS

    @cached_property
    def terms(self) -> list[tuple[str, float]]:
        """Terms and idf by index; the vocabulary has a fixed maximum size."""
        return [(r["term"], r["idf"]) for r in self.vocabulary.orderBy("idx").select("term", "idf").collect()]

    def vectors(self, df: DataFrame, text: str, output: str = "text_vector") -> DataFrame:
        """Add the unit-length weight vector of each text (length ``max_features``).

        Works batch by batch: no exchange, whatever the number of texts.
        """
        return self.word_vectors(df.withColumn("_words", tokens(F.col(text), self.stop_words)), "_words", output).drop("_words")

    def word_vectors(self, df: DataFrame, words: str, output: str = "text_vector") -> DataFrame:
        """The same from the words of the texts, as ``tokens`` gives them."""
        idf = np.array([v for _, v in self.terms] + [0.0] * (self.max_features - len(self.terms)))
        names, size = [t for t, _ in self.terms], self.max_features

        @F.arrow_udf("array<double>")
        def scaled(column: pa.Array) -> pa.Array:
            column = column.cast(pa.large_list(pa.string()))
            weights = np.zeros((len(column), size))
            for rows in slices(column):
                tf = occurrences(column[rows], names, size)
                weights[rows] = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * idf, 0.0)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * size), pa.array(weights.ravel()))

        raw = df.withColumn("_raw", array_to_vector(scaled(F.col(words))))
        return unit_length(raw, "_raw", output).drop("_raw")

    def weights(self, df: DataFrame, key: str, text: str) -> DataFrame:
        """Non-zero weights as rows (key, idx, term, weight); texts without known terms have none."""
        names = F.split(F.lit("\n".join(t for t, _ in self.terms)), "\n")
        rows = self.vectors(df.select(key, text), text).select(key, vector_to_array("text_vector").alias("w"))
        return rows.select(key, F.posexplode_outer("w").alias("idx", "weight")).where(F.col("weight") != 0).select(
            key, "idx", F.get(names, F.col("idx")).alias("term"), "weight"
        )

    def save(self, path: str) -> None:
        self.vocabulary.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, max_features: int = 600,
             stop_words: Sequence[str] = vocab.STOP_WORDS) -> TfidfModel:
        return cls(spark.read.parquet(path), max_features, tuple(stop_words))


def fit_tfidf(
    train: DataFrame, text: str, max_features: int = 600, min_df: int = 2,
    stop_words: Sequence[str] = vocab.STOP_WORDS,
) -> TfidfModel:
    """Most frequent words and word pairs of the training texts with their inverse document frequency.

    The texts are read into words once; the words are kept in the shared folder.
    """
    words = cut_lineage(train.select(tokens(F.col(text), stop_words).alias("words")))
    return fit_word_tfidf(words, "words", max_features, min_df, stop_words)


def fit_word_tfidf(
    train: DataFrame, words_col: str, max_features: int = 600, min_df: int = 2,
    stop_words: Sequence[str] = vocab.STOP_WORDS,
) -> TfidfModel:
    """``fit_tfidf`` from the words of stored texts, which are scanned several times.

    A pair is never more frequent than its words. So the most frequent words are
    found first, and only they and the pairs they form are counted in full. The
    outcome is exact when the last selected term is more frequent than the words
    left out; otherwise (few texts, flat frequencies) all pairs are counted. At
    most a few times ``max_features`` words reach the driver.
    """
    words = train.select(F.col(words_col).alias("words"))
    uses = words.select(F.explode_outer("words").alias("w")).groupBy("w").agg(F.count("w").alias("uses")).where(F.col("uses") > 0)
    return _fit_terms(uses, lambda frequent: _term_uses(words, frequent), train.count(), max_features, min_df, stop_words)


def fit_packed_tfidf(
    packs: DataFrame, max_features: int = 600, min_df: int = 2, stop_words: Sequence[str] = vocab.STOP_WORDS,
) -> TfidfModel:
    """The same from the texts that ``words.word_packs`` packed, which are scanned two or three times."""
    def count(frequent: Sequence[str] | None) -> DataFrame:
        if frequent is not None and (len(frequent) + 1) ** 2 <= words.MOST_PAIRS:
            return frequent_terms(packs, frequent)
        wanted = None if frequent is None else frozenset(frequent)

        def terms(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                column = batch.column(0)
                for part in slices(column):
                    yield term_counts(column[part].cast(pa.large_list(pa.string())), wanted)

        return _summed(from_packs(packs, terms, COUNTS, "words"))

    n_texts = packs.agg(F.sum("n")).first()[0] or 0
    return _fit_terms(word_uses(packs), count, n_texts, max_features, min_df, stop_words)


def _fit_terms(
    uses: DataFrame, count: Callable[[Sequence[str] | None], DataFrame], n_texts: int, max_features: int, min_df: int, stop_words: Sequence[str],
) -> TfidfModel:
    """The vocabulary from (w, uses) of all words and a count of the terms that frequent words, or all words, form."""
    size = 2 * max_features
    head = uses.orderBy(F.col("uses").desc(), F.col("w").asc()).limit(size).collect()
    frequent = [r["w"] for r in head]
    top = _most_used(count(frequent), max_features, min_df)
    exact = len(head) < size or (len(top) == max_features and top[-1][2] > head[-1]["uses"])
    if not exact:
        top = _most_used(count(None), max_features, min_df)
    rows = [(t, i, n, uses, math.log((1 + n_texts) / (1 + n)) + 1) for i, (t, n, uses) in enumerate(sorted(top))]
    return TfidfModel(uses.sparkSession.createDataFrame(rows, VOCABULARY), max_features, tuple(stop_words))


def incident_text() -> Column:
    """Text that stands for a report: summary, operator and aircraft."""
    return F.concat_ws(" ", "summary", "operator", "aircraft_type")


def embed_text(
    df: DataFrame, text: Column | str, dims: int = 384, output: str = "embedding",
    encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]] | None = None,
) -> DataFrame:
    """Add the unit-length vector (array<float>) of each text.

    The default counts words in ``dims`` buckets, whole Arrow batches at once; a word's bucket is the
    remainder of the first eight hex digits of its MD5. ``encoder`` builds any other
    model once per task and encodes Arrow batches with it; only the text column is
    shipped to Python.
    """
    column = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    if encoder is not None:
        raw = df.withColumn("_v", array_to_vector(_encode(encoder)(column)))
    else:
        return df.withColumn(output, bucket_vectors(dims, word_ranges(df.sparkSession))(F.lower(column)))
    unit = unit_length(raw, "_v", "_unit")
    return unit.withColumn(output, vector_to_array("_unit", "float32")).drop("_v", "_unit")


def slices(lists: pa.LargeListArray) -> Iterator[slice]:
    """Consecutive texts of an Arrow batch, at most ``STEP_TEXTS`` and, unless one alone has more, ``STEP_WORDS`` words."""
    offsets, at = lists.offsets.to_numpy(), 0
    while at < len(lists):
        most = int(np.searchsorted(offsets, offsets[at] + STEP_WORDS, "right")) - 1
        to = max(at + 1, min(most, at + STEP_TEXTS, len(lists)))
        yield slice(at, to)
        at = to


def bucket_vectors(dims: int, ranges: Ranges) -> Callable[[Column], Column]:
    """Unit-length counts of the words of lower-cased texts in buckets, for Arrow batches: each distinct word of some texts is hashed once."""
    def vectors(text: np.ndarray, bucket: np.ndarray, n_texts: int) -> np.ndarray:
        n = np.bincount(text * dims + bucket, minlength=n_texts * dims).reshape(-1, dims).astype(float)
        length = np.sqrt((n * n).sum(1, keepdims=True))
        return (n / np.where(length > 0, length, 1)).astype(np.float32)

    @F.arrow_udf("array<float>")
    def count(column: pa.Array) -> pa.Array:
        unit, at = np.empty((len(column), dims), np.float32), 0
        for part in parts_of(pa.RecordBatch.from_arrays([column], names=["text"]), "text"):
            offsets, word, names = numbered(words_of(part.column(0), ranges, vocab.STOP_WORDS))
            bucket = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims for w in names.to_pylist()], np.int64)[word]
            for i in range(0, len(part), STEP_TEXTS):
                ends = offsets[i:i + STEP_TEXTS + 1]
                n = len(ends) - 1
                unit[at:at + n] = vectors(np.repeat(np.arange(n), np.diff(ends)), bucket[ends[0]:ends[-1]], n)
                at += n
        return pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * dims), pa.array(unit.ravel()))

    return count


def _encode(encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]) -> Callable[[Column], Column]:
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for batch in batches:
            yield pd.Series([[float(x) for x in v] for v in model(batch.tolist())])

    return encode


def unit_length(df: DataFrame, vector: str, output: str) -> DataFrame:
    """Divide vectors by their Euclidean length; a zero vector stays zero."""
    return Normalizer(p=2.0, inputCol=vector, outputCol=output).transform(df)
