"""Words of texts as numbers, in packs: some rows with their words, as one compressed Arrow stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of texts in a pack, and texts whose terms are counted at once.
PACK_BYTES, STEP_TEXTS = 1 << 24, 1000
#: Pairs of words up to which a table of all of them is kept.
MOST_PAIRS = 1 << 24
Ranges = tuple[np.ndarray, np.ndarray]
_BYTES = np.arange(256)
_ASCII = np.array([b < 128 and (chr(b).isalnum() or b == ord("_")) for b in range(256)])
#: Bytes of a character by the first of them.
_SIZE = 1 + (_BYTES >= 0xC0) + (_BYTES >= 0xE0) + (_BYTES >= 0xF0)


@cache
def word_ranges(spark: SparkSession) -> Ranges:
    """First and last characters of the runs beyond ASCII that count as letters or digits in a regex of the session."""
    code = F.col("id")
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    found = spark.range(128, 0x110000).where(~code.between(0xD800, 0xDFFF)).where(char.rlike(r"[\p{L}\p{N}]"))
    points = np.sort(found.toPandas()["id"].to_numpy())
    ends = np.flatnonzero(np.diff(points) != 1)
    return points[np.append(0, ends + 1)], points[np.append(ends, len(points) - 1)]


def words_of(texts: pa.Array, ranges: Ranges, stop_words: Sequence[str] = ()) -> pa.LargeListArray:
    """The words of lower-cased texts as ``text.tokens`` finds them, by their place in one list of words; null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    run = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = _ASCII[run]
    lead = np.flatnonzero(run >= 0xC0)
    if len(lead):
        size = _SIZE[run[lead]]
        point = run[lead] & (0x7F >> size)
        for j in range(1, 4):
            more = size > j
            point[more] = (point[more] << 6) | (run[lead[more] + j] & 0x3F)
        at = np.searchsorted(ranges[0], point, "right") - 1
        good = (at >= 0) & (point <= ranges[1][at])
        for j in range(4):
            inside[lead[good & (size > j)] + j] = True
    # a word ends with its text, whatever the next one begins with
    edge = np.zeros(len(run) + 1, bool)
    edge[offsets] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, sizes = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sizes -= starts
    long = sizes > _SIZE[run[starts]]
    for j in range(4):
        inside[starts[~long & (sizes > j)] + j] = False
    starts, sizes = starts[long], sizes[long]
    at = np.searchsorted(starts, offsets)
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    coded = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(upto), pa.py_buffer(run[inside])).dictionary_encode()
    names, word = coded.dictionary, coded.indices.to_numpy()
    if stop_words:
        kept = ~pc.is_in(names, pa.array(list(stop_words), pa.large_string())).to_numpy(zero_copy_only=False)[word]
        at, word = np.concatenate((np.zeros(1, np.int64), np.cumsum(kept)))[at], word[kept]
    # frequent words have small numbers, which take few bytes
    uses = np.bincount(word, minlength=len(names))
    order = np.argsort(-uses, kind="stable")[:np.count_nonzero(uses)]
    place = np.zeros(len(names), np.uint16 if len(order) < 1 << 16 else np.int32)
    place[order] = np.arange(len(order))
    return pa.LargeListArray.from_arrays(pa.array(at), pa.DictionaryArray.from_arrays(pa.array(place[word]), names.take(pa.array(order))))


def word_packs(df: DataFrame, text: str, by: str, stop_words: Sequence[str]) -> DataFrame:
    """(``by``, n, pack): rows with equal ``by`` that a task meets together, in their order, with the words of the lower-cased ``text``."""
    ranges, others = word_ranges(df.sparkSession), [c for c in df.columns if c != text]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in pc.unique(batch.column(by)):
                rows = batch.filter(pc.equal(batch.column(by), value))
                for part in parts_of(rows, text):
                    columns = [*(part.column(c) for c in others), words_of(part.column(text), ranges, stop_words)]
                    whole, sink = pa.RecordBatch.from_arrays(columns, names=[*others, "words"]), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                        stream.write_batch(whole)
                    yield pa.RecordBatch.from_arrays([pa.array([value.as_py()]), pa.array([len(part)]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                                                     names=[by, "n", "pack"])

    return df.mapInArrow(pack, f"{by} string, n long, pack binary")


def parts_of(rows: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts have at most ``PACK_BYTES``, unless one alone has more."""
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(rows.column(text)), 0).to_numpy().astype(np.int64)), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PACK_BYTES, "right")))
        yield rows.slice(at, to - at)
        at = to


def from_packs(packs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, *columns: str) -> DataFrame:
    """``mapInArrow`` over the rows that ``word_packs`` packed; other columns than the named ones are not unpacked."""
    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.column(0):
                names = pa.ipc.open_stream(pack.as_buffer()).schema.names
                wanted = pa.ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns])
                for rows in pa.ipc.open_stream(pack.as_buffer(), options=wanted):
                    yield rows.select(list(columns))

    return packs.select("pack").mapInArrow(lambda batches: run(unpacked(batches)), schema)


def numbered(words: pa.LargeListArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offset of each text, word, names): words are places in ``names``."""
    coded = words.values
    return words.offsets.to_numpy(), coded.indices.to_numpy().astype(np.int64), coded.dictionary


def word_uses(packs: DataFrame) -> DataFrame:
    """(w, uses) of all words."""
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            _, word, names = numbered(batch.column(0))
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(np.bincount(word, minlength=len(names)))], names=["w", "uses"])

    return from_packs(packs, count, "w string, uses long", "words").groupBy("w").agg(F.sum("uses").alias("uses"))


def frequent_terms(packs: DataFrame, frequent: Sequence[str]) -> DataFrame:
    """(term, texts, uses) of the frequent words and the pairs they form, counted in each task and then summed."""
    rank, size = {w: i for i, w in enumerate(frequent)}, len(frequent) + 1

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a word counts as a pair with nothing
        uses, texts = np.zeros(len(rank) * size, np.int64), np.zeros(len(rank) * size, np.int64)
        for batch in rows:
            offsets, word, names = numbered(batch.column(0))
            known = np.array([rank.get(w, -1) for w in names.to_pylist()], np.int64)[word] if len(word) else word
            text = np.repeat(np.arange(len(batch)), np.diff(offsets))
            both = (known[:-1] >= 0) & (known[1:] >= 0) & (text[:-1] == text[1:])
            code = np.concatenate((known[known >= 0] * size, known[:-1][both] * size + known[1:][both] + 1))
            uses += np.bincount(code, minlength=len(uses))
            code += np.concatenate((text[known >= 0], text[:-1][both])) * len(uses)
            code.sort()
            texts += np.bincount(code[np.flatnonzero(np.diff(code, prepend=-1))] % max(len(uses), 1), minlength=len(uses))
        at = np.flatnonzero(uses)
        first, second = np.divmod(at, size)
        named = pa.array(list(frequent), pa.string())
        pairs = pc.binary_join_element_wise(named.take(pa.array(first)), named.take(pa.array(second - 1, mask=second == 0)), " ")
        yield pa.RecordBatch.from_arrays([pc.if_else(pa.array(second == 0), named.take(pa.array(first)), pairs), pa.array(texts[at]), pa.array(uses[at])],
                                         names=["term", "texts", "uses"])

    return from_packs(packs, count, "term string, texts long, uses long", "words").groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("uses").alias("uses"))


class Assembler:
    """Feature values and the unit-length weights of terms in one vector, as Spark's assembler and normalizer give them."""

    def __init__(self, terms: Sequence[tuple[str, float]], size: int, medians: Mapping[int, float]):
        self.size, self.medians = size, dict(medians)
        self.idf = np.array([v for _, v in terms] + [0.0] * (size - len(terms)))
        self.rank: dict[str, int] = {}
        ends = [term.partition(" ")[::2] for term, _ in terms]
        for word in dict.fromkeys(w for pair in ends for w in pair if w):
            self.rank[word] = len(self.rank) + 1
        # the columns of words and of pairs of words, by their ranks
        self.ranks = len(self.rank) + 1
        code = np.array([self.rank[first] * self.ranks + self.rank.get(second, 0) for first, second in ends], np.int64)
        self.columns = np.argsort(code)
        self.codes = code[self.columns]
        self.table = None
        if self.ranks ** 2 <= MOST_PAIRS:
            self.table = np.full(self.ranks ** 2, -1, np.int32)
            self.table[code] = np.arange(len(code))

    def column(self, first: np.ndarray, second: np.ndarray | int) -> np.ndarray:
        """The columns of words (second: 0) or pairs by their ranks; -1 for those that are no terms."""
        code = first * self.ranks + second
        if self.table is not None:
            return self.table[code]
        if not len(self.codes):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.columns[at], -1)

    def vectors(self, words: pa.LargeListArray, features: np.ma.MaskedArray) -> pa.StructArray:
        """Vectors of rows with these words and features, in the form that Spark stores; masked features take their median."""
        values = features.filled(np.nan)
        for i, median in self.medians.items():
            values[features.mask[:, i], i] = median
        if np.isnan(values).any():
            raise ValueError("a feature has no value")
        offsets, word, names = numbered(words)
        known = np.array([0, *(self.rank.get(w, 0) for w in names.to_pylist())], np.int64)[word + 1]
        parts = [self._weights(known[offsets[i]:offsets[min(i + STEP_TEXTS, len(words))]], np.diff(offsets[i:i + STEP_TEXTS + 1]), i)
                 for i in range(0, len(words), STEP_TEXTS)]
        row, place, weight = map(np.concatenate, zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        n, width = values.shape
        first, index = np.nonzero(values)
        size, counts = width + self.size, np.bincount(first, minlength=n)
        filled = counts + np.bincount(row, minlength=n)
        dense = 1.5 * (filled + 1.0) >= size
        length = np.where(dense, size, filled)
        starts = np.cumsum(length) - length
        whole, places = np.zeros(int(length.sum())), np.zeros(int(length.sum()), np.int32)
        inner = np.arange(len(first)) - (np.cumsum(counts) - counts)[first]
        at = starts[first] + np.where(dense[first], index, inner)
        whole[at], places[at] = values[first, index], index
        later = np.bincount(row, minlength=n)
        inner = counts[row] + np.arange(len(row)) - (np.cumsum(later) - later)[row]
        at = starts[row] + np.where(dense[row], width + place, inner)
        whole[at], places[at] = weight, width + place
        upto = pa.array(np.append(starts, len(whole)).astype(np.int32))
        places = places[np.repeat(~dense, length)]
        sparse = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.where(dense, 0, length)))).astype(np.int32)
        return pa.StructArray.from_arrays([
            pa.array(dense.astype(np.int8)), pa.array(np.full(n, size, np.int32), mask=dense),
            pa.ListArray.from_arrays(pa.array(sparse), pa.array(places), mask=pa.array(dense)), pa.ListArray.from_arrays(upto, pa.array(whole)),
        ], names=["type", "size", "indices", "values"])

    def _weights(self, known: np.ndarray, counts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of some texts, from the ranks of their words."""
        text = np.repeat(np.arange(len(counts)), counts)
        single = self.column(known, 0)
        near = np.flatnonzero((known[:-1] > 0) & (known[1:] > 0) & (text[:-1] == text[1:]))
        pairs = self.column(known[near], known[near + 1])
        cells = np.concatenate(((text * self.size + single)[single >= 0], (text[near] * self.size + pairs)[pairs >= 0]))
        uses = np.bincount(cells, minlength=len(counts) * self.size)
        at = np.flatnonzero(uses)
        row, term = np.divmod(at, self.size)
        weight = (1 + np.log(uses[at].astype(float))) * self.idf[term]
        # one after the other, as a loop over the vector adds them
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(counts)))
        return row + start, term, weight / norm[row]
