"""Phrase collocations from counts of longest windows alone: ROLLUP sums the shorter prefixes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, mixed

#: Bytes of text that are taken apart at once.
SLICE = 3 << 20
#: Bits of a filter per key, and at most: 16 MB, whatever the number of keys.
KEY_BITS, MOST_BITS = 16, 1 << 27
#: Bits of a hash that are left out of the keys of a filter; 40 are kept.
SHIFT = np.uint64(24)
#: Parts that the best phrases of a language are first looked for in.
PARTS = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD, BLANK, CUT = 0, 1, 2
KIND = np.full(256, WORD, np.uint8)
KIND[[9, 32]] = BLANK
KIND[[10, 11, 12, 13, *map(ord, ".,;:!?")]] = CUT


@dataclass(frozen=True)
class Words:
    """Words of some texts in their order.

    ``own`` is the number of each word among the distinct (language, word) pairs, whose
    64-bit hashes are ``keys``, languages ``langs`` and spellings ``spelled``. ``joined``
    says that the next word follows in the same piece, ``counted`` that windows starting
    here are counted here.
    """

    own: np.ndarray
    lang: np.ndarray
    joined: np.ndarray
    counted: np.ndarray
    keys: np.ndarray
    spelled: pa.Array


def segments(data: np.ndarray, a: int, b: int, order: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, counted to) of the stretches of one text that are taken apart one by one.

    A stretch ends between words; the last ``order - 1`` words of all but the last one
    belong to the next as well, and windows that start there are counted there.
    """
    while True:
        size = SLICE
        while True:
            end = min(a + size, b)
            while end < b and KIND[data[end]] == WORD:
                end += 1
            if end >= b:
                yield a, b, b
                return
            inside = KIND[data[a:end]] == WORD
            starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
            if len(starts) >= order:
                break
            size *= 2
        again = a + int(starts[1 - order]) if order > 1 else end
        yield a, end, again
        a = again


def slices(texts: pa.Array, langs: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, starts, counted to, language) of stretches joined to about ``SLICE`` bytes; each ends with a cut."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, values = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    held: list[tuple[np.ndarray, int, int]] = []
    size = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(x[0]) + 1 for x in held])
        starts = np.cumsum(sizes) - sizes
        return (np.concatenate([y for x in held for y in (x[0], np.array([10], np.uint8))]), starts,
                starts + np.array([x[1] for x in held]), np.array([x[2] for x in held]))

    for i in range(len(texts)):
        for a, b, to in segments(data, int(offsets[i]), int(offsets[i + 1]), order):
            if held and size + b - a > SLICE:
                yield joined()
                held, size = [], 0
            held.append((data[a:b], to - a, int(langs[i])))
            size += b - a + 1
    if held:
        yield joined()


def words_of(raw: np.ndarray, starts: np.ndarray, counted_to: np.ndarray, langs: np.ndarray, seeds: list[int]) -> Words | None:
    """The words of a slice; None without any."""
    kind = KIND[raw]
    inside = kind == WORD
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return None
    places = np.concatenate(([0], np.cumsum(last - first)))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(LOWER[raw[inside]])]).dictionary_encode()
    stretch = np.searchsorted(starts, first, side="right") - 1
    size = len(found.dictionary)
    distinct, own = np.unique(langs[stretch] * size + found.indices.to_numpy(), return_inverse=True)
    spelled = found.dictionary.take(pa.array(distinct % size))
    digest = xxhash.xxh64_intdigest
    keys = np.array([digest(w, seeds[k]) for w, k in zip(spelled.to_pylist(), (distinct // size).tolist(), strict=True)], np.uint64)
    piece = np.cumsum(kind == CUT)[first]
    return Words(own, langs[stretch], np.append(piece[1:] == piece[:-1], False), first < counted_to[stretch], keys, spelled)


class Filter:
    """Bits of the hashes of frequent keys: may say yes to another key, never no to one of them."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(64 * len(bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def frequent_bits(keys: DataFrame, least: int) -> np.ndarray:
    """Bits for a filter of the keys whose counts (key, n) sum to ``least`` or more.

    They are put together by Spark and come back as words of 64 bits; their number
    follows the number of frequent keys and has a fixed limit.
    """
    frequent = cut_lineage(keys.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"))
    size = 64
    while size < min(MOST_BITS, KEY_BITS * frequent.count()):
        size *= 2
    at = F.col("key").bitwiseAND(F.lit(size - 1))
    words = frequent.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return bits.view(np.uint64)


def over_words(rows: DataFrame, schema: str, make: Callable[[Words, list[str]], list[pa.Array]], order: int) -> DataFrame:
    """What ``make`` says about the words of every slice of the (text, lang) rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spoken = batch.column(1).dictionary_encode()
            languages = spoken.dictionary.to_pylist()
            seeds = [xxhash.xxh64_intdigest(x.encode()) for x in languages]
            for raw, starts, to, langs in slices(batch.column(0), spoken.indices.to_numpy().astype(np.int64), order):
                words = words_of(raw, starts, to, langs, seeds)
                if words is not None:
                    yield pa.RecordBatch.from_arrays(make(words, languages), names=names)

    return rows.mapInArrow(run, schema)


def phrases_from(words: Words, filters: list[Filter], longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``longest`` words: whether the phrase that starts at each word may be frequent, and its hash.

    It may if both phrases one word shorter may and the filter of its length, if there is one, does not deny it.
    """
    first = key = words.keys[words.own]
    may = np.ones(len(first), bool)
    for k in range(1, longest + 1):
        if k > 1:
            may = may & np.append(may[1:], False) & words.joined
            with np.errstate(over="ignore"):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.append(first[k - 1:], np.zeros(min(k - 1, len(first)), np.uint64)))
        if k <= len(filters):
            asked = np.flatnonzero(may)
            may = np.zeros(len(first), bool)
            may[asked] = filters[k - 1](key[asked] >> SHIFT)
        yield may, key >> SHIFT


def windows(docs: DataFrame, lang_col: str, text_col: str, least: int, order: int) -> DataFrame:
    """(window, n): how often each window of ``order`` words in a row occurs, as its language and words between line ends.

    A window starts at every word; past the end of its piece it is padded with empty
    words. Where its first words occur less than ``least`` times in the language, or any
    words in a row among them do, no phrase that frequent goes on, so the window is padded
    from there: what is left unpadded holds every such phrase, and all windows of a
    language together still count its words. The filters that say so, one for each length
    below ``order``, err only towards less padding.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(F.col(text_col).cast("string").alias("text"), lang)
    sent: list[Broadcast] = []

    def keys(words: Words, languages: list[str]) -> list[pa.Array]:
        *_, (may, key) = phrases_from(words, [Filter(x.value) for x in sent], len(sent) + 1)
        found, n = np.unique(key[may & words.counted], return_counts=True)
        return [pa.array(found.view(np.int64)), pa.array(n)]

    for _ in range(max(order - 1, 1)):
        bits = frequent_bits(over_words(rows, "key long, n long", keys, order), least)
        sent = [*sent, docs.sparkSession.sparkContext.broadcast(bits)]

    def count(words: Words, languages: list[str]) -> list[pa.Array]:
        columns, none = [], len(words.keys)
        for k, (may, _) in enumerate(phrases_from(words, [Filter(x.value) for x in sent], order)):
            columns.append(np.where(may, np.append(words.own[k:], np.full(min(k, len(words.own)), none)), none)[words.counted])
        key = words.lang[words.counted]
        for c in columns:
            key = np.unique(key * (none + 1) + c, return_inverse=True)[1]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        spelled = pa.concat_arrays([words.spelled, pa.array([b""], pa.large_binary())]).cast(pa.large_string()).cast(pa.string())
        lang = pa.array(languages, pa.string()).take(pa.array(words.lang[words.counted][first]))
        return [pc.binary_join_element_wise(lang, *(spelled.take(pa.array(c[first])) for c in columns), "\n"), pa.array(n)]

    # one column is a smaller row; no word holds a line end, and of a language only the last ones count
    return over_words(rows, "window string, n long", count, order).groupBy("window").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, order: int = 4) -> DataFrame:
    """(lang, k, phrase, f): occurrences of all phrases of k words, 1 to ``order``, that occur ``least`` times; k = 0 counts all words.

    Only windows of ``order`` words are counted, over all tasks before anything else is
    done with them; ROLLUP sums them over ever shorter prefixes, and a prefix whose last
    word is not padding is a phrase.
    """
    names = [f"w{k + 1}" for k in range(order)]
    words = F.split("window", "\n")
    counted = windows(docs, lang_col, text_col, least, order).select(
        F.array_join(F.slice(words, F.lit(1), F.size(words) - order), "\n").alias("lang"),
        *[F.element_at(words, k - order).alias(w) for k, w in enumerate(names)], "n")
    summed = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    length = F.coalesce(*[F.when(F.col("rolled") == (1 << (order - k)) - 1, F.lit(k)) for k in range(order + 1)])  # null: all languages
    last = F.coalesce(*[F.when(F.col("k") == k, F.col(w)) for k, w in enumerate(names, 1)])
    return summed.withColumn("k", length).where((F.col("k") == 0) | ((last != "") & (F.col("f") >= least))) \
        .select("lang", "k", F.concat_ws(" ", *names).alias("phrase"), "f")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, order: int = 4, covered: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` best collocations of each language.

    Texts are lower-cased (A to Z), cut at ``. , ; : ! ?`` and line ends into pieces and
    these at blanks and tabs into words. A phrase of 2 to ``order`` words that occurs a
    times, ``least`` at least, has for each cut into two parts that occur l and r times
    the score floor(2,000,000 a / (l + r)); its lowest one counts, of equal ones that of
    the shortest first part. A phrase goes if a longer one that contains it occurs at
    least ``covered`` percent as often. n counts the words of the language. Ranks go by
    score, a (both descending) and phrase in byte order. Products are decimals.

    A null language is "und"; null and empty texts and texts without words add nothing;
    repeated rows count each time; ids and other columns are not read; an empty table
    gives no rows. Texts are taken apart in stretches, so a long one needs no more memory.
    """
    counts = cut_lineage(phrase_counts(docs, lang_col, text_col, least, order).withColumn("id", F.monotonically_increasing_id()))
    known = counts.where("k > 0")
    phrases = counts.where("k > 1").select("id", "lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    # both parts of every cut of every phrase look up their counts in one join
    cuts = phrases.select("id", "lang", "k", "words", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    halves = F.array(F.struct(F.lit(0).alias("side"), F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("part")),
                     F.struct(F.lit(1).alias("side"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("part")))
    found = cuts.select("id", "lang", "cut", F.inline(halves)).join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    sides = F.map_from_entries(F.collect_list(F.struct(F.struct("cut", "side"), "f")))  # two per cut
    l, r = (f"sides[named_struct('cut', c, 'side', {side})]" for side in (0, 1))
    best = F.expr(f"""array_min(transform(sequence(1, k - 1), c -> named_struct(
        'score', (cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast({l} as decimal(19,0)) + cast({r} as decimal(19,0))),
        'cut', c, 'l', {l}, 'r', {r})))""")
    scored = found.groupBy("id").agg(sides.alias("sides")).join(phrases, "id") \
        .select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    lengths = F.filter(F.sequence(F.lit(2), F.col("k")), lambda x: x < F.col("k"))
    inner = F.flatten(F.transform(lengths, lambda size: F.transform(
        F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))))
    longest = phrases.where("k > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a") \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(
        F.expr(f"longer is null or 100 * cast(longer as decimal(19,0)) < {int(covered)} * cast(a as decimal(19,0))")).drop("longer")
    by = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))) \
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).where(F.col("rank") <= top)
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
