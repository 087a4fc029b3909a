"""Text search over stored postings: the rows that may hold a term are found without reading texts.

Every three neighbouring characters of the searched columns are a gram, stored as one
number. Postings list the keys of the rows with a gram, sorted, one list per block of
keys, so that a list has a bounded length however common its gram is. A search reads
the lists of the term's grams, keeps what all of them have in common and verifies the
term on these rows alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.search import LIST_COLUMNS, SEARCHED, SORT_KEYS, by_decade, by_severity, by_term, check_range, ordered_slice, sort_columns
from ..session import spent_shuffles
from .sinks import read_table, replace_table

#: Keys of a block, folders that postings are dealt to, and characters that are cut into grams at once.
SPAN, BUCKETS, STEP_CHARS = 1 << 16, 64, 500_000
#: Pairs of a row and a gram that a task holds before it passes their lists on.
HELD = 4_000_000
#: Bytes of rows that a task holds before it passes them on in packs.
HELD_BYTES = 1 << 25
#: Grams and texts are met on a grid of at most so many cells, and so many per pair; grams of a folder and a block that are merged at once.
MOST_CELLS, CELLS, GRAMS = 1 << 26, 16, 64
#: Candidates up to which they are sent to every task; with more the texts of their blocks are verified as a whole.
FEW_KEYS = 200_000
#: Bits of a character in a gram.
BITS = 21
#: Keys are stored by their place in the block, from -SPAN / 2 on.
POSTINGS = "gram long, block long, keys array<smallint>, bucket int"
#: Sorted places differ little: their differences are stored, not an index into a dictionary of all places.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#keys.list.element": "false"}


def gram_lists(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, size, text): the distinct grams of some texts, in how many of them each occurs, and these texts gram by gram."""
    points = np.frombuffer(("\0".join(texts) + "\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes, width = np.array([len(t) for t in texts], np.int64), len(texts)
    # a gram does not begin at a separator or at one of the two characters before it
    inside, ends = np.ones(len(points) - 2, bool), np.cumsum(sizes + 1) - 1
    for back in range(3):
        inside[np.maximum(ends - back, 0)[ends >= back]] = False
    inside[ends[-1]:] = False
    text = np.repeat(np.arange(width, dtype=np.int32), np.maximum(sizes - 2, 0))
    # characters by their rank among those that occur: the grams of a few kinds are few numbers
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    seen = np.flatnonzero(seen)
    kinds = len(seen)
    rank = np.zeros(seen[-1] + 1, np.int32 if kinds ** 3 <= MOST_CELLS else np.int64)
    rank[seen] = np.arange(kinds)
    ranks = rank[points]
    code = ((ranks[:-2] * kinds + ranks[1:-1]) * kinds + ranks[2:])[inside]
    if kinds ** 3 <= MOST_CELLS:
        used = np.zeros(kinds ** 3, bool)
        used[code] = True
        codes = np.flatnonzero(used)
        number = np.zeros(kinds ** 3, np.int32)
        number[codes] = np.arange(len(codes))
        code = number[code]
    else:
        codes, code = np.unique(code, return_inverse=True)
    cells = len(codes) * width
    both = code.astype(np.int32 if cells <= MOST_CELLS else np.int64, copy=False) * width + text
    if cells <= min(MOST_CELLS, CELLS * len(both)):
        grid = np.zeros(cells, bool)
        grid[both] = True
        both = np.flatnonzero(grid)
        size = grid.reshape(-1, width).sum(1)
    else:
        both.sort()
        both = both[np.flatnonzero(np.diff(both, prepend=-1))]
        size = np.bincount(both // width, minlength=len(codes))
    code, third = np.divmod(codes, kinds)
    first, second = np.divmod(code, kinds)
    return (seen[first] << (2 * BITS)) | (seen[second] << BITS) | seen[third], size, both - np.repeat(np.arange(len(codes)) * width, size)


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) of the distinct grams of each text, by gram."""
    gram, size, text = gram_lists(texts)
    return text, np.repeat(gram, size)


def bucket_of(gram: np.ndarray) -> np.ndarray:
    """The folder of each gram, ``pmod(xxhash64(gram), BUCKETS)``."""
    first, second, third, fourth, fifth = np.array([11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261], np.uint64)

    def turn(x: np.ndarray, by: int) -> np.ndarray:
        return (x << np.uint64(by)) | (x >> np.uint64(64 - by))

    h = turn(gram.astype(np.int64).view(np.uint64) * second, 31) * first ^ (np.uint64(42 + 8) + fifth)
    h = turn(h, 27) * first + fourth
    h = (h ^ (h >> np.uint64(33))) * second
    h = (h ^ (h >> np.uint64(29))) * third
    return np.mod((h ^ (h >> np.uint64(32))).view(np.int64), BUCKETS).astype(np.int32)


def lists_in_block(block: int, steps: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """``lists_of`` for the (gram, size, key) of some texts, gram by gram, whose keys all lie in one block: no keys are sorted.

    A list holds its keys as the steps bring them. The lists of a folder lie together.
    """
    gram = np.unique(np.concatenate([g for g, _, _ in steps]))
    place, order = np.empty(len(gram), np.int64), np.argsort(bucket_of(gram), kind="stable")
    place[order] = np.arange(len(gram))
    at = [place[np.searchsorted(gram, g)] for g, _, _ in steps]
    gram = gram[order]
    size = np.zeros(len(gram), np.int64)
    for where, (_, n, _) in zip(at, steps, strict=True):
        size[where] += n
    starts = np.cumsum(size) - size
    places, free = np.empty(int(size.sum()), np.int16), starts.copy()
    for where, (_, n, keys) in zip(at, steps, strict=True):
        places[np.repeat(free[where] - (np.cumsum(n) - n), n) + np.arange(len(keys))] = keys - block * SPAN - SPAN // 2
        free[where] += n
    return in_steps(gram, np.full(len(gram), block), starts, places)


def in_steps(gram: np.ndarray, block: np.ndarray, starts: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Lists that begin at ``starts``, each place but the first as its distance from the one before, round the circle of 16 bits."""
    steps = np.diff(places, prepend=np.int16(0))
    steps[starts] = places[starts]
    return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(block), pa.ListArray.from_arrays(
        pa.array(np.append(starts, len(places)).astype(np.int32)), pa.array(steps))], names=["gram", "block", "keys"])


def lists_of(keys: np.ndarray, gram: np.ndarray) -> pa.RecordBatch:
    """One row per gram and block with the places of its keys, each but the first as its distance from the one before."""
    order = np.lexsort((keys, gram))
    keys, gram = keys[order], gram[order]
    block = keys // SPAN
    starts = np.flatnonzero((np.diff(gram, prepend=-1) != 0) | (np.diff(block, prepend=block[0] - 1) != 0)) if len(keys) else np.zeros(0, np.int64)
    return in_steps(gram[starts], block[starts], starts, (keys - block * SPAN - SPAN // 2).astype(np.int16))


def merged_lists(packs: pa.Table) -> pa.Table:
    """The postings of a folder and a block from all its packs: one list per gram, with each place once."""
    parts = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in packs.column("rows").combine_chunks()]
    lists = pa.concat_tables(parts).combine_chunks()
    keys = lists.column("keys").combine_chunks()
    gram, which = np.unique(lists.column("gram").to_numpy(), return_inverse=True)
    sizes = keys.value_lengths().to_numpy()
    starts = np.cumsum(sizes) - sizes
    run = np.concatenate((np.zeros(1, np.int16), np.cumsum(keys.flatten().to_numpy(), dtype=np.int16)))
    places = run[1:] - np.repeat(run[starts], sizes)
    order = np.argsort(which, kind="stable")
    sizes = sizes[order]
    spots = places[np.repeat(starts[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(places))].astype(np.int64) + SPAN // 2
    spots += np.repeat(which[order] << 16, sizes)
    # some grams at a time, all their places are marked on a line; sorted, where they are few
    upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(which, weights=keys.value_lengths().to_numpy(), minlength=len(gram)).astype(np.int64))))
    line, found = np.zeros(GRAMS * SPAN, bool), [np.zeros(0, np.int64)]
    for first in range(0, len(gram), GRAMS):
        some = spots[upto[first]:upto[min(first + GRAMS, len(gram))]] - (first << 16)
        if len(some) * 256 >= len(line):
            line[some] = True
            some = np.flatnonzero(line)
            line[some] = False
        else:
            some.sort()
            some = some[np.flatnonzero(np.diff(some, prepend=-1))]
        found.append(some + (first << 16))
    both = np.concatenate(found)
    ends = np.searchsorted(both, np.arange(len(gram) + 1) << 16).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(((both & (SPAN - 1)) - SPAN // 2).astype(np.int16)))
    same = [pa.array(np.repeat(packs.column(c)[0].as_py(), len(gram))) for c in ("block", "bucket")]
    return pa.table([pa.array(gram), same[0].cast(pa.int64()), listed, same[1].cast(pa.int32())], names=["gram", "block", "keys", "bucket"])


def packed(df: DataFrame, *by: str) -> DataFrame:
    """(``by``, rows): the rows with equal values that a task meets together, as one compressed Arrow stream.

    What is shuffled in this form takes a fraction of the bytes.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= HELD_BYTES:
                yield from packs(pa.Table.from_batches(held), by)
                held, size = [], 0
        if held:
            yield from packs(pa.Table.from_batches(held), by)

    schema = T.StructType([df.schema[c] for c in by])
    return df.mapInArrow(pack, schema.add("rows", T.BinaryType()))


def packs(rows: pa.Table, by: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row per values of ``by`` with their rows in a compressed Arrow stream."""
    groups = rows.select(by).append_column("_at", pa.array(np.arange(len(rows)))).group_by(list(by)).aggregate([("_at", "list")])
    for group in groups.to_batches():
        for i in range(len(group)):
            at = group.column("_at_list")[i].values
            # rows that lie together are not copied
            near = len(at) and at[-1].as_py() - at[0].as_py() == len(at) - 1
            part, sink = rows.slice(at[0].as_py(), len(at)) if near else rows.take(at), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(part.combine_chunks())
            yield pa.RecordBatch.from_arrays([*(group.column(c).slice(i, 1) for c in by), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[*by, "rows"])


def unpacked(packs: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the packs that ``packed`` made of rows with this schema."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.column("rows"):
                yield from pa.ipc.open_stream(pack.as_buffer())

    return packs.mapInArrow(unpack, schema)


def write_searchable(df: DataFrame, path: str, key: str = "id", columns: Sequence[str] = SEARCHED) -> None:
    """Store rows by block of their keys, and the postings of their texts. Keys are whole numbers; rows without one are stored without postings.

    Rows are moved once, to their blocks. Their grams are cut from the stored rows, where
    the rows of a block lie together: a task's lists are long, and a key takes two bytes in
    them. One exchange brings the lists of a folder and a block together. Both exchanges move
    compressed packs, and their files go as soon as the table behind them is written.
    """
    spark = df.sparkSession
    rows = df.withColumn("block", F.shiftright(F.col(key).cast("long"), SPAN.bit_length() - 1))
    replace_table(rows.limit(0), f"{path}/schema")
    with spent_shuffles(spark):
        moved = unpacked(packed(rows, "block").hint("rebalance", "block"), rows.schema)
        replace_table(moved, f"{path}/rows", partition_by=["block"], compression="zstd")
    stored = read_table(spark, f"{path}/rows", rows.schema).where(F.col("block").isNotNull())
    text = F.concat_ws("\0\0\0", *[F.lower(c) for c in columns if c in df.columns])
    keyed = stored.select(F.col(key).cast("long").alias("key"), text.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            batch = batch.sort_by("key")
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= STEP_CHARS):
                    chars, to = chars + len(texts[to]), to + 1
                gram, size, text = gram_lists(texts[at:to])
                held.append((gram, size, keys[at:to][text]))
                at, count = to, count + len(text)
                if count >= HELD:
                    yield from listed(held)
                    held, count = [], 0
        if held:
            yield from listed(held)

    def listed(held: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([k for _, _, k in held])
        if not len(keys):
            return
        if keys.min() // SPAN == keys.max() // SPAN:
            lists = lists_in_block(int(keys[0]) // SPAN, held)
        else:
            lists = lists_of(keys, np.concatenate([np.repeat(g, n) for g, n, _ in held]))
        yield from packs(pa.Table.from_batches([lists.append_column("bucket", pa.array(bucket_of(lists.column("gram").to_numpy())))]), ("bucket", "block"))

    with spent_shuffles(spark):
        whole = keyed.mapInArrow(cut, "bucket int, block long, rows binary").groupBy("bucket", "block").applyInArrow(merged_lists, POSTINGS)
        replace_table(whole.sortWithinPartitions("bucket", "gram", "block"), f"{path}/postings", partition_by=["bucket"], **PACKED)


def term_grams(spark: SparkSession, term: str, escape: bool) -> list[int]:
    """The grams that every text with the term holds; none for a term without three plain characters in a row."""
    lowered = spark.range(1).select(F.lower(F.lit(term))).first()[0]
    parts = [lowered] if escape else re.split("[%_]", lowered)
    return sorted({int(g) for g in grams([p for p in parts if len(p) >= 3] or [""])[1]})


def candidates(spark: SparkSession, path: str, wanted: Sequence[int]) -> DataFrame:
    """(block, key) of the rows that hold all the grams."""
    buckets = spark.createDataFrame([(g,) for g in wanted], "gram long").select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int").alias("b")).distinct()
    postings = read_table(spark, f"{path}/postings", POSTINGS).where(F.col("bucket").isin([r["b"] for r in buckets.collect()]) & F.col("gram").isin(list(wanted)))
    # a block has one list per gram, each of at most SPAN keys
    lists = postings.groupBy("block").agg(F.collect_list("keys").alias("lists")).where(F.size("lists") == len(wanted))
    common = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0)), F.array_intersect)
    places = lists.select("block", F.explode(common).alias("place"))
    return places.select("block", (F.col("block") * SPAN + F.col("place") + SPAN // 2).alias("key"))


def stored_matches(spark: SparkSession, path: str, term: str | None, key: str = "id", escape: bool = False) -> DataFrame:
    """Stored rows that hold the term, as ``search.by_term`` finds them.

    Only postings of the term's grams and the blocks with common keys are read; of these
    blocks the rows with common keys are verified, or all rows where such keys are many. Terms
    without three plain characters in a row (shorter ones, or cut by the wildcards ``%``
    and ``_``) and empty ones have no grams: all rows are read.
    """
    rows = read_table(spark, f"{path}/rows", read_table(spark, f"{path}/schema").schema)
    term = (term or "").strip()
    wanted = term_grams(spark, term, escape) if term else []
    if wanted:
        found = candidates(spark, path, wanted)
        blocks = found.groupBy("block").count().collect()  # two numbers per SPAN keys at most
        rows = rows.where(F.col("block").isin([r["block"] for r in blocks]))
        # the wide rows are never moved to meet their candidates
        if sum(r["count"] for r in blocks) <= FEW_KEYS:
            rows = rows.join(F.broadcast(found.withColumnRenamed("key", key)), ["block", key], "left_semi")
    return by_term(rows.drop("block"), term, escape)


def search_stored(
    spark: SparkSession, path: str, severity: str | None = None, decade: str | None = None, term: str | None = None,
    sort_key: str = "date", sort_dir: str = "desc", page: int = 1, page_size: int = 12, escape: bool = False,
) -> DataFrame:
    """One page of matching incidents as ``search.search_incidents`` gives it, from what ``write_searchable`` stored."""
    check_range("page", page, 1)
    check_range("page_size", page_size, 1, 100)
    order = sort_columns(sort_key, sort_dir)
    hits = by_decade(by_severity(stored_matches(spark, path, term, escape=escape), severity), decade)
    ids = ordered_slice(hits.select("id", SORT_KEYS.get(sort_key, "date")), order, page_size, (page - 1) * page_size).select("id")
    return hits.join(F.broadcast(ids), "id", "left_semi").orderBy(*order).select(*LIST_COLUMNS)  # at most 100 ids
