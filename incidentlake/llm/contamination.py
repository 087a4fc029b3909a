"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Spans, chunks, code_points, kept_in_worker, matching_points, mixed

#: Shingles of benchmark items that one pass over the documents searches for; more items take more passes.
PASS_SHINGLES = 2_000_000
WORD = re.compile(r"[^\W_]+")


def shingles(text: str | None, words: int = 5) -> list[str]:
    """Shingles of lower-case words (runs of letters and digits); fewer words are one shingle, none give none."""
    found = WORD.findall((text or "").lower())
    return [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []


class WordTable:
    """Which code points are letters or digits."""

    def __init__(self) -> None:
        self.known = kept_in_worker("word_points", lambda: matching_points(r"[^\W_]"))


def shingle_hashes(texts: list[str], table: WordTable, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of ``words`` words, their text's number, and the word count of each text."""
    points, marks = code_points([t.lower() for t in texts])
    inside = table.known[points]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # texts are framed by gaps, so edges come in pairs
    starts, ends = edge[::2], edge[1::2]
    one = Spans(points).hash(starts, ends)
    text = np.searchsorted(marks, starts, side="right") - 1
    counts = np.bincount(text, minlength=len(texts))[:len(texts)]
    if len(one) < words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), counts
    whole = text[:len(text) - words + 1] == text[words - 1:]
    return joined_hash([one[k:len(one) - words + 1 + k][whole] for k in range(words)]), text[:len(text) - words + 1][whole], counts


def joined_hash(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for part in parts:
            out = mixed(out * np.uint64(31) + part)
    return out


class Sketches:
    """Bottom MinHash sketches of benchmark items, partitioned by the items' sizes.

    The items of a size class [2^k, 2^(k+1)) share a sketch length: more smallest hashes
    than a document may lack of the class's largest item. A document that contains the
    asked share of an item therefore contains a member of the item's sketch, whatever
    the document's length, and the search misses nothing.
    """

    def __init__(self, items: list[tuple[int, frozenset[str]]], share: float, words: int):
        self.items, self.words, self.share = dict(items), words, share
        table, pairs = WordTable(), []
        largest: dict[int, int] = {}
        for _, own in items:
            largest[len(own).bit_length()] = max(largest.get(len(own).bit_length(), 0), len(own))
        for item, own in items:
            keep = math.floor((1 - share) * largest[len(own).bit_length()] + 1e-9) + 1
            pairs += [(h, item) for h in sorted(hash_of(s, table) for s in own)[:keep]]
        pairs.sort()
        self.hashes = np.unique(np.array([h for h, _ in pairs], np.uint64))
        self.holders: dict[int, list[int]] = {}
        for h, item in pairs:
            self.holders.setdefault(h, []).append(item)
        self.short = any(s.count(" ") < words - 1 for own in self.items.values() for s in own)


def hash_of(shingle: str, table: WordTable) -> int:
    points, marks = code_points([shingle])
    inside = table.known[points]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    one = Spans(points).hash(edge[::2], edge[1::2])
    return int(joined_hash([one[k:k + 1] for k in range(len(one))])[0])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", words: int = 5, share: float = 0.8, pass_shingles: int = PASS_SHINGLES) -> DataFrame:
    """(id, item_id, shared, item_shingles, containment): documents that contain a benchmark item.

    An item is contained if at least ``share`` of its distinct shingles occur in the
    document. Items are read in blocks of at most ``pass_shingles`` shingles, which the
    tasks get whole; each block is one pass over all documents, so their number has no
    limit. Items and texts that are null or without words contain nothing and are not
    contained; an item of fewer words than a shingle is one shingle and found where a
    document of as few words equals it, or as words in a row within a longer one. Rows
    with a repeated id are looked at one by one, repeated items with the same id are
    joined to one. An empty table on either side gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    found = None
    for block in item_blocks(benchmark, item_col, item_text_col, words, pass_shingles):
        part = search(rows, Sketches(block, share, words))
        found = part if found is None else found.unionByName(part)
    return search(rows.limit(0), Sketches([], share, words)) if found is None else found


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, words: int, most: int) -> Iterator[list[tuple[int, frozenset[str]]]]:
    """Items with their shingles, in blocks of bounded size; they come to the driver one partition at a time."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")) \
        .where("item is not null and text is not null").groupBy("item").agg(F.concat_ws("\n\n", F.sort_array(F.collect_set("text"))).alias("text"))
    block, held = [], 0
    for row in rows.orderBy("item").toLocalIterator():
        own = frozenset(shingles(row["text"], words))
        if own:
            if held and held + len(own) > most:
                yield block
                block, held = [], 0
            block.append((row["item"], own))
            held += len(own)
    if block:
        yield block


def search(rows: DataFrame, sketches: Sketches) -> DataFrame:
    words, share = sketches.words, sketches.share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable()
        for batch in batches:
            ids, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for a, b in chunks(texts):
                hits: dict[int, set[int]] = {}
                for size in range(1 if sketches.short else words, words + 1):
                    hashes, text, _ = shingle_hashes(texts[a:b], table, size)
                    if len(hashes) and len(sketches.hashes):
                        at = np.minimum(np.searchsorted(sketches.hashes, hashes), len(sketches.hashes) - 1)
                        hit = sketches.hashes[at] == hashes
                        for t, h in zip(text[hit].tolist(), hashes[hit].tolist(), strict=True):
                            hits.setdefault(t, set()).update(sketches.holders[h])
                for t, items in hits.items():
                    found = WORD.findall(texts[a + t].lower())
                    own = {" ".join(found[i:i + k]) for k in range(1 if sketches.short else words, words + 1) for i in range(len(found) - k + 1)}
                    for item in sorted(items):
                        asked = sketches.items[item]
                        shared = len(asked & own)
                        if shared >= share * len(asked) - 1e-9:
                            out.append((ids[a + t], item, shared, len(asked), shared / len(asked)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(
                (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()))], names=["id", "item_id", "shared", "item_shingles", "containment"])

    return rows.mapInArrow(run, "id long, item_id long, shared int, item_shingles int, containment double")


def without_leaks(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that contain no benchmark item; null ids stay."""
    return docs.join(found.where("id is not null").select(F.col("id").alias(id_col)).distinct(), [id_col], "left_anti")
