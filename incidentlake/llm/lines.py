"""Near-duplicate lines by joining deletion neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Spans, chunks, code_points, cut_lineage, mixed

#: Room for line numbers in the order number of a line: document, then line.
LINES = 1 << 32
#: Parts of a line of which one is left out to find lines that agree elsewhere.
BLOCKS = 16
#: Bases of the two hashes of a line.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Characters of lines that are taken apart at once, and variants that are hashed at once.
LINE_CHARS, VARIANTS = 200_000, 200_000


def normal_lines(text: str | None) -> list[str]:
    """Lines in normal form: lower case, white space as one blank, none at the ends."""
    return [" ".join(line.split()) for line in (text or "").lower().split("\n")]


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, n, h1, h2, keys): every line that is not blank, numbered from 0, by two hashes of its normal form.

    ``keys`` is what a line shares with any line one edit away: an edit leaves the first
    or the second half untouched. Halves are cut at half the length of the shorter line,
    so a line has keys for its own length and, as the longer of two, for the length below.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks([t or "" for t in texts]):
                found = [(i, no, line) for i, text in zip(ids[a:b], texts[a:b], strict=True) for no, line in enumerate(normal_lines(text)) if line]
                if not found:
                    continue
                points, marks = code_points([x[2] for x in found])
                start, end = marks[:-1] + 1, marks[1:]
                n, (spans, other) = end - start, [Spans(points, base) for base in BASES]
                keys = []
                for length in (n, n - 1):
                    cut = length // 2
                    for side, (x, y) in enumerate(((start, start + cut), (end - (length - cut), end))):
                        with np.errstate(over="ignore"):
                            keys.append(mixed(spans.hash(x, y) + length.astype(np.uint64) * np.uint64(2) + np.uint64(side)))
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()), pa.array(n.astype(np.int32)),
                    pa.array(spans.hash(start, end).view(np.int64)), pa.array(other.hash(start, end).view(np.int64)),
                    *(pa.array(k.view(np.int64)) for k in keys)], names=["id", "no", "n", "h1", "h2", "k0", "k1", "k2", "k3"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, no int, n int, h1 long, h2 long, k0 long, k1 long, k2 long, k3 long")


def line_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, no, line, h1, h2): the normal form and hashes of the lines that ``wanted`` (id, no) names, in every row with that id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = normal_lines(text)
                out += [(id_, no, lines[no]) for no in numbers if no < len(lines)]
            for a, b in chunks([x[2] for x in out], LINE_CHARS):
                points, marks = code_points([x[2] for x in out[a:b]])
                hashes = [Spans(points, base).hash(marks[:-1] + 1, marks[1:]) for base in BASES]
                yield pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in out[a:b]], pa.int64()), pa.array([x[1] for x in out[a:b]], pa.int32()), pa.array([x[2] for x in out[a:b]], pa.string()),
                    *(pa.array(h.view(np.int64)) for h in hashes)], names=["id", "no", "line", "h1", "h2"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(wanted.groupBy("id").agg(F.collect_set("no").alias("numbers")), "id").mapInArrow(run, "id long, no int, line string, h1 long, h2 long")


def order_number(id_: str = "id", no: str = "no") -> Column:
    """One number that sorts lines by document, then line."""
    return (F.col(id_).cast("decimal(20,0)") * F.lit(LINES).cast("decimal(10,0)") + F.col(no)).cast("decimal(38,0)")


def order_parts(df: DataFrame, number: str, id_: str, no: str) -> DataFrame:
    """The document and the line of an order number, as two more columns."""
    room = F.lit(LINES).cast("decimal(10,0)")
    line = F.pmod(F.col(number), room)
    return df.withColumn(no, line.cast("int")).withColumn(id_, ((F.col(number) - line) / room).cast("decimal(20,0)").cast("long"))


def cut_blocks(n: np.ndarray, longer: int, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of a line of n characters that a block is, from the view of its own length or of one less."""
    length = n - longer
    return length * block // BLOCKS, length * (block + 1) // BLOCKS + longer


def block_rows(lines: DataFrame) -> DataFrame:
    """(h1, h2, part, key): each line (line, h1, h2) without one of its blocks, hashed.

    Two lines within one edit are equal without the block of the edit. ``part`` is the
    block, plus ``BLOCKS`` where the line is taken as the longer of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, last in chunks(texts, LINE_CHARS):
                points, marks = code_points(texts[first:last])
                start, end = np.repeat(marks[:-1] + 1, 2 * BLOCKS), np.repeat(marks[1:], 2 * BLOCKS)
                part = np.tile(np.arange(2 * BLOCKS), last - first)
                n, longer, block = end - start, part // BLOCKS, part % BLOCKS
                a, b = cut_blocks(n, longer, block)
                with np.errstate(over="ignore"):
                    key = mixed(Spans(points).hash_without(start, end, start + a, start + b) + ((n - longer) * BLOCKS + block).astype(np.uint64))
                rows = pa.array(np.repeat(np.arange(first, last), 2 * BLOCKS))
                yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), batch.column(2).take(rows), pa.array(part.astype(np.int32)),
                                                  pa.array(key.view(np.int64))], names=["h1", "h2", "part", "key"])

    return lines.select("line", "h1", "h2").mapInArrow(run, "h1 long, h2 long, part int, key long")


def variant_rows(lines: DataFrame) -> DataFrame:
    """(id, no, h1, h2, longer, place, n, v1, v2): each line without one character of the given parts, by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in chunks(texts, LINE_CHARS):
                points, marks = code_points(texts[first:last])
                row = np.repeat(np.arange(last - first), [len(x) for x in parts[first:last]])
                part = np.array([p for x in parts[first:last] for p in x], np.int64)
                a, b = cut_blocks((marks[1:] - marks[:-1] - 1)[row], part // BLOCKS, part % BLOCKS)
                spans = [Spans(points, base) for base in BASES]
                ends = np.cumsum(b - a)
                for low in range(0, int(ends[-1]) if len(ends) else 0, VARIANTS):
                    at = np.arange(low, min(low + VARIANTS, int(ends[-1])))
                    own = np.searchsorted(ends, at, side="right")
                    place = at - (ends - (b - a))[own] + a[own]
                    start, end = (marks[:-1] + 1)[row[own]], marks[1:][row[own]]
                    hashes = [x.hash_without(start, end, start + place, start + place + 1) for x in spans]
                    rows = pa.array(first + row[own])
                    yield pa.RecordBatch.from_arrays([
                        *(batch.column(c).take(rows) for c in range(2, 6)), pa.array((part[own] // BLOCKS).astype(np.int32)), pa.array(place.astype(np.int32)),
                        pa.array((end - start - 1).astype(np.int32)), *(pa.array(h.view(np.int64)) for h in hashes)],
                        names=["id", "no", "h1", "h2", "longer", "place", "n", "v1", "v2"])

    return lines.select("line", "parts", "id", "no", "h1", "h2").mapInArrow(run, "id long, no int, h1 long, h2 long, longer int, place int, n int, v1 long, v2 long")


def near_pairs(lines: DataFrame) -> DataFrame:
    """(h1, h2, first, earlier): for each distinct line the earliest line before it within one edit.

    ``lines`` has distinct lines (id, no, line, h1, h2); ``first`` is the order number of
    the line itself. Rows that repeat an id may bring several lines with one number, so a
    line is known by its hashes. Lines that no other line equals without one of its blocks
    have no neighbour. The others emit their variants in such blocks, one for every deleted
    character, as hashed keys. Lines that share the variant of the same place differ in at
    most that character, so the earliest of such a group is taken without pairing its
    members; a line that equals another's variant is one character shorter. Every link is
    verified by the edit distance of the lines themselves.
    """
    blocks = block_rows(lines)
    shared = cut_lineage(blocks.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key"))
    parts = blocks.join(shared, "key", "left_semi").groupBy("h1", "h2").agg(F.sort_array(F.collect_set("part")).alias("parts"))
    variants = cut_lineage(variant_rows(lines.join(parts, ["h1", "h2"])).withColumn("ord", order_number()))
    same = variants.where("longer = 0")
    groups = cut_lineage(same.groupBy("v1", "v2", "n", "place").agg(F.min("ord").alias("earlier"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    changed = same.join(groups, ["v1", "v2", "n", "place"]).where("earlier < ord").select("h1", "h2", "earlier")
    whole = lines.select(order_number().alias("short"), F.length("line").alias("n"), F.col("h1").alias("v1"), F.col("h2").alias("v2"))
    met = variants.where("longer = 1").select("ord", "h1", "h2", "v1", "v2", "n").join(whole, ["v1", "v2", "n"])
    missing = met.where("short < ord").select("h1", "h2", F.col("short").alias("earlier"))         .union(met.where("ord < short").select(F.col("v1").alias("h1"), F.col("v2").alias("h2"), F.col("ord").alias("earlier")))
    first = cut_lineage(changed.union(missing).groupBy("h1", "h2").agg(F.min("earlier").alias("earlier")))
    own = lines.select("h1", "h2", order_number().alias("first"), F.col("line").alias("a"))
    checked = first.join(own, ["h1", "h2"]).join(lines.select(order_number().alias("earlier"), F.col("line").alias("b")), "earlier")
    return checked.where(F.levenshtein("a", "b", 1) >= 0).select("h1", "h2", "first", "earlier").distinct()


def line_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_from: int = 20) -> DataFrame:
    """(id, line_no, kept, of_id, of_line, distance): what becomes of every line that is not blank.

    A line goes if an earlier line (smaller id, then smaller line number) is equal or, for
    lines of ``near_from`` and more characters, within one edit; lines are compared in
    normal form. ``of_id`` and ``of_line`` name the earliest such line of the same or, for
    the first of its kind, the earliest neighbour; both null if the line is kept. Blank
    lines and documents with null id or null or empty text have no rows; rows with a
    repeated id decide alike. An empty table gives no rows; other columns are not read.
    """
    seen = cut_lineage(line_rows(docs, id_col, text_col))
    kinds = seen.groupBy("h1", "h2").agg(F.min(order_number()).alias("first"), F.count("*").alias("rows"))
    doubled = cut_lineage(kinds.where("rows > 1").select("h1", "h2", "first"))

    keyed = seen.where(F.col("n") >= near_from).select("id", "no", "h1", "h2", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key"))
    shared = cut_lineage(keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key"))
    likely = keyed.join(shared, "key", "left_semi").groupBy("h1", "h2").agg(F.min(order_number()).alias("ord"))
    wanted = cut_lineage(order_parts(likely, "ord", "id", "no").select("id", "no", "h1", "h2"))
    firsts = cut_lineage(line_texts(docs, wanted, id_col, text_col).join(wanted, ["id", "no", "h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]))
    replaced = near_pairs(firsts)
    fates = cut_lineage(doubled.withColumn("earlier", F.lit(None).cast("decimal(38,0)")).union(replaced)
                        .groupBy("h1", "h2").agg(F.min("first").alias("first"), F.min("earlier").alias("earlier")))

    judged = seen.join(fates, ["h1", "h2"], "left").withColumn("ord", order_number())
    by = F.when(F.col("ord") > F.col("first"), F.col("first")).otherwise(F.col("earlier"))
    return order_parts(judged.withColumn("by", by), "by", "of_id", "of_line").select(
        "id", F.col("no").alias("line_no"), F.col("by").isNull().alias("kept"), "of_id", "of_line",
        F.when(F.col("by").isNotNull(), F.when(F.col("ord") > F.col("first"), 0).otherwise(1)).alias("distance"))


def drop_lines(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the lines that go; a document left without any line goes as well.

    All columns stay, in their order. Documents without a decision (null id, no line) stay
    as they are.
    """
    gone = decisions.groupBy("id").agg(F.sort_array(F.collect_set(F.when(~F.col("kept"), F.col("line_no")))).alias("gone"),
                                       F.max(F.col("kept").cast("int")).alias("any"))
    names, schema = docs.columns, docs.schema
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = packed.join(gone.where(F.size("gone") > 0), "id", "left").where("any is null or any = 1").select("row", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone_ in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if gone_:
                    away = set(gone_)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
                texts.append(text)
            row = batch.column(0)
            columns = [pa.array(texts, pa.string()) if c == text_col else row.field(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, schema)
