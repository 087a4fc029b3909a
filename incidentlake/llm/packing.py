"""Packing of documents into sequences by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks
from .tokens import worker_encoder

#: Characters after which a sentence may end.
SENTENCE_SIGNS = ".!?\n"
#: Tokens that are cut together; the last sequence of each such stretch may be short.
STRETCH = 1 << 20
SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_points(kinds: np.ndarray, size: int = 2048, sentence_cost: float = 8.0, word_cost: float = 64.0, step: int = 32) -> np.ndarray:
    """Ends of the windows over a stretch of tokens: the cheapest cuts.

    ``kinds`` has for each token what a cut after it breaks: 0 a sentence, 1 a document
    between sentences, 2 nothing, because a document ends. A window of n tokens costs
    its padding, ``size - n``, and a cut the penalty of what it breaks. Windows end at
    documents or sentences; a sentence longer than ``step`` tokens offers a dear cut
    after each ``step`` tokens besides. The last window ends the stretch. Among equal
    sums the longest window is taken.

    best(j) = min over i in [j - size, j) of best(i) + size - (j - i) + penalty(j): the
    values best(i) + i wait in a queue that keeps only those still able to be the least,
    so each boundary enters and leaves it once.
    """
    total = len(kinds)
    if not total:
        return np.zeros(0, np.int64)
    offered = kinds > 0
    offered[-1] = True
    ends = np.flatnonzero(offered) + 1
    gaps = np.diff(np.concatenate(([0], ends)))
    step = min(step, size)
    if (long := gaps > step).any():
        firsts, more = (ends - gaps)[long], (gaps[long] - 1) // step
        steps = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        offered[np.repeat(firsts, more) + steps * step - 1] = True
        ends = np.flatnonzero(offered) + 1
    penalty = np.array((word_cost, sentence_cost, 0.0))[kinds[ends - 1]]
    penalty[-1] = 0.0
    at, costs = [0, *ends.tolist()], [0.0, *(penalty + size).tolist()]
    weight, back = [0.0] * len(at), [0] * len(at)  # weight: best + at
    queue, head = [0], 0  # places with rising weight
    for j in range(1, len(at)):
        low = at[j] - size
        while at[queue[head]] < low:
            head += 1
        i = queue[head]
        back[j] = i
        w = weight[j] = weight[i] + costs[j]
        while len(queue) > head and weight[queue[-1]] > w:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1,
         sentence_cost: float = 8.0, word_cost: float = 64.0) -> DataFrame:
    """Pieces of documents placed in sequences of at most ``size`` tokens, in the order of the rows.

    A document is its ids and ``end_id``; null and empty texts are ``end_id`` alone. Each
    task packs its own rows in the order in which it reads them, about a million tokens
    at a time, so no text is moved and memory is bounded; a document that reaches over
    the end of such a stretch goes on in the next. One row per piece: its document, the
    document's tokens before it, its length and the CRC-32 of its ids, the sequence and
    the place there. Sequence ids are unique, ascending in the order of the rows within
    a task, and not gapless. Repeated rows are packed once each; null ids keep their
    pieces; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        sentence = encoder.ending_with(SENTENCE_SIGNS)
        sequence = TaskContext.get().partitionId() << 40
        held_ids: list[np.ndarray] = []
        held_docs: list[tuple[int | None, int, int, int]] = []  # id, tokens before, tokens here, tokens in all
        held = 0

        def place() -> pa.RecordBatch:
            nonlocal sequence
            ids = np.concatenate(held_ids)
            kinds = sentence[np.minimum(ids, len(sentence) - 1)].astype(np.int8)
            doc_ends = np.cumsum([d[2] for d in held_docs])
            whole = np.array([d[1] + d[2] == d[3] for d in held_docs])
            kinds[doc_ends[whole] - 1] = 2
            kinds[doc_ends[whole & (np.array([d[2] for d in held_docs]) > 1)] - 2] = 0
            cuts = cut_points(kinds, size, sentence_cost, word_cost)
            bounds = np.union1d(cuts, doc_ends)
            starts = np.concatenate(([0], bounds[:-1]))
            doc = np.searchsorted(doc_ends, starts, side="right")
            window = np.searchsorted(cuts, starts, side="right")
            first = np.concatenate(([0], cuts[:-1]))[window]
            doc_first = np.concatenate(([0], doc_ends[:-1]))
            raw = ids.astype("<u4").tobytes()
            sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), bounds.tolist(), strict=True)]
            before, in_all = np.array([d[1] for d in held_docs]), np.array([d[3] for d in held_docs])
            names = [d[0] for d in held_docs]
            out = pa.RecordBatch.from_arrays([
                pa.array([names[i] for i in doc.tolist()], pa.int64()), pa.array(before[doc] + starts - doc_first[doc]), pa.array(bounds - starts),
                pa.array(sums, pa.int64()), pa.array(in_all[doc]), pa.array(sequence + window), pa.array(starts - first),
            ], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += len(cuts)
            return out

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                ids, bounds = encoder.encode(texts[a:b])
                for k in range(b - a):
                    own = np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(end_id))
                    done = 0
                    while done < len(own):
                        part = own[done:done + STRETCH - held]
                        held_ids.append(part)
                        held_docs.append((names[a + k], done, len(part), len(own)))
                        done, held = done + len(part), held + len(part)
                        if held >= STRETCH:
                            yield place()
                            held_ids, held_docs, held = [], [], 0
        if held:
            yield place()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
