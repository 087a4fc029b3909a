"""Quality by compression: which of two dictionaries, of good and of bad text, fits a text better."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLACES, place_of, share_of

#: Bytes of text that are compressed at once, so that a dictionary counts throughout a long text.
PIECE = 1024
#: Bytes of a dictionary, and pieces it is built from at most.
DICTIONARY, MOST_PIECES = 112_640, 20_000


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of bad and good text; the score is logistic(slope * difference + offset)."""

    bad: bytes
    good: bytes
    slope: float
    offset: float


def pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[at:at + PIECE] for at in range(0, len(raw), PIECE)]


def differences(texts: list[str | None], bad: bytes, good: bytes) -> np.ndarray:
    """(compressed bytes with the bad dictionary - with the good one) / bytes; 0 for empty texts."""
    tools = [zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False,
                                      write_checksum=False, write_dict_id=False) for d in (bad, good)]
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        if parts := pieces(text or ""):
            sizes = [sum(len(tool.compress(p)) for p in parts) for tool in tools]
            out[i] = (sizes[0] - sizes[1]) / ((len(parts) - 1) * PIECE + len(parts[-1]))
    return out


def build_dictionary(texts: list[str], most_pieces: int = MOST_PIECES) -> bytes:
    """Dictionary of whole texts; of more than ``most_pieces`` pieces evenly spaced ones are used."""
    parts = [p for t in texts for p in pieces(t)]
    if len(parts) > most_pieces:
        parts = [parts[i] for i in np.linspace(0, len(parts) - 1, most_pieces).astype(int)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: the text itself serves
        return b"".join(parts)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the likeliest logistic curve; targets are softened, so that it is finite."""
    good = y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    scale = max(float(np.abs(x).std()), 1e-9)
    design, beta = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (target - p))
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          most_rows: int = 3000, most_pieces: int = MOST_PIECES) -> CompressionModel:
    """Dictionaries and calibration from a bounded sample of labelled rows.

    At most about ``most_rows`` rows of each label build the dictionaries and as many
    other rows, in their natural mix, the calibration; rows are chosen by a hash of
    their id; of their whole texts a dictionary is built from at most ``most_pieces``
    pieces of ``PIECE`` bytes. A document labelled twice counts with its lowest
    label, labels other than 0 and 1 and null ids are ignored. Without rows of both
    labels every score is the share of good labels (0.5 without any).
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")) \
        .where("id is not null and y in (0, 1)").groupBy("id").agg(F.min("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(0, 0), sizes.get(1, 0)
    if not bad or not good:
        p = (good + 1) / (good + bad + 2) if good + bad else 0.5
        return CompressionModel(b"", b"", 0.0, float(np.log(p / (1 - p))))
    # half of the places builds dictionaries, the other half calibrates
    place, half = place_of("id"), PLACES // 2
    share = F.when(F.col("y") == 0, min(half, share_of(most_rows, bad))).otherwise(min(half, share_of(most_rows, good)))
    rest = min(half, share_of(most_rows, bad + good))
    chosen = marked.withColumn("fits", place < half).where(F.when(place < half, place < share).otherwise(place - half < rest))
    # the sample is bounded by most_rows, so it may be sent to every task
    sample = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''") \
        .join(F.broadcast(chosen), "id")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows.sort_values(["id", "text"])["text"].tolist()
        return pd.DataFrame({"y": [int(rows["y"].iloc[0])], "dictionary": [build_dictionary(texts, most_pieces)]})

    built = {r["y"]: bytes(r["dictionary"]) for r in sample.where("fits").select("id", "y", "text").groupBy("y")
             .applyInPandas(fit, "y int, dictionary binary").collect()}
    if len(built) < 2:
        p = (good + 1) / (good + bad + 2)
        return CompressionModel(b"", b"", 0.0, float(np.log(p / (1 - p))))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(differences(batch.column(1).to_pylist(), built[0], built[1])), batch.column(0)], names=["x", "y"])

    pairs = sample.where("not fits").select("y", "text").mapInArrow(measure, "x double, y int").collect()
    x, y = np.array([p["x"] for p in pairs] or [0.0]), np.array([p["y"] for p in pairs] or [1])
    return CompressionModel(built[0], built[1], *logistic(x, y))


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, difference): how likely each whole text is labelled good, 0 to 1.

    Texts are compressed piece by piece to their end with both dictionaries. Null and
    empty texts have difference 0 and the score that belongs to it. Repeated rows give
    repeated rows; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = differences(batch.column(1).to_pylist(), model.bad, model.good) if model.bad else np.zeros(batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(x)], names=["id", "score", "difference"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double, difference double")
