"""Many plain phrases looked for in a text at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes looked at in one step.
STEP = 1 << 21


def mixed(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    """A 16-bit number for three neighbouring bytes."""
    return first * np.uint16(40503) ^ second * np.uint16(9973) ^ third * np.uint16(251)


def found_in(texts: pa.Array, phrases: Sequence[bytes]) -> np.ndarray:
    """Per text a number whose bit i says that it holds phrase i; phrases have three bytes or more.

    All texts are one run of bytes. Where three bytes may begin a phrase the rest of it is
    compared, so that the run is read once however many the phrases are.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    run = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    bits = np.zeros(len(texts), np.int64)
    begins: dict[int, list[int]] = {}
    for i, p in enumerate(phrases):
        begins.setdefault(int(mixed(*np.frombuffer(p[:3], np.uint8).astype(np.uint16)[:, None])[0]), []).append(i)
    known = np.zeros(1 << 16, bool)
    known[list(begins)] = True
    end = int(offsets[-1])
    for start in range(int(offsets[0]), end - 2, STEP):
        part = run[start:min(start + STEP, end - 2) + 2].astype(np.uint16)
        codes = mixed(part[:-2], part[1:-1], part[2:])
        at = np.flatnonzero(known[codes])
        codes, at = codes[at], at + start
        for code, members in begins.items():
            here = at[codes == code]
            for i in members:
                place = here[here + len(phrases[i]) <= end]
                for j, byte in enumerate(phrases[i]):
                    place = place[run[place + j] == byte]
                text = np.searchsorted(offsets, place, "right") - 1
                bits[text[place + len(phrases[i]) <= offsets[text + 1]]] |= 1 << i
    return bits


def phrase_bits(text: Column, phrases: Sequence[str]) -> Column:
    """``found_in`` for a text column, at most 63 phrases; 0 for a null text."""
    wanted = [p.encode() for p in phrases]

    @F.arrow_udf("long")
    def find(column: pa.Array) -> pa.Array:
        return pa.array(found_in(column, wanted))

    return find(F.coalesce(text, F.lit("")))


def place_of(phrases: Sequence[str]) -> Mapping[str, int]:
    """The bit of each phrase."""
    return {p: 1 << i for i, p in enumerate(phrases)}
