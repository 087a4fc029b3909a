"""Token ids of the public byte-level vocabulary, for whole batches of texts."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

from .common import Spans, kept_in_worker, matching_points

#: Classes of characters that the vocabulary's word pattern tells apart.
OTHER, LETTER, NUMBER, SPACE, MARK = 0, 1, 2, 3, 4
#: Endings that the pattern splits off after an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
SPECIAL = "<|endoftext|>"


def character_classes() -> np.ndarray:
    import regex

    known = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        known[matching_points(pattern, regex)] = kind
    known[0] = OTHER
    return known


def word_bounds(points: np.ndarray, marks: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where the words of the vocabulary's pattern start; ``marks`` separate the texts."""
    kind = classes[points]
    kind[marks] = MARK
    n = len(points)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    space = kind == SPACE
    following = np.concatenate((kind[1:], [MARK]))
    # the last character of a run of spaces before a word is a word of its own, or joins the word if it is a blank
    last = space & (following != SPACE) & (following != MARK)
    start |= last
    joins = last & (points == 32)
    start[1:] &= ~joins[:-1]
    # an apostrophe that starts a word takes a listed ending with it
    single = np.flatnonzero((points[:-1] == 39) & start[:-1] & (following[:-1] == LETTER))
    for i in single.tolist():
        for ending in ENDINGS:
            end = i + 1 + len(ending)
            if end <= n and points[i + 1:end].tobytes() == np.array([ord(c) for c in ending], np.uint32).tobytes():
                start[i + 1] = False
                if end < n and kind[end] == LETTER:
                    start[end] = True
                break
    return np.flatnonzero(start)


class Encoder:
    """Ids of the vocabulary file ``byte_bpe_50k`` as its own library gives them.

    Words are found for a whole batch at once; each distinct word is encoded once and
    kept by its hash, up to ``most_kept`` words. Texts with the special token's string
    go to the library itself.
    """

    def __init__(self, path: str, most_kept: int = 2_000_000):
        import tiktoken

        with open(os.path.splitext(path)[0] + ".tiktoken", "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # the words are cut already, one in each stretch between zeros
        self.words = tiktoken.Encoding("words", pat_str=r"[^\x00]+|\x00", mergeable_ranks=self.ranks, special_tokens={})
        self.path, self.classes, self.most_kept, self.library = path, character_classes(), most_kept, None
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode words that are not known yet and keep their ids."""
        gap = self.ranks[b"\0"]
        ids = np.array(self.words.encode_ordinary("\0".join(words)) + [gap], np.uint32)
        gaps = np.flatnonzero(ids == gap)
        sizes = np.diff(np.concatenate(([-1], gaps))) - 1
        ids = ids[ids != gap]
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used:self.used + len(ids)] = ids
        at = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.sizes = np.insert(self.hashes, place, hashes), np.insert(self.at, place, at), np.insert(self.sizes, place, sizes)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text starts in them (and the end)."""
        plain = [SPECIAL not in t and "\0" not in t for t in texts]
        joined = "\0" + "\0".join(t if p else "" for t, p in zip(texts, plain, strict=True)) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        marks = np.flatnonzero(points == 0)
        starts = word_bounds(points, marks, self.classes)
        ends = np.append(starts[1:], len(points))
        distinct, first, place = np.unique(Spans(points).hash(starts, ends), return_index=True, return_inverse=True)
        if len(self.hashes) > self.most_kept:
            self.forget()
        missing = np.ones(len(distinct), bool)
        if len(self.hashes):
            missing = self.hashes[np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)] != distinct
        if missing.any():
            new = first[missing]
            words = [joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            self.learn(distinct[missing], ["" if w[0] == "\0" else w for w in words])
        known = np.searchsorted(self.hashes, distinct)
        sizes, offsets = self.sizes[known][place], self.at[known][place]
        last = np.cumsum(sizes)
        ids = self.pool[np.arange(int(last[-1])) + np.repeat(offsets - last + sizes, sizes)]
        bounds = np.concatenate(([0], last))[np.searchsorted(starts, marks)]
        if all(plain):
            return ids, bounds
        parts = [ids[a:b] if p else self.whole(t) for a, b, p, t in zip(bounds[:-1], bounds[1:], plain, texts, strict=True)]
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def whole(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ending_with(self, signs: str) -> np.ndarray:
        """Which ids stand for bytes that end with one of the signs (and blanks after it)."""
        kind = np.zeros(max(self.ranks.values()) + 2, bool)
        pattern = re.compile(rb"[" + re.escape(signs.encode()) + rb"]\s*$")
        for raw, number in self.ranks.items():
            kind[number] = bool(pattern.search(raw))
        return kind


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    return kept_in_worker(f"encoder of {path}", lambda: Encoder(path))
