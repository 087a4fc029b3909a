"""Byte pair encoding as a transducer with bounded lookahead, and its incremental decoder."""

from __future__ import annotations

import codecs
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept_in_worker, matching_points

#: Characters of a text that are split into words at once, and bytes of an open word that are merged at once.
STEP, BLOCK = 1 << 16, 4096
#: Distinct words whose ids a worker keeps.
MOST_KEPT = 200_000
#: Characters before a target in which a place to cut a text is looked for.
REACH = 1000
#: No rule merges this pair.
NEVER = np.iinfo(np.int64).max

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Endings that the vocabulary's word pattern takes with an apostrophe, in its order (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
APOSTROPHE = 39


def byte_letters() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte: itself if visible, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def sufficient_lookahead(rules: list[tuple[tuple[str, ...], tuple[str, ...]]], final: set[str] | frozenset[str] = frozenset()) -> int:
    """Symbols after a place that decide whether the rules ever merge across it.

    ``rules`` are pairs of symbol sequences, the most urgent first. A rule (u, v) merges at
    a place unless a more urgent rule (x, y) merged at the end of v before; x then ends
    there too, so x and uv end alike. Each such rule adds the length of its right part,
    and rules grow more urgent along the chain, so the longest chain is finite. Nothing
    follows a symbol of ``final``.
    """
    exact: dict[tuple[str, ...], int] = {}  # left part -> longest chain that starts with it
    ending: dict[tuple[str, ...], int] = {}  # the same for every end of a left part
    longest = 0
    for u, v in rules:
        reach = len(v)
        if v[-1] not in final:
            whole = u + v
            reach += max(ending.get(whole, 0), *(exact.get(whole[k:], 0) for k in range(len(whole))))
        exact[u] = max(exact.get(u, 0), reach)
        for k in range(len(u)):
            ending[u[k:]] = max(ending.get(u[k:], 0), reach)
        longest = max(longest, reach)
    return longest


class Merges:
    """Merge rules over numbered symbols: ``pairs`` (left, right, result), the most urgent first."""

    def __init__(self, pairs: np.ndarray, lookahead: int):
        self.lookahead, self.result = lookahead, pairs[:, 2]
        self.base = int(pairs.max()) + 1 if len(pairs) else 1
        keys = pairs[:, 0] * self.base + pairs[:, 1]
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), NEVER)
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left < self.base) & (right < self.base), self.order[at], NEVER)

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, and the word of each; ``word`` ascends, and words merge side by side.

        Every round merges in each word the most urgent pair wherever it occurs, from the
        left where occurrences overlap; words without a pair leave.
        """
        symbols, word = symbols.copy(), word.copy()
        rank = np.append(self.ranks(symbols[:-1], symbols[1:]), NEVER)
        rank[:-1][word[1:] != word[:-1]] = NEVER
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(word)))
            low = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            if (over := low == NEVER).any():
                done.append((symbols[over], word[over]))
                symbols, word, rank, low = symbols[~over], word[~over], rank[~over], low[~over]
                if not len(symbols):
                    break
            hit = rank == low
            if (hit[1:] & hit[:-1]).any():  # of a run of occurrences every other one
                index = np.arange(len(hit))
                first = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), index, 0))
                hit &= (index - first) % 2 == 0
            at = np.flatnonzero(hit)
            symbols[at] = self.result[rank[at]]
            # the right part goes; what it knew about its own right neighbour is found anew
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                rank[i[i + 1 == len(symbols)]] = NEVER
                i = i[i + 1 < len(symbols)]
                rank[i] = np.where(word[i] == word[i + 1], self.ranks(symbols[i], symbols[i + 1]), NEVER)
        if not done:
            return symbols, word
        symbols, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]


class OpenWord:
    """Ids of one word that comes in pieces: bytes in, ids out as soon as nothing to come can change them."""

    def __init__(self, vocabulary: Vocabulary):
        self.known, self.held = vocabulary, np.zeros(0, np.uint8)

    def feed(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        known = self.known
        while len(raw):
            room = BLOCK + known.merges.lookahead
            taken, raw = raw[:room], raw[room:]
            self.held = np.concatenate((self.held, taken))
            if len(self.held) > room:
                # the last byte held may end the word, so it is not known as a symbol yet
                part = self.held[:-1]
                ids, _ = known.merges.merge(known.inner[part], np.zeros(len(part), np.int64))
                ends = np.cumsum(known.sizes[ids])
                stable = int(np.searchsorted(ends, len(part) - known.merges.lookahead, side="right"))
                if stable:
                    yield ids[:stable]
                    self.held = self.held[int(ends[stable - 1]):]

    def finish(self) -> np.ndarray:
        symbols = self.known.inner[self.held]
        if len(symbols):
            symbols[-1] = self.known.final[self.held[-1]]
        self.held = np.zeros(0, np.uint8)
        return self.known.merges.merge(symbols, np.zeros(len(symbols), np.int64))[0]


def normal_form(text: str) -> str:
    """Composed and lower-cased letter by letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a sigma does not look at what follows
    return text.lower()


def joins_left() -> set[str]:
    """Characters that composing may join to the character before them."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}  # vowels and ends of Hangul syllables
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<" and " " in parts:
            found.add(chr(int(parts.split()[1], 16)))
    return found


class Vocabulary:
    """A word-end vocabulary file and all that is derived from it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], byte_letters()
        numbers, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        rules = [tuple(m) for m in model["merges"]]
        self.inner = np.array([numbers[x] for x in letters], np.int64)
        self.final = np.array([numbers[x + end] for x in letters], np.int64)

        def symbols(token: str) -> tuple[str, ...]:
            body = token.removesuffix(end) if token != end else token
            return (*body[:-1], body[-1] + end) if token.endswith(end) and token != end else tuple(token)

        made = {x + end for x in letters} | set(letters)
        for a, b in rules:
            if a not in made or b not in made:
                raise ValueError("a merge rule uses a token that no rule before it makes")
            made.add(a + b)
        lookahead = sufficient_lookahead([(symbols(a), symbols(b)) for a, b in rules], {x + end for x in letters})
        self.merges = Merges(np.array([(numbers[a], numbers[b], numbers[a + b]) for a, b in rules], np.int64).reshape(-1, 3), lookahead)
        named = dict.fromkeys(range(max([*numbers.values(), *self.special.values()]) + 1), "")
        named |= {i: x for x, i in numbers.items()} | {i: x for x, i in self.special.items()}
        self.sizes = np.array([len(symbols(x)) if x else 0 for x in named.values()], np.int64)
        back = {x: b for b, x in enumerate(letters)}
        #: UTF-8 of each token as the file spells it, and the bytes it stands for, a word's end being a blank.
        self.spelled = [x.encode() for x in named.values()]
        self.plain = [x.encode() if i in self.special.values() else bytes(back[c] for c in x.removesuffix(end)) + b" " * x.endswith(end) for i, x in named.items()]
        self.classes = word_classes()
        self.joining = joins_left()
        self.at_special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.counts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str, open_kind: int = SPACE) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of a normal text as bytes, where each starts, and the class of each character.

        After an open word of ``open_kind`` the first word may be its continuation.
        """
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.classes[points]
        before = np.concatenate(([open_kind], kind[:-1]))
        start = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
        # an apostrophe that is a word of its own so far takes a listed ending with it
        alone = np.flatnonzero((points[:-1] == APOSTROPHE) & start[:-1] & (kind[1:] == LETTER))
        for i in alone.tolist():
            for ending in ENDINGS:
                if text.startswith(ending, i + 1):
                    start[i + 1] = False
                    after = i + 1 + len(ending)
                    if after < len(kind) and kind[after] == LETTER:
                        start[after] = True
                    break
        if len(start) and kind[0] != SPACE:
            start[0] = True
        raw = np.frombuffer(text.encode(), np.uint8)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        inside = kind != SPACE
        at = np.flatnonzero(start)
        places = np.concatenate(([0], np.cumsum(width * inside)))[np.append(at, len(points))] if len(at) else np.zeros(1, np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(raw[np.repeat(inside, width)])]), at, kind

    def learn(self, words: list[bytes]) -> None:
        """Merge words that are not known yet, side by side, and keep their ids."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        ids, word = self.merges.merge(symbols, np.repeat(np.arange(len(words)), sizes))
        counts = np.bincount(word, minlength=len(words))
        for w in words:
            self.place[w] = len(self.place)
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(counts) - counts))
        self.counts, self.pool = np.concatenate((self.counts, counts)), np.concatenate((self.pool, ids))

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and how many each word has."""
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.place) + len(distinct) > MOST_KEPT:
            self.forget()
        new = [w for w in distinct if w not in self.place and len(w) <= BLOCK]
        if new:
            self.learn(new)
        parts = {}
        for i, w in enumerate(distinct):
            if len(w) > BLOCK:
                stream = OpenWord(self)
                parts[i] = np.concatenate([*stream.feed(np.frombuffer(w, np.uint8)), stream.finish()])
        own = coded.indices.to_numpy()
        place = np.array([self.place.get(w, 0) for w in distinct], np.int64)
        starts, counts, pool = self.starts[place] if len(self.starts) else place, self.counts[place] if len(self.counts) else place, self.pool
        if parts:
            for i, ids in parts.items():
                starts[i], counts[i] = len(pool), len(ids)
                pool = np.concatenate((pool, ids))
        counts = counts[own]
        last = np.cumsum(counts)
        total = int(last[-1]) if len(last) else 0
        return pool[np.arange(total) + np.repeat(starts[own] - last + counts, counts)], counts

    def encode_short(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of moderate length without special tokens, all at once."""
        normal = [normal_form(t) for t in texts]
        words, at, _ = self.words("\n".join(normal))
        ids, counts = self.ids_of(words)
        ends = np.cumsum([len(t) + 1 for t in normal])
        bounds = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(at, ends)]
        return np.split(ids, bounds[:-1])[:len(texts)]

    def cut(self, text: str, target: int) -> int:
        """Where a text may be cut near ``target``: words go on or end there, nothing composes or hangs together across it.

        After white space if there is some; else before a character that does not compose
        with the one before, lower-cases alone, and is not part of an ending after an apostrophe.
        """
        low = max(target - REACH, 1)
        for i in range(target, low, -1):
            if self.classes[ord(text[i - 1])] == SPACE:
                return i

        def fits(i: int) -> bool:
            c = text[i]
            head = unicodedata.normalize("NFD", c)[0]
            if unicodedata.combining(head) or head in self.joining or any(len(x.lower()) != 1 for x in (c, text[i - 1])):
                return False
            return self.classes[ord(c)] != LETTER or "'" not in text[max(i - 3, 0):i]

        return next((i for i in [*range(target, low, -1), *range(target + 1, len(text))] if fits(i)), len(text))

    def encode_long(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text without special tokens in parts, holding one step of it and one open word."""
        open_word, open_kind, at = OpenWord(self), SPACE, 0
        while at < len(text):
            to = len(text) if len(text) - at <= STEP else self.cut(text, at + STEP)
            words, _, kind = self.words(normal_form(text[at:to]), open_kind)
            at = to
            if not len(words):
                yield open_word.finish()
                open_kind = SPACE
                continue
            goes_on = kind[0] == open_kind and open_kind in (LETTER, OTHER)
            if not goes_on:
                yield open_word.finish()
            stays_open = at < len(text) and kind[-1] in (LETTER, OTHER)
            if goes_on:
                yield from open_word.feed(np.frombuffer(words[0].as_py(), np.uint8))
                if len(words) > 1 or not stays_open:
                    yield open_word.finish()
            whole = words[int(goes_on):len(words) - (stays_open and len(words) > int(goes_on))]
            if len(whole):
                yield self.ids_of(whole)[0]
            if stays_open and len(words) > int(goes_on):
                yield from open_word.feed(np.frombuffer(words[len(words) - 1].as_py(), np.uint8))
            open_kind = int(kind[-1]) if stays_open else SPACE
        yield open_word.finish()

    def encode(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
        """(text, ids) parts in the order of the texts; a long text comes in several."""
        for a, b in chunks(texts):
            plain = [len(t) <= STEP and not (self.at_special and self.at_special.search(t)) for t in texts[a:b]]
            short = iter(self.encode_short([t for t, p in zip(texts[a:b], plain, strict=True) if p]))
            for i, p in zip(range(a, b), plain, strict=True):
                if p:
                    yield i, next(short)
                    continue
                for piece in self.at_special.split(texts[i]) if self.at_special else [texts[i]]:
                    for ids in [np.array([self.special[piece]])] if piece in self.special else self.encode_long(piece):
                        yield i, ids


def word_classes() -> np.ndarray:
    import regex

    known = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        known[matching_points(pattern, regex)] = kind
    return known


class Decoder:
    """Text of ids that come one after another: the state is the bytes of a character that is not complete.

    ``between`` stands between the bytes of two tokens. Bytes that are no character become U+FFFD.
    """

    def __init__(self, tokens: list[bytes], between: bytes = b""):
        self.tokens, self.between, self.begun = tokens, between, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        raw = self.between.join([self.tokens[i] for i in ids.tolist()])
        raw, self.begun = (self.between + raw if self.begun else raw), True
        return self.state.decode(raw)

    def finish(self) -> str:
        self.begun = False
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest


def vocabulary_of(path: str) -> Vocabulary:
    """The vocabulary of this Python worker, kept from task to task."""
    return kept_in_worker(f"vocabulary of {path}", lambda: Vocabulary(path))


def decoder(known: Vocabulary, spelled: bool) -> Decoder:
    return Decoder(known.spelled, b" ") if spelled else Decoder(known.plain)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", spelled: bool | None = None) -> DataFrame:
    """(id, ids): the token ids of every whole text, with the word-end vocabulary file ``vocabulary``.

    Words are merged by a transducer: a long word goes through a buffer, and an id leaves
    it once no later byte within the vocabulary's sufficient lookahead can change it; the
    text is split into words step by step, so working memory does not grow with a text or
    a word. Strings of the vocabulary's special tokens are these tokens. ``spelled`` adds
    ``decoded``, what ``decode`` makes of the ids, from the same pass.

    Null and empty texts have no ids; repeated rows are encoded once each, null ids keep
    their rows; other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_of(vocabulary)
        for batch in batches:
            names, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                parts: list[list[np.ndarray]] = [[np.zeros(0, np.int32)] for _ in range(a, b)]
                decoded = [""] * (b - a)
                reader, last = None, -1
                held: list[str] = []
                for i, ids in known.encode(texts[a:b]):
                    parts[i].append(ids.astype(np.int32))
                    if spelled is not None:
                        if i != last:
                            if reader:
                                decoded[last] = "".join([*held, reader.finish()])
                            reader, last, held = decoder(known, spelled), i, []
                        held.append(reader.feed(ids))
                if reader:
                    decoded[last] = "".join([*held, reader.finish()])
                whole = [np.concatenate(p) for p in parts]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in whole]))).astype(np.int32)
                columns = [names.slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(whole)))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(decoded, pa.string())] if spelled is not None else []),
                                                 names=["id", "ids"] + (["decoded"] if spelled is not None else []))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>" + (", decoded string" if spelled is not None else ""))


def decode(rows: DataFrame, vocabulary: str, id_col: str = "id", ids_col: str = "ids", spelled: bool = False) -> DataFrame:
    """(id, text): the text of lists of ids, by an incremental state machine from bytes to text.

    A token gives its bytes and a word's end a blank; with ``spelled`` tokens are written
    as in the vocabulary file, a blank between them. Null and empty lists and null ids in
    a list give no text; ids that the vocabulary does not have are left out; an empty
    table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary_of(vocabulary)
        for batch in batches:
            texts = []
            for own in batch.column(1).to_pylist():
                ids = np.array([i for i in own or () if i is not None and 0 <= i < len(known.plain)], np.int64)
                reader = decoder(known, spelled)
                texts.append("".join([*(reader.feed(ids[k:k + STEP]) for k in range(0, len(ids), STEP)), reader.finish()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "id long, text string")
