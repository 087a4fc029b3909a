import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from incidentlake.llm import packing, shards
from incidentlake.llm.queries import vocabulary
from incidentlake.llm.tokens import Encoder
from tokenizers import Tokenizer

TEXTS = ["", "a", "  a  b ", "it's don't I'll 'sfoo x's 'S ''s \" 's' we've  \n\n x \t y\n", "<|endoftext|> a", "a\0b", "naïve 日本語 １２ ²³ x y　z", "'", "''",
         "'re", "'r", "x'd'm'll", "   ", "\n", " 's", " \n 's", "1's '1", "😀😀́é", "\x1c\x1d\x85 a", "don’t"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def test_ids_are_the_library_s(library, docs):
    texts = TEXTS + [r["text"] for r in docs.limit(60).collect()]
    encoder = Encoder(vocabulary())
    for _ in range(2):
        ids, at = encoder.encode(texts)
        assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    for _ in range(40):
        kinds = rng.choice([0, 1, 2], 14, p=[0.6, 0.25, 0.15]).astype(np.int8)
        cost = {0: 3.0, 1: 1.0, 2: 0.0}

        def total(cuts, kinds=kinds):
            ends = [*cuts, 14]
            return sum(6 - (b - a) for a, b in zip([0, *ends], ends, strict=False)) + sum(cost[int(kinds[c - 1])] for c in cuts)

        best = min(total(c) for n in range(14) for c in combinations(range(1, 14), n) if max(np.diff([0, *c, 14])) <= 6)
        got = packing.cut_points(kinds, 6, 1.0, 3.0, step=1)
        assert got[-1] == 14 and max(np.diff([0, *got])) <= 6 and total(got[:-1].tolist()) == best
    assert packing.cut_points(np.zeros(0, np.int8)).tolist() == []


def test_pieces_make_up_every_document(odd, none, library):
    rows = packing.pack(odd, vocabulary(), size=64).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["id"]].append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for id_, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        times = 2 if id_ == 1 else 1
        pieces = sorted((r["start"], r["length"], r["ids_crc32"]) for r in docs[id_])
        assert sum(p[1] for p in pieces) == times * len(ids) and all(r["doc_tokens"] == len(ids) for r in docs[id_])
        assert all(zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes()) == c for a, n, c in pieces)
    assert packing.pack(none, vocabulary()).count() == 0


def test_shards_are_even_and_numbered(spark, docs):
    rows = shards.kd_shards(docs, 7).collect()
    sums, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    largest = max(r["size"] for r in rows)
    assert len(rows) == docs.count() and sorted(sums) == list(range(7)) and max(sums.values()) - min(sums.values()) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert all(r["size"] == len(texts[r["id"]].encode()) + 16 and r["text_crc32"] == zlib.crc32(texts[r["id"]].encode()) for r in rows)


def test_shards_of_odd_rows(odd, none):
    rows = shards.kd_shards(odd, target_bytes=20_000).collect()
    assert len(rows) == 10 and {r["size"] for r in rows if r["id"] in (2, 3)} == {16}
    assert shards.kd_shards(none, 5).count() == 0 and shards.kd_shards(odd, 1).where("shard <> 0").count() == 0


def test_heavy_group_is_split_others_keep_together(spark):
    rows = [(i, "same text " * 20) for i in range(4000)] + [(10_000 + i, f"text {i // 4} " * (1 + i % 7)) for i in range(4000)]
    got = shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() <= 1.02 * sums.min()
