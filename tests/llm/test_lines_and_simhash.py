from itertools import product

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from incidentlake.llm import lines, simhash
from incidentlake.llm.common import linked_groups


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute_lines(rows, near_from):
    seen, out = [], {}
    for id_, text in sorted({(i, t) for i, t in rows if i is not None and t}):
        for no, line in enumerate(text.split("\n")):
            line = " ".join(line.lower().split())
            if line:
                same = [p for p in seen if p[2] == line]
                near = [p for p in seen if len(line) >= near_from <= len(p[2]) and one_edit(p[2], line)]
                hit = min(same or near, default=None)
                out[id_, no] = (hit is None, *(hit[:2] if hit else (None, None)))
                seen.append((id_, no, line))
    return out


def test_lines_against_brute_force(spark):
    base = "a line of text that is long enough 1234"
    changed = [base[:i] + c + base[i + d:] for i, (c, d) in product((0, 1, 17, 18, 19, 38, 39), (("x", 1), ("", 1), ("y", 0), ("zz", 1)))]
    texts = [base, "short", "Short ", "shirt", "\n\n", *changed, base + " and more", "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaa"]
    rows = [(100 - i, t + "\n" + texts[i // 2]) for i, t in enumerate(texts)] + [(None, base), (500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["id"], r["line_no"]): (r["kept"], r["of_id"], r["of_line"]) for r in lines.line_decisions(df).collect()}
    assert got == brute_lines(rows, 20)


def test_lines_of_rows_that_share_an_id(spark):
    base = "a line of text that is long enough 1234"
    rows = [(1, "something else that has more than twenty characters"), (1, base), (2, base[:-1] + "5"), (3, "something else that has more than twenty characterz"), (4, "w" * 30)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r["id"]: (r["kept"], r["of_id"]) for r in lines.line_decisions(df).where("id > 1").collect()}
        assert got == {2: (False, 1), 3: (False, 1), 4: (True, None)}


def test_odd_lines(odd, none):
    kept = lines.drop_lines(odd, lines.line_decisions(odd))
    assert kept.columns == odd.columns
    found = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert 8 not in found or "quick" not in found[8] or found[8] != "It was there."
    assert found[6].count("Der schnelle") == 1 and None in found and {2, 3, 4} <= set(found)
    assert lines.line_decisions(none).count() == 0 and lines.drop_lines(none, lines.line_decisions(none)).count() == 0


def test_groups_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 200)] + [(1000, x) for x in range(1001, 1400)] + [(7, 7), (None, 3), (5000, 4999), (4999, 5000)]
    got = {r["id"]: r["group"] for r in linked_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {i: 1000 for i in range(1000, 1400)} | {4999: 4999, 5000: 4999}
    assert linked_groups(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text, words=4):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    parts = [p for p in __import__("re").split("[\x20\x09-\x0d]+", parts) if p]
    grams = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB é\t\n  z.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_index_finds_every_pair():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = [f ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for f in fps]
    every = np.unique(np.concatenate((fps, np.array(near, np.uint64), fps[:50] ^ np.uint64(1))))
    index = simhash.GrayIndex(every)
    got = {tuple(sorted(p)) for x, y in index.pairs(index, 4, True) for p in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(every)) for j in range(i + 1, len(every)) if int(every[i] ^ every[j]).bit_count() <= 4}
    assert all(any(int(a) & m == int(b) & m for m in simhash.masks(4)) for a, b in zip(fps, near, strict=True) if int(a ^ b).bit_count() <= 4)


def test_large_nodes_are_dealt_in_blocks(spark):
    rng = np.random.default_rng(4)
    fps = sorted({int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False))) for _ in range(400)})
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    df = spark.createDataFrame(rows, "id long, fp long")
    sizes = {b: {r["id"]: r["group"] for r in linked_groups(simhash.near_links(df, 4, b)).collect()} for b in (16, 8192)}
    assert sizes[16] == sizes[8192]


def test_one_row_of_a_repeated_id_stays(spark):
    rows = [(1, "b b b b"), (1, "a a a a"), (2, "c c c c"), (None, "x")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        kept = simhash.keep_one_per_group(df, simhash.simhash_groups(df)).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "x"), (1, "a a a a"), (2, "c c c c")]


def test_odd_groups(odd, none):
    rows = simhash.simhash_groups(odd).collect()
    by = {r["id"]: r for r in rows}
    assert len(rows) == 10 and by[2]["fingerprint"] == "0" * 16 and by[2]["component_id"] == by[3]["component_id"] == 2
    assert by[None]["component_id"] is None and by[1]["component_id"] == 1
    assert simhash.simhash_groups(none).count() == 0
    kept = simhash.keep_one_per_group(odd, simhash.simhash_groups(odd))
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(
        {r["component_id"] for r in rows if r["id"] is not None})
