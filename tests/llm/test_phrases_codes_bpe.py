import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from incidentlake.llm import bpe, codes, phrases
from incidentlake.llm.queries import QUERIES
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest_llm import SF


def brute_phrases(rows, least, order, covered, top):
    counts, words = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            found = re.findall("[^ \t]+", piece)
            words[lang] += len(found)
            for k in range(1, order + 1):
                counts[lang].update(tuple(found[i:i + k]) for i in range(len(found) - k + 1))
    out = []
    for lang, f in counts.items():
        able = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        inside = defaultdict(int)
        for p, n in able.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i:i + size]] = max(inside[p[i:i + size]], n)
        best = []
        for p, a in able.items():
            if 100 * inside[p] < covered * a:
                score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def test_phrases_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["The", "of", "a", "Straße", "ÄRGER", "x y", "1", "日本", "é", "-"]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " \r "]) for _ in range(rng.randrange(80))) for _ in range(120)]
    rows = [(rng.choice(["en", "de", None]), t) for t in texts] + [("en", None), ("fr", ""), ("en", " \n"), ("en", "the of the of " * 300)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = brute_phrases(rows, 6, 4, 80, 40)
    for size in (phrases.SLICE, 50):
        monkeypatch.setattr(phrases, "SLICE", size)
        assert sorted(tuple(r) for r in phrases.collocations(df, least=6, top=40).collect()) == want
    assert sorted(tuple(r) for r in phrases.collocations(df, least=3, order=3, covered=50, top=5).collect()) == brute_phrases(rows, 3, 3, 50, 5)
    assert phrases.collocations(df, order=1).count() == 0


def test_stretches_make_up_a_text(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 16)
    data = np.frombuffer(("a bb ccc. dddd " * 9 + "e" * 100 + " f g h i j").encode(), np.uint8)
    found = list(phrases.segments(data, 0, len(data), 4))
    assert found[0][0] == 0 and found[-1][1:] == (len(data), len(data)) and len(found) > 4
    assert all(a[2] == b[0] < a[1] < len(data) for a, b in zip(found, found[1:], strict=False))


def test_filter_never_denies_a_frequent_key(spark):
    keys = np.random.default_rng(0).integers(-2**63, 2**63 - 1, 4000)
    df = spark.createDataFrame([(int(k), 2 + i % 3) for i, k in enumerate(keys.tolist())], "key long, n long")
    for least in (1, 4, 9):
        known = phrases.Filter(phrases.frequent_bits(df, least))(keys.view(np.uint64))
        asked = 2 + np.arange(4000) % 3 >= least
        assert known[asked].all() and known[~asked].mean() < 0.2 if (~asked).any() else known.all()


def test_odd_rows_have_phrases(odd, none):
    found = {(r["lang"], r["phrase"]): r for r in phrases.collocations(odd).collect()}
    assert found["de", "der schnelle braune fuchs"]["a"] == 3000 and all(k[0] == "de" for k in found)
    assert phrases.collocations(none).count() == 0


def brute_codes(rows, parts, entries, rounds, scale):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    whole = [(i, [int(np.floor(scale * x)) for x in v] + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * width:(p + 1) * width] for _, v, _ in first] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p * width:(p + 1) * width], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
                for _, v, _ in whole]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * width:(p + 1) * width] for (_, v, _), f in zip(whole, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    by = Counter()
    for (_, _, label), f in zip(whole, found, strict=True):
        by[label] += sum(x[0] for x in f)
    return sorted(((i or -1, "".join(f"{x[1]:02x}" for x in f), sum(x[0] for x in f), by[label], digest)
                   for (i, _, label), f in zip(whole, found, strict=True)), key=repr)


@pytest.mark.parametrize("sent", [codes.MOST_SENT, 0])
def test_codes_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(codes, "MOST_SENT", sent)
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.02, 10)], int(i) % 3) for i in rng.permutation(150)]
    rows += [(200, [0.0] * 10, None), (201, [0.0] * 10, None), (5, [0.01] * 9, 1), (None, [1e9] + [0.0] * 9, 4), (202, [], 4), (203, [1.0, -1.0], 1),
             (204, None, 1), (205, [float("nan")] * 10, 1), (206, [None] * 10, 1), (207, [float("inf")] * 10, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({n: F.lit("clash") for n in ("id", "code", "error", "part")})
    small = [(i, v and [x if x is None or not np.isfinite(x) else min(x, codes.most_component(3) / 256) for x in v], k) for i, v, k in rows]
    got = sorted(((r["id"] or -1, r["code"], r["error"], r["label_error"], r["codebooks_sha256"])
                  for r in codes.vector_codes(df, parts=4, entries=20).collect()), key=repr)
    assert got == brute_codes(small, 4, 20, 2, 256)
    assert codes.vector_codes(df.limit(0)).count() == 0
    assert {r["code"] for r in codes.vector_codes(df.where("vec_id = 202"), parts=2).collect()} == {"0000"}


def test_outward_search_is_exact():
    rng = np.random.default_rng(3)
    for width in (1, 3, 8):
        entries = rng.integers(-6, 6, (40, width))
        points = rng.integers(-9, 9, (500, width))
        distance = ((points[:, None] - entries) ** 2).sum(2)
        best, least = codes.Codebook(entries).nearest(points)
        assert (best == distance.argmin(1)).all() and (least == distance.min(1)).all()


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def known(path):
    return bpe.Vocabulary(path)


def texts_of(rng):
    every = ["'", "'s", "'LL", "a", "re", "t", "é", "é", "Σ", "İ", "ß", "日", "가", "각", "1", "²", "!", "…", "😀", "̀", " ", "　", "\n", "\x1c", "\x85", "\0",
             "<|endoftext|>", "<|startoftext|>", "<|"]
    return ["".join(rng.choice(every) for _ in range(rng.randrange(60))) for _ in range(400)] + ["".join(rng.choice(every[:20]) for _ in range(3000)) for _ in range(4)]


def encoded(known, texts):
    parts = [[] for _ in texts]
    for i, ids in known.encode(texts):
        parts[i] += ids.tolist()
    return parts


def test_ids_and_texts_are_the_library_s(known, path, docs, monkeypatch):
    library, rng = Tokenizer.from_file(path), random.Random(1)
    texts = ["", " ", "'s's ''s 'sfoo x'll'd 'r 're're 'VE", *texts_of(rng), *(r["text"] for r in docs.limit(40).collect())]
    texts += ["".join(rng.choice("thebarolgin") for _ in range(9000)), "ab" * 6000 + "!" * 9000, "😀" * 3000, "é" * 9000, "1" * 9000, "a'" * 9000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(known, texts) == want
    monkeypatch.setattr(bpe, "STEP", 24)
    monkeypatch.setattr(bpe, "REACH", 20)
    monkeypatch.setattr(bpe, "BLOCK", 8)
    known.forget()
    assert encoded(known, texts) == want
    for text, ids in zip(texts, want, strict=True):
        reader = bpe.decoder(known, spelled=True)
        assert "".join([*(reader.feed(np.array(ids[k:k + 3], np.int64)) for k in range(0, len(ids), 3)), reader.finish()]) == library.decode(ids, skip_special_tokens=False)


def test_plain_decoding_gives_words_back(known):
    ids = np.concatenate([ids for _, ids in known.encode(["Naïve 日本 😀 it's <|endoftext|> ok"])])
    reader = bpe.decoder(known, spelled=False)
    assert "".join([*(reader.feed(ids[k:k + 1]) for k in range(len(ids))), reader.finish()]) == "naïve 日本 😀 it 's <|endoftext|>ok "
    broken = bpe.Decoder([b"\xc3", b"a"])
    assert broken.feed(np.array([0])) == "" and broken.feed(np.array([1])) == "�a" and broken.finish() == ""


def rank_order(rules, word):
    """Merges one by one: the most urgent pair, leftmost first."""
    parts = [c for c in word]
    while True:
        able = [(rules.index((a, b)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (a, b) in rules]
        if not able:
            return parts
        _, i = min(able)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def random_rules(rng, letters, n):
    made, rules = list(letters), []
    for _ in range(n):
        a, b = rng.choice(made), rng.choice(made)
        if (a, b) not in rules and a + b not in made and len(a + b) <= 6:
            rules.append((a, b))
            made.append(a + b)
    return rules, made


def test_lookahead_suffices():
    """Whatever follows a place by more than the lookahead, the tokens before it stay."""
    rng = random.Random(2)
    for _ in range(150):
        rules, made = random_rules(rng, "abc", rng.randrange(1, 14))
        ahead = bpe.sufficient_lookahead([(tuple(a), tuple(b)) for a, b in rules])
        number = {x: i for i, x in enumerate(made)}
        merges = bpe.Merges(np.array([(number[a], number[b], number[a + b]) for a, b in rules], np.int64), ahead)
        head = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 30)))
        ends = []
        for _ in range(6):
            word = head + "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
            want = rank_order(rules, word)
            ids, _ = merges.merge(np.array([number[c] for c in word]), np.zeros(len(word), np.int64))
            assert [made[i] for i in ids] == want
            bounds = np.cumsum([len(x) for x in want])
            ends.append({int(b) for b in bounds if b <= len(head) - ahead})
        assert all(e == ends[0] for e in ends)


def test_rules_must_be_made_before_they_are_used(tmp_path):
    import json

    letters = bpe.byte_letters()
    vocab = {x: i for i, x in enumerate([*letters, *(x + "</w>" for x in letters), "abc", "ab"])}
    file = tmp_path / "bad.json"
    file.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": [["ab", "c"], ["a", "b"]], "end_of_word_suffix": "</w>"}}))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(file))


def test_odd_rows_are_encoded(odd, none, path):
    library = Tokenizer.from_file(path)
    rows = bpe.encode(odd, path, spelled=True).collect()
    texts = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(r["text"] or "")
    assert len(rows) == odd.count()
    for r in rows:
        assert r["ids"] in [library.encode(t, add_special_tokens=False).ids for t in texts[r["id"]]] and r["decoded"] == library.decode(r["ids"], skip_special_tokens=False)
    again = bpe.decode(bpe.encode(odd, path), path, spelled=True).collect()
    assert sorted((r["id"] or 0, r["text"]) for r in again) == sorted((r["id"] or 0, r["decoded"]) for r in rows)
    assert bpe.encode(none, path).count() == 0 and bpe.decode(bpe.encode(none, path), path).count() == 0


def test_query_digests(spark, docs, path):
    library = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in QUERIES["op13_streaming_bpe"](spark, SF).collect()}
    for r in docs.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        row = got[r["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_words_of_arrow_slices():
    column = pa.array(["zz", None, "a b", ""])[1:]
    found = list(phrases.slices(column, np.array([0, 1, 0]), 4))
    assert [bytes(x[0]) for x in found] == [b"\na b\n\n"]
