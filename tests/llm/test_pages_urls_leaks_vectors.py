import datetime

import numpy as np
import pytest
from compare import database, differences
from conftest_llm import SF
from incidentlake.llm import contamination, extraction, queries, urls, vectors
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    assert differences(spark, database(SF), queries.QUERIES[name], queries.SQL[name], SF) == []


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\nb"),
    ("<html><head><title>t</title></head><body><nav>menu</nav><article><h1>H</h1><p>one <b>two<br>three</p><div class='comments'><p>no</p></div></article><footer>f</footer>",
     "H\none two three"),
    ("<body><header>h</header><div id=sidebar>s</div><div class='cookie-notice'>c</div><form>f</form><p>x &lt;y&gt; &copy;</p><!-- <p>z</p> --><script>var a='</p>';</script>",
     "x <y> ©"),
    ("<article><header><h1>T</h1></header><p>a\n  b</p><aside>no</aside></article>", "T\na b"),
    ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", "deep\nafter"),
    ("<div>" * 50_000 + "<nav>menu</nav><p>deep" + "</div>" * 50_000 + "<p>after", "deep\nafter"), ("<p>a<b>x<div>y</div>z", "ax\ny\nz"),
    ("<article>" + "<section>" * 400 + "<p>text</p><div class='cookie'>no</div><script>no</script>" + "</section>" * 400 + "</article>", "text"), ("<p title='a>b'>q</p><p unclosed", "q")])
def test_page_text(spark, page, text):
    df = spark.createDataFrame([(1, "http://h.example/1", page, "c")], "page_id long, url string, html string, text string")
    assert [(r["text"], r["n_chars"]) for r in extraction.main_text(df).collect()] == [(text, len(text))]


def test_site_templates_go_and_prose_stays(spark):
    def page(i):
        return (f"<body><div><span>Site name</span></div><div><p>Text {i} of its own, with words.</p><p>Shared sentence.</p></div>"
                f"<article><p>Article {i}</p><p>Shared sentence.</p><div>Read more here</div></article></body>")

    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(30)] + [(99, "http://b.example/1", page(99)), (100, None, page(1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (1000, -1):
        got = {r["id"]: r["text"] for r in extraction.main_text(df, most_sent=most).collect()}
        assert got[3] == "Article 3\nShared sentence." and got[99] == "Article 99\nShared sentence.\nRead more here"
        assert len(got) == 32
    copies = spark.createDataFrame([(i, f"http://a.example/{i}", "<div><p>copied page</p></div>") for i in range(30)], "page_id long, url string, html string")
    assert {r["text"] for r in extraction.main_text(copies).collect()} == {"copied page"}
    assert extraction.main_text(df.limit(0)).count() == 0


def test_templates_do_without_names_and_classes(spark, monkeypatch):
    """A site of plain elements: with no word or element name that says what is an aside, its articles come out."""
    monkeypatch.setattr(extraction, "ASIDE_WORDS", frozenset())
    monkeypatch.setattr(extraction, "ASIDE", frozenset({"script", "style"}))

    def page(i):
        menu = "".join(f"<li><a href='/{k}'>Part {k}</a></li>" for k in range(5))
        return (f"<body><div>The site</div><div><ul>{menu}</ul></div><div><div><h2>Title {i}</h2><p>Text {i} of its own.</p><h3>Background</h3><p>More of {i}.</p></div>"
                f"</div><div>Written by hand</div><div><div><p>Sign up for our letter.</p><p>It is free.</p></div></div></body>")

    df = spark.createDataFrame([(i, f"http://plain.example/{i}", page(i)) for i in range(100)], "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in extraction.main_text(df).collect()}
    # a heading that all articles of such a site share cannot be told from a template
    assert got == {i: f"Title {i}\nText {i} of its own.\nMore of {i}." for i in range(100)}


def test_boxes_in_articles_and_rare_menus_are_templates(spark):
    box = '<div class="box"><p>Read all our reports on the weather of the week, every day, free of charge.</p></div>'
    rows = [(i, f"http://news.example/{i}", f"<body><div>menu {i % 8}</div><article><h1>T{i}</h1><p>One {i}.</p>{box}<p>Same words.</p></article></body>") for i in range(160)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["text"] for r in extraction.main_text(df).collect()} == {f"T{i}\nOne {i}.\nSame words." for i in range(160)}
    found = extraction.site_templates(df.withColumn("host", F.lit("news.example")))
    assert found.count() == 9  # eight menus and the box


def brute_templates(rows, least):
    """All pages of a host side by side: which subtree, by its own text, names and place, is on how many different pages."""
    def spelled(e):
        return (e.name, tuple(sorted(e.words)), tuple(spelled(p) if isinstance(p, extraction.Element) else " ".join(p.split()) for p in e.parts if not isinstance(p, str) or p.split()))

    pages = {}
    for host, page in rows:
        root = extraction.parse(page)
        extraction.digest(root)
        shares = dict(extraction.recurring(root))
        found, todo = {}, [(root, ())]
        while todo:
            e, place = todo.pop()
            place = (*place, e.name)
            if e.digest in shares:
                found[place, spelled(e)] = (shares[e.digest], e.digest)
            todo += [(p, place) for p in e.parts if isinstance(p, extraction.Element)]
        body = "\n".join(t for e in extraction.structured(root) for t in extraction.blocks(e))
        pages.setdefault(host, {})[body] = pages.get(host, {}).get(body, {}) | found
    out = set()
    for host, bodies in pages.items():
        counts = {}
        for found in bodies.values():
            for key, (share, digest) in found.items():
                n, most, _ = counts.get(key, (0, 0.0, 0))
                counts[key] = (n + 1, max(most, share), digest)
        out |= {(host, digest) for n, share, digest in counts.values() if n >= least and n >= share * len(bodies)}
    return out


def test_templates_against_brute_force(spark):
    rows = [(r["host"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").withColumn("host", urls.host_of(F.col("url"))).collect() if r["host"] and r["html"]]
    rng = np.random.default_rng(2)
    parts = ["<div>menu a</div>", "<div>menu b</div>", "<ul><li>x</li></ul>", "<div class='box'><p>text of a box</p></div>", "<p>Same words.</p>"]
    rows += [("planted.example", "<body>" + "".join(rng.choice(parts, 3)) + ("<article>" if i % 2 else "<div>") + f"<p>Own {i % 70}.</p>" + "".join(rng.choice(parts, 2))) for i in range(100)]
    df = spark.createDataFrame(rows, "host string, html string")
    want = brute_templates(rows, 3)
    assert {tuple(r) for r in extraction.site_templates(df, least_pages=3).collect()} == want and len(want) >= 3


def test_url_lists_over_time(spark):
    d = datetime.date
    captures = spark.createDataFrame([("http://a.b.example/x/y?q", d(2024, 1, day)) for day in (1, 5, 10, 15, 31)] + [(None, d(2024, 1, 1)), ("http://a.b.example", None), ("no url", d(2024, 1, 9))],
                                     "url string, day date")
    entries = spark.createDataFrame([("l", "domain", "B.example", d(2024, 1, 5), "add"), ("l", "domain", "b.example", d(2024, 1, 10), "remove"),
                                     ("l", "domain", "b.example", d(2024, 1, 15), "add"), ("l", "domain", "b.example", d(2024, 1, 15), "remove"),
                                     ("m", "prefix", "a.b.example/x", d(2024, 1, 31), "add"), ("m", "prefix", None, d(2024, 1, 1), "add"), ("m", "odd", "a.b.example", d(2024, 1, 1), "add")],
                                    "list string, kind string, pattern string, day date, action string")
    got = {(r["url"], r["day"]): (r["blocked"], r["lists"], r["since"]) for r in urls.temporal_url_filter(captures, entries).collect()}
    u = "http://a.b.example/x/y?q"
    assert len(got) == 8 and [got[u, d(2024, 1, x)][0] for x in (1, 5, 10, 15, 31)] == [False, True, False, False, True]
    assert got[u, d(2024, 1, 31)] == (True, "m", d(2024, 1, 31)) and sum(v[0] for v in got.values()) == 2
    assert urls.temporal_url_filter(captures, entries.limit(0)).where("blocked").count() == 0
    assert urls.temporal_url_filter(captures.limit(0), entries).count() == 0


def test_leaks_in_long_texts_and_odd_rows(spark, odd, none):
    item = "one two three four five six seven eight nine ten eleven twelve"
    filler = " ".join(f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, f"{filler} {item.upper()}! {filler}"), (2, filler), (3, item.replace("six", "SIX,")), (4, item.replace("six", "6")), (5, "one two"), (6, None)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(10, item, "x"), (11, "one two", "x"), (12, None, "x"), (13, "", "x"), (None, item, "x")], "item_id long, text string, doc_id string")
    for most in (2_000_000, 1):
        got = {(r["id"], r["item_id"]) for r in contamination.leaks(docs, bench, pass_shingles=most).collect()}
        assert got == {(1, 10), (3, 10), (1, 11), (3, 11), (4, 11), (5, 11)}
    assert contamination.leaks(docs, bench.limit(0)).count() == contamination.leaks(none, bench).count() == 0
    clean = contamination.without_leaks(odd, contamination.leaks(odd, bench))
    assert clean.columns == odd.columns and clean.count() == 10


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 16))
    points = np.concatenate([c + rng.normal(size=(12, 16)) * 0.2 for c in centres] + [np.repeat(centres[:1] * 3, 40, 0)])
    nan, inf = float("nan"), float("inf")
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [nan] * 16), (9004, [None] * 16), (9005, [inf] * 16), (9006, []), (9007, [1.0, 0.0]), (9008, [2.0, 0.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + odd, "vec_id long, embedding array<double>").selectExpr("*", "'c' as id", "'c' as shard")
    got = {r["id"]: r for r in vectors.near_vectors(df).collect()}
    unit = points / np.sqrt((points**2).sum(1, keepdims=True))
    truth = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(points))])
    assert (found <= truth).all() and found.sum() >= 0.95 * truth.sum()
    assert got[9007]["n_links"] == 1 and got[9008]["component_id"] == 9007 and not got[9008]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(9001, 9007)) and got[None]["component_id"] is None
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_audit_counts_links_with_other_vectors_only(spark, monkeypatch):
    rng = np.random.default_rng(1)
    alone, pair = np.eye(64)[:40], np.repeat(np.eye(64)[40:60], 2, 0) + rng.normal(size=(40, 64)) * 0.01
    crowd = np.eye(64)[60] + rng.normal(size=(120, 64)) * 0.01
    rows = [(i, p.tolist()) for i, p in enumerate(np.concatenate([alone, pair, crowd]))] + [(1000 + i, p.tolist()) for i, p in enumerate(alone)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    audited, whole = [], vectors.link_recall
    monkeypatch.setattr(vectors, "link_recall", lambda truth, found: audited.append((truth, whole(truth, found))) or audited[-1][1])
    real = vectors.linked_counts
    # a search that loses every pair, as 120 x 119 links of the crowd outweigh 40 of the pairs
    monkeypatch.setattr(vectors, "linked_counts", lambda *a: real(*a).where("id < 40 or id >= 80"))
    got = {r["id"]: r for r in vectors.near_vectors(df).collect()}
    truth, first = audited[0]
    assert set(truth) == set(range(40, 200)) and truth[40] == 1 and truth[80] == 119  # copies of a vector are no links
    assert abs(first - 120 / 160) < 0.01  # by pairs it would read 0.997
    assert all(got[i]["n_links"] == 1 for i in range(80)) and {got[i]["n_links"] for i in range(80, 200)} == {119}
    assert got[41]["component_id"] == 40 and got[1000]["component_id"] == 0 and not got[1000]["kept"]


def test_audit_draws_more_where_links_are_rare(spark):
    points = np.concatenate([np.eye(1200)[:1196], np.eye(1200)[:4] + 0.1 * np.eye(1200)[1196:]])
    classes = spark.createDataFrame([(i, 1, p.tolist()) for i, p in enumerate(vectors.unit(points))], "id long, copies long, vector array<double>")
    truth, drawn = vectors.drawn_links(classes, 0.9, 200)
    assert drawn == 1200 and truth == {i: 1 for i in (0, 1, 2, 3, 1196, 1197, 1198, 1199)}


def test_small_groups_beside_a_dense_one_are_reached():
    rng = np.random.default_rng(5)
    dense = rng.normal(size=64) + rng.normal(size=(600, 64)) * 0.2
    base = np.repeat(rng.normal(size=(100, 64)), 3, 0)
    points = vectors.unit(np.concatenate([dense, base + rng.normal(size=base.shape) * 0.2]))
    truth = points @ points.T >= 0.9
    np.fill_diagonal(truth, False)
    lists = vectors.graph(points)
    edges = np.stack((np.repeat(np.arange(len(points)), lists.shape[1]), lists.ravel()), 1)[lists.ravel() >= 0]
    begins, ends = vectors.both_ways(len(points), edges)
    assert {(a, b) for a, b in edges.tolist()} <= {(b, a) for a in range(len(points)) for b in ends[begins[a]:begins[a + 1]].tolist()}
    found = vectors.range_search(points, (begins, ends), 0.9, 16)
    assert (truth | ~found).all() and not found.diagonal().any()
    per = found.sum(1) / truth.sum(1)
    assert per[:600].mean() > 0.99 and per[600:].mean() > 0.99


def test_recall_of_skewed_vectors_at_the_first_try(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = np.repeat(rng.normal(size=(300, 32)), 3, 0)
    points = np.concatenate([rng.normal(size=32) + rng.normal(size=(700, 32)) * 0.2, base + rng.normal(size=base.shape) * 0.2])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points[rng.permutation(len(points))])], "vec_id long, embedding array<double>")
    audited, whole = [], vectors.link_recall
    monkeypatch.setattr(vectors, "link_recall", lambda truth, found: audited.append(whole(truth, found)) or audited[-1])
    vectors.near_vectors(df).collect()
    assert len(audited) == 1 and audited[0] > 0.95


def test_only_a_fixed_sample_of_vectors_comes_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = np.repeat(rng.normal(size=(40, 8)), 100, 0)
    points = vectors.unit(np.concatenate([base + rng.normal(size=base.shape) * 0.1, np.ones((2000, 8)) + rng.normal(size=(2000, 8)) * 0.01]))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<double>").cache()
    fetched, whole = [], type(rows).toPandas
    monkeypatch.setattr(type(rows), "toPandas", lambda self: fetched.append(whole(self)) or fetched[-1])
    monkeypatch.setattr(vectors, "FIRST_SAMPLE", 300)
    monkeypatch.setattr(vectors, "PART", 500)
    model = vectors.fit_shards(rows, 6000, 8, 100)
    first, centres = fetched
    assert 200 < len(first) < 450 and 80 <= len(centres) == len(model.lower) <= 140 and len(model.upper) <= 10
    assert centres["part"].max() > 0  # the crowded group was dealt
    assert set(model.parent) == set(range(len(model.upper))) and np.allclose((model.lower ** 2).sum(1), 1)
    assert np.take_along_axis(points @ model.lower.T, model.nearest(points, 3), 1)[:, 0].mean() > 0.95


def test_article_text_with_words_of_asides_stays(spark):
    def page(i):
        return (f"<body><article><h1>A {i}</h1><h2 id='related-work'>Related {i}</h2><section id='discussion'><p>We discuss {i}.</p></section>"
                f"<section id='comments'><p>On comments {i}.</p></section><p class='search-results'>Found {i}.</p><div class='share-prices'><p>Up {i}.</p></div>"
                f"<div class='related'><a href='/{i}'>More {i}</a></div><div class='share'><p>Share this with friends</p></div>"
                f"<div class='comments'><p>Nice {i}</p></div><p class='ad'>Buy {i}</p></article></body>")

    df = spark.createDataFrame([(i, f"http://a.example/{i}", page(i)) for i in range(20)] + [(99, "http://b.example/1", page(99))], "page_id long, url string, html string")
    got = {r["id"]: r["text"] for r in extraction.main_text(df).collect()}
    own = "A {0}\nRelated {0}\nWe discuss {0}.\nOn comments {0}.\nFound {0}.\nUp {0}."
    assert got[3] == own.format(3) and got[99] == own.format(99) + "\nShare this with friends"
