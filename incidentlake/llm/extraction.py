"""Main text of web pages: page structure, and removal of element subtrees that recur on a site."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .urls import host_of

#: Templates that are sent to every task; more are joined by host, dealt over ``SALTS`` parts of a host.
MOST_SENT, SALTS = 200_000, 64
#: Functions that walk a tree call themselves once per level; no page may end in an error for its depth.
RECURSION = 10_000_000

TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body"}
#: Elements of a page that are not its main text.
ASIDE = frozenset("nav footer aside form script style noscript template iframe svg canvas object button select textarea input dialog menu head audio video".split())
#: Words of a class, id or role that say the same of an element.
ASIDE_WORDS = frozenset("nav navbar navigation menu menubar footer sidebar aside cookie cookies consent gdpr notice notification alert ad ads advert adverts advertisement "
                        "advertising sponsor sponsored promo promotion banner comment comments discussion disqus reply replies respond share sharing social related "
                        "breadcrumb breadcrumbs newsletter subscribe subscription signup login popup modal overlay widget masthead toolbar pagination pager "
                        "contentinfo complementary search copyright disclaimer".split())
#: Of these, words that an article may use of its own text.
AMBIGUOUS = frozenset("discussion related search share sharing social copyright reply replies respond".split())
#: Elements whose id names what an article says there.
TOPIC = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote section".split())
CONTENT_WORDS = frozenset("content article post entry story main body text".split())
#: Shares of a site's pages on which a subtree must recur to be a template, see ``recurring``.
OUTSIDE, SOME, HALF = 0.01, 0.25, 0.5
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li ol ul dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())


@dataclass
class Element:
    name: str
    words: frozenset[str] = frozenset()
    parts: list[object] = field(default_factory=list)  # texts and elements
    digest: int = 0
    said: bool = False  # whether the subtree has text, prose, an article or main element
    prose: bool = False
    main: bool = False
    roles: frozenset[str] = frozenset()  # words without those of the id
    marked: bool = False  # in an article by an ambiguous word only


def parse(page: str) -> Element:
    """The page as a tree, of any depth. Unclosed elements end with their parent, stray end tags are ignored."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), RECURSION))
    root = Element("html")
    stack, at, end = [root], 0, len(page)
    open_: dict[str, int] = {}  # open elements by name

    def leave() -> Element:
        e = stack.pop()
        open_[e.name] -= 1
        return e

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            stack[-1].parts.append(page[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if open_.get(name):
                while leave().name != name:
                    pass
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P and open_.get("p"):
            # an open paragraph ends unless another block is open in it
            inner = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == "p" or stack[i].name in BLOCK)
            if stack[inner].name == "p":
                while leave().name != "p":
                    pass
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and name == stack[-1].name:
            leave()
        if name == "li" and stack[-1].name == "li":
            leave()
        words: set[str] = set()
        roles: set[str] = set()
        if m[3]:
            for key, *values in ATTRIBUTE.findall(m[3]):
                if key.lower() in ("class", "id", "role"):
                    found = [w.lower() for w in WORDS.findall("".join(values))]
                    words.update(found)
                    roles.update(found if key.lower() != "id" else ())
        element = Element(name, frozenset(words), roles=frozenset(roles))
        stack[-1].parts.append(element)
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            element.parts.append(page[at:close.start() if close else end])
            at = close.end() if close else end
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(element)
            open_[name] = open_.get(name, 0) + 1
    return root


def is_aside(e: Element, inside_article: bool) -> bool:
    if e.name in ASIDE:
        return True
    if e.name == "header":
        return not inside_article
    if e.name in ("html", "body", "main", "h1"):
        return False
    if e.name == "article":
        return bool(e.words & {"comment", "comments", "reply", "related", "sponsored", "ad"})
    if not inside_article:
        return bool(e.words & ASIDE_WORDS)
    said = (e.roles if e.name in TOPIC else e.words) & ASIDE_WORDS
    e.marked = bool(e.words & AMBIGUOUS)
    return bool(said - AMBIGUOUS) or e.marked and all_links(e)


def all_links(e: Element) -> bool:
    """Whether a subtree has text, and all of it in links."""
    inside = outside = False
    todo: list[tuple[Element, bool]] = [(e, e.name == "a")]
    while todo:
        x, link = todo.pop()
        for p in x.parts:
            if isinstance(p, Element):
                todo.append((p, link or p.name == "a"))
            elif p.strip():
                inside, outside = inside or link, outside or not link
    return inside and not outside


def prune(e: Element, inside_article: bool = False) -> None:
    """Remove what the structure marks as no main text."""
    inside_article = inside_article or e.name in ("article", "main")
    e.parts = [p for p in e.parts if not isinstance(p, Element) or not is_aside(p, inside_article)]
    for p in e.parts:
        if isinstance(p, Element):
            prune(p, inside_article)


def mains(e: Element) -> list[Element]:
    """Outermost articles, else main elements, else elements named as content, else the page."""
    for wanted in (lambda x: x.name == "article", lambda x: x.name == "main" or "main" in x.words and x.name in BLOCK,
                   lambda x: x.name in ("div", "section") and bool(x.words & CONTENT_WORDS)):
        found: list[Element] = []
        todo: list[Element] = [e]
        while todo:
            x = todo.pop()
            if x is not e and wanted(x):
                found.append(x)
            else:
                todo += [p for p in reversed(x.parts) if isinstance(p, Element)]
        if any(blocks(x) for x in found):
            return found
    return [e]


def digest(e: Element, place: int = 0) -> int:
    """Hash of a subtree: names, classes and text without regard to white space. Sets ``digest``, with the names above, and what the subtree holds."""
    place = xxhash.xxh3_64_intdigest(b"%d %s" % (place, e.name.encode()))
    tool = xxhash.xxh3_64(e.name)
    tool.update(" ".join(sorted(e.words)))
    for p in e.parts:
        if isinstance(p, Element):
            tool.update(b"\1%d" % digest(p, place))
            e.said = e.said or p.said
            e.prose = e.prose or p.prose or p.name in ("p", "h1", "pre", "blockquote")
            e.main = e.main or p.main or p.name in ("article", "main")
        elif text := " ".join(p.split()):
            tool.update("\2" + text)
            e.said = True
    own = tool.intdigest()
    e.digest = xxhash.xxh3_64_intdigest(b"%d %d" % (place, own)) - (1 << 63)
    return own


def recurring(root: Element) -> Iterator[tuple[int, float]]:
    """(digest, share) of the subtrees with text: the share of a site's pages from which on a subtree at this place is a template.

    What lies outside of an article or main element and recurs at all is one, for a site
    may have many menus and footers: ``OUTSIDE`` is small. Inside, articles share
    sentences and headings: prose itself stays, what holds prose must be on half of the
    pages, other elements on a quarter. On a page without article or main element prose
    and what holds it must be on half of the pages, other elements on a quarter.
    """
    todo: list[tuple[Element, bool]] = [(root, False)]
    elements: list[tuple[Element, bool]] = []
    while todo:
        x, inside = todo.pop()
        for p in x.parts:
            if isinstance(p, Element):
                elements.append((p, inside))
                todo.append((p, inside or p.name in ("article", "main")))
    plain = not any(e.name in ("article", "main") for e, _ in elements)
    for e, inside in elements:
        if not e.said or e.name not in BLOCK or e.name in ("article", "main", "h1"):
            continue
        if inside and e.words & AMBIGUOUS:
            yield e.digest, SOME
        elif plain or inside:
            if plain or e.name not in PROSE:
                yield e.digest, HALF if e.name in PROSE or e.prose else SOME
        elif not e.main:
            yield e.digest, OUTSIDE


def without(e: Element, gone: frozenset[int]) -> None:
    """Remove the outermost subtrees in ``gone``."""
    todo = [e]
    while todo:
        x = todo.pop()
        x.parts = [p for p in x.parts if not isinstance(p, Element) or p.digest not in gone]
        todo += [p for p in x.parts if isinstance(p, Element)]


def blocks(e: Element) -> list[str]:
    """Texts of the blocks of a subtree in page order."""
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    def walk(x: Element) -> None:
        for p in x.parts:
            if not isinstance(p, Element):
                line.append(p)
            elif p.name in BLOCK:
                close()
                walk(p)
                close()
            elif p.name == "br":
                line.append(" ")
            else:
                walk(p)

    walk(e)
    close()
    return out


def structured(root: Element) -> list[Element]:
    """What the structure of a page marks as its main text."""
    prune(root)
    return mains(root)


def site_templates(pages: DataFrame, host: str = "host", html_col: str = "html", least_pages: int = 10) -> DataFrame:
    """(host, digest): subtrees that recur, at the same place, on at least ``least_pages`` pages and a share of the pages of a host.

    All subtrees of the whole pages are hashed in the tasks, before anything else is taken
    away, and counted per host in Spark; which share it takes says ``recurring``. Pages
    whose main text is equal count once, so that copies of one page do not make its text
    a template.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, bodies, digests, shares = [], [], [], []
            for host_, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(page)
                digest(root)
                found = dict(recurring(root))
                body = xxhash.xxh3_64_intdigest("\n".join(t for e in structured(root) for t in blocks(e))) - (1 << 63)
                found[0] = 0.0  # counts the page itself
                hosts += [host_] * len(found)
                bodies += [body] * len(found)
                digests += found.keys()
                shares += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(bodies, pa.int64()), pa.array(digests, pa.int64()), pa.array(shares, pa.float64())],
                                             names=["host", "body", "digest", "share"])

    seen = pages.select(F.col(host).alias("host"), F.col(html_col).alias("html")).where("host <> '' and html <> ''") \
        .mapInArrow(run, "host string, body long, digest long, share double").groupBy("host", "digest", "body").agg(F.max("share").alias("share"))
    counts = cut_lineage(seen.groupBy("host", "digest").agg(F.count("*").alias("n"), F.max("share").alias("share")).where(F.col("n") >= least_pages))
    total = counts.where("digest = 0").select("host", F.col("n").alias("pages"))
    return counts.where("digest <> 0").join(total, "host").where(F.col("n") >= F.col("share") * F.col("pages")).select("host", "digest")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 10, most_sent: int = MOST_SENT) -> DataFrame:
    """(id, url, text, n_chars): the main text of each whole page.

    Site templates first: subtrees that recur at the same place on many pages of the host
    go, whatever their names and classes. Then the structure of what is left, for sites
    with few pages and for what differs from page to page: menus, headers, footers,
    sidebars, notices, adverts, forms, comments, scripts and styles go, and of the rest the
    article is taken, else the main element, else an element named as content, else the
    page. In an article the ids of headings, prose and sections say nothing, and what only
    a word of ``AMBIGUOUS`` marks goes if it is all links or recurs. Character references
    are decoded, white space in a block is one blank, blocks are joined by line breaks.

    Null and empty pages give an empty text; pages without a host in their URL lose no
    templates. Templates are sent to the tasks if they are at most ``most_sent``, else
    joined by host. Repeated rows give repeated rows; other columns are not read; an empty
    table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")) \
        .withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    templates = cut_lineage(site_templates(rows, least_pages=least_pages))
    sent: dict[str, frozenset[int]] | None = None
    if templates.count() <= most_sent:
        by_host: dict[str, set[int]] = {}
        for r in templates.collect():
            by_host.setdefault(r["host"], set()).add(r["digest"])
        sent = {h: frozenset(d) for h, d in by_host.items()}
        joined = rows.withColumn("gone", F.lit(None).cast("array<long>"))
    else:
        salted = templates.groupBy("host").agg(F.collect_list("digest").alias("gone")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for host_, page, gone in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                away = sent.get(host_) if sent is not None else frozenset(gone or ())
                root = parse(page or "")
                if away:
                    digest(root)
                    without(root, away)
                texts.append("\n".join(t for e in structured(root) for t in blocks(e)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["id", "url", "text", "n_chars"])

    return joined.select("id", "url", "host", "html", "gone").mapInArrow(run, "id long, url string, text string, n_chars long")
