"""Operator 4: main text of web pages by wrapper induction.

Pages of a host are brought together in groups of about CHUNK, dealt by a hash of the page; in each, the first page
with text by id is the pattern, and every other page is aligned to it by simple tree matching. What the alignments say
(blocks with equal text at a path; how many were aligned) is summed over all groups by host, path and text, so a
host's template rests on all its pages, however they are partitioned, and no large host is gathered in one place. Blocks
whose text is constant, and paths outside the article whose blocks mostly are, become template; varying slots become
content, unless their element's role says that it is a menu, header, footer, sidebar, notice, advert, form or comment.
Article and main elements are evidence: what varies inside them is the text, unless the host's alignments have shown
slots outside that hold more of the page's varying text than they do; then both are. Only where a host has no such
evidence does the element alone decide. Pairs of pages whose content agrees too are copies and prove nothing.

Null and empty html, and html without text, give an empty text. Unclosed and stray tags are tolerated. Repeated
rows give repeated results; an empty table gives no rows; extra columns are ignored; a page without a usable URL
belongs to the host ''.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize

RESULT = "page_id long, url string, text string, n_chars long"
STATS = "host string, path string, hash long, n long, aligned long"
#: A block or path is template if constant in this share of its host's alignments, and in so many at least.
SHARE, LEAST = 0.5, 3
#: In place of a text's hash: the path as a whole is template; the path is a slot whose text varies.
PATH, SLOT = 0, 1
#: Pages of a host that are aligned to one pattern, on average at most.
CHUNK = 256
#: Templates of more rows than this, all hosts together, are joined instead of sent to every task.
SMALL = 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(script|style|noscript|template|textarea|iframe|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTR = re.compile(r"""([a-zA-Z_:][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img label".split())
_DROP = frozenset("nav header footer aside form menu dialog button select option input object canvas audio video map".split())
_ROLE = re.compile(r"(?:^|[-_ ])(?:ads?|adv|advert\w*|banners?|promo\w*|sponsor\w*|sidebars?|comments?|commentlist|respond|repl(?:y|ies)|disqus|notices?|cookies?|consent|gdpr|alerts?|popups?|modals?|newsletter|subscribe|shar(?:e|ing)|social|related|recommend\w*|menus?|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|login|signup|search|pagination|pager|widgets?|toolbar|skip)(?:[-_ ]|$)", re.I)
_ARIA = frozenset("navigation banner contentinfo complementary search alert menu form dialog".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SPACE = re.compile(r"\s+")


class Node:
    """An element: its tag with class names as key, its path, whether its role excludes it, and its children (elements and blocks of text)."""

    __slots__ = ("children", "dropped", "key", "main", "path", "tag")

    def __init__(self, tag: str, key: str, path: str, dropped: bool, main: bool):
        self.tag, self.key, self.path, self.dropped, self.main = tag, key, path, dropped, main
        self.children: list[Node | str] = []


def _child(parent: Node, tag: str, attrs: str) -> Node:
    got = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(attrs)} if attrs.strip(" /\n\t") else {}
    names = f"{got.get('class', '')} {got.get('id', '')}".strip()
    key = f"{tag}.{names}" if names else tag
    main = tag in ("article", "main") or got.get("role") == "main"
    whole = tag in ("html", "body", "main")
    named = any(_ROLE.match(n) for n in names.split()) if tag == "article" else bool(names and _ROLE.search(names))  # an article's classes also list its topics
    dropped = tag in _DROP or "hidden" in got or got.get("aria-hidden") == "true" or (not whole and (named or got.get("role") in _ARIA))
    return Node(tag, key, f"{parent.path}/{key}", parent.dropped or dropped, parent.main or main)


def parse(html: str) -> Node:
    """The tree of block elements; inline elements dissolve into the text around them, which ends at any block's border."""
    top = Node("", "", "", False, False)
    stack, run, at = [top], [], 0
    inline_dropped: list[str] = []

    def end_block() -> None:
        if run:
            text = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if text:
                stack[-1].children.append(text)
            run.clear()

    for m in _TOKEN.finditer(html):
        if m.start() > at and not inline_dropped:
            run.append(html[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1] and m[1].lower() not in ("script", "style"):
                end_block()
            continue
        if tag in _INLINE:
            if not m[2] and tag not in _VOID and tag in ("span", "a", "label") and m[4].strip() and _child(stack[-1], tag, m[4]).dropped and not stack[-1].dropped:
                inline_dropped.append(tag)
            elif m[2] and inline_dropped and inline_dropped[-1] == tag:
                inline_dropped.pop()
            continue
        if tag in ("br", "input"):
            run.append(" ")
            continue
        inline_dropped.clear()
        end_block()
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _VOID:
            continue
        if stack[-1].tag == "p":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ("ul", "ol", "dl", "table", "select", "article", "body"):
                break
            if stack[i].tag in _CLOSES.get(tag, ()):
                del stack[i:]
                break
        node = _child(stack[-1], tag, m[4])
        stack[-1].children.append(node)
        if not m[4].endswith("/"):
            stack.append(node)
    if at < len(html) and not inline_dropped:
        run.append(html[at:])
    end_block()
    return top


def blocks(top: Node) -> list[tuple[Node, str]]:
    """(parent, text) of every block outside excluded roles, in page order."""
    out, stack = [], [top]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x)
        elif not x.dropped:
            stack += [c if isinstance(c, Node) else (x, c) for c in reversed(x.children)]
    return out


def _leaf(x: Node) -> str | None:
    return x.children[0] if len(x.children) == 1 and isinstance(x.children[0], str) else None


def align(a: Node, b: Node) -> tuple[int, list[tuple[str, str, str]]]:
    """Simple tree matching: matched elements, and (path, text in a, text in b) of the matched blocks.

    A pair of text blocks or of elements that hold only text counts a bit more if the text is equal, so that constants
    are matched to each other among like siblings."""
    if not a.children or not b.children:
        return 1, []
    keys: dict = {}
    code = lambda xs: np.fromiter((keys.setdefault(x.key if isinstance(x, Node) else "", len(keys)) for x in xs), np.int64, len(xs))
    x, y = a.children, b.children
    kx, ky = code(x), code(y)
    tx, ty = ([c if isinstance(c, str) else _leaf(c) for c in xs] for xs in (x, y))
    values: dict = {}
    vx, vy = (np.fromiter((-1 - i if t is None else values.setdefault(t, len(values)) for i, t in enumerate(ts)), np.int64, len(ts)) for ts in (tx, ty))
    w = np.where(kx[:, None] == ky, 1.0 + 0.5 * ((vx[:, None] == vy) & (vx >= 0)[:, None]), 0.0)
    deep: dict[tuple[int, int], tuple[int, list]] = {}
    for i in np.flatnonzero([isinstance(c, Node) and t is None for c, t in zip(x, tx, strict=True)]).tolist():
        for j in np.flatnonzero(ky == kx[i]).tolist():
            if isinstance(y[j], Node) and ty[j] is None:
                deep[i, j] = got = align(x[i], y[j])
                w[i, j] = got[0]
    m = np.zeros((len(x) + 1, len(y) + 1))
    for i in range(len(x)):
        m[i + 1, 1:] = np.maximum.accumulate(np.maximum(m[i, 1:], m[i, :-1] + w[i]))
    i, j, pairs = len(x), len(y), []
    while i and j:
        if w[i - 1, j - 1] and m[i, j] == m[i - 1, j - 1] + w[i - 1, j - 1]:
            i, j = i - 1, j - 1
            if (i, j) in deep:
                pairs += deep[i, j][1]
            elif tx[i] is not None and ty[j] is not None:
                pairs.append((x[i].path if isinstance(x[i], Node) else a.path, tx[i], ty[j]))
        elif m[i, j] == m[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return 1 + int(m[-1, -1]), pairs


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows in order of host and salt."""
    group, pattern = None, None
    for pdf in batches:
        seen: dict[tuple[str, str, int], list[int]] = {}

        def add(host: str, path: str, value: int, constant: bool, seen: dict = seen) -> None:
            n = seen.setdefault((host, path, value), [0, 0])
            n[0] += constant
            n[1] += 1

        for host, salt, page in zip(pdf["host"].tolist(), pdf["salt"].tolist(), pdf["html"].tolist(), strict=True):
            key = xxhash.xxh64_intdigest(page)
            if group != (host, salt):
                group, pattern = (host, salt), None
            if pattern is None:
                tree = parse(page)
                pattern = (key, tree) if blocks(tree) else None
                continue
            if pattern[0] == key:
                continue
            pairs = [(p, s, t) for p, s, t in align(pattern[1], parse(page))[1]]
            if sum(len(s) for _, s, t in pairs if s == t) * 2 > sum(len(s) for _, s, _ in pairs):
                continue  # copies of one article
            add(host, "", 0, True)
            paths: dict[str, bool] = {}
            for p, s, t in pairs:
                paths[p] = paths.get(p, True) and s == t
                if s == t:
                    add(host, p, hashed(s), True)
            for p, constant in paths.items():
                add(host, p, 0, constant)
        yield pd.DataFrame([(*k, *n) for k, n in seen.items()], columns=["host", "path", "hash", "n", "aligned"])


def _rows(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))


def _grouped(rows: DataFrame) -> DataFrame:
    """host, salt, html, with groups of host and salt together and in one order whatever the partitioning."""
    large = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") > CHUNK).select("host", F.ceil(F.col("pages") / CHUNK).cast("long").alias("chunks"))
    salt = F.coalesce(F.pmod(F.xxhash64("page_id", "url", "html"), F.col("chunks")), F.lit(0))
    dealt = rows.join(F.broadcast(large), "host", "left").select("host", salt.alias("salt"), "page_id", "html")  # a CHUNKth of the pages at most
    return dealt.repartition("host", "salt").sortWithinPartitions("host", "salt", "page_id", "html").select("host", "salt", "html")


def induce(pages: DataFrame) -> DataFrame:
    """host, path, hash: the template. hash PATH: the path as a whole; SLOT: the path varies; else a block's text."""
    sums = materialize(_grouped(_rows(pages)).mapInPandas(_evidence, STATS).groupBy("host", "path", "hash").agg(F.sum("n").alias("n"), F.sum("aligned").alias("aligned")), "evidence")
    pairs = sums.where("path = ''").select(F.col("host").alias("of"), F.col("n").alias("pairs"))
    enough = (F.col("n") >= LEAST) & (F.col("n") >= SHARE * F.when(F.col("hash") == 0, F.col("aligned")).otherwise(F.col("pairs")))
    slot = (F.col("hash") == PATH) & (F.col("aligned") >= LEAST) & (F.col("n") < SHARE * F.col("aligned"))
    return sums.where("path <> ''").join(pairs, sums.host == pairs.of).where(enough | slot).select("host", "path", F.when(slot, F.lit(SLOT)).otherwise(F.col("hash")).cast("long").alias("hash"))


def mark(path: str, value: int) -> int:
    """A row of the template as a number."""
    return xxhash.xxh64_intdigest(f"{path}\0{value}")


def text_of(page: str, template: frozenset[int]) -> str:
    kept = [(x, t) for x, t in blocks(parse(page)) if mark(x.path, PATH) not in template and mark(x.path, hashed(t)) not in template]
    inside = sum(len(t) for x, t in kept if x.main)
    if inside and sum(len(t) for x, t in kept if not x.main and mark(x.path, SLOT) in template) <= inside:
        kept = [(x, t) for x, t in kept if x.main]
    return " ".join(t for _, t in kept)


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"host": pdf["host"], "marks": [np.asarray([mark(m["path"], m["hash"]) for m in x], np.uint64).tobytes() for x in pdf["rows"].tolist()]})


def templates(pages: DataFrame) -> DataFrame:
    """host, marks: the numbers of its template's rows, eight bytes each; as many as a page of the host has blocks and paths, about."""
    rows = induce(pages).groupBy("host").agg(F.collect_list(F.struct("path", "hash")).alias("rows"))
    return materialize(rows.mapInPandas(_marks, "host string, marks binary"), "templates")


def _extract(of):
    """A mapInPandas function to RESULT; of: from a batch to the marks of each of its pages, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets: dict[bytes, frozenset[int]] = {}
        for pdf in batches:
            if len(sets) > 256:
                sets.clear()
            marks = [bytes(x) if x is not None else b"" for x in of(pdf)]
            for x in set(marks).difference(sets):
                sets[x] = frozenset(np.frombuffer(x, np.uint64).tolist())
            out = pdf[["page_id", "url"]].copy()
            out["text"] = [text_of(page, sets[x]) for page, x in zip(pdf["html"].tolist(), marks, strict=True)]
            out["n_chars"] = out["text"].map(len).astype("int64")
            yield out

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars. Templates go to every task if they are small, else to their host's pages by a join, in which Spark splits a large host."""
    lists, rows = templates(pages), _rows(pages)
    if (lists.agg(F.sum(F.octet_length("marks"))).first()[0] or 0) <= 8 * SMALL:
        known = {r["host"]: bytes(r["marks"]) for r in lists.collect()}  # SMALL marks at most
        return rows.mapInPandas(_extract(lambda pdf: map(known.get, pdf["host"].tolist())), RESULT)
    return rows.join(lists, "host", "left").mapInPandas(_extract(lambda pdf: pdf["marks"].tolist()), RESULT)


#: Pages whose article holds nothing but headings, paragraphs and inline elements.
ORACLE = """
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') as h from pages),
b as (select page_id, url, regexp_replace(regexp_replace(h, '</?(b|i|a)( [^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') as t from a),
c as (select page_id, url, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&middot;', '·'), '&amp;', '&') as t from b)
select page_id, url, trim(regexp_replace(t, '\\s+', ' ', 'g')) as text, length(trim(regexp_replace(t, '\\s+', ' ', 'g'))) as n_chars from c
"""
