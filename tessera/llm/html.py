"""Main text of web pages: structural rules and per-host template removal."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MIN_PAGES = 5

#: Elements whose text is never part of the article.
SKIP = frozenset("head nav footer aside form button select menu dialog iframe object canvas svg audio video map datalist noscript template".split())
#: Elements that end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may be templates; text-level blocks never are.
SUBTREE = frozenset("div section nav aside header footer ul ol dl table form figure menu details center fieldset".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title".split())
#: A start tag of these ends an open element of the same group.
SIBLINGS = {"li": ("li",), "option": ("option",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Words of a class or id that mark what is not the article.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments cookie cookies consent copyright "
    "disclaimer disqus footer gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination popup promo promotion promoted recommended related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
#: Words that may stand beside a mark in one name; any other word makes the name one of content.
BESIDE = frozenset(
    "area article articles bar block body bottom box btn button buttons container content desktop flex form global grid header icon icons id inline inner item items label left "
    "link links list main mobile outer page panel post posts primary right row secondary section site slot small sticky story text title top unit wrap wrapper".split()
)
#: The only marks that an article or main element can have.
COMMENTS = frozenset("comment comments disqus replies reply".split())
#: Roles of what is not the article.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_GAP = re.compile(r"[\s/]*")
_NAME = re.compile(r"=?[^\s/>=]*")
_VALUE = re.compile(r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*))""")
_END = {t: re.compile(rf"</{t}(?![a-zA-Z0-9:-])[^>]*>?", re.I) for t in RAW}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes of a start tag from ``at`` on by name (the first of equals), where the tag ends, and whether it closes itself.

    Each character is passed once. A quote counts only where a value begins, and one
    that never ends is a part of an unquoted value.
    """
    found: dict[str, str] = {}
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= len(page):
            return found, at, False
        if page[at] == ">":
            return found, at + 1, gap.group().endswith("/")
        name = _NAME.match(page, at)
        at = name.end()
        value = _VALUE.match(page, at)
        if value:
            at = value.end()
        found.setdefault(name.group().lower(), (value[1] or value[2] or value[3] or "") if value else "")


def marked(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element's own attributes say that it isn't part of the article.

    It is hidden, has such a role, or a class or id all of whose words are marks or
    words that stand beside marks; ``tags-news`` or ``search-engines`` are names of content.
    Of an article or main element only the names of comments count.
    """
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _NONE.search(attributes.get("style", "")):
        return True
    whole = tag in ("article", "main")
    if not whole and attributes.get("role", "").lower() in ROLES:
        return True
    marks = COMMENTS if whole else MARKS
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if any(w in marks for w in words) and all(w in marks or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def parse(page: str) -> tuple[list[str], list[int], list[int], list[int]]:
    """Segments of the article in page order with the subtree around each, and those subtrees: hashes and parents.

    A subtree is a number into the last two lists, its parent's is smaller, -1 is none. One pass, in time
    proportional to the page, with a stack of open elements. Unclosed inline
    markup is harmless, a block start closes an open paragraph, an end tag closes
    up to its element if that is open. Within ``article``, else ``main``, else the
    whole body, blocks remain that no skipped or marked element holds. A subtree's hash is
    made of its tag, its text and the hashes of the subtrees within.
    """
    stack: list[tuple] = []  # (tag, skipped, level, innermost subtree, is one itself, is skipped by itself and no form)
    opened: Counter = Counter()
    hashes: list[int] = []
    parents: list[int] = []
    parts: list[list[str]] = []
    blocks: list[tuple[int, str, int]] = []
    text: list[str] = []
    skipped, level, node, hard = False, 0, -1, 0

    def flush():
        if text:
            s = "".join(text)
            text.clear()
            s = " ".join((_html.unescape(s) if "&" in s else s).split())
            if s:
                if node >= 0:
                    parts[node].append(s)
                if not skipped:
                    blocks.append((level, s, node))

    def push(tag, skip, up, subtree, cause):
        nonlocal skipped, level, node, hard
        if subtree:
            parents.append(node)
            hashes.append(0)
            parts.append([])
            node = len(hashes) - 1
        opened[tag] += 1
        hard += cause
        skipped, level = skip, up
        stack.append((tag, skip, up, node, subtree, cause))

    def close():
        nonlocal skipped, level, node, hard
        tag, _, _, own, subtree, cause = stack.pop()
        opened[tag] -= 1
        hard -= cause
        if subtree:
            h = xxhash.xxh64_intdigest("\x1f".join((tag, *parts[own])))
            parts[own].clear()
            hashes[own] = h - (1 << 64) if h >= 1 << 63 else h
            if parents[own] >= 0:
                parts[parents[own]].append(str(h))
        skipped, level, node = (stack[-1][1], stack[-1][2], stack[-1][3]) if stack else (False, 0, -1)

    at = 0
    while at < len(page):
        j = page.find("<", at)
        if j < 0:
            j = len(page)
        if j > at:
            text.append(page[at:j])
        m = _TAG.match(page, j)
        if not m:
            if page.startswith("<!--", j):
                at = page.find("-->", j + 4) + 3
                at = at if at > 2 else len(page)
            elif page[j + 1 : j + 2] in ("!", "?", "/"):
                at = page.find(">", j + 2) + 1 or len(page)
            else:
                text.append(page[j : j + 1])
                at = j + 1
            continue
        tag, end = m[2].lower(), bool(m[1])
        attributes, at, itself = ({}, m.end() + 1, False) if page.startswith(">", m.end()) else _attributes(page, m.end())
        if tag in RAW:
            if not end:
                stop = _END[tag].search(page, at)
                at = stop.end() if stop else len(page)
            if tag in ("textarea", "title"):
                flush()
            continue
        if tag not in BLOCK and tag not in SKIP:
            if end:
                if opened[tag]:
                    flush()
                    while stack[-1][0] != tag:
                        close()
                    close()
            elif tag not in VOID and not itself:
                mark = marked(tag, attributes)
                if mark or opened[tag]:  # only marked inline elements, and those of their kind within, are kept on the stack
                    flush()
                    push(tag, skipped or mark, level, False, mark)
            continue
        flush()
        if end:
            if opened[tag]:
                while stack[-1][0] != tag:
                    close()
                close()
            continue
        if tag in VOID or itself:
            continue
        if stack and stack[-1][0] == "p":
            close()
        if stack and stack[-1][0] in SIBLINGS.get(tag, ()):
            close()
        own = tag in SKIP or (tag == "header" and level == 0) or (tag not in ("body", "html") and marked(tag, attributes))
        skip = own or (skipped and not (tag in ("article", "main") and not hard))
        push(tag, skip, 2 if tag == "article" else max(level, 1) if tag == "main" else level, tag in SUBTREE, own and tag != "form")
    flush()
    while stack:
        close()
    most = max((b[0] for b in blocks), default=0)
    texts: list[list[str]] = []
    nodes: list[int] = []
    for of, s, inner in blocks:
        if of == most:
            if nodes and nodes[-1] == inner:
                texts[-1].append(s)
            else:
                texts.append([s])
                nodes.append(inner)
    used = set()  # only subtrees around a segment can matter
    for inner in nodes:
        while inner >= 0 and inner not in used:
            used.add(inner)
            inner = parents[inner]
    new = {old: k for k, old in enumerate(sorted(used))}
    new[-1] = -1
    return [" ".join(t) for t in texts], [new[i] for i in nodes], [hashes[i] for i in sorted(used)], [new[parents[i]] for i in sorted(used)]


def kept_text(texts: list[str], nodes: list[int], hashes: list[int], parents: list[int], templates: set[int]) -> str:
    """The segments that no template is around, joined."""
    bad: list[bool] = []
    for h, up in zip(hashes, parents):  # parents come first
        bad.append(h in templates or (up >= 0 and bad[up]))
    return " ".join(t for t, i in zip(texts, nodes) if i < 0 or not bad[i])


_PARSED = "page_id long, url string, texts array<string>, nodes array<int>, hashes array<long>, parents array<int>"
_KINDS = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = list(zip(*[parse(x or "") for x in b.column(2).to_pylist()])) or [()] * 4
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, _KINDS))], ["page_id", "url", "texts", "nodes", "hashes", "parents"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(b.column(k).to_pylist() for k in range(2, 7)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([kept_text(t, n, h, p, set(x or ())) for t, n, h, p, x in rows], pa.string())], ["page_id", "url", "text"])


def host(url):
    """Host of a URL column, lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Main text of each page: ``page_id, url, text``, one row an input row.

    ``pages(page_id, url, html)``; other columns are not read. Each page is parsed
    once into segments with the hashes of the element subtrees around them. Spark
    counts the distinct pages of each (host, hash), by a hash of the text that the
    structural rules leave: copies of a page under any URLs are one. A subtree on
    ``min_pages`` of them, whatever the host's size, is a template, and its segments go. Paragraphs,
    headings and list items are never templates, so a passage that many articles
    quote stays. Pages of all URLs without a host count together.

    Null or empty html gives an empty text; null ids and urls and repeated rows
    stay; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "html")
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # the row number is written with the row: a later scan may split the files in another way
    parsed = scratch.table(d.mapInArrow(_parse, _PARSED).withColumn("rid", F.monotonically_increasing_id()), "parsed").withColumn("host", host(F.col("url")))
    page = F.xxhash64(F.array_join("texts", " ")).alias("page")
    seen = parsed.select("host", page, F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("host", "hash").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages)
    templates = scratch.table(seen.select("host", "hash"), "templates")
    held = parsed.select("rid", "host", F.explode(F.array_distinct("hashes")).alias("hash"))
    hit = held.join(templates, ["host", "hash"]).groupBy("rid").agg(F.collect_set("hash").alias("drop"))
    hit = scratch.table(hit, "hit")
    scratch.drop("templates")
    row = parsed.join(hit, "rid", "left")
    return row.select("page_id", "url", "texts", "nodes", "hashes", "parents", "drop").mapInArrow(_keep, "page_id long, url string, text string")


#: DuckDB SQL for ``extract`` over pages of one article each, whose blocks lie in plain tags: the article's markup taken away.
SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article[^>]*>(.*)</article>', 1, 's') h from pages),
b as (select page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') t from a),
c as (select page_id, url, replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') t from b),
e as (select page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) as text from c)
select page_id, url, text, length(text)::bigint as n_chars from e
"""
