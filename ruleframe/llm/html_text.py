"""Main text of web pages by nearest-URL page differencing.

Pages are cut into block lines. Within a host, pages are put in order of their URL path, and each is paired with the nearest
page on either side. The lines of a pair are aligned by longest common subsequence; lines that both share are the site's, not
the page's, and are deleted. What a page itself marks decides first: navigation, headers, footers, asides, forms, adverts,
notices and comments go even where a page has no partner, and lines in a marked main region stay even where an article is
published twice.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.llm.common import Scratch, in_slices, tidy

# Element names of the HTML standard.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "select", "button")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "mi", "mn", "mo", "mrow", "msub", "msup", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr")
SITE = ("nav", "header", "footer", "aside", "form", "menu", "dialog", "head")
MAIN = ("article", "main")
#: Words of class, id and role that mark what is not the article.
MARKS = ("ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "header", "footer", "masthead", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter", "subscribe", "comment", "comments", "respond", "disqus", "share", "social", "related", "widget", "pagination", "pager", "search", "login", "complementary", "contentinfo")

#: Last words of names such as share-buttons, which are marks by their first word; in other names the last word decides.
CONTAINERS = ("area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "form", "header", "icons", "inner", "item", "items", "link", "links", "list", "message", "outer", "panel", "policy", "row", "section", "slot", "text", "title", "top", "bottom", "left", "right", "unit", "wrap", "wrapper")

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PART = re.compile(r"[^a-z0-9]+")
CLOSES = {x: re.compile(rf"</{x}\s*>", re.I) for x in RAW}
ADDRESS = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://|[?#].*$")
KEY = ["host", "path", "url", "page_id", "hash"]


def is_mark(name: str) -> bool:
    """A class, id or role that marks what is not the article: its last word does, or its first one before a container's name. Words in
    the middle say nothing: a post-share-enabled block may be the post."""
    parts = [x for x in PART.split(name.lower()) if x and not x.isdigit()]
    return bool(parts) and (parts[-1] in MARKS or (len(parts) == 2 and parts[0] in MARKS and parts[1] in CONTAINERS))


def marked(attributes: str) -> bool:
    if HIDDEN.search(attributes):
        return True
    return any(is_mark(name) for m in NAMED.findall(attributes) for name in "".join(m).split())


def tags_in(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of every tag; comments and declarations have no name. Each character is looked at a
    bounded number of times: after one quote that nothing closes, tags end at the next ``>`` whatever is quoted."""
    at, broken = 0, False
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = len(source) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if source.startswith(("<!", "<?"), start):
            end = source.find(">", start)
            at = len(source) if end < 0 else end + 1
            yield start, at, "", False, ""
            continue
        if (m := NAME.match(source, start)) is None:
            at = start + 1
            continue
        end = first = source.find(">", m.end())
        if first < 0:
            return  # no tag ends after this
        quotes, seen = [0, 0], m.end()
        while not broken:
            quotes = [q + source.count(c, seen, end) for q, c in zip(quotes, "\"'", strict=True)]
            if quotes[0] % 2 == 0 and (quotes[1] % 2 == 0 or quotes[0]):
                break
            seen, end = end, source.find(">", end + 1)
            if end < 0:
                broken = True
        end = first if broken else end
        at = end + 1
        yield start, at, m[1].lower(), source[start + 1] == "/", source[m.end() : end]


def page_lines(source: str) -> list[tuple[str, bool]]:
    """The page's block lines outside what it marks as not the article, with whether each lies in a marked main region."""
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    open_tags: list[tuple[str, bool, bool]] = []  # name, drops its content, is a main region
    dropping = main = at = 0
    endless: set[str] = set()
    opened: Counter = Counter()

    def end_line() -> None:
        if text:
            if line := " ".join(html.unescape("".join(text)).split()):
                out.append((line, main > 0))
            text.clear()

    for start, end, name, closing, attributes in tags_in(source):
        if start < at:
            continue  # inside an element whose content is no markup
        if not dropping and start > at:
            text.append(source[at:start])
        at = end
        if not name:
            continue
        if name not in INLINE:
            end_line()
        if closing:
            if opened[name]:
                while open_tags:
                    top, drops, region = open_tags.pop()
                    opened[top] -= 1
                    dropping, main = dropping - drops, main - region
                    if top == name:
                        break
            continue
        if name in RAW:
            close = CLOSES[name].search(source, at) if name not in endless else None
            if close:
                at = close.end()
            else:
                endless.add(name)  # none follows
                if name in ("script", "style", "textarea", "title"):
                    at = len(source)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "p" and opened["p"]:  # a new paragraph ends an open one
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == "p":
                    for top, drops, region in open_tags[k:]:
                        opened[top] -= 1
                        dropping, main = dropping - drops, main - region
                    del open_tags[k:]
                    break
                if open_tags[k][0] not in INLINE:
                    break
        region = name in MAIN and not dropping
        drops = (name in SITE and not (name == "header" and main)) or (name not in ("html", "body", *MAIN) and marked(attributes))
        open_tags.append((name, drops, region))
        opened[name] += 1
        dropping, main = dropping + drops, main + region
    if not dropping and at < len(source):
        text.append(source[at:])
    end_line()
    return out


def subsequence_lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each beginning of ``y``, the length of its longest common subsequence with ``x``."""
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` are in a longest common subsequence with ``b``. Memory is linear: halves of ``a`` are aligned on their own."""
    code = {x: k for k, x in enumerate({*a} & {*b})}
    i = [k for k, x in enumerate(a) if x in code]
    x, y = (np.array([code[v] for v in s if v in code], dtype=np.int64) for s in (a, b))
    keep, todo = [False] * len(a), [(0, len(x), 0, len(y))]
    while todo:
        lo, hi, from_, to = todo.pop()
        if lo == hi or from_ == to:
            continue
        if hi - lo == 1:
            keep[i[lo]] = bool((y[from_:to] == x[lo]).any())
            continue
        middle = (lo + hi) // 2
        cut = int(np.argmax(subsequence_lengths(x[lo:middle], y[from_:to]) + subsequence_lengths(x[middle:hi][::-1], y[from_:to][::-1])[::-1]))
        todo += [(lo, middle, from_, from_ + cut), (middle, hi, from_ + cut, to)]
    return keep


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path."""
    host, slash, path = ADDRESS.sub("", url or "").partition("/")
    return host.lower(), slash + path


def in_order(host: str, path: str, url: str | None, page_id, lines_hash: bytes) -> tuple:
    return host, path, url is not None, url or "", page_id is not None, 0 if page_id is None else page_id, lines_hash


def parsed(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[str], list[bool]]]:
    """``batch(page_id, url, html)`` -> for each page its place in the order, its lines, and whether each is in a main region."""
    for page_id, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        found = page_lines(source or "")
        lines = [x for x, _ in found]
        digest = hashlib.blake2b("\n".join(lines).encode("utf-8", "replace"), digest_size=16).digest()
        yield (*place_of(url), url, page_id, digest), lines, [x for _, x in found]


def places(pages: DataFrame) -> DataFrame:
    """``(host, path, url, page_id, hash)`` of every page; ``hash`` is that of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "html"):
            rows = [key for key, _, _ in parsed(batch)]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), batch.column(1), batch.column(0), pa.array([r[4] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "url", "page_id", "hash"])

    return pages.select("page_id", "url", "html").mapInArrow(tidy(run), f"host string, path string, url string, page_id {dict(pages.dtypes)['page_id']}, hash binary")


def ends_of_ranges(keys: DataFrame, cuts) -> list[tuple[int, list[tuple]]]:
    """For each range its first page, the next of that host with other lines (or None), the same from its end, and whether it
    holds one host only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [bisect_right(cuts.value, in_order(*key)) for key in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    def ends(pdf: pa.Table) -> pa.Table:
        rows = sorted(((*key, k) for k, key in enumerate(zip(*(pdf.column(c).to_pylist() for c in KEY), strict=True))), key=lambda r: in_order(*r[:5]))
        take, whole = [], rows[0][0] == rows[-1][0]
        for side in (rows, rows[::-1]):
            first = side[0]
            other = next((r for r in itertools.takewhile(lambda r: r[0] == first[0], side) if r[4] != first[4]), None)
            take += [first[5], None if other is None else other[5]]
        out = pdf.select(KEY).take(pa.array(take, pa.int64()))
        flags = [pa.array([pdf.column("part")[0].as_py()] * 4, pa.int32()), pa.array(range(4), pa.int32()), pa.array([whole] * 4), pa.array([x is not None for x in take])]
        return pa.table([*flags, *out.columns], names=["part", "which", "whole", "there", *KEY])

    kinds = dict(keys.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in KEY)
    dealt = keys.select(*KEY).mapInArrow(run, f"{schema}, part int")
    found = {}
    for r in dealt.groupBy("part").applyInArrow(ends, f"part int, which int, whole boolean, there boolean, {schema}").collect():  # four rows a range
        found.setdefault(r["part"], [None] * 4 + [r["whole"]])[r["which"]] = (r["host"], r["path"], r["url"], r["page_id"], bytes(r["hash"])) if r["there"] else None
    return sorted(found.items())


def copies_of(ranges: list[tuple[int, list]]) -> dict[tuple, list[int]]:
    """The pages that a range needs from others: on either side the nearest page of its host, and the nearest with other lines
    than that. By (url, page_id, hash), the ranges they are copied to."""
    out: dict[tuple, set[int]] = {}
    for order, (a, a2, z, z2) in ((ranges, (0, 1, 2, 3)), (ranges[::-1], (2, 3, 0, 1))):
        near = other = None
        for part, row in order:
            for page in (near, other):
                if page is not None and page[0] == row[a][0]:
                    out.setdefault(page[2:], set()).add(part)
            if row[z2] is not None or not row[4] or near is None or near[0] != row[z][0]:
                other = row[z2]
            elif near[4] != row[z][4]:
                other = near
            near = row[z]
    return {page: sorted(parts) for page, parts in out.items()}


def difference(pdf: pa.Table) -> pa.Table:
    """The pages of one range and those copied to it -> ``(page_id, url, text)``; a page is compared with the nearest page of its
    host on either side whose lines are not just its own."""
    keys = [tuple(r) for r in zip(*(pdf.column(c).to_pylist() for c in KEY), strict=True)]
    order = sorted(range(len(keys)), key=lambda k: in_order(*keys[k]))
    lines, mains, copied = (pdf.column(c).to_pylist() for c in ("lines", "main", "copied"))
    partners: list[list] = [[None, None] for _ in keys]
    for side, run in enumerate((order, order[::-1])):
        for last, k in itertools.pairwise(run):
            if keys[last][0] == keys[k][0]:
                partners[k][side] = partners[last][side] if keys[last][4] == keys[k][4] else last
    take, texts, known = [], [], {}
    for k in order:
        if copied[k]:
            continue
        own, site = lines[k], [False] * len(lines[k])
        if any(mains[k]):
            site = [not x for x in mains[k]]
        else:
            for other in partners[k]:
                if other is not None:
                    pair = keys[k][4], keys[other][4]
                    if pair not in known:
                        known[pair] = shared_lines(own, lines[other])
                    site = [x or y for x, y in zip(site, known[pair], strict=True)]
        take.append(k)
        texts.append(" ".join(x for x, s in zip(own, site, strict=True) if not s))
    out = pdf.select(["page_id", "url"]).take(pa.array(take, pa.int64()))
    return pa.table([*out.columns, pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, scratch: Scratch, group_pages: int = 256) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Pages in the order of host and path are cut into ranges of about ``group_pages``, whatever their host, so a host of any size is
    spread; the pages next to a range are copied to it, so each page meets its neighbours in path order. A null or empty page
    has an empty text; a page with a null URL belongs to the empty host. A page alone on its host, or on one where all pages have
    just its own lines, loses what it marks itself. Rows that repeat are pages of their own. No rows give no rows; other columns are
    not read.
    """
    spark = pages.sparkSession
    keys = scratch.keep(places(pages), "places")
    cut = keys.filter(F.pmod(F.xxhash64("url", "page_id"), F.lit(group_pages)) == 0).select(*KEY[:4]).distinct().collect()  # a page in ``group_pages``
    cuts = spark.sparkContext.broadcast(sorted(in_order(*r, b"") for r in cut))
    copies = spark.sparkContext.broadcast(copies_of(ends_of_ranges(keys, cuts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "html"):
            rows = []
            for key, lines, main in parsed(batch):
                rows.append((*key, lines, main, bisect_right(cuts.value, in_order(*key)), False))
                rows += [(*key, lines, main, part, True) for part in copies.value.get(key[2:], ())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds(batch))], names=[*KEY, "lines", "main", "part", "copied"])

    def kinds(batch: pa.RecordBatch) -> list[pa.DataType]:
        return [pa.string(), pa.string(), pa.string(), batch.schema.field(0).type, pa.binary(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.int32(), pa.bool_()]

    kind = dict(pages.dtypes)["page_id"]
    dealt = pages.select("page_id", "url", "html").mapInArrow(tidy(run), f"host string, path string, url string, page_id {kind}, hash binary, lines array<string>, main array<boolean>, part int, copied boolean")
    out = dealt.groupBy("part").applyInArrow(difference, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op7(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return main_text(pages, Scratch(spark, "op7"))
