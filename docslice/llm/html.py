"""Main text of web pages: structure first, then differencing with the page of the nearest URL.

A page is cut into blocks (lines of text) by its block elements. Blocks in menus, headers, footers, sidebars, notices,
adverts, forms, comments of readers, scripts and styles go. If the page marks its article (article, main, role main,
articleBody), its text is what is left in there. Pages that mark none are compared to a page of their host: pages are
sorted by host and URL path, each is paired with the neighbour that shares more leading path, the lines of both are
aligned by longest common subsequence, and lines that the pair shares are deleted as the site's frame. Copies are no
pair: pages of equal lines count as one, and neighbours with 0.9 of the lines in common, or that hold all lines of the
page, are passed over, however many there are: the WINDOW pages on either side are looked at first, and where all of them
are copies the search goes on to the ends of the host. A page whose host holds none but such keeps all its lines.

Differencing alone can't give right results: menus here differ from page to page, and copies of an article share all
lines (see the README for figures); so lines inside a marked article are never deleted.

Each page is parsed once, whether or not it marks an article. Pairs are found on hashes of lines (8 bytes each), by a
global sort that no host can overload; only hosts with pages that mark no article take part, and the pages of a part
stream through a window. The search beyond it holds the hashes of a part's pages (of hosts that need it) with the lines
that neighbouring pages, their pairs and so on have in common: if these hold all of a page's lines, or 0.9, all pages
they are common to are shown to be copies at once. Blocks where they don't are searched page by page. Parts that are shown so are skipped, the others are
searched one after another. Lines are aligned in linear memory.

Defined cases: a null or empty html gives an empty text; a null url is a page without neighbours; repeated rows are
pages like others (and count as one in the comparison); tags that are cut off at the end of a page are
dropped; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docslice.runtime import arrow_rows, materialise, table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPACE = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROP = set("nav header footer aside form button select script style noscript template head iframe svg canvas object textarea title dialog menu xmp noembed noframes".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words that mark a class or id as boilerplate.
FRAME = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer disqus footer gdpr header masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promotion related share sharing sidebar sidebars signup skip social sponsor sponsored subscribe toolbar widget widgets reply replies".split()
)
#: Words that may stand beside them in a class or id.
AROUND = set(
    "site page main top bottom left right post posts entry article articles blog global primary secondary mobile desktop bar box button buttons link links list section container wrapper wrap area block slot unit icon icons form panel inner outer item items group row mw wp".split()
)
#: Elements that show nothing of what is in them.
UNSEEN = set("script style noscript template head iframe svg canvas object textarea title select xmp noembed noframes".split())
#: Whole class values that mark an article element as something else than the page's article.
SIDE_ARTICLE = set("comment reply ad ads advert advertisement promo related sponsored".split())
WORDS = re.compile(r"[a-z]+")
#: Fraction of lines in common from which two pages are copies, and pages on each side that are looked at first.
NEAR, WINDOW = 0.9, 8
CLOSES_P = BLOCK - {"option", "head", "html", "body"}


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(text)} if "=" in text else {}


def _named_frame(value: str, in_article: bool) -> bool:
    """Whether a class or id names boilerplate as a whole: words of FRAME, and of AROUND beside them."""
    words = [w for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if len(w) > 1]
    # the head of an article holds its title, whatever element it is
    return any(w in FRAME and not (w == "header" and in_article) for w in words) and all(w in FRAME or w in AROUND for w in words)


def _frame(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element and all in it is no main text: 1, or 2 if not even an article in it is shown."""
    if tag in DROP and not (tag == "header" and in_article):
        return 2 if tag in UNSEEN else 1
    if not attributes or tag in ("body", "html", "main"):
        return 0
    a = _attributes(attributes)
    if tag == "article":
        return int(not SIDE_ARTICLE.isdisjoint(a.get("class", "").lower().split()))
    if a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
        return 2
    return int(a.get("role", "").lower() in ROLES or any(_named_frame(v, in_article) for k in ("class", "id") for v in (a.get(k) or "").split()))


def _main(tag: str, attributes: str) -> bool:
    if tag in ("article", "main"):
        return True
    return bool(attributes) and ("articleBody" in attributes or bool(re.search(r"role\s*=\s*[\"']?main\b", attributes)))


def blocks(page: str) -> tuple[list[str], list[bool]]:
    """Text blocks of a page that are not in a frame element, and whether each is in a marked article. A frame element
    around the only marked articles does not hide them."""
    texts, flags, lost = _blocks(page, False)
    if lost and not any(flags):
        again, marks, _ = _blocks(page, True)
        if any(marks):
            return again, marks
    return texts, flags


def _blocks(page: str, rescue: bool) -> tuple[list[str], list[bool], bool]:
    """Blocks and flags, and whether a marked article lies in a frame element; on demand these are taken out of it."""
    texts: list[str] = []
    flags: list[bool] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # tag, frame, main: of the element or one around it
    drop, main, lost = 0, False, False
    at, n = 0, len(page)

    def cut() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                texts.append(text)
                flags.append(main)
            parts.clear()

    def text(a: int, b: int) -> None:
        if b > a and not drop:
            some = page[a:b]
            parts.append(entities.unescape(some) if "&" in some else some)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if page.startswith("<![CDATA[", m.start()):
                text(m.start() + 9, at - 3)
            continue
        close, attributes, tag = m[1] or m[4], m[3] or m[6] or "", name.lower()
        if close:
            if tag in BLOCK:
                cut()
            elif tag == "br":
                parts.append(" ")
            # an element that was not opened is left out; those left open inside end with it, but for a block's end
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    drop, main = stack[-1][1:] if stack else (0, False)
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK or tag == "hr":
            cut()
            if tag in CLOSES_P and stack:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        drop, main = stack[-1][1:] if stack else (0, False)
                        break
                    if stack[i][0] in BLOCK:
                        break
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
            if end:
                at = page.find(">", end.end()) + 1 or n
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        was = main
        main = main or _main(tag, attributes)
        frame = _frame(tag, attributes, was)
        if drop == 1 and not frame and main and not was:
            lost = True
            drop = 0 if rescue else 1
        drop = max(drop, frame)
        stack.append((tag, drop, main))
    cut()
    return texts, flags, lost


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of a are in a longest common subsequence with b."""
    out = np.zeros(len(a), bool)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    out[:lo] = True
    out[len(a) - hi :] = True
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    at = np.flatnonzero(np.isin(x, y))  # only these can match
    y = y[np.isin(y, x)]
    x = x[at]
    if not len(x):
        return out
    out[lo + at[_subsequence(x, y)]] = True
    return out


#: Cells of a table of lengths that is kept whole.
CELLS = 1 << 20


def _lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of a longest common subsequence of x with each beginning of y, in one row of memory."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def _subsequence(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Positions in x of a longest common subsequence with y. Large tables are halved (Hirschberg): memory is linear."""
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and len(x) * len(y) > CELLS:
        half = len(x) // 2
        j = int((_lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]).argmax())
        return _subsequence(x[:half], y[:j]) + [half + i for i in _subsequence(x[half:], y[j:])]
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x)):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], np.where(y == x[i], best[i, :-1] + 1, 0)))
    i, j, found = len(x), len(y), []
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return found[::-1]


def line_hashes(texts: list[str]) -> list[int]:
    return [xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts]


def leading(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, key, text of each page that marks its article (null for the others), and for the comparison its
    host, path, hashes of all lines, and the lines of pages that mark no article."""
    names = ["page_id", "url", "key", "text", "host", "path", "hashes", "lines"]
    for b in batches:
        made, size, start = [], 0, 0

        def batch(a: int, z: int, made: list, b: pa.RecordBatch = b) -> pa.RecordBatch:
            text, host, path, hashes, lines = zip(*made, strict=True)
            own = [pa.array(text, pa.string()), pa.array(host), pa.array(path), pa.array(hashes, pa.list_(pa.int64())), pa.array(lines, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*(c.slice(a, z - a) for c in b.columns[:3]), *own], names)

        for i, (url, page) in enumerate(zip(b.column(1).to_pylist(), b.column(3), strict=True)):
            page = page.as_py() or ""
            texts, flags = blocks(page)
            marked = any(flags)
            text = "\n\n".join(t for t, f in zip(texts, flags, strict=True) if f) if marked else None if texts else ""
            made.append((text, *_place(url), line_hashes(texts), texts if texts and not marked else None))
            size += len(page)
            if size > 8_000_000:
                yield batch(start, i + 1, made)
                made, size, start = [], 0, i + 1
        if made:
            yield batch(start, b.num_rows, made)


def _place(url: str | None) -> tuple[str, str]:
    """Host and path (with query) of a URL."""
    rest = re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "").partition("#")[0]
    host, slash, path = rest.partition("/")
    return host.lower(), slash + path


def near_copy(same: int, a: int, b: int) -> bool:
    """Whether pages of a and b lines that share `same` of them are copies of each other, or nearly."""
    return same >= NEAR * max(a, b)


def _neighbours(edges: dict) -> object:
    """Texts of rows without the lines shared with the nearest page in the sorted order that is no near copy; edges: the
    rows just outside of each partition. The text is null where the window holds none on a side, and the host may go on."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: deque[dict] = deque(maxlen=WINDOW)
        ahead: deque[dict] = deque()  # the row itself and those after it

        def decide() -> tuple | None:
            row = ahead.popleft()
            sides = (list(reversed(before)), list(ahead)[:WINDOW])
            before.append(row)
            if row["lines"] is None:
                return None
            own, best = np.array(row["hashes"], np.int64), None
            if not row["host"]:
                return row["key"], "\n\n".join(row["lines"])
            for side, way in zip(sides, ("before", "after"), strict=True):
                for x in side:
                    if x["host"] != row["host"]:
                        break
                    other = np.array(x["hashes"], np.int64)
                    same = common(own, other)
                    if not same.all() and not near_copy(same.sum(), len(own), len(other)):
                        far = leading(x["path"], row["path"])
                        if best is None or far > best[0]:
                            best = far, same
                        break
                else:
                    if len(side) == WINDOW or (part, way) in edges:
                        return row["key"], None
            keep = row["lines"] if best is None else [t for t, s in zip(row["lines"], best[1], strict=True) if not s]
            return row["key"], "\n\n".join(keep)

        part, out = None, []

        def made() -> Iterator[pa.RecordBatch]:
            if found := [x for x in out if x]:
                key, text = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(text, pa.string())], ["key", "text"])
            out.clear()

        for b in batches:
            for row in b.to_pylist():
                if part is None:
                    part = row["part"]
                    before.extend(edges.get((part, "before"), []))
                ahead.append(row)
                if len(ahead) > WINDOW:
                    out.append(decide())
            yield from made()
        left = len(ahead)
        if left:
            ahead.extend(edges.get((part, "after"), []))
        out.extend(decide() for _ in range(left))
        yield from made()

    return rows


class Span:
    """Pages of one host in their order, as hashes of lines. Level 0 of the tree over them is the pages; a node holds lines
    that all pages below it have in common, in order, and the size of the longest. Nodes of level `deep` are blocks."""

    deep = 8

    def __init__(self) -> None:
        self.pages: list[np.ndarray] = []
        self.paths: list[str] = []
        self.at: dict[int, int] = {}
        self._nodes: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        self._marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, key: int, path: str, lines: np.ndarray) -> None:
        self.at[key] = len(self.pages)
        self.pages.append(lines)
        self.paths.append(path)

    def width(self, level: int) -> int:
        return -(-len(self.pages) >> level)

    def node(self, level: int, i: int) -> tuple[np.ndarray, int]:
        if not level:
            return self.pages[i], len(self.pages[i])
        if (level, i) not in self._nodes:
            made, size = self.node(level - 1, 2 * i)
            if 2 * i + 1 < self.width(level - 1):
                other, longest = self.node(level - 1, 2 * i + 1)
                made, size = made[common(made, other)], max(size, longest)
            self._nodes[level, i] = made, size
        return self._nodes[level, i]

    def whole(self) -> tuple[np.ndarray, int]:
        return self.node((len(self.pages) - 1).bit_length(), 0)

    def nearest(self, own: np.ndarray, i: int, step: int) -> int | None:
        """The first page from i on, in steps of 1 or -1, that is no copy of a page of `own` lines."""
        if not 0 <= i < len(self.pages):
            return None
        at = self._in_block(own, i, step)
        level, i = self.deep, (i >> self.deep) + step
        while at is None and 0 <= i < self.width(level):
            shown = passed_over(own, len(own), *self.node(level, i))
            if not shown and level > self.deep:
                level -= 1
                i = 2 * i if step > 0 else min(2 * i + 1, self.width(level) - 1)
                continue
            if not shown:
                at = self._in_block(own, i << level if step > 0 else min((i + 1) << level, len(self.pages)) - 1, step)
            i += step
            # the node above holds none but pages ahead
            while 0 <= i < self.width(level) and self.width(level) > 1 and i % 2 == (step < 0):
                i, level = i // 2, level + 1
        return at

    def _in_block(self, own: np.ndarray, i: int, step: int) -> int | None:
        """As nearest, up to the end of the block of page i. What both pages share with the block's first page at the same
        lines they share with each other; where that does not show that they are copies, they are aligned."""
        k, first = i >> self.deep, i >> self.deep << self.deep
        if k not in self._marks:
            some = self.pages[first : first + (1 << self.deep)]
            self._marks[k] = np.array([common(some[0], x) for x in some]), np.array([len(x) for x in some])
        marks, sizes = self._marks[k]
        same = (marks & common(self.pages[first], own)).sum(1)
        left = first + np.flatnonzero((same < len(own)) & (same < NEAR * np.maximum(sizes, len(own))))
        for j in (left[left >= i] if step > 0 else left[left <= i][::-1]).tolist():
            if not passed_over(own, len(own), self.pages[j], len(self.pages[j])):
                return j
        return None


def passed_over(a: np.ndarray, longest_a: int, b: np.ndarray, longest_b: int) -> bool:
    """Whether lines a, common to some pages (the longest of longest_a lines), and b, common to others, show that each of
    these is passed over for each of those. Of two pages themselves: whether it is."""
    same = int(common(a, b).sum())
    return same >= longest_a or near_copy(same, longest_a, longest_b)


FOUND = "kind string, key long, host string, path string, hashes array<long>, side int, origin int, far int, same array<boolean>, size int"


def _walk(firsts: dict, lasts: dict) -> object:
    """Of the pages of a part that ask (first step), or queries from other parts (side, origin): the nearest page of their
    host on the side that is no copy (found), or that there is none up to the end of the part and the host may go on (on);
    lines that all of the latter have in common, and all pages of a part of one host (core, all)."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = dict(zip(names, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.bool_()), pa.int32()), strict=True))
    schema = pa.schema(list(kinds.items()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: dict[str, Span] = {}
        asking: list[tuple[str, int]] = []
        cores: dict[int, tuple[np.ndarray, int]] = {}
        part = None
        out: list[dict] = []

        def search(key: int, host: str, path: str, own: np.ndarray, i: int, side: int, origin: int) -> None:
            span = spans[host]
            at = span.nearest(own, i, side)
            if at is not None:
                out.append({"kind": "found", "key": key, "side": side, "far": leading(span.paths[at], path), "same": common(own, span.pages[at]).tolist()})
            elif host == (lasts if side > 0 else firsts)[part]:
                out.append({"kind": "on", "key": key, "host": host, "path": path, "hashes": own.tolist(), "side": side, "origin": origin})
                if origin == part:
                    lines, size = cores.get(side, (own, 0))
                    cores[side] = lines[common(lines, own)], max(size, len(own))

        def made(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least:
                yield pa.RecordBatch.from_pylist(out, schema)
                out.clear()

        for b in batches:
            for r in b.to_pylist():
                part, host, own = r["part"], r["host"], np.array(r["hashes"], np.int64)
                if r["side"]:
                    search(r["key"], host, r["path"], own, 0 if r["side"] > 0 else len(spans[host].pages) - 1, r["side"], r["origin"])
                    yield from made(1000)
                    continue
                spans.setdefault(host, Span()).add(r["key"], r["path"], own)
                if r["asks"]:
                    asking.append((host, r["key"]))
        for host, key in asking:
            i = spans[host].at[key]
            for side in (-1, 1):
                search(key, host, spans[host].paths[i], spans[host].pages[i], i + side, side, part)
            yield from made(1000)
        for side, (lines, size) in cores.items():
            out.append({"kind": "core", "hashes": lines.tolist(), "side": side, "origin": part, "size": size})
        if cores and firsts[part] == lasts[part]:
            lines, size = spans[firsts[part]].whole()
            out.append({"kind": "all", "hashes": lines.tolist(), "origin": part, "size": size})
        yield from made(1)

    return rows


def _beyond(ordered: DataFrame, asking: DataFrame, firsts: dict, lasts: dict) -> DataFrame:
    """key, text of the pages that ask: as _neighbours decides, over all pages of the host. firsts, lasts: the host of the
    first and the last page of each part."""
    spark, parts = ordered.sparkSession, sorted(firsts)
    order = ["part", "side", "host", "path", "key"]
    asks = ordered.join(asking, "key", "left_semi")
    pages = ordered.select("part", "host", "path", "key", "hashes").join(asks.select("host").distinct(), "host", "left_semi")
    pages = pages.join(asking.withColumn("asks", F.lit(True)), "key", "left").select(*("part host path key hashes".split()), F.coalesce("asks", F.lit(False)).alias("asks"), F.lit(0).alias("side"), F.lit(-1).alias("origin"))
    pages = materialise(pages, "html-beyond")
    place = {x: i for i, x in enumerate(parts)}
    todo, steps, cores, whole, now = pages, [], {}, {}, {}
    while True:
        # pages of a part come before what is asked of them
        dealt = todo.withColumn("query", F.col("side") != 0).repartition(len(parts), "part").sortWithinPartitions("part", "query", *order[1:]).drop("query")
        step = materialise(arrow_rows(dealt, _by_part(_walk(firsts, lasts)), FOUND), "html-walk")
        steps.append(step)
        if len(steps) == 1:
            for r in step.filter("kind in ('core', 'all')").collect():
                lines = np.array(r["hashes"], np.int64), r["size"]
                if r["kind"] == "all":
                    whole[r["origin"]] = lines
                else:
                    cores[r["origin"], r["side"]] = lines
            now = {x: place[x[0]] for x in cores}
        else:
            now = {tuple(r): now[tuple(r)] for r in step.filter("kind = 'on'").select("origin", "side").distinct().collect()}
        for x in list(now):
            origin, side = x
            host, i = (lasts if side > 0 else firsts)[origin], now[x] + side
            while 0 <= i < len(parts) and firsts[parts[i]] == lasts[parts[i]] == host and parts[i] in whole and passed_over(*cores[x], *whole[parts[i]]):
                i += side
            now[x] = i
            if not 0 <= i < len(parts) or (firsts if side > 0 else lasts)[parts[i]] != host:
                del now[x]
        if not now:
            break
        goals = spark.createDataFrame([(*x, parts[i]) for x, i in now.items()], "origin int, side int, part int")
        queries = step.filter("kind = 'on'").join(F.broadcast(goals), ["origin", "side"])
        held = pages.join(F.broadcast(goals.select("part").distinct()), "part", "left_semi").withColumn("asks", F.lit(False))
        todo = held.unionByName(queries.select("part", "host", "path", "key", "hashes", F.lit(False).alias("asks"), "side", "origin"))
    found = functools.reduce(DataFrame.unionAll, [x.filter("kind = 'found'").select("key", "side", "far", "same") for x in steps])
    # of two as near, that before
    best = found.groupBy("key").agg(F.max_by("same", F.struct("far", -F.col("side"))).alias("same"))
    kept = F.filter("lines", lambda x, i: F.col("same").isNull() | ~F.get("same", i))
    return materialise(asks.select("key", "lines").join(best, "key", "left").select("key", F.array_join(kept, "\n\n").alias("text")), "html-texts")


def difference(every: DataFrame) -> DataFrame:
    """key, text of the pages (key, host, path, hashes, lines; lines are null where a page marks its article) that mark
    no article: their lines less those shared with the page of the nearest URL of their host that is no near copy."""
    spark = every.sparkSession
    copies = ["host", "print", "marked"]
    every = every.withColumns({"print": F.xxhash64("hashes"), "marked": F.col("lines").isNull()})
    # only hosts with such pages have anything to compare
    every = every.join(every.filter(~F.col("marked")).select("host").distinct(), "host", "left_semi")
    order = ["host", "path", "key"]
    # pages of equal lines are one page, at the first of their URLs
    heads = every.groupBy(*copies).agg(F.min_by(F.struct("path", "key", "hashes", "lines"), F.struct("path", "key")).alias("head")).select(*copies, "head.*")
    ordered = materialise(heads.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()), "html-lines")
    # the last rows of a part come before the first of the next
    ends = []
    for way in ("asc", "desc"):
        rank = F.row_number().over(Window.partitionBy("part").orderBy(*(getattr(F.col(c), way)() for c in order)))
        ends.append(ordered.select("part", *order).withColumn("rank", rank).filter(F.col("rank") <= WINDOW).join(ordered.select("key", "hashes"), "key").orderBy("part", "rank").collect())
    parts = sorted({r["part"] for r in ends[0]})
    edges: dict = {}
    for x, y in zip(parts, parts[1:], strict=False):
        edges[x, "after"] = [r.asDict() for r in ends[0] if r["part"] == y]
        edges[y, "before"] = [r.asDict() for r in reversed(ends[1]) if r["part"] == x]
    own = ordered.repartition(max(1, len(parts)), "part").sortWithinPartitions("part", *order)
    texts = materialise(arrow_rows(own, _by_part(_neighbours(edges)), "key long, text string"), "html-texts")
    left = texts.filter(F.col("text").isNull()).select("key")
    if not left.isEmpty():
        outer = [{r["part"]: r["host"] for r in x if r["rank"] == 1} for x in ends]
        texts = texts.filter(F.col("text").isNotNull()).unionAll(_beyond(ordered, left, *outer))
    named = ordered.filter(F.col("lines").isNotNull()).select(*copies, "key").join(texts, "key").drop("key")
    return every.filter(F.col("lines").isNotNull()).select("key", *copies).distinct().join(named, copies).select("key", "text")


def _by_part(each: object) -> object:
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            part = b.column(b.schema.get_field_index("part")).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z > a:
                    yield int(part[a]), b.slice(a, z - a)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts follow one another in a task; each begins anew, and only what `each` holds of it is held."""
        for _, own in itertools.groupby(slices(batches), key=lambda x: x[0]):
            yield from each(b for _, b in own)

    return rows


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    kind = own.schema["page_id"].dataType.simpleString()
    keyed = own.select("page_id", "url", F.xxhash64("page_id", "url", "html").alias("key"), "html")
    parsed = materialise(arrow_rows(keyed, _parsed, f"page_id {kind}, url string, key long, text string, host string, path string, hashes array<long>, lines array<string>"), "html-pages")
    size = F.length("text").cast("long").alias("n_chars")
    done, rest = parsed.filter(F.col("text").isNotNull()), parsed.filter(F.col("text").isNull())
    if rest.isEmpty():
        return done.select("page_id", "url", "text", size)
    texts = difference(parsed.select("key", "host", "path", "hashes", "lines")).groupBy("key").agg(F.max("text").alias("text"))
    rest = rest.select("page_id", "url", "key").join(texts, "key").select("page_id", "url", "text")
    return done.select("page_id", "url", "text").unionByName(rest).select("page_id", "url", "text", size)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
