"""Markdown and HTML documents."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docslice.functions import text as T
from docslice.operators.kernel import chunk_rows
from docslice.operators.pack import joined

HEADER = re.compile(r"^(#{1,6})[ \t]+(.+)$", re.M)
FRONT = re.compile(r"\A---\s*\n(.*?)\n---\s*\n", re.S)
FENCE = re.compile(r"^(```|~~~)")
ITEM = re.compile(r"^\s*([-*+]|\d+\.)\s+")


def word_packs(text: str, limit: int, overlap: int = 0) -> Iterator[str]:
    """Words joined while the text stays in the limit; a chunk may start with the last `overlap` words."""
    now: list[str] = []
    size = 0
    for w in text.split():
        if now and size + len(w) + 1 > limit:
            yield " ".join(now)
            now = now[-overlap:] if overlap else []
            size = len(" ".join(now))
        size += len(w) + (1 if now else 0)
        now.append(w)
    if now:
        yield " ".join(now)


def by_headers(text: str | None, level: int, shortest: int, longest: int) -> Iterator[tuple]:
    """Content, title and level of what stands under each header; text before the first one is left out."""
    text = FRONT.sub("", text or "", count=1)
    heads = [m for m in HEADER.finditer(text) if len(m[1]) <= level]
    if not heads:
        if text.strip():
            yield text.strip(), None, 0
        return
    for m, after in zip(heads, [*heads[1:], None], strict=True):
        body = text[m.start() : after.start() if after else len(text)].strip()
        if len(body) < shortest:
            continue
        for piece in [body] if len(body) <= longest else word_packs(body, longest):
            yield piece, m[2].strip(), len(m[1])


def markdown_headers(df: DataFrame, level: int = 2, shortest: int = 50, longest: int = 4000, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(by_headers, level=level, shortest=shortest, longest=longest), [text], "title string, level int", key)


def frontmatter(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, raw (what stands between the first two lines of dashes; null without), fields (its `name: value` lines as a
    JSON object, names sorted, quotes taken off), body (the rest)."""
    c = T.filled(F.col(text))
    has = c.rlike(r"\A---\s*\n(?s:.*?)\n---\s*\n")
    raw = F.when(has, F.regexp_extract(c, r"\A---\s*\n((?s:.*?))\n---\s*\n", 1))
    pairs = F.transform(F.filter(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: x.rlike(r"^[\w.-]+:\s*\S")), lambda x: F.struct(F.regexp_extract(x, r"^([\w.-]+):", 1).alias("name"), F.regexp_replace(F.regexp_extract(x, r"^[\w.-]+:\s*(.*?)\s*$", 1), r"^[\"'](.*)[\"']$", "$1").alias("value")))
    # a name that stands twice counts where it stands last
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs) + 1), lambda y: y["name"] == x["name"]))
    fields = F.to_json(F.map_from_entries(F.array_sort(last)))
    return df.select(key, raw.alias("raw"), F.when(has, fields).alias("fields"), F.when(has, F.regexp_replace(c, r"\A---\s*\n(?s:.*?)\n---\s*\n", "")).otherwise(c).alias("body"))


def sections_of(text: str) -> list[str]:
    out: list[list[str]] = []
    for p in (x.strip() for x in text.split("\n\n")):
        if p and (not out or HEADER.match(p)):
            out.append([p])
        elif p:
            out[-1].append(p)
    return ["\n\n".join(x) for x in out]


def _sections(text: str | None, longest: int) -> Iterator[str]:
    return joined(sections_of(FRONT.sub("", text or "", count=1)), "\n\n", longest)


def markdown_sections(df: DataFrame, longest: int = 2000, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(_sections, longest=longest), [text], key=key)


def blocks_of(text: str) -> Iterator[tuple[str, str]]:
    """Kind and text of code, tables, lists, headers and paragraphs, line by line."""
    held: list[str] = []
    kind, fence = "paragraph", None

    def line_kind(line: str) -> str:
        if line.lstrip().startswith("|"):
            return "table"
        if HEADER.match(line):
            return "header"
        return "list" if ITEM.match(line) else "paragraph"

    for line in [*(x.rstrip() for x in text.split("\n")), None]:
        if fence is not None and line is not None:
            held.append(line)
            if line.strip().startswith(fence):
                yield "code", "\n".join(held)
                held, fence, kind = [], None, "paragraph"
            continue
        new = None if line is None or not line else "code" if FENCE.match(line) else line_kind(line)
        if held and (new != kind or new == "header"):
            yield kind if fence is None else "code", "\n".join(held).strip()
            held = []
        if new is None:
            continue
        kind = new
        held.append(line)
        if new == "code":
            fence = line[:3]


def packed_blocks(text: str | None, limit: int, overlap: int) -> Iterator[tuple]:
    """Blocks joined to a size, with the kinds in each chunk; the overlap counts words."""
    now, kinds = "", []
    for kind, block in blocks_of(FRONT.sub("", text or "", count=1)):
        if now and len(now) + len(block) > limit:
            yield now, ",".join(sorted(set(kinds)))
            tail = " ".join(now.split()[-overlap:]) if overlap else ""
            now, kinds = f"{tail}\n\n{block}" if tail else block, [kind]
        else:
            now, kinds = f"{now}\n\n{block}" if now else block, [*kinds, kind]
    if now:
        yield now, ",".join(sorted(set(kinds)))


def markdown_blocks(df: DataFrame, limit: int = 1500, overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(packed_blocks, limit=limit, overlap=overlap), [text], "kinds string", key)


def _words(text: str | None, limit: int, overlap: int) -> Iterator[str]:
    return word_packs(text or "", limit, overlap)


def markdown_fixed(df: DataFrame, limit: int = 1000, overlap: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(_words, limit=limit, overlap=overlap), [text], key=key)


def markdown_structure(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    c = T.filled(F.col(text))
    return df.select(key, *(T.count(c, rf"(?m)^#{{{i}}}[ \t]").alias(f"h{i}") for i in range(1, 4)), T.count(c, r"```[\s\S]*?```").alias("code"), T.count(c, r"(?m)^\|").alias("table_lines"), T.count(c, r"(?m)^[ \t]*[-*+][ \t]").alias("items"), (F.regexp_extract(c, r"\A---\s*\n([\s\S]*?)\n---\s*\n", 1) != "").alias("frontmatter"))


# HTML --------------------------------------------------------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset(("script", "style"))
#: Elements whose own paragraphs do not end one around them.
HOLDERS = frozenset("article aside blockquote body button caption div dd dt figure footer form header html li main nav object section table td th".split())
SEMANTIC = ("article", "section", "nav", "aside", "header", "footer", "main", "h1", "h2", "h3", "h4", "h5", "h6", "p", "div")


@dataclass
class Element:
    tag: str
    attributes: dict
    depth: int
    own: list[str] = field(default_factory=list)
    whole: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return " ".join(" ".join(self.whole).split())

    @property
    def own_text(self) -> str:
        return " ".join(" ".join(self.own).split())


class Elements(HTMLParser):
    """Elements in the order in which they begin."""

    def __init__(self, page: str | None):
        super().__init__(convert_charrefs=True)
        self.found: list[Element] = []
        self.open: list[Element] = []
        self.feed(page or "")
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "p":  # closes the paragraph that is open, with what was left open in it
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag == "p":
                    del self.open[i:]
                    break
                if self.open[i].tag in HOLDERS:
                    break
        e = Element(tag, dict(attrs), len(self.open))
        self.found.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and not any(e.tag in SKIP for e in self.open):
            self.open[-1].own.append(data)
            for e in self.open:
                e.whole.append(data)


def xml_elements(page: str | None) -> list[Element]:
    """Elements of an XML document in the order in which they begin, names without their spaces; none if it is not
    well-formed."""
    try:
        root = ElementTree.fromstring(page or "")
    except (ElementTree.ParseError, ValueError):
        return []
    out: list[Element] = []
    stack = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        own = [node.text or "", *(child.tail or "" for child in node)]
        local = lambda name: name.rpartition("}")[2]
        if isinstance(node.tag, str):
            out.append(Element(local(node.tag), {local(k): v for k, v in node.attrib.items()}, depth, own, list(node.itertext())))
        stack += [(child, depth + 1) for child in reversed(node)]
    return out


def elements(page: str | None, form: str) -> list[Element]:
    return xml_elements(page) if form == "xml" else Elements(page).found


def _tags(page: str | None, tags: tuple[str, ...], shortest: int, form: str = "html") -> Iterator[tuple]:
    for e in elements(page, form):
        if e.tag in tags and len(t := e.text) >= shortest:
            yield t, e.tag


def html_tags(df: DataFrame, tags: tuple[str, ...] = ("p", "h1", "li"), shortest: int = 50, html: str = "html", key: str = "page_id", form: str = "html") -> DataFrame:
    """Text of each element with one of the tags; nested ones repeat text."""
    return chunk_rows(df, partial(_tags, form=form, tags=tags, shortest=shortest), [html], "tag string", key)


def html_semantic(df: DataFrame, shortest: int = 50, html: str = "html", key: str = "page_id", form: str = "html") -> DataFrame:
    return html_tags(df, SEMANTIC, shortest, html, key, form)


def _hierarchy(page: str | None, depth: int, shortest: int, form: str = "html") -> Iterator[tuple]:
    for e in elements(page, form):
        if e.depth <= depth and len(t := e.own_text) >= shortest:
            yield t, e.tag, e.depth


def html_hierarchy(df: DataFrame, depth: int = 6, shortest: int = 20, html: str = "html", key: str = "page_id", form: str = "html") -> DataFrame:
    return chunk_rows(df, partial(_hierarchy, form=form, depth=depth, shortest=shortest), [html], "tag string, depth int", key)


def _grouped(pairs: Iterator[tuple[str, str]], limit: int | None, shortest: int) -> Iterator[tuple]:
    groups: dict[str, list[str]] = {}
    for name, text in pairs:
        groups.setdefault(name, [])
        if text:
            groups[name].append(text)
    for name, texts in groups.items():
        now = ""
        for t in texts:
            now = f"{now}\n\n{t}" if now else t
            if limit and len(now) >= limit:
                yield now, name
                now = ""
        if len(now) >= max(1, shortest):
            yield now, name


def _by_type(page: str | None, limit: int, shortest: int, form: str = "html") -> Iterator[tuple]:
    return _grouped(((e.tag, e.own_text) for e in elements(page, form)), limit, shortest)


def html_by_type(df: DataFrame, limit: int = 2000, shortest: int = 50, html: str = "html", key: str = "page_id", form: str = "html") -> DataFrame:
    return chunk_rows(df, partial(_by_type, form=form, limit=limit, shortest=shortest), [html], "tag string", key)


def _by_attribute(page: str | None, name: str, shortest: int, form: str = "html") -> Iterator[tuple]:
    return _grouped(((e.attributes[name], e.text) for e in elements(page, form) if e.attributes.get(name)), None, shortest)


def html_by_attribute(df: DataFrame, name: str = "class", shortest: int = 1, html: str = "html", key: str = "page_id", form: str = "html") -> DataFrame:
    return chunk_rows(df, partial(_by_attribute, form=form, name=name, shortest=shortest), [html], "value string", key)


def _by_size(page: str | None, limit: int, overlap: int, form: str = "html") -> Iterator[str]:
    now = ""
    for e in elements(page, form):
        t = e.own_text
        if not t:
            continue
        if now and len(now) + len(t) + 1 > limit:
            yield now
            now = f"{now[-overlap:]} {t}" if overlap else t
        else:
            now = f"{now} {t}" if now else t
    if now:
        yield now


def html_by_size(df: DataFrame, limit: int = 1000, overlap: int = 0, html: str = "html", key: str = "page_id", form: str = "html") -> DataFrame:
    return chunk_rows(df, partial(_by_size, form=form, limit=limit, overlap=overlap), [html], key=key)


def html_counts(df: DataFrame, html: str = "html") -> DataFrame:
    """Opening tags by name over all pages."""
    tags = F.regexp_extract_all(T.filled(F.col(html)), F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    return df.select(F.explode(tags).alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def format_of(text: str) -> Column:
    c = T.filled(F.col(text))
    marks = (r"(?m)^#{1,6}[ \t]", r"(?m)^[ \t]*[-*+][ \t]", r"(?m)^[ \t]*\d+\.[ \t]", r"```", r"\[[^\]]+\]\([^)]+\)", r"\*\*[^*]+\*\*", r"(?m)^>[ \t]")
    n = sum((c.rlike(m).cast("int") for m in marks), F.lit(0))
    return F.when(c.rlike(r"(?i)<(html|body|div|p|head)[\s>]"), "html").when(c.rlike(r"^\s*<\?xml|</[A-Za-z][^>]*>"), "xml").when(n >= 2, "markdown").otherwise("plain")


def text_format(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """html, xml, markdown (two of seven marks) or plain."""
    return df.select(key, format_of(text).alias("format"))


PRIORITY = {"header": 1, "code": 1, "table": 1, "section": 1, "list": 2, "paragraph": 3}


def boundaries(text: str, form: str) -> list[tuple[int, int, str]]:
    """Structural spans: elements' places for Markdown blocks, else paragraphs."""
    out, at = [], 0
    if form == "markdown":
        for kind, block in blocks_of(text):
            first = block.split("\n", 1)[0]
            at = max(at, text.find(first, at))
            out.append((at, min(len(text), at + len(block)), kind))
            at += len(block)
        return out
    for m in re.finditer(r"(?:[^\n]|\n(?!\s*\n))+", text):
        if m[0].strip():
            out.append((m.start(), m.end(), "paragraph"))
    return out


def disjoint(spans: list[tuple[int, int, str]], shortest: int = 20, share: float = 0.3) -> list[tuple[int, int, str]]:
    """Spans by priority and place, less those that overlap one taken before by over `share` of the shorter."""
    kept: list[tuple[int, int, str]] = []  # by place; only those that begin before the end and reach the start can overlap
    longest = 0
    for a, z, kind in sorted((s for s in spans if s[1] - s[0] >= shortest), key=lambda s: (PRIORITY.get(s[2], 10), s[0])):
        i = bisect_left(kept, (z,))
        while i and kept[i - 1][0] > a - longest:
            x, y, _ = kept[i - 1]
            if min(z, y) - max(a, x) > share * min(z - a, y - x):
                break
            i -= 1
        else:
            insort(kept, (a, z, kind))
            longest = max(longest, z - a)
    return kept


def boundary_chunks(text: str | None, form: str, target: int, longest: int, shortest: int) -> Iterator[tuple]:
    text, at = text or "", 0
    sentence = re.compile(r"[.!?]+\s+")

    def emit(piece: str, kind: str) -> Iterator[tuple]:
        piece = piece.strip()
        parts = [piece]
        if len(piece) > longest:
            parts = list(joined([s.strip() for s in sentence.split(piece) if s.strip()], ". ", target))
        for p in parts:
            if len(p) >= shortest or kind in ("header", "code", "table") and p:
                yield p, kind

    for a, z, kind in disjoint(boundaries(text, form)):
        if a - at > 50:
            yield from emit(text[at:a], "gap")
        yield from emit(text[max(a, at) : z], kind)
        at = max(at, z)
    if text[at:].strip():
        yield from emit(text[at:], "rest")


def boundary_aware(df: DataFrame, target: int = 1000, longest: int = 2000, shortest: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Format by row, spans, their filter and the chunks between them."""
    return chunk_rows(df.select(key, text, format_of(text).alias("format")), partial(boundary_chunks, target=target, longest=longest, shortest=shortest), [text, "format"], "kind string", key)
