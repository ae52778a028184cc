"""Kernels against slow versions of their rules, and edge cases."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docslice.operators import adapt, cdc, chunkops, closed, code, discourse, kernel, markup, pack, semantic, structured, vectors
from docslice.plans import catalog
from docslice.streaming import chunks as streams

EDGES = ["", " ", "\n\n", "a", "Ü" * 50, "One. Two! Three?", "no stop at all", "x" * 5000, "a\r\nb\r\n\r\nc", "😀 e\u0301 漢字。", "...", None]


def slow_fastcdc(data, least, avg, most, bits):
    table, out, start, n = [int(x) for x in cdc.gear_table("crc")], [], 0, len(data)
    while start < n:
        first, top = min(start + least, n), min(start + most, n)
        if first >= n:
            return [*out, n]
        h = 0
        for b in data[start:first]:
            h = (h << 1) + table[b] & 0xFFFFFFFF
        p, end, second = first, None, None
        while p < min(start + 2 * avg, top):
            if not h & (1 << bits) - 1:
                end = p
                break
            if p >= start + avg and second is None and not h & (1 << (bits - 1)) - 1:
                second = p
            h = (h << 1) + table[data[p]] & 0xFFFFFFFF
            p += 1
        end = end or second or top
        out.append(end)
        start = end
    return out


def slow_window(data, least, most, window, start_value, step, hit):
    out, start, n = [], 0, len(data)
    while start < n:
        end = min(start + most, n)
        for p in range(start + least - 1, end):
            h = start_value
            for b in data[max(start, p - window + 1) : p + 1]:
                h = step(h, b)
            if hit(h):
                end = p + 1
                break
        out.append(end)
        start = end
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 40, 300, 5000, 20000])
def test_cdc_rules(n):
    r = random.Random(n)
    data = bytes(r.choice(b"abcdef \n\xc3\xa9z") for _ in range(n))
    assert list(cdc.fastcdc(data, 64, 256, 1024, 8)) == slow_fastcdc(data, 64, 256, 1024, 8)
    m = 10**9 + 7
    assert list(cdc.rolling_polynomial(data, 64, 128, 8192, 1024)) == slow_window(data, 128, 1024, 64, 0, lambda h, b: (h * 256 + b) % m, lambda h: h % 128 == 0)
    table = [int(x) for x in cdc.gear_table("gear")]
    assert list(cdc.gear_cdc(data, 32, least=128, most=1024)) == slow_window(data, 128, 1024, 32, 0, lambda h, b: h ^ table[b], lambda h: 32 - (h & (1 << 22) - 1).bit_length() >= 13)


def slow_state(data, step, cut, least, most, window):
    """Byte by byte; the state starts anew after each cut."""
    out, start, n = [], 0, len(data)
    while start < n:
        h, end = 0, min(start + most, n)
        for p in range(start, end):
            h = step(h, data[p], data[p - window] if p - start >= window else None)
            if p - start + 1 >= least and cut(h, p - start + 1):
                end = p + 1
                break
        out.append(end)
        start = end
    return out


def slow_polynomial_step(window):
    power = 1
    for _ in range(window - 1):
        power = power * 256 % cdc.M53
        if power >= cdc.TOP:
            power = (power ^ cdc.POLY) & cdc.M53

    def step(h, b, out):
        h = (h - (out * power if out is not None else 0)) % cdc.M53
        h = (h * 256 + b) % cdc.M53
        return (h ^ cdc.POLY) & cdc.M53 if h >= cdc.TOP else h

    return step


def slow_rabin_step(window):
    degree = cdc.POLY.bit_length() - 1
    full, table = (1 << degree) - 1, []
    for i in range(256):
        v = i << (degree - 8)
        for _ in range(8):
            v = (v << 1 ^ cdc.POLY if v >> (degree - 1) & 1 else v << 1) & full
        table.append(v)
    return lambda h, b, out: ((h ^ (table[out] << (window - 1) * 8 % degree & full if out is not None else 0)) << 8 ^ b) & full


def slow_turn(v, by):
    by %= 32
    return (v << by | v >> (32 - by)) & 0xFFFFFFFF if by else v


def slow_buzhash_step(window):
    table = cdc.gear_table("draw").tolist()
    return lambda h, b, out: slow_turn(h ^ (slow_turn(table[out], window) if out is not None else 0), 1) ^ table[b]


def slow_fastcdc_rolling(data, kind, least, avg, most, bits):
    out, start, n = [], 0, len(data)
    while start < n:
        if start + least >= n:
            return [*out, n]
        top = min(start + most, n)
        h, end, second = 0, None, None
        for p in range(start, min(start + 2 * avg, top)):
            if p >= start + least:
                if h % (1 << bits) == 0:
                    end = p
                    break
                if second is None and p >= start + avg and h % (1 << bits - 1) == 0:
                    second = p
            h = (h * 256 + data[p]) % cdc.POLY if kind == "rabin" else slow_turn(h, 1) ^ data[p] * 0x9E3779B9 & 0xFFFFFFFF
        out.append(end or second or top)
        start = out[-1]
    return out


def slow_sum_rule(data, target, least, most):
    out, start, n = [], 0, len(data)
    window = min(32, (most - least) // 4)
    while start < n:
        if start + least >= n:
            return [*out, n]
        last = min(start + most, n)
        first = max(start + least, start + target - target // 2)
        end = next((p for p in range(first, last - window + 1) if sum(data[p : p + window]) % 256 == target % 256), None)
        if end is None:
            back = min(100, last - start - least)
            space = next((p for p in range(last, last - back, -1) if p < n and data[p : p + 1] == b" "), -1)
            end = space if space > start else last
        out.append(end)
        start = end
    return out


def slow_sha1_rule(data, least, most, mask, window):
    out, start, n = [], 0, len(data)
    while start < n:
        end = min(start + most, n)
        for p in range(start + least - 1, end):
            if int(hashlib.sha1(data[p + 1 - window : p + 1]).hexdigest()[:8], 16) & mask == 0:
                end = p + 1
                break
        out.append(end)
        start = end
    return out


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 2**32), n=st.sampled_from([0, 1, 47, 48, 49, 64, 65, 300, 3000, 20000]), letters=st.sampled_from([1, 3, 40, 256]), least=st.integers(80, 300), window=st.sampled_from([16, 48, 64]))
def test_every_cdc_rule_byte_by_byte(seed, n, letters, least, window):
    r = random.Random(seed)
    data, most = bytes(r.randrange(letters) for _ in range(n)), least + 700
    step = slow_polynomial_step(window)
    assert list(cdc.rabin(data, window, 127, least, most)) == slow_state(data, step, lambda h, _: h & 127 == 0, least, most, window)
    assert list(cdc.rabin(data, window, 31, 9, most)) == slow_state(data, step, lambda h, _: h & 31 == 0, 9, most, window)
    assert list(cdc.tttd(data, window, 64, 256, least, 600, most)) == slow_state(data, step, lambda h, k: h % 256 == 0 or (h % 64 == 0 and k >= 300), least, most, window)
    assert list(cdc.tttd(data, window, 60, 250, least, 600, most, (3, 7))) == slow_state(data, step, lambda h, k: h % 250 == 7 or (h % 60 == 3 and k >= 300), least, most, window)
    step = slow_rabin_step(window)
    assert list(cdc.rolling_rabin(data, window, least, 1 << 13, most)) == slow_state(data, step, lambda h, _: h % 128 == 0, least, most, window)
    step = slow_buzhash_step(window)
    assert list(cdc.buzhash(data, window, 127, least, most)) == slow_state(data, step, lambda h, _: h & 127 == 0, least, most, window)
    assert list(cdc.buzhash(data, window, 0, 5, most, every=37)) == slow_state(data, step, lambda h, _: h % 37 == 0, 5, most, window)
    for kind in ("rabin", "buzhash"):
        assert list(cdc.fastcdc_rolling(data, kind, least, 400, most, 7)) == slow_fastcdc_rolling(data, kind, least, 400, most, 7)
    assert list(cdc.universal_rolling(data, 512, least, most)) == slow_sum_rule(data, 512, least, most)


@pytest.mark.parametrize("level", sorted(cdc.LEVELS))
def test_every_level_byte_by_byte(level):
    least, most, mask, kind = cdc.LEVELS[level]
    r = random.Random(level)
    data = bytes(r.randrange(256) for _ in range(min(3 * least + 5000, 300_000)))
    if kind == "polynomial":
        m = 10**9 + 7
        want = slow_window(data, least, most, 48, 0, lambda h, b: (h * 256 + b) % m, lambda h: h & mask == 0)
    else:
        want = slow_sha1_rule(data, least, most, mask, 48)
    assert list(cdc.ml_cdc(data, level)) == want and len(want) > 1
    assert list(cdc.ml_cdc(data)) == list(cdc.ml_cdc(data, cdc.level_for(len(data))))


@pytest.mark.parametrize("rule", [cdc.fastcdc, cdc.fastcdc_rolling, cdc.rolling_polynomial, cdc.rolling_rabin, cdc.buzhash, cdc.rabin, cdc.tttd, cdc.gear_cdc, cdc.ml_cdc, cdc.universal_rolling])
@settings(max_examples=15, deadline=None)
@given(data=st.binary(max_size=9000))
def test_cdc_covers_the_bytes(rule, data):
    ends = list(rule(data))
    assert ends == sorted(set(ends)) and (not data or ends[-1] == len(data))


@settings(max_examples=60, deadline=None)
@given(units=st.lists(st.text("ab .", min_size=1, max_size=30), max_size=20), most=st.integers(1, 6), chars=st.integers(1, 60), overlap=st.integers(0, 5))
def test_greedy_packs_end_and_keep_all_units(units, most, chars, overlap):
    got = list(pack.greedy(units, "|", most, chars, 1, overlap))
    assert len(got) <= max(1, len(units))
    if not overlap:
        assert [x for g in got for x in g.split("|")] == units


def test_edges_do_not_fail(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), "doc_id long, text string")
    for name in catalog.STRATEGIES:
        if name == "json":
            continue
        rows = catalog.chunk(df, name).collect()
        assert all(r["content"] is not None for r in rows), name
        assert catalog.chunk(df.limit(0), name).count() == 0


def test_fixed_size(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "aé" * 3)], "doc_id long, text string")
    got = [r["content"] for r in closed.fixed_size(df.filter("doc_id = 1"), 4, 1).orderBy("chunk_index").collect()]
    assert got == ["abcd", "defgh", "hij"]
    with pytest.raises(ValueError):
        closed.fixed_size(df, 4, 4)


def test_same_chunks_however_the_rows_are_dealt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for f in (lambda d: pack.sentence_based(d), lambda d: cdc.content_defined(d, cdc.fastcdc), lambda d: chunkops.merge_short(closed.fixed_size(d, 100), 50, 300)):
        assert sorted(map(tuple, f(docs.repartition(1)).collect())) == sorted(map(tuple, f(docs.repartition(7)).collect()))


def test_code_elements():
    found = code.python_elements("import os\n@d\nasync def f():\n    pass\nclass C:\n    def m(self): pass\n")
    assert [(k, n) for k, n, *_ in found] == [("import", "os"), ("function", "f"), ("class", "C"), ("method", "m")]
    assert code.python_elements("def (") is None
    js = code.brace_elements("function f(x) {\n  if (x) { return '}'; }\n}\n", "javascript")
    assert [(k, n, a, z) for k, n, a, z in js] == [("function", "f", 1, 3)]
    assert code.specificity("#a .b c:hover") == (1, 2, 1)
    assert [k for k, *_ in code.css_elements("@import 'x';\na { b: c }\n@media p { q { r: s } }\n@mixin m { t: u }")] == ["at_rule", "rule", "media_query", "mixin"]


def test_json_and_csv():
    assert structured.shallow({"a": {"b": {"c": 1}}}, 2) == {"a": {"b": "<truncated_dict_depth_2>"}}
    assert [x[1:] for x in structured.array_blocks('{"a": [1,2,3], "b": {"c": [4]}}', 2)] == [("a", 0), ("a", 2), ("b.c", 0)]
    assert [r[1] for r in structured.rows_of('a,b\r\n"x,1",2\r\n\r\n')] == [["a", "b"], ["x,1", "2"]]
    assert list(structured.by_bytes(["aa", "é", "b"], 3, ",", "")) == ["aa", "é,b"]


def test_markdown_and_html():
    assert [k for k, _ in markup.blocks_of("# H\ntext\n- a\n```\nx\n```\n| t |")] == ["header", "paragraph", "list", "code", "table"]
    assert [e.tag for e in markup.Elements("<div><p>a<p>b<br>c</div>").found] == ["div", "p", "p", "br"]
    assert markup.disjoint([(0, 100, "paragraph"), (10, 60, "header"), (200, 300, "list")]) == [(10, 60, "header"), (200, 300, "list")]


def test_duplicates_and_overlap():
    assert list(chunkops.distinct_units(["a b c d e", "a b c d e f", "x", "A B C D E"], 0.8)) == ["a b c d e", "x"]
    assert chunkops.longest_common("xxabcdyy", "zabcdz") == 4


@settings(max_examples=60, deadline=None)
@given(units=st.lists(st.text("ab ", max_size=40), max_size=6))
def test_overlap_of_all_pairs(units):
    def common(a, b):
        return max((k for i in range(len(a)) for k in range(1, len(a) - i + 1) if a[i : i + k] in b), default=0)

    shared = sum(n for i, a in enumerate(units) for b in units[i + 1 :] if (n := common(a, b)) > 10)
    total = sum(map(len, units))
    [(_, got)] = chunkops._overlap(units)
    assert got == pytest.approx(min(1.0, (shared / total if total else 0) / 0.2))


@settings(max_examples=200, deadline=None)
@given(spans=st.lists(st.tuples(st.integers(0, 300), st.integers(1, 120), st.sampled_from(["header", "list", "paragraph", "other"])), max_size=25))
def test_disjoint_spans_of_all_pairs(spans):
    spans = [(a, a + n, kind) for a, n, kind in spans]
    kept = []
    for a, z, kind in sorted((s for s in spans if s[1] - s[0] >= 20), key=lambda s: (markup.PRIORITY.get(s[2], 10), s[0])):
        if not any(min(z, y) - max(a, x) > 0.3 * min(z - a, y - x) for x, y, _ in kept):
            kept.append((a, z, kind))
    assert markup.disjoint(spans) == sorted(kept)


def test_top_k_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.normal(size=(60, 5))
    frame = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "BLOCK", 7)
    got = {(x["query_id"], x["rank"]): x["vec_id"] for x in vectors.top_k(frame.filter("vec_id % 3 = 0"), frame, 4).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for q in range(0, 60, 3):
        order = [int(i) for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:4]
        want |= {(q, k + 1): i for k, i in enumerate(order)}
    assert got == want


def test_byte_pieces(spark):
    """A piece is its longest beginning that is whole characters."""
    text = "aé漢😀" * 40
    got = [r["content"] for r in closed.fixed_size(spark.createDataFrame([(1, text)], "doc_id long, text string"), 7, 2, unit="byte").orderBy("chunk_index").collect()]
    data = text.encode()

    def longest(piece):
        for n in range(len(piece), 0, -1):
            try:
                return piece[:n].decode()
            except UnicodeDecodeError:
                pass
        return ""

    assert got == [longest(data[max(0, p - 2) : p + 7]) for p in range(0, len(data), 7)]


@settings(max_examples=80, deadline=None)
@given(units=st.lists(st.lists(st.sampled_from("abcdefg"), max_size=9).map(" ".join), max_size=12), threshold=st.sampled_from([0.5, 0.8, 1.0]))
def test_similar_units_of_all_pairs(units, threshold):
    kept = []
    for u in units:
        s = set(u.split())
        if not any(s and t and len(s & t) >= threshold * len(s | t) for _, t in kept):
            kept.append((u, s))
    assert list(chunkops.distinct_units(units, threshold)) == [u for u, _ in kept]


def slow_ward(x, k):
    groups = [[i] for i in range(len(x))]
    grow = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
    while len(groups) > k:
        _, i, j = min((grow(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


def slow_density(x, eps, least):
    near = [[j for j in range(len(x)) if ((x[i] - x[j]) ** 2).sum() <= eps * eps] for i in range(len(x))]
    label, group = [-1] * len(x), 0
    for i in range(len(x)):
        if label[i] < 0 and len(near[i]) >= least:
            queue = [i]
            label[i] = group
            while queue:
                for j in near[queue.pop(0)]:
                    if label[j] < 0:
                        label[j] = group
                        if len(near[j]) >= least:
                            queue.append(j)
            group += 1
    return label


@pytest.mark.parametrize("seed", range(6))
def test_clusters_by_slow_rules(seed):
    x = np.random.default_rng(seed).normal(size=(40, 3))
    for k in (2, 5, 8):
        label = semantic._ward(x, k)
        assert {frozenset(i for i in range(40) if label[i] == g) for g in set(label)} == slow_ward(x, k)
    for eps in (0.3, 0.6, 1.0):
        assert semantic._dbscan(x, eps, 3) == slow_density(x, eps, 3)


def test_clusters():
    v = [[0.0, 0], [0, 0.1], [5, 5], [5, 5.1], [9, 0], [9, 0.1]]
    for method in ("kmeans", "ward"):
        label = semantic.cluster_labels(v, method, 2)
        assert label[0] == label[1] and label[2] == label[3] and label[1] != label[2]
    assert semantic.cluster_labels([[0.0], [0.1], [9.0]], "dbscan", 2)[2] == -1


def test_adaptation():
    assert adapt.fixed_size({"size": 1000}, 0.2, "quality") == {"size": 1200}
    assert adapt.fastcdc({"avg": 30000, "bits": 13}, 0.2, "dedup")["avg"] == 32768
    assert adapt.sentence_based({"max_sentences": 5, "min_sentences": 5, "max_chars": 600}, 0.2, "quality")["max_sentences"] == 5
    assert adapt.word_windows({"words_per_chunk": 10, "overlap": 9}, 0.2, "quality") == {"words_per_chunk": 8, "overlap": 7}


@settings(max_examples=40, deadline=None)
@given(text=st.text("ab. \n", max_size=200), cuts=st.lists(st.integers(0, 200), max_size=6), size=st.integers(1, 20))
def test_stream_cutters_agree_with_the_whole_text(text, cuts, size):
    places = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    for cutter in (streams.fixed(size), streams.words(size), streams.sentences(size), streams.paragraphs()):
        rest, out = "", []
        for a, z in zip(places, places[1:], strict=False):
            made, rest = cutter(rest + text[a:z], False)
            out += made
        made, _ = cutter(rest, True)
        whole, tail = cutter(text, True)
        assert "".join("".join((out + made)).split()) == "".join("".join(whole).split()) and not tail


def test_catalogue():
    with pytest.raises(ValueError):
        catalog.register("fixed_size", closed.fixed_size)
    catalog.register("own", closed.fixed_size)
    assert "own" in catalog.STRATEGIES
    catalog.unregister("own")
    assert "own" not in catalog.STRATEGIES


@settings(max_examples=60, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_balanced_runs(sizes):
    from itertools import combinations

    from docslice.operators import plugins

    cost = lambda ends: sum(abs(sum(sizes[a:z]) - 50) for a, z in zip([0, *ends], ends))
    fits = lambda ends: all(20 <= sum(sizes[a:z]) <= 80 for a, z in zip([0, *ends], ends))
    every = [[*c, len(sizes)] for k in range(len(sizes)) for c in combinations(range(1, len(sizes)), k)]
    least = min((cost(e) for e in every if fits(e)), default=None)
    got = plugins.nearest(sizes, 50, 20, 80)
    assert (got is None) == (least is None) and (got is None or (fits(got) and cost(got) == least))
    ends = plugins.greedy(sizes, 35, 20, 80)
    assert ends[-1] == len(sizes) and ends == sorted(set(ends))


def test_office_formats():
    import io
    import zipfile

    from docslice.operators import office

    def packed(name, xml):
        with zipfile.ZipFile(to := io.BytesIO(), "w") as z:
            z.writestr(name, xml)
        return to.getvalue()

    docx = packed("word/document.xml", "<w:document xmlns:w='w'><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>One </w:t></w:r><w:r><w:t>two.</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>long</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    assert office.blocks_of(docx) == [("heading", 1, "Top"), ("paragraph", 0, "One two."), ("table", 0, "a   | long")]
    odt = packed("content.xml", "<o:d xmlns:o='o' xmlns:t='t'><o:body><o:text><t:h t:outline-level='2'>Head</t:h><t:p>Body <t:span>text</t:span></t:p></o:text></o:body></o:d>")
    assert office.blocks_of(odt) == [("heading", 2, "Head"), ("paragraph", 0, "Body text")]
    assert office.blocks_of(rb"{\rtf1{\fonttbl{\f0 Arial;}}\f0 Caf\'e9 \{x\}\par Second \u8364?5.\par}") == [("paragraph", 0, "Café {x}"), ("paragraph", 0, "Second €5.")]
    assert office.blocks_of(None) == [] and office.blocks_of(b"a\n\nb") == [("paragraph", 0, "a"), ("paragraph", 0, "b")]


def test_paragraphs_end_at_the_next_one():
    found = [(e.tag, e.depth, e.text) for e in markup.Elements("<div><p>a <b>b<br><p>c<div><p>d</div> e</div><p>f").found if e.tag == "p"]
    assert found == [("p", 1, "a b"), ("p", 1, "c d e"), ("p", 3, "d"), ("p", 0, "f")]


def test_spread_on_the_last_bit(spark):
    """Of two similarities the smaller one lies on mean less deviation, but for the last bit, which the SQL has too."""
    r = random.Random(3)
    sims = [(d, i, round(r.uniform(0.4, 1), 9)) for d in range(400) for i in range(2 + d % 3)]
    got = {(x["doc_id"], x["i"]) for x in semantic.by_spread(spark.createDataFrame(sims, "doc_id long, i long, sim double").repartition(3)).collect()}
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE s(doc_id BIGINT, i BIGINT, sim DOUBLE)")
    con.executemany("INSERT INTO s VALUES (?, ?, ?)", sims)
    want = con.execute("SELECT doc_id, i FROM (SELECT doc_id, i, sim, avg(sim) OVER (PARTITION BY doc_id) AS m, stddev_pop(sim) OVER (PARTITION BY doc_id) AS s FROM s) WHERE sim < greatest(0.3, m - s)").fetchall()
    assert got == set(want)


def test_windows_of_blank_texts(spark):
    texts = [(1, ""), (2, " \n"), (3, None), (4, " " * 25), (5, "ab" + " " * 25 + "c")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    chars = {(x["doc_id"], x["chunk_index"]): x["content"] for x in closed.universal_window(docs, 10, 2).collect()}
    assert chars == {(d, k): t if len(t) <= 10 else t[a : a + 10] for d, t in texts if t is not None for k, a in enumerate([0] if len(t) <= 10 else range(0, len(t), 8))}
    words = {x["doc_id"]: x["content"] for x in closed.universal_window(docs, 10, 2, unit="word").collect()}
    assert words == {d: t for d, t in texts if t is not None}


def test_overlap_of_a_line_in_all_chunks():
    """The value is settled long before all pairs are measured; a few pairs of long chunks are, one by one."""
    r = random.Random(2)
    line = "".join(r.choices("abcdefgh", k=60))
    body = ["".join(r.choices("abcdefghijklmnop ", k=2000)) for _ in range(120)]
    began = time.process_time()
    assert list(chunkops._overlap([b[:900] + line + b[900:] for b in body])) == [("", 1.0)]
    some = [b[:900] + line + b[900:] if i < 3 else b for i, b in enumerate(body)]
    shared = sum(chunkops.longest_common(a, b) for i, a in enumerate(some[:3]) for b in some[i + 1 : 3])
    assert list(chunkops._overlap(some)) == [("", 1 - (1 - shared / sum(map(len, some)) / 0.2))]
    assert time.process_time() - began < 5


def test_large_inputs_in_few_files_are_dealt(spark, sf, monkeypatch):
    """Also one past the size of small inputs, which may be a single row group; a plan that deals rows stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(kernel, "SPREAD_BYTES", 1)
    dealt = kernel.spread(docs)
    held = [n for n in dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(held) >= 4 and sum(held) == docs.count() and dealt.exceptAll(docs).isEmpty()
    assert kernel.spread(dealt) is dealt
    by = docs.groupBy("doc_id").count()
    assert kernel.spread(by) is by
    monkeypatch.undo()
    mixed = docs.unionByName(spark.createDataFrame([(-1, "x")], "doc_id long, text string"))  # of a size that is not known
    assert kernel.spread(mixed) is mixed


def test_terms_are_not_shuffled(spark):
    """Words of a document meet once, as its sentences do; counts and norms of terms deal and sort nothing."""
    rows = [(d, i, s) for d in range(3) for i, s in enumerate(["a cat sat", "the cat ran", "", "cat cat dog", "the end"])]
    s = spark.createDataFrame(rows, "doc_id long, i long, sentence string")
    for df in (semantic.tfidf(s), semantic.tfidf(s, pairs=True, most=4), semantic.neighbours(s)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and plan.count("Exchange") == 1
    got = {(x["doc_id"], x["i"]): (x["n"], x["sim"]) for x in semantic.neighbours(s).collect()}
    assert set(got) == {(d, i) for d in range(3) for i in range(4)} and got[0, 0][1] > 0 and got[0, 1] == (5, None) == got[1, 3]
    joined = {(x["doc_id"], x["i"]): x["sim"] for x in semantic.tfidf_similarity(semantic.tfidf(s)).collect()}
    assert joined == {k: sim for k, (_, sim) in got.items() if sim is not None}


@pytest.mark.parametrize("most", [3, 100])
def test_topic_shift_of_a_batch(most):
    """All boundaries of a batch of documents at once, as one by one."""
    r = random.Random(most)
    units = [[[r.choice("abcdefg") + "x" for _ in range(r.randrange(5))] for _ in range(r.randrange(1, 7))] for _ in range(60)]

    def slow(terms, i):
        a, b = (Counter(t for own in terms[x:y] for t in own) for x, y in ((max(0, i - 2), i), (i, i + 2)))
        names = sorted(set(a) | set(b), key=lambda t: (-a[t] - b[t], t))[:most]
        size = lambda own, other: math.sqrt(sum((own[t] * (1 if other[t] else math.log(1.5) + 1)) ** 2 for t in names))
        norm = size(a, b) * size(b, a)
        return 1 - sum(a[t] * b[t] for t in names) / norm if norm else 1.0 if names else 0.0

    at, value = discourse._shifts(pa.array(units), most)
    first = np.cumsum([0, *map(len, units)])
    want = [(first[d] + i, slow(terms, i)) for d, terms in enumerate(units) for i in range(1, len(terms))]
    assert at.tolist() == [k for k, _ in want] and value == pytest.approx([v for _, v in want])


def test_one_pattern_of_all_phrases():
    """It finds what the phrases find one by one, and is read letter by letter."""
    phrases = sorted({p for own in discourse.MARKERS.values() for p, _ in own})
    ends = {p: discourse._body(p)[len(p.replace(".", "[.]")) :] for p in phrases}
    plain = lambda x: re.compile(x.replace(r"[\p{L}\p{N}_]", r"\w"))
    any_ = plain(discourse.BEFORE + discourse._trie(ends))
    for text in [*phrases, *(f"x {p} y" for p in phrases), *(f"x{p}" for p in phrases), *(f"{p}x" for p in phrases), "e.g. x", "e.g.x", "that is to", "no"]:
        assert bool(any_.search(text)) == any(plain(discourse.phrase(p)).search(text) for p in phrases), text


def test_top_k_holds_few_scores(spark, monkeypatch):
    """A batch is scored in slices, and only what may be among the k best is sorted; results are those of a full sort."""
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(6000, 4)), 1)  # with equal vectors, so with ties
    ids, unit = list(range(0, 6000, 30)), vectors._unit(v)[::30]
    best, _ = vectors._nearest(ids, unit, 3, "vec_id")
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + 3000)), pa.array(list(v[a : a + 3000]))], ["vec_id", "v"]) for a in (0, 3000)]
    sorts, sort = [], np.lexsort
    monkeypatch.setattr(vectors, "CELLS", 20_000, raising=False)
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: sorts.append(np.size(keys[0])) or sort(keys, axis=axis))
    [got] = best(iter(batches))
    assert max(sorts) <= 20_600
    rows = list(zip(*(c.to_pylist() for c in got.columns), strict=True))
    for q in ids[:40]:
        s = np.round(vectors._unit(v) @ vectors._unit(v)[q], 9)
        s[q] = -9
        want = sort((np.arange(6000), -s))[:3]
        assert [x[1] for x in rows if x[0] == q] == want.tolist()
