import bisect
import hashlib
import json
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docslice.llm import chat, components, embeddings, html, warc
from docslice.runtime import scratch

# components


def test_components(spark):
    r = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(50)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# embeddings


def slow_links(rows):
    ids = np.array([i for i, _ in rows])
    a = np.array([v for _, v in rows], float)
    a /= np.linalg.norm(a, axis=1)[:, None]
    near = a @ a.T >= 0.95
    np.fill_diagonal(near, False)
    comp, seen = ids.copy(), np.zeros(len(ids), bool)
    for i in np.argsort(ids):
        queue = [i] if not seen[i] else []
        seen[i] = True
        while queue:
            x = queue.pop()
            comp[x] = ids[i]
            for y in np.flatnonzero(near[x] & ~seen):
                seen[y] = True
                queue.append(y)
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), comp, strict=True)}


def test_embeddings(spark):
    r = np.random.default_rng(3)
    x, rows = r.normal(size=(120, 24)), []
    for v in x:
        for _ in range(4):
            z, c = r.normal(size=24), r.uniform(0.93, 1)
            z -= z @ v / (v @ v) * v
            z *= np.linalg.norm(v) / np.linalg.norm(z)
            rows.append((len(rows), [float(y) for y in c * v + np.sqrt(1 - c * c) * z]))
    tight = x[0] + 0.02 * r.normal(size=(60, 24))
    rows += [(len(rows) + k, [float(y) for y in v]) for k, v in enumerate(tight)]
    rows += [(len(rows) + k, rows[5][1]) for k in range(5)]
    want, n = slow_links(rows), len(rows)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [1.0, None]), (None, [1.0] * 24), (n + 5, [1.0, 2.0, 3.0]), (n + 6, [2.0, 4.0, 6.0]), (n + 7, [float("inf")] + [1.0] * 23)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.linked(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect()}
    assert {i: got[i][:2] for i in want} == want and all(got[i][2] == (got[i][1] == i) for i in want)
    assert all(got[n + k] == (0, n + k, True) for k in (0, 1, 2, 3, 4, 7)) and got[None] == (0, None, False)
    assert got[n + 5] == (1, n + 5, True) and got[n + 6] == (1, n + 5, False)
    assert embeddings.linked(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    """Blocks of a key that meet in pairs give the links of the whole."""
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    r = np.random.default_rng(4)
    rows = [(i, [float(y) for y in np.ones(8) + 0.1 * r.normal(size=8)]) for i in range(70)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == slow_links(rows)


def test_recall_at_the_threshold():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z
    for n in (1000, 10**6, 10**8):
        k, tables, probes = embeddings.shape(n)
        (a, near_a), (b, near_b) = embeddings.keys_of(x, k, tables, probes), embeddings.keys_of(y, k, tables, probes)
        assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.999, n
        assert np.bitwise_count(near_a ^ near_b).sum(1).max() <= embeddings.FAR - 10


@pytest.mark.parametrize("d", [6, 48])
def test_repeated_ids_are_vectors_of_their_own(spark, d):
    r = np.random.default_rng(6)
    e = np.linalg.qr(r.normal(size=(d, d)))[0]
    near = lambda i: (e[i] + 0.01 * e[5]).tolist()
    rows = [(1, e[0].tolist()), (1, e[1].tolist()), (2, near(0)), (3, near(1)), (7, e[2].tolist()), (7, e[2].tolist()), (7, near(2)), (9, e[3].tolist()), (9, e[4].tolist())]
    got = sorted(tuple(x) for x in embeddings.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (7, 2, 7, True), (7, 2, 7, True), (7, 2, 7, True), (9, 0, 9, True), (9, 0, 9, True)])


@settings(max_examples=30, deadline=None)
@given(seed=st.integers(0, 2**32 - 1), sizes=st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_sifting_keeps_what_is_near(seed, sizes):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, (3, 4)).astype(np.uint64)
    cut = np.concatenate([[0], np.cumsum(sizes)])
    bits = base[r.integers(0, 3, cut[-1])] ^ (r.integers(0, 2**63, (cut[-1], 4)) & r.integers(0, 2**63, (cut[-1], 4)) & r.integers(0, 2**63, (cut[-1], 4))).astype(np.uint64)
    cross, block = np.repeat(r.random(len(sizes)) < 0.5, sizes), np.zeros(cut[-1], np.int64)
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        if cross[a]:
            block[a:z] = r.integers(0, 2, z - a)
    want = np.zeros(cut[-1], bool)
    for a, z in zip(cut[:-1], cut[1:], strict=True):
        for i in range(a, z):
            for j in range(a, z):
                if i != j and (not cross[a] or block[i] != block[j]) and np.bitwise_count(bits[i] ^ bits[j]).sum() <= embeddings.FAR:
                    want[i] = True
    assert (embeddings.sifted(bits, cut, block, cross) == want).all()


# web pages


def site(body):
    return f"<html><body><div class='x'>Site name</div><ul><li>Home</li><li>About us</li></ul><div>{body}</div><div class='sidebar'>side</div><p>Imprint 2020</p></body></html>"


def test_html(spark, sf):
    rows = [
        (1, "http://a.com/n/1", site("<p>One text &amp; more<p>Two")),
        (2, "http://a.com/n/2", site("<p>Other words here")),
        (4, "http://b.com/1", site("alone")),
        (5, None, None),
        (6, "http://a.com/q", "<nav>m</nav><article><header><h1>T</h1></header><p>kept  <b>x</b><br>y</p><div class='comments'>c</div><aside>a</aside></article><footer>f</footer>"),
        (6, "http://a.com/q", "<nav>m</nav><article><header><h1>T</h1></header><p>kept  <b>x</b><br>y</p><div class='comments'>c</div><aside>a</aside></article><footer>f</footer>"),
        (7, "u", "<p>cut <b"),
        (None, "http://a.com/n/3", site("nid")),
        (8, "v", "<script>var t='</p>';</script><form>f</form><p>&lt;p&gt; &eacute;</p><!-- c -->"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS key")
    got = sorted(((r["page_id"] or 0, r["text"]) for r in html.main_text(frame).collect()))
    assert got == [(0, "nid"), (1, "One text & more\n\nTwo"), (2, "Other words here"), (4, "Site name\n\nHome\n\nAbout us\n\nalone\n\nImprint 2020"), (5, ""), (6, "T\n\nkept x y"), (6, "T\n\nkept x y"), (7, "cut"), (8, "<p> é")]
    assert html.main_text(frame.limit(0)).count() == 0
    pages = html.op5_html(spark, sf).collect()
    assert len(pages) == spark.read.parquet(f"{sf}/pages.parquet").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in pages)


@pytest.mark.parametrize("cells", [1, 40, 1 << 20])
def test_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(html, "CELLS", cells)

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = np.random.default_rng(0)
    for _ in range(200):
        a, b = r.integers(0, 4, r.integers(0, 12)), r.integers(0, 4, r.integers(0, 12))
        got = html.common(a, b)
        assert got.sum() == slow(a, b)
        it = iter(b.tolist())
        assert all(x in it for x in a[got].tolist())


def test_lines_of_very_long_pages_take_linear_memory():
    r = np.random.default_rng(1)
    a = np.arange(8000)
    b = r.permutation(a)
    tracemalloc.start()
    got = html.common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # of ascending numbers, a longest increasing subsequence of b
    ends: list[int] = []
    for v in b.tolist():
        i = bisect.bisect_left(ends, v)
        ends[i : i + 1] = [v]
    assert got.sum() == len(ends) and peak < 30e6


def slow_difference(rows):
    """Text of pages (key, host, path, lines) of one host that mark no article: sorted by path, less the lines of a
    longest common subsequence with the nearer neighbour that is no near copy."""
    firsts = {}
    for row in sorted(rows, key=lambda x: (x[1], x[0])):
        firsts.setdefault(tuple(row[2]), row)
    order = sorted(firsts.values(), key=lambda x: (x[1], x[0]))
    out = {}
    for i, (_, path, lines) in enumerate(order):
        best = None
        for side in (order[max(0, i - html.WINDOW) : i][::-1], order[i + 1 : i + 1 + html.WINDOW]):
            for _, other_path, other in side:
                same = html.common(np.array([hash(x) for x in lines]), np.array([hash(x) for x in other]))
                if not same.all() and same.sum() < html.NEAR * max(len(lines), len(other)):
                    far = html.leading(other_path, path)
                    if best is None or far > best[0]:
                        best = far, same
                    break
        out[tuple(lines)] = "\n\n".join(x for x, s in zip(lines, best[1] if best else [False] * len(lines), strict=True) if not s)
    return {key: out[tuple(lines)] for key, _, lines in rows}


@pytest.mark.parametrize("parts", [1, 7])
def test_differencing_is_the_slow_one(spark, monkeypatch, parts):
    r = np.random.default_rng(8)
    frame, rows = [f"frame line {i}" for i in range(9)], []
    for k in range(60):
        own = [f"text {k} {i} {r.integers(1000)}" for i in range(r.integers(1, 6))] if k % 7 or not rows else rows[-1][2]
        lines = own if own and own[0] in frame else [x for x in frame[:4] if r.random() < 0.8] + own + [x for x in frame[4:] if r.random() < 0.8] if k % 7 else own
        rows.append((k, f"/s{k % 5}/p{r.integers(1000)}", lines))
    table = spark.createDataFrame([(k, f"http://host.example{path}", "".join(f"<p>{x}</p>" for x in lines)) for k, path, lines in rows], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {x["page_id"]: x["text"] for x in html.main_text(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # pages of one path and the same lines tie by a hash of their key, which the slow rule does not know
    assert len({x[1] for x in rows}) == len(rows) and got == slow_difference(rows)


@pytest.mark.parametrize("deep", [0, 2, 8])
def test_nearest_page_that_is_no_copy_is_that_of_a_scan(monkeypatch, deep):
    monkeypatch.setattr(html.Span, "deep", deep)
    r = np.random.default_rng(5)
    for k in range(300):
        span, pages = html.Span(), []
        for i in range(r.integers(1, 40)):
            story = r.integers(0, 3) * 100 if k % 3 == 0 else 100 * (i // 15)
            page = story + np.arange(r.integers(8, 12) if k % 2 else 10)
            page[r.integers(0, len(page) if k % 5 else 1)] = r.integers(1000, 1005)
            pages.append(page[: r.integers(1, 4)] if r.random() < 0.1 else page)
            span.add(i, "", pages[-1])
        for i, own in enumerate(pages):
            for step in (-1, 1):
                ahead = range(i + step, len(pages) if step > 0 else -1, step)
                scan = (j for j in ahead if not (same := html.common(own, pages[j])).all() and same.sum() < html.NEAR * max(len(own), len(pages[j])))
                assert span.nearest(own, i + step, step) == next(scan, None)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_copies_beyond_the_window_hide_no_page(spark, monkeypatch, parts):
    r = np.random.default_rng(9)
    head, foot = [f"menu {i}" for i in range(4)], ["about", "imprint"]
    story = [[f"sentence {k} {i}" for i in range(24)] for k in range(3)]
    hosts = {}
    # one story to the end of the host
    hosts["a"] = [[*head, *story[0], f"visitor {k}", *foot] for k in range(70)] + [[*head, "other article", *foot]]
    # stories by turns of 30, changed anywhere, and pages of the frame alone; one path has the same beginning as a page far off
    for k in range(150):
        own = list(story[k // 30 % 3])
        own[r.integers(24)] = f"changed {k}"
        hosts.setdefault("b", []).append(head[: r.integers(2, 5)] if k % 17 == 0 else [*head, *own, *foot])
    # nothing else
    hosts["c"] = [[*head, *story[1], f"visitor {k}", *foot] for k in range(40)]
    rows = [(f"http://{host}.example/p{k // 40}/{r.integers(10**6)}", x) for host, pages in hosts.items() for k, x in enumerate(pages)]
    table = spark.createDataFrame([(k, url, "".join(f"<p>{x}</p>" for x in lines)) for k, (url, lines) in enumerate(rows)], "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {x["page_id"]: x["text"] for x in html.main_text(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    monkeypatch.setattr(html, "WINDOW", len(rows))  # of the slow rule
    want = {}
    for host in hosts:
        want |= slow_difference([(k, html._place(url)[1], lines) for k, (url, lines) in enumerate(rows) if html._place(url)[0] == f"{host}.example"])
    assert len({x[0] for x in rows}) == len(rows) and got == want
    assert got[70] == "other article" and got[35].startswith("sentence 0 0") and got[35].endswith("visitor 35")


# archive


def test_warc(spark, sf):
    big = "é" * 600
    rows = [(1, "http://x/\r\n", big), (9, "http://y", big), (5, None, big), (2, "u", "small"), (3, "v", "small"), (4, "w", None), (None, "n", big), (7, "z", "\r\n\r\nWARC/1.1\r\n\r\n" * 200)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS n", "3 AS sha256")
    path = scratch(spark, "test-warc")
    warc.write_archive(frame, path)
    heads = {r["page_id"]: r for r in warc.read_records(spark, path).collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in heads.items()} == {1: ("revisit", 9), 9: ("response", None), 5: ("revisit", 9), 2: ("response", None), 3: ("response", None), 4: ("response", None), None: ("revisit", 9), 7: ("response", None)}
    whole = {r["page_id"]: r for r in warc.restore(spark, path).collect()}
    for i, _, h in rows:
        body = (h or "").encode()
        assert bytes(whole[i]["payload"]) == body and whole[i]["sha1"] == hashlib.sha1(body).hexdigest()
        assert bytes(whole[i]["head"]).startswith(b"WARC/1.1\r\n") and bytes(whole[i]["head"]).endswith(b"\r\n\r\n")
    warc.write_archive(frame.limit(0), empty := scratch(spark, "test-warc"))
    assert warc.read_records(spark, empty).count() == 0
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in warc.op7_warc(spark, sf).collect()}
    assert {i: (r["payload_bytes"], r["payload_digest"]) for i, r in got.items()} == {i: (len(b), hashlib.sha1(b).hexdigest()) for i, b in pages.items()}


def test_broken_payload_is_told():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:x>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:00\r\nPayload-SHA256: 00\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc._record_rows(record, False))
    with pytest.raises(ValueError, match="cut off"):
        list(warc._record_rows(record[:-3], False))


# chat

SCHEMA = {"type": "object", "properties": {"city": {"type": "string"}, "days": {"type": "integer"}, "unit": {"enum": ["C", "F"]}}, "required": ["city"], "additionalProperties": False}


def test_chat(spark):
    rows = [
        (1, 0, "system", json.dumps({"tools": [{"name": "w", "parameters": SCHEMA}]})),
        (1, 1, "user", "hi"),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"z": 1, "a": [1, 2]}})),
        (1, 3, "assistant", json.dumps({"content": "let me", "tool_calls": [{"id": "a", "name": "w", "arguments": {"days": 3, "city": "X"}}]})),
        (1, 4, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "w", "arguments": {"days": "3", "unit": "K", "q": 1}, "depends_on": ["a"]}, {"id": "n", "name": "nope", "arguments": {}}]})),
        (1, 5, "tool", json.dumps({"tool_call_id": "a", "content": "ok"})),
        (1, 6, "assistant", "done"),
        (1, 6, "assistant", "done"),
        (1, 7, "tool", json.dumps({"tool_call_id": "zz", "content": 1})),
        (2, 0, "assistant", json.dumps({"tool_calls": [{"id": "x", "name": "w", "arguments": {}, "depends_on": ["y"]}]})),
        (2, 1, "assistant", json.dumps({"tool_calls": [{"id": "y", "name": "w", "arguments": [1], "depends_on": ["x"]}]})),
        (2, 2, "tool", json.dumps({"tool_call_id": "x"})),
        (2, 3, "tool", json.dumps({"tool_call_id": "y"})),
        (None, None, None, None),
        (3, 0, "user", ""),
        (3, 1, "user", '{"a":1,"a":2}'),
        (3, 3000, "user", 'é"\n'),
        (3, None, "user", "first"),
        (4, 0, "user", "long " * 50_000),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS c", "2 AS key", "3 AS position")
    got = chat.linked(frame).collect()
    by = {(r["conv_id"], r["position"]): r for r in got}
    assert len(got) == len(by) == len(rows)
    assert [by[1, p]["turn"] for p in range(9)] == [0, 1, 3, 5, 4, 2, 6, 6, 7]
    assert by[1, 4]["issues"] == "b:enum:unit,b:missing:city,b:type:days,b:unknown:q,n:no_result,n:no_schema"
    assert by[1, 8]["issues"] == "zz:no_call" and by[1, 2]["issues"] == ""
    assert by[1, 2]["line"] == '{"content":"let me","role":"assistant","tool_calls":[{"arguments":{"city":"X","days":3},"id":"a","name":"w"}]}'
    assert by[1, 5]["line"] == '{"content":{"a":[1,2],"z":1},"role":"tool","tool_call_id":"b"}'
    assert any("cycle" in by[2, p]["issues"] for p in range(4)) and by[None, 0]["line"] == "{}"
    assert [by[3, p]["turn"] for p in range(4)] == [None, 0, 1, 3000] and by[3, 3]["line"] == '{"content":"é\\"\\n","role":"user"}'
    assert chat.linked(frame.limit(0)).count() == 0


def test_chat_loses_nothing(spark):
    """Unknown fields at every depth, the `function` shape, arguments as JSON text, conversations null and "null"."""
    schema = {"type": "object", "properties": {"n": {"type": ["integer", "null"], "minimum": 1, "maximum": 5}, "s": {"type": "string", "maxLength": 2}, "l": {"type": "array", "minItems": 1, "items": {"type": ["string", "integer"], "maximum": 3}}}, "required": ["n"]}
    tool = {"type": "function", "function": {"name": "w", "parameters": schema, "strict": True}}
    call = lambda i, args: {"id": i, "type": "function", "x": {"b": None, "a": [1]}, "function": {"name": "w", "arguments": args, "y": 1}}
    good, bad = {"n": None, "s": "ab", "l": ["a", 3]}, {"n": 9, "s": "abc", "l": [4, True]}
    docs = [
        {"tools": [tool], "v": 2},
        {"content": None, "tool_calls": [call("a", json.dumps(good)), call("b", json.dumps(bad)), call("c", "no json"), "odd"], "refusal": None, "extra": [{"z": 1, "y": 2}]},
        {"tool_call_id": "a", "name": "w", "content": "1", "role": "other"},
        {"tool_call_id": "b", "is_error": True},
        {"tool_call_id": "c"},
    ]
    rows = [(None, k, "r", json.dumps(x)) for k, x in enumerate(docs)] + [("null", k, "user", f"t{k}") for k in range(3)]
    got = {(r["conv_id"], r["position"]): r for r in chat.linked(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert len(got) == 8 and [got["null", k]["turn"] for k in range(3)] == [0, 1, 2]
    canonical = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"))
    called = {"role": "r", "extra": docs[1]["extra"], "tool_calls": [call("a", good), call("b", bad), call("c", "no json"), "odd"]}
    assert [got[None, k]["line"] for k in range(5)] == [canonical(x) for x in (docs[0] | {"role": "r"}, called, docs[2] | {"role": "r"}, docs[3] | {"role": "r"}, docs[4] | {"role": "r"})]
    assert sorted(got[None, 1]["issues"].split(",")) == sorted(["?:no_result", "?:no_schema", *(f"b:{x}" for x in ("range:n", "range:s", "range:l[0]", "type:l[1]")), "c:missing:n", "c:type:arguments"])
    assert got[None, 2]["issues"] == "own_role:other"


def slow_chat_links(messages):
    """Positions and issues about links of one conversation's messages (turn, role, text), by plain loops."""
    parts = []
    for turn, role, text in messages:
        x = json.loads(text) if text[:1] == "{" else {}
        parts.append((turn, role, text, [(c["id"], c.get("depends_on", [])) for c in x.get("tool_calls", [])], x.get("tool_call_id")))
    order = sorted(range(len(parts)), key=lambda i: parts[i][0])
    first, answer = {}, {}
    for i in order:
        for c, _ in parts[i][3]:
            first.setdefault(c, i)
        if parts[i][4] is not None:
            answer.setdefault(parts[i][4], i)
    place, edges = {i: (parts[i][0], 0) for i in order}, set()
    for i in order:
        if parts[i][4] in first:
            edges.add((first[parts[i][4]], i))
        edges |= {(answer[d], i) for _, deps in parts[i][3] for d in deps if d in answer}
    for _ in range(len(parts) + 1):
        for a, b in edges:
            place[b] = max(place[b], (place[a][0], place[a][1] + 1))
    issues = {}
    for i, (_, _, _, calls, result) in enumerate(parts):
        issues[i] = {f"{c}:no_result" for c, _ in calls if c not in answer} | ({f"{result}:no_call"} if result is not None and result not in first else set())
    return {parts[i][0]: (p, issues[i]) for p, i in enumerate(sorted(order, key=lambda i: (*place[i], parts[i][0])))}


def test_links_of_random_conversations(spark):
    r, rows = np.random.default_rng(9), []
    for conv in range(25):
        turns = r.permutation(40)[: r.integers(4, 24)].tolist()
        names = [f"c{i}" for i in range(len(turns))]
        for k, turn in enumerate(turns):
            what = r.random()
            if what < 0.35:  # calls depend on calls of a smaller number, so there are no cycles
                calls = [{"id": names[k], "name": "f", "arguments": {}, "depends_on": [names[int(i)] for i in r.integers(0, k, r.integers(0, 3))] if k else []}]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            elif what < 0.75:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": names[int(r.integers(0, len(names)))]})))
            else:
                rows.append((conv, turn, "user", f"text {turn}"))
    got = {}
    for x in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault(x["conv_id"], {})[x["turn"]] = (x["position"], {i for i in x["issues"].split(",") if i.endswith(("no_result", "no_call"))})
    assert got == {c: slow_chat_links([x[1:] for x in rows if x[0] == c]) for c in got} and len(got) == 25


def test_chat_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    got = chat.op2_chat(spark, sf).collect()
    want = {}
    for r in rows:
        want.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert len(got) == len(rows)
    for r in got:
        turn, role, text = sorted(want[r["conv_id"]])[r["position"]]
        assert (r["turn"], r["role"], r["kind"], r["issues"]) == (turn, role, "message", "")
        assert r["line"] == json.dumps({"content": text, "role": role} if text else {"role": role}, ensure_ascii=False, separators=(",", ":"))


def test_warc_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = {tuple(r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({warc.OP7_SQL})").fetchall()}
    got = [tuple(r[n] for n in names) for r in warc.op7_warc(spark, sf).collect()]
    assert set(got) == want and len(got) == len(want)


def test_frames_around_and_inside_articles():
    page = "<article class='post'><div class='post-header'><h1>Title</h1></div><p>Body.</p><div id=comments><article class='comment'><p>No.</p></article></div></article><article class='comment'><p>Nor this.</p></article><div class='site-header'>Menu</div>"
    texts, flags = html.blocks(page)
    assert [t for t, f in zip(texts, flags, strict=True) if f] == ["Title", "Body."]


@pytest.mark.parametrize("parts", ["1", "3"])
def test_copies_of_unmarked_pages_keep_their_article(spark, monkeypatch, parts):
    monkeypatch.setattr(html, "WINDOW", 3)
    long = [f"sentence {i} of the story" for i in range(30)]
    story, near = ("".join(f"<p>{x}" for x in y) for y in (long, [*long[:-1], "changed end"]))
    rows = [(k, f"http://a.com/n/{k}", site(story)) for k in range(1, 6)] + [(6, "http://a.com/n/6", site(near)), (7, "http://a.com/n/7", site("<p>Else")), (7, "http://a.com/n/7", site("<p>Else"))]
    rows += [(k, f"http://b.com/{k}", site(story)) for k in (20, 21)]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((r["page_id"], r["text"]) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    text = "\n\n".join(long)
    whole = "\n\n".join(["Site name", "Home", "About us", text, "Imprint 2020"])
    assert got == [(k, text) for k in range(1, 6)] + [(6, "\n\n".join([*long[:-1], "changed end"])), (7, "Else"), (7, "Else"), (20, whole), (21, whole)]


@pytest.mark.parametrize("around", ["div class='layout has-sidebar'", "div class='no-sidebar'", "div class='header-fixed page'", "form id=aspnet", "div class='sidebar widget'"])
def test_frames_around_an_article_do_not_hide_it(around):
    page = f"<{around}><div class='site-header'>Menu</div><article><p>Body.</p><div class='social-history'>Rise.</div><div class='share-price'>Fall.</div><div class='share-buttons'>Tweet</div><p hidden>no</p></article></{around.split()[0]}><div class='sidebar'>Side</div>"
    texts, flags = html.blocks(page)
    assert [t for t, f in zip(texts, flags, strict=True) if f] == ["Body.", "Rise.", "Fall."]


def test_chat_of_nested_arguments(spark):
    place = {"type": "object", "properties": {"city": {"type": "string"}, "unit": {"enum": ["C", "F"]}}, "required": ["city"], "additionalProperties": False}
    schema = {"type": "object", "properties": {"at": place, "many": {"type": "array", "items": place}, "days": {"type": "array", "items": {"type": "integer", "enum": [1, 2]}}, "deep": {"properties": {"more": {"items": {"items": place}}}}}}
    good = {"at": {"city": "X", "unit": "C"}, "many": [{"city": "Y"}], "days": [1, 2], "deep": {"more": [[{"city": "Z"}]]}}
    bad = {"at": {"unit": "K", "q": 1}, "many": [{"city": "Y"}, {"city": 3}, 4], "days": [1, "2", 3], "deep": {"more": [[{"city": "Z"}, {}]]}}
    rows = [
        (1, 0, "system", "\n\t" + json.dumps({"tools": [{"name": "w", "parameters": schema}]})),
        (1, 1, "assistant", "\r\n" + json.dumps({"tool_calls": [{"id": "a", "name": "w", "arguments": good}]})),
        (1, 2, "assistant", json.dumps({"tool_calls": [{"id": "b", "name": "w", "arguments": bad}]})),
        (1, 3, "tool", "\t" + json.dumps({"tool_call_id": "a"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "b"})),
    ]
    got = {r["turn"]: r for r in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t]["kind"] for t in range(5)] == ["tools", "call", "call", "result", "result"] and got[1]["issues"] == ""
    want = ["enum:at.unit", "missing:at.city", "unknown:at.q", "type:many[1].city", "type:many[2]", "type:days[1]", "enum:days[1]", "enum:days[2]", "missing:deep.more[0][1].city"]
    assert sorted(got[2]["issues"].split(",")) == sorted(f"b:{x}" for x in want)
