"""SQL of queries whose rules fold over a text (recursive walks), or whose input is a template. For templates the rows
that the rule gives are written out; they were checked against the rule by eye, line by line."""

from __future__ import annotations

from docslice.functions import analyze
from docslice.operators import cdc
from docslice.operators.code import ANY_CASE, CONTENT
from docslice.plans.documents import _CUT, _EVENT, _MD, _ROWS, _S, _SIM, _SURFACE, BRACES, CSS, PYTHON
from docslice.plans.splits import AFTER_STOP, BLOCKS, FALLBACK, LINED, PARAGRAPHS, SENTENCES, SPACE, STRIP, WORDS, _char_sql, joined_sql

Row = tuple[str, str, int, int, str]  # kind, name, first and last line, content


def _text(t: str) -> str:
    """SQL of a template's text for a part; line ends are written as backslash and n."""
    own = t.replace("{{", "{").replace("}}", "}").replace("'", "''")
    return f"replace(replace(replace('{own}', '{{k}}', CAST(p_partkey AS VARCHAR)), '{{s}}', CAST(p_size AS VARCHAR)), '\\n', chr(10))"


def _rows(rows: list[Row], more: str = "") -> str:
    parts = []
    for i, (kind, name, a, z, content) in enumerate(rows):
        c = _text(content)
        parts.append(f"SELECT p_partkey AS doc_id, CAST({i} AS BIGINT) AS chunk_index, {c} AS content, CAST(length({c}) AS BIGINT) AS size, '{kind}' AS kind, {_text(name)} AS name, CAST({a} AS INT) AS start_line, CAST({z} AS INT) AS end_line{more} FROM part")
    return " UNION ALL ".join(parts)


PYTHON_ROWS: list[Row] = [
    ("import", "os", 1, 1, "import os"),
    ("function", "f{k}", 4, 5, "def f{k}(x):\\n    return x + {k}"),
    ("class", "C{k}", 8, 13, "class C{k}:\\n    def m(self):\\n        pass\\n\\n    async def n(self):\\n        return {s}"),
    ("method", "m", 9, 10, "    def m(self):\\n        pass"),
    ("method", "n", 12, 13, "    async def n(self):\\n        return {s}"),
    ("rest", "", 1, 17, "print(f{k}({s}))"),
]
PYTHON_BLOCKS: list[Row] = [
    ("block", "", 1, 7, "import os\\n\\n\\ndef f{k}(x):\\n    return x + {k}\\n\\n"),
    ("block", "", 8, 17, "class C{k}:\\n    def m(self):\\n        pass\\n\\n    async def n(self):\\n        return {s}\\n\\n\\nprint(f{k}({s}))\\n"),
]
BRACE_ROWS: dict[str, list[Row]] = {
    "c": [("preprocessor", "include", 1, 1, "#include <x.h>"), ("struct", "P{k}", 2, 4, "struct P{k} {\\n  int a;\\n};"), ("function", "f{k}", 5, 8, 'int f{k}(int x) {\\n  if (x) { return "}"[0]; }\\n  return {s};\\n}')],
    "javascript": [
        ("import", "a from 'b'", 1, 1, "import a from 'b';"),
        ("class", "K{k}", 2, 4, "class K{k} {\\n  m(x) { return '}'; }\\n}"),
        ("method", "m", 3, 3, "  m(x) { return '}'; }"),
        ("function", "g{k}", 5, 7, "function g{k}(y) {\\n  if (y) { return {s}; }\\n}"),
        ("function", "h", 8, 10, "const h = (z) => {\\n  return z;\\n};"),
    ],
    "go": [
        ("package", "p", 1, 1, "package p"),
        ("import", '"fmt"', 2, 2, 'import "fmt"'),
        ("struct", "S{k}", 3, 5, "type S{k} struct {\\n  a int\\n}"),
        ("interface", "I{k}", 6, 8, "type I{k} interface {\\n  M()\\n}"),
        ("function", "M", 9, 11, "func (s S{k}) M() {\\n  fmt.Println({s})\\n}"),
    ],
    "java": [
        ("package", "a.b", 1, 1, "package a.b;"),
        ("import", "java.util.List", 2, 2, "import java.util.List;"),
        ("class", "J{k}", 3, 8, "public class J{k} {\\n  private int f = {s};\\n  public int get(int x) {\\n    return x;\\n  }\\n}"),
        ("field", "f", 4, 4, "  private int f = {s};"),
        ("method", "get", 5, 7, "  public int get(int x) {\\n    return x;\\n  }"),
    ],
}
CSS_ROWS: list[Row] = [
    ("at_rule", "@import 'x'", 1, 1, "@import 'x';"),
    ("rule", "#a{k}, .b > c:hover", 2, 4, "#a{k}, .b > c:hover {\\n  top: {s}px;\\n}"),
    ("media_query", "@media print", 5, 7, "@media print {\\n  p { margin: 0; }\\n}"),
    ("rule", "*", 8, 8, "* { color: red; }"),
]
INDENTED = ["import os\\n\\n", "def f{k}(x):\\n    return x + {k}\\n\\n", "class C{k}:\\n    def m(self):\\n        pass\\n\\n    async def n(self):\\n        return {s}\\n\\n", "print(f{k}({s}))\\n"]
TEMPLATES = {"python": PYTHON, "css": CSS, **BRACES}


def _language_sql(text: str) -> str:
    def holds(language: str, words: tuple[str, ...]) -> str:
        out = []
        for w in words:
            own = f"{'upper' if language == 'sql' else 'lower'}({text})" if language in ANY_CASE and (language == "sql" or w == "kotlin") else text
            out.append(f"NOT contains({text}, '{w[1:]}')" if w.startswith("-") else f"contains({own}, '{w}')")
        return " AND ".join(out)

    return "CASE " + " ".join(f"WHEN {holds(language, words)} THEN '{language}'" for language, ways in CONTENT for words in ways) + " ELSE 'generic' END"


def _overlapped(units: str, sep: str, most_units: int, most_chars: int, least_units: int, overlap: int) -> str:
    """Greedy packs that start again some units back. units: SQL of doc_id and a list u."""
    take = f"len(list_filter(range(1, {most_units} + 1), lambda k: i + k <= n AND (k = 1 OR p[i + k + 1] - p[i + 1] <= {most_chars})))"
    end = f"least(n, greatest(i + {take}, i + {least_units}))"
    return f"""WITH RECURSIVE u AS MATERIALIZED (SELECT doc_id, u, len(u) AS n, list_prepend(0, list_transform(range(1, len(u) + 1), lambda k: list_sum(list_transform(list_slice(u, 1, k), lambda x: length(x))))) AS p FROM {units} WHERE len(u) > 0),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS g, CAST(0 AS BIGINT) AS i, CAST(j AS BIGINT) AS j, n FROM (SELECT doc_id, n, {end.replace('i + k + 1', 'k + 1').replace('i + 1', '1').replace('i + k', 'k').replace('i + ', '')} AS j FROM u)
UNION ALL SELECT doc_id, g, i, CAST({end} AS BIGINT), n FROM (SELECT r.doc_id, r.g + 1 AS g, greatest(r.i + 1, r.j - least({overlap}, r.j - r.i)) AS i, u.n, u.p FROM r JOIN u USING (doc_id) WHERE r.j < r.n)),
c AS (SELECT r.doc_id, g, array_to_string(list_slice(u.u, i + 1, j), {sep}) AS content FROM r JOIN u USING (doc_id))
SELECT doc_id, g AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM c"""


_MERGED = f"""(WITH p AS (SELECT doc_id, {PARAGRAPHS.format(c='text')} AS u FROM {LINED}), e AS (SELECT doc_id, unnest(u) AS t, unnest(range(0, len(u))) AS i FROM p),
g AS (SELECT doc_id, t, i, sum(CASE WHEN i = 0 OR length(t) >= 80 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM e), m AS (SELECT doc_id, k, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t FROM g GROUP BY doc_id, k) SELECT doc_id, list(t ORDER BY k) AS u FROM m GROUP BY doc_id)"""
_SHORT = f"""WITH RECURSIVE u AS MATERIALIZED (SELECT doc_id, {SENTENCES.format(c='text')} AS u FROM documents),
r AS (SELECT doc_id, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS g, CAST(length(u[1]) AS BIGINT) AS len FROM u WHERE len(u) > 0
UNION ALL SELECT doc_id, i + 1, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN len + 1 + n ELSE n END FROM (SELECT r.doc_id, r.i, r.g, r.len, length(u.u[r.i + 1]) AS n, (r.len < 60 OR length(u.u[r.i + 1]) < 60) AND r.len + length(u.u[r.i + 1]) <= 200 AS j FROM r JOIN u USING (doc_id) WHERE r.i < len(u.u))),
c AS (SELECT r.doc_id, g, string_agg(u.u[r.i], ' ' ORDER BY r.i) AS content FROM r JOIN u USING (doc_id) GROUP BY ALL)
SELECT doc_id, g AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM c"""
_PIECE = "substring(text, CAST(a AS BIGINT) + 1, 1000)"
_LAST = f"a + length({_PIECE}) - strpos(reverse({_PIECE}), ' ')"
_STOP = f"CASE WHEN a + 1000 < n AND strpos(reverse({_PIECE}), ' ') > 0 AND {_LAST} > a + 500 THEN {_LAST} ELSE least(a + 1000, n) END"
_LASTSPACE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS a, CAST({_STOP} AS BIGINT) AS z, n FROM (SELECT *, 0 AS a FROM d)
UNION ALL SELECT doc_id, a, CAST({_STOP} AS BIGINT), n FROM (SELECT r.doc_id, greatest(r.a + 1, r.z - 100) AS a, d.text, d.n FROM r JOIN d USING (doc_id) WHERE r.z < r.n)),
c AS (SELECT r.doc_id, a, {STRIP.format(c='substring(text, a + 1, z - a)')} AS content FROM r JOIN d USING (doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM c WHERE content <> ''"""


def _onward(p: str) -> str:
    return f"CASE WHEN {p} >= n THEN n WHEN {p} <= 0 THEN 0 ELSE least(n, {p} + length(regexp_extract(substring(text, CAST({p} AS BIGINT) + 1), '^[^ \\t\\n\\r]*'))) END"


_SPACEWISE = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, length(text) AS n FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\v\\f\\r]')),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST({_onward('1000')} AS BIGINT) AS z, n FROM d
UNION ALL SELECT doc_id, k, a, z, n FROM (SELECT doc_id, k, a, CAST({_onward('(a + 1000)')} AS BIGINT) AS z, n FROM (SELECT r.doc_id, r.k + 1 AS k, greatest(r.a + 1, CAST({_onward('(r.a + 500)').replace('text', 'd.text').replace('n WHEN', 'd.n WHEN').replace('>= n', '>= d.n').replace('least(n', 'least(d.n')} AS BIGINT)) AS a, d.text, d.n FROM r JOIN d USING (doc_id)) WHERE a < n) WHERE z - a >= 50)
SELECT r.doc_id, k AS chunk_index, substring(text, a + 1, z - a) AS content, CAST(z - a AS BIGINT) AS size FROM r JOIN d USING (doc_id)"""
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '[‘’‚‛]', '''', 'g'), '[“”„‟]', '\"', 'g'), '[‐-―]', '-', 'g'), '[\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g')"
_SPACES = STRIP.format(c="regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+(\n|$)', '\\1', 'g')")
_PIPELINE = joined_sql("uu", "' '", 2000, FALLBACK.replace("FROM documents)", f"FROM (SELECT doc_id, {_CLEAN.format(c=_SPACES)} AS text FROM documents))"), most=5, count_sep=False)
_V = "[" + ", ".join(f"f{k}" for k in range(8)) + "]"
_PAIRS = f"(SELECT doc_id, i, v, lead(v) OVER (PARTITION BY doc_id ORDER BY i) AS nv FROM (SELECT doc_id, i, {_V} AS v FROM {_SURFACE}))"
_METRICS = {
    "cosine": "CASE WHEN list_dot_product(v, v) > 0 AND list_dot_product(nv, nv) > 0 THEN greatest(0.0, list_dot_product(v, nv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(nv, nv)))) ELSE 0 END",
    "dot": "least(1.0, greatest(0.0, (list_dot_product(v, nv) + 1) / 2))",
    "euclidean": "1 - least(list_distance(v, nv) / sqrt(8), 1.0)",
    "manhattan": "1 - least(list_sum(list_transform(list_zip(v, nv), lambda x: abs(x[1] - x[2]))) / 16, 1.0)",
}
_LINE_UNITS = f"(SELECT doc_id, list(t ORDER BY k) AS u FROM (SELECT doc_id, k, {STRIP.format(c='l')} AS t FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents)) WHERE t <> '' GROUP BY doc_id)"
_SIZED = joined_sql("u", "chr(10) || chr(10)", 2000, _LINE_UNITS, count_sep=False)
_EVENTS = joined_sql("u", "','", 200, f"(SELECT doc_id, list(j ORDER BY place) AS u FROM {_EVENT} GROUP BY doc_id)", count_sep=False)
_FORMAT_MARKS = [r"(?m)^#{1,6}[ \t]", r"(?m)^[ \t]*[-*+][ \t]", r"(?m)^[ \t]*\d+\.[ \t]", r"```", r"\[[^\]]+\]\([^)]+\)", r"\*\*[^*]+\*\*", r"(?m)^>[ \t]"]
_CATALOGUE = """(VALUES ('fixed_size', 'general', 1.0, 0.4), ('universal_fixed', 'general', 1.0, 0.4), ('universal_window', 'general', 0.9, 0.5), ('word_windows', 'text', 0.9, 0.5), ('overlapping_window', 'text', 0.9, 0.5), ('token_based', 'text', 0.9, 0.6), ('character_windows', 'text', 0.8, 0.5),
('sentence_based', 'text', 0.7, 0.8), ('paragraph_based', 'text', 0.7, 0.8), ('universal_sentence', 'text', 0.7, 0.7), ('universal_paragraph', 'text', 0.7, 0.7), ('universal_document', 'document', 0.7, 0.6), ('recursive', 'text', 0.5, 0.8), ('boundary_aware', 'text', 0.5, 0.8), ('markdown', 'document', 0.6, 0.8),
('semantic', 'text', 0.3, 0.9), ('context_enriched', 'text', 0.3, 0.9), ('discourse_aware', 'text', 0.3, 0.8), ('embedding_based', 'text', 0.3, 0.8), ('pattern_sections', 'custom', 0.7, 0.6), ('sentiment_groups', 'custom', 0.7, 0.5), ('balanced_length', 'custom', 0.6, 0.7), ('json', 'data', 0.9, 0.7),
('html', 'document', 0.5, 0.7), ('xml', 'document', 0.5, 0.7), ('fastcdc', 'content_defined', 0.6, 0.5), ('rolling_hash', 'content_defined', 0.6, 0.5), ('rabin_fingerprinting', 'content_defined', 0.6, 0.5), ('buzhash', 'content_defined', 0.6, 0.5), ('gear_cdc', 'content_defined', 0.6, 0.5),
('ml_cdc', 'content_defined', 0.6, 0.5), ('tttd', 'content_defined', 0.6, 0.5), ('universal_rolling', 'content_defined', 0.6, 0.5)) v(strategy, category, speed, quality)"""

_BYTES = "b AS (SELECT doc_id, unnest(hs) AS x, unnest(range(0, len(hs))) AS p FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS hs FROM documents)), v AS (SELECT doc_id, p, CAST('0x' || x AS INT) AS b FROM b)"
_SIZES = "d AS MATERIALIZED (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)"
_CUT_ROWS = 'SELECT r.doc_id, k AS chunk_index, a AS "start", z - a AS n_bytes, md5(unhex(substring(h, 2 * a + 1, 2 * (z - a)))) AS digest FROM r JOIN d USING (doc_id)'


def _cuts(candidates: str, lists: str, end: str) -> str:
    """Chunks of bytes: candidates are CTEs that end in c(doc_id, and the lists of `lists`); end: where a chunk that begins
    at a ends, from these lists and n."""
    return f"""WITH RECURSIVE {_BYTES}, {candidates}, {_SIZES}, e AS MATERIALIZED (SELECT d.doc_id, n, {lists} FROM d LEFT JOIN c USING (doc_id) WHERE n > 0),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS a, CAST({end} AS BIGINT) AS z, n FROM (SELECT *, 0 AS a FROM e)
UNION ALL SELECT doc_id, k, a, CAST({end} AS BIGINT), n FROM (SELECT r.doc_id, r.k + 1 AS k, r.z AS a, e.* EXCLUDE (doc_id) FROM r JOIN e USING (doc_id) WHERE r.z < r.n))
{_CUT_ROWS}"""


def _table(kind: str, bits: int) -> str:
    return "[" + ", ".join(str(int(x) & ((1 << bits) - 1)) for x in cdc.gear_table(kind)) + "]"


_GEAR = _cuts(
    f"g AS (SELECT doc_id, p, bit_xor({_table('gear', 32)}[b + 1]) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS x FROM v), c AS (SELECT doc_id, list(p + 1 ORDER BY p) AS cs FROM g WHERE (x & {(1 << 22) - 1}) < {1 << 19} GROUP BY doc_id)",
    "coalesce(cs, []) AS cs",
    "least(a + 65536, n, coalesce(list_filter(cs, lambda x: x >= a + 2048)[1], n))",
)


def _fastcdc(least: int, avg: int, most: int, bits: int) -> str:
    """The hash before byte p, of which only the last `bits` bytes are left in its low bits."""
    low = " + ".join(f"coalesce(lag(g, {i + 1}) OVER w, 0) * {1 << i}" for i in range(bits))
    zone = f"least(a + {2 * avg}, a + {most}, n)"
    return _cuts(
        f"""g AS (SELECT doc_id, p, {_table('crc', bits)}[b + 1] AS g FROM v), l AS (SELECT doc_id, p, ({low}) % {1 << bits} AS low FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
c AS (SELECT doc_id, list(p ORDER BY p) FILTER (WHERE low = 0) AS ms, list(p ORDER BY p) AS ss FROM l WHERE low % {1 << (bits - 1)} = 0 GROUP BY doc_id)""",
        "coalesce(ms, []) AS ms, coalesce(ss, []) AS ss",
        f"CASE WHEN a + {least} >= n THEN n ELSE coalesce(list_filter(ms, lambda x: x >= a + {least} AND x < {zone})[1], list_filter(ss, lambda x: x >= a + {max(avg, least)} AND x < {zone})[1], least(a + {most}, n)) END",
    )


_PRIME = 10**9 + 7


def _power(base: int, j: str, bits: int = 27) -> str:
    """base ** j modulo the prime, by the bits of j (below 2 ** bits)."""
    out, c = "CAST(1 AS BIGINT)", base % _PRIME
    for i in range(bits):
        out, c = f"({out} * CASE WHEN {j} & {1 << i} > 0 THEN {c} ELSE 1 END) % {_PRIME}", c * c % _PRIME
    return out


def _polynomial(window: int) -> str:
    """CTE h(doc_id, p, x): polynomial hash of the bytes that end at p, from terms that are turned back to position 0."""
    back = _power(pow(256, -1, _PRIME), "p")
    return f"""t AS (SELECT doc_id, p, b * ({back}) % {_PRIME} AS t FROM v), u AS (SELECT doc_id, p, CAST(sum(t) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS BIGINT) % {_PRIME} AS s FROM t),
h AS (SELECT doc_id, p, s * ({_power(256, 'p')}) % {_PRIME} AS x FROM u)"""


_POLY = _cuts(f"{_polynomial(64)}, c AS (SELECT doc_id, list(p + 1 ORDER BY p) AS cs FROM h WHERE x % 128 = 0 GROUP BY doc_id)", "coalesce(cs, []) AS cs", "least(a + 65536, n, coalesce(list_filter(cs, lambda x: x >= a + 2048)[1], n))")

def _shifted() -> str:
    """CTE h(doc_id, p, x): a state that each byte shifts by 8 bits and 53 are kept of; bytes that leave a window of 64 put
    in their table's value, shifted by the window's bits modulo 53."""
    full = (1 << 53) - 1
    leaving = "[" + ", ".join(str((x << 63 * 8 % 53) & full) for x in cdc._mod_table(53)) + "]"
    parts = [f"(coalesce(lag(b, {j}) OVER w, 0) << {8 * j})" for j in range(7)] + [f"((coalesce(lag(o, {j}) OVER w, 0) & {(1 << 53 - 8 * j) - 1}) << {8 * j + 8})" for j in range(7)]
    x = parts[0]
    for part in parts[1:]:
        x = f"xor({x}, {part})"
    return f"""o AS (SELECT doc_id, p, CAST(b AS BIGINT) AS b, CAST(coalesce({leaving}[lag(b, 64) OVER (PARTITION BY doc_id ORDER BY p) + 1], 0) AS BIGINT) AS o FROM v), h AS (SELECT doc_id, p, {x} & {full} AS x FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY p))"""


_SHIFT_CUTS = _cuts(f"{_shifted()}, c AS (SELECT doc_id, list(p + 1 ORDER BY p) AS cs FROM h WHERE x % 256 = 0 GROUP BY doc_id)", "coalesce(cs, []) AS cs", "least(a + 4096, n, coalesce(list_filter(cs, lambda x: x >= a + 256)[1], n))")

_SUMS = _cuts(
    "g AS (SELECT doc_id, p - 31 AS p, sum(b) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS x FROM v), c AS (SELECT doc_id, list(p ORDER BY p) FILTER (WHERE p >= 0 AND x % 256 = 0) AS cs, any_value(ps) AS ps FROM g LEFT JOIN (SELECT doc_id, list(p ORDER BY p) FILTER (WHERE b = 32) AS ps FROM v GROUP BY doc_id) USING (doc_id) GROUP BY doc_id)",
    "coalesce(cs, []) AS cs, coalesce(ps, []) AS ps",
    # the last space among the final bytes of the longest chunk, which may stand where the next one begins
    "CASE WHEN a + 512 >= n THEN n ELSE coalesce(list_filter(cs, lambda x: x >= a + 512 AND x + 32 <= least(a + 2048, n))[1], list_max(list_filter(ps, lambda x: x > least(a + 2048, n) - least(100, least(a + 2048, n) - a - 512) AND x <= least(a + 2048, n) AND x > a)), least(a + 2048, n)) END",
)

_SEMANTIC = f"""WITH RECURSIVE u AS MATERIALIZED (SELECT doc_id, list(sentence ORDER BY i) AS u FROM {_S} GROUP BY doc_id), b AS MATERIALIZED (SELECT doc_id, list(i + 1 ORDER BY i) AS bs FROM {_CUT} GROUP BY doc_id),
d AS MATERIALIZED (SELECT doc_id, u, len(u) AS n, coalesce(bs, []) AS bs FROM u LEFT JOIN b USING (doc_id)),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS a, CAST(coalesce(list_filter(bs, lambda x: x >= 2)[1], n) AS BIGINT) AS z, n FROM d
UNION ALL SELECT r.doc_id, r.z, CAST(coalesce(list_filter(d.bs, lambda x: x - r.z >= 2)[1], d.n) AS BIGINT), d.n FROM r JOIN d USING (doc_id) WHERE r.z < r.n),
p AS (SELECT doc_id, z, unnest(range(a, z, 15)) AS s FROM r), c AS (SELECT p.doc_id, s, substring(array_to_string(list_slice(u, s + 1, least(s + 15, z)), ' '), 1, 5000) AS content FROM p JOIN d USING (doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM c"""

_WORD_LIST = WORDS.format(c="text")
# the longest beginning of a piece that is whole characters: without a lead byte whose others are cut off, and nothing if
# the first byte continues a character
_WHOLE = "CASE WHEN regexp_matches(x, '^[89AB]') THEN '' ELSE decode(unhex(regexp_replace(x, '^((?:..)*?)(?:[CD].|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$', '\\1'))) END"
_BYTE_PIECES = f"SELECT doc_id, s // 512 AS chunk_index, {_WHOLE} AS content, CAST(length({_WHOLE}) AS BIGINT) AS size FROM (SELECT doc_id, s, substring(h, 2 * greatest(s - 16, 0) + 1, 2 * (least(s + 512, n) - greatest(s - 16, 0))) AS x FROM (SELECT doc_id, h, n, unnest(range(0, n, 512)) AS s FROM (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents)))"
_HEADED = rf"""(SELECT doc_id, k, title, level, body, doc_id || '|' || k AS id, CASE WHEN length(body) <= 4000 THEN [body] ELSE {WORDS.format(c='body')} END AS u FROM (
SELECT doc_id, k, max(CASE WHEN f = 1 THEN {STRIP.format(c="regexp_extract(l, '^#{1,2}[ 	]+(.+)$', 1)")} END) AS title, max(CASE WHEN f = 1 THEN length(regexp_extract(l, '^(#+)', 1)) ELSE 0 END) AS level, {STRIP.format(c='string_agg(l, chr(10) ORDER BY i)')} AS body FROM (
SELECT doc_id, i, l, f, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(f) OVER (PARTITION BY doc_id) AS heads FROM (SELECT doc_id, i, l, CAST(regexp_matches(l, '^#{{1,2}}[ 	]+.+$') AS INT) AS f FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM {_MD})))
WHERE k > 0 OR heads = 0 GROUP BY doc_id, k) WHERE body <> '' AND (k = 0 OR length(body) >= 50))"""
_HEAD_CHUNKS = f"SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.k, j.chunk_index) - 1 AS chunk_index, j.content, j.size, h.title, CAST(h.level AS INT) AS level FROM ({joined_sql('u', chr(39) + ' ' + chr(39), 4000, _HEADED, extra=1, group_key='id')}) j JOIN {_HEADED} h USING (id)"

# levels are below the threshold in the first 9 of each 37 steps, which is longer than the pause that ends a stretch
_SILENCE = """WITH p AS (SELECT p_partkey AS media_id, CAST(p_size * 10 + 1 AS BIGINT) AS n FROM part), s AS (SELECT media_id, n, k * 37 + 9 AS a FROM p, range(0, 100) t(k) WHERE k * 37 + 9 < n),
r AS (SELECT media_id, greatest(0.0::DOUBLE, a * 0.1::DOUBLE - 0.1::DOUBLE) AS a, least(n * 0.1::DOUBLE, least(a + 28, n) * 0.1::DOUBLE + 0.1::DOUBLE) AS z FROM s), m AS (SELECT *, greatest(1, CAST(ceil((z - a) / 2.0::DOUBLE) AS BIGINT)) AS n FROM r),
e AS (SELECT media_id, round(a + (z - a) * k / n, 6) AS start, round(a + (z - a) * (k + 1) / n, 6) AS stop FROM (SELECT *, unnest(range(0, n)) AS k FROM m)) SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start) - 1 AS segment, start, stop FROM e"""
# state: the first sentence of the chunk and its size so far; a sentence may close the chunk before it, after it, or both
_TRAIL = "coalesce(list_min(list_filter(range({a}, {z}), lambda j: p[{z} + 1] - p[j + 1] <= 100)), {z})"
_JOINED = "(p[{z} + 1] - p[{a} + 1] + greatest({z} - {a} - 1, 0))"
_CONTEXT = f"""WITH RECURSIVE u AS MATERIALIZED (SELECT doc_id, list(sentence ORDER BY i) AS u, list(length(sentence) ORDER BY i) AS l FROM {_S} GROUP BY doc_id),
w AS (SELECT doc_id, i FROM (SELECT doc_id, i, sim, avg(sim) OVER (PARTITION BY doc_id) AS m, stddev_pop(sim) OVER (PARTITION BY doc_id) AS s FROM {_SIM}) WHERE sim < greatest(0.3, m - s)),
d AS MATERIALIZED (SELECT u.doc_id, u, len(u) AS n, list_prepend(0, list_transform(range(1, len(u) + 1), lambda k: list_sum(list_slice(l, 1, k)))) AS p, coalesce(bs, []) AS bs FROM u LEFT JOIN (SELECT doc_id, list(i) AS bs FROM w GROUP BY doc_id) b USING (doc_id)),
r AS (SELECT doc_id, CAST(-1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS xa, CAST(NULL AS BIGINT) AS xz, CAST(NULL AS BIGINT) AS ya, CAST(NULL AS BIGINT) AS yz FROM d
UNION ALL SELECT doc_id, i, CAST(CASE WHEN after THEN CASE WHEN i + 1 < n THEN {_TRAIL.format(a='b', z='(i + 1)')} ELSE i + 1 END ELSE b END AS BIGINT),
CAST(CASE WHEN after THEN CASE WHEN i + 1 < n THEN {_JOINED.format(a=_TRAIL.format(a='b', z='(i + 1)'), z='(i + 1)')} ELSE 0 END ELSE grown END AS BIGINT), CASE WHEN early THEN a END, CASE WHEN early THEN i END, CASE WHEN after THEN b END, CASE WHEN after THEN i + 1 END
FROM (SELECT *, (list_contains(bs, i) AND grown >= 300) OR grown >= 1000 AS after FROM (SELECT *, CASE WHEN early THEN {_JOINED.format(a='b', z='i')} ELSE size END + p[i + 2] - p[i + 1] + 1 AS grown FROM (
SELECT *, CASE WHEN early THEN {_TRAIL.format(a='a', z='i')} ELSE a END AS b FROM (SELECT r.doc_id, r.i + 1 AS i, r.a, r.size, d.n, d.p, d.bs, r.a < r.i + 1 AND r.size + d.p[r.i + 3] - d.p[r.i + 2] + 1 > 1500 AS early FROM r JOIN d USING (doc_id) WHERE r.i + 1 < d.n))))),
e AS (SELECT doc_id, i * 3 AS o, xa AS a, xz AS z FROM r WHERE xz IS NOT NULL UNION ALL SELECT doc_id, i * 3 + 1, ya, yz FROM r WHERE yz IS NOT NULL
UNION ALL SELECT r.doc_id, r.i * 3 + 2, r.a, d.n FROM r JOIN d USING (doc_id) WHERE r.i = d.n - 1 AND r.a < d.n AND array_to_string(list_slice(u, r.a + 1, d.n), ' ') <> array_to_string(list_slice(u, {_TRAIL.format(a='0', z='d.n').replace('p[', 'd.p[')} + 1, d.n), ' ')),
c AS (SELECT e.doc_id, o, array_to_string(list_slice(u, a + 1, z), ' ') AS content FROM e JOIN d USING (doc_id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM c"""

# parts without stops, and their places; a run closes when it reaches 700, or before it would pass 2000
_SPANS = f"""(SELECT doc_id, text, a + length(x) - length(regexp_replace(x, '^{SPACE}+', '')) AS a, a + length(regexp_replace(x, '{SPACE}+$', '')) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS i FROM (
SELECT doc_id, text, x, k + coalesce(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (SELECT doc_id, text, unnest(string_split(regexp_replace(text, '[.!?]', chr(1), 'g'), chr(1))) AS x, unnest(range(0, len(string_split(regexp_replace(text, '[.!?]', chr(1), 'g'), chr(1))))) AS k FROM documents)) WHERE regexp_matches(x, '[^ \t\n\v\f\r]'))"""
_GREEDY = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT * FROM {_SPANS}), r AS (SELECT doc_id, i, CAST(0 AS BIGINT) AS g, CAST(z - a AS BIGINT) AS total, z - a < 700 AS open FROM s WHERE i = 1
UNION ALL SELECT doc_id, i, CASE WHEN NOT open OR over THEN g + 1 ELSE g END, CAST(CASE WHEN NOT open OR over THEN n ELSE total + n END AS BIGINT), CASE WHEN NOT open THEN n < 700 WHEN over THEN true ELSE total + n < 700 END
FROM (SELECT r.doc_id, s.i, r.g, r.total, r.open, s.z - s.a AS n, r.total + s.z - s.a > 2000 AS over FROM r JOIN s ON r.doc_id = s.doc_id AND s.i = r.i + 1)),
l AS (SELECT doc_id, max(g) AS g FROM r GROUP BY doc_id), o AS (SELECT r.doc_id, r.g, count(*) AS n, bool_and(open) AND max(total) < 200 AND count(*) = 1 AS small FROM r JOIN l ON r.doc_id = l.doc_id AND r.g = l.g GROUP BY r.doc_id, r.g),
f AS (SELECT r.doc_id, r.i, CASE WHEN o.small AND r.g > 0 THEN r.g - 1 ELSE r.g END AS g FROM r LEFT JOIN o ON r.doc_id = o.doc_id AND r.g = o.g),
c AS (SELECT f.doc_id, g, substring(any_value(text), CAST(min(a) AS BIGINT) + 1, CAST(max(z) - min(a) AS BIGINT)) AS content FROM f JOIN s ON f.doc_id = s.doc_id AND f.i = s.i GROUP BY f.doc_id, g)
SELECT doc_id, g AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM c UNION ALL SELECT doc_id, 0, text, CAST(length(text) AS BIGINT) FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM s)"""


def _split_all(units: str, pattern: str) -> str:
    parts = f"flatten(list_transform({units}, lambda y: list_filter(list_transform(string_split(regexp_replace(y, '{pattern}', chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '')))"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE {units} END"


_STAGES = "(SELECT doc_id, [text] AS u FROM documents)"
for _pattern in (rf"(?ms)^#{{1,6}}{SPACE}+.*$", "\n\n+", rf"\n{SPACE}*[-*+]{SPACE}+", rf"\d+\.{SPACE}+"):
    _STAGES = f"(SELECT doc_id, {_split_all('u', _pattern)} AS u FROM {_STAGES})"
_PARTS = f"(SELECT doc_id, k, t, doc_id || '|' || k AS id, CASE WHEN length(t) > 2000 THEN list_filter(list_transform(string_split(regexp_replace(t, '[.!?]+', chr(1), 'g'), chr(1)), lambda x: {STRIP.format(c='x')}), lambda x: x <> '') ELSE [t] END AS u FROM (SELECT doc_id, unnest(u) AS t, unnest(range(0, len(u))) AS k FROM {_STAGES}) WHERE length(t) >= 50)"
_SECTIONS = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, g) - 1 AS chunk_index, content, CAST(length(content) AS BIGINT) AS size FROM (SELECT p.doc_id, p.k, j.chunk_index AS g, CASE WHEN length(p.t) > 2000 THEN j.content || '.' ELSE j.content END AS content FROM ({joined_sql('u', chr(39) + '. ' + chr(39), 2000, _PARTS, count_sep=False, group_key='id')}) j JOIN {_PARTS} p USING (id))"



def _worth(target: int, longest: int) -> str:
    """Quality of a recursive chunk (column c), for a target and a longest size."""
    size = f"least(1.0::DOUBLE, length(c) / {target}) * CASE WHEN length(c) > {longest} THEN 0.5 ELSE 1.0 END"
    return f"(0.4 * ({size}) + 0.4 * least(1.0::DOUBLE, len(string_split(c, '. ')) / 5) + 0.2 * CASE WHEN regexp_matches(c, '[.!?]{SPACE}*$') THEN 1.0 ELSE 0.8 END)::DOUBLE"


# paragraphs, then sentences, then slices, each level inside the kept chunks of the one above that are over its target
_LEVEL0 = f"(SELECT * FROM (SELECT doc_id, chunk_index AS i, content AS c, doc_id || '|' || chunk_index AS id, {_worth(1200, 2500).replace('(c)', '(content)').replace('(c,', '(content,')} AS q FROM ({joined_sql(BLOCKS.format(c='text'), 'chr(10) || chr(10)', 1200, LINED)})) WHERE q >= 0.7)"
_LEVEL1 = f"(SELECT * FROM (SELECT id, chunk_index AS j, content AS c, {_worth(400, 800).replace('(c)', '(content)').replace('(c,', '(content,')} AS q FROM ({joined_sql('u', chr(39) + ' ' + chr(39), 400, '(SELECT id, ' + AFTER_STOP.format(c='c') + ' AS u FROM l0 WHERE length(c) > 400)', group_key='id')})) WHERE q >= 0.7)"
_RECURSIVE = f"""WITH l0 AS MATERIALIZED {_LEVEL0}, l1 AS MATERIALIZED {_LEVEL1},
l2 AS (SELECT * FROM (SELECT *, {_worth(200, 300)} AS q FROM (SELECT id, j, s // 200 AS k, substring(c, s + 1, 200) AS c FROM (SELECT id, j, c, unnest(range(0, length(c), 200)) AS s FROM l1 WHERE length(c) > 200)) WHERE regexp_matches(c, '[^ \t\n\v\f\r]')) WHERE q >= 0.7),
a AS (SELECT doc_id, i, 1 AS x, NULL AS j, NULL AS y, NULL AS k, c, 0 AS level, CAST(i AS VARCHAR) AS path, NULL AS parent_path, q FROM l0
UNION ALL SELECT doc_id, i, 0, j, 1, NULL, l1.c, 1, i || '/' || j, CAST(i AS VARCHAR), l1.q FROM l1 JOIN l0 USING (id)
UNION ALL SELECT doc_id, i, 0, l2.j, 0, k, l2.c, 2, i || '/' || l2.j || '/' || k, i || '/' || l2.j, l2.q FROM l2 JOIN l0 USING (id))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, x, j, y, k) - 1 AS chunk_index, c AS content, CAST(length(c) AS BIGINT) AS size, CAST(level AS INT) AS level, path, parent_path, q AS quality FROM a"""
_LEVELS = f"""WITH r AS MATERIALIZED ({_RECURSIVE}), n AS (SELECT doc_id, parent_path AS path, count(*) AS children FROM r WHERE parent_path IS NOT NULL GROUP BY ALL)
SELECT level, count(*) AS chunks, round(avg(quality), 6) AS mean_quality, round(avg(coalesce(children, 0)), 6) AS mean_children FROM r LEFT JOIN n USING (doc_id, path) GROUP BY level"""
# in the made-up Markdown each line stands alone, so it is a block; lines that open a fence do not occur
_LINE_BLOCKS = f"(SELECT doc_id, list(struct_pack(t := {STRIP.format(c='l')}, kind := CASE WHEN regexp_matches(l, '^{SPACE}*[|]') THEN 'table' WHEN regexp_matches(l, '^#{{1,6}}[ \t]+.+') THEN 'header' WHEN regexp_matches(l, '^{SPACE}*([-*+]|[0-9]+[.]){SPACE}+') THEN 'list' ELSE 'paragraph' END) ORDER BY k) AS u FROM (SELECT doc_id, k, regexp_replace(l, '{SPACE}+$', '') AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM {_MD})) WHERE l <> '' GROUP BY doc_id)"
_BLOCK_PACKS = f"""WITH RECURSIVE u AS MATERIALIZED {_LINE_BLOCKS}, r AS (SELECT doc_id, CAST(1 AS BIGINT) AS i, CAST(0 AS BIGINT) AS g, CAST(length(u[1].t) AS BIGINT) AS len FROM u
UNION ALL SELECT doc_id, i + 1, CASE WHEN over_ THEN g + 1 ELSE g END, CASE WHEN over_ THEN n ELSE len + 2 + n END FROM (SELECT r.doc_id, r.i, r.g, r.len, length(u.u[r.i + 1].t) AS n, r.len + length(u.u[r.i + 1].t) > 1500 AS over_ FROM r JOIN u USING (doc_id) WHERE r.i < len(u.u))),
c AS (SELECT r.doc_id, g, string_agg(u.u[r.i].t, chr(10) || chr(10) ORDER BY r.i) AS content, string_agg(DISTINCT u.u[r.i].kind, ',' ORDER BY u.u[r.i].kind) AS kinds FROM r JOIN u USING (doc_id) GROUP BY ALL)
SELECT doc_id, g AS chunk_index, content, CAST(length(content) AS BIGINT) AS size, kinds FROM c"""

ORACLE_SQL = {
    "q_fitting": f"SELECT strategy, 'medium' AS complexity FROM {_CATALOGUE} WHERE category = 'text' AND speed >= 0.5 AND speed < 0.8",
    "q_pipeline_multi": f"SELECT strategy, count(*) AS chunks FROM (SELECT 'fixed_size' AS strategy FROM ({_char_sql(1024, 0)}) UNION ALL SELECT 'sentence_based' FROM ({joined_sql('uu', chr(39) + ' ' + chr(39), 2000, FALLBACK, most=5, count_sep=False)}) UNION ALL SELECT 'fastcdc' FROM ({_fastcdc(2048, 8192, 65536, 13)})) GROUP BY strategy",
    "q_recursive": _RECURSIVE,
    "q_recursive_stats": _LEVELS,
    "q_md_blocks": _BLOCK_PACKS,
    "q_balanced_greedy": _GREEDY,
    "q_pattern_sections": _SECTIONS,
    "q_silence_segments": _SILENCE,
    "q_context_enriched": _CONTEXT,
    "q_fixed_byte": _BYTE_PIECES,
    "q_md_headers": _HEAD_CHUNKS,
    "q_md_fixed": joined_sql(_WORD_LIST, "' '", 1000, _MD, extra=1),
    "q_semantic_chunks": _SEMANTIC,
    "q_gear": _GEAR,
    "q_rolling_poly": _POLY,
    "q_rolling_rabin": _SHIFT_CUTS,
    "q_fastcdc": _fastcdc(2048, 8192, 65536, 13),
    "q_fastcdc_small": _fastcdc(256, 1024, 4096, 10),
    "q_univ_rolling": _SUMS,
    "q_python_code": _rows(PYTHON_ROWS),
    "q_python_blocks": _rows(PYTHON_BLOCKS),
    "q_brace_code": " UNION ALL ".join(_rows(rows, f", '{name}' AS language") for name, rows in BRACE_ROWS.items()),
    "q_css_code": _rows(CSS_ROWS),
    "q_css_selectors": "SELECT p_partkey AS doc_id, CAST(unnest([0, 1]) AS BIGINT) AS chunk_index, CAST(unnest([1, 0]) AS BIGINT) AS ids, CAST(unnest([2, 0]) AS BIGINT) AS classes, CAST(unnest([1, 0]) AS BIGINT) AS elements FROM part",
    "q_code_indentation": " UNION ALL ".join(f"SELECT p_partkey AS doc_id, CAST({i} AS BIGINT) AS chunk_index, {_text(c)} AS content, CAST(length({_text(c)}) AS BIGINT) AS size FROM part" for i, c in enumerate(INDENTED)),
    "q_code_language": " UNION ALL ".join(f"SELECT doc_id, '{name}' AS template, language, CASE WHEN doc_id % 2 = 0 THEN 'rust' ELSE language END AS by_path FROM (SELECT p_partkey AS doc_id, {_language_sql(_text(t))} AS language FROM part)" for name, t in TEMPLATES.items()),
    "q_csv_parse": "SELECT p_partkey AS doc_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS place, unnest(['id^label^size', p_partkey || '^' || p_name || ', \"x\"^' || p_size, p_partkey || '^' || p_name || ', \"x\"^' || p_size]) AS cells FROM part",
    "q_csv_header_sections": r"""SELECT doc_id, place // 3 + 1 AS section, min(place) AS first, count(*) AS n_rows, string_agg(CASE WHEN place % 3 = 0 THEN regexp_replace(upper(line), '(^|,)', '\1X', 'g') ELSE line END, chr(13) || chr(10) ORDER BY place) AS content FROM """
    + _ROWS
    + " GROUP BY doc_id, place // 3",
    "q_json_array": """SELECT p_partkey AS doc_id, CAST(0 AS BIGINT) AS chunk_index, c AS content, CAST(length(c) AS BIGINT) AS size, 'more.inner.tags' AS path, CAST(0 AS BIGINT) AS first FROM (SELECT p_partkey, '["' || p_type || '","' || p_brand || '","x"]' AS c FROM part)
UNION ALL SELECT p_partkey, s // 10 + 1, c, CAST(length(c) AS BIGINT), 'nums', s FROM (SELECT p_partkey, s, '[' || array_to_string(range(s, least(s + 10, p_size + 1)), ',') || ']' AS c FROM (SELECT p_partkey, p_size, unnest(range(0, p_size + 1, 10)) AS s FROM part))""",
    "q_json_depth": """SELECT p_partkey AS doc_id, CAST(0 AS BIGINT) AS chunk_index, c AS content, CAST(length(c) AS BIGINT) AS size FROM (SELECT p_partkey, '{"more":{"inner":"<truncated_dict_depth_2>","size":' || p_size || '},"name":"' || p_name || '","nums":[' || array_to_string(range(0, p_size + 1), ',') || ']}' AS c FROM part)""",
    "q_json_size": f"SELECT doc_id, chunk_index, '[' || content || ']' AS content, size + 2 AS size FROM ({_EVENTS})",
    "q_similarity_metrics": " UNION ALL ".join(f"SELECT doc_id, round(avg(sim), 6) AS mean_sim, '{name}' AS metric FROM (SELECT doc_id, round({x}, 9) AS sim FROM {_PAIRS} WHERE nv IS NOT NULL) GROUP BY doc_id" for name, x in _METRICS.items()),
    "q_merge_short": _SHORT,
    "q_sentence_pack_overlap": _overlapped("(SELECT doc_id, uu AS u FROM " + FALLBACK + ")", "' '", 5, 1500, 2, 1),
    "q_paragraph_pack_merged": _overlapped(_MERGED, "chr(10) || chr(10)", 3, 1200, 1, 1),
    "q_text_window_lastspace": _LASTSPACE,
    "q_overlap_window_chars": _SPACEWISE,
    "q_pipeline": f"SELECT * FROM ({_PIPELINE}) WHERE size BETWEEN 100 AND 2000",
    "q_doc_size": f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS chunk_index, content, size FROM ({_SIZED}) WHERE length({STRIP.format(c='content')}) >= 50",
    "q_boundary_format": f"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)<(html|body|div|p|head)[ \\t\\n\\v\\f\\r>]') THEN 'html' WHEN regexp_matches(text, '^{SPACE}*<\\?xml') OR regexp_matches(text, '</[A-Za-z][^>]*>') THEN 'xml' WHEN {' + '.join(f'CAST(regexp_matches(text, {m!r}) AS INT)' for m in _FORMAT_MARKS).replace(chr(92) * 2, chr(92))} >= 2 THEN 'markdown' ELSE 'plain' END AS format FROM {_MD}",
    "q_vector_export": "SELECT '{\"id\":' || vec_id || ',\"vector\":[' || array_to_string(list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE), 3) + 0.0 AS VARCHAR)), ',') || '],\"payload\":{\"label\":' || CASE WHEN typeof(label) = 'VARCHAR' THEN '\"' || label || '\"' ELSE CAST(label AS VARCHAR) END || '}}' AS record FROM embeddings",
    "q_catalogue": f"SELECT strategy, category, CAST(speed AS DOUBLE) AS speed, CAST(quality AS DOUBLE) AS quality FROM {_CATALOGUE}",
    "q_recommend": f"SELECT strategy, category, CAST(speed AS DOUBLE) AS speed, CAST(quality AS DOUBLE) AS quality, CAST(round((speed + quality) / 2, 6) AS DOUBLE) AS score FROM {_CATALOGUE} ORDER BY score DESC, strategy LIMIT 5",
}
