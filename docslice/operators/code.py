"""Source code: elements by language, packed into chunks, or plain line blocks.

Python is parsed; brace languages are scanned with strings and comments left out; CSS by rules. Elements have a kind, a
name and lines; what belongs to no element can be emitted as `rest`.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docslice.operators.kernel import chunk_rows

Found = tuple[str, str, int, int]  # kind, name, first and last line, from 1

STARTS: dict[str, list[tuple[str, re.Pattern]]] = {
    "c": [("struct", re.compile(r"^\s*(?:typedef\s+)?struct\s+(\w+)[^;]*$")), ("class", re.compile(r"^\s*class\s+(\w+)[^;]*$")), ("function", re.compile(r"^[\w:<>*&~\s]+?\s[*&]*([\w:~]+)\s*\([^;]*$"))],
    "javascript": [
        ("class", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)")),
        ("type", re.compile(r"^\s*(?:export\s+)?(?:interface|type|enum)\s+(\w+)")),
        ("function", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w*)\s*\(")),
        ("function", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)")),
        ("method", re.compile(r"^\s+(?:async\s+|static\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\([^)]*\)\s*\{")),
    ],
    "go": [("function", re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[\(\[]")), ("struct", re.compile(r"^type\s+(\w+)\s+struct\b")), ("interface", re.compile(r"^type\s+(\w+)\s+interface\b"))],
    "java": [
        ("class", re.compile(r"^\s*(?:[\w@]+\s+)*class\s+(\w+)")),
        ("interface", re.compile(r"^\s*(?:[\w@]+\s+)*interface\s+(\w+)")),
        ("enum", re.compile(r"^\s*(?:[\w@]+\s+)*enum\s+(\w+)")),
        ("method", re.compile(r"^\s*(?!return\b|new\b|else\b|throw\b)(?:[\w<>\[\],?@]+\s+)+(\w+)\s*\([^;]*$")),
    ],
}
LINES: dict[str, list[tuple[str, re.Pattern]]] = {
    "c": [("preprocessor", re.compile(r"^\s*#\s*(\w+)"))],
    "javascript": [("import", re.compile(r"^\s*import\s+(.*?);?\s*$")), ("export", re.compile(r"^\s*export\s+\{(.*)$"))],
    "go": [("package", re.compile(r"^package\s+(\w+)")), ("import", re.compile(r"^import\s+(\"[^\"]+\"|\w+)")), ("type", re.compile(r"^type\s+(\w+)\s+(?!struct\b|interface\b)\S"))],
    "java": [("package", re.compile(r"^package\s+([\w.]+)")), ("import", re.compile(r"^import\s+([\w.*\s]+);")), ("field", re.compile(r"^\s+(?!return\b|throw\b|break\b|continue\b|assert\b|yield\b)(?:(?:private|public|protected|static|final|volatile|transient)\s+)*[\w<>\[\],.]+\s+(\w+)\s*(?:=[^;(]*)?;"))],
}
CONTROL = frozenset("if for while switch catch return else do try sizeof".split())
QUIET = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)")


def quiet(code: str) -> str:
    """The code with strings and comments blanked, line for line."""
    return QUIET.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def python_elements(code: str) -> list[Found] | None:
    """Functions (async as well), classes, methods and imports; none if the code does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError):
        return None
    out: list[Found] = []

    def walk(node: ast.AST, inside: bool) -> None:
        for c in ast.iter_child_nodes(node):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(c, ast.ClassDef) else "method" if inside else "function"
                first = min([c.lineno, *(d.lineno for d in c.decorator_list)])
                out.append((kind, c.name, first, c.end_lineno or c.lineno))
                walk(c, isinstance(c, ast.ClassDef))
            elif isinstance(c, (ast.Import, ast.ImportFrom)):
                out.append(("import", ",".join(a.name for a in c.names), c.lineno, c.end_lineno or c.lineno))
            else:
                walk(c, inside)

    walk(tree, False)
    return sorted(out, key=lambda x: (x[2], -x[3]))


def brace_elements(code: str, language: str) -> list[Found]:
    """Elements that open a brace, members included, and one-line elements."""
    lines, whole = quiet(code).split("\n"), code.split("\n")
    out: list[Found] = []
    for i, line in enumerate(lines):
        # names may hold strings, so these patterns see the line as it is, if what it begins with is code
        begun = whole[i].split(maxsplit=1)[:1] == line.split(maxsplit=1)[:1]
        for kind, pattern in LINES[language]:
            if begun and (m := pattern.match(whole[i])):
                out.append((kind, m[1].strip(), i + 1, i + 1))
                break
        else:
            for kind, pattern in STARTS[language]:
                m = pattern.match(line)
                if not m or m[1] in CONTROL:
                    continue
                end = _closing(lines, i)
                if end is not None:
                    out.append((kind, m[1], i + 1, end + 1))
                    break
                if language == "javascript" and kind in ("function", "type"):
                    out.append((kind, m[1], i + 1, i + 1))
                    break
    return out


def _closing(lines: list[str], first: int, reach: int = 5) -> int | None:
    """Line of the brace that closes the one opened at `first` or a few lines on; none if a statement ends before."""
    depth, opened = 0, False
    for j in range(first, len(lines)):
        for c in lines[j]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
                if opened and depth == 0:
                    return j
            elif c == ";" and not opened:
                return None
        if not opened and j - first >= reach:
            return None
    return len(lines) - 1 if opened else None


SELECTORS = (("id", r"#[\w-]+"), ("class", r"\.[\w-]+"), ("element", r"(?:^|[\s>+~])[a-zA-Z][\w-]*"), ("pseudo", r":[\w-]+"), ("attribute", r"\[[^\]]+\]"), ("universal", r"\*"))


def specificity(selector: str) -> tuple[int, int, int]:
    s = re.sub(r"\[[^\]]*\]", lambda m: "[]", selector)
    elements = len(re.findall(r"(?:^|[\s>+~,])[a-zA-Z][\w-]*|::[\w-]+", s))
    return len(re.findall(r"#[\w-]+", s)), len(re.findall(r"\.[\w-]+|\[\]|(?<!:):[\w-]+", s)), elements


def selector_type(selector: str) -> str:
    return next((k for k, p in SELECTORS if re.search(p, selector)), "other")


def css_elements(code: str) -> list[Found]:
    """Rules, media queries, mixins and other at-rules, at the top level."""
    text = re.sub(r"/\*[\s\S]*?(?:\*/|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), code)
    out: list[Found] = []
    depth = begin = 0
    for m in re.finditer(r"[{};]", text):
        if m[0] == "{":
            if depth == 0:
                head, line = text[begin : m.start()], text.count("\n", 0, begin + len(text[begin:]) - len(text[begin:].lstrip()))
                start = (head.strip(), line)
            depth += 1
        elif m[0] == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                head, line = start
                kind = "media_query" if head.startswith("@media") else "mixin" if head.startswith("@mixin") else "at_rule" if head.startswith("@") else "rule"
                out.append((kind, head, line + 1, text.count("\n", 0, m.end()) + 1))
                begin = m.end()
        elif depth == 0:
            head = text[begin : m.start()].strip()
            if head.startswith("@"):
                line = text.count("\n", 0, m.end())
                out.append(("at_rule", head, line + 1, line + 1))
            begin = m.end()
    return out


def line_blocks(code: str, most: int) -> Iterator[tuple]:
    lines = code.split("\n")
    for i in range(0, len(lines), most):
        part = lines[i : i + most]
        if any(x.strip() for x in part):
            yield "\n".join(part), "lines", "", i + 1, i + len(part)


def elements_of(code: str, language: str) -> list[Found] | None:
    if language == "python":
        return python_elements(code)
    return css_elements(code) if language == "css" else brace_elements(code, language)


def code_chunks(code: str | None, language: str, kinds: tuple[str, ...] | None, most: int, rest: bool) -> Iterator[tuple]:
    """kinds: elements of these kinds; none: elements packed to `most` lines (logical blocks)."""
    code = code or ""
    found = elements_of(code, language)
    if found is None:
        yield from line_blocks(code, most)
        return
    lines = code.split("\n")
    if kinds:
        used = set()
        for kind, name, a, z in found:
            if kind in kinds:
                used.update(range(a, z + 1))
                yield "\n".join(lines[a - 1 : z]), kind, name, a, z
        if rest and (left := [x for i, x in enumerate(lines, 1) if i not in used and x.strip()]):
            yield "\n".join(left), "rest", "", 1, len(lines)
        return
    at, start = 1, 1
    for _, _, a, z in [f for f in found if not any(g[2] <= f[2] and f[3] <= g[3] and g is not f for g in found)]:
        if z - start + 1 > most and a > start:
            yield "\n".join(lines[start - 1 : a - 1]), "block", "", start, a - 1
            start = a
        at = z
    if start <= len(lines) and any(x.strip() for x in lines[start - 1 :]):
        yield "\n".join(lines[start - 1 :]), "block", "", start, max(at, len(lines))


SCHEMA = "kind string, name string, start_line int, end_line int"


def code(df: DataFrame, language: str, kinds: tuple[str, ...] | None = None, max_lines: int = 100, rest: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(code_chunks, language=language, kinds=kinds, most=max_lines, rest=rest), [text], SCHEMA, key)


def code_lines(df: DataFrame, max_lines: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Blocks of lines, in closed form."""
    from docslice.operators.closed import exploded, starts

    staged = df.select(key, F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("l"))
    return exploded(staged, F.transform(starts(F.size("l"), max_lines), lambda s: F.array_join(F.slice("l", s + 1, F.lit(max_lines)), "\n")), key)


def indented(text: str | None, most: int) -> Iterator[str]:
    """Blocks that begin at lines without indentation, packed to `most` lines."""
    blocks: list[list[str]] = []
    for line in (text or "").split("\n"):
        if not blocks or (line.strip() and not line[0].isspace()):
            blocks.append([])
        blocks[-1].append(line)
    now: list[str] = []
    for b in blocks:
        if now and len(now) + len(b) > most:
            yield "\n".join(now)
            now = []
        now += b
    if any(x.strip() for x in now):
        yield "\n".join(now)


def code_indentation(df: DataFrame, max_lines: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    return chunk_rows(df, partial(indented, most=max_lines), [text], key=key)


#: File endings of the languages.
ENDINGS: dict[str, tuple[str, ...]] = {
    "python": (".py", ".pyx", ".pyi"), "javascript": (".js", ".jsx", ".ts", ".tsx"), "java": (".java",), "c_cpp": (".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx"), "go": (".go",), "rust": (".rs",), "ruby": (".rb", ".rbw"),
    "php": (".php", ".phtml", ".php3", ".php4", ".php5"), "csharp": (".cs",), "swift": (".swift",), "kotlin": (".kt", ".kts"), "scala": (".scala", ".sc"), "r": (".r", ".R"), "shell": (".sh", ".bash", ".zsh", ".fish"),
    "perl": (".pl", ".pm"), "lua": (".lua",), "sql": (".sql",), "matlab": (".m",),
}
#: What a text holds in each language; the first language with an entry all of whose words are there, and
#: none of the words behind a minus.
CONTENT: tuple[tuple[str, tuple[tuple[str, ...], ...]], ...] = (
    ("python", (("def ", ":", "-end"),)),
    ("ruby", (("def ", "end"), ("class ", "@"))),
    ("javascript", (("function ",), ("=>",), ("const ",))),
    ("java", (("public class ",), ("import java.",), ("public static void main",))),
    ("c_cpp", (("#include",), ("int main(",), ("using namespace",))),
    ("go", (("func ", "package "),)),
    ("rust", (("fn ", "use ", "mod "),)),
    ("php", (("<?php",), ("function ", "$"))),
    ("csharp", (("using System",), ("namespace ", "class "))),
    ("swift", (("import Foundation",), ("func ", "var "))),
    ("kotlin", (("fun ",), ("val ",), ("var ", "kotlin"))),
    ("scala", (("def ", "object "), ("trait ",))),
    ("r", (("function(",), ("<-", "library("))),
    ("shell", (("#!/bin/bash",), ("#!/bin/sh",), ("echo ",))),
    ("perl", (("sub ", "$", "@"),)),
    ("lua", (("function ", "end", "local "),)),
    ("sql", (("SELECT ",), ("CREATE TABLE",))),
    ("matlab", (("function ", "=", "%"),)),
)
#: Languages whose words count in any case.
ANY_CASE = {"sql": F.upper, "kotlin": F.lower}


def guess_language(c: Column, path: Column | None = None) -> Column:
    """Language by the ending of a path, else by what the text holds; `generic` if nothing tells."""

    def holds(language: str, words: tuple[str, ...]) -> Column:
        ok = F.lit(True)
        for w in words:
            changed = ANY_CASE[language](c) if language == "sql" or w == "kotlin" else c
            ok &= ~c.contains(w[1:]) if w.startswith("-") else changed.contains(w)
        return ok

    found = F.lit("generic")
    for language, ways in reversed(CONTENT):
        for words in ways:
            found = F.when(holds(language, words), language).otherwise(found)
    if path is None:
        return found
    ending = F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)
    known = F.create_map(*(F.lit(x) for language, endings in ENDINGS.items() for e in endings for x in (e, language)))
    return F.coalesce(F.element_at(known, ending), F.element_at(known, F.lower(ending)), found)


def without_comments(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"/\*[\s\S]*?\*/", ""), r"(?m)(//|#(?!include|define)).*$", "")
