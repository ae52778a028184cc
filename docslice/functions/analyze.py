"""Content profiles: structure, complexity, entropy, language, modality, and the choice of a strategy from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docslice.functions import text as T
from docslice.runtime import arrow_rows

WORDS = r"[\p{L}\p{N}_]+"

COMMON = {
    "en": "a all an and as at be but by do for from have he her his in it my not of on one or say she that the their there they this to we will with would you".split(),
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einer er es für hat im in ist mit nach nicht noch sich sie sind um und von werden wie wird zu über".split(),
    "fr": "au avec avoir ce dans de des du en est et il je la le les ne par pas plus pour que qui se son sur tout un une à être".split(),
    "es": "a al como con de del el en es estar este haber hacer la las le lo los más no o para pero por que se ser su tener todo un una y".split(),
}
MARKS = {"en": "th|ing|tion", "de": "sch|ung|ß|ä|ö|ü", "fr": "eau|ç|è|ê|oi", "es": "ñ|ción|ó|í|ll"}


def structure(c: Column) -> dict[str, Column]:
    headings = T.count(c, r"(?m)^#+\s+") + T.count(c, r"(?m)^[A-Z][A-Z\s]+$") + T.count(c, r"(?m)^\d+\.\s+")
    lists = T.count(c, r"(?m)^[ \t]*[-*+][ \t]+") + T.count(c, r"(?m)^[ \t]*\d+\.[ \t]+")
    return {
        "paragraphs": F.size(F.filter(F.split(c, r"\n\s*\n"), lambda x: x.rlike(r"\S"))).cast("long"),
        "sentences": F.size(F.filter(F.split(c, r"[.!?]+"), lambda x: x.rlike(r"\S"))).cast("long"),
        "headings": headings,
        "lists": lists,
        "code": T.count(c, r"```[\s\S]*?```"),
    }


def structure_class(df: DataFrame) -> DataFrame:
    """Adds structure_type to a frame with the columns of structure()."""
    kind = F.when(F.col("code") > 0, "technical_document").when(F.col("headings") > F.col("paragraphs") * 0.1, "structured_document").when(F.col("lists") > F.col("paragraphs") * 0.2, "list_heavy").when((F.col("paragraphs") > 10) & (F.col("headings") < 3), "narrative").otherwise("mixed")
    return df.withColumn("structure_type", kind)


def profile(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    c = T.filled(F.col(text))
    return structure_class(docs.select(key, *(v.alias(k) for k, v in structure(c).items())))


def complexity(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    c = T.filled(F.col(text))
    own = docs.select(key, c.alias("c"), F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(0)).alias("w"), F.filter(F.split(c, r"[.!?]+"), lambda x: x.rlike(r"\S")).alias("s"))
    n = F.size("w")
    diversity = F.size(F.array_distinct("w")) / n
    word = F.length(F.array_join("w", "")) / n
    per_sentence = F.when(F.size("s") > 0, F.size(T.words(F.array_join("s", " "))) / F.size("s")).otherwise(0.0)
    points = T.count(F.col("c"), r"[.,;:!?]") / F.length("c")
    score = F.least(word / 10, F.lit(1.0)) * 0.3 + F.least(per_sentence / 30, F.lit(1.0)) * 0.3 + diversity * 0.2 + F.least(points * 100, F.lit(1.0)) * 0.2
    score = F.when(n > 0, F.round(score, 6)).otherwise(0.0)
    level = F.when(n == 0, "unknown").when(score < 0.3, "simple").when(score < 0.6, "moderate").otherwise("complex")
    return own.select(key, score.alias("score"), F.when(n > 0, F.round(diversity, 6)).alias("diversity"), F.when(n > 0, F.round(word, 6)).alias("word_length"), level.alias("readability"))


def _entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits, distinct = [], []
        for t in b.column(1):
            n = np.bincount(np.frombuffer(t.as_buffer(), np.uint8), minlength=256) if t.is_valid and len(t.as_buffer()) else np.zeros(256, np.int64)
            n = n[n > 0]
            p = n / n.sum() if len(n) else np.ones(1)
            bits.append(round(float(-(p * np.log2(p)).sum()) + 0.0, 6) if len(n) else None)
            distinct.append(len(n) or None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.float64()), pa.array(distinct, pa.int64())], [b.schema.names[0], "entropy", "distinct_bytes"])


def entropy(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Byte entropy and distinct bytes of each text that has any: one count of bytes a text, no shuffle."""
    own = docs.select(F.col(key), F.encode(T.filled(F.col(text)), "UTF-8").alias("b"))
    return arrow_rows(own, _entropies, f"{key} {docs.schema[key].dataType.simpleString()}, entropy double, distinct_bytes long").filter(F.col("entropy").isNotNull())


def language(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores of the known languages on the first 1000 characters (the measure's own definition), and the best."""
    head = F.lower(F.substring(T.filled(F.col(text)), 1, 1000))
    own = docs.select(key, head.alias("h"), F.regexp_extract_all(head, F.lit(WORDS), F.lit(0)).alias("w"))

    def score(lang: str) -> Column:
        known = F.array(*(F.lit(x) for x in COMMON[lang]))
        share = F.when(F.size("w") > 0, F.size(F.filter("w", lambda x: F.array_contains(known, x))) / F.size("w")).otherwise(0.0)
        marks = F.when(F.length("h") > 0, F.least(F.lit(1.0), 1000 * T.count(F.col("h"), MARKS[lang]) / F.length("h") / 100)).otherwise(0.0)
        return F.round(0.7 * share + 0.3 * marks, 6)

    scored = own.select(key, *(score(x).alias(x) for x in COMMON))
    best = F.greatest(*COMMON)
    return scored.withColumn("language", F.coalesce(*(F.when(F.col(x) == best, x) for x in COMMON)))


def scripts(c: Column) -> dict[str, Column]:
    ranges = {"latin": "[ -ɏ]", "cyrillic": "[Ѐ-ӿ]", "arabic": "[؀-ۿ]", "cjk": "[一-鿿]", "hiragana": "[぀-ゟ]", "katakana": "[゠-ヿ]", "hangul": "[가-힯]"}
    return {k: T.count(c, v) for k, v in ranges.items()}


def modality(content: Column) -> Column:
    """Modality of bytes by their first ones."""
    h = F.hex(F.substring(content, 1, 16))
    image = h.rlike("^(89504E47|FFD8FF|47494638|424D|52494646.{8}57454250)")
    sound = h.rlike("^(494433|FFFB|4F676753|664C6143|52494646.{8}57415645)")
    film = h.rlike("^(1A45DFA3|.{8}66747970|52494646.{8}41564920)")
    return F.when(image, "image").when(sound, "audio").when(film, "video").when(h.startswith("25504446") | h.startswith("504B0304"), "mixed").when(F.is_valid_utf8(content.cast("string")), "text").otherwise("mixed")


def encoding(content: Column) -> Column:
    h = F.hex(F.substring(content, 1, 4))
    return F.when(h.startswith("EFBBBF"), "utf-8-sig").when(h.startswith("FFFE0000") | h.startswith("0000FEFF"), "utf-32").when(h.startswith("FFFE") | h.startswith("FEFF"), "utf-16").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("latin-1")


#: Marks at the beginning of a text, the first that fits counts; and encodings that are tried in turn.
BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"))
TRIED = ("utf-8", "utf-16", "utf-32", "ascii", "latin1", "cp1252", "iso-8859-1", "iso-8859-15")


def _encodings(batches: Iterator[pa.RecordBatch], sample: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for c in b.column(1):
            data = (c.as_py() or b"")[:sample]
            found = ("utf-8", 1.0, "empty") if not data else next(((name, 1.0, "mark") for mark, name in BOMS if data.startswith(mark)), None)
            for name in TRIED if found is None else ():
                try:
                    data.decode(name)
                except UnicodeDecodeError:
                    continue
                found = (name, 0.9 if name == "utf-8" else 0.7, "trial")
                break
            out.append(found or ("utf-8", 0.5, "fallback"))
        name, confidence, method = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.string()), pa.array(confidence, pa.float64()), pa.array(method, pa.string())], [b.schema.names[0], "encoding", "confidence", "method"])


def detect_encoding(files: DataFrame, sample: int = 8192, content: str = "content", key: str = "path") -> DataFrame:
    """key, encoding, confidence, method: by a mark, else the first of TRIED that decodes the first `sample` bytes. (Most
    bytes of an even number decode as UTF-16; `encoding` is the rule that reading files uses.)"""
    return arrow_rows(files.select(key, content), lambda batches: _encodings(batches, sample), f"{key} {files.schema[key].dataType.simpleString()}, encoding string, confidence double, method string")


#: Strategy and size limit (bytes) by file ending; the last entry of an ending counts.
BY_EXTENSION = {
    ".txt": "sentence_based", ".md": "markdown", ".markdown": "markdown", ".rst": "paragraph_based", ".log": "fixed_size", ".csv": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json", ".html": "markup",
    ".htm": "markup", ".xml": "markup", ".py": "python_code", ".c": "brace_code", ".h": "brace_code", ".cpp": "brace_code", ".go": "brace_code", ".java": "brace_code", ".js": "brace_code", ".jsx": "brace_code",
    ".ts": "brace_code", ".tsx": "brace_code", ".css": "css_code", ".scss": "css_code", ".pdf": "pdf", ".doc": "document", ".docx": "document", ".odt": "document", ".rtf": "document", ".mp3": "time_segments",
    ".wav": "time_segments", ".mp4": "time_segments", ".avi": "time_segments", ".png": "image_grid", ".jpg": "image_grid", ".svg": "image_grid", ".bin": "fastcdc", ".zip": "fastcdc",
}
LARGE = 10 * 1024 * 1024


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def select_strategy(files: DataFrame, path: str = "path", size: str = "length") -> DataFrame:
    """Adds extension and strategy: by file ending; files over LARGE are cut by content whatever they are."""
    known = F.create_map(*(F.lit(x) for kv in BY_EXTENSION.items() for x in kv))
    ext = extension(F.col(path))
    return files.withColumns({"extension": ext, "strategy": F.when(F.col(size) > LARGE, "fastcdc").otherwise(F.coalesce(F.element_at(known, ext), F.lit("fixed_size")))})


def auto_select(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Strategy by content: markup and data by content, structure, then repetition and length."""
    c = T.filled(F.col(text))
    n = F.length(c)
    marks = T.count(c, r"(?m)^#{1,6} ") + T.count(c, r"(?m)^[-*+] ") + T.count(c, r"\n\n")
    shape = F.least(F.lit(1.0), F.when(n > 0, marks / (n / 1000)).otherwise(0.0))
    kind = F.when(c.rlike(r"^\s*[\[{]") & F.try_parse_json(c).isNotNull(), "json").when(c.rlike(r"(?i)^\s*(<!doctype|<html|<\?xml)"), "markup").when(T.count(c, r"(?m)^#{1,6} ") >= 2, "markdown").when(n > 100_000, "fastcdc").when(shape > 0.5, "paragraph_based").otherwise("sentence_based")
    return docs.select(key, F.round(shape, 6).alias("structure"), kind.alias("strategy"))
