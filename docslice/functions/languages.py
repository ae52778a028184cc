"""Language of a text by common words and marks, with the scripts it is written in, and advice by language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docslice.functions import text as T
from docslice.operators.kernel import spread
from docslice.runtime import arrow_rows

WORDS = r"[\p{L}\p{N}_]+"

#: Common words of each language; the first five (of the marks) count a second time.
COMMON = {
    "en": ("the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"),
    "es": ("el", "la", "de", "que", "y", "en", "un", "es", "se", "no", "te", "lo"),
    "fr": ("le", "de", "et", "à", "un", "il", "être", "en", "avoir", "que", "pour"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"),
    "it": ("il", "di", "che", "e", "la", "per", "un", "in", "con", "da", "su", "come"),
    "pt": ("o", "de", "e", "do", "da", "em", "um", "para", "é", "com", "não", "uma"),
    "ru": ("в", "и", "не", "на", "я", "быть", "он", "с", "а", "как", "это", "вы"),
    "zh": ("的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一"),
    "ja": ("の", "に", "は", "を", "た", "が", "で", "て", "と", "し", "れ", "さ"),
    "ar": ("في", "من", "على", "إلى", "عن", "مع", "هذا", "هذه", "التي", "الذي", "كان", "لم"),
}
#: Marks of each language; whole words, but for the two that are written without spaces.
MARKS = {
    "en": ("the", "and", "of", "to", "a"),
    "es": ("el", "la", "de", "que", "y"),
    "fr": ("le", "de", "et", "à", "un"),
    "de": ("der", "die", "und", "in", "den"),
    "it": ("il", "di", "che", "e", "la"),
    "pt": ("o", "de", "e", "do", "da"),
    "ru": ("в", "и", "не", "на", "я"),
    "zh": ("的", "了", "在", "是", "我"),
    "ja": ("の", "に", "は", "を", "た"),
    "ar": ("في", "من", "على", "إلى", "عن"),
}
UNSPACED = ("zh", "ja")
#: Ranges of code points, and the language that a script stands for where no words tell.
SCRIPTS = {"latin": (" ", "ɏ", "en"), "cyrillic": ("Ѐ", "ӿ", "ru"), "arabic": ("؀", "ۿ", "ar"), "cjk": ("一", "鿿", "zh"), "hiragana": ("぀", "ゟ", "ja"), "katakana": ("゠", "ヿ", "ja"), "hangul": ("가", "힯", "ko")}
#: Ways to cut by sentence, word and character that suit a language.
ADVICE = {
    "unspaced": (("zh", "ja"), "character_based,semantic_basic", "character_based", "character_based,fixed_size"),
    "arabic": (("ar",), "sentence_based,boundary_aware", "word_fixed_length,boundary_aware", "character_based,fixed_size"),
    "compound": (("de",), "sentence_based,compound_aware", "word_fixed_length,compound_aware", "character_based"),
    "spaced": (("en", "fr", "es", "it", "pt"), "sentence_based,paragraph_based", "word_fixed_length,token_based", "character_based,fixed_size"),
    "inflected": (("ru",), "sentence_based,boundary_aware", "word_fixed_length,morphological_aware", "character_based"),
    "other": ((), "sentence_based,boundary_aware", "word_fixed_length,character_based", "character_based,fixed_size"),
}


def _member(words: Column, of: tuple[str, ...]) -> Column:
    return F.size(F.filter(words, lambda x: x.isin(*of)))


def _staged(df: DataFrame) -> DataFrame:
    """df with its columns computed once for each row: projections above a generator are not folded into those below,
    which would compute a column anew wherever it is used."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def scores(docs: DataFrame, sample: int = 1000, text: str = "text", key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """key and a score for each language, on the first `sample` characters: .7 of the share of common words and .3 of
    the marks for each thousand characters, 1 at most. more: columns that are kept."""
    head = F.lower(F.substring(T.filled(F.col(text)), 1, sample))
    own = docs.select(key, *more, F.col(text).alias("_text"), head.alias("h"), F.regexp_extract_all(head, F.lit(WORDS), F.lit(0)).alias("all"))
    # only words of some list are looked for in each of them
    known = sorted({x for table in (COMMON, MARKS) for own_words in table.values() for x in own_words})
    own = _staged(own).select(key, *more, "_text", "h", F.size("all").alias("n"), F.filter("all", lambda x: x.isin(*known)).alias("w"))
    own = _staged(own)
    out = []
    for lang in COMMON:
        share = _member(F.col("w"), COMMON[lang]) / F.col("n")
        if lang in UNSPACED:
            marks = sum((F.length("h") - F.length(F.replace(F.col("h"), F.lit(m), F.lit(""))) for m in MARKS[lang]), F.lit(0))
        else:
            marks = _member(F.col("w"), MARKS[lang])
        value = 0.7 * share + 0.3 * F.least(F.lit(1.0), marks / F.length("h") * 1000)
        out.append(F.round(F.when(F.col("n") > 0, value).otherwise(0.0), 6).alias(lang))
    return own.select(key, *more, "_text", *out)


def _profiles(batches: Iterator[pa.RecordBatch], sample: int, key: str) -> Iterator[pa.RecordBatch]:
    """key, head, whether there is white space only, and the number of characters of each script, by code points."""
    for b in batches:
        texts = [t or "" for t in b.column(1).to_pylist()]
        counts: list[list[int]] = [[] for _ in SCRIPTS]
        for t in texts:
            code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
            for own, (first, last, _) in zip(counts, SCRIPTS.values(), strict=True):
                own.append(int(np.count_nonzero((code >= ord(first)) & (code <= ord(last)))))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t[:sample] for t in texts], pa.string()), pa.array([not t.strip(" \t\n\x0b\f\r") for t in texts], pa.bool_()), *(pa.array(own, pa.int64()) for own in counts)], [key, "_head", "_blank", *(f"_{k}" for k in SCRIPTS)])


def script_names(counts: dict[str, Column]) -> Column:
    """Scripts of at least 5 % of the characters that are of a known script, in their fixed order."""
    total = sum(counts.values(), F.lit(0))
    return F.array_compact(F.array(*(F.when((total > 0) & (n >= 0.05 * total), F.lit(k)) for k, n in counts.items())))


def detect(docs: DataFrame, sample: int = 1000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, language, confidence, scripts, top (the three best, best first). Without words that tell, the first script
    decides, at confidence .3. Scripts are counted in one pass over the text; only its head goes on."""
    kept = ("_blank", *(f"_{k}" for k in SCRIPTS))
    schema = StructType([docs.schema[key], *StructType.fromDDL(", ".join(["_head string", "_blank boolean", *(f"_{k} long" for k in SCRIPTS)]))])
    heads = arrow_rows(spread(docs.select(key, text)), partial(_profiles, sample=sample, key=key), schema)
    own = _staged(scores(heads, sample, "_head", key, kept)).withColumn("scripts", script_names({k: F.col(f"_{k}") for k in SCRIPTS}))
    ranked = F.array_sort(F.array(*(F.struct((-F.col(k)).alias("s"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(COMMON))))
    ranked = F.filter(ranked, lambda x: x["s"] < 0)
    by_script = F.element_at(F.create_map(*(F.lit(x) for k, (_, _, lang) in SCRIPTS.items() for x in (k, lang))), F.try_element_at("scripts", F.lit(1)))
    blank = F.col("_blank")
    found = _staged(own.withColumn("r", F.when(blank, F.lit(None)).otherwise(ranked)))
    told = F.size("r") > 0
    script = F.when(blank, F.array().cast("array<string>")).otherwise(F.col("scripts"))
    return found.select(
        key,
        F.when(told, F.col("r")[0]["k"]).otherwise(F.coalesce(F.when(~blank, by_script), F.lit("unknown"))).alias("language"),
        F.when(told, -F.col("r")[0]["s"]).otherwise(F.when(~blank & by_script.isNotNull(), 0.3).otherwise(0.0)).alias("confidence"),
        F.array_join(script, ",").alias("scripts"),
        F.array_join(F.transform(F.slice(F.coalesce("r", F.array().cast("array<struct<s:double,i:int,k:string>>")), 1, 3), lambda x: x["k"]), ",").alias("top"),
    )


def advice(language: Column) -> dict[str, Column]:
    """by_sentence, by_word, by_character: names of strategies for a language column."""
    out = {}
    for j, name in enumerate(("by_sentence", "by_word", "by_character"), 1):
        value = F.lit(ADVICE["other"][j])
        for langs, *names in ADVICE.values():
            if langs:
                value = F.when(language.isin(*langs), names[j - 1]).otherwise(value)
        out[name] = value
    return out
