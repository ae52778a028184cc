"""Files, tokens, PDF, configuration, plug-ins and the command line."""

import json
import os
import re
import subprocess
import sys
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docslice.__main__ import main
from docslice.functions import analyze, languages, tokens
from docslice.functions import text as T
from docslice.operators import closed, feedback, media, model, pdf, topics, vectors, windows
from docslice.plans import catalog, config, more
from docslice.runtime import scratch
from docslice.sources import files
from docslice.streaming import chunks as streams


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("Plain text. ÄÖ", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes(b"\xef\xbb\xbfmarked")
    (tmp_path / "c.txt").write_bytes("wide é".encode("utf-16"))
    (tmp_path / "d.txt").write_bytes(b"latin \xe9\xff")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.md").write_text("# Head\n\nbody\n", encoding="utf-8")
    (tmp_path / "f.bin").write_bytes(bytes(range(256)))
    (tmp_path / "empty.txt").write_text("")
    return str(tmp_path)


def test_files_of_a_folder(spark, folder):
    got = {r["path"].rpartition("/")[2]: (r["text"], r["encoding"]) for r in files.text_files(spark, folder, "*.txt").collect()}
    assert got == {"a.txt": ("Plain text. ÄÖ", "utf-8"), "b.txt": ("marked", "utf-8-sig"), "c.txt": ("wide é", "utf-16"), "d.txt": ("latin éÿ", "latin-1")}
    # Spark leaves empty files out
    kinds = {r["path"].rpartition("/")[2]: (r["extension"], r["strategy"], r["modality"], r["length"]) for r in files.catalogued(spark, folder).collect()}
    assert kinds["e.md"] == (".md", "markdown", "text", 13) and kinds["f.bin"] == (".bin", "fastcdc", "mixed", 256) and len(kinds) == 6
    assert files.binary_files(spark, folder, "*.md", recursive=False).count() == 0


@pytest.mark.parametrize("form", ["parquet", "json", "csv", "text", "yaml"])
def test_dumps_of_chunks(spark, tmp_path, form):
    rows = [(1, 0, 'a "b"\nc', 7), (2, 0, "ü", 1)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_index long, content string, size long")
    path = str(tmp_path / "out")
    files.write_chunks(chunks, path, form)
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()) if form != "parquet" else ""
    if form == "yaml":
        assert sorted(json.loads(x[2:])["content"] for x in text.splitlines() if x) == sorted(r[2] for r in rows)
    elif form == "text":
        assert sorted(text.split("\n\n")) and "ü" in text and 'a "b"\nc' in text
    elif form == "csv":
        assert "ü" in text
    else:
        assert sorted(map(tuple, spark.read.schema(chunks.schema).format(form).load(path).collect())) == rows
    assert "sum" in files.report(chunks.agg(F.sum("size").alias("sum")), "title")


def test_json_lines_and_csv(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1}\nno json\n[2]\n')
    assert files.json_lines(spark, str(tmp_path / "x.jsonl")).count() == 2
    (tmp_path / "x.csv").write_text('a,b\n1,"two\nlines"\n')
    assert [tuple(r) for r in files.csv_files(spark, str(tmp_path / "x.csv")).collect()] == [("1", "two\nlines")]


def test_tokens_are_the_librarys(spark, sf):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    lib = tokens.tokenizer(path)
    want = {i: lib.encode(t, add_special_tokens=False) for i, t in text.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.counted(docs, path).collect()} == {i: len(e.ids) for i, e in want.items()}
    got: dict = {}
    for r in tokens.token_spans(docs, path, 50, 10).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["content"], r["n_tokens"]))
    for i, e in want.items():
        own, a = [], 0
        while a < len(e.ids) and (not a or a + 10 < len(e.ids)):
            z = min(a + 50, len(e.ids))
            own.append((len(own), text[i][e.offsets[a][0] : e.offsets[z - 1][1]], z - a))
            a += 40
        assert got.get(i, []) == own


def test_token_spans_hold_one_text_at_a_time():
    """A batch of many texts takes no more memory than its longest one; a process of its own measures that."""
    code = """
import resource, sys
import pyarrow as pa, public_tokenizers
from docslice.functions import tokens
spans = lambda texts: sum(b.num_rows for b in tokens._spans(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])]), public_tokenizers.path("byte_bpe_50k.json"), 200, 20, "doc_id"))
text = " ".join(f"word{k * 7919 % 10007} and so on" for k in range(2000))
first = spans([text])
peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert spans([text] * 120) == 120 * first
sys.exit(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - peak > 100_000)
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def _pdf(parts: dict[int, bytes]) -> bytes:
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in parts.items()) + b"%%EOF"


def test_pdf(spark):
    page = b"BT /F1 9 Tf (One \\(1\\) \\101) Tj T* <0041> Tj ET BT /F2 9 Tf 0 -9 Td <00010002> Tj ET"
    packed = zlib.compress(page)
    cmap = b"1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange"
    inner = b"20 0 21 27 <</Type /Page /Parent 2 0 R>> <</Type /Pages /Kids [3 0 R 20 0 R]>>"
    data = _pdf(
        {
            1: b"<</Type /Catalog /Pages 2 0 R>>", 2: b"<</Type /Pages /Kids [3 0 R 9 0 R] /Count 2>>", 3: b"<</Type /Page /Parent 2 0 R /Contents 4 0 R /Resources <</Font <</F1 6 0 R /F2 5 0 R>> >> >>",
            4: b"<</Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream" % (len(packed), packed), 5: b"<</Type /Font /ToUnicode 7 0 R>>", 6: b"<</Type /Font>>", 7: b"<</Length 1>>\nstream\n%s\nendstream" % cmap,
            9: b"<</Type /Page /Parent 2 0 R /Contents [10 0 R]>>", 10: b"<<>>\nstream\nBT [(a) -50 (b) -900 (c)] TJ (d) ' ET\nendstream",
        }
    )
    assert list(pdf.page_texts(data)) == ["One (1) A\n\x00A\nHi", "ab c\nd"]
    assert sorted(pdf.objects(_pdf({8: b"<</Type /ObjStm /N 2 /First 11>>\nstream\n%s\nendstream" % inner}))) == [8, 20, 21]
    for odd in (None, b"", b"no pdf", data[:200], b"\x00" * 50):
        assert all(isinstance(t, str) for t in pdf.page_texts(odd))
    bomb = zlib.compress(b"(" + b"x" * 1000 + b") Tj ")
    assert pdf._unpacked(b"<</Filter /FlateDecode>>\nstream\n" + bomb[:20] + b"\nendstream") is not None
    frame = spark.createDataFrame([("a", bytearray(data)), ("b", None)], "path string, content binary")
    got = [tuple(r) for r in pdf.pdf_pages(frame, 2).collect()]
    assert got == [("a", 0, "One (1) A\n\x00A\nHi\n\nab c\nd", 23, 1, 2)]
    assert [r["size"] for r in pdf.pdf_pages(frame, 2, 10).collect()] == [10, 10, 3]


def test_byte_windows_and_offsets(spark):
    data = "aé".encode() * 5
    frame = spark.createDataFrame([("x", bytearray(data)), ("y", bytearray(b""))], "path string, content binary")
    got = [(r["start"], r["n_bytes"], r["modality"], r["text"]) for r in windows.byte_windows(frame, 4, 2).orderBy("window").collect()]
    want = []
    for p in range(0, len(data), 4):
        a, z = max(0, p - 2), min(len(data), p + 4)
        try:
            want.append((a, z - a, "text", data[a:z].decode()))
        except UnicodeDecodeError:
            want.append((a, z - a, "mixed", None))
    assert got == want
    chunks = spark.createDataFrame([(0, 0, 4), (1, 4, 3)], "k int, start long, n_bytes long")
    assert [r["k"] for r in windows.chunk_at(chunks, 4).collect()] == [1] and windows.chunk_at(chunks, 7).count() == 0


def test_normal_forms(spark):
    texts = ["ﬁne①２", "a b—c “d” ‘e’　f", "é", None, ""]
    got = [r["text"] for r in T.normalised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0] == unicodedata.normalize("NFKC", texts[0]) and got[1] == "a b—c \"d\" 'e' f".replace("—", "-") and got[2:] == ["é", None, ""]


def test_parents_and_children(spark):
    rows = spark.createDataFrame([(1, i, f"c{i}") for i in range(4)], "doc_id long, chunk_index long, content string")
    made = model.with_children(model.modelled(rows, "x", parent=F.when(F.col("chunk_index") > 1, F.lit("1_1"))))
    got = {r["id"]: (r["parent_id"], r["children_ids"]) for r in made.collect()}
    assert got == {"1_0": (None, []), "1_1": (None, ["1_2", "1_3"]), "1_2": ("1_1", []), "1_3": ("1_1", [])}


def test_configuration(spark, tmp_path, monkeypatch):
    text = '{"before": ["spaces"], "strategy": "fixed_size", "settings": {"size": 10}, "after": [{"step": "filter", "least": 2}]}'
    own = config.parsed(text)
    assert config.checked(own) == [] and config.checked({"strategy": "x", "y": 1, "after": [{"step": "z"}]}) == ["unknown field y", "unknown strategy x", "unknown step z after"]
    assert config.with_environment(own, {"DOCSLICE_SETTINGS_SIZE": "20", "DOCSLICE_SETTINGS_UNIT": "word", "DOCSLICE_STRATEGY": "recursive"}) == own | {"strategy": "recursive", "settings": {"size": 20, "unit": "word"}}
    (tmp_path / "c.json").write_text(text)
    assert config.read(spark, str(tmp_path / "c.json")) == own
    with pytest.raises(ValueError):
        config.parsed("[1]")


PLUGIN = '''
from pyspark.sql import functions as F


def halves(df, text="text", key="doc_id"):
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / 2)).cast("int")
    parts = F.array(F.substring(F.col(text), F.lit(1), n), F.substring(F.col(text), n + 1, F.lit(1 << 30)))
    return df.select(key, F.posexplode(F.filter(parts, lambda x: x != "")).alias("chunk_index", "content"))


def broken(df):
    return df.select("doc_id", F.lit(1).alias("chunk_index"), F.lit(" ").alias("content"))


def raising(df):
    raise KeyError("x")


STRATEGIES = {"test_halves": halves, "test_broken": broken, "test_raising": raising}
'''


def test_plug_ins_and_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "plug_in_of_tests.py").write_text(PLUGIN)
    docs = spark.createDataFrame([(1, "abcdef"), (2, "x")], "doc_id long, text string")
    try:
        own = config.load(str(tmp_path / "plug_in_of_tests.py"))
        assert config.validate(own["test_halves"], docs) == []
        assert config.validate(own["test_broken"], docs) == ["2 empty chunks", "chunks are not numbered from 0 without gaps"]
        assert config.validate(own["test_raising"], docs)[0].startswith("raised KeyError")
        docs.write.parquet(str(tmp_path / "in.parquet"))
        out = str(tmp_path / "out")
        assert main(["chunk", str(tmp_path / "in.parquet"), out, "--strategy", "test_halves"], spark) == 0
        assert sorted(tuple(r)[:3] for r in spark.read.parquet(out).collect()) == [(1, 0, "abc"), (1, 1, "def"), (2, 0, "x")]
        assert main(["chunk", str(tmp_path / "in.parquet"), out + "2", "--strategy", "fixed_size", "--set", "size=4", "--format", "json"], spark) == 0
        assert spark.read.json(out + "2").count() == 3
        assert main(["chunk", str(tmp_path / "in.parquet"), out + "3", "--strategy", "none such"], spark) == 2
        assert main(["benchmark", str(tmp_path / "in.parquet"), "--strategies", "fixed_size,recursive"], spark) == 0
        assert main(["check", str(tmp_path / "in.parquet"), "--strategy", "fixed_size"], spark) == 0
        assert main(["list", "--category", "custom"], spark) == 0
        assert "test_halves" in capsys.readouterr().out
    finally:
        for name in ("test_halves", "test_broken", "test_raising"):
            catalog.unregister(name)
    (tmp_path / "good.json").write_text("{}")
    assert main(["validate", str(tmp_path / "good.json")], spark) == 0
    with pytest.raises(ValueError):
        catalog.register("fixed_size", lambda df: df)


def test_every_strategy_of_the_catalogue_is_valid(spark):
    docs = spark.createDataFrame([(1, "One sentence here. Two of them! Is this the third?\n\nA new paragraph, however, begins. " * 6), (2, '[{"a": 1}, {"a": 2}]')], "doc_id long, text string")
    bad = {name: p for name, (f, *_) in catalog.STRATEGIES.items() if (p := [x for x in config.validate(f, docs) if x != "documents without chunks"])}
    # plain text has no elements, and the window rule may leave white space at a text's end
    assert bad == {"html": ["no chunks"], "xml": ["no chunks"], "universal_rolling": ["1 empty chunks"]}


def test_quick_benchmark_and_sentence_flush(spark):
    docs = spark.createDataFrame([(1, "a b c. d e f.")], "doc_id long, text string")
    got = feedback.quick_benchmark(docs, ["fixed_size", "recursive", "sentence_based"], catalog.chunk, 2).collect()
    assert len(got) == 2 and got[0]["seconds"] <= got[1]["seconds"]
    cut = streams.sentences(2, flush_at=100)
    assert cut("x" * 101, False) == (["x" * 101], "") and cut("A. B. C", False) == (["A. B. "], "C")


def test_structural_similarity_by_direct_sums():
    r = np.random.default_rng(1)
    k = np.exp(-(np.arange(-5, 6) ** 2) / 4.5)
    k = np.outer(k, k) / k.sum() ** 2

    def at(x, i, j):
        """Weighted mean around a place, the image mirrored at its edges."""
        mirror = lambda p, n: abs(p) if p < n else 2 * (n - 1) - p
        return sum(k[a + 5, b + 5] * x[mirror(i + a, x.shape[0]), mirror(j + b, x.shape[1])] for a in range(-5, 6) for b in range(-5, 6))

    a, b = r.integers(0, 256, (9, 12)).astype(float), r.integers(0, 256, (9, 12)).astype(float)
    c1, c2, total = 6.5025, 58.5225, 0.0
    for i in range(9):
        for j in range(12):
            ma, mb = at(a, i, j), at(b, i, j)
            va, vb, cov = at(a * a, i, j) - ma * ma, at(b * b, i, j) - mb * mb, at(a * b, i, j) - ma * mb
            total += (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    assert media.ssim(a, b) == pytest.approx(total / 108) and media.ssim(a, a) == pytest.approx(1.0)


def test_structure_of_many_pairs():
    """Pairs of several sizes are measured by the batch, each as by itself; 40,000 take seconds, not a minute."""
    r = np.random.default_rng(5)
    frames = [r.integers(0, 256, n).astype(float) for n in (64, 16, 64, 8, 16, 64) for _ in range(2)]
    now, past = pa.array(frames[::2]), pa.array(frames[1::2])
    alone = [1 - media.ssim(x.reshape(-1, 4), y.reshape(-1, 4)) for x, y in zip(frames[::2], frames[1::2], strict=True)]
    assert media._paired(now, past, 4) == pytest.approx(np.array(alone))
    many = pa.array(list(r.integers(0, 256, (40_000, 64)).astype(float)))
    began = time.process_time()
    assert len(media._paired(many, many[::-1], 8)) == 40_000
    assert time.process_time() - began < 8


def test_encodings_that_are_tried(spark):
    rows = [("a", b""), ("b", b"plain"), ("c", "ä".encode()), ("d", b"odds\xe9"), ("e", b"\xe9\x00ab"), ("f", b"\xff\xfe\x00\x00x"), ("g", None)]
    got = {r["path"]: (r["encoding"], r["confidence"], r["method"]) for r in analyze.detect_encoding(spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows], "path string, content binary")).collect()}
    want = {}
    for k, v in rows:
        v = v or b""
        marked = next((n for m, n in analyze.BOMS if v.startswith(m)), None)
        if not v or marked:
            want[k] = (marked or "utf-8", 1.0, "mark" if marked else "empty")
            continue
        for name in analyze.TRIED:
            try:
                v.decode(name)
            except UnicodeDecodeError:
                continue
            want[k] = (name, 0.9 if name == "utf-8" else 0.7, "trial")
            break
    assert got == want and got["d"][0] == "latin1" and got["f"][0] == "utf-16-le"


def test_topics_are_nearest_to_their_own_mean():
    words = [["apple", "pear"], ["apple", "pear", "plum"], ["car", "road"], ["road", "car", "bus"], ["apple", "plum"], ["bus", "road"]]
    got = list(topics._labels(["s"] * 6, words, 1000))
    label = [x[2] for x in got]
    assert [x[1] for x in got] == list(range(6)) and len(set(label)) == 2
    assert label[0] == label[1] == label[4] != label[2] == label[3] == label[5]
    assert list(topics._labels(["a", "b"], [["x"], ["y"]], 10)) == []


def test_hashed_embeddings(spark):
    import xxhash

    texts = ["Some words, some WORDS again é", "one", " ", None, "x " * 300]
    got = {r["doc_id"]: r["embedding"] for r in vectors.embed_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string"), 16).collect()}
    want = {}
    for k, t in enumerate(texts):
        if t and t.strip():
            v = np.zeros(16)
            for w in re.findall(r"\w+", t.lower()):
                h = xxhash.xxh64_intdigest(w.encode(), 42)
                v[(h - (1 << 64) if h >> 63 else h) % 16] += 1
            want[k] = (v / np.linalg.norm(v)).tolist()
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_random_patches(spark):
    import xxhash

    frame = spark.createDataFrame([(5, 100, 80), (6, 31, 90), (7, 32, 32)], "image_id long, width int, height int")
    got = {(r["image_id"], r["k"]): (r["x"], r["y"], r["w"], r["h"]) for r in closed.random_patches(frame, 32, 3).collect()}

    def at(image, k, side, salt):
        h = xxhash.xxh64_intdigest(image.to_bytes(8, "little"), 42)
        for v in (k, 42 + salt):
            h = xxhash.xxh64_intdigest(v.to_bytes(4, "little"), h)
        return (h - (1 << 64) if h >> 63 else h) % (side - 32 + 1)

    assert got == {(i, k): (at(i, k, w, 0), at(i, k, h, 1), 32, 32) for i, w, h in ((5, 100, 80), (7, 32, 32)) for k in range(3)}


def test_scripts_are_counted_in_one_pass():
    texts = ["Plain, é ɏ.", "слово and word", "漢字かなカナ한글", " ", " \t\n\x0b\f\r", "😀\x7f\x1f", "", None, "سلام" * 400]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    [got] = languages._profiles(iter([batch]), 1000, "doc_id")
    for r, t in zip(got.to_pylist(), texts, strict=True):
        t = t or ""
        assert r["_head"] == t[:1000] and r["_blank"] == (not re.search(r"\S", t, re.ASCII))
        assert [r[f"_{k}"] for k in languages.SCRIPTS] == [sum(a <= c <= z for c in t) for a, z, _ in languages.SCRIPTS.values()]


def test_topic_labels_gather_words_only(spark):
    """A document's words meet once; its sentences are not dealt beside them."""
    rows = [(1, i, s) for i, s in enumerate(["a cat sat", "cats ran", "...", "the dog", "a cat sat"])] + [(2, 0, "x"), (3, 0, "!"), (3, 1, "?"), (3, 2, "!")]
    own = topics.topic_labels(spark.createDataFrame(rows, "doc_id long, i long, sentence string"))
    assert "units" not in own._jdf.queryExecution().optimizedPlan().toString()
    words = [["cat", "sat"], ["cats", "ran"], [], ["the", "dog"], ["cat", "sat"]]
    want = {(1, i): k for _, i, k in topics._labels(words, words, 1000)} | {(3, i): 0 for i in range(3)}
    assert {(x["doc_id"], x["i"]): x["topic"] for x in own.collect()} == want


def test_pieces_of_a_stream_are_written_by_all_cores(spark, sf, monkeypatch):
    """Documents in one row group are dealt before they are cut into pieces."""
    made = []
    monkeypatch.setattr(more, "scratch", lambda *a: made.append(scratch(*a)) or made[-1])
    assert more.streamed(spark, sf).count()
    assert len([f for f in os.listdir(f"{made[0]}/in") if f.endswith(".parquet")]) > 1
