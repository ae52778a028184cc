import hashlib
import json
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docslice.llm import decontam, shingles, simhash, tokenbin, toxicity


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# token files


@settings(max_examples=60, deadline=None)
@given(bits=st.integers(1, 32), data=st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=200)), np.uint32)
    packed = tokenbin.pack(ids, bits)
    assert len(packed) == (len(ids) * bits + 7) // 8 and (tokenbin.unpack(packed, len(ids), bits) == ids).all()


@pytest.mark.parametrize("bits", [3, 16, 17])
def test_random_access(bits):
    r = np.random.default_rng(bits)
    docs = [r.integers(0, 2**bits, n).astype(np.uint32) for n in (0, 1, 7, 300, 64, 0, 1000)]
    w = tokenbin.FileWriter(bits, block_ids=64)
    data = b"".join(x + b"\n" for k, d in enumerate(docs) for x in w.add(k or None, d)) + b"".join(x + b"\n" for x in w.finish())
    f = tokenbin.FileReader(data)
    flat = np.concatenate(docs)
    assert f.ids == len(flat) and f.lengths.tolist() == [len(d) for d in docs] and f.docs[0] == tokenbin.NULL_DOC
    assert all((f.document(i) == d).all() for i, d in enumerate(docs))
    assert all((f.read(a, z) == flat[a:z]).all() for a, z in ((0, 0), (3, 900), (63, 65), (64, 128), (1371, 1372)))


SPACES = st.text(st.sampled_from(list("\x01\n\nab'1.!é漢 \t\n　\x85\x1c\x00|<>")), max_size=40)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(SPACES, max_size=5))
def test_cached_encoder_gives_the_librarys_ids(texts):
    e = tokenbin.encoder_of(tokenbin.tokenizer_path())
    texts = [*texts, "it's <|endoftext|> x", "a  b   c", "\n \n"]
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.lib.encode_batch(texts, add_special_tokens=False)]


def test_trimmed_cache_still_right():
    e = tokenbin.CachedEncoder(tokenbin.tokenizer_path())
    e.UNITS = 50
    for k in range(30):
        t = [f"w{k} common w{k * 7} common other{k % 3}" for _ in range(3)]
        assert [x.tolist() for x in e.encode(t)] == [x.ids for x in e.lib.encode_batch(t, add_special_tokens=False)]


def test_files_begin_anew_at_their_limit():
    r = np.random.default_rng(5)
    docs = [r.integers(0, 2**9, n).astype(np.uint32) for n in (10, 256, 0, 64, 200, 1, 250, 63, 64, 65, 3)]
    w = tokenbin.FileWriter(9, block_ids=64, file_blocks=4)
    rows = [x for k, d in enumerate(docs) for x in w.add(k, d)]
    rows += list(w.finish())
    files, held = [], []
    for x in rows:  # all but the last file have five rows
        held.append(x)
        if x[-tokenbin.TRAILER.size :][:4] == tokenbin.MAGIC:
            files.append(tokenbin.FileReader(b"".join(y + b"\n" for y in held)))
            assert len(held) == 5 or x is rows[-1]
            held = []
    assert not held and len(files) > 3
    with pytest.raises(ValueError):
        list(w.add(9, np.zeros(257, np.uint32)))
    assert [f.document(i).tolist() for f in files for i in range(len(f.docs))] == [d.tolist() for d in docs]


def test_other_tokenizers_get_whole_texts(tmp_path):
    spec = json.load(open(tokenbin.tokenizer_path()))
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}):
        path = str(tmp_path / "other.json")
        json.dump(spec | change, open(path, "w"))
        e = tokenbin.CachedEncoder(path)
        texts = ["Some words\nAnd MORE words ", None, ""]
        assert not e.cuts and [x.tolist() for x in e.encode(texts)] == [e.lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files(spark, sf, docs, odd, none):
    lib = tokenbin.encoder_of(tokenbin.tokenizer_path()).lib
    for frame, got in ((docs, tokenbin.op3_token_binary(spark, sf)), (odd, tokenbin.encode_and_read(odd))):
        rows = sorted(got.collect(), key=lambda r: r["start"])
        at, want = 0, {}
        for r in frame.collect():
            ids = lib.encode(r["text"] or "", add_special_tokens=False).ids + [0]
            want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        ids = [r["doc_id"] for r in rows]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and len(ids) == frame.count()
        for r in rows:
            assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]] and r["bits"] == 16
            at += r["n_tokens"]
    assert tokenbin.encode_and_read(none).count() == 0


# toxicity


def slow_fit(rows, epochs):
    """FTRL-proximal with dictionaries and one coordinate at a time."""
    ones = sum(y for y, _ in rows)
    bias, z, n = math.log((ones + 1) / (len(rows) - ones + 19)), {}, {}
    shift = bias_n = 0.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for order in toxicity.orders(len(rows), epochs):
        for y, at in (rows[i] for i in order):
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-(bias + shift + sum(w.values())))) - y
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
            bias_n += g * g
            shift -= 0.02 * g / (1 + math.sqrt(bias_n))
    return bias + shift, {i: weight(i) for i in z if weight(i)}


def test_fit_is_the_plain_loop():
    r = np.random.default_rng(3)
    rows = []
    for k in range(120):
        y = int(k % 4 == 0)
        at = np.unique(np.concatenate([r.integers(0, 400, 12), [500 + y, 600 + r.integers(2)]])).astype(np.int32)
        rows.append((y, at))
    bias, at, w = toxicity.fit(rows)
    want_bias, want = slow_fit([(y, x.tolist()) for y, x in rows], toxicity.EPOCHS)
    assert len(want) > 1 and at.tolist() == sorted(want) and bias == pytest.approx(want_bias)
    assert w.tolist() == pytest.approx([want[i] for i in at.tolist()])


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(["ab", "abc", "abcd", "abcdefgh", "abcdefxy", "Zz", "é", "x1"]), max_size=30).map(" ".join), max_size=5), seed=st.integers(0, 99))
def test_scores_are_sums_of_all_features(texts, seed):
    r = np.random.default_rng(seed)
    weights = np.zeros(1 << toxicity.BITS)
    every = np.unique(np.concatenate([np.zeros(0, np.int32), *(toxicity.features(t.encode()) for t in texts)]))
    some = every[r.random(len(every)) < 0.2]
    weights[some] = r.normal(size=len(some))
    want = [1 / (1 + math.exp(-(-1 + sum(weights[i] for i in set(toxicity.features(t.encode()).tolist()))))) for t in texts]
    assert toxicity.score_texts([t.encode() for t in texts], -1.0, weights) == pytest.approx(want)


def test_toxicity(spark, sf, docs, odd, none):
    rows = {r["doc_id"]: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    scored = toxicity.score(spark.read.parquet(f"{big}/documents.parquet"), toxicity.train(spark.read.parquet(f"{big}/documents.parquet"), labels))
    held = scored.filter("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    pos, neg = [r["score"] for r in held if r["toxic"]], [r["score"] for r in held if not r["toxic"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in held]) > 0.95
    assert np.mean([r["predicted"] for r in held if r["toxic"]]) >= 0.9
    assert np.mean([r["predicted"] for r in held if not r["toxic"]]) <= 0.01
    assert np.mean([np.mean([p > n for n in neg]) for p in pos]) > 0.95
    empty = toxicity.train(none, labels)
    model = toxicity.train(odd, spark.createDataFrame([(4, 1), (4, 0), (6, None), (None, 1)], "doc_id long, toxic int"))
    for m in (empty, model):
        got = toxicity.score(odd, m).collect()
        assert len(got) == odd.count() and all(r["held_out"] is not None for r in got)
        assert toxicity.score(none, m).count() == 0
    assert toxicity.reject_toxic(odd, empty).columns == odd.columns and toxicity.reject_toxic(odd, empty).count() == odd.count()
    assert all(abs(r["score"] - 0.05) < 1e-9 for r in toxicity.score(odd, empty).collect())


# decontamination


def slow_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, hit, found = word.findall(low(text)), set(), set()
    for name, t in items:
        x = word.findall(low(t))
        n = min(13, len(x))
        for p in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[p : p + n]:
                    hit.update(range(i, i + n))
                    found.add(str(name) if name is not None else "")
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit and 20 * len(hit) >= len(w))


WORDS = st.lists(st.sampled_from(["a", "b", "B", "é", "c1"]), max_size=60).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(WORDS, min_size=1, max_size=4), items=st.lists(WORDS, max_size=4))
def test_hits_of_random_texts(texts, items):
    class Block:
        value = decontam.Tests([(str(k), t.encode()) for k, t in enumerate(items)])

    n, hit, found = decontam.judge([t.encode() for t in texts], [Block])
    for k, t in enumerate(texts):
        want = slow_hits(t, list(enumerate(items)))
        assert (n[k], hit[k], len(found[k])) == want[:3]


def test_decontamination(spark, sf, docs, odd, none):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in decontam.op9_decontamination(spark, sf).collect()}
    want = {r["doc_id"]: slow_hits(r["text"], items) for r in docs.filter("doc_id < 60").collect()}
    assert all(got[i] == w for i, w in want.items()) and len(got) == docs.count()
    kept = {r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == {i for i, r in got.items() if not r[1]}
    assert {r["doc_id"] for r in decontam.decontaminate(docs, bench, 1 / decontam.SHARE).collect()} == {i for i, r in got.items() if not r[4]}
    odd_bench = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "the SAME text", 1), (3, "the SAME text", 1), (None, "one", 1), (4, "word " * 30, 1)], "item_id long, text string, doc_id int")
    rows = decontam.score(odd, odd_bench).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count() and by[1]["n_words"] == 0 and by[4]["n_hit"] == 3 and by[7]["n_hit"] == 60_000 and by[10]["n_items"] == 1
    assert decontam.score(none, odd_bench).count() == 0 and decontam.score(odd, odd_bench.limit(0)).filter("contaminated").count() == 0
    spans = {(r["doc_id"], r["item"]): r for r in decontam.spans(odd, odd_bench).filter("doc_id = 4").collect()}
    assert (spans[4, "3"]["doc_start"], spans[4, "3"]["n_words"]) == (0, 3)


def test_blocks_of_the_benchmark_agree(spark, docs, odd, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, decontam.score(docs, bench).collect()))
    assert len(decontam.split_tests(bench, 4000)) > 1
    assert sorted(map(tuple, decontam.score(docs, bench, block_bytes=4000).collect())) == one
    left = decontam.decontaminate(docs, bench, block_bytes=4000)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == sorted(map(tuple, decontam.decontaminate(docs, bench).collect()))
    odd_one, odd_many = (sorted(map(str, decontam.score(odd, bench.unionByName(bench.selectExpr("item_id", "'one' AS text")), block_bytes=n).collect())) for n in (1 << 20, 4000))
    assert odd_one == odd_many


# SimHash


def test_keys_meet_within_two_bits():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**64, 2000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for j in r.choice(64, r.integers(0, 3), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(j)
    keys = []
    for x in (a, b):
        row, key = simhash.keys_of(x)
        keys.append(set(zip(row.tolist(), key.tolist(), strict=True)))
    assert {r for r, _ in keys[0] & keys[1]} == set(range(2000))


def slow_components(prints):
    names = sorted(prints)
    v, parent = np.array([prints[i] for i in names], np.uint64), {i: i for i in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, n in enumerate(names):
        for j in np.flatnonzero(np.bitwise_count(v[i + 1 :] ^ v[i]) <= 2):
            x, y = sorted((root(n), root(names[i + 1 + j])))
            parent[y] = x
    return {i: root(i) for i in names}


def test_simhash(spark, sf, docs, odd, none):
    got = {r["doc_id"]: r for r in simhash.op8_simhash(spark, sf).collect()}
    prints = {r["doc_id"]: simhash.fingerprint((r["text"] or "").encode()) for r in docs.collect()}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(prints)
    rows = simhash.near_duplicates(odd).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == odd.count() and by[1] == by[2] == by[3] == 1 and by[5] == 4 and by[6] == 6
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(odd).collect() if r["doc_id"] is not None)
    assert kept == [1, 4, 6, 7, 8, 9, 10] and simhash.deduplicate(odd).columns == odd.columns
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicate(none).count() == 0


@settings(max_examples=20, deadline=None)
@given(base=st.integers(0, 2**64 - 1), flips=st.lists(st.sets(st.integers(0, 63), max_size=3), min_size=1, max_size=40))
def test_runs_connect_what_links_connect(base, flips):
    prints = np.unique(np.array([base ^ sum(1 << b for b in f) for f in flips], np.uint64))
    row, key = simhash.keys_of(prints)
    order = np.argsort(key, kind="stable")
    a, b = simhash.links_of_runs(key[order], prints[row[order]])
    assert (np.bitwise_count(a ^ b) <= 2).all()
    parent = {int(p): int(p) for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = sorted((root(x), root(y)))
        parent[y] = x
    want = slow_components({int(p): int(p) for p in prints})
    assert {p: root(p) for p in parent} == want


@pytest.mark.parametrize("operator", [simhash, shingles])
def test_one_row_of_every_component_stays(spark, operator):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (9, b), (None, c), (None, d), (None, d), (None, a), (7, c + "\n"), (8, "x y"), (8, "x y"), (None, "p q"), (None, "r s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n")
    got = sorted(((r["doc_id"] or 0, r["text"].strip()) for r in operator.deduplicate(frame).collect()))
    assert got == sorted([(1, a), (5, b), (7, c), (0, d), (8, "x y"), (0, "p q"), (0, "r s")])


def slow_similar(texts, similarity=0.8):
    """Root (first index) of each text."""
    sets = []
    for t in texts:
        w = low(t).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [128, 8, 3])
def test_pipeline_finds_near_copies(spark, monkeypatch, block):
    """Texts with some words replaced, below and above the threshold, alone and in one large group."""
    import corpus_pipeline

    monkeypatch.setattr(shingles, "BLOCK", block)
    r, texts = np.random.default_rng(7), [None, "", " \n", "two words", "Two  WORDS"]
    for k in range(40):
        base = [f"w{k}x{i}" for i in range(120)]
        for n in range(0, 6) if k else [0] + [1 + i % 4 for i in range(60)]:
            w = list(base)
            for i in r.integers(0, 120, n):
                w[i] = f"new{r.integers(1 << 40)}"
            texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, frame, "").collect())
    assert got == sorted(set(slow_similar(texts)))


def test_blocks_of_a_run_of_two_groups_meet(spark, monkeypatch):
    """A key that texts of two groups share, the second group apart from the run's first class and over many blocks."""
    monkeypatch.setattr(shingles, "BLOCK", 3)
    monkeypatch.setattr(shingles, "bands", lambda hashes: np.zeros(1, np.int64))
    base = np.arange(100, dtype=np.int32)
    rows = []
    for k in range(24):  # even ones are near each other, odd ones too, the two kinds are not
        own = base + (0 if k % 2 else 1000)
        own = np.concatenate([own[:95], np.arange(10_000 + 10 * k, 10_005 + 10 * k)])
        rows.append((k, k, k, k, [7], [int(x) for x in own]))
    rows += [(100 + k, 100 + k, 0, 100 + k, [7], list(range(100_000 * (k + 1), 100_000 * (k + 1) + 50))) for k in range(5)]
    frame = spark.createDataFrame(rows, "row long, doc_id long, text_hash long, node long, bands array<long>, shingles array<int>")
    assert shingles.arrow_rows(frame.select("doc_id", "node").repartition(1).sortWithinPartitions("doc_id"), lambda b: shingles._members(b, 3), "run long, block long, node long, first long, hot boolean").count() == 0
    keyed = frame.selectExpr("7L AS key", "node").repartition(1)
    members = shingles.arrow_rows(keyed, lambda b: shingles._members(b, 3), "run long, block long, node long, first long, hot boolean").collect()
    assert {r["block"] for r in members} == set(range(10)) and all(r["hot"] for r in members)
    found = {}
    for r in shingles.classes(frame, 0.8).collect():
        found.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, found.values())) == [list(range(0, 24, 2)), list(range(1, 24, 2))]
