import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from docslice.llm import mixing, shingles, simhash, tokenbin, toxicity
from tests.llm.test_text_ops import slow_hits, slow_similar

NAMES = [name for name, _ in corpus_pipeline.STAGES]
BY_NAME = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="session")
def tables(spark, sf, tmp_path_factory):
    """A folder with labels and a benchmark for the odd rows."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(4, 0, 1), (5, 1, 0), (5, 0, 0), (None, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("q1", "the SAME text"), ("q2", None), ("q2", ""), (None, "one")], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return Counter(map(str, df.collect()))


def slow_toxic(spark, docs, sf_dir):
    """Rows that score under one half, text by text, with plain sums of the model's weights."""
    bias, weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = []
    for r in docs.collect():
        at = set(toxicity.features((r["text"] or "").encode()).tolist())
        keep.append(r) if bias + sum(weights[i] for i in at) < 0 else None
    return Counter(map(str, keep))


def slow_one_of_each(docs):
    """Rows that stay: of each component of similar texts that of the smallest id (ids before nulls)."""
    rows = docs.collect()
    groups = defaultdict(list)
    for i, root in enumerate(slow_similar([r["text"] for r in rows])):
        groups[root].append(rows[i])
    return [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]


def test_simhash_finds_similar_texts_that_share_no_band(spark, tables):
    texts = []
    for seed in (22318, 49650, 58862, 106405):
        words = " ".join(f"w{i}" for i in np.random.default_rng(seed).integers(0, 1 << 30, 17))
        own = [f"{'round and round we go again friend ' * 60}{words} {x}1 {x}2 {x}3" for x in "ab"]
        a, b = (np.unique(simhash.shingle_hashes(t.encode(), shingles.SHINGLE)) for t in own)
        assert not (shingles.bands(a) == shingles.bands(b)).any() and (simhash.fingerprint(own[0].encode()) ^ simhash.fingerprint(own[1].encode())).bit_count() <= 2
        # the other text, of equal fingerprint, is not similar
        texts += [*own, f"{'round and round we go again friend ' * 60}{seed} and so on to the end of this other song"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(x["doc_id"] for x in BY_NAME["simhash near-dedup"](spark, frame, tables).collect())
    assert got == sorted(set(slow_similar(texts))) and 0 in got and 1 not in got


def slow_clean(spark, docs, sf_dir):
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    return Counter(str(r) for r in docs.collect() if not slow_hits(r["text"], items)[1])


def test_stages_are_those_that_were_asked_for():
    assert NAMES == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing sources", "token files"]


def test_every_stage_on_odd_rows(spark, odd, tables):
    assert rows_of(BY_NAME["toxicity"](spark, odd, tables)) == slow_toxic(spark, odd, tables)
    kept = BY_NAME["simhash near-dedup"](spark, odd, tables)
    assert sorted(map(str, kept.collect())) == sorted(map(str, slow_one_of_each(odd)))
    assert rows_of(BY_NAME["benchmark decontamination"](spark, odd, tables)) == slow_clean(spark, odd, tables)
    mixed, taken = rows_of(BY_NAME["mixing sources"](spark, odd, tables)), mixing.mix(mixing.sized(odd)).collect()
    assert set(mixed) <= set(rows_of(odd)) and sum(mixed.values()) == sum(r["repeats"] for r in taken)
    files = BY_NAME["token files"](spark, odd, tables).collect()
    lib = tokenbin.encoder_of(tokenbin.tokenizer_path()).lib
    want = Counter()
    for r in odd.collect():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in files) == want
    at = 0
    for r in sorted(files, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_stages_keep_columns_and_take_empty_tables(spark, odd, none, tables, name):
    out = BY_NAME[name](spark, none, tables)
    assert out.count() == 0
    if name != NAMES[-1]:
        assert out.columns == odd.columns and out.schema == none.schema
    # names that the operators use themselves
    clash = odd.selectExpr("*", "1 AS _id", "2 AS _hash", "3 AS node", "4 AS _repeats", "5 AS twin", "6 AS n", "7 AS row", "8 AS size", "9 AS memberships", "'a' AS cell", "10 AS toxic", "11 AS item", "12 AS _copy", "13 AS text_hash")
    out = BY_NAME[name](spark, clash, tables)
    assert out.count() > 0 and (name == NAMES[-1] or out.columns == clash.columns)


def test_the_whole_pipeline(spark, sf, docs):
    got = corpus_pipeline.run(spark, sf).collect()
    left = slow_toxic(spark, docs, sf)
    rows = [r for r in docs.collect() if left[str(r)]]
    left = spark.createDataFrame(rows, docs.schema)
    left = spark.createDataFrame(slow_one_of_each(left), docs.schema)
    clean = slow_clean(spark, left, sf)
    left = spark.createDataFrame([r for r in left.collect() if clean[str(r)]], docs.schema)
    taken = {r["doc_id"]: r["repeats"] for r in mixing.mix(mixing.sized(left)).collect() if r["repeats"]}
    assert Counter(r["doc_id"] for r in got) == Counter(taken) and 0 < len(taken) < docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    lib = tokenbin.encoder_of(tokenbin.tokenizer_path()).lib
    assert all(r["n_tokens"] == len(lib.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids) + 1 for r in got)
