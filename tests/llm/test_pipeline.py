"""The pipeline stage by stage, each against brute force or SQL on its own input."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def inputs(spark):
    """What each stage gets, and the result."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs
        docs = corpus_pipeline.stash(stage(spark, docs, SMALL))
    return out | {"result": docs}


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(inputs):
    assert list(STAGES) == ["quality rules", "toxicity", "line dedup", "n-gram Jaccard join", "best-fit packing"]
    assert all(inputs[name].columns == COLUMNS for name in STAGES)


def test_quality(inputs):
    """The verdicts themselves are held against brute force in test_operators.py; here the base rules are, and that each
    verdict takes effect and nothing else does."""
    from matchloom.llm.quality_rules import quality

    before, after = texts(inputs["quality rules"]), texts(inputs["toxicity"])
    verdicts = {r.doc_id: r.kept for r in quality(inputs["quality rules"]).collect()}
    assert after == {i: t for i, t in before.items() if verdicts[i]}
    assert all(len(t.split()) >= 50 for t in after.values()) and len(after) > 100


def test_toxicity(spark, inputs):
    from matchloom.llm.toxicity import ToxicityModel, fit, score_text, training_rows

    before, after = texts(inputs["toxicity"]), texts(inputs["line dedup"])
    spec = ToxicityModel()
    ids, weights, bias = fit(training_rows(inputs["toxicity"], spark.read.parquet(f"{SMALL}/labels.parquet"), spec), spec)
    place = {int(f): k for k, f in enumerate(ids)}
    scores = {i: score_text(t.encode(), place, weights, bias, spec.hash_bits) for i, t in before.items()}
    assert after == {i: t for i, t in before.items() if scores[i] < spec.threshold}
    assert len(after) < len(before)


def test_lines(inputs, tmp_path):
    from matchloom.llm.line_dedup import LINE_SQL

    inputs["line dedup"].write.parquet(f"{tmp_path}/docs")
    want = dict(duckdb.sql(LINE_SQL.format(docs=f"'{tmp_path}/docs/*.parquet'") + "SELECT doc_id, text FROM kept").fetchall())
    after = inputs["n-gram Jaccard join"]
    assert texts(after) == want and after.where("n_chars <> length(text)").count() == 0


def test_near_duplicates(inputs):
    before, after = texts(inputs["n-gram Jaccard join"]), texts(inputs["best-fit packing"])
    sets = {}
    for i, t in before.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert after == {i: t for i, t in before.items() if find(i) == i}


def test_packing(inputs):
    from tokenizers import Tokenizer

    from matchloom.llm.registry import tokenizer_path

    tok, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), set()
    for i, t in texts(inputs["best-fit packing"]).items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want |= {(i, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    rows = inputs["result"].collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_odd_rows(spark):
    from test_operators import CLASHES

    long = "alpha beta gamma delta " * 40
    words = " ".join(f"word{k}" for k in range(120))
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (2, words, "en", "b", 1), (None, words + " more", "en", "b", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, long, "en", "a", 2), (6, "x" * 300_000 + " " + words.upper().replace("WORD", "other"), "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0))) for c in CLASHES})
    kept = STAGES["n-gram Jaccard join"](spark, docs, SMALL).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [1, 3, 4, 5, 6]
    for name, stage in corpus_pipeline.STAGES:
        out, empty = stage(spark, docs, SMALL), stage(spark, docs.limit(0), SMALL)
        assert empty.collect() == []
        if name != "best-fit packing":
            assert out.columns == docs.columns
            for r in out.collect():
                assert all(r[c] == f"{c}{r.doc_id or 0}" for c in CLASHES)
        else:
            assert {r.doc_id for r in out.collect()} == {1, 2, None, 3, 4, 5, 6}
