"""Registered queries over whole code lists against one-at-a-time greedy, to the stop rule, on a
small table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from helpers import SF_SMALL, brute_learn
from wordmill import registry
from wordmill.operators import bpe, vocab as vb
from wordmill.sources.corpus import read_table


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = read_table(spark, SF_SMALL, "documents").where("doc_id < 3").withColumn(
        "text", F.substring("text", 1, 700))
    docs.write.parquet(sf + "/documents.parquet")
    read_table(spark, SF_SMALL, "labels").where("doc_id < 3").write.parquet(sf + "/labels.parquet")
    words = Counter(w for r in docs.select("text").collect() for w in r.text.split())
    return sf, words, brute_learn(dict(words), 10**6)


def greedy_form(codes):
    ranks = {p: i for i, p in enumerate(codes)}
    return lambda w: bpe._greedy(w, ranks)


def test_learning_ends_by_the_stop_rule(spark, small):
    sf, _, want = small
    assert len(want) > 50
    for name in ("learn_bpe", "stop_rule", "codes_roundtrip"):
        got = entry.queries()[name](spark, sf).orderBy("rank").collect()
        assert [(r["left"], r["right"]) for r in got] == want


def test_words_are_segmented_with_all_codes(spark, small):
    sf, words, want = small
    cut = greedy_form(want)
    for name in ("segment_words", "segment_words_fold"):
        got = {r.word: r.subwords for r in entry.queries()[name](spark, sf).collect()}
        assert got == {w: " ".join(cut(w)) for w in words}


def line_texts(spark, sf):
    for r in read_table(spark, sf, "documents").collect():
        for i, text in enumerate(r.text.split("\n")):
            yield (r.doc_id, i), text


def test_text_is_segmented_with_all_codes(spark, small):
    sf, _, want = small
    cut = greedy_form(want)
    got = {(r.doc_id, r.line_no): r.text for r in entry.queries()["segment_text"](spark, sf).collect()}
    assert got == {k: " ".join("@@ ".join(cut(w)) for w in t.split()) for k, t in line_texts(spark, sf)}


def test_streamed_lines_are_encoded_with_all_codes(spark, small):
    sf, _, want = small
    cut = greedy_form(want)
    lines = {k: " ".join("@@ ".join(cut(w)) for w in t.split()) for k, t in line_texts(spark, sf)}
    n = Counter(t for k in sorted(lines) for t in lines[k].split())   # first seen first
    vocab = ["UNK"] + [t for t, c in sorted(n.items(), key=lambda x: -x[1]) if c >= vb.MIN_COUNT_PREPARE]
    ids = {t: i for i, t in enumerate(vocab)}
    ends = len(vocab), len(vocab) + 2
    got = {(r.doc_id, r.line_no): r.ids for r in entry.queries()["stream_encode"](spark, sf).collect()}
    assert got == {k: " ".join(map(str, [ends[0], *[ids.get(t, 0) for t in s.split(" ")][:198], ends[1]]))
                   for k, s in lines.items()}


def test_subword_chain_with_all_codes(spark, small):
    sf, _, _ = small
    pairs = {r.row_idx: r for r in registry.indexed_pairs(spark, sf).collect()}
    words = Counter(w for r in pairs.values() for t in (r.a, r.b) for w in t.split())
    cut = greedy_form(brute_learn(dict(words), bpe.SCRIPT_MERGES))
    form = lambda t: " ".join("@@ ".join(cut(w)) for w in t.split())
    n = Counter(t for r in pairs.values() for side in (r.a, r.b) for t in form(side).split())
    keep = {t for t, c in n.items() if c >= vb.MIN_COUNT_SHELL}
    unk = lambda t: " ".join(x if x in keep else "UNK" for x in form(t).split())
    got = {r.row_idx: (r.a, r.b, r.label) for r in entry.queries()["subword_chain"](spark, sf).collect()}
    assert got == {i: (unk(r.a), unk(r.b), r.label) for i, r in pairs.items()}
