"""Ops 3 and 8 against the tokenizers library on whole texts."""

import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from wordmill.llm import mph, token_counts, token_store, tokens  # noqa: E402

FILE = P.path("byte_bpe_50k.json")
TEXTS = ["", " ", "\n\n", "a  b\n\n c\t d ", "it's 12345 o'clock...", "x<|endoftext|> y  <|endoftext|>",
         "漢字とかな😀 ñandú", "a b  c\x1cd\x85e", "  lead", "trail  ", "\x00 \x00a", "é" * 300]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(FILE)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_pieces_give_the_library_ids(library, text):
    enc = tokens.encoder(FILE)
    assert "".join(tokens.pieces(text)) == (text if "\0" in text else text.replace("\0", ""))
    ids = enc.text_ids(text) if enc.whole(text) else \
        [i for p in tokens.pieces(text) for i in enc.piece_ids(p)]
    assert ids == library(text)


def test_cache_is_bounded_and_right():
    made = []
    cache = tokens.PieceCache(lambda p: made.append(p) or len(p), {"pin": 99}, capacity=10)
    for i in range(200):
        assert cache[f"w{i % 25}"] == len(f"w{i % 25}")
        cache.trim()
        assert len(cache) <= 12 and cache["pin"] == 99
    assert cache["x" * 100] == 100 and "x" * 100 not in cache


def test_counts_on_odd_rows(spark, odd_docs, library):
    got = token_counts.count_tokens(odd_docs, FILE, limit=5, table_size=10, share=1).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(library(r.text)), len(library(r.text)) > 5)
            for r in odd_docs.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.count_tokens(odd_docs.limit(0), FILE).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(0)
    key = np.unique(rng.integers(-2**62, 2**62, 5000))
    copy = np.zeros(len(key), np.int64)
    key, copy = np.concatenate([key, key[:50]]), np.concatenate([copy, copy[:50] + 1])
    m = mph.MinimalPerfectHash.build(key, copy)
    assert sorted(m.find(key, copy).tolist()) == list(range(len(key)))
    again = mph.MinimalPerfectHash.of(m.arrays())
    assert (again.find(key, copy) == m.find(key, copy)).all()
    one = mph.MinimalPerfectHash.build(key[:1], copy[:1])
    assert one.find(key[:1], copy[:1]).tolist() == [0]


def test_store_round_trip(spark, odd_docs, library):
    store = token_store.write_store(odd_docs, FILE, end_id=0)
    rows = token_store.read(store, token_store.locate(store, odd_docs.select("doc_id"))).collect()
    docs = sorted(((r.doc_id, r.text) for r in odd_docs.collect()),
                  key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for d, t in docs:
        want.setdefault(token_store.NULL_KEY if d is None else d, []).append(
            np.array(library(t) + [0], "<u4").tobytes())
    got = {}
    for r in rows:
        got.setdefault(r["key"], []).append(bytes(r["ids"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted(rows, key=lambda r: r["start"])
    assert [r["key"] for r in order] == sorted(r["key"] for r in rows)
    assert [r["start"] for r in order] == np.cumsum([0] + [r["n"] for r in order])[:-1].tolist()
    assert token_store.get(store, 7).tolist() == library("eins zwei drei") + [0]
    assert token_store.get(store, None, 0) is not None and token_store.get(store, 12345) is None
    assert zlib.crc32(bytes(order[0]["ids"])) >= 0


def test_empty_store(spark, odd_docs):
    store = token_store.write_store(odd_docs.limit(0), FILE)
    assert token_store.read(store, token_store.locate(store, odd_docs.select("doc_id"))).count() == 0


def test_pieces_of_many_tokens_are_not_in_the_table():
    from wordmill.llm import token_counts as tc
    assert tc._packed(["a", "😀" * 64, "b"], [1, 256, 255]) == (b"a\0b", bytes([1, 255]))


def test_an_id_of_many_rows_is_split_and_its_copies_numbered(spark, library):
    from pyspark.sql import functions as F
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 2 > 0, F.col("id")).alias("doc_id"),
        F.concat(F.lit("text "), F.col("id") % 500).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = token_store.write_store(docs, FILE)
        assert store.parts.count() == 4
        rows = token_store.read(store, token_store.locate(store, docs.select("doc_id"))).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for key in (7, token_store.NULL_KEY):
        mine = [r for r in rows if r["key"] == key]
        assert sorted(r["copy"] for r in mine) == list(range(2000 if key == 7 else 500))
    want = sorted(np.array(library(r.text) + [0], "<u4").tobytes() for r in docs.collect())
    assert sorted(bytes(r["ids"]) for r in rows) == want
    reader = token_store.Reader(store)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup()
    for r in rows[::50]:
        key = None if r["key"] == token_store.NULL_KEY else r["key"]
        assert reader.get(key, r["copy"]).astype("<u4").tobytes() == bytes(r["ids"])
    assert reader.get(7, 2000) is None and reader.get(8) is None
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == jobs


def test_buckets_of_the_driver_are_those_of_spark(spark):
    keys = [(0, 0), (7, 3), (-1, 1), (token_store.NULL_KEY, 2), (2**62, 9)]
    df = spark.createDataFrame(keys, "key long, copy long")
    got = [r[0] for r in df.select(token_store._bucket(13)).collect()]
    assert got == [token_store.bucket_of(k, c, 13) for k, c in keys]
