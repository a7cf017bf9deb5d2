"""Bin packing: subset sums and plans against brute force, ids against the library."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordmill.llm import packing as pk, tokens as tk
from wordmill.llm.queries import QUERIES, tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")


def test_fullest_against_all_combinations():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 30)
        sums = {sum(n * k for n, k in zip(counts, c))
                for c in itertools.product(*[range(m + 1) for m in counts.values()])}
        use = pk.fullest(counts, room)
        assert sum(n * k for n, k in use.items()) == max(s for s in sums if s <= room)
        assert all(0 < k <= counts[n] for n, k in use.items())


def test_plan_is_bin_by_bin():
    rng = random.Random(6)
    for _ in range(50):
        counts = {rng.randint(1, 40): rng.randint(1, 60) for _ in range(rng.randint(1, 12))}
        left, bins = dict(counts), []
        while left:                                   # one bin at a time
            seed = max(left)
            left[seed] -= 1
            use = pk.fullest(left, 40 - seed)
            use[seed] = use.get(seed, 0) + 1
            left[seed] += 1
            left = {n: c - use.get(n, 0) for n, c in left.items() if c > use.get(n, 0)}
            bins.append(use)
        plan = pk.plan(counts, 40)
        assert sum(t for _, t in plan) == len(bins)
        total = sum(n * c for n, c in counts.items())
        assert len(bins) >= -(-total // 40)
        for n, c in counts.items():
            assert sum(u.get(n, 0) * t for u, t in plan) == c
        p = pk.places(plan)
        length = np.repeat(list(counts), list(counts.values()))
        rank = np.concatenate([np.arange(c) for c in counts.values()])
        check_bins(length, *pk.place(p, length, rank), 40)


def check_bins(length, seq, offset, capacity):
    order = np.lexsort((offset, seq))
    n, s, o = length[order], seq[order], offset[order]
    first = np.r_[True, s[1:] != s[:-1]]
    assert (o[first] == 0).all()
    assert (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all()
    assert (o + n <= capacity).all()
    assert sorted(set(s.tolist())) == list(range(s.max() + 1))


def library_ids(texts):
    tok = Tokenizer.from_file(FILE)
    return [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in docs], library_ids([r.text for r in docs])))
    got = QUERIES["op11_bin_packing"](spark, sf).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, ids in want.items():
        rows = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert rows[0].start == 0 and sum(r.length for r in rows) == len(ids)
        assert all(r.length == 2048 for r in rows[1:]) and rows[0].length <= 2048
        for r in rows:
            raw = np.array(ids[r.start:r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
    a = np.array([(r.length, r.sequence_id, r.offset) for r in got])
    check_bins(*a.T, 2048)
    assert a[:, 1].max() + 1 <= 1.01 * -(-a[:, 0].sum() // 2048) + 1


def test_sequences_hold_their_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = pk.pack(docs, FILE, capacity=512, end_id=7, with_ids=True).persist()
    seqs = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in pk.sequences(packed).collect()}
    assert max(map(len, seqs.values())) <= 512
    back = {}
    for r in packed.collect():
        back.setdefault(r.doc_id, {})[r.piece] = seqs[r.sequence_id][r.offset:r.offset + r.length]
    rows = docs.select("doc_id", "text").collect()
    for r, ids in zip(rows, library_ids([r.text for r in rows])):
        cells = back[r.doc_id]
        assert np.concatenate([cells[i] for i in range(len(cells))]).tolist() == ids[:-1] + [7]


def test_odd_rows_and_empty_table(spark, odd_docs):
    got = pk.pack(odd_docs, FILE, capacity=64).collect()
    assert set(got[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32",
                                    "sequence_id", "offset"}
    a = np.array([(r.length, r.sequence_id, r.offset) for r in got])
    check_bins(*a.T, 64)
    assert sum(r.piece == 0 for r in got) == odd_docs.count()
    rows = odd_docs.collect()
    total = sum(map(len, library_ids([r.text for r in rows])))
    assert a[:, 0].sum() == total
    end = zlib.crc32(np.zeros(1, "<u4").tobytes())
    assert {(r.length, r.ids_crc32) for r in got if r.doc_id in (3, 4)} == {(1, end)}
    assert pk.pack(odd_docs.where("false"), FILE).collect() == []


ODD_TEXTS = [None, "", " ", "\n", "a\tb  c", "x<|endoftext|>y", "a\0b", "  x", "don't  stop\n\nnow",
             "日本 語 テスト", "a\r\nb", "  lead", "trail  ", "ªº µm ſt", "ÿ×÷ é,", "a,b. c.. d.,",
             "İstanbul Ωmega", "é" * 30 + ",", "1,000.50 é1, 1é!"]


@pytest.mark.parametrize("capacity", [1, 10, 700_000])
def test_batch_encoder_equals_the_library(spark, capacity):
    import pyarrow as pa
    enc = tk.BatchEncoder(FILE, capacity)
    enc.CHUNK = 50
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60)
    texts = ODD_TEXTS + [r.text for r in rows.collect()] + ODD_TEXTS
    want = library_ids(texts)
    for _ in range(2):
        for row, ids, bounds in enc.documents(pa.array(texts), 0):
            for i in range(len(bounds) - 1):
                assert ids[bounds[i]:bounds[i + 1]].tolist() == want[row + i]


def test_a_frequent_length_is_numbered_across_tasks(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"))
    got = pk.pack(docs.repartition(7), FILE, capacity=10).collect()
    a = np.array([(r.length, r.sequence_id, r.offset) for r in got])
    check_bins(*a.T, 10)
    assert a[:, 1].max() + 1 == -(-4000 // (10 // a[0, 0]))
