"""Merkle manifest and climbed proofs against a plain statement of the tree."""

import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from wordmill.llm import merkle as mk
from wordmill.llm.oracle import ORACLE
from wordmill.llm.queries import QUERIES


def h(*texts):
    return sha256("".join(texts).encode()).hexdigest()


def leaf_of(row, text):
    cells = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return h(*["-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells])


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(level, at, now):
    """(top, siblings, folded) of the node at a place of a level."""
    proof = []
    while len(level) > 1:
        a = at // 16 * 16
        run = level[a:a + 16]
        others = run[:at - a], run[at - a + 1:]
        proof += others[0] + others[1]
        now = h(*others[0], now, *others[1])
        level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
        at //= 16
    return level[0], proof, now


def plain(rows):
    """One tuple per row as ``prove`` returns them."""
    by = {}
    for r in rows:
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        own, now = leaf_of(r, r.text), leaf_of(r, lower(r.text) if hit else r.text)
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, own, now, r.doc_id))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    lists = {s: sorted(by[s], key=lambda x: x[:4]) for s in order}
    tops = [climb([x[2] for x in lists[s]], 0, "")[0] for s in order]
    out = []
    for t, s in enumerate(order):
        level = [x[2] for x in lists[s]]
        for at, x in enumerate(lists[s]):
            sub, proof, now = climb(level, at, x[3])
            root, more, folded = climb(tops, t, now)
            out.append((x[4], x[2], sub, root, h(*proof, *more), folded, folded == root))
    return sorted(out, key=str)


def got(df):
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert df.columns == cols
    return sorted([tuple(r) for r in df.collect()], key=str)


def proved(docs):
    return mk.prove(mk.build(docs, mk.tampered_text()))


def test_query_against_plain_trees(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(sf + "/documents.parquet").collect()
    out = got(QUERIES["op13_merkle_manifest"](spark, sf))
    assert out == plain(rows)
    assert {r[-1] for r in out} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [300, 1, 16, 2], [1] * 20, [257] + [3] * 17])
def test_tree_shapes(spark, sizes):
    docs = spark.createDataFrame(
        [(1000 * s + i, f"S{s:03d}" if s else None, "en", i, f"Text {i} A") for s, n in enumerate(sizes)
         for i in range(n)], "doc_id long, source string, lang string, n_chars long, text string")
    assert got(proved(docs)) == plain(docs.collect())


def test_odd_rows_and_empty_table(spark, odd_docs):
    assert got(proved(odd_docs)) == plain(odd_docs.collect())
    assert got(proved(odd_docs.where("false"))) == []


def test_every_change_is_found(spark, odd_docs):
    m = mk.build(odd_docs, F.concat(F.col("text"), F.lit("!")))
    rows = mk.prove(m).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all(r.verified == (r.text is None) for r in rows)
    untouched = mk.prove(mk.build(odd_docs)).collect()
    assert all(r.verified for r in untouched) and len(untouched) == odd_docs.count()


def test_no_more_rows_in_the_recursion_than_runs_and_limit_is_restored(spark):
    n = 40_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"),
                                 F.lit("en").alias("lang"), F.lit(1).alias("n_chars"),
                                 F.col("id").cast("string").alias("text"))
    spark.conf.set(mk.ROW_LIMIT, "1000")
    try:
        m = mk.build(docs)
        assert m.height == 3 and m.runs.count() == n // 16
        assert mk.prove(m).where("verified").count() == n
        assert spark.conf.get(mk.ROW_LIMIT) == "1000"
    finally:
        spark.conf.unset(mk.ROW_LIMIT)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    rel = con.sql(ORACLE["op13_merkle_manifest"])
    df = QUERIES["op13_merkle_manifest"](spark, sf)
    assert sorted(rel.columns) == sorted(df.columns)
    want = sorted(rel.select(", ".join(df.columns)).fetchall(), key=str)
    assert got(df) == want
