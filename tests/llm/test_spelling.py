"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordmill.llm import spelling as sp
from wordmill.llm.queries import QUERIES


def words_of(rows, noise=97):
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            yield run


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def plain(rows, min_length=5, min_count=3, noise=97):
    n = {w: c for w, c in Counter(words_of(rows, noise)).items() if len(w) >= min_length and c >= min_count}
    by = {}
    for w in n:                                   # words with a deletion in common, then compared
        for x in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            by.setdefault(x, []).append(w)
    near = {w: set() for w in n}
    for same in by.values():
        for a in same:
            near[a] |= {b for b in same if one_apart(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(sf + "/documents.parquet").select("doc_id", "text").collect()]
    want = plain(rows)
    assert any(r[1] for r in want)
    assert got(QUERIES["op12_spelling_variants"](spark, sf)) == want


@pytest.mark.parametrize("symbols", [2, 3, 7, 26])
def test_all_pairs_at_any_alphabet(spark, symbols):
    rng = random.Random(symbols)
    letters = "abyzàéÿÉ"
    words = {"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(300)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = [tuple(r) for r in sp.near_pairs(df, symbols).select("word", "other").collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_apart(a, b)}


def test_neighbourhoods_are_whole_and_without_repeats(spark):
    forms = [(0, "0010"), (1, "1"), (2, "22")]
    df = spark.createDataFrame(forms, "form long, r string")
    near = [tuple(r) for r in sp.neighbourhoods(df, 3).collect()]
    assert len(near) == len(set(near))
    for k, r in forms:
        texts = {r} | {r[:i] + r[i + 1:] for i in range(len(r))}
        texts |= {r[:i] + s + r[i + d:] for i in range(len(r) + 1) for s in "012" for d in (0, 1)
                  if i + d <= len(r)}
        hashes = {x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string")
                  .select(F.xxhash64("t")).collect()}
        assert {b for a, b in near if a == k} == hashes


def test_forms_are_followed_to_the_last(spark):
    chain = [f"n{i}" for i in range(40)]
    df = spark.createDataFrame(list(zip(chain, chain[1:] + [None])), "word string, form string")
    assert {tuple(r) for r in sp.roots(df).collect()} == {(w, "n39") for w in chain[:-1]}


def test_ties_case_and_chains(spark):
    texts = ([("Straße strasse",)] * 3 + [("Colour",)] * 20 + [("COLOR",)] * 20 + [("colör",)] * 4
             + [("coloor",)] * 10 + [("coloor x coloors",)] * 3 + [("ÀÉÎÕÜ àéîõü",)] * 3)
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = [tuple(r) for r in docs.collect()]
    assert got(sp.variants(docs, noise=97)) == plain(rows)
    assert got(sp.variants(docs, min_length=3, min_count=1, noise=2)) == plain(rows, 3, 1, 2)


def test_odd_rows_and_empty_table(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(sp.variants(odd_docs, 3, 1, noise=5)) == plain(rows, 3, 1, 5)
    assert got(sp.variants(odd_docs.where("false"), noise=97)) == set()


def test_more_symbols_for_larger_vocabularies():
    q = [sp.n_symbols({k: n for k in range(5, 12)}) for n in (10, 10**4, 10**6, 10**9)]
    assert q == sorted(q) and q[0] < q[-1] <= len(sp.SYMBOLS)
