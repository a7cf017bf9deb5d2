"""Ops 4 and 9 against brute force."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from wordmill.llm import components, exact_dedup, hamming, simhash


def test_misra_gries_finds_every_frequent_value():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.choice(200, 3000, p=np.r_[[0.2, 0.1, 0.05], np.full(197, 0.65 / 197)])
        counts = {}
        for part in np.array_split(x, 7):
            counts = exact_dedup.misra_gries(counts, pd.Series(part), 20)
            assert len(counts) <= 20
        for v, n in zip(*np.unique(x, return_counts=True)):
            if n > len(x) / 21:
                assert v in counts


def test_exact_dedup_on_odd_rows(spark, odd_docs):
    for capacity in (1, 1000):
        got = exact_dedup.exact_dedup(odd_docs, capacity).collect()
        docs = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
        groups = {}
        for d, t in docs:
            h = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest()
            groups.setdefault(h, []).append((d, len(t)))
        assert len(got) == len(docs)
        for h, rows in groups.items():
            mine = [r for r in got if r.text_sha256 == h]
            most = max(n for _, n in rows)
            best = [d for d, n in rows if n == most and d is not None]
            assert [r.group_size for r in mine] == [len(rows)] * len(rows)
            assert {r.keep_id for r in mine} == {min(best) if best else None}
            assert sum(r.kept for r in mine) == 1
    assert exact_dedup.exact_dedup(odd_docs.limit(0)).count() == 0


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One TWO", "a b c", "A b c d e", "É ß x y Z",
                                  " ".join(f"w{i}" for i in range(700))])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def near_codes(rng, n, flips):
    base = rng.integers(0, 2**63, max(1, n // 6)).astype(np.uint64)
    c = base[rng.integers(0, len(base), n)].copy()
    for _ in range(flips):
        c ^= np.where(rng.random(n) < .7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64),
                      np.uint64(0))
    return np.unique(c)


def brute_classes(codes, limit=3):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= limit
    label = np.arange(len(codes))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def same_classes(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_gray_index_finds_all_links():
    rng = np.random.default_rng(2)
    for t in range(15):
        c = near_codes(rng, int(rng.integers(1, 250)), t % 4)
        ix = hamming.GrayIndex(c)
        q, leaf, _ = ix.search(c[:30], 3)
        near = np.bitwise_count(c[:30, None] ^ c[None, :]) <= 3
        assert {(int(a), int(ix.order[b])) for a, b in zip(q, leaf)} == set(zip(*map(list, np.nonzero(near))))
        assert same_classes(hamming.classes(c, 3, block=16).tolist(), brute_classes(c).tolist())


def test_links_at_every_depth(spark):
    """Small tasks force the second block and the chunk pairs."""
    rng = np.random.default_rng(3)
    c = near_codes(rng, 500, 3)
    dense = np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) \
        ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    c = np.unique(np.concatenate([c, dense]))
    codes = spark.createDataFrame(pd.DataFrame({"fp": c.view(np.int64)}))
    want = brute_classes(c)
    for per_task in (7, 50, 20_000):
        found = simhash.links(codes, 3, per_task).toPandas()
        d = np.bitwise_count(found["a"].to_numpy().view(np.uint64) ^ found["b"].to_numpy().view(np.uint64))
        roots = components.components(spark.createDataFrame(found)).toPandas()
        root = dict(zip(roots["node"], roots["root"]))
        got = [root.get(x, x) for x in c.view(np.int64).tolist()]
        assert same_classes(got, want.tolist())
        assert d.size > 0


def test_components(spark):
    rng = np.random.default_rng(4)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    rest = [(int(a), int(b)) for a, b in rng.integers(2000, 2100, (60, 2))]
    df = spark.createDataFrame(chain + star + rest + [(5, 5), (0, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in chain + star + rest:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in chain + star + rest if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_simhash_on_odd_rows(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    fps = np.array([brute_fingerprint(t) for _, t in docs], np.uint64)
    codes = np.unique(fps)
    label = dict(zip(codes.tolist(), brute_classes(codes).tolist()))
    least = {}
    for (d, _), f in zip(docs, fps.tolist()):
        if d is not None:
            k = label[f]
            least[k] = min(least.get(k, d), d)
    want = sorted(str((d, "%016x" % f, least.get(label[f]))) for (d, _), f in zip(docs, fps.tolist()))
    got = simhash.groups(odd_docs)
    got = got.select("doc_id", simhash.hex_fingerprint("fp"), "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    heads = [least.get(k) for k in {label[f] for f in fps.tolist()}]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, heads))
    assert simhash.groups(odd_docs.limit(0)).count() == 0
    assert simhash.keep_one(odd_docs.limit(0)).count() == 0
