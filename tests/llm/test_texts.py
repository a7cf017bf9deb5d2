"""Ops 1, 5, 6 and 10 against brute force, round trips and held-out accuracy."""

import random
import re

import numpy as np
import pytest

from wordmill.llm import decontaminate as dc
from wordmill.llm import html_extract as hx
from wordmill.llm import html_tree as ht
from wordmill.llm import pii
from wordmill.llm import toxicity as tx

SMALL = tx.Settings(buckets=1 << 14, epochs=40)


def toxic_sample(n=400, seed=3):
    rng = random.Random(seed)
    plain = ["table", "river", "window", "garden", "letter", "market", "engine", "silver"]
    bad = ["moron", "idiot", "scumbag"]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(40)]
        if i % 4 == 0:
            w[rng.randrange(40)] = rng.choice(bad)
            w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_model_learns_and_shares_subwords():
    texts, y = toxic_sample()
    m = tx.train(texts[:300], y[:300], np.ones(300), SMALL)
    value = m.word_values()

    def score(t):
        z = sum((value(w) for w in t.split()), 0j)
        return 1 / (1 + np.exp(-(z.real / max(1, z.imag) + m.bias)))
    got = np.array([score(t) > 0.5 for t in texts[300:]])
    assert (got == (y[300:] == 1)).mean() > 0.95
    clean = "table river window garden letter market engine silver " * 4
    assert score(clean) < 0.3 < score(clean + "moronn idiott scumbagg morons idiots")  # unseen forms


def test_training_and_folded_scores_against_a_plain_computation(spark):
    texts, labels = toxic_sample(60)
    labels = np.array(labels)
    s = tx.Settings(epochs=25, buckets=1 << 12, dim=3)
    g = np.where(labels == 1, 2.0, 0.5)
    model = tx.train(texts, labels, g, s)
    bag = np.zeros((len(texts), s.buckets))          # the whole matrix of mean subword counts
    for i, t in enumerate(texts):
        for w in t.split():
            for r in tx.subwords(w, s):
                bag[i, r] += 1
    bag /= np.maximum(1, bag.sum(1, keepdims=True))
    seen = np.flatnonzero(bag.any(0))
    x, g = bag[:, seen] * s.scale, g / g.sum()
    rng = np.random.default_rng(s.seed)
    theta = [rng.normal(0, 0.1, (s.dim, len(seen))), rng.normal(0, 0.3, s.dim)]
    p0 = (labels * g).sum()
    theta.append(np.log(p0 / (1 - p0)))
    m, v = [0 * t for t in theta], [0 * t for t in theta]
    for step in range(1, s.epochs + 1):
        e, w, b = theta
        err = (1 / (1 + np.exp(-(x @ e.T @ w + b))) - labels) * g
        grads = [np.outer(w, x.T @ err) + s.decay * e, e @ x.T @ err, err.sum()]
        rate = s.rate * (1 - 0.95 * step / s.epochs)
        for k, d in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            theta[k] = theta[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    e, w, b = theta
    want = 1 / (1 + np.exp(-(x @ e.T @ w + b)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.s for r in df.select("doc_id", tx.scorer(spark, model)("text").alias("s")).orderBy("doc_id").collect()]
    assert np.allclose(got, want, atol=2e-3) and want.max() - want.min() > 0.3


def test_bytes_of_the_sample_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (2000 if i % 10 == 0 else 20)) for i in range(80)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(tx, "train", lambda texts, y, w, s: seen.append((texts, y, w)))
    tx.fit(docs, labels, tx.Settings(max_bytes=1000))
    texts, y, w = seen[0]
    assert {len(t) for t in texts} == {100} and (y == 0).sum() == (y == 1).sum() == 10
    known = docs.where(tx.fold(docs["doc_id"]) != 2).count()
    assert abs(w.sum() - known) < 1e-9        # a class weighs what the whole labelled class does


def test_toxicity_on_odd_rows(spark, odd_docs, odd_labels):
    got = tx.score_documents(odd_docs, odd_labels, SMALL).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert tx.score_documents(odd_docs.limit(0), odd_labels, SMALL).count() == 0
    assert tx.score_documents(odd_docs, odd_labels.limit(0), SMALL).count() == odd_docs.count()
    assert tx.drop_toxic(odd_docs, odd_labels, SMALL, threshold=2.0).columns == odd_docs.columns


def luhn(d):
    x = [int(c) for c in d][::-1]
    return sum(v if i % 2 == 0 else (2 * v - 9 if 2 * v > 9 else 2 * v) for i, v in enumerate(x)) % 10 == 0


def test_pseudonyms(spark):
    rng = random.Random(1)
    cards = []
    while len(cards) < 60:
        c = "".join(rng.choice("0123456789") for _ in range(rng.choice([13, 15, 16, 19])))
        cards += [c] * luhn(c)
    ips = [f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(40)]
    days = [f"{rng.randrange(1800, 2200)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}" for _ in range(40)]
    ssns = [f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(40)]
    phones = [f"+1 ({rng.randrange(1000):03d}) {rng.randrange(1000):03d}-{rng.randrange(10000):04d}" for _ in range(40)]
    mails = [f"{w}.{rng.randrange(100)}@mail.example.com" for w in ("Ann", "bob", "x", "verylongnameofaperson")]
    values = [*cards, *ips, *days, *ssns, *phones, *mails]
    docs = [(i, f"a {v} b {v}, c") for i, v in enumerate(values)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    new = {}
    for i, v in enumerate(values):
        a, b = re.fullmatch(r"a (.*) b (.*), c", got[i].text).groups()
        assert a == b and got[i].n_values == 2
        assert re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", a))) == \
            re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v))) or v in ips
        new[v] = a
    assert len(set(new.values())) == len(set(values))
    assert all(luhn(new[c]) for c in cards)
    assert all(max(map(int, new[x].split("."))) < 256 for x in ips)
    assert sum(new[v] != v for v in values) > 0.95 * len(values)
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, "other").collect()}
    assert sum(other[i] == got[i].text for i in other) < 10


def test_small_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = [r[0] for r in df.select(pii.permute_digits(F.col("d"), "k", "t")).collect()]
    assert sorted(out) == [f"{i:03d}" for i in range(1000)]


@pytest.mark.parametrize("text", [
    "12 " * 20_000, "12 " * 200_000, "1-" * 100_000, "a@" + "b." * 5_000 + "com", "a." * 100_000 + "@b.com",
    "x@y." + "z" * 200_000, "+1" + " 2" * 100_000, "1.2." * 50_000, "4111 " * 50_000])
def test_pii_of_very_long_groups_ends(spark, text):
    mail = " mail kim@example.com"
    rows = spark.createDataFrame([(1, text + mail)], "doc_id long, text string")
    out = pii.pseudonymise(rows, "key").collect()[0]
    assert out.n_email >= 1 and not out.text.endswith(mail) and out.text.endswith("@example.com")
    assert len(out.text) == len(text + mail)


def plain_feistel(x, y, a, b, key, tweak):
    """The network stated anew: F is the first 15 hex digits of a SHA-256."""
    import hashlib
    turn = lambda i, v: int(hashlib.sha256(f"{key}|{tweak}|{i}|{v}".encode()).hexdigest()[:15], 16)
    for i in range(10):
        if i % 2 == 0:
            x = (x + turn(i, y) % a) % a
        else:
            y = (y + turn(i, x) % b) % b
    return x, y


def test_pii_values_against_a_plain_network(spark):
    import datetime as dt
    values = ["123-45-6789", "10.20.30.40", "2024-05-01", "2024/05/01", "+1 212 555 0100", "212.555.0100",
              "212 555 0100", "4111.1111.1111.1111", "4111111111111111"]
    df = spark.createDataFrame([(i, f"a {v}, b") for i, v in enumerate(values)], "doc_id long, text string")
    got = [r.text[2:-3] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]

    def digits(d, kind):
        h = len(d) // 2
        x, y = plain_feistel(int(d[:h] or 0), int(d[h:]), 10 ** h, 10 ** (len(d) - h), "k", f"{kind}|{len(d)}")
        return (f"{x:0{h}d}" if h else "") + f"{y:0{len(d) - h}d}"

    def fill(form, d):
        d = iter(d)
        return "".join(next(d) if c.isdigit() else c for c in form)

    def card(form):
        body = digits("411111111111111", "card")
        check = next(c for c in "0123456789" if sum(
            int(x) if i % 2 == 0 else sum(map(int, str(2 * int(x)))) for i, x in enumerate((body + c)[::-1])) % 10 == 0)
        return fill(form, body + check)

    x, y = plain_feistel(123 - 1, 44 * 9999 + 6788, 898, 989_901, "k", "ssn")
    area = x + 1 + (x + 1 >= 666)
    ssn = f"{area:03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    x, y = plain_feistel(10 * 256 + 20, 30 * 256 + 40, 65536, 65536, "k", "ip")
    ip = f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    day = (dt.date(2024, 5, 1) - dt.date(1800, 1, 1)).days
    x, y = plain_feistel(day // 5411, day % 5411, 27, 5411, "k", "date")
    date = dt.date(1800, 1, 1) + dt.timedelta(x * 5411 + y)
    phone = digits("2125550100", "phone")
    assert got == [ssn, ip, f"{date:%Y-%m-%d}", f"{date:%Y/%m/%d}", fill("+1 ", "1") + fill("212 555 0100", phone),
                   fill("212.555.0100", phone), fill("212 555 0100", phone), card("4111.1111.1111.1111"),
                   card("4111111111111111")]


def test_pii_of_texts_with_the_marks(spark):
    rows = [(1, "a kim@example.com b"), (2, "a kim@example.com b \ufdd0 123-45-6789"), (3, "\ufdd1"), (4, "")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(
        spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    assert got[2].startswith(got[1] + " \ufdd0 ") and got[3] == "\ufdd1" and got[4] == ""
    assert "123-45-6789" not in got[2] and len(got[2]) == len(rows[1][1])


def test_pii_leaves_the_rest(spark, odd_docs):
    got = pii.pseudonymise(odd_docs, "key").collect()
    assert sorted(str((r.doc_id, r.text)) for r in got) == \
        sorted(str((r.doc_id, r.text)) for r in odd_docs.collect())
    bad = ["2021-02-30", "300.1.1.1", "4845168114407320", "000-12-3456", "x4845168114407329", "1.2.3.4.5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "doc_id long, text string")
    assert [r.text for r in pii.pseudonymise(df, "key").orderBy("doc_id").collect()] == bad
    assert pii.pseudonymise(odd_docs.limit(0), "key").count() == 0


def test_free_forms_of_personal_data(spark):
    one = {"date": ["2024-05-01T12:00", "5/1/2024", "1.5.2024", "13/5/2024", "2024-5-1"],
           "card": ["3782 822463 10005", "12 3782-822463-10005 7", "37 82 8224 6310 005",
                    "12 4845 1681 1440 7329"],
           "phone": ["+44 20 7946 0958", "+49 (0)30 12345", "+49 30 123456 and", "+33 1 23 45 67 89"]}
    two = {"date": ["2024-01-01/2024-02-01", "2024-01-01T10:00Z/2024-02-01T11:00Z", "1.5.2024-3.5.2024",
                    "1/5/2024-2/5/2024"], "phone": ["+1 212 555 0100 212-555-0199"]}
    rows = [(f"a {t} b", k, n) for n, f in ((1, one), (2, two)) for k, ts in f.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    for i, (t, k, n) in enumerate(rows):
        assert (t, got[i][f"n_{k}"], got[i].n_values) == (t, n, n)
        assert got[i].text != t
    # numbers next to others keep their kinds
    other = ["100 212-555-0100", "5 2024-01-15 1234", "1234 5678 9012 10.0.0.1", "3 123-45-6789 2020"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(other)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "key").collect()}
    assert [got[i][f"n_{k}"] for i, k in enumerate(["phone", "date", "ip", "ssn"])] == [1] * 4


def items(rng, n=60):
    w = [f"w{i}" for i in range(900)] + ["the", "of", "and"] * 60
    return [(i, " ".join(rng.choice(w) for _ in range(rng.randrange(12, 40))) + ". "
             + " ".join(rng.choice(w) for _ in range(8)) + ".") for i in range(n)]


def test_wand_equals_exhaustive_scoring():
    rng = random.Random(2)
    ix = dc.build_index(items(rng), threshold=0.3)
    for _ in range(200):
        i = rng.randrange(60)
        q = sorted(set(rng.sample(range(len(ix.terms)), 20))
                   | set(rng.sample(sum(ix.parts[i], []), rng.randrange(1, 12))))
        full = np.zeros(60)
        for t in q:
            full[ix.items[ix.first[t]:ix.first[t + 1]]] += ix.impacts[ix.first[t]:ix.first[t + 1]]
        want = {i for i in range(60) if full[i] >= 0.3 - 1e-9}
        got = dict(dc.wand(ix, q))
        assert set(got) == want and all(abs(got[i] - full[i]) < 1e-9 for i in want)


def test_leaks_found_and_clean_kept(spark):
    rng = random.Random(4)
    bench = items(rng)
    noise = [f"n{i}" for i in range(3000)] + ["the", "of", "and"] * 300 + [f"w{i}" for i in range(900)]
    docs, want = [], set()
    for d in range(120):
        words = [rng.choice(noise) for _ in range(rng.randrange(1, 900))]
        if d % 3 == 0:
            i = rng.randrange(60)
            at = rng.randrange(len(words) + 1)
            words[at:at] = bench[i][1].upper().replace(" ", "\n" if d % 2 else " ").split(" ")
            want.add((d, i))
        elif d % 3 == 1:                      # the question without its answer
            words += bench[rng.randrange(60)][1].split(". ")[0].split()
        docs.append((d, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.leaks(df, b).collect()}
    assert got == want
    kept = {r.doc_id for r in dc.drop_leaks(df, b).collect()}
    assert kept == set(range(120)) - {d for d, _ in want}


def test_items_in_parts_give_the_hits_of_one_index(spark, monkeypatch):
    rng = random.Random(9)
    bench = items(rng) + [(900, "w1 w2 " * 60 + "w3. w4 w5 w6 w7 w8 w9"), (901, None), (902, " "), (None, "w1 w2 w3")]
    bench += bench[:2]                        # items that repeat
    docs = [(d, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(900)))
             + " " + (bench[rng.randrange(60)][1] if d % 2 else "")) for d in range(60)]
    df = spark.createDataFrame([*docs, (None, bench[0][1]), (70, None), (71, "")], "doc_id long, text string")
    b = spark.createDataFrame(bench, "item_id long, text string").repartition(3)
    whole = sorted(map(str, dc.leaks(df, b).collect()))
    kept = sorted(map(str, dc.drop_leaks(df, b).collect()))
    monkeypatch.setattr(dc, "MAX_INDEX_BYTES", 12 * 2500)
    assert dc.load_index(b) is None
    assert len(whole) > 30 and sorted(map(str, dc.leaks(df, b).collect())) == whole
    assert sorted(map(str, dc.drop_leaks(df, b).collect())) == kept


def test_leaks_on_odd_rows(spark, odd_docs):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and slept all day long"), (2, None), (3, ""),
                                   (None, "eins zwei drei")], "item_id long, text string")
    got = dc.leaks(odd_docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 1), (1, 1), (2, 1)]
    assert dc.drop_leaks(odd_docs, bench).columns == odd_docs.columns
    assert dc.leaks(odd_docs.limit(0), bench).count() == 0
    assert dc.leaks(odd_docs, bench.limit(0)).count() == 0
    assert dc.drop_leaks(odd_docs, bench.limit(0)).count() == odd_docs.count()


PAGE = ("<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body>"
        "<header><h2>Site</h2></header><nav><ul><li><a href=/a>A{n}</a></ul></nav><div class='ad box'>buy</div>"
        "<div id=wrap><div class=story><h1>Head {n}</h1><p>One &amp; <b>tw</b>o {n}<br>x<p>Para {n}</p>"
        "<p>Share this page</p><span class=promo>no</span></div></div>"
        "<div class=comments><p>reader {n}</p></div><footer>&copy; {n}</footer></body>")


def test_wrapper_takes_slots_and_leaves_template():
    pages = [PAGE.replace("{n}", str(n) * 3) for n in range(8)]
    w = hx.induce(pages)
    assert w["region"] and w["template"]
    assert hx.extract(pages[3], w) == "Head 333 One & two 333 x Para 333"
    assert hx.extract("<p>no such page</p>", w) == "no such page"
    assert hx.induce(pages[:1]) == {"region": None, "template": []}
    assert hx.extract(None) == "" and hx.extract("") == "" and hx.extract("a < b &amp c") == "a < b & c"


def test_all_regions_of_a_host_are_kept():
    two = ("<body><div class=a><article class=lead><p>Lead {n}</p></article></div>"
           "<article class=rest><p>Rest {n}</p></article><p>menu</p></body>")
    pages = [two.replace("{n}", str(n) * 3) for n in range(6)]
    w = hx.induce(pages)
    assert hx.extract(pages[2], w) == hx.extract(pages[2]) == "Lead 222 Rest 222"
    other = "<body><main id=m><p>Other</p></main></body>"      # a kind of page not sampled
    assert hx.extract(other, w) == "Other"


def test_text_outside_the_largest_block_is_kept():
    page = ("<body><p>Site</p><div class=wrap>{lead}<div class=text><p>" + "long text {n} " * 20
            + "</p><p>more {n}</p></div></div></body>")
    pages = [page.replace("{lead}", f"<h1>Head {n}</h1>").replace("{n}", str(n) * 3) for n in range(6)]
    w = hx.induce(pages)
    assert hx.extract(pages[1], w).startswith("Head 1 long text 111")
    assert "Site" not in hx.extract(pages[1], w)
    # a headline on some pages only, not on the one that the alignment starts from
    some = [p if n == 0 else p.replace(f"<h1>Head {n}</h1>", "") for n, p in enumerate(pages)]
    assert hx.extract(some[0], hx.induce(some)).startswith("Head 0 long text 000")


def test_large_pages_and_numbered_ids_have_a_template():
    page = ("<body><div id=post-{n}><h1>Head {n}</h1>" + "<p>Para {n} of a long page</p>" * hx.MOST_NODES
            + "<p>Share this page</p></div></body>")
    for html in (page, page.replace("<p>Para {n} of a long page</p>" * hx.MOST_NODES, "<p>Para {n}</p>")):
        pages = [html.replace("{n}", str(n) * 3) for n in range(6)]
        text = hx.extract(pages[4], hx.induce(pages))
        assert text.startswith("Head 444 Para 444") and "Share" not in text


def test_copies_do_not_fill_the_sample(spark):
    pages = [(n, "http://copies.example/", PAGE.replace("{n}", "7" if n >= 8 else str(n) * 3))
             for n in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in hx.extract_pages(df).collect()}
    assert len(got) == 400
    assert all(got[n] == f"Head {str(n) * 3} One & two {str(n) * 3} x Para {str(n) * 3}" for n in range(8))


def test_all_pages_of_a_host_are_counted(spark):
    """Twelve small pages that say nothing of what most pages of their hosts, large ones, have: a
    fixture inside the article, a headline outside the text's block."""
    para = "".join(f"<p>Line {k}</p>" for k in range(hx.MOST_NODES))
    place = "<body><p>Site</p><div class=wrap>{head}<div class=text><p>Text {i}</p>{more}</div></div></body>"
    pages = []
    for i in range(30):
        large = i >= 12
        pages.append((i, "http://a/", marked(i, "related-now" if large else "x").replace(
            "</h1>", "</h1>" + para if large else "</h1>")))
        pages.append((100 + i, "http://b/", place.format(
            head=f"<h1>Head {i}</h1>" if large else "", i=i, more=para if large else "<p>And so on</p>")))
    got = {r.page_id: r.text for r in hx.extract_pages(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert ("Part" in got[i]) == (i < 12) and got[i].startswith(f"Title {i} ")
        assert got[100 + i].startswith(f"Head {i} Text {i} Line 0" if i >= 12 else f"Text {i} And so on")


def test_an_empty_page_does_not_hide_the_template():
    pages = [PAGE.replace("{n}", str(n) * 3) for n in range(8)]
    assert hx.induce([*pages, "", None]) == hx.induce(pages)


def test_article_and_broken_markup():
    h = "<body><article><header><h1>T</h1></header><p><b>a<br><p>b &amp; c<!-- x --><form>f</form>d</article>z"
    assert hx.extract(h) == "T a b & c d"
    assert hx.extract("<ul><li>one<li>two</ul><p>x<div>y</div>") == "one two x y"
    assert hx.extract("<article><p>x</p><article><p>y</p></article></article><p>z</p>") == "x y"
    assert hx.extract("<p title='a>b'>q</p><p") == "q"


def test_tree_matching_equals_plain_recursion():
    rng = random.Random(6)

    def tree(depth):
        return f"<{(t := rng.choice(['div', 'section']))}>" + "".join(
            tree(depth - 1) for _ in range(rng.randrange(0, 4)) if depth) + f"{rng.randrange(2)}</{t}>"

    def plain(x, y):
        if x.label != y.label:
            return 0.0
        xs, ys = x.children, y.children

        def best(i, j):
            if i == len(xs) or j == len(ys):
                return 0.0
            return max(best(i + 1, j), best(i, j + 1), plain(xs[i], ys[j]) + best(i + 1, j + 1))
        return 1.0 + 0.5 * (x.text() == y.text()) + best(0, 0)
    for _ in range(30):
        a, b = ht.parse(tree(2)), ht.parse(tree(2))
        pairs = []
        assert ht.match(a, b, pairs) == plain(a, b)
        assert sum(1 + 0.5 * (x.text() == y.text()) for x, y in pairs) == plain(a, b)


def test_pages_on_odd_rows(spark):
    pages = [(n, f"http://Host.example/{n}", PAGE.replace("{n}", str(n) * 3), 1) for n in range(8)]
    pages += [(8, None, PAGE.replace("{n}", "8"), 1), (9, "not a url", None, 1), (None, "http://x.y/", "", 1),
              (3, "http://host.example:80/3", pages[3][2], 1), (10, "http://one.example", "<p>hi &lt; you</p>", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, w int")
    got = hx.extract_pages(df).collect()
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[3] == "Head 333 One & two 333 x Para 333" and by[9] == "" and by[None] == ""
    assert by[10] == "hi < you" and by[8].startswith("Head 8")
    assert hx.extract_pages(df.limit(0)).count() == 0


def test_deep_pages_end(spark):
    """One nested page in a host of flat ones, and a host of nested ones."""
    deep = lambda n, i: ("<html><body><nav>x</nav><article>" + "<div>" * n + f"deep text {i}"
                         + "</div>" * n + f"<p>end {i}</p></article></body></html>")
    rows = [(i, "http://a/x", deep(3, i)) for i in range(8)] + [(8, "http://a/x", deep(30_000, 8))]
    rows += [(20 + i, "http://b/x", deep(1_400, i)) for i in range(6)]
    rows += [(40, "http://b/x", "<p><b>" * 20_000 + "open")]
    got = {r.page_id: r.text for r in hx.extract_pages(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, _ in rows[:-1]:
        k = i if i < 20 else i - 20
        assert got[i] == f"deep text {k} end {k}"
    assert got[40] == "open"


def test_a_form_round_the_page_is_a_frame():
    page = ("<html><body><form id=aspnetForm><nav>Menu words</nav><div><p>The article's text is here and long."
            "</p><form class=search><input>Find it</form></div></form></body></html>")
    assert hx.extract(page) == "The article's text is here and long."
    page = ("<body><div><p>The article's text is here and long.</p><form>Your name, please</form></div></body>")
    assert hx.extract(page) == "The article's text is here and long."


def marked(i, cls):
    return (f"<html><body><article><h1>Title {i}</h1><p>Text of page {i}.</p><div class='{cls}'>Part {i * 7}</div>"
            f"<div class='share-buttons'>Tell {i}</div></article></body></html>")


def test_marked_words_inside_an_article_are_for_the_wrapper():
    for cls in ("related-work", "social-history", "banner-making"):
        assert hx.extract(marked(1, cls)) == "Title 1 Text of page 1. Part 7"
    for cls in ("related-links", "comments", "ad slot", "newsletter-box"):
        assert hx.extract(marked(1, cls)) == "Title 1 Text of page 1."
    # on most pages of a host it is a fixture, on one of them a part of its text
    w = hx.induce([marked(i, "related-now") for i in range(8)])
    assert hx.extract(marked(9, "related-now"), w) == "Title 9 Text of page 9."
    w = hx.induce([marked(0, "related-work")] + [marked(i, "x") for i in range(1, 8)])
    assert hx.extract(marked(9, "related-work"), w) == "Title 9 Text of page 9. Part 63"


def test_hosts_without_article_elements():
    """Recall and precision of words on hosts whose article is only known by its slots."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    right = kept = wanted = 0
    for h in range(12):
        tag, bar = rng.choice(["div", "td", "section"]), text(8)
        pages, truth = [], []
        for i in range(14):
            paras = [text(rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
            head = text(5)
            truth.append([head, *paras])
            pages.append(f"<html><body><div class=x{h}><div>{bar}</div><{tag} class=c{h}><h1>{head}</h1>"
                         + "".join(f"<p>{p}</p>" for p in paras)
                         + f"</{tag}><div>Imprint {bar}</div></div></body></html>")
        w = hx.induce(pages[:12])
        for page, t in zip(pages, truth):
            got, want = hx.extract(page, w).split(), " ".join(t).split()
            right += len(set(got) & set(want))
            kept += len(set(got))
            wanted += len(set(want))
    assert right / wanted >= 0.99 and right / kept >= 0.95
