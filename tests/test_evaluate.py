"""Losses and metrics: hand cases from the fixture table and numeric statements."""

import math

import numpy as np

from wordmill.functions import scoring as sc
from wordmill.operators import evaluate as ev, lm


def test_perplexity_is_mean_of_exp(spark):
    df = spark.createDataFrame([(0, 0.0), (1, math.log(3))], "row_idx long, loss double")
    assert abs(ev.perplexity(df).first()["ppl"] - 2.0) < 1e-12


def test_batch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 4.0)], "row_idx long, loss double")
    assert abs(ev.batch_averaged_metrics(df, 2).first()["loss"] - 2.5) < 1e-12
    assert abs(ev.row_weighted_cost(df, 2).first()["cost"] - 2.0) < 1e-12


def test_class_weights_and_score_label(spark):
    df = spark.createDataFrame([(1, 3.6), (0, 0.0)], "y int, s double")
    r = df.select(sc.class_weight("y", 0.8).alias("w"),
                  sc.score_distribution_label("s", 6).alias("d")).collect()
    assert [round(x["w"], 12) for x in r] == [0.8, 0.2]
    assert [round(v, 12) for v in r[0]["d"]] == [0, 0, 0, 0.4, 0.6, 0]


def test_f1(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "y int, pred int")
    r = ev.f1(df).first()
    assert (r["tp"], r["fp"], r["fn"], r["f1"]) == (1, 1, 1, 50.0)
    none = spark.createDataFrame([(1, 0)], "y int, pred int")
    assert ev.f1(none).first()["f1"] == 0.0


def test_softmax_ce_argmax_against_numpy(spark):
    data = [([0.3, -1.2, 2.0], 2), ([5.0, 5.0, 1.0], 0), ([-3.0, 0.0, -1.0], 1)]
    df = spark.createDataFrame(data, "x array<double>, y int")
    out = df.select(sc.softmax("x", 2.0).alias("p"), sc.cross_entropy("x", "y").alias("ce"),
                    sc.argmax("x").alias("a")).collect()
    for (x, y), r in zip(data, out):
        z = np.array(x) / 2.0
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(r["p"], p) and abs(sum(r["p"]) - 1) < 1e-12
        q = np.exp(np.array(x) - max(x)) / np.exp(np.array(x) - max(x)).sum()
        assert abs(r["ce"] + math.log(q[y])) < 1e-12
        assert r["a"] == int(np.argmax(x))


def test_objective(spark):
    c = spark.createDataFrame([(1.0,), (3.0,)], "loss double")
    l = spark.createDataFrame([(4.0,)], "loss double")
    assert ev.objective(c, l, 0.5).first()["objective"] == 4.0
    assert ev.objective(c, l, 0.0).first()["objective"] == 2.0


def test_bigram_lm_matches_counts(spark):
    train = spark.createDataFrame([(0, [3, 1, 2, 5]), (1, [3, 1, 1, 5])], "row_idx long, ids array<int>")
    dev = spark.createDataFrame([(0, [3, 1, 5])], "row_idx long, ids array<int>")
    b, t = lm.fit_ngram_lm(train)
    pos = lm.score_ngram_lm(dev, b, t, 6, 1.0).orderBy("pos").collect()
    # (3->1): c=2, t(3)=2 ; (1->5): c=1, t(1)=3
    assert abs(pos[0]["loss"] + math.log(3 / 8)) < 1e-12
    assert abs(pos[1]["loss"] + math.log(2 / 9)) < 1e-12
    seq = ev.masked_seq_loss(lm.score_ngram_lm(dev, b, t, 6, 1.0)).first()["loss"]
    assert abs(seq - (pos[0]["loss"] + pos[1]["loss"]) / 2) < 1e-12


def test_pair_classifier_learns_shared_tokens(spark):
    from wordmill.operators import classifier as clf
    rows = []
    for i in range(40):
        if i % 2:
            rows.append((i, f"red apple {i}", f"red apple {i + 1}", 1))
        else:
            rows.append((i, f"blue sky {i}", f"green sea {i + 1}", 0))
    pairs = spark.createDataFrame(rows, "index long, a string, b string, label int")
    model = clf.fit_pair_classifier(pairs, max_iter=50)
    scored = clf.score_pairs(model, pairs, key="index")
    f = ev.f1(scored.withColumnRenamed("label", "y")).first()
    assert scored.count() == 40 and f["f1"] == 100.0


def test_relational_classifier_against_numpy(spark):
    from wordmill.operators import classifier as clf
    rows = [(1, "a b c", "b c d", 1), (2, "a a", "", 0), (3, "", "", 1), (4, "b", "b", 0),
            (5, "c d e", "e", 1), (6, "never seen", "words", -1)] + [(10 + i, "a", "b c", i % 2) for i in range(9)]
    df = spark.createDataFrame(rows, "pair_id long, a string, b string, label int")
    terms = [{("s:" if t in set(a.split()) & set(b.split()) else "u:") + t
              for t in set(a.split()) | set(b.split())} for _, a, b, _ in rows]
    known = [i for i, r in enumerate(rows) if r[3] >= 0]
    names = sorted(set().union(*(terms[i] for i in known)))
    x = np.array([[t in ts for t in names] for ts in terms], float)
    y = np.array([r[3] for r in rows], float)
    w = np.where(y == 1, 0.8, 0.2)
    theta, bias = np.zeros(len(names)), 0.0
    for _ in range(3):
        e = (w * (1 / (1 + np.exp(-(x @ theta + bias))) - y))[known]
        theta, bias = theta - 0.7 * x[known].T @ e / len(known), bias - 0.7 * e.sum() / len(known)
    weights, got_bias = clf.fit_linear(df, steps=3, rate=0.7)
    got = {r.term: r.w for r in weights.collect()}
    assert sorted(got) == names and abs(got_bias - bias) < 1e-12
    assert np.allclose([got[t] for t in names], theta)
    scored = clf.linear_scores(df, clf.feature_rows(df), weights, got_bias)
    z = x @ theta + bias
    assert np.allclose([r.z for r in scored.orderBy("pair_id").collect()], z)
    one = clf.weighted_loss(scored).first()
    assert one.n == len(known)
    assert math.isclose(one.loss, (w * np.log1p(np.exp(np.where(y == 1, -z, z))))[known].mean())


def test_first_step_looks_no_weight_up_and_keys_may_repeat(spark, monkeypatch):
    from wordmill.operators import classifier as clf
    rows = [(1, "a b", "b c", 1), (1, "a b", "b c", 1), (2, "c", "", 0), (None, "d", "e", 0), (3, "x", "y", -1)]
    df = spark.createDataFrame(rows, "pair_id long, a string, b string, label int")
    zero = df.where("label >= 0").selectExpr("pair_id", "label", "0.0D as z")
    g = {r["term"]: r["g"] for r in clf.gradient(zero, clf.feature_rows(df.where("label >= 0"))).collect()}
    monkeypatch.setattr(clf, "linear_scores", None)
    weights, _ = clf.fit_linear(df, steps=1, rate=1.0)
    got = {r["term"]: r["w"] for r in weights.collect()}
    assert set(got) == {"u:a", "u:c", "s:b", "u:d", "u:e"} and got["u:d"] == 0
    for t, w in got.items():
        assert abs(w + g.get(t, 0.0) / 4) < 1e-12
    # two rows of one key meet each other's errors, as in a join
    assert abs(g["s:b"] + 4 * 0.5 * clf.POS_WEIGHT) < 1e-12
