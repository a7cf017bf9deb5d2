"""Toxicity scoring with subword-bag embeddings.

A text is a bag of subwords: every word (lower-case, between white space, outer punctuation off)
gives itself and its character n-grams with word-boundary marks. Subwords are hashed into rows
of an embedding table; the mean of a text's rows goes into a linear softmax, and both are trained
together, so a misspelling that was never seen still shares most n-gram rows with the word.

Training runs in numpy on the driver over a bounded sample of labelled texts (``Settings``);
scoring is one narrow scan. After training, embedding and softmax fold into one weight per
subword, so a word adds (sum of weights, number of subwords), cached per worker.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm.common import ship
from wordmill.llm.tokens import PieceCache

PART = 1 << 20     # entries summed at a time: bounds the driver's memory
PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”‘’…—–"


@dataclass(frozen=True)
class Settings:
    """``max_toxic`` and ``max_clean`` bound the labelled sample (rows by hash of the id) and
    ``max_bytes`` the text that a class brings to the driver; labelled texts of over an eighth of
    that are not learned from. Documents of a class weigh as much as the whole labelled class."""
    max_toxic: int = 1000
    max_clean: int = 3000
    max_bytes: int = 16 << 20
    buckets: int = 1 << 18
    n_min: int = 3
    n_max: int = 5
    dim: int = 4
    epochs: int = 100
    rate: float = 0.05
    decay: float = 3e-5
    scale: float = 30.0
    seed: int = 7


def subwords(word: str, s: Settings) -> set[int]:
    """Table rows of a word: the word itself and the n-grams of ``<word>``, each once. A word
    longer than 40 characters gives n-grams too, all of them."""
    from xxhash import xxh32_intdigest as h
    w = f"<{word.lower().strip(PUNCT)}>"
    n = len(w)
    buckets = s.buckets
    rows = {h(w) % buckets}
    for k in range(s.n_min, s.n_max + 1):
        rows.update([h(w[i:i + k]) % buckets for i in range(n - k + 1)])
    return rows


@dataclass
class Model:
    """``weight``: one number per table row (embedding times softmax difference); ``bias``."""
    settings: Settings
    weight: np.ndarray
    bias: float

    def word_values(self):
        """A function word -> (sum of weights, number of subwords) as a complex number."""
        weight, s = self.weight.tolist(), self.settings

        def value(word: str) -> complex:
            rows = subwords(word, s)
            return complex(sum([weight[r] for r in rows]), len(rows))
        return value


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, s: Settings) -> Model:
    """Full-batch Adam on the weighted log loss of the softmax over mean embeddings."""
    rng = np.random.default_rng(s.seed)
    vocab: dict[str, int] = {}
    doc_words, doc_counts, starts = [], [], [0]
    for t in texts:
        ids = np.array([vocab.setdefault(w, len(vocab)) for w in (t or "").split()], np.int32)
        u, c = np.unique(ids, return_counts=True)
        doc_words.append(u.astype(np.int32))
        doc_counts.append(c.astype(np.float32))
        starts.append(starts[-1] + len(u))
    if not vocab or len(set(labels.tolist())) < 2:
        p = float((labels * weights).sum() / weights.sum()) if len(labels) else 0.0
        p = min(max(p, 1e-4), 1 - 1e-4)
        return Model(s, np.zeros(s.buckets, np.float32), float(np.log(p / (1 - p))))
    flat, sizes = array("i"), array("i")
    for word in vocab:
        found = sorted(subwords(word, s))
        flat.extend(found)
        sizes.append(len(found))
    vocab.clear()
    n_sub = np.frombuffer(sizes, np.int32).astype(np.int64)
    sub = np.frombuffer(flat, np.int32)
    seen = np.zeros(s.buckets, bool)
    seen[sub] = True
    rows = np.flatnonzero(seen)                              # only rows that occur are trained
    place = np.cumsum(seen, dtype=np.int32) - 1
    # blocks of whole words of about PART subwords: sums go block by block to bound memory
    ends = np.cumsum(n_sub)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(
        ends, np.arange(PART, int(ends[-1]), PART)) + 1, [len(n_sub)]]))
    starts_at = np.concatenate([[0], ends])
    blocks = [(a, b, place[sub[starts_at[a]:starts_at[b]]]) for a, b in zip(cuts, cuts[1:])]
    del sub, flat
    words, counts = np.concatenate(doc_words), np.concatenate(doc_counts)
    docs = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(starts))
    by_word = np.argsort(words, kind="stable")
    word_at = np.searchsorted(words[by_word], np.arange(len(n_sub)))
    size = np.maximum(1, np.bincount(docs, counts * n_sub[words], len(texts)))
    e = rng.normal(0, 0.1, (s.dim, len(rows))).astype(np.float32)
    w = rng.normal(0, 0.3, s.dim).astype(np.float32)
    y, g = labels.astype(np.float64), weights / weights.sum()
    p0 = float(np.clip((y * g).sum(), 1e-4, 1 - 1e-4))
    b = np.float64(np.log(p0 / (1 - p0)))
    me, ve, mw, vw, mb, vb = np.zeros_like(e), np.zeros_like(e), 0 * w, 0 * w, 0.0, 0.0
    sums = np.add.reduceat   # no run is empty: every word has subwords and occurs in a text

    for step in range(1, s.epochs + 1):
        h = np.empty((s.dim, len(texts)))
        for k in range(s.dim):
            u = np.concatenate([sums(e[k][x], starts_at[lo:hi] - starts_at[lo])
                                for lo, hi, x in blocks])
            h[k] = np.bincount(docs, counts * u[words], len(texts)) * s.scale / size
        z = np.clip(w @ h + b, -30, 30)
        err = (1 / (1 + np.exp(-z)) - y) * g
        gw, gb = h @ err, err.sum()
        per_doc = err * s.scale / size
        du = sums((counts * per_doc[docs])[by_word], word_at).astype(np.float32)
        base = np.zeros(len(rows))
        for lo, hi, x in blocks:
            base += np.bincount(x, np.repeat(du[lo:hi], n_sub[lo:hi]), len(rows))
        base = base.astype(np.float32)
        a1, a2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        rate = s.rate * (1 - 0.95 * step / s.epochs)      # small steps at the end: no swinging
        for k in range(s.dim):
            ge = base * w[k] + s.decay * e[k]
            me[k] += 0.1 * (ge - me[k])
            ve[k] += 0.001 * (ge * ge - ve[k])
            e[k] -= rate * (me[k] / a1) / (np.sqrt(ve[k] / a2) + 1e-8)
        mw, vw = mw + 0.1 * (gw - mw), vw + 0.001 * (gw * gw - vw)
        mb, vb = mb + 0.1 * (gb - mb), vb + 0.001 * (gb * gb - vb)
        w = (w - rate * (mw / a1) / (np.sqrt(vw / a2) + 1e-8)).astype(np.float32)
        b -= rate * (mb / a1) / (np.sqrt(vb / a2) + 1e-8)
    weight = np.zeros(s.buckets, np.float32)
    weight[rows] = (w @ e) * s.scale
    return Model(s, weight, float(b))


def fold(doc_id) -> Column:
    """crc32 of the id as text, modulo 4: remainder 2 is held out of training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), label: str = "toxic") -> Model:
    """Train on labelled documents outside the held-out fold, at most ``max_toxic`` and
    ``max_clean`` of them: those with the smallest hashes of their ids, as far as their whole texts
    fit in ``max_bytes``. Rows without id or label
    are left out; a document with contradicting labels counts as toxic. Without both classes the
    model gives the labelled share to every text."""
    spark = docs.sparkSession
    known = (labels.select(labels["doc_id"].cast("long").alias("doc_id"),
                           labels[label].cast("int").alias("y"))
             .where("doc_id is not null and y in (0, 1)").where(fold(F.col("doc_id")) != 2)
             .groupBy("doc_id").agg(F.max("y").alias("y")))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = known.withColumn("h", F.xxhash64("doc_id", F.lit(s.seed)))
    ids = [(r["doc_id"], r["y"]) for y, most in ((1, s.max_toxic), (0, s.max_clean))
           for r in pick.where(F.col("y") == y).orderBy("h", "doc_id").limit(most).collect()]
    from wordmill.llm.common import small_table
    chosen = F.broadcast(small_table(spark, ids, "doc_id long, y int"))
    # one text per chosen id: the sample stays bounded when ids repeat
    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                        F.coalesce(docs["text"], F.lit("")).alias("text")).join(chosen, "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
            .withColumn("bytes", F.octet_length("text").cast("long")).where(F.col("bytes") <= s.max_bytes // 8))
    upto = Window.partitionBy("y").orderBy(F.xxhash64("doc_id", F.lit(s.seed)), "doc_id") \
        .rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("bytes").over(upto)).where(F.col("upto") <= s.max_bytes) \
        .select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], np.int64)
    taken = {v: int((y == v).sum()) for v in (0, 1)}
    weight = np.array([n[v] / taken[v] for v in y.tolist()], np.float64)
    return train([r["text"] for r in rows], y, weight, s)


def scorer(spark, model: Model):
    """A column function text -> score in [0, 1]. Null and empty texts get the bias's score."""
    ship(spark)
    sent = spark.sparkContext.broadcast((model.settings, model.weight.astype(np.float32).tobytes(),
                                         model.bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        s, raw, bias = sent.value
        m = Model(s, np.frombuffer(raw, np.float32), bias)
        cache = PieceCache(m.word_values())
        get = cache.__getitem__
        for texts in batches:
            out = []
            for t in texts:
                total = sum(map(get, t.split()), 0j) if t else 0j
                cache.trim()
                z = total.real / max(1.0, total.imag) + bias
                out.append(1 / (1 + np.exp(-min(max(z, -60.0), 60.0))))
            yield pd.Series(out, dtype="float64")
    return score


def score_documents(docs: DataFrame, labels: DataFrame, s: Settings = Settings(),
                    threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row per input row. Null texts score as empty
    ones; a null id isn't held out; ties and repeated rows get equal scores; other columns are
    not read. An empty table gives an empty result."""
    score = scorer(docs.sparkSession, fit(docs, labels, s))
    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
            .select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
                    score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def drop_toxic(docs: DataFrame, labels: DataFrame, s: Settings = Settings(),
               threshold: float = 0.3) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    score = scorer(docs.sparkSession, fit(docs, labels, s))
    return docs.where(score(docs["text"]) < threshold)


__all__ = ["Settings", "Model", "train", "fit", "scorer", "score_documents", "drop_toxic"]
