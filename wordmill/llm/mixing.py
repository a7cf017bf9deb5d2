"""Mixing to target weights with soft domain membership, in DataFrame functions only.

1. The domains and their priors are counted over all rows. A naive Bayes classifier over hashed
   words is counted from a bounded sample of each domain's labelled documents (of all of them where
   none is labelled) and gives every document a posterior over the domains, tempered so that long
   texts stay soft. It is a column expression over the whole text: nothing is joined or shuffled.
2. Rates r >= ``floor`` are fitted by projected gradient on

       1/2 sum_k (T_k(r) - target_k)^2 / (target_k S)  +  ridge/2 sum_d (t_d / S) (r_d - 1)^2

   with T_k(r) = sum_d r_d t_d p_dk, t_d the document's tokens and S their sum. In the metric
   t_d / S a step is r_d <- max(floor, r_d - eta (p_d . g + ridge (r_d - 1))) with
   g_k = (T_k - target_k) / target_k: one aggregate of K sums per step. A document's rate follows
   from its own posterior and the list of the g so far, so no rates are stored between steps.
3. Copies: floor(rate + u), u uniform by hash of the row.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import drop, free_name, small_table, written


@dataclass(frozen=True)
class Settings:
    """``sample`` is about the most documents the classifier counts, dealt evenly over the domains
    (smallest hashes of ids; a small domain leaves its share to the others);
    ``evidence`` is the number of words whose likelihood a text is given at most."""
    buckets: int = 2048
    sample: int = 20_000
    evidence: int = 20
    ridge: float = 1e-9
    steps: int = 40
    halvings: int = 12
    damping: float = 0.01
    patience: int = 8
    tolerance: float = 1e-3
    temperature: float = 0.7
    seed: int = 11


@dataclass
class Classifier:
    domains: list[str]
    prior: list[float]
    weights: list[list[float]]       # per domain, log likelihood per bucket
    settings: Settings


@dataclass
class Mix:
    classifier: Classifier
    targets: dict[str, float]
    totals: dict[str, float]         # expected tokens per domain at the fitted rates
    gradients: list[list[float]] = field(default_factory=list)      # scaled, one per step
    floor: float = 0.0
    residual: float = 0.0            # largest |total - target| / target


def words(text: Column) -> Column:
    """Lower-case words between white space; a null or blank text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def buckets(text: Column, s: Settings) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(s.buckets)).cast("int"))


def _rates(rows: dict[str, int], most: int) -> dict[str, float]:
    """The share of each domain's rows to sample: equal numbers, all of a domain that has fewer."""
    out, left = {}, most
    for i, (d, n) in enumerate(sorted(rows.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, max(1, left // (len(rows) - i)))
        out[d], left = take / n, left - take
    return out


def _per_domain(rows: DataFrame) -> dict[str, int]:
    return {r["domain"]: r["n"] for r in rows.groupBy("domain")
            .agg(F.count(F.lit(1)).alias("n")).collect()}


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str = "lang",
                   s: Settings = Settings()) -> Classifier:
    """Domains and priors of all rows with a domain; word buckets counted over a sample of each
    domain's documents that have a row in ``labels``, or of all its documents where none has.
    Rows without id give no words; with no domain at all there is a single one, "all"."""
    spark = docs.sparkSession
    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                        docs[domain].cast("string").alias("domain"), docs["text"].alias("text"))
            .where("domain is not null"))
    per_domain = _per_domain(rows)
    domains = sorted(per_domain)
    if not domains:
        return Classifier(["all"], [0.0], [[0.0] * s.buckets], s)
    named = rows.select("doc_id", "domain").where("doc_id is not null")
    ids = (labels.select(labels["doc_id"].cast("long").alias("doc_id")).where("doc_id is not null")
           .distinct())
    labelled, labelled_path = written(named.join(ids, "doc_id"), "mix-labelled")
    have = _per_domain(labelled)
    bare = [d for d in domains if d not in have]
    share = _rates({d: have.get(d, per_domain[d]) for d in domains}, s.sample)
    shares = F.broadcast(small_table(spark, list(share.items()), "domain string, share double"))
    pool = labelled.unionByName(named.where(F.col("domain").isin(bare))) if bare else labelled
    u = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 30)) / (1 << 30)
    picked, path = written(pool.join(shares, "domain").where(u < F.col("share"))
                           .select("doc_id", "domain").distinct(), "mix-sample")
    rows = rows.join(F.broadcast(picked), ["doc_id", "domain"])      # about ``sample`` ids
    seen = (rows.select("domain", F.explode(buckets(F.col("text"), s)).alias("b"))
            .groupBy("domain", "b").agg(F.count(F.lit(1)).alias("n")))
    counts = {d: np.ones(s.buckets) for d in domains}
    for r in seen.collect():                    # domains x buckets at most
        counts[r["domain"]][r["b"]] += r["n"]
    drop(spark, path)
    drop(spark, labelled_path)
    total = sum(per_domain.values())
    logs = [np.log(counts[d] / counts[d].sum()) for d in domains]
    mean = sum(logs) / len(logs)
    return Classifier(domains, [math.log(per_domain[d] / total) for d in domains],
                      [[round(float(x), 6) for x in v - mean] for v in logs], s)


def _posterior(c: Classifier, b: Column) -> Column:
    """array<double>: softmax of prior + tempered log likelihood, from a column of buckets."""
    damp = F.least(F.lit(1.0), F.lit(float(c.settings.evidence)) / F.greatest(F.size(b), F.lit(1)))
    logits = []
    for prior, w in zip(c.prior, c.weights):
        # one literal: the optimizer folds the constant split and cast
        table = F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>")
        logits.append(F.lit(prior) + damp * _summed(b, table))
    return F.array(*logits)


def _summed(b: Column, table: Column) -> Column:
    return F.aggregate(b, F.lit(0.0), lambda a, i: a + F.get(table, i))


def _softmax(z: Column, k: int) -> Column:
    top = F.array_max(z)
    return F.transform(z, lambda x: F.exp(x - top))


def with_posterior(docs: DataFrame, c: Classifier, text: Column) -> DataFrame:
    """``row`` (all columns as a struct), ``tokens`` and ``p`` (posterior, in domain order)."""
    out = docs.select(F.struct("*").alias("row"), buckets(text, c.settings).alias("b"))
    out = out.select("row", F.size("b").cast("long").alias("tokens"), _posterior(c, F.col("b")).alias("z"))
    out = out.select("row", "tokens", _softmax(F.col("z"), len(c.domains)).alias("e"))
    return out.select("row", "tokens", F.transform(
        "e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def _rate(m: Mix, p: list[Column]) -> Column:
    """The rate after all steps so far: 1 less the sum of the steps, cut at the floor. Cutting the
    sum and not each step keeps the steps of a document that was at the floor for a while."""
    return F.greatest(F.lit(m.floor), F.lit(1.0) - _pull(p, np.sum(m.gradients, axis=0).tolist()
                                                          if m.gradients else [0.0] * len(p)))


def _pull(p: list[Column], g: list[float]) -> Column:
    return sum((x * F.lit(v) for x, v in zip(p, g)), F.lit(0.0))


def fit(docs: DataFrame, labels: DataFrame, domain: str = "lang",
        weights: dict[str, float] | None = None, floor: float = 0.0, keep_all: bool = False,
        s: Settings = Settings(), text_col: str = "text") -> Mix:
    """Fit rates. ``weights`` are target shares per domain (default: share ** temperature); the
    token budget is that of the input, or with ``keep_all`` the smallest at which no domain has to
    shrink. Domains without expected tokens get no target; a weight for a domain that no row has is
    an error.

    A step moves all rates against the gradient of the squared misses, scaled by the k x k matrix
    of tokens that two domains share in the documents above the floor (or pushed up from it); the
    sum of the steps is projected on rates of at least the floor. Where no rate is cut, one step
    meets the targets. A step is halved until it lowers the dual cost of the least squares (the
    rates closest to 1 that meet the targets), which is convex and whose gradient the misses are.
    The fit ends within the tolerance, or where ``patience`` steps haven't lowered the relative
    misses, and then goes back to the best: the floor holds some total off its target, ``residual``
    says how far, and a warning is given."""
    c = fit_classifier(docs, labels, domain, s)
    k = len(c.domains)
    narrow = with_posterior(docs.select(docs[text_col].alias("text")), c, F.col("text"))
    state, path = written(narrow.select(
        F.col("tokens").cast("double").alias("t"), *[F.col("p")[i].alias(f"p{i}") for i in range(k)]),
        "mix-state")
    p = [F.col(f"p{i}") for i in range(k)]
    first = state.agg(*[F.sum(F.col("t") * x) for x in p]).head()
    now = np.array([float(x or 0.0) for x in first])
    total = now.sum()
    if total <= 0:
        drop(docs.sparkSession, path)
        return Mix(c, dict.fromkeys(c.domains, 0.0), dict.fromkeys(c.domains, 0.0), floor=floor)
    unknown = sorted(set(weights or ()) - set(c.domains))
    if unknown:
        drop(docs.sparkSession, path)
        raise ValueError(f"target weights for domains that no row has: {', '.join(unknown)}")
    share = np.array([weights.get(d, 0.0) for d in c.domains]) if weights else \
        (now / total) ** s.temperature
    share = np.where(now > 0, share, 0.0)
    share = share / share.sum()
    budget = float((now[share > 0] / share[share > 0]).max()) if keep_all else total
    target = share * budget
    live = target > 0
    scale = np.where(live, target, 1.0)
    m = Mix(c, dict(zip(c.domains, target.tolist())), {}, [], floor)
    now, shared, cost = _evaluate(state, m, p, F.lit(True))
    damp = s.damping * shared
    if m.floor >= 1.0:      # all rates start at the floor: those that the misses push up are free
        up = _pull(p, np.where(live, (now - target) / scale, 0.0).tolist()) < 0
        _, shared, _ = _evaluate(state, m, p, up)
    off = lambda x: np.where(live, np.abs(x - target) / scale, 0.0)
    best = ((off(now) ** 2).sum(), 0, now)
    while off(now).max() >= s.tolerance and len(m.gradients) < min(s.steps, best[1] + s.patience):
        miss = np.where(live, now - target, 0.0)
        h = (shared + damp) / np.outer(scale, scale) * np.outer(live, live)
        h += np.eye(k) * s.ridge * max(np.trace(h) / k, 1e-300)
        d = np.where(live, np.linalg.lstsq(h, miss / scale, rcond=None)[0] / scale, 0.0)
        for _ in range(s.halvings):
            m.gradients.append(d.tolist())
            after = _evaluate(state, m, p)
            if after[2] + float(d @ target) < cost - 1e-4 * abs(float(miss @ d)):
                break
            m.gradients.pop()
            d = d / 2
        else:
            break
        now, shared, cost = after
        best = min(best, ((off(now) ** 2).sum(), len(m.gradients), now), key=lambda x: x[0])
    now = best[2]
    del m.gradients[best[1]:]
    m.totals = dict(zip(c.domains, now.tolist()))
    m.residual = float(np.where(live, np.abs(now - target) / scale, 0.0).max())
    if m.residual >= s.tolerance:
        warnings.warn(f"mixing: totals are off their targets by up to {m.residual:.2%} after "
                      f"{len(m.gradients)} steps", stacklevel=2)
    drop(docs.sparkSession, path)
    return m


def _evaluate(state: DataFrame, m: Mix, p: list[Column], up: Column | None = None) -> tuple:
    """In one pass at the present rates: tokens per domain, tokens that two domains share in rows
    above the floor (or in ``up``), and the part of the dual cost that is a sum over rows."""
    k = len(p)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r, t = _rate(m, p), F.col("t")
    pull = _pull(p, np.sum(m.gradients, axis=0).tolist() if m.gradients else [0.0] * k)
    rows = state.select("t", *p, r.alias("r"), pull.alias("pull"))
    free = F.when((F.col("r") > m.floor) | (F.lit(False) if up is None else up), t).otherwise(0.0)
    got = rows.agg(*[F.sum(F.col("r") * t * x) for x in p], *[F.sum(free * p[i] * p[j]) for i, j in pairs],
                   F.sum(-t * ((F.col("r") - 1) ** 2 / 2 + F.col("r") * F.col("pull")))).head()
    got = [float(x or 0.0) for x in got]
    shared = np.zeros((k, k))
    for (i, j), v in zip(pairs, got[k:]):
        shared[i, j] = shared[j, i] = v
    return np.array(got[:k]), shared, got[-1]


def rates(docs: DataFrame, m: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, tokens, p, rate, copies`` per input row. Null and blank texts have no tokens and
    the prior's posterior; equal rows get equal rates and copies."""
    k, s = len(m.classifier.domains), m.classifier.settings
    out = with_posterior(docs, m.classifier, docs[text_col])
    out = out.select("row", "tokens", "p", _rate(m, [F.col("p")[i] for i in range(k)]).alias("rate"))
    u = F.pmod(F.xxhash64(f"row.{id_col}", f"row.{text_col}", F.lit(s.seed)), F.lit(1 << 20)) / (1 << 20)
    return out.withColumn("copies", F.floor(F.col("rate") + u).cast("int"))


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", floor: float = 0.0,
        keep_all: bool = False, s: Settings = Settings(),
        weights: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row as many times as its copies say; all its columns. With
    ``floor=1, keep_all=True`` no document is lost: rare domains are repeated instead. An empty
    table gives an empty result."""
    m = fit(docs, labels, domain, weights, floor, keep_all, s)
    again = F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias(free_name(docs, "_again"))
    return rates(docs, m).select("row", again).select("row.*")


def mix_table(docs: DataFrame, labels: DataFrame, domain: str = "lang",
              s: Settings = Settings()) -> DataFrame:
    """One row per document: ``doc_id, tokens, domain`` (likeliest), its posterior, ``rate``,
    ``copies``."""
    m = fit(docs, labels, domain, s=s)
    names = F.array(*[F.lit(d) for d in m.classifier.domains])
    best = F.array_position(F.col("p"), F.array_max("p")) - 1
    return rates(docs, m).select(
        F.col("row.doc_id").alias("doc_id"), "tokens",
        F.get(names, best.cast("int")).alias("domain"),
        F.round(F.array_max("p"), 6).alias("posterior"), F.round("rate", 6).alias("rate"), "copies")


__all__ = ["Settings", "Classifier", "Mix", "fit_classifier", "fit", "rates", "mix", "mix_table"]
