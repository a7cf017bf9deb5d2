"""Pair classifier (M8, M9): a pyspark.ml pipeline in place of the fine-tuned transformer.

Features are hashed tokens shared by both sides and tokens on one side only; the logistic
regression uses the original's class weights (p for positives, 1 - p for negatives) as the
instance weight column. Training and scoring are distributed ml jobs.

The same model is also stated as joins and aggregates over unhashed terms: logits at given
weights, their weighted loss and gradient, and gradient steps.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.functions import scoring as sc
from wordmill.functions import text as tx
from wordmill.operators.joins import hot_split_join
from wordmill.session import cut_lineage, release

POS_WEIGHT = 0.8      # fixed value: class weight of positives in the original


def pair_features(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    ta, tb = tx.word_tokens(a), tx.word_tokens(b)
    shared = F.transform(F.array_intersect(ta, tb), lambda t: F.concat(F.lit("s:"), t))
    only = F.transform(F.concat(F.array_except(ta, tb), F.array_except(tb, ta)),
                       lambda t: F.concat(F.lit("u:"), t))
    return pairs.withColumn("_terms", F.concat(shared, only))


def fit_pair_classifier(pairs: DataFrame, pos_weight: float = POS_WEIGHT,
                        num_features: int = 1 << 18, max_iter: int = 20) -> PipelineModel:
    """M8: fit on labelled pairs (label >= 0)."""
    train = pair_features(pairs.where(F.col("label") >= 0)) \
        .withColumn("_y", F.col("label").cast("double")) \
        .withColumn("_w", sc.class_weight("label", pos_weight))
    pipe = Pipeline(stages=[
        HashingTF(inputCol="_terms", outputCol="_f", numFeatures=num_features),
        LogisticRegression(featuresCol="_f", labelCol="_y", weightCol="_w", maxIter=max_iter,
                           regParam=0.01, predictionCol="_pred", probabilityCol="_prob",
                           rawPredictionCol="_raw")])
    return pipe.fit(train)


def score_pairs(model: PipelineModel, pairs: DataFrame, key: str = "index") -> DataFrame:
    """M9: predicted label per pair (argmax of the two class scores)."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(pair_features(pairs))
    return out.select(key, *[c for c in pairs.columns if c not in (key, "a", "b")],
                      sc.argmax(vector_to_array("_raw")).alias("pred"))


def feature_rows(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row ``(key, term)`` per pair and term: ``s:`` for a token of both sides, ``u:`` for a
    token of one side. A pair without tokens has no rows."""
    return pair_features(pairs).select(key, F.explode("_terms").alias("term"))


def linear_scores(pairs: DataFrame, features: DataFrame, weights: DataFrame, bias: float = 0.0,
                  key: str = "pair_id") -> DataFrame:
    """``pairs`` with ``z``, the sum of their terms' weights (``term, w``; an unknown term has
    none) plus the bias. A frequent term's weight reaches its rows by broadcast, the others by a shuffle (``hot_split_join``)."""
    z = (hot_split_join(features, weights.select("term", "w"), "term")
         .groupBy(key).agg(F.sum("w").alias("_z")))
    return pairs.join(z, key, "left").withColumn("z", F.coalesce("_z", F.lit(0.0)) + F.lit(bias)).drop("_z")


def _weighted(scored: DataFrame, pos_weight: float) -> DataFrame:
    """Logit, 0/1 label and class weight of the labelled pairs."""
    return (scored.where(F.col("label") >= 0).withColumn("_y", F.col("label").cast("double"))
            .withColumn("_w", sc.class_weight("label", pos_weight)))


def weighted_loss(scored: DataFrame, pos_weight: float = POS_WEIGHT) -> DataFrame:
    """M8: labelled pairs and the mean of their class-weighted logistic losses, in a form that no
    logit overflows."""
    z = F.col("z")
    ce = F.greatest(z, F.lit(0.0)) - z * F.col("_y") + F.log1p(F.exp(-F.abs(z)))
    return _weighted(scored, pos_weight).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_w") * ce).alias("loss"))


def _errors(scored: DataFrame, pos_weight: float, key: str) -> DataFrame:
    """The loss's derivative by the logit, added up per key: ``_e``, over ``_m`` labelled pairs."""
    e = F.col("_w") * (1 / (1 + F.exp(-F.col("z"))) - F.col("_y"))
    return _weighted(scored, pos_weight).groupBy(key).agg(F.sum(e).alias("_e"),
                                                          F.count(F.lit(1)).alias("_m"))


def _term_sums(rows: DataFrame) -> DataFrame:
    """``(term, _e, _m)`` rows, added up per task before the shuffle: ``g`` and ``n`` per term."""
    return rows.groupBy("term").agg(F.sum("_e").alias("g"), F.sum("_m").alias("n"))


def gradient(scored: DataFrame, features: DataFrame, pos_weight: float = POS_WEIGHT,
             key: str = "pair_id") -> DataFrame:
    """The loss's gradient, summed over pairs: per term ``g`` and the labelled pairs ``n`` that
    have it. Rows are added up per task before the shuffle, so a term of every pair is one row
    per task."""
    return _term_sums(features.join(_errors(scored, pos_weight, key), key))


def term_lists(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """``(key, label, _terms)``, one row a pair, written once: tokens are split and compared a
    single time, and what later steps move by key is a row per pair, not one per term."""
    return cut_lineage(pair_features(pairs).select(key, "label", "_terms"))


def term_rows(lists: DataFrame, key: str = "pair_id") -> DataFrame:
    """``feature_rows`` of written term lists."""
    return lists.select(key, F.explode("_terms").alias("term"))


def fit_linear(pairs: DataFrame, steps: int = 1, rate: float = 1.0, pos_weight: float = POS_WEIGHT,
               key: str = "pair_id") -> tuple[DataFrame, float]:
    """Weights (``term, w``) and bias after full gradient steps from zero on the mean loss of the
    labelled pairs. Weights stay a table, written once a step; the driver holds the bias alone.

    At zero weights every logit is the bias, so the first step looks no weight up. A step's
    errors meet the term lists a row per pair, before the terms are exploded.
    """
    lists = term_lists(pairs.where(F.col("label") >= 0), key)
    weights, bias = None, 0.0
    for _ in range(steps):
        known = lists.select(key, "label")
        scored = (known.withColumn("z", F.lit(bias)) if weights is None else cut_lineage(
            linear_scores(known, term_rows(lists, key), weights, bias, key)))
        n, total = _weighted(scored, pos_weight).agg(
            F.count(F.lit(1)), F.sum(F.col("_w") * (1 / (1 + F.exp(-F.col("z"))) - F.col("_y")))).first()
        if n:
            errors = _errors(scored, pos_weight, key)
            hit = lists.join(errors, key).select("_e", "_m", F.explode("_terms").alias("term"))
            g = _term_sums(hit)
            if weights is None:
                # terms of pairs without a key keep weight 0: no error meets them
                base = term_rows(lists.where(F.col(key).isNull()), key) \
                    .select("term", F.lit(0.0).alias("g"))
                after = cut_lineage(g.select("term", "g").unionByName(base).groupBy("term").agg(
                    (F.lit(0.0) - rate / n * F.sum("g")).alias("w")))
            else:
                after = cut_lineage(weights.join(g, "term", "left").select(
                    "term", (F.col("w") - rate / n * F.coalesce("g", F.lit(0.0))).alias("w")))
                release(weights)
            weights, bias = after, bias - rate / n * total
        release(scored)
    if weights is None:
        weights = cut_lineage(term_rows(lists, key).select("term").distinct().withColumn("w", F.lit(0.0)))
    release(lists)
    return weights, bias
