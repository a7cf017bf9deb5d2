"""Loss and metric aggregates.

Batch-level metrics follow the original averaging rules exactly: the language model averages
batch means unweighted (a short last batch counts fully); the classifier weights each batch
mean by its row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def masked_seq_loss(pos_loss: DataFrame, seq: str = "seq", loss: str = "loss",
                    mask: str = "mask") -> DataFrame:
    """A5: per sequence Σ(loss * mask) / Σ mask over its target positions."""
    return pos_loss.groupBy(seq).agg(
        (F.sum(F.col(loss) * F.col(mask)) / F.sum(mask)).alias("loss"))


def perplexity(seq_loss: DataFrame, loss: str = "loss") -> DataFrame:
    """Mean of exp(sequence loss) (not exp of the mean), with the mean loss."""
    return seq_loss.agg(F.avg(F.exp(loss)).alias("ppl"), F.avg(loss).alias("loss"),
                        F.count(F.lit(1)).alias("n_seq"))


def batch_averaged_metrics(seq_loss: DataFrame, n_batch: int, idx: str = "row_idx",
                           loss: str = "loss") -> DataFrame:
    """Mean over batches of (mean loss, mean exp(loss)) per batch of n consecutive rows,
    each batch weighted equally."""
    per_batch = seq_loss.groupBy(F.floor(F.col(idx) / n_batch).alias("batch")).agg(
        F.avg(loss).alias("b_loss"), F.avg(F.exp(loss)).alias("b_ppl"))
    return per_batch.agg(F.avg("b_loss").alias("loss"), F.avg("b_ppl").alias("ppl"),
                         F.count(F.lit(1)).alias("n_batches"))


def row_weighted_cost(losses: DataFrame, n_batch: int, idx: str = "row_idx",
                      loss: str = "loss") -> DataFrame:
    """Σ(batch mean × batch rows) / rows."""
    per_batch = losses.groupBy(F.floor(F.col(idx) / n_batch).alias("batch")).agg(
        F.avg(loss).alias("m"), F.count(F.lit(1)).alias("n"))
    return per_batch.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("cost"),
                         F.sum("n").alias("n_rows"))


def f1(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """F1 of the positive class × 100 with tp/fp/fn; 0 when tp = 0."""
    yc, pc = F.col(y) == 1, F.col(pred) == 1
    tp = F.sum(F.when(yc & pc, 1).otherwise(0))
    fp = F.sum(F.when(~yc & pc, 1).otherwise(0))
    fn = F.sum(F.when(yc & ~pc, 1).otherwise(0))
    out = df.agg(tp.cast("long").alias("tp"), fp.cast("long").alias("fp"),
                 fn.cast("long").alias("fn"))
    return out.withColumn("f1", F.when(F.col("tp") > 0, F.lit(100.0) * 2 * F.col("tp")
                                       / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
                          .otherwise(F.lit(0.0)))


def objective(clf_losses: DataFrame, lm_losses: DataFrame, lm_coef: float,
              loss: str = "loss") -> DataFrame:
    """A10: mean(clf) + coef·mean(lm), or mean(clf) when coef <= 0. One aggregate over the
    tagged union of both loss tables (no join)."""
    u = (clf_losses.select(F.lit("clf").alias("_k"), F.col(loss).alias("_v"))
         .unionByName(lm_losses.select(F.lit("lm").alias("_k"), F.col(loss).alias("_v"))))
    agg = u.agg(F.avg(F.when(F.col("_k") == "clf", F.col("_v"))).alias("clf_loss"),
                F.avg(F.when(F.col("_k") == "lm", F.col("_v"))).alias("lm_loss"))
    if lm_coef > 0:
        return agg.withColumn("objective", F.col("clf_loss") + F.lit(lm_coef) * F.col("lm_loss"))
    return agg.withColumn("objective", F.col("clf_loss"))


def every_n_steps(metrics: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Keep each n-th step."""
    return metrics.where(F.col(step) % n == 0)
