"""Math scalars over logit arrays (M1-M5), as higher-order column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def softmax(logits, t: float = 1.0) -> Column:
    """M1: temperature softmax, shifted by the maximum."""
    x = F.transform(_c(logits), lambda v: v.cast("double") / F.lit(float(t)))
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = _sum(e)
    return F.transform(e, lambda v: v / s)


def log_sum_exp(logits) -> Column:
    x = F.transform(_c(logits), lambda v: v.cast("double"))
    m = F.array_max(x)
    return m + F.log(_sum(F.transform(x, lambda v: F.exp(v - m))))


def cross_entropy(logits, y) -> Column:
    """M2: -log softmax[y] in log-sum-exp form (y is a 0-based class)."""
    return log_sum_exp(logits) - F.element_at(_c(logits), _c(y) + 1).cast("double")


def class_weight(y, pos_weight: float) -> Column:
    """Weight p for y = 1 and 1 - p for y = 0: (2p - 1) y + 1 - p."""
    return F.lit(2.0 * pos_weight - 1.0) * _c(y).cast("double") + F.lit(1.0 - pos_weight)


def weighted_cross_entropy(ce, y, pos_weight: float = 0.8) -> Column:
    """M3: cross entropy times the class weight."""
    return class_weight(y, pos_weight) * _c(ce)


def argmax(arr) -> Column:
    """M4: 0-based index of the first maximum."""
    return (F.array_position(_c(arr), F.array_max(_c(arr))) - 1).cast("int")


def score_distribution_label(score, n_class: int = 6) -> Column:
    """M5: a real score to class weights: floor(y) gets floor(y) - y + 1, floor(y) + 1 gets
    y - floor(y), every other class 0."""
    y = _c(score).cast("double")
    fl = F.floor(y)
    return F.transform(F.sequence(F.lit(0), F.lit(n_class - 1)),
                       lambda i: F.when(i == fl + 1, y - fl)
                       .when(i == fl, fl - y + 1).otherwise(F.lit(0.0)))
