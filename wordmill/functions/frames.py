"""Framing and model-input column expressions.

All are array higher-order functions over one row, so they need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frame(ids, n_ctx: int, start: int, end: int) -> Column:
    """Start + first n_ctx-2 ids + end."""
    return F.concat(F.array(F.lit(start)), F.slice(_c(ids), 1, max(n_ctx - 2, 0)),
                    F.array(F.lit(end)))


def pad(ids, n_ctx: int) -> Column:
    """E5: zero-pad on the right to n_ctx (longer inputs are cut to n_ctx)."""
    c = F.slice(_c(ids), 1, n_ctx)
    return F.concat(c, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(n_ctx) - F.size(c))))


def length_mask(ids, n_ctx: int) -> Column:
    """1.0 for each real position (specials included), 0.0 for padding, length n_ctx."""
    n = F.least(F.size(_c(ids)), F.lit(n_ctx))
    return F.concat(F.array_repeat(F.lit(1.0), n), F.array_repeat(F.lit(0.0), F.lit(n_ctx) - n))


def nonzero_mask(ids) -> Column:
    """sign(id) per position: excludes padding and UNK alike (the training mask)."""
    return F.transform(_c(ids), lambda x: F.signum(x).cast("double"))


def position_ids(ids, n_vocab: int, n_special: int = 3) -> Column:
    """V + n_special + position next to each id, as (id, pos_id) structs."""
    return F.transform(_c(ids), lambda x, i: F.struct(x.alias("id"),
                                                      (F.lit(n_vocab + n_special) + i)
                                                      .alias("pos_id")))


def frame_pair(a_ids, b_ids, n_ctx: int, start: int, delim: int, end: int) -> Column:
    """Both orders [start a delim b end] and [start b delim a end], sides cut to
    (n_ctx-3)//2. Returns array of two arrays (order 0 = A.B, 1 = B.A)."""
    m = (n_ctx - 3) // 2
    a = F.slice(_c(a_ids), 1, m)
    b = F.slice(_c(b_ids), 1, m)
    s, d, e = F.array(F.lit(start)), F.array(F.lit(delim)), F.array(F.lit(end))
    return F.array(F.concat(s, a, d, b, e), F.concat(s, b, d, a, e))


def end_position(ids, end: int) -> Column:
    """0-based index of the first end token, 0 when absent."""
    return F.greatest(F.array_position(_c(ids), F.lit(end)) - 1, F.lit(0)).cast("int")


def sequence_length(ids, n_ctx: int) -> Column:
    """min(len, n_ctx)."""
    return F.least(F.size(_c(ids)), F.lit(n_ctx))


def next_token_targets(ids) -> Column:
    """(prev, next, pos) structs for target positions 1..len-1."""
    c = _c(ids)
    return F.transform(F.arrays_zip(F.slice(c, 1, F.size(c) - 1).alias("prev"),
                                    F.slice(c, 2, F.size(c) - 1).alias("next")),
                       lambda z, i: F.struct(z["prev"].alias("prev"), z["next"].alias("next"),
                                             (i + 1).alias("pos")))
