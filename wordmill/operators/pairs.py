"""Sentence-pair assembly (J7, J8, E9 frames; pair inputs from the driver tables).

Positional pairing (``paste``-like zips, first half / second half) is a join on the dense row
index, never a collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.functions import frames as fr
from wordmill.operators.rows import dense_index


LINES_PER_DOC = 1 << 24      # room for a document's pairs in ``pair_id``


def doc_pairs(documents: DataFrame, labels: DataFrame | None = None,
              label_col: str = "toxic") -> DataFrame:
    """Labelled pairs from documents: lines 2k and 2k+1 (or '') of every document as A and B,
    label from ``labels`` (-1 where it has no row). ``pair_id`` = doc_id * 2^24 + k."""
    lines = documents.select("doc_id", F.split("text", "\n").alias("p"))
    k = F.explode(F.sequence(F.lit(0), ((F.size("p") - 1) / 2).cast("int")))
    pairs = lines.select("doc_id", "p", k.alias("k")).select(
        "doc_id", (F.col("doc_id") * LINES_PER_DOC + F.col("k")).alias("pair_id"),
        F.get("p", F.col("k") * 2).alias("a"),
        F.coalesce(F.get("p", F.col("k") * 2 + 1), F.lit("")).alias("b"))
    if labels is None:
        return pairs.drop("doc_id").withColumn("label", F.lit(-1))
    lab = labels.select("doc_id", F.col(label_col).alias("_y"))
    return (pairs.join(lab, "doc_id", "left")
            .withColumn("label", F.coalesce(F.col("_y").cast("int"), F.lit(-1)))
            .drop("_y", "doc_id"))


def index_rows(df: DataFrame, key: str = "pair_id", name: str = "row_idx") -> DataFrame:
    return dense_index(df, [F.col(key)], name=name)


def zip_columns(a: DataFrame, b: DataFrame, label: DataFrame | None = None,
                idx: str = "row_idx") -> DataFrame:
    """Combine columns by row position (``paste``): a full outer join on the row index;
    a shorter input contributes empty fields."""
    z = a.join(b, idx, "full_outer")
    if label is not None:
        z = z.join(label, idx, "full_outer")
    return z


def unstack_halves(df: DataFrame, n: int, idx: str = "row_idx", text: str = "text") -> DataFrame:
    """First n//2 rows are A, last n//2 rows are B, paired by position; with an odd count
    the middle row is dropped. ``n`` is the row count of ``df`` (row index 0..n-1)."""
    h = n // 2
    a = df.where(F.col(idx) < h).select(F.col(idx), F.col(text).alias("a"))
    b = df.where(F.col(idx) >= n - h).select((F.col(idx) - (n - h)).alias(idx),
                                             F.col(text).alias("b"))
    return a.join(b, idx, "inner")


def frame_pairs(df: DataFrame, n_ctx: int, start: int, delim: int, end: int,
                a: str = "a_ids", b: str = "b_ids", key: str = "pair_id") -> DataFrame:
    """Two rows per pair, ``ord`` 0 = [start a delim b end], 1 = [start b delim a end]."""
    both = fr.frame_pair(a, b, n_ctx, start, delim, end)
    return df.select(key, *[c for c in df.columns if c not in (key, a, b)],
                     F.posexplode(both).alias("ord", "ids"))
