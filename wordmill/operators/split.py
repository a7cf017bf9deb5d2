"""Train/dev split (E1-E3) and index-based splits.

The original draws an unseeded ``random.random()`` per line. Here the draw is a seeded hash
of the line key: the same rate, reproducible, and identical on every re-execution of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values of the dev-rate rules.
DEV_LINES_TARGET = 10000     # dev rate = min(10000 / lines, 0.1)
DEV_RATE_CAP = 0.1
DEV_CHARS_TARGET = 8000      # char variant: 8000 / counted characters, uncapped
DEFAULT_SEED = 42
# ---------------------------------------------------------------------------------------------


def dev_rate(n_lines: int) -> float:
    """min(10000 / lines, 0.1); an empty corpus gives 0."""
    return min(DEV_LINES_TARGET / n_lines, DEV_RATE_CAP) if n_lines else 0.0


def dev_rate_by_chars(n_chars: int) -> float:
    """8000 / counted characters (uncapped); an empty corpus gives 0."""
    return float(DEV_CHARS_TARGET) / n_chars if n_chars else 0.0


def dev_rate_frame(lines: DataFrame) -> DataFrame:
    """E1 as a one-row frame."""
    n = F.count(F.lit(1))
    return lines.agg(n.alias("n_lines"),
                     F.when(n > 0, F.least(F.lit(float(DEV_LINES_TARGET)) / n,
                                           F.lit(DEV_RATE_CAP))).otherwise(0.0).alias("rate"))


def hash_unit(seed: int, *key) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of md5('seed:k1:k2...')."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k
                                                    for k in key]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def random_split(lines: DataFrame, rate: float, seed: int = DEFAULT_SEED,
                 keys=("doc_id", "line_no"), name: str = "split") -> DataFrame:
    """Independent draw per line: ``dev`` with probability ``rate``, else ``train``."""
    return lines.withColumn(name, F.when(hash_unit(seed, *keys) < F.lit(rate), F.lit("dev"))
                            .otherwise(F.lit("train")))


def split_by_index(df: DataFrame, idx: DataFrame, col: str = "row_idx") -> DataFrame:
    """Rows listed in ``idx`` are dev, the others train: one left join with the index."""
    i = idx.select(col).distinct().withColumn("_dev", F.lit(True))
    return (df.join(i, col, "left")
            .withColumn("split", F.when(F.col("_dev"), F.lit("dev")).otherwise(F.lit("train")))
            .drop("_dev"))


def dev_rate_by_chars_frame(chars: DataFrame, col: str = "n_chars") -> DataFrame:
    """E2 as a one-row frame: total of a per-line character count and the rate."""
    n = F.coalesce(F.sum(col), F.lit(0)).cast("long")
    return chars.agg(n.alias("n_chars"), F.when(n > 0, F.lit(dev_rate_by_chars(1)) / n)
                     .otherwise(dev_rate_by_chars(0)).alias("rate"))


def replicate_index(idx: DataFrame, n: int, col: str = "row_idx", blocks: int = 4) -> DataFrame:
    """The index repeated at offsets 0, n/4, n/2, 3n/4 (integer division) for data made
    of four augmented blocks. A generator over the block number, no join."""
    offs = F.array(*[F.lit((k * n) // blocks) for k in range(blocks)])
    return idx.select(F.col(col), F.explode(offs).alias("_off")) \
        .select((F.col(col) + F.col("_off")).alias(col))
