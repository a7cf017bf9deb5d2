"""Exact dedup with a heavy-hitter split.

1. One scan turns every document into a narrow row: digest (SHA-256 of the text without white
   space), code points of the original text, id. It is written once and read by all later steps.
2. Misra-Gries counters, one summary of ``capacity`` counters per task, merged by a sum per
   digest: every digest with more than n / (capacity + 1) rows is among the candidates.
3. The candidates' exact counts and winners are verified by an aggregate that combines map-side
   (at most ``capacity`` groups), and broadcast: rows of frequent digests get their answer without
   a shuffle.
4. All other digests, each with at most n / (capacity + 1) rows, take an ordinary shuffle.

A candidate that is not frequent costs nothing but its place; a digest that the counters miss is
handled by step 4, so the result doesn't depend on ``capacity``.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm.common import id_and_text, written

#: Fixed value: the white space that doesn't count when texts are compared.
WHITE = r"[\x20\x09-\x0D]+"


def misra_gries(counts: dict, batch: "pd.Series", capacity: int) -> dict:
    """Add a batch to a summary of at most ``capacity`` counters: sum, then take the
    (capacity + 1)-th largest count off all and drop what isn't positive."""
    for k, n in batch.value_counts(sort=False).items():
        counts[k] = counts.get(k, 0) + int(n)
    if len(counts) > capacity:
        cut = sorted(counts.values(), reverse=True)[capacity]
        counts = {k: n - cut for k, n in counts.items() if n > cut}
    return counts


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, n_points, row``: row tells apart rows that repeat an id."""
    docs = id_and_text(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.unhex(F.sha2(F.regexp_replace(text, WHITE, "").cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("n_points"),
        F.monotonically_increasing_id().alias("row"))


def frequent(rows: DataFrame, capacity: int) -> list[bytes]:
    """Candidate heavy hitters among ``rows.digest``, at most ``capacity`` of them."""
    def summarise(batches):
        counts: dict = {}
        for b in batches:
            counts = misra_gries(counts, b.column(0).to_pandas(), capacity)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()),
                                          pa.array(list(counts.values()), pa.int64())],
                                         names=["digest", "n"])

    merged = (rows.select("digest").mapInArrow(summarise, "digest binary, n long")
              .groupBy("digest").agg(F.sum("n").alias("n"))
              .orderBy(F.desc("n"), "digest").limit(capacity + 1).collect())
    cut = merged[capacity]["n"] if len(merged) > capacity else 0
    # of the remaining candidates, a count of one can't have copies worth a broadcast
    return [bytes(r["digest"]) for r in merged[:capacity] if r["n"] > max(cut, 1)]


def _winner():
    # most code points, then the smallest id (a null id comes last), then the earliest row
    return F.max(F.struct(F.col("n_points").alias("p"), F.col("doc_id").isNotNull().alias("has"),
                          (-F.col("doc_id")).alias("neg"), (-F.col("row")).alias("r")))


def exact_dedup(docs: DataFrame, capacity: int = 1000, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical without white space (a null text counts as empty). Of
    equal texts the row with the most code points stays, then the smallest id; a null id loses
    to any other, and of fully repeated rows exactly one stays (any of them: they are alike).
    An empty table gives an empty result; other columns are not read.
    """
    rows, _ = written(digests(docs, id_col, text_col), "digests")
    heavy = frequent(rows, capacity)
    spark = rows.sparkSession
    flags = spark.createDataFrame(pa.table({"digest": pa.array(heavy, pa.binary())}))
    flags = F.broadcast(flags)  # at most ``capacity`` digests of 32 bytes
    verified = (rows.join(flags, "digest", "left_semi").groupBy("digest")
                .agg(F.count(F.lit(1)).alias("group_size"), _winner().alias("w")))
    often = rows.join(F.broadcast(verified), "digest")  # at most ``capacity`` rows
    by = Window.partitionBy("digest")
    rest = (rows.join(flags, "digest", "left_anti")
            .withColumn("group_size", F.count(F.lit(1)).over(by))
            .withColumn("w", _winner().over(by)))
    both = often.select("doc_id", "row", "digest", "group_size", "w").unionAll(
        rest.select("doc_id", "row", "digest", "group_size", "w"))
    return both.select("doc_id", (-F.col("w.neg")).alias("keep_id"), "group_size",
                       (F.col("row") == -F.col("w.r")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))
