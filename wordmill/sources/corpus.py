"""Scans and sinks.

Connectors are local or shared files only. Tables are parquet unless the original format is a
text format a user would exchange (TSV pairs, ``token count`` lines, predictions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions.text import WS_CLASS
from wordmill.operators import vocab as vb
from wordmill.session import cut_lineage

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)``: the lines of text files, numbered from 0 in each file.

    The files are read in splits, so one large file spreads over many tasks. A line's place is
    (file, start of its split, place in the split); lines are numbered inside a split and shifted
    by the number of lines in the file's earlier splits. That table has a row per split.
    """
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"))
    raw = cut_lineage(raw)
    splits = raw.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"),
                                               F.min("_at").alias("_first"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(
        Window.unboundedPreceding, -1)
    splits = splits.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # ids grow by one per line inside a split, and a split lies in one task
    return raw.join(F.broadcast(splits), ["file", "_start"]).select(
        "file", (F.col("_off") + F.col("_at") - F.col("_first")).alias("line_no"), "value")


def read_corpus(src, spark: SparkSession | None = None, text: str = "text",
                key: str = "doc_id", spread: int | None = None) -> DataFrame:
    """One row per line with the stable key (doc_id, line_no).

    ``src`` is a DataFrame with ``key`` and ``text`` columns (e.g. ``documents``), whose texts are
    split on ``\\n`` and kept even when empty; or a path to text files of one sentence per line,
    numbered by file path, a newline at a file's end adding no line. ``spread`` deals a small
    table's documents over that many partitions first (by key); it is for inputs with fewer files
    than cores and is off by default.
    """
    if isinstance(src, str):
        lines = numbered_lines(spark, src)
        files = lines.select("file").distinct().withColumn(
            "doc_id", F.row_number().over(Window.orderBy("file")).cast("long") - 1)
        return lines.join(F.broadcast(files), "file").select(
            "doc_id", F.col("line_no").cast("int").alias("line_no"), F.col("value").alias("text"))
    src = src.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if spread:
        src = src.repartition(spread, "doc_id")
    return src.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "text"))


def read_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Unquoted TSV ``A \\t B [\\t ... \\t label]``; label = last field, else -1.

    Returns (pairs, rejects): rows with fewer than two fields go to ``rejects``. ``pair_id`` is
    the dense line number in file order: files by path, lines by position.
    """
    lines = numbered_lines(spark, path)
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    p = lines.join(F.broadcast(sizes), "file").select(
        (F.col("_off") + F.col("line_no")).alias("pair_id"), "value",
        F.split("value", "\t").alias("_p"))
    ok = p.where(F.size("_p") >= 2)
    pairs = ok.select(
        "pair_id", F.get("_p", 0).alias("a"), F.get("_p", 1).alias("b"),
        F.when(F.size("_p") < 3, F.lit(-1))
        .otherwise(F.element_at("_p", -1).cast("int")).alias("label"))
    rejects = p.where(F.size("_p") < 2).select("pair_id", F.col("value").alias("line"))
    return pairs, rejects


def write_pairs(pairs: DataFrame, path: str, with_label: bool = True) -> None:
    cols = [F.col("a"), F.col("b")] + ([F.col("label").cast("string")] if with_label else [])
    pairs.orderBy("pair_id").select(F.concat_ws("\t", *cols).alias("value")) \
        .write.mode("overwrite").text(path)


INFERENCE_SCHEMA = T.StructType([T.StructField("index", T.StringType()),
                                 T.StructField("a", T.StringType()),
                                 T.StructField("b", T.StringType())])


def read_inference_pairs(spark: SparkSession, path: str) -> DataFrame:
    """S3: TSV ``index, A, B``; no header, no quoting; empty or missing fields read as ''."""
    df = (spark.read.option("sep", "\t").option("header", "false").option("quote", "")
          .schema(INFERENCE_SCHEMA).csv(path))
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def write_vocab(vocab: DataFrame, path: str, text_path: str | None = None) -> None:
    """Persist (id, token); optionally a text export with one token per line in id order."""
    vocab.select("id", "token").write.mode("overwrite").parquet(path)
    if text_path:
        (vocab.repartitionByRange("id").sortWithinPartitions("id").select("token")
         .write.mode("overwrite").text(text_path))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Load (id, token); both lookup directions are joins on either column."""
    return spark.read.parquet(path).select(F.col("id").cast("int"), "token")


def read_vocab_text(spark: SparkSession, path: str) -> DataFrame:
    """A text vocabulary, one token per line, line number = id."""
    pairs = numbered_lines(spark, path)
    sizes = pairs.groupBy("file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return pairs.join(F.broadcast(sizes), "file").select(
        (F.col("_off") + F.col("line_no")).cast("int").alias("id"), F.col("value").alias("token"))


def vocab_from_counts(counts: DataFrame, min_freq: int) -> DataFrame:
    """A vocabulary from ``(token, freq)`` alone, ties by token (a counts file has no
    first positions)."""
    keyed = counts.select("token", "freq", F.lit(0).cast("long").alias("first_doc_id"),
                          F.lit(0).cast("long").alias("first_line_no"),
                          F.col("token").alias("first_pos"))
    return vb.assign_vocab_ids(keyed, min_freq)


def write_counts(counts: DataFrame, path: str) -> None:
    """``token count`` lines, most frequent first (a CSV writer would quote tokens)."""
    ties = [c for c in ("first_doc_id", "first_line_no", "first_pos") if c in counts.columns]
    counts.orderBy(F.desc("freq"), *ties, "token").select(F.concat_ws(" ", "token", F.col("freq").cast("string")).alias("value")) \
        .write.mode("overwrite").text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """count = last whitespace field, token = the others joined by one space."""
    p = spark.read.text(path).select(F.array_remove(F.split("value", WS_CLASS + "+"), "")
                                     .alias("_p"))
    return p.where(F.size("_p") >= 2).select(
        F.array_join(F.slice("_p", 1, F.size("_p") - 1), " ").alias("token"),
        F.element_at("_p", -1).cast("long").alias("freq"))


def write_codes(codes: DataFrame, path: str) -> None:
    """Ranked merge list."""
    codes.select("rank", "left", "right").write.mode("overwrite").parquet(path)


def write_codes_text(codes: DataFrame, path: str) -> None:
    """``left right`` lines in rank order."""
    codes.orderBy("rank").select(F.concat_ws(" ", "left", "right").alias("value")) \
        .write.mode("overwrite").text(path)


def read_codes_text(spark: SparkSession, path: str) -> DataFrame:
    """``left right`` lines; the line number is the rank."""
    v = read_vocab_text(spark, path)
    p = F.split("token", " ")
    return v.select(F.col("id").alias("rank"), F.get(p, 0).alias("left"), F.get(p, 1).alias("right"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("rank").cast("int"), "left", "right")


ROWS_PER_FILE = 1_000_000


def write_split(df: DataFrame, path: str) -> None:
    """Unk-replaced text of both splits, one folder per split, files of bounded rows."""
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).mode("overwrite").partitionBy("split").parquet(path)


def write_sequences(df: DataFrame, path: str) -> None:
    """Encoded sequences, one folder per round-robin shard; rows of a shard are gathered by
    ranges of their index first, so files hold ``ROWS_PER_FILE`` rows and not a task's few."""
    block = F.floor(F.col("row_idx") / (10 * ROWS_PER_FILE))
    df.select("row_idx", "shard", "ids").repartition("shard", block).write.mode("overwrite").partitionBy("shard") \
        .parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """All shards; consumers order by (shard, row_idx)."""
    return spark.read.parquet(path).select("row_idx", F.col("shard").cast("int"), "ids")


def read_split_index(spark: SparkSession, path: str) -> DataFrame:
    """A one-column table of row numbers."""
    df = spark.read.parquet(path)
    return df.select(F.col(df.columns[0]).cast("long").alias("row_idx"))


METRIC_SCHEMA = "step long, name string, value double, ts timestamp"


def append_metrics(df: DataFrame, path: str) -> None:
    """Append metric records as JSON lines, stamping a time where absent."""
    if "ts" not in df.columns:
        df = df.withColumn("ts", F.lit(None).cast("timestamp"))
    df.withColumn("ts", F.coalesce("ts", F.current_timestamp())) \
        .write.mode("append").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """``index \\t label`` lines."""
    df.select(F.col("index").cast("string"), F.col("label").cast("string")) \
        .write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)
