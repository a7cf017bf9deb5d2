"""Streaming variants (R1, R2) with Structured Streaming.

The original streams text through stdin/stdout filters one line at a time; here arriving
files of documents are the stream. Both queries keep their progress in a checkpoint under the
shared folder named by ``spark.checkpoint.dir``, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordmill.functions import frames as fr
from wordmill.operators import bpe, vocab as vb
from wordmill.session import checkpoint_dir, cut_lineage
from wordmill.sources.corpus import read_corpus

DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def read_document_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Documents arriving as parquet files under ``path`` (a folder or glob). ``max_files`` limits
    a micro-batch where a user wants smaller ones; by default it takes all that arrived."""
    r = spark.readStream.schema(DOCUMENT_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path).select("doc_id", "text")


def stream_token_counts(docs: DataFrame, mode: str = "word") -> DataFrame:
    """Running token counts over arriving lines (stateful streaming aggregate)."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.select(F.explode(vb.count_tokens_col("text", mode)).alias("token")) \
        .groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


COUNTS_SCHEMA = "token string, freq long"
COMPACT_EVERY = 20      # batches of R1 between two compactions


def _folders(spark: SparkSession, path: str, column: str) -> dict[int, str]:
    """Committed ``column=<number>`` folders under a path, by number."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for f in fs.listStatus(p) if fs.exists(p) else []:
        name = f.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")
        if name.startswith(column + "=") and fs.exists(done):
            found[int(name.split("=")[1])] = f.getPath().toString()
    return found


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _newest(spark: SparkSession, out_path: str, upto: int | None = None) -> tuple[list, int]:
    """Folders that hold the running counts (the newest base and the batches after it), and the
    last batch in that base (-1 without one)."""
    out = out_path.rstrip("/")
    bases = {k: v for k, v in _folders(spark, out + "/_base", "upto").items() if upto is None or k <= upto}
    last = max(bases, default=-1)
    batches = [v for k, v in sorted(_folders(spark, out, "batch_id").items())
               if k > last and (upto is None or k <= upto)]
    return ([bases[last]] if bases else []) + batches, last


def compact_token_counts(spark: SparkSession, out_path: str, upto: int) -> None:
    """Merge what batches up to ``upto`` wrote into one base table, a row per token (counts only
    grow, so the largest is the latest). Folders that the base before this one had already taken
    in are deleted, one generation late, so that a reader of that time still finds its files."""
    out = out_path.rstrip("/")
    paths, before = _newest(spark, out, upto)
    if not paths or before == upto:
        return
    (spark.read.schema(COUNTS_SCHEMA).parquet(*paths).groupBy("token").agg(F.max("freq").alias("freq"))
     .write.mode("overwrite").parquet(f"{out}/_base/upto={upto}"))
    for k, path in _folders(spark, out, "batch_id").items():
        if k <= before:
            _delete(spark, path)
    for k, path in _folders(spark, out + "/_base", "upto").items():
        if k < before:
            _delete(spark, path)


def counts_writer(out_path: str, compact_every: int = COMPACT_EVERY):
    """The ``foreachBatch`` function of R1: the counts that a batch changed replace the
    ``batch_id=`` folder of an earlier attempt; every ``compact_every`` batches all are merged."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
        if (batch_id + 1) % compact_every == 0:
            compact_token_counts(batch.sparkSession, out_path, batch_id)
    return run


def start_token_counts(docs: DataFrame, out_path: str, name: str, mode: str = "word",
                       available_now: bool = True,
                       compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Run R1: each micro-batch writes the counts that it changed (update mode);
    ``read_token_counts`` gives the running totals. The state stays on the executors, nothing is
    collected, a replayed batch replaces its folder, and there are never more than two
    compactions' worth of folders, however long the query runs."""
    spark = docs.sparkSession
    w = (stream_token_counts(docs, mode).writeStream.outputMode("update")
         .foreachBatch(counts_writer(out_path, compact_every))
         .option("checkpointLocation", checkpoint_dir(spark).rstrip("/") + f"/streams/{name}"))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_token_counts(spark: SparkSession, out_path: str) -> DataFrame:
    """Running totals: the latest written count of every token."""
    paths, _ = _newest(spark, out_path)
    if not paths:
        return spark.createDataFrame([], COUNTS_SCHEMA)
    return (spark.read.schema(COUNTS_SCHEMA).parquet(*paths).groupBy("token")
            .agg(F.max("freq").alias("freq")))


def encode_batch(lines: DataFrame, codes: DataFrame, vocab: DataFrame, n_vocab: int,
                 n_ctx: int) -> DataFrame:
    """The batch form of R2: segment, unk-replace, encode with specials, frame."""
    seg = bpe.segment_text(lines, codes)
    rep = vb.unk_replace(seg, vocab, "word")
    enc = vb.encode(rep, vb.add_specials(vocab, n_vocab))
    sp = vb.special_ids(n_vocab)
    return enc.select("doc_id", "line_no",
                      fr.frame("ids", n_ctx, sp[vb.START], sp[vb.END]).alias("ids"))


def encode_writer(codes: DataFrame, vocab: DataFrame, n_vocab: int, out_path: str,
                  n_ctx: int = 200, name: str = "stream_encode"):
    """The ``foreachBatch`` function of R2: a batch's encoded lines replace the
    ``query=<name>/batch_id=`` folder of an earlier attempt at the same batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        out = encode_batch(read_corpus(batch), codes, vocab, n_vocab, n_ctx)
        out.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/query={name}/batch_id={batch_id}")
    return run


def start_stream_encode(docs: DataFrame, codes: DataFrame, vocab: DataFrame, n_vocab: int,
                        out_path: str, name: str, n_ctx: int = 200,
                        available_now: bool = True) -> StreamingQuery:
    """R2: arriving lines segmented, unk-replaced, encoded and framed in ``foreachBatch``.

    A batch is written to the folder of its number under that of the query ``name``, which also
    names the checkpoint: a replayed batch (after a failure) replaces its own output, and several
    queries can write to one ``out_path`` without touching each other's batches.
    """
    spark = docs.sparkSession
    codes = cut_lineage(codes.select("rank", "left", "right"))
    vocab = cut_lineage(vocab.select("id", "token"))
    run = encode_writer(codes, vocab, n_vocab, out_path, n_ctx, name)
    w = (docs.writeStream.foreachBatch(run)
         .option("checkpointLocation", checkpoint_dir(spark).rstrip("/") + f"/streams/{name}"))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def read_encoded(spark: SparkSession, out_path: str, name: str | None = None) -> DataFrame:
    """Encoded lines of all queries that wrote to ``out_path``, or of one: ``doc_id, line_no, ids,
    query, batch_id``."""
    df = spark.read.parquet(out_path)
    return df if name is None else df.where(F.col("query") == name)
