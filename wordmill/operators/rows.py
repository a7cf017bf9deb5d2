"""Row numbering, sharding, batching, ordering and set operators.

Dense file-order numbering never uses one global window: rows are range-partitioned on the
order key (the sampler splits even one hot document across partitions because the key is
unique), sorted inside each partition, numbered locally, and shifted by the running total of
the earlier partitions. The offset table has one row per partition, so broadcasting it is
bounded by the partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.session import cut_lineage


def dense_index(df: DataFrame, order: list, name: str = "row_idx",
                num_partitions: int | None = None) -> DataFrame:
    """0-based dense row number in ``order`` (which must be a unique key).

    One range shuffle. Rows are numbered inside each range partition and that result is
    written once to the reliable checkpoint folder, so the per-partition counts and the
    numbered rows come from the same partitioning (a second evaluation of the range shuffle
    could sample different bounds) and a lost executor cannot renumber anything.
    """
    cols = df.columns
    # without an explicit count AQE sizes the range partitions (coalesced neighbours are still
    # contiguous ranges); the written copy makes the numbering independent of that choice
    ranged = (df.repartitionByRange(num_partitions, *order) if num_partitions
              else df.repartitionByRange(*order))
    local = (ranged.sortWithinPartitions(*order)
             .withColumn("_pid", F.spark_partition_id())
             .withColumn("_local", F.monotonically_increasing_id()
                         - F.shiftleft(F.col("_pid").cast("long"), 33)))
    local = cut_lineage(local)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
            .select(*cols, (F.col("_off") + F.col("_local")).alias(name)))


def round_robin_shard(df: DataFrame, n_shards: int = 10, idx: str = "row_idx",
                      name: str = "shard") -> DataFrame:
    """shard = row index mod n."""
    return df.withColumn(name, (F.col(idx) % n_shards).cast("int"))


def shard_positions(df: DataFrame, name: str = "_i") -> DataFrame:
    """Position of every row in (shard, row_idx) order, 0-based and dense.

    Where shards were dealt round robin from a dense index, which one aggregate per shard shows,
    the position is arithmetic: the rows of earlier shards plus the place in the own one. Nothing
    is shuffled. Any other numbering takes ``dense_index``.
    """
    per = df.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("lo"),
                                  F.max("row_idx").alias("hi"),
                                  F.count_distinct("row_idx").alias("d")).orderBy("shard").collect()
    step = len(per)
    dealt = all(r["lo"] == r["shard"] == i and r["d"] == r["n"] and r["hi"] == i + (r["n"] - 1) * step
                for i, r in enumerate(per))
    if not dealt:
        return dense_index(df, [F.col("shard"), F.col("row_idx")], name=name)
    before = [0]
    for r in per:
        before.append(before[-1] + r["n"])
    first = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("shard"))
    return df.withColumn(name, first + F.floor(F.col("row_idx") / max(1, step)).cast("long"))


def padded_batches(df: DataFrame, batch_size: int, ids: str = "ids",
                   order: list | None = None) -> DataFrame:
    """Consecutive rows in (shard, row_idx) order, zero-padded to the batch maximum.

    The last partial batch is dropped (drop-remainder batching). Output adds ``batch``,
    ``batch_pos`` and ``padded``. One exchange, by batch, where positions are arithmetic
    (``shard_positions``); another ``order`` is numbered first.
    """
    numbered = dense_index(df, order, name="_i") if order else shard_positions(df)
    total = numbered.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    full = (total // batch_size) * batch_size
    b = numbered.where(F.col("_i") < full).withColumn(
        "batch", F.floor(F.col("_i") / batch_size).cast("long"))
    w = Window.partitionBy("batch")
    b = b.withColumn("_maxlen", F.max(F.size(ids)).over(w))
    return (b.withColumn("batch_pos", (F.col("_i") % batch_size).cast("int"))
            .withColumn("padded", F.concat(F.col(ids), F.array_repeat(
                F.lit(0), (F.col("_maxlen") - F.size(ids)).cast("int"))))
            .drop("_i", "_maxlen"))


def iter_batches(df: DataFrame, n_batch: int, truncate: bool = False,
                 max_batches: int | None = None, idx: str = "row_idx",
                 total: int | None = None) -> DataFrame:
    """Batch number floor(i / n) with optional truncation to full batches and a cap."""
    if total is None:
        total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    n = (total // n_batch) * n_batch if truncate else total
    if max_batches is not None:
        n = min(n, max_batches * n_batch)
    return (df.where(F.col(idx) < n)
            .withColumn("batch", F.floor(F.col(idx) / n_batch).cast("long")))


def head(df: DataFrame, n: int, idx: str = "row_idx") -> DataFrame:
    """O3: the first n rows by row index."""
    return df.where(F.col(idx) < n)


def shuffle_key(seed: int, epoch, key) -> Column:
    """Seeded, reproducible random order key for a row (or a batch) in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(seed), epoch if isinstance(epoch, Column)
                             else F.lit(epoch), key if isinstance(key, Column) else F.col(key)))


def shuffle(df: DataFrame, seed: int, epoch: int, key: str = "row_idx",
            name: str = "order_idx", ties: tuple = ()) -> DataFrame:
    """A new seeded permutation per epoch; ``order_idx`` is the shuffled position. With a
    batch number as ``key`` whole batches change places; ``ties`` orders the rows inside one."""
    keyed = df.withColumn("_k", shuffle_key(seed, epoch, key))
    return dense_index(keyed, [F.col("_k"), F.col(key), *ties], name=name).drop("_k")


def draw(seed: int, epoch: int, *what) -> Column:
    """A seeded 32-bit draw as a long (the first 8 hex digits of an md5)."""
    key = F.concat_ws(":", F.lit(seed), F.lit(epoch), *[w.cast("string") for w in what])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def buffered_shuffle(df: DataFrame, seed: int, epoch: int, buffer: int = 1000, idx: str = "batch",
                     stream: str | None = None, name: str = "order_idx") -> DataFrame:
    """O4, streamed form: the order in which a shuffle buffer of ``buffer`` entries lets the rows
    of a stream go. ``idx`` is dense from 0 in each ``stream`` (without one, df is one stream).

    The buffer first fills up. In step t entry ``draw(t) % buffer`` leaves and the next row takes
    its place, until no row is left to come; what is then in the buffer leaves in the order of
    seeded keys. No buffer has to be run for that: a row enters a known entry at a known step and
    leaves at the entry's next draw, so the order is one window per entry (``lead`` over its
    draws) plus one over the last ``buffer`` rows.
    """
    s = F.col(stream) if stream else F.lit(0)
    rows = df.withColumn("_s", s.cast("long"))
    n = F.broadcast(rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_n")))   # a row per stream
    size = F.least(F.lit(buffer), F.col("_n"))
    i, step = F.col(idx).cast("long"), F.col(idx).cast("long") - size
    entry = F.when(step < 0, i).otherwise(F.pmod(draw(seed, epoch, F.col("_s"), step), size))
    rows = rows.join(n, "_s").withColumn("_size", size).withColumn("_entry", entry).withColumn(
        "_in", F.greatest(step, F.lit(-1)))
    out = F.lead("_in").over(Window.partitionBy("_s", "_entry").orderBy("_in"))
    rows = rows.withColumn("_out", out)
    gone = rows.where("_out is not null").withColumn(name, F.col("_out"))
    last = Window.partitionBy("_s").orderBy(draw(seed, epoch, F.col("_s"), F.lit("end"), i), i)
    left = rows.where("_out is null").withColumn(
        name, F.col("_n") - F.col("_size") + F.row_number().over(last) - 1)
    return gone.unionByName(left).drop("_s", "_n", "_size", "_entry", "_in", "_out")


def stack_columns(pairs: DataFrame, a: str = "a", b: str = "b", idx: str = "row_idx",
                  text: str = "text") -> DataFrame:
    """All A rows, then all B rows, as one corpus keyed by (side, row_idx)."""
    left = pairs.select(F.lit(0).alias("side"), F.col(idx), F.col(a).alias(text))
    right = pairs.select(F.lit(1).alias("side"), F.col(idx), F.col(b).alias(text))
    return left.unionByName(right)


def concat_datasets(first: DataFrame, second: DataFrame, idx: str = "row_idx") -> DataFrame:
    """Append ``second`` after ``first`` and re-index densely."""
    u = (first.withColumn("_src", F.lit(0))
         .unionByName(second.withColumn("_src", F.lit(1))))
    u = u.withColumnRenamed(idx, "_old")
    return dense_index(u, [F.col("_src"), F.col("_old")], name=idx).drop("_src", "_old")


def repeat_epochs(df: DataFrame, n: int, name: str = "epoch") -> DataFrame:
    """The data set repeated n times (generator, no join)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def index_complement(idx: DataFrame, n: int, col: str = "row_idx") -> DataFrame:
    """U4: symmetric difference of an index set with 0..n-1."""
    spark = idx.sparkSession
    everything = spark.range(n).select(F.col("id").alias(col))
    i = idx.select(col)
    return i.subtract(everything).unionByName(everything.subtract(i))
