"""K-d tree sharding by weight.

The tree splits the documents again and again at the weighted median of the widest metadata
dimension (its spread inside the node over its spread at the root), until a leaf holds one
shard's share of the bytes. A weighted median is found by histograms: one aggregate over narrow
rows sums the weight per node and bin, the bin that holds the median is cut into bins anew. Rows
equal in the split dimension are cut by a hash of the row, so a value that holds a third of all
rows doesn't unbalance a split. The driver holds one row per node; a shard follows from a
document's own columns, so texts are neither shuffled nor joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm.common import drop, free_name, scratch, small_table, written

BINS = 4096
LIMIT = 1 << 61        # coordinates are kept within +-2^61, so differences fit a long
TIE_BITS = 62


def category(c) -> Column:
    """A number for a category (equal values, equal numbers)."""
    return F.pmod(F.xxhash64(c), F.lit(1 << 20))


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")


@dataclass
class Split:
    node: int
    dim: int           # number of the dimension
    value: int         # left: coordinate below it, or equal and tie below ``tie``
    tie: int
    left: int          # child nodes
    right: int


@dataclass
class Tree:
    dims: list[str]
    n_shards: int
    levels: list[list[Split]] = field(default_factory=list)
    leaves: dict[int, int] = field(default_factory=dict)   # node -> shard


def _coordinates(dims: dict[str, Column]) -> list[Column]:
    return [F.coalesce(F.least(F.greatest(c.cast("long"), F.lit(-LIMIT)), F.lit(LIMIT)),
                       F.lit(-LIMIT)).alias(f"d{i}") for i, c in enumerate(dims.values())]


def _tie(keys: list) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - TIE_BITS).alias("tie")


def _table(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A row per tree node."""
    return F.broadcast(small_table(spark, rows, schema))


def _next_nodes(rows: DataFrame, splits: list[Split], n_dims: int) -> DataFrame:
    """Send every row of a split node to its child; rows of leaves stay."""
    spark = rows.sparkSession
    if len(splits) == 1 and splits[0].node == 0:    # the root: all rows, no table needed
        s = splits[0]
        x, tie = F.col(f"d{s.dim}"), F.col("tie")
        left = (x < s.value) | ((x == s.value) & (tie < s.tie))
        return rows.withColumn("node", F.when(left, s.left).otherwise(s.right).cast("long"))
    t = _table(spark, [(s.node, s.dim, s.value, s.tie, s.left, s.right) for s in splits],
               "node long, s_dim int, s_value long, s_tie long, s_left long, s_right long")
    x = _pick("s_dim", n_dims)
    left = (x < F.col("s_value")) | ((x == F.col("s_value")) & (F.col("tie") < F.col("s_tie")))
    return (rows.join(t, "node", "left")
            .withColumn("node", F.when(F.col("s_left").isNull(), F.col("node"))
                        .when(left, F.col("s_left")).otherwise(F.col("s_right")))
            .drop("s_dim", "s_value", "s_tie", "s_left", "s_right"))


def _pick(dim: str, n_dims: int) -> Column:
    out = F.col("d0")
    for i in range(1, n_dims):
        out = F.when(F.col(dim) == i, F.col(f"d{i}")).otherwise(out)
    return out


def _medians(rows: DataFrame, todo: dict[int, dict], n_dims: int, tolerance: float) -> None:
    """Find value and tie of each node's split. Each round is one aggregate over the rows and
    returns one row per node: the bin that holds the target and the weight before it."""
    spark = rows.sparkSession
    for n in todo.values():
        n.update(at_tie=False, before=0, done=False)
    while any(not n["done"] for n in todo.values()):
        info = []
        for node, n in todo.items():
            if n["done"]:
                continue
            n["step"] = max(1, -(-(n["hi"] - n["lo"] + 1) // BINS))
            info.append((node, n["dim"], n["at_tie"], n.get("value", 0), n["lo"], n["hi"],
                         n["step"], float(n["target"] - n["before"])))
        t = _table(spark, info, "node long, i_dim int, at_tie boolean, at long, lo long, hi long, "
                                "step long, target double")
        x = _pick("i_dim", n_dims)
        pos = F.when(F.col("at_tie"), F.col("tie")).otherwise(x)
        hist = (rows.join(t, "node")
                .where(~F.col("at_tie") | (x == F.col("at")))
                .withColumn("pos", pos).where("pos between lo and hi")
                .groupBy("node", F.expr("(pos - lo) div step").alias("bin"))
                .agg(F.sum("weight").alias("w"), F.first("target").alias("target")))
        upto = Window.partitionBy("node").orderBy("bin")
        cut = (hist.withColumn("upto", F.sum("w").over(upto))
               .withColumn("most", F.max("bin").over(Window.partitionBy("node")))
               .where((F.col("upto") >= F.col("target")) | (F.col("bin") == F.col("most")))
               .groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("c")))
        for r in cut.collect():
            n, c = todo[r["node"]], r["c"]
            before = n["before"] + c["upto"] - c["w"]
            lo = n["lo"] + c["bin"] * n["step"]
            hi = min(n["hi"], lo + n["step"] - 1)
            small = c["w"] <= tolerance * n["weight"]
            if small or (n["step"] == 1 and n["at_tie"]):
                # the bin's end that lies nearer to the target
                end = lo if n["target"] - before <= before + c["w"] - n["target"] else hi + 1
                n["value"], n["tie"] = (n["value"], end) if n["at_tie"] else (end, 0)
                n["done"] = True
            elif n["step"] == 1:  # one value of the dimension: go on by tie among its rows
                n.update(value=lo, at_tie=True, lo=0, hi=(1 << TIE_BITS) - 1, before=before)
            else:
                n.update(lo=lo, hi=hi, before=before)


def build_tree(docs: DataFrame, dims: dict[str, Column], weight: Column, keys: list,
               n_shards: int | None = None, target_bytes: int | None = None,
               tolerance: float = 1e-4) -> Tree:
    """The tree over all rows of ``docs``: ``n_shards`` leaves, or as many as total weight over
    ``target_bytes``. ``keys`` are the columns whose hash cuts ties. A null coordinate counts as
    the smallest; rows equal in everything stay together. No rows: one leaf, shard 0."""
    spark = docs.sparkSession
    k = len(dims)
    rows, path = written(docs.select(*_coordinates(dims), _tie(keys),
                                     weight.cast("long").alias("weight"),
                                     F.lit(0).cast("long").alias("node")), "kd-rows")
    total = rows.agg(F.sum("weight")).head()[0] or 0
    shards = n_shards or max(1, -(-total // target_bytes))
    tree = Tree(list(dims), shards)
    open_ = {0: (0, shards)} if total and shards > 1 else {}   # node -> (first shard, count)
    tree.leaves = {} if open_ else {0: 0}
    root, next_id = None, 1
    while open_:
        seen = rows.where(F.col("node").isin(list(open_))) if len(open_) < 100 else rows
        stats = {r["node"]: r for r in seen.groupBy("node").agg(
            F.sum("weight").alias("weight"),
            *[f(f"d{i}").alias(f"{n}{i}") for i in range(k) for n, f in (("lo", F.min), ("hi", F.max))]
        ).collect()}
        if root is None:
            root = [max(1, stats[0][f"hi{i}"] - stats[0][f"lo{i}"]) for i in range(k)]
        todo = {}
        for node, (first, count) in list(open_.items()):
            if node not in stats:   # nothing in it: all its shards but the first stay empty
                tree.leaves[node] = first
                continue
            s = stats[node]
            wide = [(s[f"hi{i}"] - s[f"lo{i}"]) / root[i] for i in range(k)]
            dim = max(range(k), key=lambda i: (wide[i], -i))
            todo[node] = {"dim": dim, "weight": s["weight"], "lo": s[f"lo{dim}"],
                          "hi": s[f"hi{dim}"], "target": s["weight"] * (count // 2) / count}
        _medians(rows, todo, k, tolerance)
        level, after = [], {}
        for node, n in todo.items():
            first, count = open_[node]
            split = Split(node, n["dim"], n["value"], n["tie"], next_id, next_id + 1)
            next_id += 2
            level.append(split)
            for child, at, c in ((split.left, first, count // 2),
                                 (split.right, first + count // 2, count - count // 2)):
                if c == 1:
                    tree.leaves[child] = at
                else:
                    after[child] = (at, c)
        tree.levels.append(level)
        open_ = after
        if open_:
            rows, new = written(_next_nodes(rows, level, k), "kd-rows")
            drop(spark, path)
            path = new
    drop(spark, path)
    return tree


def assign(docs: DataFrame, tree: Tree, dims: dict[str, Column], keys: list,
           name: str = "shard") -> DataFrame:
    """``docs`` with its shard in a new column: broadcasts of one row per tree node, no shuffle."""
    spark, k = docs.sparkSession, len(dims)
    row = free_name(docs, "_row")
    out = docs.select(F.struct("*").alias(row), *_coordinates(dims), _tie(keys),
                      F.lit(0).cast("long").alias("node"))
    for level in tree.levels:
        out = _next_nodes(out, level, k)
    leaves = _table(spark, list(tree.leaves.items()), "node long, leaf int")
    return out.join(leaves, "node").select(f"{row}.*", F.col("leaf").alias(name))


def number_slots(rows: DataFrame, shard: str = "shard", order: str = "doc_id",
                 rows_per_chunk: int = 100_000) -> DataFrame:
    """``slot``: gapless numbers from 0 in each shard. Shards are numbered in chunks by a hash of
    the order column and the text's crc; offsets have a row per shard and chunk and are joined by
    the keys that the rows are already partitioned by.

    Rows equal in all columns are counted before the shuffle and numbered as one row, so copies
    never meet in a task; they are spread out again in runs of ``rows_per_chunk``. All columns
    take part in the order, so every evaluation gives equal rows equal sets of slots."""
    cols = rows.columns
    counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    chunks = max(1, rows.count() // rows_per_chunk)
    counted = counted.withColumn("_chunk", F.pmod(F.xxhash64(order, "text_crc32"), F.lit(chunks)))
    sizes = counted.groupBy(shard, "_chunk").agg(F.sum("_n").alias("_all"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "_chunk", F.coalesce(
        F.sum("_all").over(upto(Window.partitionBy(shard).orderBy("_chunk"))), F.lit(0)).alias("_first"))
    by = Window.partitionBy(shard, "_chunk").orderBy(order, *[c for c in cols if c not in (order, shard)])
    numbered = (counted.withColumn("_at", F.coalesce(F.sum("_n").over(upto(by)), F.lit(0)))
                .join(offsets, [shard, "_chunk"]))
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(rows_per_chunk).cast("long")))
    one = F.explode(F.sequence(F.col("_run"), F.least(F.col("_n"), F.col("_run") + rows_per_chunk) - 1))
    return (numbered.withColumn("_run", runs).withColumn("_copy", one)
            .withColumn("slot", (F.col("_first") + F.col("_at") + F.col("_copy")).cast("long"))
            .select(*cols, "slot"))


def _metadata(docs: DataFrame) -> dict[str, Column]:
    """Dimensions of the documents table, as far as it has them."""
    have = {"n_chars": F.col("n_chars"), "lang": category("lang"), "source": category("source")}
    return {k: c for k, c in have.items() if k in docs.columns} or {"doc_id": F.col("doc_id")}


def shard_documents(docs: DataFrame, n_shards: int | None = 16,
                    target_bytes: int | None = None) -> DataFrame:
    """``docs`` (all its columns) and ``shard``. Law: bytes (UTF-8 size plus 1 per row, shards
    near equal). Null texts weigh 1; null metadata counts as the smallest; an existing column
    named shard is replaced; an empty table gives an empty result."""
    docs = docs.drop("shard")
    dims, keys = _metadata(docs), ["doc_id", "text"]
    tree = build_tree(docs, dims, text_size(), keys, n_shards, target_bytes)
    return assign(docs, tree, dims, keys)


def shard_table(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    path = scratch(docs.sparkSession, "shards")
    (shard_documents(docs, n_shards)
     .select("doc_id", text_size().alias("size"),
             F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
             F.lit("bytes").alias("law"), "shard", F.lit(None).cast("int").alias("grown_shard"))
     .write.parquet(path))
    return (number_slots(docs.sparkSession.read.parquet(path))
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
