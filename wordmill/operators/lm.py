"""Count-based language model over encoded sequences (M6, M7) and embedding lookup.

The transformer of the original is replaced by an add-k bigram model fitted on the same
framed id sequences and scored with the same masked per-position loss, so every aggregate
downstream (sequence loss, perplexity, batch averages) is the original's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.functions import frames as fr
from wordmill.operators.joins import hot_split_join
from wordmill.session import BROADCAST_MAX_BYTES, cut_lineage, small_enough


def target_positions(seqs: DataFrame, ids: str = "ids", seq: str = "row_idx") -> DataFrame:
    """W7 exploded: (seq, pos, prev, next, next_mask) for target positions 1..len-1."""
    return seqs.select(F.col(seq).alias("seq"), F.explode(fr.next_token_targets(ids)).alias("t")) \
        .select("seq", F.col("t.pos").alias("pos"), F.col("t.prev").alias("prev"),
                F.col("t.next").alias("next"))


def fit_ngram_lm(train: DataFrame, ids: str = "ids", seq: str = "row_idx",
                 materialize: bool = True) -> tuple:
    """M6: bigram counts (prev, next, c) and context totals (prev, t).

    The counts are an aggregate with map-side partial aggregation (a hot context id costs one
    row per map task in the shuffle). The fitted counts are the model: with ``materialize``
    they are written once to the checkpoint folder and the totals are summed from that copy,
    so scoring does not aggregate the training sequences twice.
    """
    t = target_positions(train, ids, seq)
    bigrams = t.groupBy("prev", "next").agg(F.count(F.lit(1)).alias("c"))
    if materialize:
        bigrams = cut_lineage(bigrams)
    totals = bigrams.groupBy("prev").agg(F.sum("c").alias("t"))
    return bigrams, totals


def score_ngram_lm(dev: DataFrame, bigrams: DataFrame, totals: DataFrame, n_types: int,
                   k: float = 1.0, mask: str = "length", ids: str = "ids",
                   seq: str = "row_idx") -> DataFrame:
    """M7: per-position loss -ln((c + k) / (t + k·n_types)) with its mask.

    ``mask='length'`` keeps every real target (validation rule); ``'nonzero'`` drops UNK
    targets (training rule, sign(id)). The bigram table grows with the corpus, the dev set does
    not: the distinct dev pairs (combined map-side) pick their bigrams first, and only those few
    rows meet the dev positions, so a hot pair such as (UNK, UNK) is one row on that side.
    """
    t = target_positions(dev, ids, seq)
    asked = t.select("prev", "next").distinct()
    asked = cut_lineage(asked)
    near = F.broadcast(asked) if small_enough(asked) else asked
    few = cut_lineage(near.join(bigrams, ["prev", "next"]).join(totals, "prev"))
    ctx = cut_lineage(asked.select("prev").distinct().join(totals, "prev"))
    hint = F.broadcast if small_enough(asked) else (lambda d: d)
    j = (t.join(hint(few.select("prev", "next", "c")), ["prev", "next"], "left")
         .join(hint(ctx), "prev", "left"))
    p = (F.coalesce(F.col("c"), F.lit(0)) + F.lit(k)) / \
        (F.coalesce(F.col("t"), F.lit(0)) + F.lit(k * n_types))
    m = F.lit(1.0) if mask == "length" else F.signum("next").cast("double")
    return j.select("seq", "pos", (-F.log(p)).alias("loss"), m.alias("mask"))


def embedding_lookup_sum(framed: DataFrame, emb: DataFrame, n_vocab: int,
                         keys=("pair_id", "ord"), ids: str = "ids", key: str = "vec_id",
                         vec: str = "embedding", n_special: int = 3,
                         limit: int = BROADCAST_MAX_BYTES, derive: dict | None = None) -> DataFrame:
    """h[pos] = E[id] + E[V + n_special + pos] for every position of every sequence.

    What is added depends on (id, pos) alone, and there are far fewer of those than positions. So
    the vector table is joined twice (token row and position row) with the distinct (id, pos), the
    two vectors are added there with ``zip_with``, and every position looks its sum up. Tables of
    at most ``limit`` measured bytes are broadcast; larger ones are joined with the hot keys split
    off. A position whose id or position id has no row keeps its row with a null ``h``. ``derive``
    names columns made from ``h``; they too are worked out once per (id, pos).
    """
    seqs = cut_lineage(framed.select(*keys, ids))       # read twice, the ids are made once
    ex = seqs.select(*keys, F.posexplode(ids).alias("pos", "id")) \
        .withColumn("pos_id", F.lit(n_vocab + n_special) + F.col("pos"))
    e = emb.select(F.col(key).alias("_k"), F.transform(vec, lambda x: x.cast("double"))
                   .alias("_v"))
    size = e.agg(F.sum(F.size("_v") * 8 + 40)).head()[0] or 0
    def look(df, key, name):
        table = e.select(F.col("_k").cast(df.schema[key].dataType).alias(key), F.col("_v").alias(name))
        return df.join(F.broadcast(table), key, "left") if size <= limit else hot_split_join(df, table, key)

    asked = cut_lineage(ex.select("id", "pos", "pos_id").distinct())
    both = look(look(asked, "id", "_tv"), "pos_id", "_pv")
    at = F.struct("id", "pos")
    sums = both.select(at.alias("_at"), F.zip_with("_tv", "_pv", lambda a, b: a + b).alias("h"))
    sums = cut_lineage(sums.select("*", *[c.alias(n) for n, c in (derive or {}).items()]))
    made = sums.agg(F.sum(F.coalesce(F.size("h"), F.lit(0)) * 8 + 100)).head()[0] or 0
    marked = ex.withColumn("_at", at)
    found = (marked.join(F.broadcast(sums), "_at", "left") if made <= limit
             else hot_split_join(marked, sums, "_at"))
    return found.select(*keys, "pos", "id", "pos_id", "h", *(derive or {}))
