"""Row numbering, shards, batches, halves, set operators and the plan scale guard."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import SF_SMALL, brute_learn
from wordmill.operators import bpe, pairs as pr, rows, split, vocab as vb
from wordmill.sources.corpus import read_corpus, read_table


def corpus_lines(spark):
    return read_corpus(read_table(spark, SF_SMALL, "documents").select("doc_id", "text"))


def test_dense_index_equals_row_number(spark):
    ln = corpus_lines(spark)
    a = rows.dense_index(ln, [F.col("doc_id"), F.col("line_no")])
    b = ln.withColumn("rn", F.row_number().over(Window.orderBy("doc_id", "line_no")) - 1)
    j = a.join(b, ["doc_id", "line_no"])
    assert j.count() == ln.count()
    assert j.where(F.col("row_idx") != F.col("rn")).count() == 0


def test_shards_balanced(spark):
    ln = rows.round_robin_shard(rows.dense_index(corpus_lines(spark),
                                                 [F.col("doc_id"), F.col("line_no")]), 10)
    sizes = [r["count"] for r in ln.groupBy("shard").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 1


def test_halves_odd(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate("pqrst")], "row_idx long, text string")
    out = pr.unstack_halves(df, 5).orderBy("row_idx").collect()
    assert [(r["a"], r["b"]) for r in out] == [("p", "s"), ("q", "t")]


def test_padded_batches_drop_last(spark):
    df = spark.createDataFrame([(0, 0, [1, 1, 1]), (1, 0, [2] * 5), (2, 0, [3, 3])],
                               "row_idx long, shard int, ids array<int>")
    out = rows.padded_batches(df, 2).orderBy("batch_pos").collect()
    assert [r["padded"] for r in out] == [[1, 1, 1, 0, 0], [2] * 5]


def test_iter_batches_and_head(spark):
    df = spark.range(10).withColumnRenamed("id", "row_idx")
    b = rows.iter_batches(df, 4, truncate=True, max_batches=None)
    assert b.count() == 8 and b.agg(F.max("batch")).first()[0] == 1
    assert rows.iter_batches(df, 4, truncate=True, max_batches=1).count() == 4
    assert rows.head(df, 3).count() == 3


def test_shuffle_permutation(spark):
    df = spark.range(50).withColumnRenamed("id", "row_idx")
    a = rows.shuffle(df, 42, 0)
    b = rows.shuffle(df, 42, 1)
    assert sorted(r["order_idx"] for r in a.collect()) == list(range(50))
    ka = [r["row_idx"] for r in a.orderBy("order_idx").collect()]
    kb = [r["row_idx"] for r in b.orderBy("order_idx").collect()]
    assert ka != kb and sorted(ka) == list(range(50))


def test_index_ops(spark):
    idx = spark.createDataFrame([(0,), (4,), (8,)], "row_idx long")
    rep = sorted(r["row_idx"] for r in split.replicate_index(idx, 10).collect())
    assert rep == sorted([0, 4, 8, 2, 6, 10, 5, 9, 13, 7, 11, 15])
    comp = sorted(r["row_idx"] for r in rows.index_complement(idx, 6).collect())
    assert comp == [1, 2, 3, 5, 8]
    df = spark.range(12).withColumnRenamed("id", "row_idx")
    s = split.split_by_index(df, idx)
    assert s.where(F.col("split") == "dev").count() == 3 and s.count() == 12
    assert rows.repeat_epochs(df, 3).count() == 36


def test_random_split_rate_and_disjoint(spark):
    ln = corpus_lines(spark)
    n = ln.count()
    s = split.random_split(ln, 0.1, 42)
    dev = s.where(F.col("split") == "dev").count()
    assert s.count() == n and 0.05 * n < dev < 0.15 * n
    assert split.dev_rate(1000) == 0.1 and split.dev_rate(1_000_000) == 0.01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_inputs_ok(plan: str) -> bool:
    """Every single-partition exchange must read the per-partition count table of dense
    numbering (one row per partition), never lines- or token-sized data."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = next((x for x in lines[i + 1:] if x.strip()), "")
            if "HashAggregate(keys=[_pid" not in nxt:
                return False
    return True


def test_no_single_partition_exchange_over_lines(spark):
    ln = corpus_lines(spark)
    counts = vb.token_counts(ln)
    v = vb.assign_vocab_ids(counts, 2)
    for df in (counts, bpe.pair_stats(bpe.word_symbols(ln)), vb.unk_replace(ln, v, "word"),
               rows.dense_index(ln, [F.col("doc_id"), F.col("line_no")])):
        assert _single_partition_inputs_ok(_plan(df))
    assert "SinglePartition" not in _plan(counts)


def test_plan_properties(spark):
    ln = corpus_lines(spark)
    counts = vb.token_counts(ln)
    p = _plan(counts)
    assert "HashAggregate" in p and "SortAggregate" not in p
    # column pruning: the corpus scan reads only the key and the text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p
    v = spark.createDataFrame([(0, "UNK"), (1, "a")], "id int, token string")
    rep = vb.unk_replace(read_corpus(read_table(spark, SF_SMALL, "documents")), v, "word")
    rp = _plan(rep)
    # a narrow pass: no exchange over text
    assert "Exchange" not in rp and "ArrowEvalPython" in rp


def test_approx_totals(spark):
    ln = corpus_lines(spark)
    exact = vb.corpus_totals(ln).first()
    approx = vb.corpus_totals(ln, approx=True).first()
    assert exact["n_tokens"] == approx["n_tokens"]
    assert abs(approx["n_distinct"] - exact["n_distinct"]) <= 0.05 * exact["n_distinct"]


def buffer_order(n, size, pick, last):
    """The buffer itself, one row at a time."""
    buf, out = list(range(min(size, n))), []
    for step in range(n - len(buf)):
        e = pick(step) % len(buf)
        out.append(buf[e])
        buf[e] = step + len(buf)
    return out + sorted(buf, key=lambda i: (last(i), i))


def test_buffered_shuffle_equals_a_running_buffer(spark):
    import hashlib
    draw = lambda *k: int(hashlib.md5(":".join(map(str, k)).encode()).hexdigest()[:8], 16)
    sizes = {0: 0, 1: 1, 2: 7, 3: 50, 4: 333}
    df = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "shard int, batch long")
    got = {}
    for r in rows.buffered_shuffle(df, 5, 2, buffer=10, stream="shard").collect():
        got.setdefault(r["shard"], {})[r["order_idx"]] = r["batch"]
    for s, n in sizes.items():
        want = buffer_order(n, 10, lambda t: draw(5, 2, s, t), lambda i: draw(5, 2, s, "end", i))
        assert [got.get(s, {})[k] for k in range(n)] == want
    one = rows.buffered_shuffle(df.where("shard = 4"), 5, 3, buffer=10).collect()
    assert sorted(r["order_idx"] for r in one) == list(range(333))
    assert all(r["order_idx"] >= r["batch"] - 10 for r in one)       # nothing leaves before it came


def test_shard_positions_are_arithmetic_where_shards_were_dealt(spark):
    df = rows.round_robin_shard(spark.range(1003).withColumnRenamed("id", "row_idx"), 7)
    got = rows.shard_positions(df)
    assert "Exchange" not in _plan(got)
    order = [r["row_idx"] for r in got.orderBy("_i").collect()]
    assert order == sorted(range(1003), key=lambda i: (i % 7, i))
    assert [r["_i"] for r in got.orderBy("_i").collect()] == list(range(1003))
    some = df.where("row_idx <> 500")                                # a gap: numbered by the rows
    order = [r["row_idx"] for r in rows.shard_positions(some).orderBy("_i").collect()]
    assert order == sorted((i for i in range(1003) if i != 500), key=lambda i: (i % 7, i))
    b = rows.padded_batches(df.withColumn("ids", F.array(F.col("row_idx").cast("int"))), 8)
    assert _plan(b).count("Exchange") == 1


def test_sequences_are_prepared_without_shuffling_text(spark):
    """What is exchanged while sequences are made are keys and framed ids."""
    from wordmill.plans import prepare as pp
    p = pp.prepare_corpus(corpus_lines(spark), "word", min_freq=2)
    seen = []
    real = rows.dense_index
    try:
        rows.dense_index = lambda df, *a, **k: seen.append(df.columns) or real(df, *a, **k)
        n = pp.prepare_sequences(p, 50).count() + pp.prepare_sequences(p, 50, which="dev").count()
        both = pp.prepare_split_sequences(p, 50).count()
    finally:
        rows.dense_index = real
    assert n == both == p.corpus.count()
    assert len(seen) == 3 and all("text" not in c and "ids" in c for c in seen)


def test_hot_keys_are_split_off_the_lookup_join(spark):
    from wordmill.operators.joins import hot_split_join
    df = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, F.lit("hot"))
                                  .when(F.col("id") % 3 == 0, F.lit(None))
                                  .otherwise(F.concat(F.lit("k"), F.col("id") % 2000)).alias("tok"))
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 2000, 3)]], "tok string, v int")
    got = hot_split_join(df, table, "tok", share=100)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, df.join(table, "tok", "left").select(
        "tok", "id", "v").collect()))
    p = _plan(got)
    assert p.count("BroadcastHashJoin") + p.count("BroadcastExchange") >= 3 and "Union" in p


def test_lookups_beyond_the_broadcast_size_are_the_same(spark):
    from wordmill.operators import lm
    seqs = spark.createDataFrame([(i, 0, [1, 1, 1, i % 5, 9]) for i in range(200)],
                                 "pair_id long, ord int, ids array<int>")
    emb = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(16) if i != 3],
                                "vec_id long, embedding array<double>")
    key = lambda r: str(tuple(r))
    a = lm.embedding_lookup_sum(seqs, emb, 6).collect()
    b = lm.embedding_lookup_sum(seqs, emb, 6, limit=0).collect()
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) == 1000
    assert any(r["h"] is None for r in a) and any(r["h"] for r in a)


def test_embedding_sums_are_made_once_per_id_and_position(spark):
    from wordmill.operators import lm
    seqs = spark.createDataFrame([(i, 0, [1, 2, 1, None, 9]) for i in range(300)] + [(7, 1, [])],
                                 "pair_id long, ord int, ids array<int>")
    emb = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(16) if i != 3] + [(1, [0.5, 0.5])],
                                "vec_id long, embedding array<double>")
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    got = lm.embedding_lookup_sum(seqs, emb, 2, derive={"total": total})
    assert "zip_with" not in _plan(got)          # no position adds vectors
    rows = got.collect()
    # id 1 has two vectors, position 2 of the row is at pos_id 7; a null id has no sum
    assert len(rows) == 300 * 7
    for r in rows:
        assert (r["h"] is None) == (r["id"] is None) and r["total"] == (None if r["h"] is None else sum(r["h"]))
    assert {tuple(r["h"]) for r in rows if r["pos"] == 1} == {(8.0, 16.0)}
    assert {tuple(r["h"]) for r in rows if r["pos"] == 2} == {(8.0, 16.0), (7.5, 14.5)}
