"""Scans and sinks: ragged TSV, round trips of every persisted table."""

import os

from pyspark.sql import functions as F

from wordmill.operators import rows
from wordmill.sources import corpus as src


def write_text(path, lines):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, "part-0.txt"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_ragged_tsv(spark, tmp_dir):
    p = os.path.join(tmp_dir, "pairs")
    write_text(p, ['q"a\tb\t1', "c\td", "e\tf\tx\t0", "lonely"])
    pairs, rejects = src.read_pairs(spark, p)
    got = pairs.orderBy("pair_id").collect()
    assert [(r["a"], r["b"], r["label"]) for r in got] == [('q"a', "b", 1), ("c", "d", -1),
                                                           ("e", "f", 0)]
    assert [r["line"] for r in rejects.collect()] == ["lonely"]


def test_inference_pairs_and_predictions(spark, tmp_dir):
    p = os.path.join(tmp_dir, "inf")
    write_text(p, ['7\t"x\ty', "8\tz\tw"])
    df = src.read_inference_pairs(spark, p)
    assert [(r["index"], r["a"], r["b"]) for r in df.orderBy("index").collect()] == \
        [("7", '"x', "y"), ("8", "z", "w")]
    out = os.path.join(tmp_dir, "pred")
    src.write_predictions(df.withColumn("label", F.lit(1)), out)
    text = spark.read.text(out).collect()
    assert sorted(r["value"] for r in text) == ["7\t1", "8\t1"]


def test_vocab_counts_codes_roundtrip(spark, tmp_dir):
    v = spark.createDataFrame([(0, "UNK"), (1, "a"), (2, "b")], "id int, token string")
    src.write_vocab(v, os.path.join(tmp_dir, "v"), os.path.join(tmp_dir, "vt"))
    assert sorted(src.read_vocab(spark, os.path.join(tmp_dir, "v")).collect()) == \
        sorted(v.collect())
    c = spark.createDataFrame([("a", 5), ("b", 2)], "token string, freq long")
    src.write_counts(c, os.path.join(tmp_dir, "c"))
    assert sorted(src.read_counts(spark, os.path.join(tmp_dir, "c")).collect()) == \
        sorted(c.collect())
    k = spark.createDataFrame([(0, "a", "b")], "rank int, left string, right string")
    src.write_codes(k, os.path.join(tmp_dir, "k"))
    assert src.read_codes(spark, os.path.join(tmp_dir, "k")).collect() == k.collect()


def test_sequences_split_metrics(spark, tmp_dir):
    df = spark.createDataFrame([(i, [1, i]) for i in range(25)], "row_idx long, ids array<int>")
    seq = rows.round_robin_shard(df, 10)
    src.write_sequences(seq, os.path.join(tmp_dir, "s"))
    back = src.read_sequences(spark, os.path.join(tmp_dir, "s"))
    assert back.count() == 25 and back.select("shard").distinct().count() == 10
    assert sorted((r["row_idx"], r["ids"]) for r in back.collect()) == \
        [(i, [1, i]) for i in range(25)]
    sp = spark.createDataFrame([(0, "dev", "x"), (1, "train", "y")],
                               "line_no int, split string, text string")
    src.write_split(sp, os.path.join(tmp_dir, "sp"))
    assert spark.read.parquet(os.path.join(tmp_dir, "sp")).where("split = 'dev'").count() == 1
    m = spark.createDataFrame([(1, "loss", 0.5)], "step long, name string, value double")
    src.append_metrics(m, os.path.join(tmp_dir, "m"))
    src.append_metrics(m, os.path.join(tmp_dir, "m"))
    got = src.read_metrics(spark, os.path.join(tmp_dir, "m")).collect()
    assert len(got) == 2 and all(r["ts"] is not None for r in got)
    idx = spark.createDataFrame([(3,), (5,)], "i int")
    idx.write.parquet(os.path.join(tmp_dir, "idx"))
    assert sorted(r["row_idx"] for r in src.read_split_index(
        spark, os.path.join(tmp_dir, "idx")).collect()) == [3, 5]


def test_read_corpus_from_text_files(spark, tmp_dir):
    p = os.path.join(tmp_dir, "txt")
    write_text(p, ["one line", "", "third"])
    ln = src.read_corpus(p, spark).orderBy("line_no").collect()
    assert [r["text"] for r in ln] == ["one line", "", "third"]


def test_lines_of_several_files_and_splits(spark, tmp_dir):
    p = os.path.join(tmp_dir, "many")
    os.makedirs(p)
    want = []
    for f in range(3):
        lines = [f"{f} {i} " + "x" * (i % 50) for i in range((f + 1) * 400)]
        want += [(f, i, t) for i, t in enumerate(lines)]
        with open(os.path.join(p, f"part-{f}.txt"), "w", encoding="utf-8") as out:
            out.write("\n".join(lines) + "\n" * (f % 2))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = src.read_corpus(p, spark)
        assert got.rdd.getNumPartitions() >= 1
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pairs_keep_file_order(spark, tmp_dir):
    p = os.path.join(tmp_dir, "ordered")
    os.makedirs(p)
    for f, n in enumerate((3, 400, 20)):
        with open(os.path.join(p, f"part-{f}.txt"), "w", encoding="utf-8") as out:
            out.write("".join(f"a{f}-{i}\tb\n" for i in range(n)))
    pairs, _ = src.read_pairs(spark, p)
    got = sorted((r["pair_id"], r["a"]) for r in pairs.collect())
    assert got == list(enumerate(f"a{f}-{i}" for f, n in enumerate((3, 400, 20)) for i in range(n)))


def test_text_vocab_codes_and_counts(spark, tmp_dir):
    from wordmill.operators import vocab as vb
    v = spark.createDataFrame([(0, "UNK"), (1, "b"), (2, "a")], "id int, token string")
    src.write_vocab(v, os.path.join(tmp_dir, "v2"), os.path.join(tmp_dir, "vt2"))
    assert sorted(src.read_vocab_text(spark, os.path.join(tmp_dir, "vt2")).collect()) == sorted(v.collect())
    k = spark.createDataFrame([(1, "th", "e"), (0, "t", "h")], "rank int, left string, right string")
    src.write_codes_text(k, os.path.join(tmp_dir, "kt"))
    assert sorted(src.read_codes_text(spark, os.path.join(tmp_dir, "kt")).collect()) == sorted(k.collect())
    c = spark.createDataFrame([("a", 5), ("b", 9), ("c", 1)], "token string, freq long")
    src.write_counts(c, os.path.join(tmp_dir, "ct"))
    lines = [r["value"] for r in spark.read.text(os.path.join(tmp_dir, "ct")).collect()]
    assert sorted(lines) == ["a 5", "b 9", "c 1"]
    made = src.vocab_from_counts(src.read_counts(spark, os.path.join(tmp_dir, "ct")), 2)
    assert sorted(map(tuple, made.collect())) == [(0, "UNK"), (1, "b"), (2, "a")]
    assert vb.UNK == "UNK"
