"""Vocabulary rules: ordering, ties, reserved tokens, unk replacement, encoding."""

from helpers import lines_df
from wordmill.functions import frames as fr
from wordmill.operators import vocab as vb
from wordmill.plans import prepare as pp


def vocab_of(spark, texts, k=1, mode="word"):
    v = vb.assign_vocab_ids(vb.token_counts(lines_df(spark, texts), mode), k)
    return {r["token"]: r["id"] for r in v.collect()}


def test_frequency_tie_first_seen(spark):
    assert vocab_of(spark, ["b a", "a b"]) == {"UNK": 0, "b": 1, "a": 2}


def test_literal_reserved_token(spark):
    v = vocab_of(spark, ["UNK " * 25 + "x _start_"], k=1)
    assert v["UNK"] == 0 and "_start_" not in v and list(v.values()).count(0) == 1


def test_ids_dense_and_unique(spark):
    v = vocab_of(spark, ["a b c d e a b c a b a", "f g a"], k=1)
    assert sorted(v.values()) == list(range(len(v)))
    assert v["a"] == 1 and v["b"] == 2 and v["c"] == 3


def test_char_mode_space_gives_empty_token(spark):
    lines = lines_df(spark, ["a b"] * 25)
    v, n = pp.build_vocab(lines, "char", 20, materialize=False)
    assert {r["token"]: r["id"] for r in v.collect()} == {"UNK": 0, "a": 1, "b": 2}
    rep = vb.unk_replace(lines_df(spark, ["a b", "a　c"]), v, "char").orderBy("line_no")
    assert [r["text"] for r in rep.collect()] == ["a  b", "a  UNK"]
    enc = vb.encode(rep, vb.add_specials(v, n)).orderBy("line_no")
    assert [r["ids"] for r in enc.collect()] == [[1, 0, 2], [1, 0, 0]]


def test_empty_line_frames_to_start_unk_end(spark):
    v = spark.createDataFrame([(0, "UNK"), (1, "a"), (2, "b")], "id int, token string")
    enc = vb.encode(lines_df(spark, [""]), vb.add_specials(v, 3))
    ids = enc.select(fr.frame("ids", 5, 3, 5).alias("f")).first()["f"]
    assert ids == [3, 0, 5]


def test_specials(spark):
    v = spark.createDataFrame([(0, "UNK"), (1, "a"), (2, "b")], "id int, token string")
    s = {r["token"]: r["id"] for r in vb.add_specials(v, 3).collect()}
    assert (s["_start_"], s["_delimiter_"], s["_end_"]) == (3, 4, 5)


def test_unk_replace_word(spark):
    lines = lines_df(spark, ["x y x", "  ", "y z"])
    v = spark.createDataFrame([(0, "UNK"), (1, "x")], "id int, token string")
    out = vb.unk_replace(lines, v, "word").orderBy("line_no").collect()
    assert [r["text"] for r in out] == ["x UNK x", "", "UNK UNK"]


def test_large_stop_table(spark):
    toks = vb.corpus_tokens(lines_df(spark, ["the a b the c"]))
    stop = spark.createDataFrame([("the",), ("c",)], "w string")
    out = vb.drop_stopwords_table(toks, stop).orderBy("pos").collect()
    assert [r["token"] for r in out] == ["a", "b"]


def test_line_count_from_counting_pass(spark):
    lines = lines_df(spark, ["a b", "", "  ", "a"])
    v, n, n_lines = pp.build_vocab(lines, "word", 1, materialize=False, with_line_count=True)
    assert n_lines == 4 and n == 3
    assert "\n" not in {r["token"] for r in v.collect()}


def test_chars_are_counted_before_they_become_rows(spark):
    rows = [(2, 0, "b a　a"), (1, 1, "ab😀"), (1, 0, None), (None, 0, "zz a"), (1, 1, ""), (0, 3, " ")]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, text string").repartition(3)
    got = vb.token_counts(lines, "char", line_sentinel=True)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "posexplode" not in plan.lower() and "MapInArrow" in plan
    want = {"a": (4, 1, 1, 0), "b": (2, 1, 1, 1), "😀": (1, 1, 1, 2), "z": (2, None, None, None),
            "\n": (5, 0, 3, 0)}
    want["a"], want["b"] = (4, 1, 1, 0), (2, 1, 1, 1)
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
