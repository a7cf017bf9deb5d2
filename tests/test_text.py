"""Text scalars: hand cases and an independent statement of Python's whitespace rules."""

import re

from pyspark.sql import functions as F

from helpers import SF_SMALL
from wordmill.functions import text as tx
from wordmill.sources.corpus import read_corpus, read_table


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("o")).first()["o"]


def test_unicode_whitespace_word_tokens(spark):
    assert one(spark, tx.word_tokens("text"), "　a b\x1cc ") == ["a", "b", "c"]


def test_char_tokens_astral_and_space(spark):
    assert one(spark, tx.char_tokens("text"), "x\U0001F600") == ["x", "\U0001F600"]
    assert one(spark, tx.char_tokens("text"), " a b ") == ["a", "b"]
    assert one(spark, tx.char_tokens("text"), "") == []


def test_whitespace_rules_match_python_on_corpus(spark):
    """Spark tokens/strip equal Python's str.split()/str.strip() on every sf0.001 line, plus
    lines made of each of the 29 whitespace characters."""
    ws = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert len(ws) == 29
    extra = [f"a{w}b{w}" for w in ws] + [ws + "x" + ws]
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    lines = read_corpus(docs).select("text")
    rows = lines.select("text", tx.word_tokens("text").alias("t"), tx.strip("text").alias("s"))
    got = rows.collect()
    for r in got:
        assert r["t"] == r["text"].split()
        assert r["s"] == r["text"].strip()
    df = spark.createDataFrame([(x,) for x in extra], "text string")
    for r in df.select("text", tx.word_tokens("text").alias("t"),
                       tx.strip("text").alias("s")).collect():
        assert r["t"] == r["text"].split()
        assert r["s"] == r["text"].strip()


def test_whitespace_constants_are_pythons(spark):
    ws = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert tx.WS_CHARS == ws
    probe = list(ws) + ["a", "_", "\u200b", "\x00", "\ufeff", "\u180e"]
    df = spark.createDataFrame([(c,) for c in probe], "c string")
    got = {r["c"]: r["m"] for r in df.select("c", F.col("c").rlike("^" + tx.WS_CLASS + "$")
                                             .alias("m")).collect()}
    assert got == {c: c.isspace() for c in probe}


def test_number_tags(spark):
    out = one(spark, tx.tag_numbers("text"), "tel 138****1234 x***")
    assert out == "tel  #num  x #num "


def test_cjk_spacing(spark):
    out = one(spark, tx.strip(tx.collapse_ws(tx.space_cjk("text"))), "花呗a")
    assert out == "花 呗 a"


def _py_space_latin(t):
    return re.sub(r"[a-zA-Z]+", lambda m: " " + m.group() + " " if len(m.group()) > 1 else "", t)


def _py_space_symbols(t):
    cls = "[!“\"#$%&'()+,\\-./:;<=>?@\\[\\]^_`{|}~，。！？、【】「」～；（）：”‘’·－…〈〉』『]+"
    return re.sub(cls, lambda m: " " + " ".join(m.group()) + " ", t)


def test_run_rewrites_match_python_rules(spark):
    samples = ["tel x", "a1b", "ab c de", "Hello, World!!", "x...y", "q(a)[b]", "", "!?!",
               "mixed 12ab3 C d", "“quoted” —dash"]
    df = spark.createDataFrame([(s,) for s in samples], "text string")
    got = df.select("text", tx.space_latin("text").alias("l"),
                    tx.space_symbols("text").alias("s")).collect()
    for r in got:
        assert r["l"] == _py_space_latin(r["text"])
        assert r["s"] == _py_space_symbols(r["text"])


def test_drop_stopwords_keeps_order_and_duplicates(spark):
    out = one(spark, tx.drop_stopwords(tx.word_tokens("text"), ["a", "the"]), "the b a b c the")
    assert out == ["b", "b", "c"]


def test_fix_typos(spark):
    assert one(spark, tx.fix_typos("text"), "花贝借贝") == "花呗借呗"


def test_remove_none_and_flatten(spark):
    df = spark.createDataFrame([([["a"], [], ["b", "c"]],)], "x array<array<string>>")
    assert df.select(tx.flatten("x")).first()[0] == ["a", "b", "c"]
    df = spark.createDataFrame([(["a", None, "b"],)], "x array<string>")
    assert df.select(tx.remove_none("x")).first()[0] == ["a", "b"]


def test_project_with_optional_label(spark):
    with_label = spark.createDataFrame([("x", "y", 1, 9)], "a string, b string, label int, z int")
    without = spark.createDataFrame([("x", "y", 9)], "a string, b string, z int")
    assert tx.project_with_optional_label(with_label).columns == ["a", "b", "label"]
    assert tx.project_with_optional_label(without).columns == ["a", "b"]


def test_private_use_characters_are_kept(spark):
    df = spark.createDataFrame([("a\ue000b\ue001\ue000c!?\u82b1\u5457x",)], "t string")
    got = df.select(tx.space_symbols("t"), tx.space_cjk("t")).first()
    assert got[0] == "a\ue000b\ue001\ue000c ! ? \u82b1\u5457x"
    assert got[1] == "a\ue000b\ue001\ue000c!? \u82b1 \u5457 x"
