"""Properties of the composite plans on the sf0.001 corpus."""

from pyspark.sql import functions as F

from helpers import SF_SMALL
from wordmill.operators import vocab as vb
from wordmill.plans import prepare as pp
from wordmill.sources.corpus import read_corpus, read_table


def test_prepare_corpus_and_sequences_properties(spark):
    lines = read_corpus(read_table(spark, SF_SMALL, "documents").select("doc_id", "text"))
    prep = pp.prepare_corpus(lines, "word")
    c = prep.corpus
    # train and dev partition the corpus: every line once, in exactly one split
    assert c.count() == lines.count()
    assert c.select("doc_id", "line_no").distinct().count() == lines.count()
    assert set(r["split"] for r in c.select("split").distinct().collect()) <= {"train", "dev"}
    # unk-replaced text only holds vocabulary tokens
    vocab = {r["token"] for r in prep.vocab.collect()}
    toks = c.select(F.explode(F.split("text", " ")).alias("t")).where("t <> ''")
    assert {r["t"] for r in toks.distinct().collect()} <= vocab
    seqs = pp.prepare_sequences(prep, n_ctx=16, n_shards=10)
    n = c.where("split = 'train'").count()
    got = seqs.select("row_idx", "shard", "ids").collect()
    assert sorted(r["row_idx"] for r in got) == list(range(n))
    v = prep.n_vocab
    for r in got:
        assert 2 <= len(r["ids"]) <= 16
        assert r["ids"][0] == v and r["ids"][-1] == v + 2
        assert all(0 <= x < v + 3 for x in r["ids"])
        assert r["shard"] == r["row_idx"] % 10
    sizes = [r["count"] for r in seqs.groupBy("shard").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_narrow_lookups_equal_joins(spark):
    lines = read_corpus(read_table(spark, SF_SMALL, "documents").select("doc_id", "text"))
    for mode in ("word", "char"):
        v = vb.assign_vocab_ids(vb.token_counts(lines, mode), 5)
        a, b = (vb.unk_replace(lines, v, mode, limit=x) for x in (1 << 30, 0))
        assert a.count() == lines.count() and a.exceptAll(b).count() == 0
        t = vb.add_specials(v, v.count())
        a, b = (vb.encode(lines, t, limit=x) for x in (1 << 30, 0))
        assert a.count() == lines.count() and a.exceptAll(b).count() == 0


def test_split_sequences_equal_per_split(spark):
    lines = read_corpus(read_table(spark, SF_SMALL, "documents").select("doc_id", "text"))
    prep = pp.prepare_corpus(lines, "word")
    both = pp.prepare_split_sequences(prep, n_ctx=30)
    for which in ("train", "dev"):
        one = pp.prepare_sequences(prep, n_ctx=30, which=which)
        got = both.where(F.col("split") == which).drop("split")
        assert got.count() == one.count()
        assert got.exceptAll(one.select(*got.columns)).count() == 0


def test_lookups_in_packed_tables_equal_joins(spark):
    lines = read_corpus(read_table(spark, SF_SMALL, "documents").select("doc_id", "text"))
    for mode in ("word", "char"):
        v = vb.assign_vocab_ids(vb.token_counts(lines, mode), 2)
        table = vb.vocab_lookup_table(v)
        n = 40 * v.count()              # room for the arrays, not for a dict of some 200 bytes a token
        assert isinstance(vb.sent_table(table, n), tuple) and vb.sent_table(table, 0) is None
        a, b = (vb.unk_replace(lines, v, mode, limit=x) for x in (n, 0))
        assert a.count() == lines.count() and a.exceptAll(b).count() == 0
        t = vb.add_specials(v, v.count())
        a, b = (vb.encode(lines, t, limit=x) for x in (n, 0))
        assert a.count() == lines.count() and a.exceptAll(b).count() == 0


def test_equal_hashes_in_a_packed_table():
    import pyarrow as pa
    from xxhash import xxh64_intdigest
    h = xxh64_intdigest("b".encode(), 42)
    h -= (h >> 63) << 64
    table = vb.PackedTable((pa.array([h, h]), pa.array([1, 2]), pa.array(["a", "b"])))
    assert table["b"] == 2 and table["a"] is None and table["c"] is None


def test_the_corpus_is_counted_once(spark):
    counts = vb.token_counts(read_corpus(read_table(spark, SF_SMALL, "documents").select("doc_id", "text")),
                             line_sentinel=True)
    kept = []
    was = pp.cut_lineage
    try:
        pp.cut_lineage = lambda df: kept.append(df) or was(df)
        v, n_vocab, n_lines = pp.build_vocab(
            read_corpus(read_table(spark, SF_SMALL, "documents").select("doc_id", "text")), with_line_count=True)
    finally:
        pp.cut_lineage = was
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2          # lines and tokens; a union had them twice
    assert n_lines == counts.where(F.col("token") == vb.LINE_SENTINEL).head()["freq"]
    assert n_vocab == v.count()
