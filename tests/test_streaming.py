"""Streaming R1/R2 equal their batch forms; a replayed R2 does not duplicate rows."""

from helpers import SF_SMALL
from wordmill.operators import bpe, vocab as vb
from wordmill.plans import prepare as pp
from wordmill.sources.corpus import read_corpus, read_table
from wordmill.streaming import stream as st

PATTERN = SF_SMALL + "/documents*.parquet"


def test_stream_token_counts_equals_batch(spark, tmp_dir):
    out = tmp_dir + "/counts"
    q = st.start_token_counts(st.read_document_stream(spark, PATTERN), out, "wm_counts_test")
    q.awaitTermination()
    got = {r["token"]: r["freq"] for r in st.read_token_counts(spark, out).collect()}
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    want = {r["token"]: r["freq"] for r in vb.token_counts(read_corpus(docs)).collect()}
    assert got == want


def test_stream_encode_equals_batch_and_replays(spark, tmp_dir):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    lines = read_corpus(docs)
    codes = bpe.learn_bpe(bpe.word_symbols(lines), 10)
    seg = bpe.segment_text(lines, codes)
    v, n = pp.build_vocab(seg, "word", 5)
    out = tmp_dir + "/enc"
    for _ in range(2):   # second start: nothing new, no duplicate rows
        q = st.start_stream_encode(st.read_document_stream(spark, PATTERN), codes, v, n, out,
                                   "wm_encode_test", n_ctx=50)
        q.awaitTermination()
    # a replay of the first batch, as after a failure between its write and its commit
    st.encode_writer(codes, v, n, out, 50, "wm_encode_test")(docs, 0)
    got = spark.read.parquet(out)
    want = st.encode_batch(lines, codes, v, n, 50)
    assert got.count() == want.count()
    diff = got.select("doc_id", "line_no", "ids").exceptAll(
        want.select("doc_id", "line_no", "ids"))
    assert diff.count() == 0


def files_under(path):
    import os
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_many_batches_leave_few_folders(spark, tmp_dir):
    import os
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    docs.repartition(12).write.parquet(tmp_dir + "/in")
    out = tmp_dir + "/counts"
    stream = st.read_document_stream(spark, tmp_dir + "/in", max_files=1)
    st.start_token_counts(stream, out, "wm_compact_test", compact_every=3).awaitTermination()
    batches = [d for d in os.listdir(out) if d.startswith("batch_id=")]
    assert len(batches) <= 6 and len(os.listdir(out + "/_base")) <= 4       # two bases, their checksums
    want = {r["token"]: r["freq"] for r in vb.token_counts(read_corpus(docs.select("doc_id", "text"))).collect()}
    count = lambda: {r["token"]: r["freq"] for r in st.read_token_counts(spark, out).collect()}
    assert count() == want
    # a replay of an old batch, and of the compaction after it, changes nothing
    old = spark.createDataFrame([("zzz", 1)], st.COUNTS_SCHEMA).where("freq > 1")
    st.counts_writer(out, 3)(old, 2)
    st.compact_token_counts(spark, out, 11)
    assert count() == want
    # a base whose write did not end is no base
    os.makedirs(out + "/_base/upto=99")
    assert count() == want
    assert st.read_token_counts(spark, tmp_dir + "/none").count() == 0


def test_two_queries_share_a_path(spark, tmp_dir):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    lines = read_corpus(docs.select("doc_id", "text"))
    codes = bpe.learn_bpe(bpe.word_symbols(lines), 5)
    v, n = pp.build_vocab(bpe.segment_text(lines, codes), "word", 5)
    out = tmp_dir + "/enc"
    for name, part in (("one", "doc_id < 20"), ("two", "doc_id >= 20")):
        docs.where(part).write.parquet(f"{tmp_dir}/{name}")
        stream = st.read_document_stream(spark, f"{tmp_dir}/{name}")
        st.start_stream_encode(stream, codes, v, n, out, "wm_share_" + name, 50).awaitTermination()
    key = lambda r: (r["doc_id"], r["line_no"], tuple(r["ids"]))
    want = sorted(map(key, st.encode_batch(lines, codes, v, n, 50).collect()))
    assert sorted(map(key, st.read_encoded(spark, out).collect())) == want
    one = st.read_encoded(spark, out, "wm_share_one").collect()
    assert {r["doc_id"] < 20 for r in one} == {True} and {r["batch_id"] for r in one} == {0}
