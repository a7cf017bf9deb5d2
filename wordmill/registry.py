"""Registered queries: one per inventory operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (``documents``, ``labels``, ``embeddings``) or data Spark
derives from them, over whole tables and whole texts. Output conventions (shared with the SQL
oracle): integers as bigint, doubles rounded to 6 places, arrays as space-joined strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions import frames as fr
from wordmill.functions import scoring as scr
from wordmill.functions import text as tx
from wordmill.operators import bpe, lm, rows, split, vocab as vb
from wordmill.operators import classifier as clf
from wordmill.operators import evaluate as ev
from wordmill.operators import pairs as pr
from wordmill.plans import prepare as pp
from wordmill.plans import shell_chains as sc
from wordmill.session import cut_lineage, literal_rows, scratch_path
from wordmill.sources import corpus as src
from wordmill.streaming import stream as stm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

N_CTX = 200          # pre-training context (the original default)
N_SHARDS = 10        # sequence shards
N_BATCH = 8          # pre-training batch size
SHUFFLE_BUFFER = 1000   # entries of the streamed batch shuffle
CLF_N_CTX = 73       # pair classifier context
SEED = split.DEFAULT_SEED


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def normalize(df: DataFrame) -> DataFrame:
    """Integers to bigint, floats to double rounded to 6 places."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def ids_str(c) -> F.Column:
    return F.array_join(F.transform(c if not isinstance(c, str) else F.col(c),
                                    lambda x: x.cast("string")), " ")


# ------------------------------------------------------------------ shared inputs

def documents(spark, sf) -> DataFrame:
    return src.read_table(spark, sf, "documents").select("doc_id", "text")


def lines(spark, sf) -> DataFrame:
    """Corpus lines; the test tables are single small files, so their documents are spread."""
    return src.read_corpus(documents(spark, sf), spread=2 * spark.sparkContext.defaultParallelism)


_CACHE: dict = {}
_CODES: dict = {}


def prepared(spark, sf, mode="word") -> pp.Prepared:
    """E12 for a table folder, computed once per session (vocabulary materialised)."""
    key = (spark.sparkContext.applicationId, sf, mode)
    if key not in _CACHE:
        _CACHE[key] = pp.prepare_corpus(lines(spark, sf), mode)
    return _CACHE[key]


# ------------------------------------------------------------------ S1, T1-T3

@query("corpus_lines")
def q_corpus_lines(spark, sf):
    return normalize(lines(spark, sf))


@query("word_tokens")
def q_word_tokens(spark, sf):
    t = tx.word_tokens("text")
    return normalize(lines(spark, sf).select("doc_id", "line_no", F.size(t).alias("n_tokens"),
                                             tx.join_tokens(t).alias("tokens")))


@query("char_tokens")
def q_char_tokens(spark, sf):
    t = tx.char_tokens("text")
    return normalize(lines(spark, sf).select("doc_id", "line_no", F.size(t).alias("n_chars"),
                                             tx.join_tokens(t).alias("chars")))


@query("strip_text")
def q_strip(spark, sf):
    return normalize(lines(spark, sf).select("doc_id", "line_no", tx.strip("text").alias("text")))


# ------------------------------------------------------------------ A1-A3, W1, W2, O1

@query("token_counts_word")
def q_counts_word(spark, sf):
    return normalize(vb.token_counts(lines(spark, sf), "word"))


@query("token_counts_char")
def q_counts_char(spark, sf):
    return normalize(vb.token_counts(lines(spark, sf), "char"))


@query("corpus_totals")
def q_totals(spark, sf):
    return normalize(vb.corpus_totals(lines(spark, sf), "word"))


@query("min_count")
def q_min_count(spark, sf):
    c = vb.token_counts(lines(spark, sf), "word")
    return normalize(vb.min_count(c, vb.MIN_COUNT_PREPARE).select("token", "freq"))


@query("vocab_word")
def q_vocab_word(spark, sf):
    return normalize(prepared(spark, sf, "word").vocab)


@query("vocab_char")
def q_vocab_char(spark, sf):
    return normalize(prepared(spark, sf, "char").vocab)


@query("vocab_specials")
def q_vocab_specials(spark, sf):
    p = prepared(spark, sf, "word")
    return normalize(vb.add_specials(p.vocab, p.n_vocab))


@query("counts_by_frequency")
def q_counts_by_frequency(spark, sf):
    c = vb.token_counts(lines(spark, sf), "word")
    return normalize(vb.counts_by_frequency(c).select("rank", "token", "freq"))


# ------------------------------------------------------------------ J1, J2, E1-E3, E12

@query("unk_replace_word")
def q_unk_word(spark, sf):
    p = prepared(spark, sf, "word")
    return normalize(vb.unk_replace(lines(spark, sf), p.vocab, "word"))


@query("unk_replace_char")
def q_unk_char(spark, sf):
    p = prepared(spark, sf, "char")
    return normalize(vb.unk_replace(lines(spark, sf), p.vocab, "char"))


@query("dev_rate")
def q_dev_rate(spark, sf):
    return normalize(split.dev_rate_frame(lines(spark, sf)))


@query("dev_rate_by_chars")
def q_dev_rate_chars(spark, sf):
    chars = lines(spark, sf).select(F.size(tx.char_tokens("text")).alias("n_chars"))
    return normalize(split.dev_rate_by_chars_frame(chars))


@query("random_split")
def q_random_split(spark, sf):
    ln = lines(spark, sf)
    rate = split.dev_rate(ln.count())
    return normalize(split.random_split(ln, rate, SEED).select("doc_id", "line_no", "split"))


@query("prepare_corpus")
def q_prepare_corpus(spark, sf):
    return normalize(prepared(spark, sf, "word").corpus)


@query("prepare_corpus_char")
def q_prepare_corpus_char(spark, sf):
    return normalize(prepared(spark, sf, "char").corpus)


# ------------------------------------------------------------------ J3, E4-E11, W3, W4, E13

def _encoded(spark, sf, which=None):
    p = prepared(spark, sf, "word")
    c = p.corpus if which is None else p.corpus.where(F.col("split") == which)
    table = vb.add_specials(p.vocab, p.n_vocab)
    return vb.encode(c, table), p.n_vocab


@query("encode")
def q_encode(spark, sf):
    enc, _ = _encoded(spark, sf)
    return normalize(enc.select("doc_id", "line_no", F.size("ids").alias("n_ids"),
                                ids_str("ids").alias("ids")))


def _framed_train(spark, sf):
    enc, v = _encoded(spark, sf, "train")
    sp = vb.special_ids(v)
    return enc.select("doc_id", "line_no", fr.frame("ids", N_CTX, sp[vb.START], sp[vb.END])
                      .alias("ids")), v


@query("frame")
def q_frame(spark, sf):
    f, _ = _framed_train(spark, sf)
    return normalize(f.select("doc_id", "line_no", ids_str("ids").alias("ids")))


@query("pad")
def q_pad(spark, sf):
    f, _ = _framed_train(spark, sf)
    return normalize(f.select("doc_id", "line_no", ids_str(fr.pad("ids", N_CTX)).alias("padded")))


@query("length_mask")
def q_length_mask(spark, sf):
    f, _ = _framed_train(spark, sf)
    m = fr.length_mask("ids", N_CTX)
    return normalize(f.select("doc_id", "line_no",
                              F.aggregate(m, F.lit(0.0), lambda a, x: a + x).alias("mask_sum"),
                              ids_str(F.transform(m, lambda x: x.cast("int"))).alias("mask")))


@query("nonzero_mask")
def q_nonzero_mask(spark, sf):
    f, _ = _framed_train(spark, sf)
    m = fr.nonzero_mask(fr.pad("ids", N_CTX))
    return normalize(f.select("doc_id", "line_no",
                              F.aggregate(m, F.lit(0.0), lambda a, x: a + x).alias("mask_sum"),
                              ids_str(F.transform(m, lambda x: x.cast("int"))).alias("mask")))


@query("position_ids")
def q_position_ids(spark, sf):
    f, v = _framed_train(spark, sf)
    p = fr.position_ids("ids", v)
    return normalize(f.select("doc_id", "line_no",
                              ids_str(F.transform(p, lambda s: s["pos_id"])).alias("pos_ids")))


@query("end_position")
def q_end_position(spark, sf):
    f, v = _framed_train(spark, sf)
    return normalize(f.select("doc_id", "line_no",
                              fr.end_position("ids", vb.special_ids(v)[vb.END]).alias("end_pos")))


@query("sequence_length")
def q_sequence_length(spark, sf):
    f, _ = _framed_train(spark, sf)
    return normalize(f.select("doc_id", "line_no", fr.sequence_length("ids", N_CTX).alias("len")))


def _split_sequences(spark, sf):
    """E13 for both splits, numbered and encoded in one pass, written once per session."""
    key = (spark.sparkContext.applicationId, sf, "sequences")
    if key not in _CACHE:
        _CACHE[key] = pp.prepare_split_sequences(prepared(spark, sf, "word"), N_CTX, N_SHARDS)
    return _CACHE[key]


def _sequences(spark, sf):
    return _split_sequences(spark, sf).where(F.col("split") == "train").drop("split")


@query("row_index")
def q_row_index(spark, sf):
    f, _ = _framed_train(spark, sf)
    return normalize(rows.dense_index(f.select("doc_id", "line_no"),
                                      [F.col("doc_id"), F.col("line_no")]))


@query("round_robin_shard")
def q_shard(spark, sf):
    s = _sequences(spark, sf)
    return normalize(s.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"),
                                            F.min("row_idx").alias("first_row")))


@query("prepare_sequences")
def q_prepare_sequences(spark, sf):
    s = _sequences(spark, sf)
    return normalize(s.select("row_idx", "shard", ids_str("ids").alias("ids")))


# ------------------------------------------------------------------ flagship

def flagship_summary(spark, sf) -> DataFrame:
    """E12 summarised: lines, tokens and UNK tokens per split."""
    c = prepared(spark, sf, "word").corpus
    toks = tx.word_tokens("text")
    return normalize(c.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.size(toks)).cast("long").alias("n_tokens"),
        F.sum(F.size(F.filter(toks, lambda t: t == vb.UNK))).cast("long").alias("n_unk")))


@query("prepare_corpus_summary")
def q_flagship(spark, sf):
    return flagship_summary(spark, sf)


# ------------------------------------------------------------------ T5-T20 cleaners

STOP_K = 20   # stop list of the registered queries: the 20 most frequent tokens (data-derived)


def _line_map(spark, sf, fn, name="text"):
    return normalize(lines(spark, sf).select("doc_id", "line_no", fn(F.col("text")).alias(name)))


for _name, _fn in [("mask_alnum", tx.mask_alnum), ("collapse_stars", tx.collapse_stars),
                   ("fix_typos", tx.fix_typos), ("tag_numbers", tx.tag_numbers),
                   ("star_numbers", tx.star_numbers), ("space_latin", tx.space_latin),
                   ("lower_latin", tx.lower_latin), ("space_symbols", tx.space_symbols),
                   ("space_cjk", tx.space_cjk), ("collapse_ws", tx.collapse_ws),
                   ("clean_symbols", tx.clean_symbols), ("clean_numbers", tx.clean_numbers)]:
    QUERIES[_name] = (lambda fn: lambda spark, sf: _line_map(spark, sf, fn))(_fn)


# The corpus holds none of the characters these three look for; frequent letters of its lines
# stand in for them, so that lines do change.
for _name, _fn in [
        ("fix_typos", lambda t: tx.fix_typos(F.translate(t, "erth", "花贝借呗"))),
        ("space_cjk", lambda t: tx.space_cjk(F.translate(t, "the", "花呗贝"))),
        ("collapse_ws", lambda t: tx.collapse_ws(F.replace(t, F.lit(" "), F.lit(" \t\u3000"))))]:
    QUERIES[_name] = (lambda fn: lambda spark, sf: _line_map(spark, sf, fn))(_fn)


@query("drop_stopwords")
def q_drop_stopwords(spark, sf):
    ln = lines(spark, sf)
    stop = vb.top_tokens(vb.token_counts(ln, "word"), STOP_K)
    t = tx.drop_stopwords(tx.word_tokens("text"), stop)
    return normalize(ln.select("doc_id", "line_no", F.size(t).alias("n_tokens"),
                               tx.join_tokens(t).alias("tokens")))


@query("clean_words")
def q_clean_words(spark, sf):
    ln = lines(spark, sf)
    masked = ln.select("doc_id", "line_no",
                       tx.fix_typos(tx.collapse_stars(tx.mask_alnum("text"))).alias("text"))
    stop = vb.top_tokens(vb.token_counts(masked, "word"), STOP_K)
    return normalize(ln.select("doc_id", "line_no", tx.clean_words("text", stop).alias("text")))


@query("flatten_tokens")
def q_flatten(spark, sf):
    d = documents(spark, sf)
    t = tx.flatten(F.transform(F.split("text", "\n"), lambda l: tx.word_tokens(l)))
    return normalize(d.select("doc_id", F.size(t).alias("n_tokens"),
                              tx.join_tokens(t).alias("tokens")))


@query("remove_none")
def q_remove_none(spark, sf):
    return _line_map(spark, sf, lambda c: tx.join_tokens(
        tx.remove_none(F.transform(F.split(c, " "), lambda x: F.nullif(x, F.lit(""))))))


# ------------------------------------------------------------------ W5, W6, O3, O4, U3

@query("padded_batches")
def q_padded_batches(spark, sf):
    s = _sequences(spark, sf)
    b = rows.padded_batches(s, N_BATCH, "ids")
    return normalize(b.select("batch", "batch_pos", "row_idx", "shard",
                              ids_str("padded").alias("padded")))


@query("iter_batches")
def q_iter_batches(spark, sf):
    s = _sequences(spark, sf)
    return normalize(rows.iter_batches(s, N_BATCH, truncate=True).select("row_idx", "batch"))


@query("head_rows")
def q_head(spark, sf):
    s = _sequences(spark, sf)
    n_dev = prepared(spark, sf, "word").corpus.where(F.col("split") == "dev").count()
    return normalize(rows.head(s, n_dev).select("row_idx", ids_str("ids").alias("ids")))


@query("shuffle_rows")
def q_shuffle(spark, sf):
    s = _sequences(spark, sf)
    return normalize(rows.shuffle(s.select("row_idx"), SEED, 1))


@query("repeat_epochs")
def q_repeat(spark, sf):
    s = _sequences(spark, sf)
    return normalize(rows.repeat_epochs(s.select("row_idx"), 3))


# ------------------------------------------------------------------ B1-B8, A4, O2


NO_LIMIT = 2**31 - 1     # merges of a list that only the stop rule ends; ranks are ints


def _words(spark, sf):
    """The corpus word table (distinct words with symbols), written once per session."""
    key = (spark.sparkContext.applicationId, sf, "words")
    if key not in _CACHE:
        _CACHE[key] = cut_lineage(bpe.word_symbols(lines(spark, sf)))
    return _CACHE[key]


@query("word_symbols")
def q_word_symbols(spark, sf):
    w = _words(spark, sf)
    return normalize(w.select("word", "freq",
                              F.array_join(bpe.symbols_of("w"), " ").alias("symbols")))


@query("pair_stats")
def q_pair_stats(spark, sf):
    return normalize(bpe.pair_stats(_words(spark, sf)))


@query("best_pair")
def q_best_pair(spark, sf):
    top = bpe.best_pairs(bpe.pair_stats(_words(spark, sf)), 10)
    return normalize(top.withColumn("rank", F.row_number().over(
        Window.orderBy(*bpe.pair_order())) - 1))


@query("merge_pair")
def q_merge_pair(spark, sf):
    w = _words(spark, sf)
    b = bpe.best_pairs(bpe.pair_stats(w), 1).first()
    m = bpe.merge_pair(w, b["l"], b["r"])
    return normalize(m.select("word", "freq",
                              F.array_join(bpe.symbols_of("w"), " ").alias("symbols")))


def learned_codes(spark, sf, n=bpe.DEFAULT_MERGES):
    """Codes learned over the corpus, written once per session."""
    key = (spark.sparkContext.applicationId, sf, n)
    if key not in _CODES:
        size = bpe.TAIL_RUN_SYMBOLS if n == NO_LIMIT else bpe.RUN_SYMBOLS
        _CODES[key] = cut_lineage(bpe.learn_bpe(_words(spark, sf), n, run_symbols=size))
    return _CODES[key]


@query("learn_bpe")
def q_learn_bpe(spark, sf):
    return normalize(learned_codes(spark, sf))


@query("stop_rule")
def q_stop_rule(spark, sf):
    """Learning over the corpus without a limit, so only the stop rule ends it."""
    return normalize(learned_codes(spark, sf, NO_LIMIT))


@query("shuffle_batches")
def q_shuffle_batches(spark, sf):
    """Whole batches of dev sequences change places, their rows keep their order."""
    dev, _ = _dev_sequences(spark, sf)
    b = dev.select("row_idx", F.floor(F.col("row_idx") / N_BATCH).cast("long").alias("batch"))
    return normalize(rows.shuffle(b, SEED, 1, key="batch", ties=(F.col("row_idx"),)))


@query("shuffle_buffer")
def q_shuffle_buffer(spark, sf):
    """O4, streamed: batches of train sequences in the order a shuffle buffer lets them go."""
    s = _sequences(spark, sf)
    b = rows.iter_batches(s, N_BATCH, truncate=True).select("batch").distinct()
    return normalize(rows.buffered_shuffle(b, SEED, 1, buffer=SHUFFLE_BUFFER))


@query("text_roundtrips")
def q_text_roundtrips(spark, sf):
    """S4-S6 as text: the vocabulary made from a written counts file, exported and read back."""
    path = _scratch(spark, "text")
    src.write_counts(vb.token_counts(lines(spark, sf), "word"), path + "-counts")
    v = src.vocab_from_counts(src.read_counts(spark, path + "-counts"), vb.MIN_COUNT_PREPARE)
    src.write_vocab(v, path + "-vocab", path + "-vocab-text")
    return normalize(src.read_vocab_text(spark, path + "-vocab-text"))


@query("codes_text_roundtrip")
def q_codes_text(spark, sf):
    """All initial pairs in rank order, written as ``left right`` lines and read back."""
    path = _scratch(spark, "codes-text")
    stats = cut_lineage(bpe.pair_stats(_words(spark, sf)).select("l", "r", "n"))
    ranked = rows.dense_index(stats, bpe.pair_order(), name="rank").select(
        "rank", F.col("l").alias("left"), F.col("r").alias("right"))
    src.write_codes_text(ranked, path)
    return normalize(src.read_codes_text(spark, path))


@query("rank_codes")
def q_rank_codes(spark, sf):
    # all pairs of the corpus by count, then all pairs of its words in reverse order of count
    stats = cut_lineage(bpe.pair_stats(_words(spark, sf)).select("l", "r", "n"))
    n = stats.count()
    one = rows.dense_index(stats, bpe.pair_order(), name="rank")
    two = rows.dense_index(stats, [F.col("n"), F.col("l"), F.col("r")], name="rank")
    codes = one.unionByName(two.withColumn("rank", F.col("rank") + n)).select(
        "rank", F.col("l").alias("left"), F.col("r").alias("right"))
    return normalize(bpe.rank_codes(codes))


@query("symbol_pairs")
def q_symbol_pairs(spark, sf):
    w = _words(spark, sf)
    p = bpe.symbol_pairs(bpe.symbols_of("w"))
    s = F.array_sort(F.transform(p, lambda x: F.concat(x["l"], F.lit("\x1f"), x["r"])))
    return normalize(w.select("word", F.size(p).alias("n_pairs"),
                              F.array_join(s, " ").alias("pairs")))


@query("segment_words")
def q_segment_words(spark, sf):
    w = _words(spark, sf).select("word")
    s = bpe.segment_words(w, learned_codes(spark, sf))
    return normalize(s.select("word", F.array_join("subwords", " ").alias("subwords")))


@query("segment_words_fold")
def q_segment_words_fold(spark, sf):
    w = _words(spark, sf).select("word")
    s = bpe.segment_words_fold(w, learned_codes(spark, sf))
    return normalize(s.select("word", F.array_join("subwords", " ").alias("subwords")))


@query("segment_text")
def q_segment_text(spark, sf):
    return normalize(bpe.segment_text(lines(spark, sf), learned_codes(spark, sf)))


# ------------------------------------------------------------------ pairs: J4-J8, U1, U2, U4, E9, B9, B10


def doc_pairs(spark, sf):
    return pr.doc_pairs(documents(spark, sf), src.read_table(spark, sf, "labels"))


def indexed_pairs(spark, sf):
    return pr.index_rows(doc_pairs(spark, sf))


@query("doc_pairs")
def q_doc_pairs(spark, sf):
    return normalize(doc_pairs(spark, sf))


def _encoded_pairs(spark, sf):
    p = prepared(spark, sf, "word")
    table = vb.add_specials(p.vocab, p.n_vocab)
    return vb.encode_fields(doc_pairs(spark, sf), ["a", "b"], table), p.n_vocab


@query("project_pairs")
def q_project_pairs(spark, sf):
    """Pair columns with the label kept because the frame has one."""
    return normalize(tx.project_with_optional_label(doc_pairs(spark, sf)))


@query("encode_fields")
def q_encode_fields(spark, sf):
    e, _ = _encoded_pairs(spark, sf)
    return normalize(e.select("pair_id", "label", ids_str("a_ids").alias("a_ids"),
                              ids_str("b_ids").alias("b_ids")))


def _split_index(ip):
    return ip.where(F.col("row_idx") % 10 == 0).select("row_idx")


@query("split_by_index")
def q_split_by_index(spark, sf):
    ip = indexed_pairs(spark, sf)
    return normalize(split.split_by_index(ip, _split_index(ip)).select("pair_id", "row_idx",
                                                                       "split"))


@query("replicate_index")
def q_replicate_index(spark, sf):
    ip = indexed_pairs(spark, sf)
    return normalize(split.replicate_index(_split_index(ip), ip.count()))


@query("index_complement")
def q_index_complement(spark, sf):
    ip = indexed_pairs(spark, sf)
    n = ip.count()
    return normalize(rows.index_complement(split.replicate_index(_split_index(ip), n), n))


@query("stack_columns")
def q_stack_columns(spark, sf):
    return normalize(rows.stack_columns(indexed_pairs(spark, sf)))


@query("concat_datasets")
def q_concat_datasets(spark, sf):
    ip = indexed_pairs(spark, sf)
    first = ip.where(F.col("label") >= 0).select("row_idx", "pair_id", "label")
    second = ip.where(F.col("label") < 0).select("row_idx", "pair_id", "label")
    return normalize(rows.concat_datasets(first, second))


@query("zip_columns")
def q_zip_columns(spark, sf):
    ln = lines(spark, sf)
    key = [F.col("doc_id"), F.col("line_no")]
    a = rows.dense_index(ln.where("line_no % 2 = 0"), key).select("row_idx", F.col("text").alias("a"))
    b = rows.dense_index(ln.where("line_no % 2 = 1"), key).select("row_idx", F.col("text").alias("b"))
    lab = pr.index_rows(src.read_table(spark, sf, "labels").select(
        "doc_id", F.col("toxic").alias("label")), "doc_id").drop("doc_id")
    z = pr.zip_columns(a, b, lab)
    # a missing field pastes as empty text; read back, a missing label is -1
    return normalize(z.select("row_idx", F.coalesce("a", F.lit("")).alias("a"),
                              F.coalesce("b", F.lit("")).alias("b"),
                              F.coalesce(F.col("label").cast("long"), F.lit(-1)).alias("label")))


@query("unstack_halves")
def q_unstack_halves(spark, sf):
    ln = rows.dense_index(lines(spark, sf), [F.col("doc_id"), F.col("line_no")])
    return normalize(pr.unstack_halves(ln, ln.count()))


@query("frame_pair")
def q_frame_pair(spark, sf):
    e, v = _encoded_pairs(spark, sf)
    sp = vb.special_ids(v)
    f = pr.frame_pairs(e, CLF_N_CTX, sp[vb.START], sp[vb.DELIMITER], sp[vb.END])
    return normalize(f.select("pair_id", "ord", F.size("ids").alias("len"),
                              ids_str("ids").alias("ids")))


@query("subword_chain")
def q_subword_chain(spark, sf):
    out, _ = sc.subword_chain(indexed_pairs(spark, sf))
    return normalize(out)


@query("char_chain")
def q_char_chain(spark, sf):
    return normalize(sc.char_chain(indexed_pairs(spark, sf)))


# ------------------------------------------------------------------ M1-M9, A5-A10, W7, W8, J9


POS_WEIGHT = clf.POS_WEIGHT
LM_COEF = 0.5          # classifier fine-tuning default
CLF_BATCH = 32         # classifier batch size
LOG_EVERY = 100        # W8 step interval
ADD_K = 1.0


def logits(spark, sf):
    """Two logits per vector: the sums of its even and of its odd entries; y = (label = 1); ``e2``
    is the mean absolute entry."""
    e = src.read_table(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    x = e.select(F.col("vec_id").alias("id"), v.alias("v"),
                 F.when(F.col("label") == 1, 1).otherwise(0).alias("y"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return x.select("id", F.array(total(F.filter("v", lambda e, i: i % 2 == 0)),
                                  total(F.filter("v", lambda e, i: i % 2 == 1))).alias("logits"),
                    "y", (total(F.transform("v", F.abs)) / F.size("v")).alias("e2"))


@query("softmax")
def q_softmax(spark, sf):
    p = scr.softmax("logits")
    return normalize(logits(spark, sf).select("id", p[0].alias("p0"), p[1].alias("p1")))


@query("cross_entropy")
def q_cross_entropy(spark, sf):
    return normalize(logits(spark, sf).select("id", "y", scr.cross_entropy("logits", "y")
                                              .alias("ce")))


def _clf_losses(spark, sf):
    x = logits(spark, sf)
    return x.select("id", "y", scr.weighted_cross_entropy(scr.cross_entropy("logits", "y"),
                                                          "y", POS_WEIGHT).alias("loss"),
                    scr.argmax("logits").alias("pred"))


@query("weighted_cross_entropy")
def q_wce(spark, sf):
    return normalize(_clf_losses(spark, sf).select("id", "y", "loss"))


@query("argmax")
def q_argmax(spark, sf):
    return normalize(logits(spark, sf).select("id", scr.argmax("logits").alias("pred")))


@query("score_distribution_label")
def q_score_label(spark, sf):
    x = logits(spark, sf).select("id", F.least(F.abs("e2") * 5, F.lit(5.0)).alias("score"))
    d = scr.score_distribution_label("score", 6)
    return normalize(x.select("id", "score", *[d[i].alias(f"w{i}") for i in range(6)]))


@query("f1")
def q_f1(spark, sf):
    return normalize(ev.f1(_clf_losses(spark, sf)))


@query("row_weighted_cost")
def q_row_weighted_cost(spark, sf):
    l = rows.dense_index(_clf_losses(spark, sf), [F.col("id")])
    return normalize(ev.row_weighted_cost(l, CLF_BATCH))


def _dev_sequences(spark, sf):
    p = prepared(spark, sf, "word")
    return _split_sequences(spark, sf).where(F.col("split") == "dev").drop("split"), p.n_vocab


def _lm(spark, sf):
    return lm.fit_ngram_lm(_sequences(spark, sf))


def _pos_losses(spark, sf, mask="length"):
    dev, v = _dev_sequences(spark, sf)
    bigrams, totals = _lm(spark, sf)
    return lm.score_ngram_lm(dev, bigrams, totals, v + 3, ADD_K, mask)


def _seq_losses(spark, sf, mask="length"):
    s = ev.masked_seq_loss(_pos_losses(spark, sf, mask))
    return s.withColumnRenamed("seq", "row_idx")


@query("next_token_targets")
def q_next_token_targets(spark, sf):
    return normalize(lm.target_positions(_sequences(spark, sf)))


@query("fit_ngram_lm")
def q_fit_ngram_lm(spark, sf):
    b, t = _lm(spark, sf)
    v = prepared(spark, sf, "word").n_vocab + 3
    return normalize(b.join(t, "prev").select(
        "prev", "next", "c", "t", F.log((F.col("c") + ADD_K) / (F.col("t") + ADD_K * v))
        .alias("logp")))


@query("score_ngram_lm")
def q_score_ngram_lm(spark, sf):
    return normalize(_pos_losses(spark, sf, "length"))


@query("masked_seq_loss")
def q_masked_seq_loss(spark, sf):
    return normalize(_seq_losses(spark, sf, "nonzero"))


@query("perplexity")
def q_perplexity(spark, sf):
    return normalize(ev.perplexity(_seq_losses(spark, sf)))


@query("batch_averaged_metrics")
def q_batch_metrics(spark, sf):
    return normalize(ev.batch_averaged_metrics(_seq_losses(spark, sf), N_BATCH))


@query("objective")
def q_objective(spark, sf):
    return normalize(ev.objective(_clf_losses(spark, sf), _seq_losses(spark, sf), LM_COEF))


@query("every_n_steps")
def q_every_n_steps(spark, sf):
    m = _seq_losses(spark, sf).select(F.col("row_idx").alias("step"),
                                      F.lit("loss").alias("name"), F.col("loss").alias("value"))
    return normalize(ev.every_n_steps(m, LOG_EVERY))


@query("embedding_lookup_sum")
def q_embedding_lookup_sum(spark, sf):
    p = prepared(spark, sf, "char")
    pairs = doc_pairs(spark, sf)
    ra = vb.unk_replace(pairs.select(F.col("pair_id"), F.lit(0).alias("side"),
                                     F.col("a").alias("text"))
                        .unionByName(pairs.select(F.col("pair_id"), F.lit(1).alias("side"),
                                                  F.col("b").alias("text"))),
                        p.vocab, "char", keys=("pair_id", "side"))
    wide = ra.groupBy("pair_id").agg(
        F.max(F.when(F.col("side") == 0, F.col("text"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("text"))).alias("b"))
    table = vb.add_specials(p.vocab, p.n_vocab)
    enc = vb.encode_fields(wide, ["a", "b"], table)
    sp = vb.special_ids(p.n_vocab)
    framed = pr.frame_pairs(enc, CLF_N_CTX, sp[vb.START], sp[vb.DELIMITER], sp[vb.END])
    emb = src.read_table(spark, sf, "embeddings")
    h = lm.embedding_lookup_sum(framed, emb, p.n_vocab, derive={
        "dim": F.size("h"),
        "h_sum": F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x), 4),
        "h_sq": F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x * x), 4)})
    return normalize(h.select("pair_id", "ord", "pos", "id", "pos_id", "dim", "h_sum", "h_sq"))


@query("score_pairs")
def q_score_pairs(spark, sf):
    ip = indexed_pairs(spark, sf)
    sp = split.split_by_index(ip, _split_index(ip))
    model = clf.fit_pair_classifier(sp.where(F.col("split") == "train"))
    scored = clf.score_pairs(model, sp.withColumnRenamed("pair_id", "index"), key="index")
    return normalize(scored.select("index", "split", "label", "pred"))


@query("pair_f1")
def q_pair_f1(spark, sf):
    s = q_score_pairs(spark, sf).where((F.col("split") == "dev") & (F.col("label") >= 0))
    return normalize(ev.f1(s.withColumnRenamed("label", "y")))


CLF_RATE = 1.0      # of the gradient steps in the registered queries


def _train_pairs(spark, sf):
    ip = indexed_pairs(spark, sf)
    return split.split_by_index(ip, _split_index(ip)).where(F.col("split") == "train")


@query("pair_features")
def q_pair_features(spark, sf):
    """M8: terms of every pair that the classifier sees."""
    f = clf.pair_features(doc_pairs(spark, sf))
    return normalize(f.select("pair_id", "label", F.size("_terms").alias("n_terms"),
                              F.array_join(F.array_sort("_terms"), " ").alias("terms")))


@query("pair_gradient")
def q_pair_gradient(spark, sf):
    """M8: gradient of the class-weighted loss of the train pairs at zero weights, per term."""
    train = _train_pairs(spark, sf)
    scored = train.select("pair_id", "label", F.lit(0.0).alias("z"))
    g = clf.gradient(scored, clf.feature_rows(train), clf.POS_WEIGHT)
    return normalize(g.withColumn("g", F.round("g", 6) + F.lit(0.0)))      # no negative zero


@query("pair_loss")
def q_pair_loss(spark, sf):
    """M8: weighted loss of the train pairs before and after a full gradient step."""
    train, out = cut_lineage(_train_pairs(spark, sf).select("pair_id", "a", "b", "label")), None
    lists = clf.term_lists(train)
    for step in (0, 1):
        weights, bias = clf.fit_linear(train, steps=step, rate=CLF_RATE)
        scored = clf.linear_scores(lists.select("pair_id", "label"), clf.term_rows(lists), weights, bias)
        one = clf.weighted_loss(scored) \
            .select(F.lit(step).alias("step"), "n", "loss")
        out = one if out is None else out.unionByName(one)
    return normalize(out)


@query("pair_logits")
def q_pair_logits(spark, sf):
    """M9: logit and predicted label of every pair, train and dev, after a full gradient step."""
    weights, bias = clf.fit_linear(_train_pairs(spark, sf), steps=1, rate=CLF_RATE)
    lists = clf.term_lists(doc_pairs(spark, sf))
    scored = clf.linear_scores(lists.select("pair_id", "label"), clf.term_rows(lists), weights, bias)
    return normalize(scored.select("pair_id", "label", (F.round("z", 6) + F.lit(0.0)).alias("z"),
                                   (F.col("z") > 0).cast("int").alias("pred")))


# ------------------------------------------------------------------ S2-S12 round trips, R1, R2


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@query("pairs_tsv_roundtrip")
def q_pairs_tsv(spark, sf):
    """Labelled pairs written as unquoted TSV and read back (label = last field)."""
    path = _scratch(spark, "pairs")
    src.write_pairs(doc_pairs(spark, sf), path)
    pairs, _ = src.read_pairs(spark, path)
    return normalize(pairs.select("pair_id", "a", "b", "label"))


@query("inference_pairs_roundtrip")
def q_inference_pairs(spark, sf):
    """S3: ``index, A, B`` TSV read with no header and no quoting."""
    path = _scratch(spark, "inference")
    doc_pairs(spark, sf).select(F.concat_ws("\t", F.col("pair_id").cast("string"), "a", "b")
                                .alias("value")).write.text(path)
    return normalize(src.read_inference_pairs(spark, path))


@query("vocab_roundtrip")
def q_vocab_roundtrip(spark, sf):
    """Vocabulary persisted as (id, token) and loaded back."""
    path = _scratch(spark, "vocab")
    src.write_vocab(prepared(spark, sf, "word").vocab, path, path + "-text")
    return normalize(src.read_vocab(spark, path))


@query("counts_roundtrip")
def q_counts_roundtrip(spark, sf):
    """``token count`` lines written and parsed back."""
    path = _scratch(spark, "counts")
    src.write_counts(vb.token_counts(lines(spark, sf), "word"), path)
    return normalize(src.read_counts(spark, path))


@query("codes_roundtrip")
def q_codes_roundtrip(spark, sf):
    """Ranked merge codes persisted and loaded back."""
    path = _scratch(spark, "codes")
    src.write_codes(learned_codes(spark, sf).drop("n"), path)
    return normalize(src.read_codes(spark, path))


@query("split_roundtrip")
def q_split_roundtrip(spark, sf):
    """The prepared corpus written with one folder per split and read back."""
    path = _scratch(spark, "split")
    src.write_split(prepared(spark, sf, "word").corpus, path)
    return normalize(spark.read.parquet(path).select("doc_id", "line_no", "split", "text"))


@query("sequences_roundtrip")
def q_sequences_roundtrip(spark, sf):
    """Sequences written by shard and read back in (shard, row_idx) order."""
    path = _scratch(spark, "sequences")
    src.write_sequences(_sequences(spark, sf), path)
    s = src.read_sequences(spark, path)
    return normalize(s.select("row_idx", "shard", ids_str("ids").alias("ids")))


@query("split_index_roundtrip")
def q_split_index_roundtrip(spark, sf):
    """The dev index (every 10th pair row) as a one-column table."""
    path = _scratch(spark, "index")
    _split_index(indexed_pairs(spark, sf)).write.parquet(path)
    return normalize(src.read_split_index(spark, path))


@query("metrics_roundtrip")
def q_metrics_roundtrip(spark, sf):
    """Per-sequence dev losses appended as JSON metric records (time stamped)."""
    path = _scratch(spark, "metrics")
    m = _seq_losses(spark, sf).select(F.col("row_idx").alias("step"),
                                      F.lit("loss").alias("name"), F.col("loss").alias("value"))
    src.append_metrics(m, path)
    back = src.read_metrics(spark, path)
    return normalize(back.select("step", "name", "value",
                                 F.col("ts").isNotNull().alias("stamped")))


@query("predictions_roundtrip")
def q_predictions_roundtrip(spark, sf):
    """``index \\t label`` predictions (argmax of the logits) written and read back."""
    path = _scratch(spark, "pred")
    src.write_predictions(_clf_losses(spark, sf).select(F.col("id").alias("index"),
                                                        F.col("pred").alias("label")), path)
    back = spark.read.option("sep", "\t").schema("index string, label string").csv(path)
    return normalize(back)


@query("stream_token_counts")
def q_stream_token_counts(spark, sf):
    """Running counts after the stream has consumed every arriving document file."""
    out = _scratch(spark, "stream-counts")
    q = stm.start_token_counts(stm.read_document_stream(spark, sf.rstrip("/") + "/documents*.parquet"),
                               out, f"wm_stream_counts_{uuid.uuid4().hex[:8]}")
    q.awaitTermination()
    return normalize(stm.read_token_counts(spark, out))


@query("stream_encode")
def q_stream_encode(spark, sf):
    """R2: streamed lines segmented with the learned codes, unk-replaced, encoded, framed."""
    ln = lines(spark, sf)
    codes = learned_codes(spark, sf)
    v, n = pp.build_vocab(bpe.segment_text(ln, codes), "word", vb.MIN_COUNT_PREPARE)
    out = _scratch(spark, "stream-encode")
    q = stm.start_stream_encode(stm.read_document_stream(spark, sf.rstrip("/") + "/documents*.parquet"),
                                codes, v, n, out, f"wm_encode_{uuid.uuid4().hex[:8]}", N_CTX)
    q.awaitTermination()
    e = spark.read.parquet(out)
    return normalize(e.select("doc_id", "line_no", ids_str("ids").alias("ids")))
