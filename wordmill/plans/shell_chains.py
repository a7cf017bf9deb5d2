"""The two shell chains that turn a labelled pair file into a pair table with unk-replaced
text (B9 subword, B10 char), as one Spark plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.operators import bpe, pairs as pr, rows, vocab as vb
from wordmill.session import cut_lineage

KEYS = ("side", "row_idx")


def _stacked(indexed_pairs: DataFrame) -> tuple[DataFrame, int]:
    """U1 over indexed pairs: all A rows, then all B rows, numbered 0..2N-1."""
    st = rows.stack_columns(indexed_pairs)
    n_pairs = indexed_pairs.count()
    st = st.withColumn("corpus_idx", F.col("side") * F.lit(n_pairs) + F.col("row_idx"))
    return st, 2 * n_pairs


def _finish(replaced: DataFrame, stacked: DataFrame, n_rows: int,
            labels: DataFrame) -> DataFrame:
    corpus = replaced.join(stacked.select(*KEYS, "corpus_idx"), list(KEYS)) \
        .select(F.col("corpus_idx").alias("row_idx"), "text")
    halves = pr.unstack_halves(corpus, n_rows)
    return pr.zip_columns(halves, labels.select("row_idx", "label"))


def subword_chain(indexed_pairs: DataFrame, n_merges: int = bpe.SCRIPT_MERGES,
                  min_freq: int = vb.MIN_COUNT_SHELL) -> tuple[DataFrame, DataFrame]:
    """Stack -> learn BPE -> segment -> count -> min count -> vocabulary -> unk ->
    halves -> paste labels. Returns (pairs table, codes)."""
    stacked, n_rows = _stacked(indexed_pairs)
    stacked = cut_lineage(stacked)
    codes = bpe.learn_bpe(bpe.word_symbols(stacked), n_merges)
    seg = cut_lineage(bpe.segment_text(stacked, codes, keys=KEYS))
    counts = vb.token_counts(seg, "word", keys=KEYS)
    v = cut_lineage(vb.assign_vocab_ids(counts, min_freq))
    replaced = vb.unk_replace(seg, v, "word", keys=KEYS)
    return _finish(replaced, stacked, n_rows, indexed_pairs), codes


def char_chain(indexed_pairs: DataFrame,
               min_freq: int = vb.MIN_COUNT_SHELL) -> DataFrame:
    """Stack -> char counts -> min count -> vocabulary -> char unk -> halves -> paste."""
    stacked, n_rows = _stacked(indexed_pairs)
    stacked = cut_lineage(stacked)
    counts = vb.token_counts(stacked, "char", keys=KEYS)
    v = cut_lineage(vb.assign_vocab_ids(counts, min_freq))
    replaced = vb.unk_replace(stacked, v, "char", keys=KEYS)
    return _finish(replaced, stacked, n_rows, indexed_pairs)
