"""Composite plans: corpus preparation (E12) and sequence preparation.

E12 is one lazy plan with one barrier, the vocabulary: it is materialised to the reliable
checkpoint folder (it is re-used by the unk pass and by encoding) and its row count V is the
only scalar brought to the driver, with the line count for the dev rate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.functions import frames as fr
from wordmill.operators import rows, split, vocab as vb
from wordmill.session import cut_lineage


@dataclass
class Prepared:
    vocab: DataFrame          # (id int, token string), 0 = UNK
    n_vocab: int              # V: vocabulary rows including UNK
    rate: float               # dev rate used
    corpus: DataFrame         # (doc_id, line_no, split, text) unk-replaced


def build_vocab(lines: DataFrame, mode: str = "word", min_freq: int = vb.MIN_COUNT_PREPARE,
                materialize: bool = True, with_line_count: bool = False):
    """A1 -> A3 -> W1; returns the vocabulary and V (rows including UNK), and with
    ``with_line_count`` also the number of lines, counted in the same pass.

    Only the kept tokens (freq >= min_freq) are written to the checkpoint folder; their count
    is V - 1.
    """
    counts = vb.token_counts(lines, mode, line_sentinel=with_line_count)
    if with_line_count:     # one filter: a union would count the corpus a second time
        kept = counts.where(vb.can_enter(min_freq) | (F.col("token") == vb.LINE_SENTINEL))
    else:
        kept = vb.kept_tokens(counts, min_freq)
    if materialize:
        kept = cut_lineage(kept)
    n_lines = None
    if with_line_count:
        row = kept.where(F.col("token") == vb.LINE_SENTINEL).select("freq").first()
        n_lines = row["freq"] if row else 0
        kept = kept.where(F.col("token") != vb.LINE_SENTINEL)
    n_kept = kept.count()
    v = vb.assign_vocab_ids(kept, min_freq)
    if materialize:
        v = cut_lineage(v)
    if with_line_count:
        return v, n_kept + 1, n_lines
    return v, n_kept + 1


def prepare_corpus(lines: DataFrame, mode: str = "word", min_freq: int = vb.MIN_COUNT_PREPARE,
                   seed: int = split.DEFAULT_SEED, materialize: bool = True) -> Prepared:
    """Vocabulary, dev rate, unk replacement and the train/dev split of every line.

    Two passes over the corpus: counting (which also counts the lines for the dev rate) and
    replacing. With ``materialize`` the split corpus is written once to the checkpoint folder:
    train encoding, dev encoding and the language model all read it, so the corpus is
    tokenised and looked up once.
    """
    v, n_vocab, n_lines = build_vocab(lines, mode, min_freq, materialize, with_line_count=True)
    rate = split.dev_rate(n_lines)
    replaced = vb.unk_replace(lines, v, mode)
    corpus = split.random_split(replaced, rate, seed).select("doc_id", "line_no", "split", "text")
    if materialize:
        corpus = cut_lineage(corpus)
    return Prepared(v, n_vocab, rate, corpus)


def encode_frame(corpus: DataFrame, v: DataFrame, n_vocab: int, n_ctx: int,
                 keys=("doc_id", "line_no"), carry=()) -> DataFrame:
    """W2 -> J3 -> E4 over unk-replaced lines; returns keys + carry + ``ids`` (framed)."""
    specials = vb.special_ids(n_vocab)
    table = vb.add_specials(v, n_vocab)
    enc = vb.encode(corpus, table, keys=keys, carry=carry)
    return enc.select(*keys, *carry, fr.frame("ids", n_ctx, specials[vb.START],
                                              specials[vb.END]).alias("ids"))


def prepare_sequences(prepared: Prepared, n_ctx: int = 200, n_shards: int = 10,
                      which: str = "train") -> DataFrame:
    """Encode + frame the train lines, number them in file order, round-robin shard.

    Output ``(row_idx, shard, doc_id, line_no, ids)``; S8 writes it partitioned by shard.
    Lines are encoded before they are numbered, so what is shuffled are at most ``n_ctx`` ids a
    line and never text; the ids are written first, because the range sampler of the numbering
    would run the encoding a second time.
    """
    lines = prepared.corpus.where(F.col("split") == which).select("doc_id", "line_no", "text")
    framed = cut_lineage(encode_frame(lines, prepared.vocab, prepared.n_vocab, n_ctx))
    numbered = rows.dense_index(framed, [F.col("doc_id"), F.col("line_no")])
    return rows.round_robin_shard(numbered, n_shards).select(
        "row_idx", "shard", "doc_id", "line_no", "ids")


def prepare_split_sequences(prepared: Prepared, n_ctx: int = 200,
                            n_shards: int = 10) -> DataFrame:
    """E13 for both splits in one pass: one encoding and one numbering of the whole corpus.

    Rows are numbered by (split, doc_id, line_no); ``dev`` sorts before ``train``, so the train
    index is the global one minus the number of dev lines (read from the written corpus).
    ``row_idx`` restarts at 0 in each split, in file order, exactly as numbering each split
    alone. Only framed ids are shuffled, and the numbered sequences are the table that the shard
    writer and the language model read. Output ``(split, row_idx, shard, doc_id, line_no, ids)``.
    """
    c = prepared.corpus.select("doc_id", "line_no", "split", "text")
    n_dev = c.where(F.col("split") == "dev").count()
    framed = cut_lineage(encode_frame(c, prepared.vocab, prepared.n_vocab, n_ctx, carry=("split",)))
    numbered = rows.dense_index(framed, [F.col("split"), F.col("doc_id"), F.col("line_no")],
                                name="_g")
    numbered = numbered.withColumn(
        "row_idx", F.when(F.col("split") == "dev", F.col("_g")).otherwise(F.col("_g") - n_dev))
    return rows.round_robin_shard(numbered, n_shards).select(
        "split", "row_idx", "shard", "doc_id", "line_no", "ids")
