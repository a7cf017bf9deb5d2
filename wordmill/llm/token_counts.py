"""Token counts: map-side lookup in two tiers, no shuffle of text or pre-tokens.

Tier 1 is a table of the frequent pieces (pre-tokens with their leading blank) and their token
counts, built from a fixed share of the documents and broadcast in a compact form: one UTF-8
blob and one byte per piece, at most ``table_size`` pieces. Tier 2 is each worker's own bounded
cache of pieces met since. A piece in neither is encoded by the library. The table and the cache
only save time: counts are those of the library for every whole text, whatever they hold.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm import tokens as tk
from wordmill.llm.common import drop, id_and_text, written

OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def frequent_pieces(docs: DataFrame, table_size: int, share: int) -> list[str]:
    """The most frequent pieces of one in ``share`` documents (by hash of the id). Each task
    hands on its own ``2 * table_size`` most frequent at most; the sum of those is ranked."""
    keep = 2 * table_size

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(tk.pieces(t))
                if len(seen) > 20 * keep:
                    seen = Counter(dict(seen.most_common(keep)))
        top = [(p, n) for p, n in seen.most_common(keep) if 0 < len(p) <= 64 and "\0" not in p]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            names=["piece", "n"])

    part = (docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
            .where(F.col("text").isNotNull()).select("text"))
    # written before it is collected: a collected top-k sends every task's k rows to the driver
    top, path = written(part.mapInArrow(count, "piece string, n long").groupBy("piece")
                        .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece")
                        .limit(table_size), "frequent-pieces")
    found = [r["piece"] for r in top.collect()]
    drop(docs.sparkSession, path)
    return found


def _packed(pieces: list[str], counts: list[int]) -> tuple[bytes, bytes]:
    """Pieces and their token counts, one byte each; a piece of more tokens is left out."""
    held = [(p, n) for p, n in zip(pieces, counts) if n <= 255]
    return "\0".join(p for p, _ in held).encode(), bytes(n for _, n in held)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, table_size: int = 50_000,
                 share: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens, over_limit`` (n_tokens > limit).

    One row per input row, repeated rows and null ids included. A null text counts as empty
    (0 bytes, 0 tokens); an empty table gives an empty result; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    top = frequent_pieces(docs, table_size, share)
    enc = tk.encoder(tokenizer)
    counts = [len(enc.piece_ids(p)) if enc.by_piece else 0 for p in top]
    table = spark.sparkContext.broadcast(_packed(top, counts))

    def run(batches):
        enc = tk.encoder(tokenizer)
        blob, lengths = table.value
        pinned = dict(zip(blob.decode().split("\0"), lengths)) if lengths else {}
        cache = tk.PieceCache(lambda p: len(enc.piece_ids(p)), pinned)
        get = cache.__getitem__
        for b in batches:
            text = b.column(1)
            n = []
            for t in text.to_pylist():
                if not t:
                    n.append(0)
                elif enc.whole(t):
                    n.append(len(enc.text_ids(t)))
                else:
                    n.append(sum(map(get, tk.pieces(t))))
                    cache.trim()
            n = pa.array(n, pa.int64())
            size = pc.fill_null(pc.cast(pc.binary_length(text), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), size, n, pc.greater(n, limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, OUT)
