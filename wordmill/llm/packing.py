"""Packing documents into sequences of a fixed number of tokens by minimum bin slack.

1. One Arrow pass turns every whole text into ids and cuts only texts longer than ``capacity``
   (the first piece takes the rest, all others are full). A row per piece is written: its length
   and its number among the task's pieces of that length.
2. The counts per length (at most ``capacity`` rows, whatever the input) go to the driver. Bin by
   bin, the longest length left is the seed and a subset-sum over the lengths left, a bitset with
   a bit per sum, gives the fullest combination that fits beside it. The combination is removed
   as many times as the counts allow, which is what bin by bin would do again and again, so there
   are a few combinations per length at most.
3. Pieces of a length are numbered by a running total over the tasks' counts (no window over the
   pieces, so a frequent length is no hot key) and read their sequence off the broadcast plan.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm import tokens as tk
from wordmill.llm.common import id_and_text, written

#: Ranks among pieces of one length stay below this.
RANKS = 1 << 48


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths (with how many of each) whose sum comes closest to ``room`` without passing it,
    from ``counts`` available. Bit s of ``reach`` says that sum s can be made; a length that is
    there m times enters in parts of 1, 2, 4, ... Longest lengths first, so that of equally full
    combinations the short lengths are kept for later."""
    reach, steps = 1, []
    full, mask = 1 << room, (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach & full:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            left, part = left - part, part * 2
        if reach & full:
            break
    at, use = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            use[length] = use.get(length, 0) + part
            at -= length * part
    return use


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations ``({length: uses}, times)`` that pack all counted pieces."""
    left = {n: c for n, c in counts.items() if c}
    out = []
    while left:
        seed = max(left)
        left[seed] -= 1
        use = fullest(left, capacity - seed)
        left[seed] += 1
        use[seed] = use.get(seed, 0) + 1
        times = min(left[n] // k for n, k in use.items())
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((use, times))
    return out


class Places(NamedTuple):
    """A row per combination and length in it, ascending by (length, rank): the pieces of that
    length from ``key`` on fill sequences from ``base`` on, ``uses`` in each, from ``offset``."""
    key: np.ndarray
    length: np.ndarray
    base: np.ndarray
    uses: np.ndarray
    offset: np.ndarray


def places(combinations: list[tuple[dict[int, int], int]]) -> Places:
    rows, ranks, base = [], {}, 0
    for use, times in combinations:
        offset = 0
        for n in sorted(use, reverse=True):
            rows.append((n * RANKS + ranks.get(n, 0), n, base, use[n], offset))
            ranks[n] = ranks.get(n, 0) + use[n] * times
            offset += n * use[n]
        base += times
    return Places(*np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def place(p: Places, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    row = np.searchsorted(p.key, length * RANKS + rank, "right") - 1
    nth = length * RANKS + rank - p.key[row]
    return p.base[row] + nth // p.uses[row], p.offset[row] + nth % p.uses[row] * length


def cut(size: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(document, start, length)`` of the pieces of documents of these sizes."""
    n = np.maximum(1, -(-size // capacity))
    doc = np.repeat(np.arange(len(size)), n)
    piece = np.arange(len(doc)) - np.repeat(n.cumsum() - n, n)
    first = (size - (n - 1) * capacity)[doc]
    start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
    return doc, start, np.where(piece == 0, first, capacity)


def encoded_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int,
                   with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, written: ``doc_id, piece, start, length, ids_crc32, part, nth`` (and
    ``ids``, little-endian unsigned 32-bit); nth counts the pieces of that length in task part."""
    docs = id_and_text(docs, id_col, text_col)

    def run(batches):
        from pyspark import TaskContext
        enc, part = tk.batch_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for row, ids, bounds in enc.documents(b.column(1), end_id):
                doc, start, length = cut(np.diff(bounds), capacity)
                raw, at = memoryview(ids.astype("<u4").tobytes()), 4 * (bounds[doc] + start)
                cells = [raw[a:e] for a, e in zip(at.tolist(), (at + 4 * length).tolist())]
                order = np.argsort(length, kind="stable")
                n, new = length[order], np.ones(len(order), bool)
                new[1:] = n[1:] != n[:-1]
                lead = np.flatnonzero(new)
                nth = np.empty(len(order), np.int64)
                nth[order] = (np.arange(len(order))
                              - np.repeat(lead, np.diff(np.append(lead, len(order)))) + seen[n])
                np.add.at(seen, length, 1)
                piece = np.arange(len(doc)) - np.searchsorted(doc, doc)
                cols = [b.column(0).slice(row, len(bounds) - 1).take(pa.array(doc)),
                        pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([zlib.crc32(c) for c in cells], pa.int64()),
                        pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    cols.append(pa.array([bytes(c) for c in cells], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
              + (", ids binary" if with_ids else ""))
    return written(docs.mapInArrow(run, schema), "pieces")[0]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
         with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and
    ``ids``). Sequences are numbered from 0 without gaps; their pieces lie side by side from
    offset 0.

    Null texts count as empty and are the end id alone, a null id stays null, rows that repeat an
    id are packed one by one, other columns are not read, an empty table gives an empty result.
    """
    pieces = encoded_pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col)
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("length").agg(F.sum("n")).collect()      # at most ``capacity`` rows
    p = spark.sparkContext.broadcast(tuple(places(plan({r[0]: r[1] for r in total}, capacity))))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))

    @F.pandas_udf("sequence_id long, offset long")
    def look(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, offset = place(Places(*p.value), length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": seq, "offset": offset})

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return (pieces.join(shift, ["part", "length"])
            .withColumn("at", look("length", F.col("nth") + F.col("shift")))
            .select(*keep, "at.sequence_id", "at.offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: ``sequence_id, ids``
    (binary, unsigned 32-bit), ``doc_ids`` in the order of the pieces. A group is one sequence, so
    it never holds more than ``capacity`` ids."""
    cells = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return (packed.groupBy("sequence_id").agg(cells.alias("c"))
            .select("sequence_id",
                    F.aggregate("c", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
                    F.col("c.doc_id").alias("doc_ids")))
