"""SimHash near-duplicate groups with a Gray-order hierarchical index.

* Fingerprints: one narrow scan (words, shingles, XXH64, majority per bit).
* Equal fingerprints are one code; only distinct codes are compared.
* Two codes that differ in at most 3 bits agree on one of four 16-bit blocks. Codes are dealt by
  (block, its value); many values share a task, which builds one Gray-order index over its codes
  and walks it with the block's bits held equal. A task returns a spanning forest of the links it
  finds, never all pairs of a group.
* A block value with more codes than a task should take is dealt again by a second block among
  the other 48 bits; what is still too large is cut into chunks that are compared pair by pair.
  Every link is found at any size; nothing is capped.
* Components of the forest's links give the groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm import hamming
from wordmill.llm.common import free_name, id_and_text, ship, written
from wordmill.llm.components import components, join_by_weight

_LOW = np.uint64(0x0101010101010101)
PER_SUM = 255          # bytes of a packed count never overflow
AT_A_TIME = 1 << 18    # shingles hashed before their bits are summed: bounds memory on long texts


def _add_bits(total: np.ndarray, hashes: np.ndarray) -> None:
    at = np.arange(0, len(hashes), PER_SUM)
    for s in range(8):
        x = np.add.reduceat((hashes >> np.uint64(s)) & _LOW, at)
        total[s::8] += x.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text, unsigned: lower-case A-Z, words between ASCII white space, shingles of
    ``width`` words with repeats; fewer words make one shingle, none give 0."""
    from xxhash import xxh64_intdigest as h
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1:]
    total = np.zeros(64, np.int64)
    for s in range(0, n, AT_A_TIME):
        part = zip(starts[s:s + AT_A_TIME].tolist(), ends[s:s + AT_A_TIME].tolist())
        _add_bits(total, np.array([h(line[i:j], seed) for i, j in part], np.uint64))
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints_with(docs: DataFrame, key: str, width: int) -> DataFrame:
    """``doc_id, key, fp`` with a long column of the input carried along."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "key", "fp"])
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col(key).alias("key"),
                       docs["text"].cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, key long, fp long")


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), one row per input row."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "fp"])
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _mask(offset: int, bits: int) -> int:
    return ((1 << bits) - 1) << offset


def _blocks(limit: int):
    """Bit masks of limit + 1 blocks that together are the 64 bits."""
    cuts = [64 * i // (limit + 1) for i in range(limit + 2)]
    return [_mask(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _second(block: int, limit: int):
    """limit + 1 masks over the bits outside ``block``, each joined with it."""
    rest = [i for i in range(64) if not block >> i & 1]
    cuts = [len(rest) * i // (limit + 1) for i in range(limit + 2)]
    return [block | sum(1 << i for i in rest[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(codes: DataFrame, masks: list[int]) -> DataFrame:
    """A row per code and mask: ``must`` (the mask) and ``value`` (the code's bits on it)."""
    lit = F.array(*[F.lit(_signed(m)) for m in masks])
    return (codes.select("fp", F.explode(lit).alias("must"))
            .withColumn("value", F.col("fp").bitwiseAND(F.col("must"))))


def _forest(fp: np.ndarray, label: np.ndarray):
    """Links from each class's first code to its others."""
    order = np.argsort(label, kind="stable")
    fp, label = fp[order], label[order]
    first = np.concatenate([[True], label[1:] != label[:-1]])
    head = fp[np.flatnonzero(first)[np.cumsum(first) - 1]]
    return head[~first], fp[~first]


def links(codes: DataFrame, limit: int = 3, per_task: int = 20_000) -> DataFrame:
    """``a, b``: links between distinct codes (column ``fp``) at ``limit`` differing bits or
    fewer, enough of them to connect all that such links connect."""
    n = codes.count()

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy()
        must = int(pdf["must"].iloc[0]) % (1 << 64)
        a, b = _forest(fp, hamming.classes(fp.view(np.uint64), limit, must))
        return pd.DataFrame({"a": a, "b": b})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.loc[pdf["side"] == 0, "fp"].to_numpy()
        right = pdf.loc[pdf["side"] == 1, "fp"].to_numpy()
        if pdf["one"].iloc[0] == pdf["two"].iloc[0]:
            a, b = _forest(left, hamming.classes(left.view(np.uint64), limit))
        else:
            i, j = hamming.links_between(left.view(np.uint64), right.view(np.uint64), limit)
            a, b = left[i], right[j]
        return pd.DataFrame({"a": a, "b": b})

    def split(dealt: DataFrame):
        """Rows of values that fit a task, and rows of those that don't (with their count w)."""
        sizes = dealt.groupBy("must", "value").agg(F.count(F.lit(1)).alias("w"))
        large = sizes.where(F.col("w") > per_task)
        return (dealt.join(large, ["must", "value"], "left_anti"),
                dealt.join(large, ["must", "value"]))

    def grouped(rows: DataFrame, total: int) -> DataFrame:
        groups = max(1, -(-total // per_task))
        return (rows.withColumn("g", F.pmod(F.xxhash64("value"), F.lit(groups)))
                .groupBy("must", "g").applyInPandas(inside, "a long, b long"))

    first = _blocks(limit)
    fits, large = split(_deal(codes, first))
    # values too large for one task: a second block among the other bits
    pairs = [(_signed(m), F.array(*[F.lit(_signed(s)) for s in _second(m, limit)])) for m in first]
    second = F.coalesce(*[F.when(F.col("must") == m, s) for m, s in pairs])
    deeper = (large.withColumn("must", F.explode(second))
              .withColumn("value", F.col("fp").bitwiseAND(F.col("must")))
              .select("fp", "must", "value"))
    fits2, large2 = split(deeper)
    # still too large: chunks of ``per_task`` codes, each compared with itself and each later one
    chunks = F.ceil(F.col("w") / per_task)
    cut = (large2.withColumn("k", chunks).withColumn("c", F.pmod(F.xxhash64("fp", "must"), "k"))
           .withColumn("other", F.explode(F.expr("sequence(0L, k - 1)"))))
    sides = cut.select("fp", "must", "value", F.least("c", "other").alias("one"),
                       F.greatest("c", "other").alias("two"),
                       F.when(F.col("c") <= F.col("other"), 0).otherwise(1).alias("side"))
    return (grouped(fits, n).union(grouped(fits2, n))
            .union(sides.groupBy("must", "value", "one", "two").applyInPandas(across, "a long, b long")))


def groups(docs: DataFrame, width: int = 3, limit: int = 3, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``, one row per input row.

    Documents link when their fingerprints differ in at most ``limit`` bits; component_id is the
    smallest doc_id that chains of links reach. Null and blank texts have fingerprint 0 and link
    like any others; a null doc_id never is a component_id unless no other id is in the group;
    repeated rows are all returned. An empty table gives an empty result.
    """
    rows, _ = written(fingerprints(docs, width, id_col, text_col), "simhash")
    return (join_by_weight(rows, _classes(rows, limit), "fp", "w", max(1, rows.count()))
            .select("doc_id", "fp", "component_id"))


def _classes(rows: DataFrame, limit: int) -> DataFrame:
    """Per distinct code of ``rows``: ``fp, root, component_id, w`` (rows with it), ``one``."""
    codes, _ = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"),
                                              F.count(F.lit(1)).alias("w")), "codes")
    found, _ = written(links(codes.select("fp"), limit), "simhash-links")
    roots, _ = written(components(found).select(F.col("node").alias("fp"), "root"), "roots")
    linked = codes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"),
                                       F.count(F.lit(1)).alias("codes"))
    named = join_by_weight(linked, least, "root", "codes", max(1, codes.count()))
    return written(named.select("fp", "root", "component_id", "w", F.lit(1).alias("one")),
                   "named")[0]


def keep_one(docs: DataFrame, width: int = 3, limit: int = 3) -> DataFrame:
    """``docs`` (all its columns) with one row of each group: the smallest doc_id, any null id
    last; of rows alike in id and text exactly one. Rows are found again by a hash of id and
    text; its keys are as good as distinct, so no group of copies meets in one task."""
    key, nth = free_name(docs, "_key"), free_name(docs, "_nth")
    marked = docs.withColumn(key, F.xxhash64(docs["doc_id"].cast("long"), docs["text"]))
    ids, _ = written(_fingerprints_with(marked, key, width), "simhash-keys")
    named = _classes(ids.select("doc_id", "fp"), limit)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    heads = (join_by_weight(ids.groupBy("fp").agg(least.alias("m")), named, "fp", "one",
                            max(1, named.count()))
             .groupBy("component_id", "root").agg(F.min("m").alias("m"))
             .select(F.col("m.key").alias(key)))
    kept = marked.join(heads, key, "left_semi")
    first = Window.partitionBy(key).orderBy(key)
    return kept.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(key, nth)


def hex_fingerprint(fp):
    """16 lower-case hexadecimal digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
