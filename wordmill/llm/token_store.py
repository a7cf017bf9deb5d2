"""Token ids as raw binary files with a keyed index.

A store is a folder of
* ``ids-*.bin``: raw little-endian ids (2 bytes each if the vocabulary fits, else 4), documents
  in ascending key order, every document closed by the end id;
* ``index-*.npz``: for one bucket of keys (by hash) a minimal perfect hash and, at the number it
  gives, the key's fingerprint, payload file, offset and length.

A keyed read is one hash, one index entry and one range of one payload file. Files are written by
Spark tasks through Arrow's filesystems under names no two attempts share; only the files that a
committed task reports are part of the store, so a lost executor or a second attempt leaves at
most unused files.
"""

from __future__ import annotations

import io
import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordmill.llm import tokens as tk
from wordmill.llm.common import id_and_text, open_fs, scratch, task_label, written
from wordmill.llm.mph import MinimalPerfectHash, fingerprint

KEYS_PER_INDEX = 200_000
READ_BYTES = 8 << 20
NULL_KEY = -(2 ** 63)


@dataclass
class TokenStore:
    """``parts``: part, file, n_ids, base (ids before the part). ``index``: bucket, file, n_keys.
    Both are small tables: a row per file."""
    path: str
    width: int
    n_index: int
    parts: DataFrame
    index: DataFrame


def _dtype(width: int) -> str:
    return "<u2" if width == 2 else "<u4"


def _bucket(n_index: int):
    return F.pmod(F.xxhash64("key", "copy"), F.lit(n_index)).cast("int")


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode every whole text and write the store.

    Null texts count as empty (the end id alone). A null id sorts first and is addressed as null.
    Rows that repeat an id are kept, ordered by text hash, and told apart by ``copy`` 0, 1, ...
    An empty table gives a store without files. One shuffle: the range partitioning by id.
    """
    docs = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    path = path or scratch(spark, "token-store")
    width = 2 if max(tk.encoder(tokenizer).n_vocab, end_id + 1) <= 65536 else 4

    def encode(batches):
        enc = tk.batch_encoder(tokenizer)
        fs, root = open_fs(path)
        name, out, at, last, copy = f"ids-{task_label()}.bin", None, 0, object(), 0
        part = int(name.split("-")[1])
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
            copies = []
            for key in b.column(0).to_pylist():
                copy = copy + 1 if key == last else 0
                last = key
                copies.append(copy)
            keys = pc.fill_null(b.column(0), NULL_KEY)
            for row, ids, bounds in enc.documents(b.column(1), end_id):
                out.write(ids.astype(_dtype(width)).tobytes())
                n = len(bounds) - 1
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(row, n), pa.array(copies[row:row + n], pa.int64()),
                     pa.array([part] * n, pa.int32()), pa.array([name] * n),
                     pa.array(at + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64())],
                    names=["key", "copy", "part", "file", "first", "n"])
                at += len(ids)
        if out is not None:
            out.close()

    # rows of one id (or without one) are split by their text, so no id is a hot key
    ordered = (docs.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h")
               .sortWithinPartitions("doc_id", "_h").select("doc_id", "text"))
    entries, _ = written(ordered.mapInArrow(
        encode, "key long, copy long, part int, file string, first long, n long"), "token-entries")
    entries = _copies_across_parts(entries)
    # a row per payload file: as many as the range partitioning has partitions
    parts = entries.groupBy("part", "file").agg(F.sum("n").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts, _ = written(parts.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))),
                       "token-parts")
    n_index = max(1, -(-entries.count() // KEYS_PER_INDEX))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        key, copy = pdf["key"].to_numpy(), pdf["copy"].to_numpy()
        mph = MinimalPerfectHash.build(key, copy)
        at = mph.find(key, copy)
        put = lambda values, kind: _placed(at, values, kind)
        buf = io.BytesIO()
        np.savez(buf, fingerprint=put(fingerprint(key, copy), np.uint32),
                 part=put(pdf["part"].to_numpy(), np.uint32),
                 first=put(pdf["first"].to_numpy(), np.uint64),
                 n=put(pdf["n"].to_numpy(), np.uint64), **mph.arrays())
        fs, root = open_fs(path)
        fs.create_dir(root, recursive=True)
        name = f"index-{int(pdf['bucket'].iloc[0]):06d}-{task_label()}.npz"
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(buf.getvalue())
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "file": [name],
                             "n_keys": [len(pdf)]})

    index, _ = written(entries.withColumn("bucket", _bucket(n_index)).groupBy("bucket")
                       .applyInPandas(build, "bucket int, file string, n_keys long"), "token-index")
    return TokenStore(path, width, n_index, parts, index)


def _copies_across_parts(entries: DataFrame) -> DataFrame:
    """Copies of an id are counted per part; where an id goes on in the next part, the copies before
    are added. Only the first id of a part can go on, so the tables here have a row per part."""
    first = entries.groupBy("part").agg(F.min("key").alias("key"))
    per = (entries.join(F.broadcast(first.select("key").distinct()), "key")
           .groupBy("key", "part").agg(F.count(F.lit(1)).alias("n_here")))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.select("key", "part", F.sum("n_here").over(before).alias("shift")).where("shift > 0")
    return entries.join(F.broadcast(shift), ["key", "part"], "left").withColumn(
        "copy", F.col("copy") + F.coalesce("shift", F.lit(0))).drop("shift")


def _placed(at, values, kind):
    out = np.zeros(len(values), kind)
    out[at] = values.astype(kind)
    return out


def _read_index(fs, name: str):
    with fs.open_input_file(name) as f:
        a = dict(np.load(io.BytesIO(f.read())))
    return MinimalPerfectHash.of(a), a


def locate(store: TokenStore, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Index entries of the given keys: ``key, copy, part, first, n``; keys that are not in the
    store are left out (their fingerprint differs). A key given k times finds its copies 0..k-1."""
    keys = keys.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_KEY)).alias("key"))
    keys = keys.withColumn("copy", (F.row_number().over(
        Window.partitionBy("key").orderBy("key")) - 1).cast("long"))
    path = store.path

    def look(key, rows: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
        cols = ["key", "copy", "part", "first", "n"]
        if not len(rows) or not len(files):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})
        fs, root = open_fs(path)
        mph, a = _read_index(fs, f"{root}/{files['file'].iloc[0]}")
        k, c = rows["key"].to_numpy(), rows["copy"].to_numpy()
        at = mph.find(k, c)
        ok = (at >= 0) & (a["fingerprint"][at] == fingerprint(k, c))
        at = at[ok]
        return pd.DataFrame({"key": k[ok], "copy": c[ok], "part": a["part"][at].astype(np.int64),
                             "first": a["first"][at].astype(np.int64),
                             "n": a["n"][at].astype(np.int64)})

    return (keys.withColumn("bucket", _bucket(store.n_index)).groupBy("bucket")
            .cogroup(store.index.groupBy("bucket"))
            .applyInPandas(look, "key long, copy long, part long, first long, n long"))


def read(store: TokenStore, found: DataFrame) -> DataFrame:
    """Payloads of located keys: ``key, copy, start, n, ids`` (binary, little-endian unsigned
    32-bit). Neighbouring ranges of a file are read together, up to ``READ_BYTES`` at a time."""
    path, width = store.path, store.width

    def fetch(batches):
        fs, root = open_fs(path)
        for b in batches:
            rows = b.to_pandas().sort_values(["file", "first"], kind="stable")
            for name, g in rows.groupby("file", sort=False):
                with fs.open_input_file(f"{root}/{name}") as f:
                    yield from _ranges(f, g, width)

    # narrow rows only: spread by payload file and position, a file is read by several tasks
    step = READ_BYTES * 8 // width
    return (found.join(F.broadcast(store.parts.select(F.col("part").cast("long").alias("part"),
                                                      "file", "base")), "part")
            .withColumn("start", F.col("base") + F.col("first"))
            .repartition("file", F.floor(F.col("first") / step))
            .sortWithinPartitions("file", "first")
            .select("key", "copy", "file", "first", "start", "n")
            .mapInArrow(fetch, "key long, copy long, start long, n long, ids binary"))


def _ranges(f, g: pd.DataFrame, width: int):
    first, n = g["first"].to_numpy(), g["n"].to_numpy()
    i = 0
    while i < len(g):
        j, end = i + 1, first[i] + n[i]
        while (j < len(g) and first[j] <= end
               and (max(end, first[j] + n[j]) - first[i]) * width <= READ_BYTES):
            end = max(end, first[j] + n[j])
            j += 1
        raw = np.frombuffer(f.read_at(int((end - first[i]) * width), int(first[i] * width)),
                            dtype=_dtype(width))
        ids = [raw[a - first[i]:a - first[i] + m].astype("<u4").tobytes()
               for a, m in zip(first[i:j], n[i:j])]
        part = g.iloc[i:j]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part["key"]), pa.array(part["copy"]), pa.array(part["start"]),
             pa.array(part["n"]), pa.array(ids, pa.binary())],
            names=["key", "copy", "start", "n", "ids"])
        i = j


class Reader:
    """Keyed access without Spark jobs: the store's file tables (a row per payload or index file)
    are read once, index files when they are first asked for, the last ``open_indexes`` stay."""

    def __init__(self, store: TokenStore, open_indexes: int = 64):
        self.store, self.open_indexes = store, open_indexes
        self.files = {r["bucket"]: r["file"] for r in store.index.collect()}
        self.parts = {r["part"]: r["file"] for r in store.parts.collect()}
        self.fs, self.root = open_fs(store.path)
        self._open: dict[int, tuple] = {}

    def _index(self, bucket: int):
        if bucket not in self._open:
            while len(self._open) >= self.open_indexes:
                del self._open[next(iter(self._open))]
            self._open[bucket] = _read_index(self.fs, f"{self.root}/{self.files[bucket]}")
        return self._open[bucket]

    def get(self, key: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of one document, in constant time: one index entry, one range of one file."""
        key = NULL_KEY if key is None else key
        bucket = bucket_of(key, copy, self.store.n_index)
        if bucket not in self.files:
            return None
        mph, a = self._index(bucket)
        k, c = np.array([key], np.int64), np.array([copy], np.int64)
        at = int(mph.find(k, c)[0])
        if at < 0 or a["fingerprint"][at] != fingerprint(k, c)[0]:
            return None
        width = self.store.width
        with self.fs.open_input_file(f"{self.root}/{self.parts[int(a['part'][at])]}") as f:
            raw = f.read_at(int(a["n"][at]) * width, int(a["first"][at]) * width)
        return np.frombuffer(raw, dtype=_dtype(width)).astype(np.uint32)


def bucket_of(key: int, copy: int, n_index: int) -> int:
    """``_bucket`` of one key on the driver: Spark's xxhash64 of two longs (seed 42, chained)."""
    h = 42
    for value in (key, copy):
        h = xxhash.xxh64_intdigest(struct.pack("<q", value), seed=h)
    return (h - (1 << 64) if h >> 63 else h) % n_index


def get(store: TokenStore, key: int | None, copy: int = 0) -> np.ndarray | None:
    """The ids of one document. For many single keys keep a ``Reader``."""
    return Reader(store).get(key, copy)


__all__ = ["TokenStore", "Reader", "write_store", "locate", "read", "get"]
