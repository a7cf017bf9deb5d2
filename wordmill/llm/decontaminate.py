"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

The index holds the test items, never training data; its size is checked before it is broadcast.
Larger test sets are indexed in parts, one after the other, with the statistics of all items.
Every training text is cut into overlapping passages so long that each occurrence of an item lies
within one of them, and every passage is a query:

1. Bounds, for all passages of a batch together: the impacts of their rarer terms are summed per
   item; a passage in which every item's sum, plus all that the commonest terms could add to it,
   stays below the threshold ends here: its WAND search would find nothing.
2. The others run block-max WAND term by term and retrieve every item above the threshold. A
   block is ``BLOCK`` neighbouring items, and a term has its largest impact per block.
3. A retrieved item counts as leaked when its question and its answer both overlap: at least
   0.8 of the five-word shingles of each part occur in the passage.

Impacts are divided by the item's score against itself, so 1 is a full match of any item.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import drop, id_and_text, ship, written
from wordmill.llm.tokens import PieceCache

BLOCK = 8
K1, B = 1.2, 0.75
COMMON_SHARE = 1 / 3      # of the threshold: what the commonest terms may add to any item
MAX_INDEX_BYTES = 256 << 20
INDEX_PER_BYTE = 12       # bytes of index for a byte of test items, at most
NO_WORD, UNKNOWN = -2, -1
HIT = ("item_id long, score double, passage_start long, question_overlap double, "
       "answer_overlap double")


def word(token: str) -> str:
    """A token's letters and digits, lower-case."""
    token = token.lower()
    return token if token.isalnum() else "".join(c for c in token if c.isalnum())


def words(text: str | None) -> tuple[list[str], list[bool]]:
    """Words of a text and whether each ends a sentence."""
    out, ends = [], []
    for t in (text or "").split():
        w = word(t)
        if w:
            out.append(w)
            ends.append(t[-1] in ".!?")
    return out, ends


def answer_start(ends: list[bool], least: int = 5) -> int:
    """Where the answer begins: the shortest run of last sentences with ``least`` words, or the
    last half of an item of one sentence."""
    n = len(ends)
    cuts = [i + 1 for i in range(n - 1) if ends[i]]
    return max((c for c in cuts if n - c >= least), default=n // 2)


@dataclass
class Index:
    """``terms``: word -> number. Postings of a term lie between ``first``: item numbers in
    ascending order and impacts; ``bound`` is the term's largest impact per block, ``common`` marks
    the terms left out of the first bound and ``rest`` what they add at most to each item."""
    item_ids: list[int]
    parts: list[tuple[list[int], list[int]]]
    terms: dict[str, int]
    first: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    bound: list[dict[int, float]]
    common: np.ndarray
    rest: np.ndarray
    longest: int
    threshold: float


@dataclass
class Statistics:
    """Of all items with words: their number, mean and largest number of words, and for each word
    the number of items that hold it."""
    n: int
    mean: float
    longest: int
    df: dict[str, int]


def build_index(rows: list[tuple[int, str]], threshold: float = 0.6,
                known: Statistics | None = None) -> Index:
    """Index of (item id, text) rows. Items without words are left out; items that repeat are
    each kept. The longest item sets the passage length. Rows that are a part of the items come
    with the ``known`` statistics of all, so they score as in one index."""
    terms: dict[str, int] = {}
    texts, ids, parts = [], [], []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or "")):
        w, ends = words(t)
        if w:
            nums = [terms.setdefault(x, len(terms)) for x in w]
            cut = answer_start(ends)
            ids.append(i)
            texts.append(nums)
            parts.append((nums[:cut], nums[cut:]))
    n, df = len(texts), Counter(x for t in texts for x in set(t))
    mean, longest = sum(map(len, texts)) / max(1, n), max(map(len, texts), default=1)
    if known:
        n, mean, longest = known.n, known.mean, known.longest
        df = Counter({i: known.df[x] for x, i in terms.items()})
    posts: list[list[tuple[int, float]]] = [[] for _ in terms]
    for i, t in enumerate(texts):
        raw = {x: math.log(1 + (n - df[x] + .5) / (df[x] + .5)) * f * (K1 + 1)
               / (f + K1 * (1 - B + B * len(t) / mean)) for x, f in Counter(t).items()}
        full = sum(raw.values())
        for x, v in raw.items():
            posts[x].append((i, v / full))
    bound = []
    for p in posts:
        best: dict[int, float] = {}
        for i, v in p:
            best[i // BLOCK] = max(best.get(i // BLOCK, 0.0), v)
        bound.append(best)
    rest = np.zeros(max(1, len(texts)))
    common = np.zeros(len(terms) + 2, bool)
    for x in sorted(range(len(terms)), key=lambda x: -df[x]):
        add = np.zeros_like(rest)
        add[[i for i, _ in posts[x]]] = [v for _, v in posts[x]]
        if (rest + add).max() > threshold * COMMON_SHARE:
            break
        rest += add
        common[x] = True
    flat = [p for ps in posts for p in ps]
    return Index(ids, parts, terms, np.cumsum([0] + [len(p) for p in posts]),
                 np.array([i for i, _ in flat], np.int64), np.array([v for _, v in flat]),
                 bound, common, rest, longest, threshold)


def wand(ix: Index, query: list[int]) -> list[tuple[int, float]]:
    """All items that score at least the threshold for distinct query terms, by block-max WAND:
    the pivot is the first item where the terms' largest impacts reach the threshold; unless
    their maxima in its block do so too, the search skips to the end of the block."""
    lists = [[ix.items[ix.first[t]:ix.first[t + 1]], ix.impacts[ix.first[t]:ix.first[t + 1]],
              ix.bound[t], 0, max(ix.bound[t].values())] for t in query]
    found, limit = [], ix.threshold - 1e-9
    while True:
        lists = [x for x in lists if x[3] < len(x[0])]
        lists.sort(key=lambda x: x[0][x[3]])
        total, pivot = 0.0, -1
        for x in lists:
            total += x[4]
            if total >= limit:
                pivot = int(x[0][x[3]])
                break
        if pivot < 0:
            return found
        block = pivot // BLOCK
        near = [x for x in lists if x[0][x[3]] <= pivot]
        if sum(x[2].get(block, 0.0) for x in near) < limit:
            later = [int(x[0][x[3]]) for x in lists if x[0][x[3]] > pivot]
            target = min([(block + 1) * BLOCK, *later])
        else:
            score = 0.0
            for x in near:
                at = x[3] = int(np.searchsorted(x[0], pivot))
                if at < len(x[0]) and x[0][at] == pivot:
                    score += float(x[1][at])
            if score >= limit:
                found.append((pivot, score))
            target = pivot + 1
        for x in near:
            x[3] = max(x[3], int(np.searchsorted(x[0], target)))


def overlap(part: list[int], passage: list[int], width: int = 5) -> float:
    """Share of a part's distinct shingles that occur in the passage; a part of fewer words is
    one shingle, an empty one overlaps fully."""
    if not part:
        return 1.0
    k = min(width, len(part))
    mine = {tuple(part[i:i + k]) for i in range(len(part) - k + 1)}
    theirs = {tuple(passage[i:i + k]) for i in range(len(passage) - k + 1)}
    return len(mine & theirs) / len(mine)


class Matcher:
    """One worker's search over batches of texts."""

    def __init__(self, ix: Index, least: float = 0.8, per_round: int = 200_000):
        self.ix, self.least, self.per_round = ix, least, per_round
        terms = ix.terms

        def number(token: str) -> int:
            w = word(token)
            return terms.get(w, UNKNOWN) if w else NO_WORD
        self.cache = PieceCache(number)

    def match(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text the leaked items: (item id, score, passage start, overlaps), one row per item
        with its best passage."""
        out: list[list[tuple]] = [[] for _ in texts]
        get, held, size = self.cache.__getitem__, [], 0
        for i, t in enumerate(texts):
            if not t or not self.ix.item_ids:
                continue
            tokens = t.split()
            ids = np.fromiter(map(get, tokens), np.int64, len(tokens))
            self.cache.trim()
            ids = ids[ids != NO_WORD]
            held.append((i, ids))
            size += len(ids)
            if size >= self.per_round:
                self._search(held, out)
                held, size = [], 0
        if held:
            self._search(held, out)
        return out

    def _search(self, held, out) -> None:
        ix, step = self.ix, self.ix.longest
        counts = np.array([max(1, -(-(len(a) - step) // step)) for _, a in held])
        base = np.cumsum(counts) - counts          # number of each text's first passage
        at, ids = [], []
        for (_, a), b, c in zip(held, base, counts):
            p = np.arange(len(a)) // step          # in passages p - 1 and p, as far as they exist
            keep = (a >= 0) & ~ix.common[a]
            p, a = p[keep], a[keep]
            for q in (p - 1, p):
                ok = (q >= 0) & (q < c)
                at.append(b + q[ok])
                ids.append(a[ok])
        at, ids = np.concatenate(at), np.concatenate(ids)
        pairs = np.unique(at * len(ix.terms) + ids)
        at, ids = pairs // len(ix.terms), pairs % len(ix.terms)
        n = ix.first[ids + 1] - ix.first[ids]
        spot = np.repeat(ix.first[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(at, n) * len(ix.rest) + ix.items[spot]
        keys, inverse = np.unique(key, return_inverse=True)
        sums = np.bincount(inverse, ix.impacts[spot], len(keys)) + ix.rest[keys % len(ix.rest)]
        if ix.rest.max() >= ix.threshold:
            live = np.arange(counts.sum())
        else:
            live = np.unique(keys[sums >= ix.threshold - 1e-9] // len(ix.rest))
        best: dict[tuple[int, int], tuple] = {}
        for passage in live.tolist():
            k = int(np.searchsorted(base, passage, side="right")) - 1
            i, a = held[k]
            start = (passage - int(base[k])) * step
            span = a[start:start + 2 * step]
            for item, score in wand(ix, np.unique(span[span >= 0]).tolist()):
                q, ans = (overlap(p, span.tolist()) for p in ix.parts[item])
                if q >= self.least and ans >= self.least:
                    score = round(score, 9)        # sums of equal terms in any order are equal
                    row = (ix.item_ids[item], score, start, q, ans)
                    if (i, item) not in best or best[i, item][1] < score:
                        best[i, item] = row
        for (i, _), row in sorted(best.items()):
            out[i].append(row)


def _items(bench: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """``id, text`` of the items and the bytes of their texts."""
    items = bench.select(bench[id_col].cast("long").alias("id"), bench[text_col].cast("string").alias("text"))
    return items, items.agg(F.sum(F.octet_length("text"))).head()[0] or 0


def _sent(spark, rows, threshold: float, known: Statistics | None = None):
    raw = pickle.dumps(build_index([(r["id"], r["text"]) for r in rows], threshold, known))
    return spark.sparkContext.broadcast(raw)


def load_index(bench: DataFrame, threshold: float = 0.6, id_col: str = "item_id",
               text_col: str = "text"):
    """The broadcast index of all test items, or None if it would exceed ``MAX_INDEX_BYTES``."""
    ship(bench.sparkSession)
    items, total = _items(bench, id_col, text_col)
    return _sent(bench.sparkSession, items.collect(), threshold) if _fits(total) else None


def _fits(text_bytes):
    return text_bytes * INDEX_PER_BYTE <= MAX_INDEX_BYTES


def part_indexes(bench: DataFrame, threshold: float = 0.6, id_col: str = "item_id",
                 text_col: str = "text") -> Iterator:
    """Broadcast indexes that hold all items between them, each within the limit (an item beyond
    it has one to itself). Words are counted over all items by Spark; a part collects the counts
    of its own words. An index is destroyed when the next one is asked for."""
    spark = bench.sparkSession
    ship(spark)
    items, total = _items(bench, id_col, text_col)

    @F.pandas_udf("array<string>")
    def all_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: words(t)[0])

    rows, path = written(items.where("id is not null").withColumn("at", F.monotonically_increasing_id())
                         .withColumn("words", all_words(F.coalesce("text", F.lit("")))), "leak-items")
    rows = rows.where(F.size("words") > 0)
    vocabulary, at = written(rows.select(F.explode(F.array_distinct("words")).alias("word"))
                             .groupBy("word").agg(F.count(F.lit(1)).alias("df")), "leak-words")
    n, mean, longest = rows.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.max(F.size("words"))).head()
    parts, split = 1, True
    while split:
        parts *= 2
        dealt = F.pmod(F.xxhash64("at"), F.lit(parts))
        sizes = rows.groupBy(dealt.alias("part")).agg(F.sum(F.octet_length("text")).alias("bytes"),
                                                      F.count(F.lit(1)).alias("n"))
        split = not sizes.where(~_fits(F.col("bytes")) & (F.col("n") > 1)).isEmpty()
    for part in range(parts):
        mine = rows.where(dealt == part)
        own = mine.select(F.explode("words").alias("word")).distinct()
        df = {r["word"]: r["df"] for r in vocabulary.join(own, "word").collect()}
        if df:
            sent = _sent(spark, mine.select("id", "text").collect(), threshold,
                         Statistics(n, mean, longest, df))
            yield sent
            sent.destroy()
    for p in (path, at):
        drop(spark, p)


def _hits(texts: DataFrame, sent, least: float) -> DataFrame:
    def run(batches):
        m = Matcher(pickle.loads(sent.value), least)
        for b in batches:
            found = m.match(b.column(1).to_pylist())
            ids = b.column(0).to_pylist()
            flat = [(ids[i], *row) for i, rows in enumerate(found) for row in rows]
            cols = list(zip(*flat)) if flat else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds)],
                names=["doc_id", "item_id", "score", "passage_start", "question_overlap",
                       "answer_overlap"])

    return texts.mapInArrow(run, "doc_id long, " + HIT)


def leaks(docs: DataFrame, bench: DataFrame, threshold: float = 0.6, least: float = 0.8,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the columns of ``HIT``, one row per document row and leaked item.

    Null and empty texts and items leak nothing, nor do empty tables; a null id is kept with its
    hits; repeated rows each give theirs. ``passage_start`` counts words. Other columns are not
    read. Test sets beyond one index are searched part by part, each with a scan of the documents;
    the hits are those of one index.
    """
    texts = id_and_text(docs, id_col, text_col)
    sent = load_index(bench, threshold)
    if sent:
        return _hits(texts, sent, least)
    parts = [written(_hits(texts, s, least), "leak-hits")[0] for s in part_indexes(bench, threshold)]
    return reduce(DataFrame.unionByName, parts)


def _clean(sent, least: float):
    """A column function text -> whether nothing of the index is leaked in it."""
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Matcher(pickle.loads(sent.value), least)
        for texts in batches:
            yield pd.Series([not hits for hits in m.match(texts.tolist())], dtype="bool")
    return clean


def drop_leaks(docs: DataFrame, bench: DataFrame, threshold: float = 0.6,
               least: float = 0.8) -> DataFrame:
    """The documents without a leaked item, with all their columns. Beyond one index a part takes
    what the part before left."""
    sent = load_index(bench, threshold)
    if sent:
        return docs.where(_clean(sent, least)(docs["text"]))
    path = None
    for s in part_indexes(bench, threshold):
        before = path
        docs, path = written(docs.where(_clean(s, least)(docs["text"])), "leak-free")
        if before:
            drop(docs.sparkSession, before)
    return docs
