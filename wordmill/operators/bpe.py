"""Byte-pair encoding as Spark jobs.

Data model: the distinct words of a corpus, ``(word, freq, w)``, where ``w`` spells the
current symbols of the word as ``\\x1c s1 \\x1d \\x1c s2 \\x1d ...`` (no spaces). Both marks are
Python whitespace, so they never occur inside a word. With an opening and a closing mark per
symbol, merging a pair is one literal ``replace`` that is left-to-right and non-overlapping and
still catches back-to-back occurrences (``abab``) and runs of one symbol (``aaa`` -> ``aa a``).

Learning (B3) goes in epochs over a word table that stays distributed. An epoch takes the most
frequent pairs as active and cuts every word at its other pairs: those are less frequent than the
threshold, and merging never makes a pair more frequent than the pair it stands on, so down to
that threshold greedy learning can't see across the cuts. What is left are runs of active pairs,
few and short however large the corpus, because the same runs come back in most words. Equal runs
are added up by Spark, one task learns from them merge by merge down to the threshold, and all
its codes are applied to the words in one pass. The tables of an epoch hold symbols as numbers, so pairs
are counted and words cut in numpy, a batch at a time, and a run is merged once per task, however
many words hold it. The number of active pairs follows from the size
of the runs, which is checked before they go to that task (see ``learn_bpe``).

A list of more than ``HEAD_CODES`` merges (it may have as many as there are words) is learned on by
``learn_tail``, where codes and the names of symbols are written tables and the driver holds neither.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordmill.functions import text as tx
from wordmill.operators import vocab as vb
from wordmill.operators.rows import dense_index
from wordmill.session import cut_lineage, literal_rows, release, ship, small_enough

# ---------------------------------------------------------------------------------------------
# Fixed values.
END_OF_WORD = "</w>"        # appended to every word before learning/segmenting
SEPARATOR = "@@"            # suffix of every non-final subword in segmented text
DEFAULT_MERGES = 10000      # merges learned by default
SCRIPT_MERGES = 4000        # merges of the subword shell chain
MIN_PAIR_COUNT = 2          # learning stops when the best pair is seen fewer times
# ---------------------------------------------------------------------------------------------

OPEN, CLOSE = "\x1c", "\x1d"


def delimit(syms: Column) -> Column:
    return F.concat(F.lit(OPEN), F.array_join(syms, CLOSE + OPEN), F.lit(CLOSE))


def symbols_of(w) -> Column:
    w = F.col(w) if isinstance(w, str) else w
    return F.split(F.substring(w, F.lit(2), F.length(w) - 2), CLOSE + OPEN)


def n_symbols(w) -> Column:
    """Number of symbols of a marked word (one opening mark each)."""
    w = F.col(w) if isinstance(w, str) else w
    return F.length(w) - F.length(F.replace(w, F.lit(OPEN), F.lit("")))


def word_symbols(lines: DataFrame) -> DataFrame:
    """B1: distinct words with their frequency, as characters + end-of-word mark."""
    counts = lines.select(F.explode(tx.word_tokens("text")).alias("word")) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    return counts.select("word", "freq", delimit(
        F.concat(tx.chars("word"), F.array(F.lit(END_OF_WORD)))).alias("w"))


def adjacent_pairs(syms: Column) -> Column:
    """Adjacent symbol pairs of an array, in order, overlaps included."""
    n = F.size(syms)
    return F.arrays_zip(F.slice(syms, 1, n - 1).alias("l"), F.slice(syms, 2, n - 1).alias("r"))


def pair_stats(words: DataFrame) -> DataFrame:
    """A4: Σ word frequency over adjacent symbol pairs; ``aaa`` counts (a, a) twice.

    The symbol array is its own projection so it is split once per word, not once per use.
    """
    syms = words.select("freq", symbols_of("w").alias("_s"))
    ex = syms.select("freq", F.explode(adjacent_pairs(F.col("_s"))).alias("p"))
    return ex.groupBy(F.col("p.l").alias("l"), F.col("p.r").alias("r")) \
        .agg(F.sum("freq").cast("long").alias("n"))


def pair_order() -> list:
    """Best first: count descending, then left and right symbol (a fixed tie rule)."""
    return [F.col("n").desc(), F.col("l"), F.col("r")]


def best_pairs(stats: DataFrame, k: int = 1) -> DataFrame:
    """O2: the k most frequent pairs (TakeOrderedAndProject, a top-k report)."""
    return stats.orderBy(*pair_order()).limit(k)


def merge_expr(w: Column, pairs) -> Column:
    """Replace every left-to-right occurrence of each (l, r) by the merged symbol."""
    for l, r in pairs:
        w = F.replace(w, F.lit(OPEN + l + CLOSE + OPEN + r + CLOSE), F.lit(OPEN + l + r + CLOSE))
    return w


def merge_pair(words: DataFrame, left: str, right: str) -> DataFrame:
    """B2: merge one pair in every word that holds it (the others are unchanged)."""
    return words.withColumn("w", merge_expr(F.col("w"), [(left, right)]))


def contexts(words: DataFrame, pairs: list) -> tuple:
    """What merging a candidate touches: ``reach`` (l, r) -> the largest count of a pair that the
    merge makes, and ``over`` {pair: {other pair: count of their overlap}} among the candidates.
    One aggregate over the symbol triples of the words; at most k + k^2 rows come back."""
    spark = words.sparkSession
    names = sorted({(r["l"], r["r"]) for r in pairs})
    syms = words.select("freq", symbols_of("w").alias("_s"))
    n = F.size("_s")
    t = F.explode(F.arrays_zip(F.slice("_s", 1, n - 2).alias("a"), F.slice("_s", 2, n - 2).alias("b"),
                               F.slice("_s", 3, n - 2).alias("c")))
    t = syms.where(n > 2).select("freq", t.alias("t")).groupBy(
        F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.c").alias("c")).agg(
        F.sum("freq").cast("long").alias("n"))
    known = literal_rows(spark, names, "x string, y string").withColumn("ok", F.lit(True))
    ab = F.broadcast(known.select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("ok").alias("ab")))
    bc = F.broadcast(known.select(F.col("x").alias("b"), F.col("y").alias("c"), F.col("ok").alias("bc")))
    t = t.join(ab, ["a", "b"], "left").join(bc, ["b", "c"], "left").where("ab or bc")
    none = F.lit(None).cast("string").alias("c")
    side = F.filter(F.array(
        F.struct(F.col("a").alias("l"), F.col("b").alias("r"), F.col("ab").alias("ok")),
        F.struct(F.col("b").alias("l"), F.col("c").alias("r"), F.col("bc").alias("ok"))),
        lambda x: x["ok"])
    sides = t.select(F.inline(side), "n").groupBy("l", "r").agg(F.max("n").alias("n"))
    rows = (sides.select("l", "r", none, "n")
            .union(t.where("ab and bc").select("a", "b", "c", "n"))).collect()
    reach, over = {}, {}
    for r in rows:
        if r["c"] is None:
            reach[r["l"], r["r"]] = r["n"]
        else:
            one, two = (r["l"], r["r"]), (r["r"], r["c"])
            over.setdefault(one, {})[two] = r["n"]
            over.setdefault(two, {})[one] = r["n"]
    return reach, over


def choose_batch(top: list, produced: set, remaining: int, reach: dict, over: dict,
                 complete: bool = False) -> list:
    """Merges that one-at-a-time greedy would take next, in its order.

    Merging (l, r) changes the count of another pair only where the two overlap, that is where
    the other starts with r or ends with l. Such a pair is set aside: its count is then at most
    what is left after the first overlap is taken off. Pairs that a merge makes are seen at most
    ``reach`` times, whatever is merged after it, and pairs outside ``top`` at most as often as
    its last. The next candidate not set aside is taken while its count is strictly above all
    these. The batch closes after a pair of two equal symbols, or one whose merged string already
    exists as a symbol.
    """
    floor = 0 if complete else top[-1]["n"]
    taken: list = []
    lefts: set = set()
    rights: set = set()
    bound = 0
    aside: dict = {}
    for row in top:
        l, r, n = row["l"], row["r"], row["n"]
        if len(taken) >= remaining or n < MIN_PAIR_COUNT:
            break
        if taken and (l in rights or r in lefts):
            first = next(p for p in taken if p[1] == l or p[0] == r)
            aside[l, r] = n - over.get((first[0], first[1]), {}).get((l, r), 0)
            if l == r:
                break
            continue
        if taken and (n <= bound or n <= floor or any(n <= u for u in aside.values())):
            break
        taken.append((l, r, n))
        lefts.add(l)
        rights.add(r)
        bound = max(bound, reach.get((l, r), 0))
        m = l + r
        close = l == r or m in produced or m == END_OF_WORD
        produced.add(m)
        if close:
            break
    return taken


WORDS_PER_PARTITION = 200_000
RUN_SYMBOLS = 2_000_000     # symbols of all runs that one task learns from
HEAD_CODES = 100_000        # merges that the driver holds; those after them are written tables
TAIL_RUN_SYMBOLS = 4_000_000    # symbols of all runs of an epoch after those (many tasks share them)
GROUP_SYMBOLS = 1_000_000   # symbols of the runs that one of these tasks learns from
TASK_SYMBOLS = 100_000      # what it has of them on average


def _symbol_list(w: str) -> list:
    return w[1:-1].split(CLOSE + OPEN)


FIRST = 0x110000       # numbers of symbols: a character's code point, from here on longer symbols
PAIRS_HELD = 1_000_000     # pairs that a task adds up before it sends them
RUNS_HELD = 200_000        # runs that a task adds up, or remembers merged


class Symbols:
    """Numbers of the symbols of a word table; one string has one number."""

    def __init__(self, names=()):
        self.names: list = []
        self.ids: dict = {}
        for x in (END_OF_WORD, *names):
            self.add(x)

    def add(self, x: str) -> None:
        if len(x) != 1 and x not in self.ids:
            self.ids[x] = FIRST + len(self.names)
            self.names.append(x)

    def number(self, x: str) -> int:
        return ord(x) if len(x) == 1 else self.ids[x]


def _spell(numbers, names: list) -> list:
    return [chr(i) if i < FIRST else names[i - FIRST] for i in numbers]


def _numbered(words: DataFrame, symbols: Symbols) -> DataFrame:
    """``s`` (little-endian numbers of the symbols), ``freq`` of the words with a pair."""
    ids = words.sparkSession.sparkContext.broadcast(symbols.ids)

    def run(batches):
        known = ids.value
        for b in batches:
            rows = [(np.array([ord(x) if len(x) == 1 else known[x] for x in sy], "<i4").tobytes(), n)
                    for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                    if len(sy := _symbol_list(w)) > 1]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()),
                                              pa.array([n for _, n in rows], pa.int64())], ["s", "freq"])
    return words.select("w", F.col("freq").cast("long").alias("freq")).mapInArrow(run, "s binary, freq long")


def _spelled(words: DataFrame, names: list) -> DataFrame:
    """``w, freq`` of a numbered table."""
    sent = words.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        for b in batches:
            w = [OPEN + (CLOSE + OPEN).join(_spell(np.frombuffer(x, "<i4").tolist(), sent.value)) + CLOSE
                 for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), b.column(1)], ["w", "freq"])
    return words.mapInArrow(run, "w string, freq long")


def _columns(b: pa.RecordBatch) -> tuple:
    """Bytes, numbers and lengths of a batch's words, one after the other."""
    raw = b"".join(b.column(0).to_pylist())
    return raw, np.frombuffer(raw, "<i4"), pc.binary_length(b.column(0)).to_numpy() // 4


def _pair_keys(ids, lens) -> tuple:
    """For every symbol the pair that it begins, and whether there is one (not at a word's end)."""
    key = np.zeros(len(ids), np.int64)
    key[:-1] = ids[:-1].astype(np.int64) << 32 | ids[1:]
    ok = np.ones(len(ids), bool)
    ok[np.cumsum(lens) - 1] = False
    return key, ok


def _numbered_stats(words: DataFrame) -> DataFrame:
    """``pair_stats`` of a numbered table: ``key`` (left number, right number), ``n``."""
    def added(held):
        key, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(np.add.reduceat(n[order], at))],
                                          ["key", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            _, ids, lens = _columns(b)
            key, ok = _pair_keys(ids, lens)
            held.append((key[ok], np.repeat(b.column(1).to_numpy(), lens)[ok]))
            size += len(held[-1][0])
            if size > PAIRS_HELD:
                yield added(held)
                held, size = [], 0
        if size:
            yield added(held)
    return words.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").cast("long").alias("n"))


def _named(stats: DataFrame, names: list) -> DataFrame:
    """``l, r, n`` of numbered pairs."""
    sent = stats.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(_spell((key >> 32).tolist(), sent.value), pa.string()),
                 pa.array(_spell((key & 0xFFFFFFFF).tolist(), sent.value), pa.string()), b.column(1)],
                ["l", "r", "n"])
    return stats.mapInArrow(run, "l string, r string, n long")


def _cuts(ids, lens, active) -> tuple:
    """Begins and ends of the runs of active pairs (sorted keys), words one after the other."""
    key, ok = _pair_keys(ids, lens)
    hit = ok & (active[np.minimum(np.searchsorted(active, key), len(active) - 1)] == key)
    return (np.flatnonzero(hit & ~np.r_[False, hit[:-1]]),
            np.flatnonzero(hit & ~np.r_[hit[1:], False]) + 2)


def active_runs(words: DataFrame, active) -> DataFrame:
    """Words cut at every pair that is not in ``active`` (a broadcast array of sorted keys), equal
    runs of two or more symbols added up: ``s, freq``."""
    def added(found):
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()),
                                           pa.array(list(found.values()), pa.int64())], ["s", "freq"])

    def run(batches):
        found: dict = {}
        for b in batches:
            raw, ids, lens = _columns(b)
            begins, ends = _cuts(ids, lens, active.value)
            freq = np.repeat(b.column(1).to_numpy(), lens)[begins].tolist()
            for i, j, n in zip((4 * begins).tolist(), (4 * ends).tolist(), freq):
                x = raw[i:j]
                found[x] = found.get(x, 0) + n
            if len(found) > RUNS_HELD:
                yield added(found)
                found = {}
        if found:
            yield added(found)

    return words.mapInArrow(run, "s binary, freq long").groupBy("s").agg(
        F.sum("freq").cast("long").alias("freq"))


def greedy_merges(runs, floor: int, limit: int, made: set) -> list:
    """One merge at a time from ``(symbols, freq)`` runs: the most frequent pair, ties by (left,
    right), until the best is seen fewer than ``floor`` times or ``limit`` merges are made. Ends
    early after a merge that spells a symbol that exists (in ``made``, which grows): then pairs may
    add up across cuts. Counts are changed by what a merge touches; the heap holds an entry at or
    above every pair's count, corrected when it comes up. A pair's runs are a list, where a run may
    stand twice or have lost the pair: most pairs have few, and a set of them takes several times
    the memory."""
    runs = list(runs)
    count: dict = {}
    where: dict = {}
    for i, (sy, freq) in enumerate(runs):
        for p in zip(sy, sy[1:]):
            count[p] = count.get(p, 0) + freq
            if p in where:
                where[p].append(i)
            else:
                where[p] = [i]
    heap = [(-n, l, r) for (l, r), n in count.items() if n >= floor]
    heapq.heapify(heap)
    out: list = []
    while heap and len(out) < limit:
        n, l, r = heapq.heappop(heap)
        now = count.get((l, r), 0)
        if now != -n:
            if floor <= now < -n:
                heapq.heappush(heap, (-now, l, r))
            continue
        out.append((l, r, now))
        m, new = l + r, set()
        for i in where.pop((l, r)):
            sy, freq = runs[i]
            to, j = [], 0
            while j < len(sy):
                if sy[j] == l and j + 1 < len(sy) and sy[j + 1] == r:
                    to.append(m)
                    j += 2
                else:
                    to.append(sy[j])
                    j += 1
            if len(to) == len(sy):
                continue
            for p in zip(sy, sy[1:]):
                count[p] -= freq
            for p in zip(to, to[1:]):
                count[p] = count.get(p, 0) + freq
                if m in p:      # other pairs were in this run before
                    new.add(p)
                    if p in where:
                        where[p].append(i)
                    else:
                        where[p] = [i]
            runs[i] = (to, freq)
        for p in new:
            if count[p] >= floor:
                heapq.heappush(heap, (-count[p], *p))
        if m in made or m == END_OF_WORD:
            break
        made.add(m)
    return out


def _learn_runs(runs: DataFrame, floor: int, limit: int, made: set, names: list) -> list:
    """``greedy_merges`` in one task over a run table of checked size: its codes, in order."""
    sent = runs.sparkSession.sparkContext.broadcast((names, made))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, made = sent.value
        chars: dict = {}      # a symbol is one string, however many runs hold it
        rows = [([names[i - FIRST] if i >= FIRST else chars.setdefault(i, chr(i))
                  for i in np.frombuffer(x, "<i4").tolist()], int(n))
                for pdf in batches for x, n in zip(pdf["s"], pdf["freq"])]
        codes = greedy_merges(rows, floor, limit, set(made))
        yield pd.DataFrame({"i": range(len(codes)), "l": [c[0] for c in codes],
                            "r": [c[1] for c in codes], "n": [c[2] for c in codes]})

    got = runs.coalesce(1).mapInPandas(run, "i long, l string, r string, n long").collect()
    return [(c["l"], c["r"], c["n"]) for c in sorted(got, key=lambda c: c["i"])]


def apply_merges(words: DataFrame, codes: list, active, symbols: Symbols) -> DataFrame:
    """A numbered table after the given merges, one after the other; a word that became one symbol
    has no pair left and goes. No merge reaches across a pair that is not in ``active`` (as for
    ``active_runs``), so only the runs are merged, each once per task."""
    sent = words.sparkSession.sparkContext.broadcast((
        {(c[0], c[1]): i for i, c in enumerate(codes)},
        {c[0] + c[1]: symbols.number(c[0] + c[1]) for c in codes}, symbols.names))

    def rule():
        ranks, made, names = sent.value

        def merged(x: bytes) -> bytes:
            ids = np.frombuffer(x, "<i4").tolist()
            sy = _spell(ids, names)
            own = dict(zip(sy, ids))
            new = [made[y] if y in made else own[y] for y in _merged(sy, ranks, once=True)]
            return np.array(new, "<i4").tobytes()
        return merged

    return _runs_merged(words, rule, active)


def _runs_merged(words: DataFrame, rule, active) -> DataFrame:
    """The pass of ``apply_merges``; ``rule()`` gives a task the function that merges a run."""
    def run(batches):
        merged = rule()
        known: dict = {}
        for b in batches:
            raw, ids, lens = _columns(b)
            begins, ends = _cuts(ids, lens, active.value)
            if len(known) > RUNS_HELD:
                known.clear()
            parts, at, less = [], 0, []
            for i, j in zip((4 * begins).tolist(), (4 * ends).tolist()):
                x = raw[i:j]
                y = known.get(x)
                if y is None:
                    y = known[x] = merged(x)
                parts += (raw[at:i], y)
                at = j
                less.append((len(x) - len(y)) // 4)
            parts.append(raw[at:])
            left = lens.astype(np.int64)
            np.subtract.at(left, np.searchsorted(np.cumsum(lens), begins, side="right"),
                           np.array(less, np.int64))
            ends_at = np.r_[0, 4 * np.cumsum(left)].astype(np.int32)
            s = pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(ends_at),
                                                               pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([s, b.column(1)], ["s", "freq"]).filter(pa.array(left > 1))

    return words.mapInArrow(run, "s binary, freq long")


def _threshold(stats: DataFrame, k: int, below: int | None) -> tuple[int, int]:
    """(count of the k-th most frequent pair, at least ``below``; pairs with at least that)."""
    floor = stats.orderBy(F.desc("n")).limit(k).agg(F.min("n")).head()[0]
    floor = max(floor, MIN_PAIR_COUNT, below or 0)
    return floor, stats.where(F.col("n") >= floor).count()


def learn_bpe(words: DataFrame, n_merges: int = DEFAULT_MERGES, k: int = 256, batch: bool = True,
              run_symbols: int = RUN_SYMBOLS, log=None, head: int = HEAD_CODES) -> DataFrame:
    """B3 + B4: ranked merge codes ``(rank, left, right, n)``, as one-at-a-time greedy finds them.

    Ties between equally frequent pairs go to the smaller (left, right) (a fixed rule where the
    original falls back to dict order). Stops after ``n_merges`` codes or when the best pair is
    seen fewer than twice.

    An epoch counts all pairs, takes about ``k`` of them as active (k is adapted), and learns from
    their runs down to the least frequent active pair's count. If runs have more than
    ``run_symbols`` symbols, fewer pairs are active. Where even one count's pairs make too many
    runs, the epoch is a pass of ``choose_batch`` over the whole table. Every epoch makes at least
    one merge, so nothing is capped, and the word table of each is written and the one before it
    deleted. ``batch=False`` takes the best pair of a recount each time. After ``head`` merges
    ``learn_tail`` goes on, with as many symbols for its tasks together.
    """
    spark = words.sparkSession
    ship(spark)
    first = words.select("w", "freq").persist()   # deterministic; recomputable
    n_words = first.count()
    # characters and an end mark take three places a symbol and three more; other words, where
    # merges were made before, bring symbols of their own
    end = F.lit(OPEN + END_OF_WORD + CLOSE)
    other = first.where((F.length("w") != 3 * n_symbols("w") + 3) | ~F.endswith("w", end))
    symbols = Symbols(sorted(r["x"] for r in other.select(F.explode(symbols_of("w")).alias("x"))
                             .where(F.char_length("x") != 1).distinct().collect()))
    # partitions sized by the table (each epoch scans it), not by the shuffle setting
    parts = max(spark.sparkContext.defaultParallelism, -(-n_words // WORDS_PER_PARTITION))
    cur = cut_lineage(_numbered(first.repartition(parts), symbols))
    first.unpersist()
    made: set = set()
    codes: list = []
    first_codes = min(n_merges, head) if batch else n_merges
    while len(codes) < first_codes:
        stats = cut_lineage(_numbered_stats(cur))
        best = stats.agg(F.max("n")).head()[0] or 0
        if best < MIN_PAIR_COUNT:
            release(stats)
            break
        if batch:
            taken, active, k = _epoch(cur, stats, best, k, first_codes - len(codes), made,
                                      min(run_symbols, RUN_SYMBOLS), symbols)
        else:
            taken = [tuple(best_pairs(_named(stats.where(F.col("n") == best), symbols.names)).head())]
            active = _sent_pairs(spark, taken, symbols)
        for l, r, _ in taken:
            made.add(m := l + r)
            symbols.add(m)
        codes.extend(taken)
        if log is not None:
            log(f"+{len(taken)} merges (total {len(codes)}), from n={best}, {k} active pairs")
        release(stats)
        if len(codes) >= n_merges:
            break
        nxt = cut_lineage(apply_merges(cur, taken, active, symbols))
        release(cur)
        cur = nxt
    n_codes, names = len(codes), symbols.names
    done = literal_rows(spark, [(i, l, r, int(n)) for i, (l, r, n) in enumerate(codes)],
                        "rank int, left string, right string, n long")
    if not n_codes == first_codes < n_merges:
        release(cur)
        return done
    done = cut_lineage(done)
    del codes, made, symbols        # written now; the driver has little room
    more = learn_tail(cur, names, n_merges - n_codes, run_symbols, log)
    if more is None:
        return done
    return done.union(more.select((F.col("rank") + n_codes).cast("int").alias("rank"), "left", "right", "n"))


def _sent_pairs(spark, pairs: list, symbols: Symbols):
    return spark.sparkContext.broadcast(np.sort(np.array(
        [symbols.number(p[0]) << 32 | symbols.number(p[1]) for p in pairs], np.int64)))


def _epoch(words: DataFrame, stats: DataFrame, best: int, k: int, limit: int, made: set,
           run_symbols: int, symbols: Symbols) -> tuple:
    """The merges of one epoch, the pairs that they stay within, and the number of active pairs to
    try in the next."""
    spark, below = words.sparkSession, None
    while True:
        floor, n_active = _threshold(stats, k, below)
        if n_active <= run_symbols:
            active = spark.sparkContext.broadcast(np.sort(
                stats.where(F.col("n") >= floor).select("key").toArrow().column(0).to_numpy()))
            runs = cut_lineage(active_runs(words, active))
            size = (runs.agg(F.sum(F.octet_length("s"))).head()[0] or 0) // 4
            if size <= run_symbols:
                break
            release(runs)
        else:
            size = 2 * n_active
        if floor >= best:       # the pairs of a single count make too many runs
            least = _threshold(stats, 256, None)[0]
            top = best_pairs(_named(stats.where(F.col("n") >= least), symbols.names), 256).collect()
            taken = choose_batch(top, made, limit, *contexts(_spelled(words, symbols.names), top),
                                 complete=len(top) < 256)
            return taken, _sent_pairs(spark, taken, symbols), k
        below = floor + 1       # ties: fewer active pairs must mean a higher threshold
        k = max(1, int(k * max(0.1, 0.7 * run_symbols / size)))
    taken = _learn_runs(runs, floor, limit, made, symbols.names)
    release(runs)
    if n_active <= 2 * k:       # else ties decide, not k
        k = max(1, min(run_symbols, int(k * min(8, 0.7 * run_symbols / max(1, size)))))
    return taken, active, k


def learn_tail(words: DataFrame, names: list, limit: int, run_symbols: int = TAIL_RUN_SYMBOLS,
               log=None) -> DataFrame | None:
    """The merges after those of a numbered table (which goes), as ``rank, left, right, n``.

    Epochs as in ``learn_bpe``, but their runs are learned from by many tasks: runs that share no
    pair, not even through other runs, don't see each other. Each group of such runs gives its merges
    in greedy order. One-at-a-time greedy over all groups takes the best of their next merges, so its
    order is that of the worst ``(n, left, right)`` which a group has come to, then the group's own.

    A merge that spells an existing symbol ends its epoch, as there: merges after the first of
    these in that order are dropped and found again by the next epoch. The driver holds the active
    pairs and merges of one epoch, as numbers. If runs have more than ``run_symbols`` symbols, or one
    group's more than ``GROUP_SYMBOLS``, fewer pairs are active, but always those of the best count."""
    spark = words.sparkSession
    known = [cut_lineage(literal_rows(spark, [(FIRST + i, x) for i, x in enumerate(names)],
                                      "id int, name string"))]     # written, not kept in a plan
    base, total, pieces, files, share = FIRST + len(names), 0, [], list(known), 2
    while total < limit:
        stats = cut_lineage(_numbered_stats(words))
        best = stats.agg(F.max("n")).head()[0] or 0
        if best < MIN_PAIR_COUNT:
            release(stats)
            break
        symbols = known[0]
        for x in known[1:]:
            symbols = symbols.union(x)
        found, active, most = _tail_epoch(words, stats, symbols, best, share, limit - total, run_symbols)
        share = 4 if 8 * most < GROUP_SYMBOLS else 2
        release(stats)
        files.append(found)
        codes, n_ids = _tail_numbers(found, base)
        codes, again = _until_spelled_again(codes, symbols)
        base += n_ids
        sent = codes.select("id", "a", "b").toArrow()
        n_sent = len(sent)
        total += n_sent
        if log is not None:
            log(f"+{n_sent} merges (tail {total}), from n={best}, {len(active.value)} active pairs, "
                f"{most} symbols in a group")
        pieces.append(codes.select(F.lit(len(pieces)).alias("epoch"), *TAIL_ORDER, "left", "right", "n"))
        known.append(codes.where(~F.col("id").isin(list(again))).select(
            "id", F.concat("left", "right").alias("name")))
        if total < limit:
            merged = _tail_merged(words, sent, again, active)
            del sent        # in the workers now
            pa.default_memory_pool().release_unused()
            nxt = cut_lineage(merged)
            release(words)
            words = nxt
        active.destroy()
    release(words)
    out = None
    if pieces:
        out = pieces[0]
        for x in pieces[1:]:
            out = out.union(x)
        out = dense_index(out, ["epoch", *TAIL_ORDER], name="rank").where(F.col("rank") < limit)
    for x in files:
        release(x)
    return out


#: Order of an epoch's merges: the worst (count, left, right) that the group has come to (best first,
#: so the count is negative), then the merge's place in its group.
TAIL_ORDER = ["wn", "wl", "wr", "i"]


def _tail_epoch(words: DataFrame, stats: DataFrame, symbols: DataFrame, best: int, share: int,
                limit: int, run_symbols: int) -> tuple:
    """The merges of an epoch as each task finds them (written), the active pairs, and the symbols
    that a task had at most. Pairs down to the best count by ``share`` are active, fewer if their
    runs are too many or linked too much."""
    spark = words.sparkSession
    floor, held = best, 0
    for r in stats.where(F.col("n") >= max(MIN_PAIR_COUNT, best // share)).groupBy("n").count() \
            .orderBy(F.desc("n")).collect():
        held += r["count"]
        if 2 * held > run_symbols and r["n"] < best:
            break
        floor = r["n"]
    while True:
        active = spark.sparkContext.broadcast(np.sort(
            stats.where(F.col("n") >= floor).select("key").toArrow().column(0).to_numpy()))
        pa.default_memory_pool().release_unused()
        runs = cut_lineage(active_runs(words, active))
        size = runs.agg(F.sum(F.octet_length("s"))).head()[0] // 4
        if size <= run_symbols or floor >= best:
            parts = max(2 * spark.sparkContext.defaultParallelism, size // TASK_SYMBOLS + 1)
            dealt = cut_lineage(_dealt(runs, parts))
            release(runs)
            most = dealt.groupBy("p").agg(F.sum(F.octet_length("s")).alias("n")).agg(F.max("n")).head()[0] // 4
            if most <= GROUP_SYMBOLS or floor >= best:
                break
            release(dealt)
        else:
            release(runs)
        active.destroy()
        floor = (floor + best + 1) // 2
    found = cut_lineage(_tail_codes(dealt, symbols, parts, floor, limit))
    release(dealt)
    return found, active, most


def _linked(a, b) -> tuple:
    """Nodes of the edges ``a, b`` and for each the smallest node that it is linked with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        x, y = label[u], label[v]
        new = label.copy()
        low = np.minimum(x, y)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _dealt(runs: DataFrame, parts: int) -> DataFrame:
    """Runs with a group ``p`` (0 to ``parts`` - 1): runs that share a pair have the same. A run is
    known by a hash here; two runs of one hash only come into one group. One task gets the links
    between runs, two numbers each; most runs have none."""
    def pairs(batches):
        for b in batches:
            _, ids, lens = _columns(b)
            key, ok = _pair_keys(ids, lens)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[ok]), pa.array(np.repeat(b.column(1).to_numpy(), lens)[ok])], ["key", "node"])

    def link(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if got:
            nodes, label = _linked(*(np.concatenate(x) for x in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "label"])

    runs = runs.withColumn("node", F.xxhash64("s"))
    key = Window.partitionBy("key")
    links = runs.select("s", "node").mapInArrow(pairs, "key long, node long").select(
        F.min("node").over(key).alias("least"), "node").where("least < node").distinct()
    labels = links.repartition(1).mapInArrow(link, "node long, label long")
    return runs.join(labels, "node", "left").select(
        "s", "freq", F.pmod(F.coalesce("label", "node"), F.lit(parts)).cast("int").alias("p"))


def _tail_codes(dealt: DataFrame, symbols: DataFrame, parts: int, floor: int, limit: int) -> DataFrame:
    """``greedy_merges`` of each group. ``a, b`` are the numbers of the two symbols, -1 - i for the
    one that merge ``i`` of the group makes."""
    def used(batches):
        for b in batches:
            p, ids = b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4")
            both = np.repeat(p.astype(np.int64), pc.binary_length(b.column(0)).to_numpy() // 4) << 32 | ids
            both = np.unique(both[ids >= FIRST])
            yield pa.RecordBatch.from_arrays([pa.array((both >> 32).astype(np.int32)),
                                              pa.array((both & 0xFFFFFFFF).astype(np.int32))], ["p", "id"])

    def learn(runs: pa.Table, names: pa.Table) -> pa.Table:
        name = dict(zip(names["id"].to_pylist(), names["name"].to_pylist()))
        number = {x: i for i, x in name.items()}
        chars: dict = {}
        spelled = [([name[i] if i >= FIRST else chars.setdefault(i, chr(i))
                     for i in np.frombuffer(x, "<i4").tolist()], n)
                   for x, n in zip(runs["s"].to_pylist(), runs["freq"].to_pylist())]
        p = runs["p"][0].as_py() if len(runs) else 0
        worst, out = None, []
        for i, (l, r, n) in enumerate(greedy_merges(spelled, floor, limit, set(number))):
            worst = (-n, l, r) if worst is None else max(worst, (-n, l, r))
            a, b = (number[x] if x in number else ord(x) for x in (l, r))
            out.append((p, i, l, r, n, *worst, a, b))
            number.setdefault(l + r, -1 - i)
        return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*out) if out else [()] * 10, kind)],
                        schema=kind)

    kind = pa.schema([("p", pa.int32()), ("i", pa.int32()), ("left", pa.string()), ("right", pa.string()),
                      ("n", pa.int64()), ("wn", pa.int64()), ("wl", pa.string()), ("wr", pa.string()),
                      ("a", pa.int32()), ("b", pa.int32())])
    needed = dealt.select("s", "p").mapInArrow(used, "p int, id int").distinct().join(symbols, "id")
    # a count of partitions that is given is kept, however small they are
    return dealt.repartition(parts, "p").groupBy("p").cogroup(
        needed.select("p", "id", "name").repartition(parts, "p").groupBy("p")).applyInArrow(
        learn, "p int, i int, left string, right string, n long, wn long, wl string, wr string, a int, b int")


def _tail_numbers(found: DataFrame, base: int) -> tuple[DataFrame, int]:
    """An epoch's merges with the number of the symbol that each makes and of its parts; how many
    numbers they take. Numbers grow with the order of a group's merges."""
    at, n = {}, 0
    for r in found.groupBy("p").count().collect():
        at[r["p"]] = n
        n += r["count"]
    begin = F.element_at(F.array(*[F.lit(base + at.get(p, 0)) for p in range(max(at) + 1)]), F.col("p") + 1)
    made = [F.when(F.col(x) < 0, begin - 1 - F.col(x)).otherwise(F.col(x)).cast("int").alias(x)
            for x in ("a", "b")]
    return found.select("left", "right", "n", *TAIL_ORDER, *made,
                        (begin + F.col("i")).cast("int").alias("id")), n


def _until_spelled_again(codes: DataFrame, symbols: DataFrame) -> tuple[DataFrame, dict]:
    """An epoch's merges up to the first that spells a symbol which exists by then, and that merge's
    number with the number of the symbol, if there is one."""
    place = F.struct(*TAIL_ORDER)
    every = codes.select(F.concat("left", "right").alias("name"), "id", place.alias("at")).union(
        symbols.select("name", "id", F.lit(None).alias("at")))
    name = Window.partitionBy("name").orderBy(F.col("at").asc_nulls_first())
    again = every.withColumn("old", F.first("id").over(name)).where("at is not null and id != old") \
        .orderBy("at").limit(1).collect()
    if not again:
        return codes, {}
    end = again[0]["at"]
    last = F.struct(*[F.lit(end[c]).cast(codes.schema[c].dataType).alias(c) for c in TAIL_ORDER])
    return codes.where(place <= last), {again[0]["id"]: again[0]["old"]}


class _SentCodes:
    """An epoch's merges (``id, a, b``): ``get`` gives the rank of a pair of numbers."""

    def __init__(self, codes: pa.Table, again: dict):
        key = codes["a"].to_numpy().astype(np.int64) << 32 | codes["b"].to_numpy()
        order = np.argsort(key)
        self.keys, self.ids, self.again = key[order], codes["id"].to_numpy()[order], again

    def __len__(self) -> int:
        return len(self.keys)

    def get(self, pair: tuple, none: int) -> int:
        key = pair[0] << 32 | pair[1]
        i = int(self.keys.searchsorted(key))
        return int(self.ids[i]) if i < len(self.keys) and self.keys[i] == key else none

    def symbol(self, rank: int) -> int:
        return self.again.get(rank, rank)


def _tail_merged(words: DataFrame, codes: pa.Table, again: dict, active) -> DataFrame:
    """``apply_merges`` of an epoch's merges (``id, a, b``); the tasks sort them, not the driver."""
    sent = words.sparkSession.sparkContext.broadcast(codes)

    def rule():
        ranks = _SentCodes(sent.value, again)
        return lambda x: np.array(_merged(np.frombuffer(x, "<i4").tolist(), ranks, once=True,
                                          symbol=ranks.symbol), "<i4").tobytes()

    return _runs_merged(words, rule, active)


def rank_codes(codes: DataFrame) -> DataFrame:
    """The first occurrence of a duplicated code wins."""
    return codes.groupBy("left", "right").agg(F.min("rank").alias("rank"))


def symbol_pairs(syms) -> Column:
    """Distinct adjacent pairs of a word (first occurrence order)."""
    return F.array_distinct(adjacent_pairs(F.col(syms) if isinstance(syms, str) else syms))


def _merged(sy: list, ranks, once: bool = False, symbol=None) -> list:
    """Apply the lowest-ranked pair present until none is left. The rank of each neighbouring pair
    is kept, so a merge only looks up the pairs it makes. ``once`` takes the ranks as a sequence of
    merges: a pair made by a later merge is not merged any more. ``symbol`` gives the symbol that the
    merge of a rank makes, where it isn't the two strings joined. Ranks are below 2**60."""
    none = len(ranks) + (1 << 60)
    get = ranks.get
    rk = [get(p, none) for p in zip(sy, sy[1:])]
    while rk:
        best = min(rk)
        if best == none:
            break
        i = rk.index(best)
        a, b = sy[i], sy[i + 1]
        while i < len(rk):
            if rk[i] == best and sy[i] == a and sy[i + 1] == b:
                sy[i:i + 2] = [a + b if symbol is None else symbol(best)]
                del rk[i]
                for j in (i - 1, i):
                    if 0 <= j < len(rk):
                        new = get((sy[j], sy[j + 1]), none)
                        rk[j] = none if once and new <= best else new
            i += 1
    return sy


def _greedy(word: str, ranks: dict) -> list:
    """Segment a word with ranked codes; drop the end-of-word mark."""
    sy = _merged(list(word) + [END_OF_WORD], ranks)
    if sy[-1] == END_OF_WORD:
        sy = sy[:-1]
    elif sy[-1].endswith(END_OF_WORD):
        sy[-1] = sy[-1].replace(END_OF_WORD, "")
    return sy


END_CHAR = "\x1c"     # stands for the end mark in the library: white space, so in no word


def _odd_strings(ranks: dict) -> dict:
    """Merged strings, by their first two characters, that are spelled by two codes or stand in a
    code before the one that makes them. Without these a merge only makes pairs of later codes, and
    then it doesn't matter whether the occurrences of a pair are merged at once or in turn."""
    made: dict = {}
    odd = set()
    for (l, r), rank in ranks.items():
        if l + r in made:
            odd.add(l + r)
        made[l + r] = rank
    odd.update(x for p, rank in ranks.items() for x in p if made.get(x, -1) >= rank)
    heads: dict = {}
    for x in odd:
        heads.setdefault(x[:2], []).append(x)
    return heads


def segmenter(ranks: dict):
    """A function from words to their subwords, as ``_greedy`` gives them. The merging is done by
    the tokenizers library; words that hold an odd string (``_odd_strings``) or the marks
    themselves go through ``_greedy``."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    from tokenizers.models import BPE
    as_char = {}        # the codes with the end mark as one character
    for (l, r), rank in ranks.items():
        if r.endswith(END_OF_WORD):
            r = r[:-len(END_OF_WORD)] + END_CHAR
        if END_OF_WORD not in l + r and END_CHAR not in l + r[:-1] and l and r:
            as_char[l, r] = rank
    merges = sorted(as_char, key=as_char.get)
    unknown = "\x1d\x1d"        # no code has it
    parts = [unknown, END_CHAR, *dict.fromkeys(c for l, r in merges for c in l + r),
             *dict.fromkeys(x for l, r in merges for x in (l, r, l + r))]
    vocab = {x: i for i, x in enumerate(dict.fromkeys(parts))}
    library = Tokenizer(BPE(vocab, merges, unk_token=unknown, fuse_unk=False))
    heads = _odd_strings(as_char)

    def plain(w: str) -> bool:
        if END_CHAR in w or END_OF_WORD in w:
            return False
        m = w + END_CHAR
        return not heads or not any(
            m.startswith(x, i) for i in range(len(w)) for x in heads.get(m[i:i + 2], ()))

    def run(words) -> list:
        ok = [plain(w) for w in words]
        done = iter(library.encode_batch([w + END_CHAR for w, o in zip(words, ok) if o],
                                         add_special_tokens=False))
        out = []
        for w, o in zip(words, ok):
            if not o:
                out.append(_greedy(w, ranks))
                continue
            n = len(w)
            out.append([w[a:b] for a, b in next(done).offsets if a < n])
        return out
    return run


SEGMENT_SCHEMA = T.StructType([T.StructField("word", T.StringType()),
                               T.StructField("subwords", T.ArrayType(T.StringType()))])


def _sent_ranks(spark, codes: DataFrame):
    """The ranked code list, one entry per merge, in every worker."""
    ship(spark)
    return spark.sparkContext.broadcast(
        {(r["left"], r["right"]): r["rank"] for r in rank_codes(codes).collect()})


def segment_words(words: DataFrame, codes: DataFrame, word: str = "word") -> DataFrame:
    """Segment each distinct word with the min-rank greedy rule.

    Runs as ``mapInPandas`` over the distinct words (Arrow batches); the ranked code list is
    bounded by the number of merges and is broadcast once.
    """
    bc = _sent_ranks(words.sparkSession, codes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = segmenter(bc.value)
        for pdf in batches:
            yield pd.DataFrame({"word": pdf["word"], "subwords": split(list(pdf["word"]))})

    return words.select(F.col(word).alias("word")).mapInPandas(run, SEGMENT_SCHEMA)


def _own_codes(named: DataFrame, made: DataFrame) -> DataFrame:
    """``word, _c``: the codes whose merged string is part of the word, by rank; one Arrow pass with
    the code list (``part, rank, a, b``) in every worker."""
    ship(named.sparkSession)
    by_part: dict = {}
    for r in made.collect():
        by_part.setdefault(r["part"], []).append((r["rank"], r["a"], r["b"]))
    sent = named.sparkSession.sparkContext.broadcast(by_part)

    def run(batches):
        parts = sent.value
        sizes = sorted({len(x) for x in parts})
        for b in batches:
            a, c, ends = [], [], [0]
            for w in b.column(0).to_pylist():
                t = "" if w is None else w + END_OF_WORD
                found = {t[i:i + n] for n in sizes if n <= len(t) for i in range(len(t) - n + 1)}
                own = sorted(x for p in found & parts.keys() for x in parts[p])
                a += [x[1] for x in own]
                c += [x[2] for x in own]
                ends.append(len(a))
            rows = pa.StructArray.from_arrays([pa.array(a, pa.string()), pa.array(c, pa.string())],
                                              ["a", "b"])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], ["word", "_c"])
    return named.mapInArrow(run, "word string, _c array<struct<a:string,b:string>>")


def _joined_codes(named: DataFrame, made: DataFrame) -> DataFrame:
    """``_own_codes`` for code lists too large for a worker: the word's parts are joined with it."""
    longest = made.agg(F.max(F.char_length("part"))).head()[0] or 0
    named = named.withColumn("_t", F.concat("word", F.lit(END_OF_WORD)))
    at = named.select("word", "_t", F.explode(F.sequence(F.lit(1), F.length("_t"))).alias("i"))
    room = F.least(F.lit(longest), F.length("_t") - F.col("i") + 1)
    parts = at.where(room > 1).select("word", "_t", "i", F.explode(F.sequence(F.lit(2), room)).alias("n")) \
        .select("word", F.substring("_t", F.col("i"), F.col("n")).alias("part"))
    own = parts.join(made, "part").groupBy("word").agg(
        F.array_sort(F.collect_set(F.struct("rank", "a", "b"))).alias("_c"))
    return named.select("word").join(own, "word", "left")


def segment_words_fold(words: DataFrame, codes: DataFrame, word: str = "word") -> DataFrame:
    """B7, native form: fold the codes in rank order with ``replace`` on the marked word.

    Equal to the greedy rule when ``fold_equals_greedy`` holds for the code list. A code can only
    apply to a word that its merged string is part of, so every word first finds its own codes, by
    its parts, in the broadcast code list (a join beyond ``BROADCAST_MAX_BYTES``). The fold is then as
    long as the word has codes, however many there are in all.
    """
    made = rank_codes(codes).select(
        F.concat("left", "right").alias("part"), "rank",
        F.concat(F.lit(OPEN), "left", F.lit(CLOSE + OPEN), "right", F.lit(CLOSE)).alias("a"),
        F.concat(F.lit(OPEN), "left", "right", F.lit(CLOSE)).alias("b"))
    named = words.select(F.col(word).alias("word"))
    own = _own_codes(named, made) if small_enough(made) else _joined_codes(named, made)
    chars = delimit(F.concat(tx.chars("word"), F.array(F.lit(END_OF_WORD))))
    folded = F.aggregate("_c", F.col("_w"), lambda w, c: F.replace(w, c["a"], c["b"]))
    marked = own.select("word", chars.alias("_w"), "_c").select(
        "word", F.coalesce(folded, F.col("_w")).alias("_w"))
    split = marked.select("word", symbols_of("_w").alias("_s"))
    syms = F.col("_s")
    last = F.element_at(syms, -1)
    fixed = F.when(last == END_OF_WORD, F.slice(syms, 1, F.size(syms) - 1)).otherwise(
        F.concat(F.slice(syms, 1, F.size(syms) - 1),
                 F.array(F.replace(last, F.lit(END_OF_WORD), F.lit("")))))
    return split.select("word", fixed.alias("subwords"))


def fold_equals_greedy(pairs: list) -> bool:
    """True when applying the codes in rank order gives the min-rank greedy result: no code has
    an operand that only a code of the same or a later rank produces, and no two codes (or a
    code and the end mark) spell the same string. Then greedy merges codes in increasing rank,
    which is exactly the fold."""
    made: dict = {}
    for i, (l, r) in enumerate(pairs):
        m = l + r
        if m in made or m == END_OF_WORD:
            return False
        made[m] = i
    for i, (l, r) in enumerate(pairs):
        if made.get(l, -1) >= i or made.get(r, -1) >= i:
            return False
    return True


def segmented_form(subwords: Column, sep: str = SEPARATOR) -> Column:
    """Each non-final subword gets the separator; joined by one space."""
    n = F.size(subwords)
    head = F.transform(F.slice(subwords, 1, n - 1), lambda x: F.concat(x, F.lit(sep)))
    return F.array_join(F.concat(head, F.slice(subwords, n, 1)), " ")


WORDS_CACHED = 400_000     # words whose segmentation a worker remembers


def segment_text(lines: DataFrame, codes: DataFrame, sep: str = SEPARATOR,
                 keys=vb.LINE_KEY, carry=()) -> DataFrame:
    """One output line per input line, words segmented and joined by spaces.

    One narrow Arrow pass, no shuffle: a worker segments each word it meets once and remembers
    it, up to ``WORDS_CACHED`` words (then it starts anew; only speed depends on it).
    """
    bc = _sent_ranks(lines.sparkSession, codes)
    cached, end = WORDS_CACHED, sep + " "

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split, known = segmenter(bc.value), {}
        for texts in batches:
            rows = [None if t is None else t.split() for t in texts]
            new = list({w for r in rows if r for w in r if w not in known})
            if len(known) + len(new) > cached:
                known.clear()
                new = list({w for r in rows if r for w in r})
            known.update((w, end.join(sub)) for w, sub in zip(new, split(new)))
            yield pd.Series([None if r is None else " ".join([known[w] for w in r])
                             for r in rows], dtype="object")
    return lines.select(*keys, *carry, run("text").alias("text"))
