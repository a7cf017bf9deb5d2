"""Token counting, vocabulary ids and token lookups (A1-A3, W1, W2, O1, J1-J4, T8 large form).

Lookups against a vocabulary of measured size are one narrow Arrow pass over the lines: the
table goes to every worker, a line is split, looked up and joined in place, and no text is
shuffled. The table goes as a dict, or where that would be too large as sorted hashes beside the
tokens (``PackedTable``), an eighth of its size. One that is beyond ``BROADCAST_MAX_BYTES`` in that
form too is joined instead: lines are exploded to tokens, joined (AQE splits skewed tokens) and
re-assembled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.functions import text as tx
from wordmill.operators.joins import hot_split_join
from wordmill.operators.rows import dense_index
from wordmill.session import BROADCAST_MAX_BYTES, literal_rows, ship, small_enough

# ---------------------------------------------------------------------------------------------
# Reserved token strings and their order after the vocabulary.
UNK = "UNK"
START = "_start_"
DELIMITER = "_delimiter_"
END = "_end_"
RESERVED = (UNK, START, DELIMITER, END)
# Minimum counts of the original: 20 for pre-training preparation, 10 in the shell chains.
MIN_COUNT_PREPARE = 20
MIN_COUNT_SHELL = 10
# ---------------------------------------------------------------------------------------------

LINE_KEY = ("doc_id", "line_no")
# One per line in a token count when the line count is wanted from the same pass. Lines are
# split on it and it is whitespace, so it is never a real token.
LINE_SENTINEL = "\n"


def count_tokens_col(text, mode: str) -> Column:
    """Tokens that are counted for a vocabulary.

    word: Unicode-whitespace split. char: code points with every whitespace character removed
    (a deliberate departure: whitespace characters never enter a vocabulary).
    """
    if mode == "word":
        return tx.word_tokens(text)
    if mode == "char":
        return F.array_remove(tx.chars(tx.drop_ws(text)), "")
    raise ValueError(f"mode must be 'word' or 'char', not {mode!r}")


def corpus_tokens(lines: DataFrame, mode: str = "word", keys=LINE_KEY,
                  line_sentinel: bool = False) -> DataFrame:
    """Exploded tokens ``(doc_id, line_no, pos, token)``; with ``line_sentinel`` every line
    also yields one ``LINE_SENTINEL`` after its last token."""
    toks = count_tokens_col("text", mode)
    if line_sentinel:
        toks = F.concat(toks, F.array(F.lit(LINE_SENTINEL)))
    return lines.select(*keys, F.posexplode(toks).alias("pos", "token"))


_DOC_SHIFT = "CAST(9223372036854775808 AS DECIMAL(38,0))"    # 2^63: doc ids may be negative
_LINE_SCALE = "CAST(4611686018427387904 AS DECIMAL(38,0))"   # 2^62: room for (line, pos)


def first_seen_key(doc, line, pos) -> Column:
    """(doc, line, pos) packed into one decimal(38,0) that orders like the tuple.

    A fixed-width key keeps ``min`` in a hash aggregate (a struct minimum falls back to a
    sort-based aggregate, which sorts every token of every map task). line and pos are ints.
    """
    inner = (F.col(line).cast("long") * F.lit(2 ** 31) + F.col(pos).cast("long"))
    return ((F.col(doc).cast("decimal(38,0)") + F.expr(_DOC_SHIFT)) * F.expr(_LINE_SCALE)
            + inner.cast("decimal(38,0)"))


def _unpack_first_seen(k: Column) -> list:
    inner = F.pmod(k, F.expr(_LINE_SCALE)).cast("long")
    doc = (((k - inner.cast("decimal(38,0)")) / F.expr(_LINE_SCALE)).cast("decimal(38,0)")
           - F.expr(_DOC_SHIFT)).cast("long")
    return [doc.alias("first_doc_id"),
            F.floor(inner / F.lit(2 ** 31)).cast("long").alias("first_line_no"),
            F.pmod(inner, F.lit(2 ** 31)).cast("int").alias("first_pos")]


def token_counts(lines: DataFrame, mode: str = "word", keys=LINE_KEY,
                 line_sentinel: bool = False) -> DataFrame:
    """A1: frequency per token plus the first position it was seen at.

    The first position is reported as ``first_doc_id, first_line_no, first_pos`` whatever the
    two line-key columns are called (file order = key order). Partial aggregation runs
    map-side in a hash aggregate, so a hot token costs one row per map task in the shuffle,
    not one per occurrence. Characters are added up before they become rows (``_char_counts``).
    """
    if mode == "char":
        ship(lines.sparkSession)
        kind = [lines.schema[k].dataType.simpleString() for k in keys[:2]]
        part = lines.select(*keys[:2], "text").mapInArrow(
            _char_counts(line_sentinel),
            f"token string, _n long, _doc {kind[0]}, _line {kind[1]}, _pos int")
        agg = part.groupBy("token").agg(F.sum("_n").alias("freq"),
                                        F.min(first_seen_key("_doc", "_line", "_pos")).alias("_k"))
    else:
        toks = corpus_tokens(lines, mode, keys, line_sentinel)
        agg = toks.groupBy("token").agg(F.count(F.lit(1)).alias("freq"),
                                        F.min(first_seen_key(keys[0], keys[1], "pos")).alias("_k"))
    return agg.select("token", "freq", *_unpack_first_seen(F.col("_k")))


CHARS_HELD = 200_000      # different characters a task adds up before it hands their counts on


def _char_counts(line_sentinel: bool):
    """Arrow function for ``token_counts`` in char mode: characters added up per task, with their
    first position (none for a character only seen at null keys)."""
    held, sentinel = CHARS_HELD, LINE_SENTINEL

    def run(batches):
        import pyarrow as pa
        count: Counter = Counter()
        first: dict = {}

        def rows(schema):
            at = [first.get(t, (None, None, None)) for t in count]
            cols = [list(count), list(count.values()), *([a[i] for a in at] for i in range(3))]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        schema = None
        for b in batches:
            schema = pa.schema([("token", pa.string()), ("_n", pa.int64()),
                                ("_doc", b.column(0).type), ("_line", b.column(1).type),
                                ("_pos", pa.int32())])
            for doc, line, text in zip(*(c.to_pylist() for c in b.columns)):
                if text is None:
                    continue
                text = "".join(text.split())
                count.update(text)
                at = {t: text.find(t) for t in set(text)}
                if line_sentinel:
                    count[sentinel] += 1
                    at[sentinel] = len(text)
                if doc is not None and line is not None:
                    for t, pos in at.items():
                        was = first.get(t)
                        if was is None or (doc, line, pos) < was:
                            first[t] = (doc, line, pos)
                if len(count) > held:
                    yield rows(schema)
                    count.clear()
                    first.clear()
        if count:
            yield rows(schema)
    return run


def corpus_totals(lines: DataFrame, mode: str = "word", approx: bool = False,
                  rsd: float = 0.01) -> DataFrame:
    """A2: lines, tokens, distinct tokens and characters in one aggregate.

    Characters are T2 tokens (code points of the stripped line other than U+0020). With
    ``approx`` the distinct count is a HyperLogLog++ estimate (no distinct shuffle).
    """
    per_line = lines.select(count_tokens_col("text", mode).alias("_t"),
                            F.size(tx.char_tokens("text")).alias("_c"))
    ex = per_line.select(F.posexplode_outer("_t").alias("_p", "token"), "_c")
    first = F.col("_p").isNull() | (F.col("_p") == 0)
    return ex.agg(F.sum(F.when(first, 1).otherwise(0)).cast("long").alias("n_lines"),
                  F.count("token").alias("n_tokens"),
                  (F.approx_count_distinct("token", rsd) if approx
                   else F.count_distinct("token")).alias("n_distinct"),
                  F.sum(F.when(first, F.col("_c")).otherwise(0)).cast("long").alias("n_chars"))


def min_count(counts: DataFrame, k: int) -> DataFrame:
    """A3: keep tokens seen at least k times."""
    return counts.where(F.col("freq") >= k)


def frequency_order(prefix: str = "first_") -> list:
    """Frequency descending, ties by first appearance (stable sort of an insertion-ordered
    counter)."""
    return [F.col("freq").desc(), F.col(prefix + "doc_id"), F.col(prefix + "line_no"),
            F.col(prefix + "pos")]


def counts_by_frequency(counts: DataFrame) -> DataFrame:
    """O1: dense rank 0.. by (freq desc, first seen); distributed, no global window."""
    return dense_index(counts, frequency_order(), name="rank")


def assign_vocab_ids(counts: DataFrame, min_freq: int = MIN_COUNT_PREPARE) -> DataFrame:
    """Id 0 = UNK, then 1.. by (freq desc, first seen) over tokens with freq >= min_freq.

    Reserved strings never take an id of their own (a literal ``UNK`` in the text is UNK). Ids
    come from distributed dense numbering, never from one window over the vocabulary.
    """
    kept = kept_tokens(counts, min_freq)
    ranked = dense_index(kept, frequency_order(), name="_r")
    body = ranked.select((F.col("_r") + 1).cast("int").alias("id"), "token")
    unk = literal_rows(counts.sparkSession, [(0, UNK)], "id int, token string")
    return unk.unionByName(body)


def can_enter(min_freq: int) -> Column:
    """Whether a counted token can enter a vocabulary (freq >= min_freq, not reserved)."""
    return (F.col("freq") >= min_freq) & ~F.col("token").isin(*RESERVED, LINE_SENTINEL)


def kept_tokens(counts: DataFrame, min_freq: int) -> DataFrame:
    """Tokens that can enter a vocabulary (freq >= min_freq, not reserved)."""
    return counts.where(can_enter(min_freq))


def add_specials(vocab: DataFrame, n_vocab: int) -> DataFrame:
    """The three reserved rows at V, V+1, V+2 (V = vocabulary rows including UNK)."""
    spark = vocab.sparkSession
    specials = literal_rows(
        spark, [(n_vocab, START), (n_vocab + 1, DELIMITER), (n_vocab + 2, END)],
        "id int, token string")
    return vocab.select("id", "token").unionByName(specials)


def special_ids(n_vocab: int) -> dict:
    return {START: n_vocab, DELIMITER: n_vocab + 1, END: n_vocab + 2}


def regroup(exploded: DataFrame, keys, pos: str, value: Column, name: str,
            carry=()) -> DataFrame:
    """Re-collect exploded values per key in position order.

    ``collect_list`` alone is unordered after a shuffle, so (pos, value) structs are sorted.
    Rows with a null position (empty input arrays from posexplode_outer) give ``[]``.
    ``carry`` columns are constant per key and kept with ``first``.
    """
    s = F.array_sort(F.collect_list(F.when(F.col(pos).isNotNull(),
                                           F.struct(F.col(pos).alias("p"), value.alias("v")))))
    kept = [F.first(c).alias(c) for c in carry]
    return (exploded.groupBy(*keys).agg(s.alias("_s"), *kept)
            .select(*keys, *carry, F.transform("_s", lambda e: e["v"]).alias(name)))


def lookup_tokens(df: DataFrame, keys, tokens: Column, table: DataFrame, on_hit, on_miss,
                  name: str, carry=()) -> DataFrame:
    """Map every token of every row through a lookup table by a join, keeping row and token
    order: the form for tables too large to hold in a worker. Frequent tokens are not shuffled
    (``hot_split_join``).

    ``table`` has columns ``(_tok, _val)``. ``on_hit``/``on_miss`` build the output value from
    the token and ``_val`` columns. ``carry`` columns ride along unchanged.
    """
    ex = df.select(*keys, *carry, F.posexplode_outer(tokens).alias("_pos", "_tok"))
    j = hot_split_join(ex, table, "_tok")
    value = F.when(F.col("_val").isNotNull(), on_hit).otherwise(on_miss)
    return regroup(j, keys, "_pos", value, name, carry)


def _table_rows(table: DataFrame) -> dict:
    """A lookup table of checked size as a dict."""
    return {r["_tok"]: r["_val"] for r in table.select("_tok", "_val").collect()}


ENTRY_BYTES = 28          # hash, id, offset of a token and some room, beside its own bytes
TOKENS_HELD = 200_000     # tokens whose id a task remembers, beside the table


def _packed(table: DataFrame, limit: int) -> tuple | None:
    """A table of ``(_tok, _val)`` as hashes in order, values and tokens; None if that is more than
    ``limit`` bytes."""
    known = table.where(F.col("_tok").isNotNull())
    size = known.agg(F.sum(F.octet_length("_tok").cast("long") + ENTRY_BYTES)).head()[0] or 0
    if size > limit:
        return None
    t = known.select(F.xxhash64("_tok").alias("h"), "_tok", "_val").toArrow().sort_by("h")
    return tuple(t[c].combine_chunks() for c in ("h", "_val", "_tok"))


class PackedTable(dict):
    """Token -> value, None without one, from the arrays of ``_packed``. A token's hash gives its
    place and the token there is compared, so equal hashes do no harm."""

    def __init__(self, arrays: tuple):
        super().__init__()
        hashes, self.values_at, self.tokens = arrays
        self.hashes = hashes.to_numpy()

    def __missing__(self, x):
        if len(self) >= TOKENS_HELD:
            self.clear()
        got = self[x] = self.find(x)
        return got

    def find(self, x: str):
        from xxhash import xxh64_intdigest
        h = xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42)     # as Spark's xxhash64
        h -= (h >> 63) << 64
        i = int(self.hashes.searchsorted(h))
        while i < len(self.hashes) and self.hashes[i] == h:
            if self.tokens[i].as_py() == x:
                return self.values_at[i].as_py()
            i += 1
        return None


def sent_table(table: DataFrame, limit: int):
    """A lookup table for ``mapped_text``: a dict, arrays, or None if both are beyond ``limit``."""
    return _table_rows(table) if small_enough(table, limit) else _packed(table, limit)


class CharMap(dict):
    """Characters by their replacement; one met for the first time is decided once: white space
    becomes the empty token, any other UNK."""

    def __missing__(self, x):
        got = self[x] = "" if x.isspace() else UNK
        return got


def mapped_text(spark, table, rule: str):
    """A column function over text that looks tokens up in a broadcast dict or ``_packed`` arrays.

    ``words``: white-space tokens, unknown ones become UNK. ``chars``: code points of the stripped
    text, white space becomes the empty token, unknown ones UNK. ``ids``: single-space split,
    unknown ones 0. ``values``: white-space tokens replaced by their value, unknown ones kept.
    """
    ship(spark)
    sent = spark.sparkContext.broadcast(table)
    unk = UNK

    @F.pandas_udf("array<int>" if rule == "ids" else "string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = sent.value
        if isinstance(known, tuple):
            known = PackedTable(known)
        get = known.get
        if isinstance(known, PackedTable) and rule != "values":
            if rule == "ids":
                one = lambda t: [known[x] or 0 for x in t.split(" ")]
            elif rule == "words":
                one = lambda t: " ".join([unk if known[x] is None else x for x in t.split()])
            else:
                one = lambda t: " ".join(
                    [x if known[x] is not None else "" if x.isspace() else unk for x in t.strip()])
        elif rule == "ids":
            one = lambda t: [get(x, 0) for x in t.split(" ")]
        elif rule == "words":
            one = lambda t: " ".join([x if x in known else unk for x in t.split()])
        elif rule == "chars":
            out = CharMap((x, x) for x in known)
            one = lambda t: " ".join([out[x] for x in t.strip()])
        else:
            one = lambda t: " ".join([get(x, x) for x in t.split()])
        for texts in batches:
            yield pd.Series([None if t is None else one(t) for t in texts], dtype="object")
    return run


def vocab_lookup_table(vocab: DataFrame) -> DataFrame:
    """Vocabulary tokens with id >= 1 (UNK itself is the miss value)."""
    return vocab.where(F.col("id") > 0).select(F.col("token").alias("_tok"),
                                               F.col("id").alias("_val"))


def unk_replace(lines: DataFrame, vocab: DataFrame, mode: str = "word", keys=LINE_KEY,
                text: str = "text", out: str = "text", carry=(),
                limit: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Tokens outside the vocabulary become ``UNK``; joined by one space.

    word: whitespace tokens. char: every code point of the stripped line; whitespace
    characters become the empty token, so ``"a b"`` gives ``"a  b"``.
    """
    if mode not in ("word", "char"):
        raise ValueError(mode)
    table = vocab_lookup_table(vocab)
    sent = sent_table(table, limit)
    if sent is not None:
        fn = mapped_text(lines.sparkSession, sent, mode + "s")
        return lines.select(*keys, *carry, fn(text).alias(out))
    if mode == "word":
        toks, miss = tx.word_tokens(text), F.lit(UNK)
    else:
        toks = tx.chars(tx.strip(text))
        miss = F.when(F.col("_tok").rlike("^" + tx.WS_CLASS + "$") | (F.col("_tok") == ""),
                      F.lit("")).otherwise(F.lit(UNK))
    r = lookup_tokens(lines, keys, toks, table, F.col("_tok"), miss, "_toks", carry)
    return r.select(*keys, *carry, F.array_join("_toks", " ").alias(out))


def encode(df: DataFrame, vocab_specials: DataFrame, keys=LINE_KEY, text: str = "text",
           out: str = "ids", carry=(), limit: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Split on single spaces (empty tokens kept), token -> id, unknown -> 0."""
    table = vocab_specials.select(F.col("token").alias("_tok"), F.col("id").alias("_val"))
    sent = sent_table(table, limit)
    if sent is not None:
        fn = mapped_text(df.sparkSession, sent, "ids")
        return df.select(*keys, *carry, fn(text).alias(out))
    return lookup_tokens(df, keys, F.split(F.col(text), " "), table, F.col("_val"), F.lit(0), out,
                         carry)


def encode_fields(df: DataFrame, cols, vocab_specials: DataFrame, key: str = "pair_id",
                  limit: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """J3 on each text column; other columns pass through. ``key`` must be unique per row."""
    rest = [c for c in df.columns if c not in cols and c != key]
    table = vocab_specials.select(F.col("token").alias("_tok"), F.col("id").alias("_val"))
    sent = sent_table(table, limit)
    if sent is not None:
        fn = mapped_text(df.sparkSession, sent, "ids")
        return df.select(key, *rest, *[fn(c).alias(c + "_ids") for c in cols])
    stacked = None
    for i, c in enumerate(cols):
        extra = [F.col(r) if i == 0 else F.lit(None).cast(df.schema[r].dataType).alias(r)
                 for r in rest]
        part = df.select(F.col(key), F.lit(i).alias("_field"), F.col(c).alias("_text"), *extra)
        stacked = part if stacked is None else stacked.unionByName(part)
    enc = lookup_tokens(stacked, (key, "_field"), F.split(F.col("_text"), " "), table,
                        F.col("_val"), F.lit(0), "_ids", carry=rest)
    return enc.groupBy(key).agg(
        *[F.max(c).alias(c) for c in rest],
        *[F.max(F.when(F.col("_field") == i, F.col("_ids"))).alias(c + "_ids")
          for i, c in enumerate(cols)])


def top_tokens(counts: DataFrame, k: int) -> list:
    """The k most frequent tokens (bounded by k) as a Python list, e.g. for a stop list."""
    rows = counts.orderBy(*frequency_order()).limit(k).select("token").collect()
    return [r["token"] for r in rows]


def drop_stopwords_table(tokens: DataFrame, stop: DataFrame, keys=LINE_KEY, pos: str = "pos",
                         token: str = "token") -> DataFrame:
    """T8 for a long stop list held as a table: left-anti join of exploded tokens. The planner
    broadcasts the list where its measured size allows."""
    s = stop.select(F.col(stop.columns[0]).alias(token))
    return tokens.join(s, token, "left_anti").select(*keys, pos, token)
