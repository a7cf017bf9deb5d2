"""Grouping of spelling variants by neighbourhoods over a reduced alphabet.

``vocabulary`` counts words. ``near_pairs`` finds all pairs of words one edit apart: letters are
hashed to a few symbols, every distinct reduced word is expanded to its whole one-edit
neighbourhood (itself, deletions, replacements, insertions), the neighbourhoods are joined with
the reduced vocabulary by a 64-bit hash, and the words behind both sides are compared as they
are. An edit of a word is at most one edit of its reduced form, so no pair is missed; a false
meeting of forms or hashes ends at the comparison.

Few symbols make small neighbourhoods that meet many words, many symbols the reverse. The number
is the one with the least expected work for the vocabulary's lengths, so it grows with the
vocabulary and the words behind one form stay few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordmill.llm.common import drop, id_and_text, written

#: Letters that make words, and those that are lower-cased.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols that reduced words are spelled with.
SYMBOLS = "0123456789abcdefghijklmnop"


def runs(docs: DataFrame, noise: int | None = None, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``word`` per run of letters of every text, A-Z lower-cased. With ``noise`` a run whose
    crc32 (of ``id:run``, a null id is empty) is divisible by it loses the code point at
    crc32 % length."""
    docs = id_and_text(docs, id_col, text_col)
    text = F.translate("text", UPPER, LOWER)
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                        F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("word"))
    if noise is None:
        return found.select("word")
    h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("word")).cast("int")
    cut = F.concat(F.left("word", at), F.substr("word", at + 2))
    return found.withColumn("h", h).select(
        F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, noise: int | None = None,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` of the words of at least ``min_length`` code points that occur at least
    ``min_count`` times. Counts are combined before the shuffle, so frequent words are cheap."""
    w = runs(docs, noise, id_col, text_col).where(F.char_length("word") >= min_length)
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def n_symbols(lengths: dict[int, int]) -> int:
    """The number of symbols q with the least expected work: words of a length times their
    neighbours, each with the words of that length behind it if all forms were equally common."""
    def work(q):
        return sum(n * (2 * q * k + q) * (1 + n / q ** min(k, 40)) for k, n in lengths.items())
    return min(range(2, len(SYMBOLS) + 1), key=work)


def reduced(word: str, q: int) -> Column:
    """Each letter as one of ``q`` symbols (code point modulo q)."""
    letters = LOWER + "".join(map(chr, range(0xC0, 0x100)))
    return F.translate(word, letters, "".join(SYMBOLS[ord(c) % q] for c in letters))


def neighbourhoods(forms: DataFrame, q: int) -> DataFrame:
    """``form, near`` (hashes): every string at most one edit from the reduced word ``r``, once.
    Of a run of equal symbols only the first is deleted, and a symbol is not inserted behind an
    equal one, because that gives a string that is there already."""
    at = forms.select("form", "r", F.explode(F.sequence(F.lit(0), F.length("r"))).alias("p"))
    p = F.col("p")
    at = at.select("form", "r", "p", F.substring("r", F.lit(1), p).alias("head"),
                   F.substr("r", p + 1).alias("tail"), F.substr("r", p + 2).alias("rest"),
                   F.substring("r", p, F.lit(1)).alias("last"), F.substr("r", p + 1, F.lit(1)).alias("this"))
    inside, last, this = F.col("p") < F.length("r"), F.col("last"), F.col("this")
    first = F.col("p") == 0
    made = [F.when(first, F.col("r")), F.when(inside & (first | (this != last)), F.concat("head", "rest"))]
    for s in SYMBOLS[:q]:
        made.append(F.when(inside & (this != s), F.concat("head", F.lit(s), "rest")))
        made.append(F.when(first | (last != s), F.concat("head", F.lit(s), "tail")))
    return (at.select("form", F.explode(F.array(*made)).alias("x")).where("x is not null")
            .select("form", F.xxhash64("x").alias("near")))


def near_pairs(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """``word, n, other, n_other`` for all words exactly one inserted, deleted or replaced code
    point apart, each pair from both sides. ``words`` (word, n) must be distinct and is read
    several times. Empty in, empty out."""
    if symbols is None:
        by = words.groupBy(F.least(F.char_length("word"), F.lit(64)).alias("k")).count().collect()
        symbols = n_symbols({r["k"]: r["count"] for r in by})
    r = words.select("word", "n", reduced("word", symbols).alias("r"))
    r = r.withColumn("form", F.xxhash64("r"))
    forms = r.groupBy("form").agg(F.first("r").alias("r"))
    met = neighbourhoods(forms, symbols).join(r.select(
        F.col("form").alias("near"), F.col("word").alias("other"), F.col("n").alias("n_other")), "near")
    both = met.select("form", "other", "n_other").join(r.select("form", "word", "n"), "form")
    return (both.where(F.levenshtein("word", "other", 1) == 1)
            .select("word", "n", "other", "n_other"))


def roots(links: DataFrame, rounds: int = 70) -> DataFrame:
    """``word, root`` from ``word, form``: forms are followed to the last by pointer doubling,
    each round a join on the words that still move. Forms must not form a ring (a form is more
    frequent than its word)."""
    spark = links.sparkSession
    state, path = written(links.where("form is not null").select("word", F.col("form").alias("root")),
                          "roots")
    for _ in range(rounds):
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = state.join(step, "root", "left")
        new, new_path = written(new.select("word", F.coalesce("next", "root").alias("root"),
                                           F.col("next").isNotNull().alias("moved")), "roots")
        drop(spark, path)
        path, state = new_path, new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return state
    raise RuntimeError(f"forms did not settle in {rounds} rounds")


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, noise: int | None = None,
             ratio: int = 2, symbols: int | None = None, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` per word of the vocabulary. The form is the near
    word with the largest n (then the first in code-point order) if that n is at least ``ratio``
    times the word's own; the root is where following forms ends.

    Null and empty texts have no words, rows that repeat an id all count, a null id hashes as an
    empty one, other columns are not read; an empty table gives an empty result.
    """
    words, _ = written(vocabulary(docs, min_length, min_count, noise, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("n_other")).alias("m"), F.col("other")))
    near = (near_pairs(words, symbols).groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), best.alias("b")))
    w = words.join(near, "word", "left")
    fits = -F.col("b.m") >= F.col("n") * ratio
    w, _ = written(w.select("word", F.when(fits, F.col("b.other")).alias("form"), "n",
                            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                            F.when(fits, -F.col("b.m")).alias("form_n")), "forms")
    return w.join(roots(w), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
