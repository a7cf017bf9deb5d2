"""BPE: hand cases, exact batched learning against a one-at-a-time statement of the rule,
and segmentation properties."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from helpers import SF_SMALL, brute_learn, lines_df
from wordmill.operators import bpe
from wordmill.sources.corpus import read_corpus, read_table


def codes_df(spark, pairs):
    return spark.createDataFrame([(i, l, r) for i, (l, r) in enumerate(pairs)],
                                 "rank int, left string, right string")


def test_pair_stats_overlap(spark):
    w = bpe.word_symbols(lines_df(spark, ["aaa"] * 5))
    st = {(r["l"], r["r"]): r["n"] for r in bpe.pair_stats(w).collect()}
    assert st == {("a", "a"): 10, ("a", "</w>"): 5}


def test_merge_left_to_right(spark):
    w = bpe.word_symbols(lines_df(spark, ["aaa abab"]))
    w = bpe.merge_pair(bpe.merge_pair(w, "a", "a"), "a", "b")
    got = {r["word"]: r["s"] for r in w.select("word", bpe.symbols_of("w").alias("s")).collect()}
    assert got["aaa"] == ["aa", "a", "</w>"]
    assert got["abab"] == ["ab", "ab", "</w>"]


def test_segmentation_hand_case(spark):
    codes = codes_df(spark, [("t", "h"), ("th", "e"), ("the", "</w>"), ("a", "a"), ("o", "n")])
    out = bpe.segment_text(lines_df(spark, ["the aaa on thethe", ""]), codes)
    got = [r["text"] for r in out.orderBy("line_no").collect()]
    assert got == ["the aa@@ a on the@@ the", ""]
    fold = bpe.segment_text(lines_df(spark, ["the aaa on thethe"]), codes)
    assert fold.first()["text"] == "the aa@@ a on the@@ the"


def test_duplicate_code_first_rank(spark):
    r = bpe.rank_codes(codes_df(spark, [("a", "b"), ("c", "d"), ("a", "b")]))
    assert {(x["left"], x["right"]): x["rank"] for x in r.collect()}[("a", "b")] == 0


def fixture_lines(spark, max_doc=30):
    docs = read_table(spark, SF_SMALL, "documents").where(F.col("doc_id") < max_doc)
    return read_corpus(docs.select("doc_id", "text"))


def test_batched_learning_equals_greedy(spark):
    lines = fixture_lines(spark)
    words = Counter()
    for r in lines.select("text").collect():
        words.update(r["text"].split())
    expect = brute_learn(dict(words), 40)
    got = bpe.learn_bpe(bpe.word_symbols(lines), 40).orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in got] == expect


def test_stop_rule(spark):
    codes = bpe.learn_bpe(bpe.word_symbols(lines_df(spark, ["ab ab cd"])), 100).collect()
    assert [(r["left"], r["right"]) for r in codes] == [("a", "b"), ("ab", "</w>")]


def test_segmentation_properties(spark):
    lines = fixture_lines(spark, 20)
    codes = bpe.learn_bpe(bpe.word_symbols(lines), 30)
    words = bpe.word_symbols(lines).select("word")
    g = {r["word"]: r["subwords"] for r in bpe.segment_words(words, codes).collect()}
    f = {r["word"]: r["subwords"] for r in bpe.segment_words_fold(words, codes).collect()}
    assert g == f
    for w, sub in g.items():
        assert "".join(sub) == w
    seg = bpe.segment_text(lines, codes)
    joined = lines.join(seg.withColumnRenamed("text", "seg"), ["doc_id", "line_no"])
    for r in joined.collect():
        assert r["seg"].replace("@@ ", "").split() == r["text"].split()


def test_fold_condition():
    assert bpe.fold_equals_greedy([("t", "h"), ("th", "e"), ("a", "a")])
    assert not bpe.fold_equals_greedy([("ab", "c"), ("a", "b")])     # operand made later
    assert not bpe.fold_equals_greedy([("a", "bc"), ("b", "c"), ("ab", "c")])
    assert not bpe.fold_equals_greedy([("a", "b"), ("a", "b")])      # same string twice


def test_text_is_its_words_segmented(spark):
    lines = fixture_lines(spark, 15)
    codes = bpe.learn_bpe(bpe.word_symbols(lines), 25)
    words = bpe.segment_words(bpe.word_symbols(lines).select("word"), codes).collect()
    form = {r["word"]: "@@ ".join(r["subwords"]) for r in words}
    seg = {(r["doc_id"], r["line_no"]): r["text"] for r in bpe.segment_text(lines, codes).collect()}
    for r in lines.collect():
        assert seg[r["doc_id"], r["line_no"]] == " ".join(form[w] for w in r["text"].split())


def test_epochs_equal_single_merges(spark):
    lines = fixture_lines(spark, 12)
    w = bpe.word_symbols(lines)
    log: list = []
    b = bpe.learn_bpe(w, 60, batch=False)
    runs = [b, bpe.learn_bpe(w, 60), bpe.learn_bpe(w, 60, k=3),
            # so little room that epochs retry with fewer pairs
            bpe.learn_bpe(w, 60, run_symbols=300, log=log.append)]
    key = [[(r["left"], r["right"], r["n"]) for r in x.orderBy("rank").collect()] for x in runs]
    assert key[0] == key[1] == key[2] == key[3]
    assert len(log) > 4


def test_pass_over_the_whole_table_where_runs_have_no_room(spark):
    w = bpe.word_symbols(fixture_lines(spark, 4))
    a = bpe.learn_bpe(w, 25, run_symbols=0).orderBy("rank").collect()
    b = bpe.learn_bpe(w, 25).orderBy("rank").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def random_words(rng):
    """Few letters and many repeats, so that pairs tie, overlap and spell a symbol twice."""
    letters = "ab</w>"[:rng.choice([2, 3, 6])]
    return {"".join(rng.choices(letters, k=rng.randint(1, 9))): rng.randint(1, 4) for _ in range(40)}


def test_merges_of_runs_equal_brute_force():
    """Epochs in plain Python over the same functions: cut at a threshold, learn, apply."""
    rng = random.Random(3)
    twice = 0
    for _ in range(150):
        words = random_words(rng)
        state = [(list(w) + ["</w>"], f) for w, f in words.items()]
        made: set = set()
        codes: list = []
        while True:
            count = Counter()
            for sy, f in state:
                for p in zip(sy, sy[1:]):
                    count[p] += f
            best = max(count.values(), default=0)
            if best < 2:
                break
            floor = rng.randint(2, best)
            found = Counter()
            for sy, f in state:
                a = 0
                for i in range(1, len(sy) + 1):
                    if i == len(sy) or count[sy[i - 1], sy[i]] < floor:
                        if i - a > 1:
                            found[tuple(sy[a:i])] += f
                        a = i
            new = bpe.greedy_merges([(list(k), f) for k, f in found.items()], floor, 10**6, made)
            twice += len({l + r for l, r, _ in new}) < len(new) or any(l + r in made for l, r, _ in new[-1:])
            made.update(l + r for l, r, _ in new)
            ranks = {(l, r): i for i, (l, r, _) in enumerate(new)}
            state = [(bpe._merged(sy, ranks, once=True), f) for sy, f in state]
            codes += [(l, r) for l, r, _ in new]
        assert codes == brute_learn(words, 10**6)
    assert twice          # the case of a symbol spelled twice occurs


def test_fold_finds_the_codes_of_each_word(spark):
    lines = fixture_lines(spark, 20)
    words = bpe.word_symbols(lines)
    codes = bpe.learn_bpe(words, 1500)
    assert bpe.fold_equals_greedy([(r["left"], r["right"]) for r in codes.orderBy("rank").collect()])
    w = words.select("word")
    g = {r["word"]: r["subwords"] for r in bpe.segment_words(w, codes).collect()}
    assert g == {r["word"]: r["subwords"] for r in bpe.segment_words_fold(w, codes).collect()}


def test_fold_codes_by_join_equal_those_by_broadcast(spark, monkeypatch):
    words = bpe.cut_lineage(bpe.word_symbols(fixture_lines(spark, 6)))
    codes = bpe.learn_bpe(words, 200)
    w = words.select("word").union(spark.createDataFrame([(None,), ("",), ("the",)], "word string"))
    one = bpe.segment_words_fold(w, codes)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan      # no row per part of a word
    monkeypatch.setattr(bpe, "small_enough", lambda made: False)
    two = bpe.segment_words_fold(w, codes)
    rows = [Counter((r.word, tuple(r.subwords or ())) for r in x.collect() if r.word) for x in (one, two)]
    assert rows[0] == rows[1] and one.count() == w.count()


def test_numbered_tables_equal_spelled_ones(spark):
    """Words that merges were made in before, a symbol that spells the end mark, an astral one."""
    rows = [(["th", "e", "</w>"], 3), (["th", "e", "th", "e", "</w>"], 2), (["a", "a", "a", "</w>"], 5),
            (["<", "/w>", "</w>"], 4), (["\U0001F600", "th", "e"], 2), (["x"], 7)]
    words = spark.createDataFrame(rows, "s array<string>, freq long").select(
        bpe.delimit(F.col("s")).alias("w"), "freq")
    symbols = bpe.Symbols(["th", "/w>"])
    numbered = bpe._numbered(words, symbols)
    key = lambda df: {(r["l"], r["r"]): r["n"] for r in df.collect()}
    assert key(bpe._named(bpe._numbered_stats(numbered), symbols.names)) == key(bpe.pair_stats(words))
    symbols.add("the")
    codes = [("th", "e", 9), ("<", "/w>", 4)]
    got = bpe.apply_merges(numbered, codes, bpe._sent_pairs(spark, codes, symbols), symbols)
    state = Counter({w: n for w, n in bpe._spelled(got, symbols.names).collect()})
    spell = lambda *sy: bpe.OPEN + (bpe.CLOSE + bpe.OPEN).join(sy) + bpe.CLOSE
    assert state == {spell("the", "</w>"): 3, spell("the", "the", "</w>"): 2, spell("a", "a", "a", "</w>"): 5,
                     spell("</w>", "</w>"): 4, spell("\U0001F600", "the"): 2}
    assert [tuple(r)[1:] for r in bpe.learn_bpe(words, 9).orderBy("rank").collect()] == [
        tuple(r)[1:] for r in bpe.learn_bpe(words, 9, batch=False).orderBy("rank").collect()]


def test_a_list_without_a_limit_settles_more_pairs_a_pass(spark, monkeypatch):
    from wordmill import registry
    from wordmill.operators import bpe as ops
    words = ops.word_symbols(spark.createDataFrame(
        [(" ".join(w[:n] for w in ("abcabd", "bcabca", "cababc") for n in range(2, 7)),)], "text string"))
    learn, sizes = ops.learn_bpe, []

    def seen(w, n, run_symbols=ops.RUN_SYMBOLS, **more):
        sizes.append(run_symbols)
        return learn(w, n, run_symbols=run_symbols, **more)

    monkeypatch.setattr(registry, "_words", lambda spark, sf: words)
    monkeypatch.setattr(ops, "learn_bpe", seen)
    got = [tuple(r) for r in registry.learned_codes(spark, "rows-of-this-test", registry.NO_LIMIT)
           .orderBy("rank").collect()]
    assert sizes[0] > ops.RUN_SYMBOLS
    plain = [tuple(r) for r in learn(words, registry.NO_LIMIT, batch=False).orderBy("rank").collect()]
    assert got == plain and plain


def test_the_library_segments_as_the_plain_rule(monkeypatch):
    rng = random.Random(3)
    slow = []
    plain = bpe._greedy
    monkeypatch.setattr(bpe, "_greedy", lambda w, r: slow.append(w) or plain(w, r))
    for trial in range(60):
        syms, ranks = list("abc<w>") + ["</w>", "/"], {}
        for k in range(rng.choice([4, 12, 30])):     # not learned: strings made twice, or too late
            pair = rng.choice(syms), rng.choice(syms)
            if pair not in ranks and not pair[0].endswith("</w>"):
                ranks[pair] = k
                syms.append("".join(pair))
        order = list(ranks.values())
        if trial % 2:
            rng.shuffle(order)
        ranks = dict(zip(ranks, order))
        words = ["", "a</w>b", "\U0001F600a", "a\x1cb"] + [
            "".join(rng.choice("aabbcx</w>") for _ in range(rng.randint(0, 12))) for _ in range(100)]
        assert bpe.segmenter(ranks)(words) == [plain(w, ranks) for w in words]
    slow.clear()
    ranks = {("a", "b"): 0, ("ab", "ab"): 1, ("c", "</w>"): 2}     # as learning gives them
    assert bpe.segmenter(ranks)(["ababc", "xc", "abé"]) == [["abab", "c"], ["x", "c"], ["ab", "é"]]
    assert not slow


def words_table(spark, words):
    chars = F.concat(F.split("word", ""), F.array(F.lit(bpe.END_OF_WORD)))
    return spark.createDataFrame(list(words.items()), "word string, freq long").select(
        "word", "freq", bpe.delimit(chars).alias("w"))


def test_merges_after_the_head_equal_brute_force(spark, monkeypatch):
    """A list longer than the driver holds: the rest is learned by many tasks, in the same order, and
    the driver never makes a table of more than the head (and the end mark)."""
    sent = []
    literal = bpe.literal_rows
    monkeypatch.setattr(bpe, "literal_rows", lambda s, rows, schema: (
        sent.append(len(rows)), literal(s, rows, schema))[1])
    rng = random.Random(5)
    words = {"".join(rng.choices("abcdefgh", k=rng.randint(1, 9))): rng.randint(1, 4) for _ in range(60)}
    want = brute_learn(words, 10**6)
    assert len(want) > 100
    for head, limit, room in ((7, 10**6, bpe.RUN_SYMBOLS), (0, 50, 30)):
        del sent[:]
        got = bpe.learn_bpe(words_table(spark, words), limit, head=head, run_symbols=room).orderBy("rank").collect()
        assert [(r["left"], r["right"]) for r in got] == want[:limit]
        assert [r["rank"] for r in got] == list(range(len(got)))
        assert all(a["n"] >= b["n"] >= 2 for a, b in zip(got, got[1:]))
        assert max(sent) <= head + 1


def test_symbols_spelled_twice_after_the_head(spark):
    """The end mark written out in words, and runs of one letter: a merge spells what exists."""
    words = {"x</w>": 3, "aaaaaaa": 3, "aaab": 2, "baaa": 2, "</w>": 2, "ab</w>x": 2}
    want = brute_learn(words, 10**6)
    log: list = []
    got = bpe.learn_bpe(words_table(spark, words), 10**6, head=0, log=log.append).orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in got] == want
    assert any(left + right == bpe.END_OF_WORD for left, right in want)


def test_epoch_ends_where_a_symbol_is_spelled_again(spark):
    rows = [("a", "b", -5, "a", "b", 0, 10), ("c", "d", -4, "c", "d", 0, 11),
            ("ab", "c", -4, "ab", "c", 1, 12), ("a", "bc", -3, "a", "bc", 1, 13), ("x", "y", -3, "x", "y", 2, 14)]
    codes = spark.createDataFrame(rows, "left string, right string, wn long, wl string, wr string, i int, id int")
    symbols = spark.createDataFrame([(3, "zz")], "id int, name string")
    kept, again = bpe._until_spelled_again(codes, symbols)
    assert sorted(r["id"] for r in kept.collect()) == [10, 11, 12, 13] and again == {13: 12}
    kept, again = bpe._until_spelled_again(codes, spark.createDataFrame([(3, "cd")], "id int, name string"))
    assert sorted(r["id"] for r in kept.collect()) == [10, 11, 12] and again == {11: 3}
    kept, again = bpe._until_spelled_again(codes.where("id < 13"), symbols)
    assert kept.count() == 3 and again == {}


def test_runs_that_share_pairs_are_linked():
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    group = {x: {x} for e in edges for x in e}
    for a, b in edges:
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    a, b = (np.array(x, np.int64) * 1000 - 30000 for x in zip(*edges))
    nodes, least = bpe._linked(a, b)
    assert dict(zip(nodes.tolist(), least.tolist())) == {
        x * 1000 - 30000: min(g) * 1000 - 30000 for x, g in group.items()}
