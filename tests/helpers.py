"""Fixtures and plain statements of rules that several test modules use."""

from collections import Counter

SF_SMALL = "/root/testdata/sf0.001"


def lines_df(spark, texts, doc_id=0):
    """Lines fixture: one document per call, one row per given line."""
    return spark.createDataFrame([(doc_id, i, t) for i, t in enumerate(texts)],
                                 "doc_id long, line_no int, text string")


def brute_learn(words: dict, n: int) -> list:
    """One merge at a time: most frequent pair, ties by (left, right); stop below 2."""
    vocab = {tuple(w) + ("</w>",): f for w, f in words.items()}
    codes = []
    for _ in range(n):
        stats = Counter()
        for sy, f in vocab.items():
            for a, b in zip(sy, sy[1:]):
                stats[(a, b)] += f
        if not stats:
            break
        best = min(stats, key=lambda p: (-stats[p], p))
        if stats[best] < 2:
            break
        codes.append(best)
        new = Counter()
        for sy, f in vocab.items():
            out, i = [], 0
            while i < len(sy):
                if i + 1 < len(sy) and (sy[i], sy[i + 1]) == best:
                    out.append(sy[i] + sy[i + 1])
                    i += 2
                else:
                    out.append(sy[i])
                    i += 1
            new[tuple(out)] += f
        vocab = new
    return codes
