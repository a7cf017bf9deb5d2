"""Headline benchmark: corpus preparation (E12), sequence preparation (E13), token counts
(A1), pair statistics (A4), BPE learning (B3), segmentation (B8) and LM scoring (M7).

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default /root/testdata/sf0.1) and prints one
JSON line. Every query is executed end to end (its vocabulary/codes included) and forced
with a no-op write, so nothing is collected to the driver. Before timing, the same queries run
once on the smallest table folder (untimed) so JIT compilation and Python worker start-up are
not counted: the numbers are steady-state throughput, as on a long-running cluster job.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wordmill import registry as R  # noqa: E402
from wordmill.session import get_session  # noqa: E402

HEADLINE = ["prepare_corpus", "prepare_sequences", "token_counts_word", "pair_stats",
            "learn_bpe", "segment_text", "score_ngram_lm"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("wordmill-bench", master=f"local[{cpus}]", shuffle_partitions=cpus,
                        driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
    # warm-up (JVM, JIT, Python workers) on the smallest folder; not timed
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in HEADLINE:
            R.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    R.lines(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        R._CACHE.clear()
        R._CODES.clear()
        t0 = time.time()
        R.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else None}))
    spark.stop()


if __name__ == "__main__":
    main()
