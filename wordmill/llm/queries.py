"""Registered queries of the pipeline operators: thin, with production parameters, over whole
tables. Each derives its columns from what its operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op3_token_store(spark, sf):
    from wordmill.llm import token_store as ts
    docs = table(spark, sf, "documents")
    store = ts.write_store(docs, tokenizer_file("byte_bpe_50k.json"), end_id=0)
    got = ts.read(store, ts.locate(store, docs.select("doc_id")))
    return got.select(
        F.when(F.col("key") != ts.NULL_KEY, F.col("key")).alias("doc_id"), "start",
        F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op8_token_counts(spark, sf):
    from wordmill.llm import token_counts as tc
    return tc.count_tokens(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"),
                           limit=1024)


@query
def op4_exact_dedup(spark, sf):
    from wordmill.llm import exact_dedup as ed
    return ed.exact_dedup(table(spark, sf, "documents"), capacity=1000)


@query
def op9_simhash(spark, sf):
    from wordmill.llm import simhash as sh
    g = sh.groups(table(spark, sf, "documents"), width=3, limit=3)
    return g.select("doc_id", sh.hex_fingerprint("fp").alias("fingerprint"), "component_id")


@query
def op7_sharding(spark, sf):
    from wordmill.llm import sharding as sd
    return sd.shard_table(table(spark, sf, "documents"), n_shards=16)


@query
def op1_toxicity(spark, sf):
    from wordmill.llm import toxicity as tx
    return tx.score_documents(table(spark, sf, "documents"), table(spark, sf, "labels"),
                              threshold=0.3)


@query
def op6_decontaminate(spark, sf):
    from wordmill.llm import decontaminate as dc
    return dc.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op2_mixing(spark, sf):
    from wordmill.llm import mixing as mx
    return mx.mix_table(table(spark, sf, "documents"), table(spark, sf, "labels"), domain="lang")


@query
def op10_html_text(spark, sf):
    from wordmill.llm import html_extract as hx
    return hx.extract_pages(table(spark, sf, "pages"))


@query
def op5_pii(spark, sf):
    from wordmill.llm import pii
    return pii.pseudonymise(table(spark, sf, "documents"), key="wordmill-demo-key")


@query
def op11_bin_packing(spark, sf):
    from wordmill.llm import packing as pk
    return pk.pack(table(spark, sf, "documents"), tokenizer_file("byte_bpe_50k.json"),
                   capacity=2048, end_id=0)


@query
def op13_merkle_manifest(spark, sf):
    from wordmill.llm import merkle as mk
    return mk.prove(mk.build(table(spark, sf, "documents"), mk.tampered_text(every=5)))


@query
def op12_spelling_variants(spark, sf):
    from wordmill.llm import spelling as sp
    return sp.variants(table(spark, sf, "documents"), min_length=5, min_count=3, noise=97, ratio=2)
