"""The pipeline on a small slice of the test tables, and the registered queries."""

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline as cp  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing",
                                         "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    out = cp.run(spark, SF)
    assert out.columns == docs.columns + ["shard"]
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert 0 < len(ids) < n and {r.shard for r in out.select("shard").collect()} <= set(range(16))


def test_stages_on_odd_rows(spark, odd_docs, odd_labels, tmp_dir):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and slept all day long"), (2, None), (3, "")],
                                  "item_id long, text string")
    odd_labels.write.parquet(f"{tmp_dir}/labels.parquet")
    bench.write.parquet(f"{tmp_dir}/benchmark.parquet")
    docs = odd_docs.drop("shard")
    key = lambda df: sorted(map(str, df.select(docs.columns).collect()))
    everything = key(docs)
    for name, stage in cp.STAGES:
        out = stage(spark, docs, tmp_dir)
        assert out.columns == docs.columns + ["shard"] * (name == "sharding"), name
        rows = key(out)
        assert set(rows) <= set(everything), name
        if name == "decontamination":          # the item is in ids 1 (twice) and 2
            assert rows == key(docs.where("doc_id is null or doc_id not in (1, 2)"))
        if name == "mixing":                   # every row stays at least once
            assert all(rows.count(r) >= everything.count(r) for r in everything)
        if name == "sharding":
            assert rows == everything
        assert stage(spark, docs.limit(0), tmp_dir).count() == 0, name


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert {x.split("_")[0] for x in names if x.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
