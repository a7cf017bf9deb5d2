"""Framing, masks, positions and pair framing (hand cases)."""

from wordmill.functions import frames as fr


def row(spark, data, schema, *cols):
    return spark.createDataFrame([data], schema).select(*cols).first()


def test_frame_truncates(spark):
    r = row(spark, ([1, 2, 1, 2],), "ids array<int>", fr.frame("ids", 5, 3, 5).alias("f"))
    assert r["f"] == [3, 1, 2, 1, 5]


def test_pair_framing_side_limit(spark):
    r = row(spark, ([1, 1, 1], [2]), "a array<int>, b array<int>",
            fr.frame_pair("a", "b", 8, 3, 4, 5).alias("p"))
    assert r["p"] == [[3, 1, 1, 4, 2, 5], [3, 2, 4, 1, 1, 5]]


def test_masks(spark):
    r = row(spark, ([3, 0, 5],), "ids array<int>", fr.length_mask("ids", 5).alias("lm"),
            fr.nonzero_mask(fr.pad("ids", 5)).alias("nm"), fr.pad("ids", 5).alias("p"),
            fr.end_position("ids", 5).alias("e"), fr.sequence_length("ids", 2).alias("n"))
    assert r["lm"] == [1.0, 1.0, 1.0, 0.0, 0.0]
    assert r["nm"] == [1.0, 0.0, 1.0, 0.0, 0.0]
    assert r["p"] == [3, 0, 5, 0, 0]
    assert r["e"] == 2 and r["n"] == 2


def test_positions_and_targets(spark):
    r = row(spark, ([3, 7, 5],), "ids array<int>", fr.position_ids("ids", 3).alias("p"),
            fr.next_token_targets("ids").alias("t"))
    assert [x["pos_id"] for x in r["p"]] == [6, 7, 8]
    assert [(x["prev"], x["next"], x["pos"]) for x in r["t"]] == [(3, 7, 1), (7, 5, 2)]
