import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text and extra
    columns whose names clash with working names."""
    long_text = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "the cat sat on the mat and slept all day long", "en", "a", 5),
            (1, "the cat sat on the mat and slept all day long", "en", "a", 5),
            (2, "the  cat sat\non the mat and slept all day long ", "en", "a", None),
            (3, None, None, None, None), (None, "an orphan text of five words", "en", "a", 1),
            (None, None, None, None, None), (4, "", "en", "b", 0), (5, " \n\t ", "de", "b", 4),
            (6, long_text, "de", "c", len(long_text)), (7, "eins zwei drei", "de", "c", 14),
            (8, "eins zwei drei", "de", "c", 14), (9, "x", "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F
    return df.select("*", F.lit("z").alias("fp"), F.lit(1).alias("row"), F.lit(2).alias("_key"),
                     F.lit(3).alias("node"), F.lit(4).alias("p"), F.lit(5).alias("tokens"),
                     F.lit(6).alias("shard"), F.lit(7).alias("key"), F.lit(8).alias("score"))


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 1, 1), (5, None, None), (7, 0, 0),
                                  (9, 0, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
