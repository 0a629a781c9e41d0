"""Level dictionaries and sparse one-hot vectors."""

from collections import Counter

from pyspark.sql import functions as F

from alertlift.operators import levels


def table(spark):
    return spark.range(3000).select(
        "id", (F.col("id") % 3).cast("int").alias("fold"),
        F.when(F.col("id") % 10 < 4, "hot").when(F.col("id") % 10 < 5, None).otherwise(F.concat(F.lit("l"), F.col("id") % 601)).alias("a.b"),
    )


def test_ids_are_dense_and_fall_with_frequency(spark):
    rows = levels.dictionary(table(spark), "a.b").collect()
    plain = Counter(r[0] for r in table(spark).select("`a.b`").collect() if r[0] is not None)
    assert {r["level"]: r["n"] for r in rows} == plain
    by_id = sorted(rows, key=lambda r: r["id"])
    assert [r["id"] for r in by_id] == list(range(len(plain))) and by_id[0]["level"] == "hot"
    assert [r["n"] for r in by_id] == sorted(plain.values(), reverse=True)


def test_vectors_are_sparse_and_unknown_levels_are_zeros(spark):
    df = table(spark).withColumnRenamed("a.b", "x")
    train = levels.fold_dictionaries(df, ["x"], 1)
    known = {r["level"]: r["id"] for r in train["x"].collect()}
    rows = levels.one_hot(df, train).collect()
    assert len(rows) == 3000
    for r in rows:
        v = r["x_vector"]
        assert v.size == len(known) and list(v.indices) == ([known[r["x"]]] if r["x"] in known else [])
    assert any(r["x"] is not None and r["x"] not in known for r in rows)


def test_dictionary_of_nothing(spark):
    assert levels.dictionary(table(spark).where("id < 0"), "a.b").count() == 0
