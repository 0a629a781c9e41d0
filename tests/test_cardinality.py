"""The race of columns for the fewest distinct values."""

from pyspark.sql import functions as F

from alertlift.operators import cardinality


def test_only_columns_that_can_win_are_counted(spark):
    df = spark.range(5000).select(
        "id", (F.col("id") % 7).alias("seven"), (F.col("id") % 7 + 1).cast("string").alias("a.b"), F.lit(3).alias("same"),
        (F.col("id") / 2).alias("half"), F.lit(None).cast("int").alias("none"), F.when(F.col("id") % 9 != 0, F.col("id") % 900).alias("wide"),
    )
    told = {s.column: s for s in cardinality.race(df, df.columns)}
    assert (told["seven"].n_distinct, told["a.b"].n_distinct) == (7, 7)
    assert all(told[c].n_distinct is None for c in ("id", "same", "half", "none", "wide"))
    assert told["half"].fractional and told["same"].constant and told["none"].constant
    assert cardinality.winner(list(told.values())) == "seven"


def test_close_columns_are_never_told_apart_by_sketches(spark):
    df = spark.range(20_000).select((F.col("id") % 1001).alias("more"), (F.col("id") % 1000).alias("less"), "id")
    told = {s.column: s.n_distinct for s in cardinality.race(df, df.columns)}
    assert told == {"more": 1001, "less": 1000, "id": None}


def test_no_candidates_and_no_rows(spark):
    assert cardinality.race(spark.range(3), []) == [] and cardinality.winner([]) is None
    empty = spark.range(3).where("id > 5").withColumn("b", F.lit("x"))
    standings = cardinality.race(empty, empty.columns)
    assert cardinality.winner(standings) is None and all(s.constant for s in standings)
