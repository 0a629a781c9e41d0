"""Dictionaries of text levels that never pass through the driver.

A level's id is its rank by falling frequency, summed up from counts of frequencies, of hash buckets within one frequency and of
levels within one bucket, so no task sorts all levels and none is collected: a column may have as many levels as rows.
Ids come back to the rows by a join; one-hot vectors are sparse and need the number of levels only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlift.operators.folds import DIGEST_DIGITS

UNSEEN = "__level"


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """``level``, ``n`` and ``id`` from 0 on, the most frequent level first.  Missing values are no level."""
    counts = (
        df.select(F.col(f"`{column}`").cast("string").alias("level"))
        .where("level is not null")
        .groupBy("level")
        .agg(F.count("*").alias("n"))
        .withColumn("bucket", F.substring(F.md5("level"), 1, DIGEST_DIGITS))
    )
    buckets = counts.groupBy("n", "bucket").agg(F.count("*").alias("levels"))
    # Fewer than sqrt(2 * rows) different frequencies.
    classes = (
        buckets.groupBy("n")
        .agg(F.sum("levels").alias("levels"))
        .select("n", (F.sum("levels").over(Window.orderBy(F.desc("n"))) - F.col("levels")).alias("ahead"))
    )
    in_class = Window.partitionBy("n").orderBy("bucket")
    offsets = (
        buckets.withColumn("before", F.sum("levels").over(in_class) - F.col("levels"))
        .join(classes, "n")
        .select("n", "bucket", (F.col("ahead") + F.col("before")).alias("offset"))
    )
    place = F.row_number().over(Window.partitionBy("n", "bucket").orderBy("level")) - 1
    return (
        counts.withColumn("place", place)
        .join(offsets, ["n", "bucket"])
        .select("level", "n", (F.col("offset") + F.col("place")).alias("id"))
    )


def indexed(df: DataFrame, levels: DataFrame, column: str, name: str) -> DataFrame:
    """Add the id of each row's level, null for a missing value or one that the dictionary lacks."""
    table = levels.select(F.col("level").alias(UNSEEN), F.col("id").alias(name))
    return df.join(table, F.col(f"`{column}`").cast("string") == F.col(UNSEEN), "left").drop(UNSEEN)


def one_hot(df: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """Add ``<column>_vector``, sparse, with one slot per level; missing and unknown values give zeros.

    All that reaches the driver is the number of levels of each column.
    """
    indices, outputs, sizes = [], [], []
    for i, (column, levels) in enumerate(dictionaries.items()):
        sizes.append(levels.count())
        index = f"__id_{i}"
        df = indexed(df, levels, column, index)
        # One id above all levels stands for none; its slot is the last one, which the encoder drops.
        df = df.withColumn(index, F.coalesce(F.col(index), F.lit(sizes[-1])).cast("double"))
        indices.append(index)
        outputs.append(f"{column}_vector")
    spark = df.sparkSession
    shape = spark.createDataFrame([tuple(float(n) for n in sizes)], ", ".join(f"`{i}` double" for i in indices))
    return OneHotEncoder(inputCols=indices, outputCols=outputs, dropLast=True).fit(shape).transform(df).drop(*indices)


def fold_dictionaries(df: DataFrame, columns: Sequence[str], held: int) -> dict[str, DataFrame]:
    """Dictionaries of the rows outside fold ``held``, for a fit that must not see it."""
    train = df.where(F.col("fold") != held)
    return {c: dictionary(train, c) for c in columns}
