"""K-means of several starts in shared passes."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from alertlift.operators import kmeans_batch as kb


def blobs(spark, n=900):
    draw = np.random.default_rng(4)
    middle = np.array([[0.0, 0.0], [6.0, 0.0], [0.0, 7.0]])
    which = draw.choice(3, n, p=[0.5, 0.3, 0.2])
    x = middle[which] + draw.normal(size=(n, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    return VectorAssembler(inputCols=["a", "b"], outputCol="z").transform(df), x


def plain(x, centres):
    for _ in range(300):
        at = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[at == c].mean(axis=0) for c in range(len(centres))])
        if ((moved - centres) ** 2).sum(axis=1).max() <= kb.CENTRE_SHIFT**2:
            break
        centres = moved
    return ((x - centres[at]) ** 2).sum()


def test_shared_passes_find_what_single_starts_find(spark):
    df, x = blobs(spark)
    found = kb.fit_starts(df, restarts=4)
    assert len(found.costs) == 4 and found.costs[found.best] == min(found.costs)
    assert found.costs[found.best] <= plain(x, np.array([[0.0, 0.0], [6.0, 0.0], [0.0, 7.0]])) * 1.001
    assert found.sizes == sorted(found.sizes, reverse=True) and sum(found.sizes) == len(x)


def test_result_does_not_depend_on_the_order_of_rows(spark):
    df, _ = blobs(spark)
    one, two = kb.fit_starts(df.repartition(2, "id"), restarts=3), kb.fit_starts(df.orderBy(F.desc("b")), restarts=3)
    assert (one.centres == two.centres).all() and one.sizes == two.sizes and one.best == two.best


def test_labels_are_the_nearest_centres(spark):
    df, x = blobs(spark, 200)
    found = kb.fit_starts(df, restarts=2)
    told = [r[0] for r in df.orderBy("id").select(found.label(vector_to_array("z"))).collect()]
    assert told == kb.nearest(x, found.centres[None])[0][:, 0].tolist()


def test_fewer_values_than_centres_and_no_rows(spark):
    df = VectorAssembler(inputCols=["a"], outputCol="z").transform(spark.createDataFrame([(1.0,)] * 5, "a double"))
    found = kb.fit_starts(df, restarts=2)
    assert sum(found.sizes) == 5 and found.costs[found.best] == pytest.approx(0)
    with pytest.raises(ValueError):
        kb.fit_starts(df.where("a > 1"), restarts=2)


def test_equal_rows_travel_once_and_count_as_often_as_they_occur(spark):
    df, _ = blobs(spark, 300)
    seen = []
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), 1 + F.col("id").cast("int") % 5)))
    kb.stage, stage = (lambda t: seen.append(t.count()) or stage(t)), kb.stage
    try:
        found = kb.fit_starts(copies, restarts=2)
    finally:
        kb.stage = stage
    assert seen[0] == 300 and sum(found.sizes) == copies.count()


def test_sums_of_members_are_exact_beyond_what_a_float_holds():
    draw = np.random.default_rng(1)
    values, at = draw.integers(-(1 << 55), 1 << 55, (500, 3)), draw.integers(0, 3, (500, 4))
    told = kb.member_sums(at, 3, values)
    for start in range(4):
        for centre in range(3):
            assert told[start, centre].tolist() == [sum(map(int, column)) for column in values[at[:, start] == centre].T]
