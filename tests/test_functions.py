import math
from statistics import NormalDist

from pyspark.sql import functions as F

from alertlift.functions import cap_at, hash_bucket, nan_to_null, normal_cdf, z_score_of
from alertlift.functions.scalar import r6, r6_probability


def test_normal_cdf_equals_the_error_function(spark):
    xs = [i / 7 for i in range(-300, 301)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, p in df.select("x", normal_cdf(F.col("x")).alias("p")).collect():
        exact = 0.5 * math.erfc(-x / math.sqrt(2))
        assert abs(p - exact) < 1e-13


def test_normal_cdf_keeps_null(spark):
    assert spark.sql("select cast(null as double) x").select(normal_cdf(F.col("x"))).first()[0] is None


def test_z_score_is_the_inverse():
    for p in (0.7, 0.95, 0.99):
        assert abs(NormalDist().cdf(z_score_of(p)) - p) < 1e-12


def test_cap_keeps_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (9.0,), (None,)], "x double")
    assert [r[0] for r in df.select(cap_at(F.col("x"), F.lit(5.0))).collect()] == [1.0, 5.0, None]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(nan_to_null(F.col("x"))).collect()] == [None, 2.0]


def test_hash_bucket_depends_on_the_key_only(spark):
    df = spark.range(1000)
    one = {r[0]: r[1] for r in df.select("id", hash_bucket(F.col("id"), 3, 42)).collect()}
    two = {
        r[0]: r[1]
        for r in df.repartition(7).select("id", hash_bucket(F.col("id"), 3, 42)).collect()
    }
    assert one == two
    assert set(one.values()) == {0, 1, 2}
    other = {r[0]: r[1] for r in df.select("id", hash_bucket(F.col("id"), 3, 43)).collect()}
    assert one != other


def test_probabilities_are_rounded_as_all_numbers_and_ends_by_comparison(spark):
    ends = [0.0, 1e-12, 3.9e-7, 4e-7, 4.999999e-7, 5e-7, 5.000001e-7, 1e-6, 0.1234565, 0.5, math.nan, None, 1.5, -0.25]
    values = [*ends, *[1 - v for v in ends if v is not None]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    rows = df.select("i", r6_probability(F.col("p")).alias("got"), r6(F.col("p")).alias("wanted")).collect()
    for r in rows:
        assert r["got"] == r["wanted"] or (math.isnan(r["got"]) and math.isnan(r["wanted"])), values[r["i"]]
