import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlift.operators import quantiles
from alertlift.operators.quantiles import exact_quantiles


def skewed(spark, n=20_000):
    """One group holds over a third of the rows; heavy tails, ties and gaps."""
    rng = np.random.default_rng(7)
    group = np.where(rng.random(n) < 0.4, "hot", np.array(list("abcdef"))[rng.integers(0, 6, n)])
    x = np.round(np.exp(rng.normal(0, 4, n)), 3)
    y = rng.integers(0, 5, n).astype(float)
    rows = [
        (None if g == "f" else str(g), float(a), None if i % 11 == 0 else float(b))
        for i, (g, a, b) in enumerate(zip(group, x, y))
    ]
    return spark.createDataFrame(rows, "g string, x double, y double"), rows


def expected(rows, column, p, group):
    values = [r[column] for r in rows if r[0] == group and r[column] is not None]
    return float(np.quantile(values, p))


def test_grouped_quantiles_equal_numpy(spark):
    df, rows = skewed(spark)
    targets = {"x50": ("x", 0.5), "x99": ("x", 0.99), "y50": ("y", 0.5), "x0": ("x", 0.0), "x1": ("x", 1.0)}
    got = {
        r["g"]: r for r in exact_quantiles(df.repartition(6), targets, ["g"]).collect()
    }
    assert set(got) == {r[0] for r in rows}
    for g, row in got.items():
        for name, (column, p) in targets.items():
            want = expected(rows, 1 if column == "x" else 2, p, g)
            assert row[name] == pytest.approx(want, rel=1e-12)


def test_a_useless_sketch_costs_time_but_not_exactness(spark, monkeypatch):
    """Brackets far off: the wanted rank lies below or above them."""
    df, rows = skewed(spark, 3_000)
    real = quantiles._brackets
    for low, high in ((-5.0, -4.0), (1e12, 1e13), (0.5, 0.5)):
        monkeypatch.setattr(
            quantiles,
            "_brackets",
            lambda *a, low=low, high=high: real(*a).withColumns(
                {"__bounds0": F.array(*[F.lit(low + (high - low) * j / 64) for j in range(65)])}
            ),
        )
        got = exact_quantiles(df, {"m": ("x", 0.5)}, ["g"]).collect()
        for r in got:
            assert r["m"] == pytest.approx(expected(rows, 1, 0.5, r["g"]), rel=1e-12)


def test_many_groups_without_broadcast(spark):
    """Where Spark does not broadcast, the joins shuffle; the result is the same."""
    df, rows = skewed(spark, 3_000)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["g"]: r["m"] for r in exact_quantiles(df, {"m": ("x", 0.5)}, ["g"]).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for g, m in got.items():
        assert m == pytest.approx(expected(rows, 1, 0.5, g), rel=1e-12)


def test_slices_stay_narrow_in_a_power_tail(spark):
    """The slice that holds p99 is a small share of all rows, also beside infinities."""
    n = 200_000
    x = (1 - np.random.default_rng(3).random(n)) ** -2.0
    df = spark.createDataFrame([(float(v),) for v in x] + [(float("inf"),)] * 5, "x double").repartition(8)
    targets = {"m": ("x", 0.99)}
    got = exact_quantiles(df, targets).first()["m"]
    assert got == pytest.approx(float(np.quantile(np.append(x, [np.inf] * 5), 0.99)), rel=1e-12)
    flat = df.select(F.col("x").alias("__v0"))
    sliced = flat.crossJoin(F.broadcast(quantiles._brackets(flat, targets, []))).select(quantiles._slice(0).alias("s"))
    inside = sliced.where("s between 1 and 65").groupBy("s").count().agg(F.max("count")).first()[0]
    assert inside < 2e-3 * n


def test_neighbours_of_an_even_median(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 8)], "x double")
    row = exact_quantiles(df, {"m": ("x", 0.5)}, neighbours=True).first()
    assert (row["m_low"], row["m_high"]) == (2.0, 4.0)


def test_groups_without_values_are_absent(spark):
    df = spark.createDataFrame([("a", None), ("b", 3.0)], "g string, x double")
    got = exact_quantiles(df, {"m": ("x", 0.5)}, ["g"]).collect()
    assert [tuple(r) for r in got] == [("b", 3.0)]


def test_a_target_without_values_is_null(spark):
    df = spark.createDataFrame(
        [("a", None, 1.0), ("a", None, 2.0), ("b", 3.0, 4.0)], "g string, x double, y double"
    )
    out = exact_quantiles(df, {"x": ("x", 0.5), "y": ("y", 0.5)}, ["g"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", None, 1.5), ("b", 3.0, 4.0)]


def test_no_rows_at_all(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert exact_quantiles(df, {"m": ("x", 0.5)}, ["g"]).count() == 0


def test_no_group_meets_in_one_buffer(spark):
    """The sliced way counts by value and never collects a group's values."""
    df, _ = skewed(spark, 2_000)
    out = exact_quantiles(df, {"m": ("x", 0.5)}, ["g"])
    text = out._jdf.queryExecution().toString()
    assert "percentile" not in text and "collect_list" not in text
