"""Forests, boosting, all-column least squares and balanced group folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertlift.operators import binning, boosting, forest, group_balance, growth, least_squares
from alertlift.plans import trained, views
from alertlift.sources.staging import staged_scope, staging_root

NUMERIC, GROUP = views.NUMERIC, "airport"


@pytest.fixture(scope="module")
def table(spark, sf_dir):
    rows = views.labelled(spark, sf_dir).select("alert_id", GROUP, "fold", "label", *NUMERIC)
    # Awkward values: a missing number and a missing level.
    odd = rows.withColumn("lat_std", F.when(F.col("alert_id") % 7 != 0, F.col("lat_std")))
    return binning.encode(odd.withColumn(GROUP, F.when(F.col("alert_id") % 11 != 0, F.col(GROUP))), NUMERIC, [GROUP])


def by_key(df, *more):
    return {(r["alert_id"], *(r[m] for m in more)): r["duration_pred"] for r in df.collect()}


def arrays(table):
    r = table.rows.select(*binning.BLOCK_COLUMNS, "alert_id").toPandas()
    bins = np.frombuffer(b"".join(map(bytes, r["__bins"])), dtype=np.uint8).reshape(len(r), table.k + 1, -1)
    return r, bins


# Growth ---------------------------------------------------------------------------------


def grow_by_histograms(bins, weight, value, rule, tree, hash_, depth):
    """The same tree, node by node from full histograms."""
    w, s = np.zeros((1, bins.shape[1], binning.MAX_BINS), np.int64), np.zeros((1, bins.shape[1], binning.MAX_BINS), np.int64)
    for j in range(bins.shape[1]):
        np.add.at(w[0, j], bins[:, j], weight)
        np.add.at(s[0, j], bins[:, j], value)
    mean = value.sum() / weight.sum()
    if rule.depth is not None and depth >= rule.depth:
        return lambda x: mean
    found = growth.best_splits(w, s, growth.allowed(np.array([hash_]), tree, bins.shape[1], rule), rule)
    f, t = found.feature[0], found.bin[0]
    if f < 0:
        return lambda x: mean
    left = bins[:, f] <= t
    a, b = growth.children(np.array([hash_]))
    sides = [grow_by_histograms(bins[m], weight[m], value[m], rule, tree, h[0], depth + 1) for m, h in ((left, a), (~left, b))]
    return lambda x: sides[int(x[f] > t)](x)


@pytest.mark.parametrize(
    "rule", [growth.Rule(), growth.Rule(4, 5, per_split=3), growth.Rule(penalty=2.0, gain=1e10, per_tree=4), growth.Rule(0)]
)
def test_rows_and_histograms_grow_the_same_tree(rule):
    r = np.random.default_rng(1)
    bins = np.concatenate([r.integers(0, 128, (500, 5)), r.integers(0, 2, (500, 3))], axis=1).astype(np.uint8)
    value = ((bins[:, 0] * 0.3 + r.normal(0, 4, 500)) * 1e6).astype(np.int64)
    tree = growth.stream_of(7, 1)
    w = growth.bootstrap_weights(np.arange(500), tree)
    out, gains = growth.grow(bins, w, value, bins[:200], rule, tree, tree)
    used = w > 0
    plain = grow_by_histograms(bins[used], w[used], (w * value)[used], rule, tree, tree, 0)
    assert (out == np.array([plain(x) for x in bins[:200]])).all()
    assert (gains >= 0).all() and (rule.depth == 0) == (gains.sum() == 0)


def test_cut_points_separate_values_evenly():
    cuts = binning.cut_points(np.array([1.0, 1.0, 2.0, np.nan, 4.0]))
    assert cuts.tolist() == [1.5, 3.0] and len(binning.cut_points(np.array([3.0, 3.0]))) == 0
    many = binning.cut_points(np.random.default_rng(0).normal(size=20_000), 16)
    assert len(many) == 15 and np.diff(many).min() > 0


def test_encoding_uses_training_rows_of_each_fold_only(table):
    r, bins = arrays(table)
    assert bins.shape == (len(r), 4, len(NUMERIC) + 5) and bins.max() < binning.MAX_BINS
    missing = (r["alert_id"] % 7 == 0).to_numpy()
    place = NUMERIC.index("lat_std")
    assert (bins[missing][:, :, place] == 0).all() and (bins[~missing][:, :, place] > 0).all()
    levels = bins[:, :, len(NUMERIC) :].sum(axis=2)
    assert (levels[(r["alert_id"] % 11 == 0).to_numpy()] == 0).all() and (levels.max(), levels.min()) == (1, 0)


# Forest -----------------------------------------------------------------------------------


def test_hand_over_does_not_change_the_forest(table, monkeypatch):
    spec = forest.Forest(4, growth.Rule(per_split=6))
    whole = by_key(forest.out_of_fold(table, spec, "rf"))
    monkeypatch.setattr(forest, "LOCAL_ROWS", 150)
    monkeypatch.setattr(forest, "HISTOGRAM_BYTES", 600_000)
    parted = by_key(forest.out_of_fold(table, spec, "rf"))
    assert whole.keys() == parted.keys() and all(abs(whole[k] - parted[k]) < 1e-9 for k in whole)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 0)
    spread = by_key(forest.out_of_fold(table, forest.Forest(2, growth.Rule(3)), "rf"))
    monkeypatch.setattr(forest, "LOCAL_ROWS", 10**6)
    assert spread == pytest.approx(by_key(forest.out_of_fold(table, forest.Forest(2, growth.Rule(3)), "rf")))


def test_prefixes_of_one_fit_are_the_smaller_forests(table):
    fits = [forest.Fit(forest.Forest(12), 0, None, (5,))]
    both = forest.predicted(table, forest.fit_forests(table, fits), fits)
    small = [forest.Fit(forest.Forest(5), 0)]
    one = forest.predicted(table, forest.fit_forests(table, small), small)
    told = lambda df, n: {r["__row"]: r["duration_pred"] for r in df.where(F.col("trees") == n).collect()}
    assert told(both, 5) == pytest.approx(told(one, 5)) and len(told(both, 12)) == len(told(both, 5))


def test_unlimited_tree_learns_its_rows_and_held_rows_stay_out(table):
    r, bins = arrays(table)
    fit = forest.Fit(forest.Forest(1, bootstrap=False), 1)
    got = {x["__row"]: x["duration_pred"] for x in forest.predicted(table, forest.fit_forests(table, [fit]), [fit]).collect()}
    assert set(got) == set(r.loc[r["__fold"] == 1, "__row"])
    own, train = bins[:, 1], (r["__fold"] != 1).to_numpy()
    y = r["__y"].to_numpy() * binning.UNIT
    seen = {}
    for b, label in zip(map(bytes, own[train]), y[train]):
        seen.setdefault(b, []).append(label)
    hits = [(got[i], np.mean(seen[b])) for i, b in zip(r["__row"], map(bytes, own)) if i in got and b in seen]
    assert all(abs(a - b) < 1e-6 for a, b in hits)


def test_importances_add_up(table):
    fits = [forest.Fit(forest.Forest(3), 0)]
    told = {r["feature"]: r["importance"] for r in forest.importances(table, forest.fit_forests(table, fits)).collect()}
    assert set(told) == set(table.names) and sum(told.values()) == pytest.approx(1.0)


def test_search_chooses_the_least_inner_error(table):
    settings = [forest.Forest(n, growth.Rule(d)) for d in (1, 8) for n in (3, 6)]
    scored, report = forest.search(table, settings, 3, "rf")
    rows = report.collect()
    assert len(rows) == 3 * 4 and scored.count() == table.rows.count()
    for fold in range(3):
        own = [r for r in rows if r["fold"] == fold]
        chosen = [r for r in own if r["chosen"]]
        assert len(chosen) == 1 and chosen[0]["mae"] == min(r["mae"] for r in own) and chosen[0]["setting"] == 1


# Boosting -----------------------------------------------------------------------------------


def test_one_task_and_many_boost_the_same(table, monkeypatch):
    settings = {
        "squared": boosting.Boosting(5, 0.3, 3, penalty=2.0, least=3, rows=0.7, columns=0.6),
        "absolute": boosting.Boosting(4, 0.5, 2, absolute=True),
    }
    local = by_key(boosting.out_of_fold(table, settings), "model")
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 0)
    monkeypatch.setattr(boosting, "CHECKPOINT", 2)
    assert by_key(boosting.out_of_fold(table, settings), "model") == local


def test_first_round_by_hand(table):
    """One split: leaves are penalised means, or exact medians of the residuals."""
    r, bins = arrays(table)
    train = (r["__fold"] != 2).to_numpy()
    y = r["__y"].to_numpy()[train]
    for absolute in (False, True):
        spec = boosting.Boosting(1, 1.0, 1, penalty=5.0, absolute=absolute)
        got = by_key(boosting.out_of_fold(table, {"b": spec}))
        base = round(int(y.sum()) / len(y))
        base += round(float(np.median(y - base))) if absolute else 0
        rest = y - base
        value = np.sign(rest) if absolute else rest
        best, where = -1.0, None
        for j in range(bins.shape[2]):
            x = bins[train, 2, j]
            for t in np.unique(x)[:-1]:
                left = x <= t
                gain = sum(float(value[m].sum()) ** 2 / (m.sum() + 5.0) for m in (left, ~left))
                if gain > best + 1e-12 * abs(best):
                    best, where = gain, (j, t)
        j, t = where
        step = {}
        for side in (False, True):
            m = (bins[train, 2, j] > t) == side
            step[side] = round(float(np.median(rest[m])) if absolute else rest[m].sum() / (m.sum() + 5.0))
        for i in np.flatnonzero(~train):
            assert got[(r["alert_id"][i],)] == pytest.approx((base + step[bool(bins[i, 2, j] > t)]) * binning.UNIT, abs=2e-6)


def test_boosting_improves_and_absolute_error_follows_the_median(table):
    told = boosting.out_of_fold(table, {f"b{n}": boosting.Boosting(n, 0.3, 3, absolute=True) for n in (1, 40)})
    error = {r["model"]: r["e"] for r in told.groupBy("model").agg(F.avg(F.abs(F.col("duration_true") - F.col("duration_pred"))).alias("e")).collect()}
    assert error["b40"] < 0.5 * error["b1"]


# Least squares and group folds ------------------------------------------------------------------


def test_sweep_equals_least_squares_and_skips_dependent_columns():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 4))
    x = np.column_stack([np.ones(200), x, x[:, 0] + 2 * x[:, 1], np.zeros(200)])
    y = x[:, :5] @ np.array([3.0, 1.0, -2.0, 0.5, 0.0]) + r.normal(size=200)
    a = np.column_stack([x, y])
    b = least_squares.sweep(a.T @ a)
    assert b[5] == 0 and b[6] == 0
    assert np.allclose(x @ b, x @ np.linalg.lstsq(x, y, rcond=None)[0])


def test_missing_numbers_and_levels_in_least_squares(spark):
    rows = [(i, i % 3, None if i == 4 else float(i % 5), "ab"[i % 2] if i % 4 else None, 2.0 * (i % 5) + i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "alert_id long, fold int, x double, airport string, label double")
    told = least_squares.out_of_fold(df, ["x"], ["airport"])
    assert told.count() == 60 and told.where("duration_pred is null").count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_filling_equals_one_group_at_a_time(seed):
    r = random.Random(seed)
    k = r.randint(2, 5)
    classes = [(s, r.randint(1, 40)) for s in r.sample(range(1, 60), 12)]
    loads, plain = [0] * k, {}
    for size, count in sorted(classes, reverse=True):
        given = [0] * k
        for _ in range(count):
            i = loads.index(min(loads))
            loads[i] += size
            given[i] += 1
        plain[size] = [sum(given[: i + 1]) for i in range(k)]
    assert dict(group_balance.shares(classes, k)) == plain


def test_balanced_folds_keep_groups_together(spark):
    sizes = [50, 20, 20, 9, 3, 3, 3, 1, 1, 1, 1]
    df = spark.createDataFrame([(g if g else None, i) for g, n in enumerate(sizes) for i in range(n)], "g int, i int")
    folds = group_balance.assign_balanced_group_folds(df, "g").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("g").alias("g")).collect()
    assert sorted(r["n"] for r in folds) == [31, 31, 50] and sum(r["n"] for r in folds) == sum(sizes)
    assert group_balance.balanced_group_folds(df, "g").count() == len(sizes)


def test_features_of_two_bins_are_split_without_an_order_of_their_own(monkeypatch):
    draw = np.random.default_rng(8)
    bins = np.column_stack([draw.integers(0, 30, 4000), draw.integers(0, 2, 4000), draw.integers(0, 2, 4000) * 7]).astype(np.uint8)
    y, w, held = draw.integers(-(10**8), 10**8, 4000), draw.poisson(1, 4000), bins[:200]
    sorts = []
    real = np.argsort
    monkeypatch.setattr(growth.np, "argsort", lambda *a, **k: sorts.append(1) or real(*a, **k))
    told, gains = growth.grow(bins, w, y, held, growth.Rule(least=3), np.uint64(1), np.uint64(1))
    assert len(sorts) == 1
    monkeypatch.undo()

    def plain(rows, asked):
        """The mean of each asked row's leaf, by histograms."""
        weight, total = np.zeros((1, 3, 128), dtype=np.int64), np.zeros((1, 3, 128), dtype=np.int64)
        for j in range(3):
            np.add.at(weight[0, j], bins[rows, j], w[rows])
            np.add.at(total[0, j], bins[rows, j], (w * y)[rows])
        best = growth.best_splits(weight, total, np.ones((1, 3), dtype=bool), growth.Rule(least=3))
        j, at = best.feature[0], best.bin[0]
        if j < 0:
            return np.full(len(asked), (w * y)[rows].sum() / w[rows].sum())
        out, below, sought = np.zeros(len(asked)), bins[rows, j] <= at, held[asked, j] <= at
        out[sought], out[~sought] = plain(rows[below], asked[sought]), plain(rows[~below], asked[~sought])
        return out

    assert (told == plain(np.flatnonzero(w > 0), np.arange(200))).all() and (gains > 0).all()


def test_training_sets_of_hundreds_of_thousands_of_rows_need_no_job_per_level(spark, monkeypatch):
    def no_spread(*_):
        raise AssertionError("a job per level")

    monkeypatch.setattr(boosting, "_boost_spread", no_spread)
    df = spark.range(300_000).select(
        F.col("id").alias("alert_id"), F.lit("a").alias("airport"), (F.col("id") % 3).cast("int").alias("fold"),
        (F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 50 + F.col("id") % 7).cast("double").alias("label"),
    )
    out = boosting.out_of_fold(binning.encode(df, ["x"]), {"short": boosting.Boosting(3, 0.5, 3)})
    assert out.count() == 300_000 and out.where("duration_pred is null").count() == 0


def test_equal_rows_are_added_up_once_and_features_read_only_nodes_that_may_use_them(monkeypatch):
    draw = np.random.default_rng(3)
    vectors = draw.integers(0, 90, (300, 11)).astype(np.uint8)
    which = draw.integers(0, 300, 20_000)
    y, w = draw.integers(0, 10**8, 20_000), draw.poisson(1, 20_000)
    rule = growth.Rule(least=2, per_split=3)
    added = []
    real = growth._sums_by_bin
    monkeypatch.setattr(growth, "_sums_by_bin", lambda keys, *rest: added.append(len(keys)) or real(keys, *rest))
    told, _ = growth.grow(vectors[which], w, y, vectors, rule, np.uint64(1), np.uint64(1))
    assert max(added) <= 300 and len(added) > 3
    own_w, own_s = np.bincount(which, w, 300).astype(np.int64), np.bincount(which, w * y, 300).astype(np.int64)
    plain = grow_by_histograms(vectors, own_w, own_s, rule, np.uint64(1), np.uint64(1), 0)
    assert (told == np.array([plain(x) for x in vectors])).all()


def test_sums_beyond_exact_floats_are_added_up_as_whole_numbers(monkeypatch):
    draw = np.random.default_rng(4)
    bins, y = draw.integers(0, 100, (600, 3)).astype(np.uint8), draw.integers(2**52, 2**53, 600)
    counted = []
    real = growth._sums_by_bin
    monkeypatch.setattr(growth, "_sums_by_bin", lambda keys, w, s, *rest: counted.append(s.dtype) or real(keys, w, s, *rest))
    rule, one = growth.Rule(3), np.ones(600, dtype=np.int64)
    told, _ = growth.grow(bins, one, y, bins, rule, np.uint64(1), np.uint64(1))
    assert set(counted) == {np.dtype(np.int64)}
    plain = grow_by_histograms(bins, one, y, rule, np.uint64(1), np.uint64(1), 0)
    assert (told == np.array([plain(x) for x in bins])).all()


def test_rows_are_dealt_in_waves_and_only_sums_of_earlier_ones_stay(table, spark, monkeypatch):
    spec = forest.Forest(12, growth.Rule(per_split=6))
    whole = by_key(forest.out_of_fold(table, spec, "rf"))
    dealt, left = [], []
    real, size = forest.deal, table.rows.count()

    def counted(fits, tops, units, blocks):
        dealt.append(len({(u.fit, u.first) for u in units}) * size)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{staging_root(spark)}/alertlift-staged")
        left.append(folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getDirectoryCount())
        return real(fits, tops, units, blocks)

    monkeypatch.setattr(forest, "deal", counted)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 300)
    monkeypatch.setattr(forest, "WAVE_ROWS", 0)
    monkeypatch.setattr(forest, "WAVE_TABLES", 4)
    monkeypatch.setattr(forest, "WAVES_KEPT", 2)
    with staged_scope(spark):
        parted = by_key(forest.out_of_fold(table, spec, "rf"))
    assert whole.keys() == parted.keys() and all(abs(whole[k] - parted[k]) < 1e-9 for k in whole)
    assert len(dealt) == 9 and max(dealt) <= forest.WAVE_TABLES * size and max(left) - left[0] <= 2 * 2


def test_shuffle_files_of_forests_go_with_their_queries(table, spark, monkeypatch):
    seen = []
    real = forest.stage
    monkeypatch.setattr(forest, "stage", lambda df: seen.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")) or real(df))
    forest.search(table, [forest.Forest(2, growth.Rule(2))], 2, "rf")
    assert seen and set(seen) == {"true"}


def test_published_forest_search_is_whole():
    settings = trained.search_settings()
    assert len(set(settings)) == 12 and {s.trees for s in settings} <= {120, 200, 300}
    told = {s.rule.depth for s in settings} | {s.rule.whole for s in settings} | {s.rule.least for s in settings}
    assert len({s.trees for s in settings}) > 1 and told <= {None, 10, 15, 25, 35, 2, 5, 1, 4}
    assert trained.INNER == 3


@pytest.mark.parametrize("whole", [2, 9, 40])
def test_small_nodes_are_not_split(whole):
    r = np.random.default_rng(5)
    bins, value = r.integers(0, 60, (300, 4)).astype(np.uint8), r.integers(0, 10**8, 300)
    rule, tree, one = growth.Rule(whole=whole), growth.stream_of(3, 1), np.ones(300, dtype=np.int64)
    out, _ = growth.grow(bins, one, value, bins, rule, tree, tree)
    plain = grow_by_histograms(bins, one, value, rule, tree, tree, 0)
    assert (out == np.array([plain(x) for x in bins])).all()
    sizes = np.unique(out, return_counts=True)[1]
    assert whole == 2 or sizes.max() > 1
