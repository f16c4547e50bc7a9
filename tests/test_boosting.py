import numpy as np
import pytest
from pyspark.sql import functions as F

from rillspark.operators import boosting, models
from rillspark.operators.boosting import Fork, Growth, Leaf, PenalisedTrees, Sums


@pytest.fixture(scope="module")
def rows(spark):
    """240 rows whose y depends on two of three features, with noise, in three folds."""
    draw = np.random.default_rng(3)
    x = draw.integers(0, 40, size=(240, 3)).astype(float)
    y = np.where(x[:, 0] > 20, 30.0, -10.0) + x[:, 1] + draw.normal(size=240) * 3
    made = [(i, *map(float, a), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(made, "id int, a double, b double, c double, y double, fold int")
    return models.assemble(df, ["a", "b", "c"]), x, y


def leaf_of(tree, x):
    while isinstance(tree, Fork):
        tree = tree.left if x[tree.feature] <= tree.threshold else tree.right
    return tree


def soft(total, n, lam, alpha):
    return np.sign(total) * max(abs(total) - alpha, 0) / (n + lam)


def test_leaf_values_are_the_closed_form(rows):
    df, x, y = rows
    params = PenalisedTrees(n_estimators=3, learning_rate=0.3, reg_lambda=10.0, reg_alpha=5.0)
    model = params.fit(df)
    assert model.base == pytest.approx(y.mean())
    rest = y - y.mean()
    for tree in model.trees:
        leaves = [leaf_of(tree, r) for r in x]
        for leaf in set(leaves):
            inside = np.array([own == leaf for own in leaves])
            assert leaf.value == pytest.approx(soft(rest[inside].sum(), inside.sum(), 10.0, 5.0))
        rest = rest - 0.3 * np.array([own.value for own in leaves])
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(list(y - rest))


def test_without_penalties_it_is_sparks_boosting(rows):
    df, _, _ = rows
    own = PenalisedTrees(n_estimators=1, learning_rate=1.0, reg_lambda=0.0, max_depth=3).fit(df)
    spark_tree = models.boosted_trees(n_estimators=1, max_depth=3, learning_rate=1.0).fit(df)
    both = own.transform(df).select("id", "prediction").join(
        spark_tree.transform(df).select("id", F.col("prediction").alias("other")), "id"
    )
    assert both.filter(F.abs(F.col("prediction") - F.col("other")) > 1e-9).count() == 0


def test_gamma_folds_forks_from_the_leaves_up():
    tree = Fork(0, 1.0, Fork(1, 1.0, Leaf(0), Leaf(1)), Leaf(2))
    sums = {0: Sums(10, 10.0), 1: Sums(10, 12.0), 2: Sums(10, -50.0)}
    weak_gain = (100 / 10 + 144 / 10 - 22**2 / 20) / 2
    strong_gain = (22**2 / 20 + 2500 / 10 - 28**2 / 30) / 2

    def refit(gamma):
        return PenalisedTrees(reg_lambda=0.0, gamma=gamma).refit(tree, sums)[0]

    kept = refit(weak_gain / 2)
    assert isinstance(kept.left, Fork) and kept.left.gain == pytest.approx(weak_gain)
    folded = refit((weak_gain + strong_gain) / 2)
    assert isinstance(folded, Fork) and isinstance(folded.left, Leaf)
    assert folded.left.value == pytest.approx(22 / 20)
    assert folded.gain == pytest.approx(strong_gain)
    assert refit(strong_gain * 2).value == pytest.approx(-28 / 30)


def test_an_inner_fork_with_gain_keeps_the_outer_one():
    # Both outer sides have the same sum; only the forks below them improve anything.
    tree = Fork(0, 1.0, Fork(1, 1.0, Leaf(0), Leaf(1)), Leaf(2))
    sums = {0: Sums(5, 50.0), 1: Sums(5, -50.0), 2: Sums(10, 0.0)}
    kept = PenalisedTrees(reg_lambda=0.0, gamma=1.0).refit(tree, sums)[0]
    assert isinstance(kept, Fork) and isinstance(kept.left, Fork)


@pytest.mark.parametrize("axis", ["reg_lambda", "reg_alpha", "gamma"])
def test_every_penalty_acts(rows, axis):
    df, _, y = rows
    spreads = []
    for value in (0.0, 1e9):
        model = PenalisedTrees(n_estimators=2, **{axis: value}).fit(df)
        spreads.append(model.transform(df).agg(F.stddev_pop("prediction")).first()[0])
    assert spreads[0] > 1 and spreads[1] < 1e-3


def test_errors_of_both_sides_come_with_every_tree(rows):
    df, x, y = rows
    params = PenalisedTrees(
        learning_rate=0.4, subsample=0.7, colsample_bytree=0.67, gamma=30.0, reg_alpha=2.0
    )
    written = boosting.written(df, ["fold"])
    growth = Growth(params, written, F.col("fold") == 1).grow(4).grow(boosting.TREES_PER_WRITE + 2)
    held = np.arange(len(y)) % 3 == 1
    assert growth.base == pytest.approx(y[~held].mean())
    made = np.full(len(y), growth.base)
    assert len(growth.curve) == len(growth.trees) + 1 == boosting.TREES_PER_WRITE + 3
    for k, (train, test) in enumerate(growth.curve):
        if k:
            made = made + 0.4 * np.array([leaf_of(growth.trees[k - 1], r).value for r in x])
        assert train == pytest.approx(((y - made)[~held] ** 2).mean())
        assert test == pytest.approx(((y - made)[held] ** 2).mean())
    used = [{f.feature for f in boosting._forks(t)} for t in growth.trees]
    assert all(len(u) <= 2 for u in used)


def test_growth_is_repeatable_and_may_pause(rows):
    df, _, _ = rows
    params = PenalisedTrees(n_estimators=4, subsample=0.5, colsample_bytree=0.5)
    written = boosting.written(df)
    assert Growth(params, written).grow(4).trees == Growth(params, written).grow(1).grow(4).trees


def test_search_halves_and_scores_prefixes(spark, rows):
    df, _, _ = rows
    points = [
        {"max_depth": 0}, {"learning_rate": 0.5}, {"reg_lambda": 1e9}, {"learning_rate": 1.5, "max_depth": 4},
    ]
    found = boosting.halving_search(df, points, [1, 5], keep=0.5)
    table = {r["point"]: r for r in found.table(spark).collect()}
    assert [table[i]["trees"] for i in range(4)].count(5) == 2
    assert table[1]["trees"] == 5 and table[0]["trees"] == 1
    assert table[1]["r2"] > 0.7 and table[1]["r2"] >= table[3]["r2"]
    assert found.best.learning_rate == 0.5 and found.best.n_estimators == table[1]["n_estimators"]
    # One fit of as many trees on the other folds scores the same.
    n, scores = table[1]["n_estimators"], []
    for k in range(3):
        model = PenalisedTrees(learning_rate=0.5, n_estimators=n).fit(df.filter(F.col("fold") != k))
        test = model.transform(df.filter(F.col("fold") == k))
        lost, spread = test.agg(
            F.avg((F.col("y") - F.col("prediction")) ** 2), F.var_pop("y")
        ).first()
        scores.append(1 - lost / spread)
    assert table[1]["r2"] == pytest.approx(np.mean(scores))
    with pytest.raises(ValueError):
        boosting.halving_search(df, [{"leaves": 3}], [1])


def test_awkward_tables(spark, rows):
    df, _, _ = rows
    empty = PenalisedTrees(n_estimators=2).fit(df.limit(0))
    assert {r["prediction"] for r in empty.transform(df).collect()} == {0.0}
    flat = df.withColumn("y", F.when(F.col("id") != 0, 5.0))
    model = PenalisedTrees(n_estimators=2).fit(flat)
    assert {r["prediction"] for r in model.transform(df).collect()} == {5.0}
    assert not model.featureImportances.toArray().any()
    search = boosting.halving_search(flat, [{}], [1])
    assert search.rows[0][-1] is None
    with pytest.raises(ValueError):
        PenalisedTrees(max_depth=40)


def test_importance_goes_to_the_planted_feature(rows):
    df, _, _ = rows
    shares = PenalisedTrees(n_estimators=3).fit(df).featureImportances.toArray()
    assert shares.argmax() == 0 and shares.sum() == pytest.approx(1.0) and shares[2] < 0.1


def test_points_share_the_sums_of_their_folds(rows, monkeypatch):
    df, _, _ = rows
    found, sums = [], boosting._sides
    monkeypatch.setattr(boosting, "_sides", lambda *a: found.append(sums(*a)) or found[-1])
    points = [{"max_depth": d, "learning_rate": 0.5} for d in (1, 2, 3)]
    search = boosting.halving_search(df, points, [1])
    assert len(found) == 3 and len(search.rows) == 3
