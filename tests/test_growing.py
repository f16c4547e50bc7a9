"""Boosting inside tasks: draws, thresholds and trees are those of Spark and of the rounds that are jobs of Spark."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from rillspark.catalog import load
from rillspark.catalog import models as jobs
from rillspark.operators import boosting, growing, models
from rillspark.operators.boosting import Growth, PenalisedTrees
from rillspark.operators.trees import nodes, read_tree


@pytest.fixture(scope="module")
def table(spark):
    """300 rows in three folds; one feature of few values, one of many, one that never changes."""
    draw = np.random.default_rng(8)
    x = np.stack([draw.integers(0, 12, 300), draw.integers(0, 25, 300), np.full(300, 4)], axis=1).astype(float)
    y = np.where(x[:, 0] > 5, 20.0, -5.0) + np.abs(x[:, 1] - 9) + draw.normal(size=300)
    made = [(i, *map(float, a), float(b), i % 3 if i % 50 else None) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(made, "id int, a double, b double, c double, y double, fold int")
    return boosting.written(models.assemble(df, ["a", "b", "c"]), ["fold"])


@pytest.mark.parametrize("seed", [0, 42_000_131, -7, 2**31 + 5])
def test_draws_are_those_of_spark(spark, seed):
    rows = spark.range(0, 3 * 2**33, 2**31 + 12345).select(F.col("id").alias("_row"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(growing.SAMPLES)).alias("coin"))
    found = sorted(rows.collect())
    hashes = growing._hash_long(np.array([r["_row"] for r in found]), np.uint64(42))
    assert list(growing.coins(hashes, seed)) == [r["coin"] for r in found]


@pytest.mark.parametrize("rows", [5, 40, 700])
def test_thresholds_are_those_of_spark(spark, rows):
    draw = np.random.default_rng(rows)
    values = np.round(draw.exponential(50, size=rows))
    df = spark.createDataFrame([(float(v), float(draw.normal())) for v in values], "x double, y double").coalesce(1)
    whole = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=12, minInstancesPerNode=1).fit(whole)
    used = {f.threshold for f in boosting.forks(read_tree(tree.toDebugString, [0]))}
    assert used and used <= set(growing.thresholds(values, min(32, rows) - 1).tolist())


@pytest.mark.parametrize("params", [
    {"max_depth": 3}, {"max_depth": 4, "subsample": 0.8, "colsample_bytree": 0.67, "min_child_weight": 7},
    {"max_depth": 3, "gamma": 30.0, "reg_alpha": 4.0, "learning_rate": 0.7}, {"max_depth": 0}, {"subsample": 1e-5},
])
def test_models_in_tasks_are_those_grown_by_jobs(table, params):
    settings = PenalisedTrees(**params)
    sides = [boosting._sides(table, F.col("fold") == k) for k in range(3)]
    together = boosting.side_by_side(table, [settings], "fold", range(3), sides)
    together.grow([(0, 0), (0, 1)], 2)
    together.grow([(0, 1)], 5)
    grown = together.models[0, 1]
    by_jobs = Growth(settings, table, F.col("fold") == 1).grow(5)
    assert len(together.models[0, 0].trees) == 2 and not together.models[0, 2].trees
    assert [[(f.feature, f.threshold) for f in boosting.forks(t)] for t in grown.trees] == [
        [(f.feature, f.threshold) for f in boosting.forks(t)] for t in by_jobs.trees
    ]
    for a, b in zip(grown.curve, by_jobs.curve, strict=True):
        assert a == pytest.approx(b)


def test_a_search_over_a_large_table_grows_by_jobs(table, monkeypatch):
    points = [{"learning_rate": 0.5}, {"max_depth": 1}]
    in_tasks = boosting.halving_search(table, points, [2])
    monkeypatch.setattr(boosting, "HELD_NUMBERS", 100)
    by_jobs = boosting.halving_search(table, points, [2])
    assert by_jobs.best == in_tasks.best
    for a, b in zip(in_tasks.rows, by_jobs.rows, strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1])


@pytest.mark.parametrize("held", [boosting.HELD_NUMBERS, 100])
def test_a_fit_inside_a_task_is_that_of_jobs(table, monkeypatch, held):
    monkeypatch.setattr(boosting, "HELD_NUMBERS", held)
    settings = PenalisedTrees(n_estimators=3, gamma=5.0, reg_alpha=2.0)
    got, want = settings.fit_in_task(table), settings.fit(table)
    assert got.base == pytest.approx(want.base) and len(got.trees) == 3
    a, b = ([r["prediction"] for r in m.transform(table).orderBy("_row").collect()] for m in (got, want))
    assert a == pytest.approx(b)


def test_a_surface_may_grow_inside_tasks(table):
    matrix = models.Matrix(table.withColumn("split", F.expr("if(fold = 1, 'test', 'train')")), ["a", "b", "c"])
    params = {"n_estimators": 3, "min_child_weight": 10}
    in_tasks, by_spark = (
        {(r["depth"], r["trees"], r["split"]): r["r2"] for r in models.validation_surface(matrix, [1, 3], in_tasks=x, **params).collect()}
        for x in (True, False)
    )
    assert len(in_tasks) == 12 and in_tasks == pytest.approx(by_spark)


def test_written_predictions_do_not_pile_up(spark, table, monkeypatch, tmp_path):
    from rillspark import session

    monkeypatch.setattr(boosting, "TREES_PER_WRITE", 1)
    before = len(session._FOLDERS)
    Growth(PenalisedTrees(max_depth=1), table).grow(5)
    assert len(session._FOLDERS) == before + 1


def test_nodes_predict_as_the_tree_of_spark(spark, table):
    tree = DecisionTreeRegressor(labelCol="y", maxDepth=6).fit(table)
    flat = nodes(read_tree(tree.toDebugString, [0, 1, 2]))
    rows = tree.transform(table).select("_x", "prediction").collect()
    assert flat.predict(np.array([r["_x"] for r in rows])) == pytest.approx([r["prediction"] for r in rows])


@pytest.fixture
def searched(spark, monkeypatch):
    """Runs a query on a small matrix, with a search that only notes the targets, numbers of points and of trees."""
    rows = spark.range(60).selectExpr("id % 10 site", "id % 7 a", "id % 7 * 2.0 y0", "if(id % 10 < 8, 'train', 'test') split")
    matrix = models.prepare(rows, ["a"], "y0", keep=["site"])
    targets, asked = [], []
    monkeypatch.setattr(jobs, "_matrix", lambda v, target="ec": targets.append(target) or matrix)
    found = boosting.Search(PenalisedTrees(n_estimators=2), [(0, "{}", 500, 2, 0.5)])
    monkeypatch.setattr(boosting, "halving_search", lambda rows, points, trees: asked.append((len(points), trees)) or found)

    def run(name):
        made = load()[name].run(SimpleNamespace(spark=spark)).collect()
        return targets, asked, made

    return run


def test_the_randomised_search_is_whole(searched):
    """6 draws of one target had been grown to 1 tree, and 2 of them to 3."""
    targets, asked, made = searched("m5_randomised_search")
    assert targets == [r["target"] for r in made] == list(jobs.TARGETS)
    assert asked == [(50, [500])] * 3


def test_the_tuned_holdout_searches_whole_targets(searched):
    """3 draws of one target had been grown to 1 tree, and one of them to 2."""
    targets, asked, made = searched("m5_tuned_holdout")
    assert targets == list(jobs.TARGETS) and asked == [(50, [500])] * 3
    assert [(r["target"], r["split"], r["n_estimators"]) for r in sorted(made, key=lambda r: (r["target"], r["split"]))] == [
        (t, s, 2) for t in sorted(jobs.TARGETS) for s in ("test", "train")
    ]


def test_the_curve_has_a_hundred_trees_for_every_depth_and_target(searched, spark, monkeypatch):
    """It had 3 trees."""
    asked = []
    made = spark.createDataFrame([(2, "test", 0.5)], "depth int, split string, r2 double")
    monkeypatch.setattr(models, "validation_curve", lambda m, depths, **params: asked.append((depths, params)) or made)
    targets, _, rows = searched("m6_validation_curve")
    assert targets == list(jobs.TARGETS) and len(rows) == 3
    assert asked == [(list(range(2, 11)), {"in_tasks": True, "n_estimators": 100, "learning_rate": 0.07})] * 3


def test_boosting_in_tasks_is_that_of_spark(table, monkeypatch):
    params = {"n_estimators": 4, "max_depth": 4, "learning_rate": 0.3, "min_child_weight": 10}
    fitted = models.fit_boosted({"t": table}, {"k": ("t", params)}, 1)["k"]
    assert isinstance(fitted, boosting.PlainModel) and len(fitted.trees) == 4
    by_spark = models.boosted_trees(**params).fit(table)
    assert fitted.treeWeights == [1.0, 0.6, 0.6, 0.6] and list(by_spark.treeWeights) == [1.0, 0.3, 0.3, 0.3]
    got, want = ([r["prediction"] for r in m.transform(table).orderBy("_row").collect()] for m in (fitted, by_spark))
    assert got == pytest.approx(want)
    monkeypatch.setattr(boosting, "HELD_NUMBERS", 100)
    assert type(models.fit_boosted({"t": table}, {"k": ("t", params)}, 1)["k"]) is type(by_spark)


def test_boosting_in_tasks_draws_rows_and_features(table):
    params = {"n_estimators": 2, "max_depth": 3}
    drawn = {"subsample": {"subsample": 0.5}, "share": {"colsample_bytree": 0.3}, "both": {"subsample": 0.5, "colsample_bytree": 0.3}}
    settings = {k: ("t", {**params, **p}) for k, p in {"none": {}, **drawn}.items()}
    first, again = (models.fit_boosted({"t": table}, settings, 1) for _ in range(2))
    assert len({str(m.trees) for m in first.values()}) == 4
    assert all(first[k].trees == again[k].trees for k in settings)


def test_splits_that_part_alike_go_to_the_first_feature():
    draw = np.random.default_rng(1)
    x = draw.normal(size=500)
    y = np.where(x > 0.3, 1.0, 0.0) + draw.normal(size=500) + 1e6
    table = growing.Table(y, np.stack([x, -x, 2 * x], axis=1), np.zeros(500, dtype=np.uint64), None)
    made, _ = growing.grow(PenalisedTrees(max_depth=3), table.without(), float(y.mean()), [], 5)
    assert {f.feature for t in made for f in boosting.forks(t)} == {0}


def test_specialised_models_have_all_their_trees(spark, monkeypatch):
    """They had 5 of 1,000 trees."""
    rows = spark.range(200).selectExpr(
        "id % 20 site", "id % 7 * 1.0 swir22", "id % 11 * 1.0 NDVI", "id % 5 * 1.0 NDTI", "id * 1.0 ta", "id * 2.0 ec", "id % 3 * 1.0 drp"
    )
    asked, fit = {}, models.fit_boosted

    def fewer(tables, settings, at_a_time):
        asked.update(settings)
        return fit(tables, {k: (t, {**p, "n_estimators": 2}) for k, (t, p) in settings.items()}, at_a_time)

    monkeypatch.setattr(models, "fit_boosted", fewer)
    made = load()["m9_specialised"].run(SimpleNamespace(spark=spark, once=lambda *_: rows)).collect()
    assert [r["target"] for r in made] == list(models.SPECIALISED) and all(r["n"] for r in made)
    assert {k: (t, p["n_estimators"], p["max_depth"], p["subsample"]) for k, (t, p) in asked.items()} == {
        t: (t, 1000, 7, 0.8) for t in jobs.TARGETS
    }
