import pytest
from pyspark.sql import functions as F

from rillspark.operators import models, prep, split


@pytest.fixture(scope="module")
def planted(spark):
    """y is linear in a, with places, gaps and a feature that is never there."""
    x = F.col("id")
    return spark.range(600).select(
        x.alias("row_id"),
        (x % 40).alias("site"),
        F.when(x % 11 != 0, (x * 7919 % 601).cast("double")).alias("a"),
        (x * 104729 % 499).cast("double").alias("b"),
        F.lit(None).cast("double").alias("never"),
        ((x * 7919 % 601) * 3.0 - 200.0).alias("y0"),
    )


@pytest.fixture(scope="module")
def matrix(planted):
    rows = split.group_split(planted, ["site"])
    return models.prepare(rows, ["a", "b", "never"], "y0", keep=["site"])


def test_prepare_drops_features_without_values(matrix):
    assert matrix.features == ["a", "b"]
    assert matrix.df.columns == ["site", "y", "split", "features"]


@pytest.mark.parametrize("name", list(models.MODELS))
def test_models_beat_the_mean(matrix, name):
    params = {} if name == "ridge" else {"n_estimators": 4, "max_depth": 4}
    fitted = models.MODELS[name](**params).fit(matrix.side("train"))
    scores = {r["split"]: r["r2"] for r in models.evaluate(fitted, matrix).collect()}
    assert scores["test"] > 0.4


def test_importances_name_the_planted_feature(spark, matrix):
    fitted = models.random_forest(n_estimators=3, max_depth=3).fit(matrix.side("train"))
    table = models.importances(fitted, matrix.features, spark)
    assert table.orderBy(F.col("importance").desc()).first()["feature"] == "a"


def test_parameters_are_translated():
    gbt = models.boosted_trees(
        n_estimators=7, learning_rate=0.03, max_depth=6, subsample=0.8, colsample_bytree=0.8,
        min_child_weight=5, gamma=0.5, reg_lambda=10, reg_alpha=1,
    )
    assert (gbt.getMaxIter(), gbt.getStepSize(), gbt.getMaxDepth()) == (7, 0.03, 6)
    assert (gbt.getSubsamplingRate(), gbt.getFeatureSubsetStrategy()) == (0.8, "0.8")
    # gamma bounds a summed gain and has no counterpart: Spark's bound is per row.
    assert (gbt.getMinInstancesPerNode(), gbt.getMinInfoGain()) == (5, 0.0)
    assert models.boosted_trees(random_state=7).getSeed() == 7
    forest = models.random_forest(min_samples_split=5)
    assert forest.getMinInstancesPerNode() == 1
    assert models.random_forest(max_depth=None).getMaxDepth() == models.DEEPEST_TREE
    with pytest.raises(ValueError):
        models.boosted_trees(leaves=3)


def test_draws_are_distinct_and_repeatable():
    a = models.draws(models.ROBUST_SPACE, 50)
    assert a == models.draws(models.ROBUST_SPACE, 50)
    assert len({str(p) for p in a}) == 50
    assert len(models.draws({"max_depth": [1, 2]}, 10)) == 2


def test_search_prefers_the_better_depth(matrix):
    train = split.group_k_fold(matrix.side("train"), ["site"], 3)
    points = [{"max_depth": 1, "n_estimators": 1}, {"max_depth": 4, "n_estimators": 1}]
    best, table = models.search(models.Matrix(train, matrix.features), points)
    scores = {r["point"]: r["r2"] for r in table.collect()}
    assert scores[1] > scores[0]
    assert best.getOrDefault("maxDepth") == 4


def test_surface_is_the_score_of_a_fit_of_so_many_trees(matrix):
    surface = models.validation_surface(matrix, [1, 3], n_estimators=3, learning_rate=0.5)
    got = {(r["depth"], r["trees"], r["split"]): r["r2"] for r in surface.collect()}
    assert len(got) == 2 * 3 * 2
    fitted = models.boosted_trees(n_estimators=2, max_depth=3, learning_rate=0.5).fit(matrix.side("train"))
    for r in models.evaluate(fitted, matrix).collect():
        assert got[3, 2, r["split"]] == pytest.approx(r["r2"])
    curve = models.validation_curve(matrix, [1, 3], n_estimators=3, learning_rate=0.5)
    assert {(r["depth"], r["split"], r["r2"]) for r in curve.collect()} == {
        (d, s, r2) for (d, n, s), r2 in got.items() if n == 3
    }


def test_submission_contract(planted):
    train = planted.withColumn("y1", F.when(F.col("row_id") % 2 == 0, -F.abs("y0")))
    template = planted.filter("row_id < 50").select("row_id", "site", "a", "b")
    out = models.score_submission(
        train, template, ["a", "b"], ["y0", "y1"], ["row_id", "site"], ["row_id", "site"],
        build=lambda: models.boosted_trees(n_estimators=2, max_depth=3),
    )
    assert out.columns == ["row_id", "site", "y0", "y1"]
    rows = out.collect()
    assert sorted(r["row_id"] for r in rows) == list(range(50))
    assert min(r["y0"] for r in rows) >= 0 and {r["y1"] for r in rows} == {0.0}
    assert max(r["y0"] for r in rows) > 0


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_ridge_is_the_closed_form(spark, alpha):
    import numpy as np

    draw = np.random.default_rng(0)
    x = draw.normal(size=(200, 2)) * [1.0, 3.0]
    y = 46 * x[:, 0] - 5 * x[:, 1] + draw.normal(size=200) * 20 + 7
    rows = [(float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)]
    df = models.assemble(spark.createDataFrame(rows, "`a.b` double, c double, y double"), ["a.b", "c"])
    z = x - x.mean(0)
    want = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
    fitted = models.ridge(alpha).fit(df)
    assert fitted.coefficients.toArray() == pytest.approx(want, rel=1e-9)


def test_many_categories_with_dots_go_all_the_way(spark):
    rows = [(i, f"v.{i % 300}", float(i % 7), float(i), "train") for i in range(1200)]
    df = spark.createDataFrame(rows, "id int, k string, x double, y double, split string")
    encoded = prep.one_hot(df, ["k"])
    flags = [c for c in encoded.columns if c.startswith("k_")]
    assert len(flags) == 299 and "k_v.1" in flags
    matrix = models.prepare(encoded, ["x", *flags[:20]], "y")
    assert models.ridge().fit(matrix.side("train")).numFeatures == 21


def test_written_vectors_are_those_of_the_assembler(spark):
    rows = spark.range(50).selectExpr("id", "id * 0.5 as `a.b`", "cast(id % 3 as int) as c")
    made = models.written_vectors(rows, ["id"], ["a.b", "c"])
    want = {r["id"]: r["features"] for r in models.assemble(rows, ["a.b", "c"]).collect()}
    assert made.schema["features"].dataType == models.assemble(rows, ["a.b", "c"]).schema["features"].dataType
    got = {r["id"]: r["features"] for r in made.collect()}
    assert {k: list(x.toArray()) for k, x in got.items()} == {k: list(x.toArray()) for k, x in want.items()}
    for bad in ("double('NaN')", "cast(null as double)"):
        with pytest.raises(Exception, match="not a number"):
            models.written_vectors(rows.selectExpr("id", f"{bad} as x"), ["id"], ["x"])


def test_a_surface_scores_all_depths_in_one_pass(matrix, monkeypatch):
    from pyspark.ml.regression import GBTRegressionModel

    passes = []
    monkeypatch.setattr(GBTRegressionModel, "evaluateEachIteration", lambda *_: passes.append("a model") or [0.0, 0.0])
    once = models._errors_after_trees
    monkeypatch.setattr(models, "_errors_after_trees", lambda *a: passes.append("all") or once(*a))
    assert models.validation_surface(matrix, [1, 2], n_estimators=2).count() == 8
    assert passes == ["all"]


def test_large_tables_are_fitted_one_at_a_time():
    assert [models.fits_at_a_time(n, 4) for n in (0, 100, 12_000_000, 43_000_000)] == [4, 4, 2, 1]
