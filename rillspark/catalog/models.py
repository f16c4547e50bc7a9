"""Model jobs (M1-M11, M14, M15): few and small trees, over all rows.

Scores of fitted models are not expressible in SQL; what can be checked exactly is the frame around
them, which the other groups cover.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rillspark.catalog import query
from rillspark.catalog.joins import enriched, training_table
from rillspark.catalog.preparation import split_sql
from rillspark.operators import boosting, metrics, models, prep, split
from rillspark.operators.joins import append_frames
from rillspark.plans import evaluation
from rillspark.session import durable

SPECTRAL = ["red", "green", "blue", "nir", "swir16", "swir22", "NDMI", "NDVI", "SI2"]
CLIMATE = ["ppt", "tmax", "tmin", "pet", "ppt_3mo", "tmax_3mo", "T_range"]
CALENDAR = ["Month", "DayOfYear"]
FEATURES = [*SPECTRAL, *CLIMATE, *CALENDAR]
SMALL = {"n_estimators": 5, "max_depth": 3}
TARGETS = ("ta", "ec", "drp")
IDENTITY = ("sample_id", "site", "lat", "lon", "d", "cat")


def _enriched(v):
    """The samples with every feature that a model query here takes; no other column is written down."""

    def made():
        rows = enriched(v)
        taken = {*IDENTITY, *TARGETS, *FEATURES, *models.SUBMISSION_FEATURES, *models.BENCHMARK_FEATURES}
        return rows.select(*(c for c in rows.columns if c in taken))

    return v.once("enriched", made)


def _matrix(v, target="ec", features=FEATURES, **options):
    rows = split.group_split(_enriched(v).filter(F.col(target).isNotNull()), ["site"])
    return models.prepare(rows, features, target, keep=["sample_id", "site"], **options)


def _fitted(matrix, **params):
    estimator = models.boosted_trees(**{**SMALL, **params})
    return estimator.fit(matrix.side("train"))


@query("m1_boosted_trees")
def m1(v):
    matrix = _matrix(v)
    model = _fitted(matrix, learning_rate=0.05, subsample=0.8)
    return models.evaluate(model, matrix)


@query("m1_spatial_evaluation")
def m1_spatial(v):
    rows = _enriched(v)
    return evaluation.evaluate_targets(
        rows, FEATURES, ["ta", "ec", "drp"], models.boosted_trees(**SMALL, learning_rate=0.05),
        place=["site"], categorical=["cat"],
    )


@query("m1_random_evaluation")
def m1_random(v):
    rows = _enriched(v)
    return evaluation.evaluate_targets(
        rows, ["lat", "lon", *FEATURES], list(TARGETS), models.boosted_trees(**SMALL),
        row_key=["sample_id"], categorical=["cat"],
    )


def _each_target(made):
    """The table of every target one below the other."""
    return append_frames([made(t).withColumn("target", F.lit(t)) for t in TARGETS])


@query("m2_random_forest")
def m2(v):
    def of(target):
        matrix = _matrix(v, target)
        forest = models.random_forest(n_estimators=5, max_depth=5)
        return models.evaluate(forest.fit(matrix.side("train")), matrix)

    return _each_target(of)


@query("m3_ridge")
def m3(v):
    def of(target):
        matrix = _matrix(v, target)
        return models.evaluate(models.ridge().fit(matrix.side("train")), matrix)

    return _each_target(of)


@query(
    "m3_line",
    f"""with pairs as (select s.site, s.ec, b.red from samples s join bands b on b.sample_id = s.sample_id
                       where s.ec is not null and b.red is not null),
        {split_sql('pairs')},
        line as (select regr_slope(ec, red) as a, regr_intercept(ec, red) as b from marked
                 where split = 'train')
        select split, count(*) as n, round(1 - avg((ec - a * red - b) * (ec - a * red - b)) / var_pop(ec), 7) as r2,
               round(sqrt(avg((ec - a * red - b) * (ec - a * red - b))), 4) as rmse
        from marked, line group by split""",
)
def m3_line(v):
    pairs = v.samples().select("sample_id", "site", "ec").join(
        v.bands().select("sample_id", "red"), "sample_id"
    ).dropna()
    matrix = models.prepare(split.group_split(durable(pairs), ["site"]), ["red"], "ec")
    scored = models.ridge(0.0).fit(matrix.side("train")).transform(matrix.df)
    return metrics.regression_metrics(scored, ["split"]).select(
        "split", "n", F.round("r2", 7).alias("r2"), F.round("rmse", 4).alias("rmse")
    )


@query(
    "m3_ridge_one_feature",
    f"""with pairs as (select s.site, s.ec, b.red from samples s join bands b on b.sample_id = s.sample_id
                       where s.ec is not null and b.red is not null),
        {split_sql('pairs')},
        shrunk as (select regr_slope(ec, red) * count(*) / (count(*) + 50) as a, avg(ec) as y, avg(red) as x from marked
                   where split = 'train'),
        line as (select a, y - a * x as b from shrunk)
        select split, count(*) as n, round(1 - avg((ec - a * red - b) * (ec - a * red - b)) / var_pop(ec), 7) as r2,
               round(sqrt(avg((ec - a * red - b) * (ec - a * red - b))), 4) as rmse
        from marked, line group by split""",
)
def m3_one(v):
    """Ridge on one standardised feature shrinks the slope of the line by n / (n + alpha)."""
    pairs = v.samples().select("sample_id", "site", "ec").join(
        v.bands().select("sample_id", "red"), "sample_id"
    ).dropna()
    matrix = models.prepare(split.group_split(durable(pairs), ["site"]), ["red"], "ec")
    scored = models.ridge(50.0).fit(matrix.side("train")).transform(matrix.df)
    return metrics.regression_metrics(scored, ["split"]).select(
        "split", "n", F.round("r2", 7).alias("r2"), F.round("rmse", 4).alias("rmse")
    )


def _with_group_folds(matrix, k=3):
    train = split.group_k_fold(matrix.side("train"), ["site"], k)
    return models.Matrix(durable(train), matrix.features)


@query("m4_grid_search")
def m4(v):
    matrix = _with_group_folds(_matrix(v))
    space = {"max_depth": [2, 3], "learning_rate": [0.03, 0.07], "n_estimators": [2]}
    return models.search(matrix, models.grid(space))[1]


@query("m4_grid_search_row_folds")
def m4_rows(v):
    matrix = _matrix(v)
    folds = split.k_fold(matrix.side("train"), ["sample_id"], 3)
    return models.search(
        models.Matrix(durable(folds), matrix.features),
        models.grid({"n_estimators": [2], "max_depth": [3], "min_samples_split": [2, 5]}),
        build=models.random_forest, names=models.FOREST_NAMES,
    )[1]


def _searched(matrix):
    """The search of the whole job: 50 draws over eight axes, all of which act, each grown to 500 trees on all folds."""
    return boosting.halving_search(_with_group_folds(matrix).df, models.draws(models.ROBUST_SPACE, 50), [500])


@query("m5_randomised_search")
def m5(v):
    return _each_target(lambda t: _searched(_matrix(v, t)).table(v.spark))


@query("m5_tuned_holdout")
def m5_tuned(v):
    """The winner of each target's search, fitted on all training rows and scored on places held out."""

    def of(target):
        whole = _matrix(v, target)
        model = _searched(whole).best.fit_in_task(whole.side("train"))
        return models.evaluate(model, whole).withColumn("n_estimators", F.lit(len(model.trees)))

    return _each_target(of)


@query("m1_penalised_trees")
def m1_penalised(v):
    matrix = _matrix(v)
    trees = boosting.PenalisedTrees(**SMALL, learning_rate=0.3, reg_lambda=10, reg_alpha=0.5, gamma=0.5)
    return models.evaluate(trees.fit(matrix.side("train")), matrix)


@query("m6_validation_curve")
def m6(v):
    """Nine depths of 100 trees for every target, as in the whole job."""
    depths = list(range(2, 11))
    return _each_target(
        lambda t: models.validation_curve(_matrix(v, t), depths, in_tasks=True, n_estimators=100, learning_rate=0.07)
    )


@query("m6_validation_surface")
def m6_surface(v):
    return models.validation_surface(_matrix(v), [2, 3, 4], n_estimators=5, learning_rate=0.3)


@query("m7_feature_importance")
def m7(v):
    marked, splits = split.target_splits(_enriched(v), TARGETS, ["site"])
    matrices = models.prepare_targets(marked, dict.fromkeys(TARGETS, FEATURES), splits, keep=["sample_id", "site"])
    fitted = models.fit_targets(matrices, lambda _: models.boosted_trees(**SMALL))

    def of(target):
        table = models.importances(fitted[target], matrices[target].features, v.spark)
        return metrics.top_k(table, [], "importance", 10, ["feature"])

    return _each_target(of)


@query("m8_submission")
def m8(v):
    rows = _enriched(v)
    features = [f for f in models.SUBMISSION_FEATURES if f in rows.columns]
    # The samples without a category stand for the template.
    return models.score_submission(
        rows.filter("cat is not null"), rows.filter("cat is null"), features, ["ta", "ec", "drp"],
        keys=["sample_id", "lat", "lon", "d"], row_id=["sample_id", "lat", "lon", "d"],
        build=lambda: models.boosted_trees(**SMALL),
    )


@query("m9_specialised")
def m9(v):
    """The model of each target with all of its settings, 1,000 trees of depth 7."""
    full = v.once("training_table", lambda: training_table(v))
    rows = split.group_split(full, ["site"])
    known = {c: models.specialised_features(rows, t) for t, c in zip(models.SPECIALISED, TARGETS)}
    matrices = models.prepare_targets(rows, {c: known[c][0] for c in TARGETS}, dict.fromkeys(TARGETS, "split"))
    most = max(m.train_rows for m in matrices.values())
    fitted = models.fit_boosted(
        {c: m.side("train") for c, m in matrices.items()}, {c: (c, known[c][2]) for c in TARGETS},
        models.fits_at_a_time(most, len(TARGETS)),
    )
    tables = []
    for target, column in zip(models.SPECIALISED, TARGETS):
        present, missing, _ = known[column]
        tables.append(
            metrics.regression_metrics(fitted[column].transform(matrices[column].side("test")), []).select(
                F.lit(target).alias("target"), F.lit(len(present)).alias("present"),
                F.lit(len(missing)).alias("missing"), "n", "r2", "rmse",
            )
        )
    return append_frames(tables)


@query("m10_ablation")
def m10(v):
    rows = split.group_split(_enriched(v).filter("ec is not null"), ["site"])
    rows = rows.select("site", "ec", "split", *FEATURES)  # the join moves whole rows
    rows = durable(prep.location_mean(rows, ["site"], "ec", "loc_mean_cond"))
    return models.ablation(
        rows, [*FEATURES, "loc_mean_cond"], models.LOCATION_MEANS, "ec",
        models.boosted_trees(**SMALL),
    )


@query("m11_model_comparison")
def m11(v):
    candidates = {
        "boosted_trees": models.boosted_trees(**SMALL),
        "random_forest": models.random_forest(**SMALL),
        "ridge": models.ridge(),
    }
    return metrics.leaderboard(models.compare_models(_matrix(v), candidates), [])


@query("m14_lag_regression")
def m14(v):
    histories = evaluation.monthly_sequences(v.obs(), ["loc"], "ts", ["flow"], "value", 3, "day")
    flat, features = models.lag_matrix(histories, ["loc", "ts"], ["value", "flow"], 3)
    rows = split.sequential_split(durable(flat), "loc", "ts")
    matrix = models.prepare(rows, features, "y", keep=["loc", "ts"], scale=False)
    return models.evaluate(_fitted(matrix), matrix)


@query("m15_benchmark_features")
def m15(v):
    rows = split.random_split(
        _enriched(v).filter("ec is not null"), ["sample_id"], test_fraction=0.3
    )
    matrix = models.prepare(rows, models.BENCHMARK_FEATURES, "ec")
    forest = models.random_forest(n_estimators=5, max_depth=5).fit(matrix.side("train"))
    return models.evaluate(forest, matrix)
