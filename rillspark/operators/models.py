"""Training, tuning and scoring of regressors with Spark ML.

Features are prepared with column expressions (imputed, scaled), assembled into one vector and
written down once per target; every fit and fold then reads that table.
"""

from __future__ import annotations

import itertools
import random
import re
import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.functions.numeric import clip_at_zero
from rillspark.operators.boosting import PenalisedTrees, PlainModel, fit_plain, fits_at_a_time
from rillspark.operators.columns import pick_features, require
from rillspark.operators.growing import PlainTrees
from rillspark.operators.metrics import regression_metrics
from rillspark.operators.prep import Preprocessor, fit_on, fit_subsets, scaler_of
from rillspark.operators.quantiles import column_medians_exact, sketches, subset_sketches
from rillspark.operators.trees import Nodes, nodes, read_tree
from rillspark.session import durable

# Boosting and forest parameters by their usual names, and what Spark calls them.
BOOSTED_NAMES = {
    "n_estimators": "maxIter",
    "learning_rate": "stepSize",
    "max_depth": "maxDepth",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "min_child_weight": "minInstancesPerNode",
    "random_state": "seed",
}
FOREST_NAMES = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "max_features": "featureSubsetStrategy",
    "random_state": "seed",
}
# Ignored, as Spark's trees have no counterpart: penalties on leaf weights, a bound on the summed
# gain of a split (Spark bounds the gain per row), and a least size of a node that is split
# (Spark bounds the size of its children). All but the last act in ``boosting.PenalisedTrees``.
WITHOUT_COUNTERPART = ("reg_lambda", "reg_alpha", "gamma", "min_samples_split")
# Spark's own ceiling; a tree without a limit grows to it, with a warning.
DEEPEST_TREE = 30


def _translated(params: Mapping, names: Mapping[str, str]) -> dict:
    out = {}
    for name, value in params.items():
        if name in WITHOUT_COUNTERPART:
            continue
        if name not in names:
            raise ValueError(f"unknown parameter: {name}")
        target = names[name]
        if target == "maxDepth":
            if value is None:
                warnings.warn(f"trees grow to depth {DEEPEST_TREE} at most", stacklevel=3)
                value = DEEPEST_TREE
        elif target == "featureSubsetStrategy":
            value = "all" if value in (None, 1.0) else str(value)
        out[target] = value
    return out


def boosted_trees(seed: int = 42, **params):
    return GBTRegressor(
        labelCol="y", featuresCol="features", checkpointInterval=10,
        **{"seed": seed, **_translated(params, BOOSTED_NAMES)},
    )


def random_forest(seed: int = 42, **params):
    return RandomForestRegressor(
        labelCol="y", featuresCol="features",
        **{"seed": seed, **_translated(params, FOREST_NAMES)},
    )


@dataclass(frozen=True)
class Ridge:
    """Least squares plus alpha times the squared coefficients, intercept aside.

    Spark minimises the mean squared error of a label in units of its spread, so its penalty is
    alpha times that spread over the number of rows; one pass finds both.
    """

    alpha: float = 1.0

    def fit(self, df: DataFrame):
        n, spread = df.agg(F.count("y"), F.stddev_pop("y")).first()
        return LinearRegression(
            labelCol="y", featuresCol="features", elasticNetParam=0.0, standardization=False,
            regParam=self.alpha * (spread or 0.0) / n if n else 0.0,
        ).fit(df)


def ridge(alpha: float = 1.0) -> Ridge:
    return Ridge(alpha)


MODELS = {
    "boosted_trees": boosted_trees, "penalised_trees": PenalisedTrees,
    "random_forest": random_forest, "ridge": ridge,
}

# Features and parameters per target.
SPECIALISED = {
    "Total Alkalinity": (
        ("carbonate_index", "swir22", "swir16", "perc_forest", "perc_grass", "soil_carbon",
         "Month", "soil_ph", "topographic_slope", "soil_texture", "ppt_3mo", "ppt_6mo",
         "temperature", "urban_precip_interaction", "perc_urban"),
        {"learning_rate": 0.03, "max_depth": 7, "n_estimators": 1000, "subsample": 0.8,
         "colsample_bytree": 0.8},
    ),
    "Electrical Conductance": (
        ("perc_urban", "perc_agri", "perc_barren", "precipitation", "ppt_3mo", "ppt_6mo",
         "SI1", "SI2", "NDSI", "NDVI", "evap_ratio", "evapotranspiration"),
        {"learning_rate": 0.07, "max_depth": 7, "n_estimators": 1000, "subsample": 0.8,
         "colsample_bytree": 0.8},
    ),
    "Dissolved Reactive Phosphorus": (
        ("perc_agri", "soil_clay", "soil_ph", "hydro_soil_interaction", "ndci", "NDTI",
         "ndci_turbidity_interaction", "post_2008", "topographic_slope", "temperature",
         "precipitation"),
        {"learning_rate": 0.03, "max_depth": 7, "n_estimators": 1000, "subsample": 0.8,
         "colsample_bytree": 0.8},
    ),
}
# Search spaces, submission features, ablated features, benchmark features.
GRID_SPACE = {
    "max_depth": [5, 7], "learning_rate": [0.03, 0.07], "n_estimators": [1000],
    "subsample": [0.8], "colsample_bytree": [0.8],
}
ROBUST_SPACE = {
    "max_depth": [2, 3, 4], "min_child_weight": [5, 10, 20], "learning_rate": [0.01, 0.05, 0.1],
    "subsample": [0.6, 0.75, 0.9], "colsample_bytree": [0.6, 0.75, 0.9],
    "reg_lambda": [1, 10, 50], "reg_alpha": [0, 0.5, 5], "gamma": [0, 0.5, 2],
}
SUBMISSION_FEATURES = (
    "pet", "ppt", "tmax", "tmin", "soil", "def", "ppt_3mo", "ppt_6mo", "tmax_3mo", "T_range",
    "Month", "DayOfYear",
    "red", "blue", "green", "nir", "swir16", "swir22", "NDVI", "SI2", "NDTI", "MNDWI", "NDMI",
)
SUBMISSION_PARAMS = {
    "subsample": 0.7, "n_estimators": 1000, "max_depth": 10, "learning_rate": 0.01,
    "colsample_bytree": 0.7, "random_state": 42,
}
LOCATION_MEANS = ("loc_mean_cond", "loc_mean_alk", "loc_mean_phos")
BENCHMARK_FEATURES = ("swir22", "NDMI", "MNDWI", "pet")


@dataclass
class Matrix:
    """A prepared table: keys, y, split, any fold, and the feature vector."""

    df: DataFrame
    features: list[str]
    prep: Preprocessor | None = field(default=None, repr=False)
    # Rows of the training side, where they are known.
    train_rows: int = field(default=0, repr=False)

    def side(self, split: str) -> DataFrame:
        return self.df.filter(F.col("split") == split)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the feature vector. Names may hold dots, which the assembler takes for paths."""
    plain = {f"_feature_{i}": F.col(f"`{c}`") for i, c in enumerate(features)}
    assembler = VectorAssembler(
        inputCols=list(plain), outputCol="features", handleInvalid="error"
    )
    return assembler.transform(df.withColumns(plain)).drop(*plain)


def _checked(features: Sequence[str]) -> Column:
    """The features as an array. Values must be numbers, as for the assembler."""
    bad = F.raise_error(F.lit("a feature is missing or not a number")).cast("double")
    x = (F.col(f"`{f}`").cast("double") for f in features)
    return F.array(*(F.coalesce(F.nanvl(c, bad), bad) for c in x)).cast("array<double>")


def written_vectors(df: DataFrame, keep: Sequence[str | Column], features: Sequence[str]) -> DataFrame:
    """The columns to keep and the feature vector, written down: for several fits.

    The vector is built by column expressions in the layout of a dense one, and is a vector once it is read back.
    """
    vector = F.struct(
        F.lit(1).cast("byte").alias("type"), F.lit(None).cast("int").alias("size"),
        F.lit(None).cast("array<int>").alias("indices"), _checked(features).alias("values"),
    )
    plain = df.select(*keep, vector.alias("features"))
    fields = [*plain.schema.fields[:-1], T.StructField("features", VectorUDT())]
    return durable(plain, T.StructType(fields))


def prepare(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    keep: Sequence[str] = (),
    fit_rows: str = "train",
    scale: bool = True,
) -> Matrix:
    """Drop rows without a target, impute and scale with training statistics, assemble.

    ``df`` has a ``split`` column. Features without any value on the fitting side are left out. Takes several
    passes over ``df``, each of which reads only the columns it needs: hand in a table that is cheap to read.
    """
    names = dict.fromkeys([*keep, *features, target, "split"])
    labelled = require(df, [target]).select(*(F.col(f"`{c}`") for c in names))
    prep = fit_on(labelled, features, fit_rows)
    used = [f for f in features if prep.medians[f] is not None]
    prep = Preprocessor(*({f: d[f] for f in used} for d in (prep.medians, prep.means, prep.stds)))
    ready = prep.transform(labelled) if scale else prep.impute(labelled)
    kept = [*(F.col(f"`{c}`") for c in keep), F.col(f"`{target}`").cast("double").alias("y"), F.col("split")]
    return Matrix(written_vectors(ready, kept, used), used, prep)


def prepare_targets(
    df: DataFrame, features: Mapping[str, Sequence[str]], splits: Mapping[str, str], keep: Sequence[str] = ()
) -> dict[str, Matrix]:
    """``prepare`` for each target, by the features of its model and the name of its split column.

    The statistics of all targets come from the same two passes over ``df``.
    """

    def has(target: str) -> Column:
        y = F.col(f"`{target}`")
        return y.isNotNull() & ~F.isnan(y.cast("double"))

    subsets = {t: (has(t) & (F.col(splits[t]) == "train"), own) for t, own in features.items()}
    known = subset_sketches(df, subsets)
    fitted = fit_subsets(df, subsets, known)
    made = {}
    for target, own in features.items():
        prep = fitted[target]
        used = [f for f in own if prep.medians[f] is not None]
        prep = Preprocessor(*({f: d[f] for f in used} for d in (prep.medians, prep.means, prep.stds)))
        names = dict.fromkeys([*keep, *used, target, splits[target]])
        ready = prep.transform(df.filter(has(target)).select(*(F.col(f"`{c}`") for c in names)))
        kept = [*(F.col(f"`{c}`") for c in keep), F.col(f"`{target}`").cast("double").alias("y"), F.col(splits[target]).alias("split")]
        vectors = written_vectors(ready, kept, used)
        made[target] = Matrix(vectors, used, prep, max((k.rows for k in known[target].values()), default=0))
    return made


def fit_each(tables: Mapping[str, DataFrame], rows: int, build: Callable[[str], object]) -> dict[str, object]:
    """The models that ``build`` names for the tables, of ``rows`` rows at most; fitted together while their rows can be held."""
    if not tables:
        return {}
    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(fits_at_a_time(rows, len(tables))) as pool:
        fit = inheritable_thread_target(spark)(lambda name: build(name).fit(tables[name]))
        return dict(zip(tables, pool.map(fit, tables), strict=True))


def fit_targets(matrices: Mapping[str, Matrix], build: Callable[[str], object]) -> dict[str, object]:
    """The model of every target, fitted on its training side."""
    most = max((m.train_rows for m in matrices.values()), default=0)
    return fit_each({t: m.side("train") for t, m in matrices.items()}, most, build)


def fit_boosted(
    tables: Mapping[str, DataFrame], settings: Mapping[object, tuple[str, Mapping]], at_a_time: int, in_tasks: bool = True
) -> dict[object, object]:
    """The boosted model of every key, of a named table and parameters.

    Grown inside tasks where a task can hold the tables, else by Spark, so many at a time. Of splits that part the rows
    alike, tasks take the first; Spark leaves it to rounding.
    """
    estimators = {key: boosted_trees(**params) for key, (_, params) in settings.items()}
    plain = {key: (settings[key][0], _plain(e)) for key, e in estimators.items()}
    grown = fit_plain(tables, plain) if in_tasks and all(p for _, p in plain.values()) else None
    if grown is not None:
        return {key: grown[key] for key in settings}
    spark = next(iter(tables.values())).sparkSession
    fit = inheritable_thread_target(spark)(lambda key: estimators[key].fit(tables[settings[key][0]]))
    with ThreadPoolExecutor(at_a_time) as pool:
        return dict(zip(settings, pool.map(fit, settings), strict=True))


def _plain(estimator: GBTRegressor) -> PlainTrees | None:
    """The settings of an estimator; None for a rule of features that trees in tasks do not know."""
    rule = estimator.getFeatureSubsetStrategy()
    if rule not in ("all", "auto") and not re.fullmatch(r"0?\.\d+|1\.0", rule):
        return None
    return PlainTrees(
        estimator.getMaxIter(), estimator.getStepSize(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode(),
        estimator.getSubsamplingRate(), 1.0 if rule in ("all", "auto") else float(rule), estimator.getSeed(),
    )


def evaluate(model, matrix: Matrix) -> DataFrame:
    """Metrics on both sides of the split."""
    return regression_metrics(model.transform(matrix.df), ["split"], len(matrix.features))


def importances(model, features: Sequence[str], spark: SparkSession) -> DataFrame:
    """(feature, importance) of a fitted tree model; one row per feature."""
    values = [float(v) for v in model.featureImportances.toArray()]
    return spark.createDataFrame(
        list(zip(features, values)), "feature string, importance double"
    )


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    names = list(space)
    return [dict(zip(names, values)) for values in itertools.product(*space.values())]


def draws(space: Mapping[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """n different points of a grid, or all of them if it has fewer."""
    points = grid(space)
    return random.Random(seed).sample(points, min(n, len(points)))


def search(
    matrix: Matrix,
    points: Sequence[Mapping],
    fold: str = "fold",
    folds: int = 3,
    build=boosted_trees,
    names: Mapping[str, str] = BOOSTED_NAMES,
    parallelism: int = 2,
) -> tuple[object, DataFrame]:
    """Cross-validate every point by R2 on the given fold column and refit the best one.

    Returns the fitted model and a table (point, params, r2).
    """
    estimator = build()
    maps = []
    for point in points:
        maps.append({estimator.getParam(k): v for k, v in _translated(point, names).items()})
    train = matrix.side("train")
    validator = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps or ParamGridBuilder().build(),
        evaluator=RegressionEvaluator(labelCol="y", metricName="r2"),
        numFolds=folds,
        foldCol=fold,
        parallelism=fits_at_a_time(train.count(), parallelism),
    )
    fitted = validator.fit(train)
    table = [
        (i, str(dict(point)), float(score))
        for i, (point, score) in enumerate(zip(points, fitted.avgMetrics))
    ]
    spark = matrix.df.sparkSession
    return fitted.bestModel, spark.createDataFrame(table, "point int, params string, r2 double")


def validation_surface(
    matrix: Matrix, depths: Sequence[int], parallelism: int = 8, in_tasks: bool = False, **params
) -> DataFrame:
    """R2 on both sides for each tree depth and number of trees: (depth, trees, split, r2).

    One fit per depth, all on one written matrix; several run at a time where the rows of so many fits can be held.
    ``in_tasks`` lets them grow inside tasks where a task can hold the rows: for many trees. The errors of all depths
    after every tree come from one pass over the matrix. R2 is NULL on a side without spread.
    """
    spark = matrix.df.sparkSession
    sides = {r["split"]: r for r in matrix.df.groupBy("split").agg(F.count("*").alias("n"), F.var_pop("y").alias("spread")).collect()}
    at_a_time = fits_at_a_time(sides["train"]["n"] if "train" in sides else 0, parallelism)

    settings = {d: ("train", {"max_depth": d, **params}) for d in depths}
    fitted = fit_boosted({"train": matrix.side("train")}, settings, at_a_time, in_tasks)
    errors = _errors_after_trees(matrix, fitted)
    return spark.createDataFrame(
        [
            (depth, trees, side, 1 - errors[side, depth, trees] / r["n"] / r["spread"] if r["spread"] else None)
            for depth, model in fitted.items()
            for side, r in sorted(sides.items())
            for trees in range(1, len(model.treeWeights) + 1)
        ],
        "depth int, trees int, split string, r2 double",
    )


def _errors_after_trees(matrix: Matrix, fitted: Mapping[int, object]) -> dict[tuple[str, int, int], float]:
    """Sum of squared errors per side, key of a boosted model and number of its trees; one Arrow pass over the matrix.

    Partitions are summed up in their order, so that the sums are the same on every run.
    """
    made = {key: _nodes_of(model) for key, model in fitted.items()}

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        errors: dict[str, np.ndarray] = {}
        part = 0
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            part = rows["_part"][0].as_py() if len(rows) else part
            for split in rows["split"].unique().to_pylist():
                own = rows.filter(pc.equal(rows["split"], split))
                x = pc.list_flatten(own["x"]).to_numpy().reshape(len(own), -1)
                rest, found = own["y"].to_numpy(), []
                for trees in made.values():
                    left = rest.copy()
                    for tree, weight in trees:
                        left -= weight * tree.predict(x)
                        found.append(left @ left)
                errors[split] = errors.get(split, 0.0) + np.array(found)
        table = {"split": list(errors), "_part": [part] * len(errors), "errors": [e.tolist() for e in errors.values()]}
        yield pa.RecordBatch.from_pydict(table, pa.schema([("split", pa.string()), ("_part", pa.int32()), ("errors", pa.list_(pa.float64()))]))

    rows = matrix.df.filter(F.col("split").isNotNull() & F.col("y").isNotNull()).select(
        "split", "y", vector_to_array("features").alias("x"), F.spark_partition_id().alias("_part")
    )
    names = [(key, trees) for key, model in made.items() for trees in range(1, len(model) + 1)]
    errors: dict[tuple[str, int, int], float] = {}
    for r in sorted(rows.mapInArrow(summed, "split string, _part int, errors array<double>").collect(), key=lambda r: r["_part"]):
        for at, error in zip(names, r["errors"], strict=True):
            errors[r["split"], *at] = errors.get((r["split"], *at), 0.0) + error
    return errors


def _nodes_of(model) -> list[tuple[Nodes, float]]:
    """The trees of a boosted model of Spark, and their weights."""
    if isinstance(model, PlainModel):
        trees = model.trees
    else:
        trees = (read_tree(t.toDebugString, range(model.numFeatures)) for t in model.trees)
    return [(nodes(t), float(w)) for t, w in zip(trees, model.treeWeights)]


def validation_curve(matrix: Matrix, depths: Sequence[int], **params) -> DataFrame:
    """R2 on both sides for each tree depth, with all trees."""
    surface = validation_surface(matrix, depths, **params)
    return surface.groupBy("depth", "split").agg(F.max_by("r2", "trees").alias("r2"))


def compare_models(matrix: Matrix, candidates: Mapping[str, object]) -> DataFrame:
    """Holdout metrics of several estimators on one prepared table."""
    from rillspark.operators.joins import append_frames

    tables = []
    for name, estimator in candidates.items():
        model = estimator.fit(matrix.side("train"))
        scored = model.transform(matrix.side("test"))
        tables.append(
            regression_metrics(scored, [], len(matrix.features)).withColumn("model", F.lit(name))
        )
    return append_frames(tables)


def ablation(
    df: DataFrame, features: Sequence[str], dropped: Sequence[str], target: str, estimator
) -> DataFrame:
    """Holdout metrics with all features and without the named ones."""
    from rillspark.operators.joins import append_frames

    tables = []
    for label, names in (
        ("all", list(features)),
        ("without", [f for f in features if f not in set(dropped)]),
    ):
        matrix = prepare(df, names, target)
        scored = estimator.fit(matrix.side("train")).transform(matrix.side("test"))
        tables.append(
            regression_metrics(scored, [], len(matrix.features)).select(
                F.lit(label).alias("features_used"),
                F.lit(len(matrix.features)).alias("features"), "n", "r2", "rmse",
            )
        )
    return append_frames(tables)


def score_submission(
    train: DataFrame,
    template: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    keys: Sequence[str],
    row_id: Sequence[str],
    build,
) -> DataFrame:
    """Fit one model per target on all labelled rows and predict the template rows.

    Medians come from all training rows, labelled or not, and scaling from the labelled ones; they
    apply to the template too. Predictions are clipped at 0, and the columns come out as the keys
    followed by the targets. The predictions of the targets are columns of one pass over the
    template, so its rows are neither joined nor matched by position.
    """
    medians = column_medians_exact(train, sketches(train, features))
    used = [f for f in features if medians[f] is not None]
    medians = {f: medians[f] for f in used}
    imputed = Preprocessor(medians, {}, {}).impute(train)
    scored = Preprocessor(medians, {}, {}).impute(template).select(*row_id, *used)
    labels = {t: F.col(f"`{t}`").isNotNull() & ~F.isnan(F.col(f"`{t}`").cast("double")) for t in targets}
    known = subset_sketches(imputed, {t: (labels[t], used) for t in targets})
    scalers = {t: scaler_of(known[t], medians) for t in targets}
    tables = {
        t: written_vectors(scalers[t].scale(imputed.filter(labels[t])), [F.col(f"`{t}`").cast("double").alias("y")], used)
        for t in targets
    }
    models = fit_each(tables, max((k.rows for own in known.values() for k in own.values()), default=0), lambda _: build())
    for target, model in models.items():
        own = scalers[target]
        model.setPredictionCol("_prediction")
        scaled = {
            f: (F.col(f) - F.lit(own.means[f])) / F.lit(own.stds[f] or 1.0) for f in used
        }
        inputs = [f"_in_{f}" for f in used]
        scored = VectorAssembler(inputCols=inputs, outputCol="features").transform(
            scored.withColumns({f"_in_{f}": x for f, x in scaled.items()})
        )
        scored = (
            model.transform(scored)
            .withColumn(target, clip_at_zero(F.col("_prediction")))
            .drop("_prediction", "features", *inputs)
        )
    return scored.select(*keys, *targets)


def lag_matrix(
    sequences: DataFrame, keys: Sequence[str], columns: Sequence[str], length: int
) -> tuple[DataFrame, list[str]]:
    """Flatten the history arrays into one column per (step back, feature)."""
    names = {
        f"{c}_lag{length - i}": F.col("x")[i][c] for i in range(length) for c in columns
    }
    flat = sequences.select(*keys, *(x.alias(n) for n, x in names.items()), "y")
    return flat, list(names)


def specialised_features(df: DataFrame, target: str) -> tuple[list[str], list[str], dict]:
    """Present features, missing features and parameters of a target's own model."""
    features, params = SPECIALISED[target]
    present, missing = pick_features(df, features)
    return present, missing, params
