"""Boosted trees with penalised leaves, and a search that scores every number of trees (M1, M4, M5).

Searches grow their models inside tasks, many side by side (``growing``), where a task can hold the table. Else
Spark's regression tree finds the splits of each round, and the values of its leaves come from one
aggregation by leaf. Either way a round yields the errors of every side after it, so the score at each
number of trees costs no further pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rillspark.operators import growing
from rillspark.operators.growing import SAMPLES
from rillspark.operators.trees import Fork, Leaf, Nodes, Sums, forks, nodes, read_tree, values_of_places
from rillspark.session import discard, durable

# A tree becomes one nested expression with up to 2^depth leaves.
DEEPEST = 12
# Predictions so far are written down after as many trees, which keeps the plan short.
TREES_PER_WRITE = 8
# Numbers of a table that the driver collects and every task then holds: 64 MB.
HELD_NUMBERS = 8_000_000
# Rows that the fits that run at a time may hold together: some 5 GB.
HELD_ROWS = 30_000_000


def fits_at_a_time(rows: int, wanted: int) -> int:
    """How many fits run at a time: each holds its rows in the executors' memory until it is done."""
    return max(1, min(wanted, HELD_ROWS // max(rows, 1)))


def expression(tree: Fork | Leaf, x: Column, of_leaf) -> Column:
    """What ``of_leaf`` says about the leaf that array ``x`` falls into."""
    if isinstance(tree, Leaf):
        return F.lit(of_leaf(tree))
    return F.when(
        x[tree.feature] <= tree.threshold, expression(tree.left, x, of_leaf)
    ).otherwise(expression(tree.right, x, of_leaf))


def _added(columns: Sequence[Column]) -> Column:
    """Sum whose nesting grows with the logarithm of the number of terms."""
    if len(columns) == 1:
        return columns[0]
    middle = len(columns) // 2
    return _added(columns[:middle]) + _added(columns[middle:])


@dataclass(frozen=True)
class PenalisedTrees:
    """Gradient boosting on squared errors, with penalties on leaf values.

    A leaf with n rows and residual sum S has the value sign(S) max(|S| - reg_alpha, 0) /
    (n + reg_lambda). From the leaves up, a fork whose two leaves improve the penalised loss by less
    than ``gamma`` becomes a leaf. Forks themselves are Spark's: they reduce the variance of
    residuals and know of no penalty. ``subsample`` draws rows per tree by a hash of written row
    numbers, ``colsample_bytree`` draws features per tree. Rows without y take no part; of a table
    without rows the model predicts 0.
    """

    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 3
    min_child_weight: int = 1
    subsample: float = 1.0
    colsample_bytree: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    random_state: int = 42

    def __post_init__(self):
        if not 0 <= self.max_depth <= DEEPEST:
            raise ValueError(f"max_depth must be 0 to {DEEPEST}")
        if not (0 < self.subsample <= 1 and 0 < self.colsample_bytree <= 1):
            raise ValueError("subsample and colsample_bytree must be above 0 and at most 1")

    def fit(self, df: DataFrame) -> PenalisedModel:
        return Growth(self, written(df)).grow(self.n_estimators).model()

    def fit_in_task(self, df: DataFrame) -> PenalisedModel:
        """As ``fit``, but inside a task where one can hold the rows: for many trees."""
        rows = written(df)
        sides = _sides(rows, None)
        together = side_by_side(rows, [self], None, [None], [sides])
        if together is None:
            return Growth(self, rows, found=sides).grow(self.n_estimators).model()
        together.grow([(0, 0)], self.n_estimators)
        return together.models[0, 0].model()

    def rate(self, number: int) -> float:
        return self.learning_rate

    def columns(self, seed: int, features: int) -> tuple[list[int], None]:
        return growing.drawn_columns(seed, self.colsample_bytree, features), None

    def leaf_value(self, sums: Sums) -> float:
        size = max(abs(sums.total) - self.reg_alpha, 0.0)
        weight = sums.n + self.reg_lambda
        return float(np.copysign(size, sums.total) / weight) if weight > 0 else 0.0

    def _strength(self, sums: Sums) -> float:
        """Twice the penalised loss that the leaf value saves."""
        return abs(self.leaf_value(sums)) * max(abs(sums.total) - self.reg_alpha, 0.0)

    def refit(self, tree: Fork | Leaf, sums: Mapping[int, Sums]) -> tuple[Fork | Leaf, Sums]:
        """The tree with penalised values and folded forks, and the sums of its rows."""
        if isinstance(tree, Leaf):
            own = sums.get(tree.place, Sums())
            return Leaf(tree.place, self.leaf_value(own)), own
        left, of_left = self.refit(tree.left, sums)
        right, of_right = self.refit(tree.right, sums)
        own = of_left + of_right
        gain = (self._strength(of_left) + self._strength(of_right) - self._strength(own)) / 2
        if isinstance(left, Leaf) and isinstance(right, Leaf) and gain < self.gamma:
            return Leaf(left.place, self.leaf_value(own)), own
        return Fork(tree.feature, tree.threshold, left, right, gain), own


def numbered(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The labelled rows with a number and their features as an array."""
    return df.filter(F.col("y").isNotNull()).select(
        *keep, "y", "features", vector_to_array("features").alias("_x"),
        F.monotonically_increasing_id().alias("_row"),
    )


def written(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The numbered rows as a written table."""
    return durable(numbered(df, keep))


def with_prediction(df: DataFrame, base: float, trees: Sequence[tuple[Nodes, float]]) -> DataFrame:
    """Add ``prediction``: the base and the values of all trees, each by its weight."""

    @F.pandas_udf("double")
    def predicted(x: pd.Series) -> pd.Series:
        made = np.full(len(x), base)
        if trees and len(x):
            rows = np.stack(x.to_numpy())
            for tree, weight in trees:
                made += weight * tree.predict(rows)
        return pd.Series(made)

    return df.withColumn("prediction", predicted(vector_to_array("features")))


@dataclass
class PlainModel:
    """Trees of Spark's boosting that were grown inside a task."""

    trees: list
    treeWeights: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``."""
        return with_prediction(df, 0.0, [(nodes(t), w) for t, w in zip(self.trees, self.treeWeights, strict=True)])


def fit_plain(tables: Mapping[str, DataFrame], settings: Mapping[object, tuple[str, growing.PlainTrees]]) -> dict[object, PlainModel] | None:
    """The model of every key, of a named table and settings, where a task can hold all tables; else None."""
    rows = {name: numbered(df) for name, df in tables.items()}
    sides = {name: _sides(df, None).get(False) for name, df in rows.items()}
    if not all(sides.values()) or sum(s["n"] * (s["width"] + 4) for s in sides.values()) > HELD_NUMBERS:
        return None
    folds = {name: growing.collected(df).without() for name, df in rows.items()}
    spark = next(iter(tables.values())).sparkSession
    jobs = [(key, params, name, 0.0, []) for key, (name, params) in settings.items()]
    found = _grown_in_tasks(spark, folds, [(*job, job[1].n_estimators) for job in jobs])
    return {key: PlainModel(made, [settings[key][1].rate(i) for i in range(len(made))]) for key, made, _ in found}


def _grown_in_tasks(spark: SparkSession, folds: Mapping, jobs: Sequence[tuple]) -> list[tuple]:
    """(key, new trees, errors after each) of jobs (key, settings, name of a fold, base, trees so far, trees wanted).

    One task per model; the deepest come first, as they take longest.
    """
    if not jobs:
        return []
    shared = spark.sparkContext.broadcast(dict(folds))

    def grown(job: tuple) -> tuple:
        key, params, fold, base, known, wanted = job
        return key, *growing.grow(params, shared.value[fold], base, known, wanted)

    ordered = sorted(jobs, key=lambda job: -job[1].max_depth)
    made = spark.sparkContext.parallelize(ordered, len(ordered)).map(grown).collect()
    shared.destroy()
    return made


@dataclass
class PenalisedModel:
    base: float
    rate: float
    trees: list
    features: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``."""
        return with_prediction(df, self.base, [(nodes(t), self.rate) for t in self.trees])

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gains of all forks."""
        gains = np.zeros(self.features)
        for tree in self.trees:
            for fork in forks(tree):
                gains[fork.feature] += max(fork.gain, 0.0)
        return DenseVector(gains / gains.sum() if gains.sum() > 0 else gains)


# The name that callers know.
_forks = forks


def _held(held: Column | None) -> Column:
    return F.lit(False) if held is None else F.coalesce(held, F.lit(False))


def _sides(rows: DataFrame, held: Column | None) -> dict[bool, Row]:
    """Number of rows, mean and spread of y and number of features of training (False) and held rows (True)."""
    sums = rows.groupBy(_held(held).alias("_held")).agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("spread"),
        F.max(F.size("_x")).alias("width"),
    )
    return {r["_held"]: r for r in sums.collect()}


class Grown:
    """A model that grows tree by tree; ``found`` is what ``_sides`` says of its rows.

    ``curve`` holds (mean squared error of training rows, of held rows) after 0, 1, ... trees.
    """

    def __init__(self, params: PenalisedTrees, found: Mapping):
        self.params = params
        train = found.get(False)
        self.base = train["mean"] if train else 0.0
        self.features = train["width"] if train else 0
        self.held_spread = found[True]["spread"] if True in found else None
        self.trees: list = []
        self.curve = [tuple(
            found[side]["spread"] + (found[side]["mean"] - self.base) ** 2 if side in found else None
            for side in (False, True)
        )]

    def model(self) -> PenalisedModel:
        return PenalisedModel(self.base, self.params.learning_rate, list(self.trees), self.features)

    def best(self) -> tuple[int, float | None]:
        """Number of trees with the best R2 on held rows, and that R2; None without spread."""
        if not self.held_spread:
            return len(self.trees), None
        errors = [held for _, held in self.curve]
        at = int(np.argmin(errors))
        return at, 1 - errors[at] / self.held_spread


class SideBySide:
    """Models that grow inside tasks, one per task: a list of settings, each with every one of some folds held out."""

    def __init__(self, spark: SparkSession, folds: Mapping[int, growing.Fold], models: Mapping[tuple[int, int], Grown]):
        self.spark, self.folds, self.models = spark, folds, models

    def grow(self, wanted: Sequence[tuple[int, int]], trees: int) -> None:
        """Go on with the given models to the given number of trees."""
        jobs = [
            (at, m.params, at[1], m.base, list(m.trees), trees) for at in wanted if (m := self.models[at]).features
        ]
        for at, made, errors in _grown_in_tasks(self.spark, self.folds, jobs):
            self.models[at].trees += made
            self.models[at].curve += errors


def side_by_side(
    rows: DataFrame, settings: Sequence[PenalisedTrees], fold: str | None, folds: Sequence, sides: Sequence[Mapping]
) -> SideBySide | None:
    """The models of all settings with each of the folds held out, where a task can hold the rows; else None.

    ``sides`` is what ``_sides`` says of each fold.
    """
    numbers = max((sum(s["n"] * (s["width"] + 4) for s in found.values()) for found in sides), default=0)
    if numbers > HELD_NUMBERS:
        return None
    table = growing.collected(rows, fold)
    models = {(i, k): Grown(p, found) for i, p in enumerate(settings) for k, found in enumerate(sides)}
    return SideBySide(rows.sparkSession, {i: table.without(k) for i, k in enumerate(folds)}, models)


class Growth(Grown):
    """A model whose rounds are jobs of Spark, on the rows where ``held`` is false or null.

    ``found`` is what ``_sides`` says of the rows, where it is known already.
    """

    def __init__(self, params: PenalisedTrees, rows: DataFrame, held: Column | None = None, found: Mapping | None = None):
        super().__init__(params, _sides(rows, held) if found is None else found)
        self._rows = rows.withColumn("_held", _held(held)).withColumn("_p", F.lit(self.base))
        self._own: DataFrame | None = None
        self._unwritten: list = []

    def grow(self, trees: int) -> Growth:
        """Go on to the given number of trees."""
        while len(self.trees) < trees and self.features:
            self._add_tree()
        return self

    def _predicted(self) -> Column:
        rate = self.params.learning_rate
        steps = [expression(t, F.col("_x"), lambda leaf: leaf.value * rate) for t in self._unwritten]
        return _added([F.col("_p"), *steps])

    def _add_tree(self) -> None:
        p, number = self.params, len(self.trees)
        seed = growing.tree_seed(p.random_state, number)
        if len(self._unwritten) == TREES_PER_WRITE:
            before, self._own = self._own, durable(self._rows.withColumn("_p", self._predicted()))
            self._rows, self._unwritten = self._own, []
            if before is not None:  # or a table per write would pile up
                discard(before)
        coin = F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(SAMPLES))
        drawn = ~F.col("_held") & (coin < round(p.subsample * SAMPLES))
        rows = self._rows.withColumns({"_r": F.col("y") - self._predicted(), "_drawn": drawn})

        columns = growing.drawn_columns(seed, p.colsample_bytree, self.features)
        sample = rows.filter("_drawn")
        if len(columns) < self.features:
            sample = VectorSlicer(inputCol="features", outputCol="_f", indices=columns).transform(sample)
        else:
            sample = sample.withColumn("_f", F.col("features"))
        if p.subsample < 1 and sample.isEmpty():  # nothing drawn: a tree of one leaf without effect
            shape: Fork | Leaf = Leaf(0)
        else:
            fitted = DecisionTreeRegressor(
                labelCol="_r", featuresCol="_f", maxDepth=p.max_depth, seed=seed,
                minInstancesPerNode=max(1, int(p.min_child_weight)),
            ).fit(sample.select("_r", "_f"))
            shape = read_tree(fitted.toDebugString, columns)

        leaf = expression(shape, F.col("_x"), lambda leaf: leaf.place)
        sums: dict[tuple, Sums] = {}
        for r in (
            rows.groupBy(leaf.alias("leaf"), "_held", "_drawn")
            .agg(F.count("*").alias("n"), F.sum("_r").alias("s"), F.sum(F.col("_r") * F.col("_r")).alias("q"))
            .collect()
        ):
            sums[r["leaf"], r["_held"], r["_drawn"]] = Sums(r["n"], r["s"], r["q"])
        of_leaf = {at: s for (at, _, drawn), s in sums.items() if drawn}
        tree, _ = p.refit(shape, of_leaf)
        value = values_of_places(shape, tree)
        errors = []
        for side in (False, True):
            mine = [(at, s) for (at, held, _), s in sums.items() if held == side]
            n = sum(s.n for _, s in mine)
            lost = sum(s.error_after(p.learning_rate * value[at]) for at, s in mine)
            errors.append(lost / n if n else None)
        self.curve.append(tuple(errors))
        self.trees.append(tree)
        self._unwritten.append(tree)


@dataclass
class Search:
    """Outcome of a halving search: the table (point, params, trees, n_estimators, r2)."""

    best: PenalisedTrees
    rows: list[tuple] = field(repr=False)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.rows, "point int, params string, trees int, n_estimators int, r2 double"
        )


def halving_search(
    train: DataFrame,
    points: Sequence[Mapping],
    trees: Sequence[int],
    fold: str = "fold",
    folds: int = 3,
    keep: float = 1 / 3,
    parallelism: int = 4,
) -> Search:
    """Search by successive halving over numbers of trees, scored by mean R2 over folds.

    All points grow to ``trees[0]`` trees, the best ``keep`` of them on to ``trees[1]``, and so on;
    growing goes on where it stopped. A point's score is that of its best number of trees up to
    then, the same for all folds. All folds read one written table. Ties go to the earlier point;
    points without a score come last.
    """
    rows = written(train, [fold])
    known = {f.name for f in fields(PenalisedTrees)}
    for point in points:
        if set(point) - known:
            raise ValueError(f"unknown parameters: {sorted(set(point) - known)}")
    settings = [replace(PenalisedTrees(), **point) for point in points]
    if not settings or not trees:
        raise ValueError("a search needs points and numbers of trees")

    threaded = inheritable_thread_target(train.sparkSession)
    jobs = [(i, k) for i in range(len(settings)) for k in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        sides = list(pool.map(threaded(lambda k: _sides(rows, F.col(fold) == k)), range(folds)))
    together = side_by_side(rows, settings, fold, range(folds), sides)
    if together:
        grown: Mapping[tuple[int, int], Grown] = together.models
    else:
        grown = {(i, k): Growth(settings[i], rows, F.col(fold) == k, sides[k]) for i, k in jobs}
    most = max((s[False]["n"] for s in sides if False in s), default=0)
    with ThreadPoolExecutor(fits_at_a_time(most, parallelism)) as pool:
        scores: dict[int, tuple[int, float | None]] = {}
        left = list(range(len(settings)))
        for wanted in trees:
            todo = [(i, k) for i in left for k in range(folds)]
            if together:
                together.grow(todo, wanted)
            else:
                list(pool.map(threaded(lambda at: grown[at].grow(wanted)), todo))
            for i in left:
                scores[i] = _mean_best([grown[i, k] for k in range(folds)])
            left.sort(key=lambda i: _order(i, scores[i][1]))
            if wanted != trees[-1]:
                left = left[: max(1, round(len(left) * keep))]
    first = left[0]
    rows_out = [
        (i, str(dict(points[i])), len(grown[i, 0].trees), scores[i][0], scores[i][1])
        for i in range(len(settings))
    ]
    return Search(replace(settings[first], n_estimators=scores[first][0]), rows_out)


def _order(point: int, score: float | None) -> tuple:
    return (score is None, -(score or 0.0), point)


def _mean_best(grown: Sequence[Grown]) -> tuple[int, float | None]:
    """Number of trees with the best mean R2 over the folds that have one, and that mean."""
    usable = [g for g in grown if g.held_spread and g.features]
    if not usable:
        return len(grown[0].trees), None
    r2 = np.mean([[1 - held / g.held_spread for _, held in g.curve] for g in usable], axis=0)
    at = int(np.argmax(r2))
    return at, float(r2[at])
