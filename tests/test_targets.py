"""Several targets of one table: splits, statistics and vectors agree with those of each target by itself."""

import pytest
from pyspark.sql import functions as F

from rillspark.operators import models, prep, quantiles, split
from rillspark.plans import evaluation

TARGETS = ["u", "v"]


@pytest.fixture(scope="module")
def rows(spark):
    made = [
        (i, i % 37 if i % 50 else None, float(i % 11) if i % 3 else None, float("nan") if i == 7 else float(i * 7 % 101) if i % 4 else None,
         float(i * i % 53) if i % 5 else None, i % 13)
        for i in range(400)
    ]
    return spark.createDataFrame(made, "id long, site long, u double, v double, x double, k long").repartition(3).localCheckpoint()


@pytest.mark.parametrize("row_key", [None, ["id"]])
def test_splits_of_all_targets_are_those_of_each(rows, row_key):
    marked, names = split.target_splits(rows, TARGETS, ["site"], row_key)
    for target in TARGETS:
        has = F.col(target).isNotNull()
        alone = rows.filter(has)
        alone = split.random_split(alone, row_key) if row_key else split.group_split(alone, ["site"])
        got = marked.filter(has).select("id", F.col(names[target]).alias("split"))
        assert sorted(got.collect()) == sorted(alone.select("id", "split").collect())


def test_crowded_ranges_and_targets_without_rows(rows, monkeypatch):
    monkeypatch.setattr(split, "RANKED_ROWS", 0)
    marked, names = split.target_splits(rows.withColumn("none", F.lit(None).cast("double")), ["u", "none"], row_key=["id"])
    alone = split.random_split(rows.filter("u is not null"), ["id"])
    got = marked.filter("u is not null").select("id", F.col(names["u"]).alias("split"))
    assert sorted(got.collect()) == sorted(alone.select("id", "split").collect())
    assert {r[0] for r in marked.select(names["none"]).collect()} == {"train"}


@pytest.mark.parametrize("spanned", [400_000, 10])
def test_statistics_of_subsets_are_those_of_their_rows(rows, spanned, monkeypatch):
    monkeypatch.setattr(quantiles, "SPANNED_ROWS", spanned)
    subsets = {"u": (F.col("u").isNotNull(), ["x", "k"]), "v": (F.col("v") > 20, ["k"]), "all": (None, ["x"]), "no": (F.lit(False), ["x"])}
    found = prep.fit_subsets(rows, subsets)
    for name, (condition, features) in subsets.items():
        alone = prep.fit_preprocessor(rows if condition is None else rows.filter(condition), features)
        assert found[name].medians == alone.medians
        for kind in ("means", "stds"):
            got, expected = getattr(found[name], kind), getattr(alone, kind)
            assert got == {c: e if e is None else pytest.approx(e, rel=1e-12) for c, e in expected.items()}


def test_matrices_of_all_targets_are_those_of_each(rows):
    marked = split.group_split(rows, ["site"])
    made = models.prepare_targets(marked, {"u": ["x", "k"], "v": ["k"]}, dict.fromkeys(TARGETS, "split"), keep=["id"])
    for target, features in (("u", ["x", "k"]), ("v", ["k"])):
        alone = models.prepare(marked, features, target, keep=["id"])
        got, expected = (sorted(m.df.collect(), key=lambda r: r["id"]) for m in (made[target], alone))
        assert [(r["id"], r["y"], r["split"]) for r in got] == [(r["id"], r["y"], r["split"]) for r in expected]
        assert all(a["features"].toArray() == pytest.approx(b["features"].toArray()) for a, b in zip(got, expected))
        assert made[target].train_rows == made[target].side("train").count()


def test_targets_share_the_passes_over_the_table(rows, monkeypatch):
    """One pass of all targets; it had been one per target."""
    passes, run = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **b: passes.append(1) or run(self, *a, **b))
    found = evaluation.evaluate_targets(rows, ["x", "k"], TARGETS, models.boosted_trees(n_estimators=1, max_depth=2), place=["site"])
    assert {r["target"] for r in found.collect()} == set(TARGETS)
    assert len(passes) == 1


def test_fits_run_together_only_while_their_rows_can_be_held(rows, monkeypatch):
    marked = split.group_split(rows, ["site"])
    matrices = models.prepare_targets(marked, dict.fromkeys(TARGETS, ["x", "k"]), dict.fromkeys(TARGETS, "split"))
    asked = []
    monkeypatch.setattr(models, "fits_at_a_time", lambda n, wanted: asked.append((n, wanted)) or 1)
    fitted = models.fit_targets(matrices, lambda _: models.boosted_trees(n_estimators=1, max_depth=2))
    assert list(fitted) == TARGETS
    assert asked == [(max(m.train_rows for m in matrices.values()), 2)]
