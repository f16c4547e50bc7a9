import math
import random

import pytest
from pyspark.sql import functions as F

from rillspark.operators import numbering, split


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, 0 if i % 3 == 0 else rng.randint(1, 60), float(i)) for i in range(1000)]
    return spark.createDataFrame(data, "id long, site long, y double").cache()


def sides(df):
    return {r["id"]: r["split"] for r in df.collect()}


@pytest.mark.parametrize("fraction", [0.2, 0.3, 0.001, 1.0])
def test_random_split_has_the_exact_size(rows, fraction):
    marked = sides(split.random_split(rows, ["id"], fraction))
    assert sum(s == "test" for s in marked.values()) == math.ceil(fraction * 1000)


def test_split_does_not_depend_on_partitioning(rows):
    a = sides(split.random_split(rows, ["id"]))
    b = sides(split.random_split(rows.repartition(7).orderBy(F.rand(3)), ["id"]))
    assert a == b
    assert a != sides(split.random_split(rows, ["id"], seed=43))


@pytest.mark.parametrize("exact", [True, False])
def test_group_split_keeps_places_whole(rows, exact):
    marked = split.group_split(rows, ["site"], 0.2, exact=exact)
    check = split.groups_in_both(marked, ["site"]).first()
    assert check["groups_in_both"] == 0
    test_groups = marked.filter("split = 'test'").select("site").distinct().count()
    if exact:
        assert test_groups == math.ceil(0.2 * check["groups"])
    else:
        assert 0 < test_groups < check["groups"]


def test_exact_split_by_many_passes_and_equal_digests(rows, monkeypatch):
    plain = sides(split.random_split(rows, ["id"], 0.3))
    monkeypatch.setattr(split, "HEX_DIGITS", 1)
    monkeypatch.setattr(split, "RANKED_ROWS", 2)
    assert sides(split.random_split(rows, ["id"], 0.3)) == plain
    # One key in a third of all rows has one digest and stays whole.
    tests = split.random_split(rows, ["site"], 0.5).groupBy("site").agg(F.countDistinct("split").alias("n"))
    assert tests.filter("n > 1").isEmpty()
    assert sides(split.random_split(rows.limit(0), ["id"])) == {}


def test_leak_is_seen(rows):
    leaky = split.random_split(rows, ["id"])
    assert split.groups_in_both(leaky, ["site"]).first()["groups_in_both"] > 0


def test_k_fold_is_even(rows):
    folds = split.k_fold(rows, ["id"], 3).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in folds) == [0, 1, 2]
    assert all(250 < r["count"] < 420 for r in folds)


def folds_of(df, k=3):
    out = split.group_k_fold(df, ["site"], k)
    assert out.count() == df.count()
    assert out.groupBy("site").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    return {r["site"]: r["fold"] for r in out.collect()}


def test_group_k_fold_deals_largest_first(rows):
    sizes = {r["site"]: r["count"] for r in rows.groupBy("site").count().collect()}
    totals, want = [0, 0, 0], {}
    for site in sorted(sizes, key=lambda s: (-sizes[s], s)):
        fold = totals.index(min(totals))
        want[site] = fold
        totals[fold] += sizes[site]
    assert folds_of(rows) == want


def test_group_k_fold_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "b")], "id int, site string")
    got = {r["id"]: r["fold"] for r in split.group_k_fold(df, ["site"], 2).collect()}
    assert got == {2: 0, 3: 0, 1: 1, 4: 1}


def test_group_k_fold_numbered_over_many_tasks(rows, monkeypatch):
    want = folds_of(rows)
    monkeypatch.setattr(numbering, "ONE_TASK_ROWS", 5)
    assert folds_of(rows) == want


@pytest.mark.parametrize("k", [2, 3, 5])
def test_dealing_by_size_equals_dealing_one_by_one(k):
    rng = random.Random(k)
    for _ in range(200):
        sizes = [rng.choice([1, 1, 2, 3, 5, 50]) for _ in range(rng.randint(1, 60))]
        sizes = sorted([*sizes, rng.randint(1, 200)], reverse=True)
        totals, want = [0] * k, []
        for size in sizes:
            fold = totals.index(min(totals))
            totals[fold] += size
            want.append(fold)
        classes = [(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)]
        phases = split._deal(classes, k)
        got = []
        for i, (size, start, turn) in enumerate(phases):
            same = i + 1 < len(phases) and phases[i + 1][0] == size
            end = phases[i + 1][1] if same else dict(classes)[size]
            got += [turn[j % len(turn)] for j in range(end - start)]
        assert got == want


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.8, 1.0])
def test_sequential_split(spark, fraction):
    import datetime as dt

    data = [
        (i, 0 if i % 3 == 0 else i % 7, dt.datetime(2020, 1, 1) + dt.timedelta(hours=(i * 37) % 500))
        for i in range(500)
    ]
    df = spark.createDataFrame(data, "id int, s long, t timestamp_ntz")
    got = sides(split.sequential_split(df, "s", "t", fraction))
    ordered = sorted(data, key=lambda r: (r[1], r[2]))
    cut = int(500 * fraction)
    assert got == {r[0]: "train" if i < cut else "test" for i, r in enumerate(ordered)}
