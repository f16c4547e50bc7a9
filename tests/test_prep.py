import datetime as dt

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from rillspark.operators import columns, joins, metrics, numbering, prep


def test_one_hot_drops_first_and_zeroes_missing(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, k string")
    out = {r["id"]: r["k_b"] for r in prep.one_hot(df).collect()}
    assert out == {1: 1, 2: 0, 3: 0}
    assert prep.one_hot(df).columns == ["id", "k_b"]


def test_too_many_categories_is_an_error(spark):
    df = spark.createDataFrame([(str(i),) for i in range(9)], "k string")
    with pytest.raises(ValueError):
        prep.categories(df, "k", limit=8)


def test_factorize_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, k string")
    got = {r["id"]: r["k_code"] for r in prep.factorize(df, "k", "id").collect()}
    assert got == {1: 0, 2: 1, 3: -1, 4: 0}


def test_label_codes_follow_the_text(spark):
    df = spark.createDataFrame([(1, "z"), (2, "a"), (3, None), (4, "z")], "id int, k string")
    got = {r["id"]: r["k_code"] for r in prep.label_encode(df, "k").collect()}
    assert got == {1: 2, 2: 0, 3: 1, 4: 2}


def test_numbering_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ONE_TASK_ROWS", 10)
    values = spark.range(5000).select((F.col("id") * 37 % 5000).alias("v")).repartition(9)
    out = numbering.numbered(values, ["v"], "n")
    assert out.filter("v <> n").count() == 0
    assert out.count() == 5000


def test_encode_all(spark):
    df = spark.createDataFrame(
        [(1.5, dt.date(2020, 2, 3), "x", [1.0])], "y double, d date, k string, a array<double>"
    )
    out = prep.encode_all(df, ["y"])
    assert out.columns == ["y", "d_year", "d_month", "d_day", "k"]
    assert tuple(out.first()) == (1.5, 2020, 2, 3, 0)


@pytest.fixture
def split_rows(spark):
    rows = [("train", 1.0, 5.0), ("train", 2.0, 5.0), ("train", 4.0, 5.0), ("train", 10.0, None),
            ("test", None, None), ("test", 1000.0, 7.0)]
    return spark.createDataFrame(rows, "split string, x double, c double")


def test_statistics_come_from_the_training_side(split_rows):
    fitted = prep.fit_on(split_rows, ["x", "c"])
    assert fitted.medians == {"x": 3.0, "c": 5.0}
    assert fitted.stds["x"] == pytest.approx(3.491060010942235)
    filled = fitted.impute(split_rows).filter("split = 'test'").orderBy("x").collect()
    assert [(r["x"], r["c"]) for r in filled] == [(3.0, 5.0), (1000.0, 7.0)]


def test_constant_feature_is_only_centred(split_rows):
    scaled = prep.fit_on(split_rows, ["x", "c"]).transform(split_rows)
    assert {r["c"] for r in scaled.filter("split = 'train'").collect()} == {0.0}


def test_location_mean_ignores_the_test_side(spark):
    rows = [("a", "train", 1.0), ("a", "train", 3.0), ("a", "test", 100.0), ("b", "test", 7.0)]
    df = spark.createDataFrame(rows, "site string, split string, y double")
    out = prep.location_mean(df, ["site"], "y", "m").collect()
    assert {(r["site"], r["split"]): r["m"] for r in out} == {
        ("a", "train"): 2.0, ("a", "test"): 2.0, ("b", "test"): 2.0
    }


def test_duplicate_feature_rows_multiply_the_sample(spark):
    samples = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id int, lat double")
    bands = spark.createDataFrame([(1.0, 5.0), (1.0, 6.0)], "lat double, red double")
    assert joins.enrich(samples, [bands], ["lat"]).count() == 3
    assert joins.duplicate_keys(bands, ["lat"]).first()["rows"] == 2


def test_missing_keys_do_not_match_but_stay(spark):
    samples = spark.createDataFrame([(1, None)], "id int, d date")
    bands = spark.createDataFrame([(None, 5.0)], "d date, red double")
    assert joins.enrich(samples, [bands], ["d"]).first()["red"] is None


def test_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b double")
    assert columns.drop_null_columns(df).columns == ["a"]


def test_r2_is_not_a_squared_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "y double, prediction double")
    row = metrics.regression_metrics(df, [], features=2).first()
    assert row["r2"] == pytest.approx(-6.0)
    assert row["adj_r2"] is None
    assert row["n"] == 3


def test_r2_of_constant_values_is_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, prediction double")
    assert metrics.regression_metrics(df, []).first()["r2"] is None


def test_top_k_and_best(spark):
    df = spark.createDataFrame(
        [("t", "a", 1.0), ("t", "b", 3.0), ("t", "c", 3.0), ("u", "a", 0.5)],
        "target string, feature string, score double",
    )
    top = metrics.top_k(df, ["target"], "score", 2, ["feature"]).collect()
    assert sorted((r["target"], r["rank"], r["feature"]) for r in top) == [
        ("t", 1, "b"), ("t", 2, "c"), ("u", 1, "a")
    ]
    worst = metrics.best_per_group(df, ["target"], "score", largest=False).collect()
    assert {r["target"]: r["feature"] for r in worst} == {"t": "a", "u": "a"}


def test_sparse_one_hot_keeps_the_rules(spark, monkeypatch):
    monkeypatch.setattr(numbering, "ONE_TASK_ROWS", 3)
    rows = [(1, "b", "x"), (2, "a", None), (3, None, "x"), (4, "c", "x"), (5, "b", "x"), (6, "d", "x")]
    df = spark.createDataFrame(rows, "id int, k string, one string")
    made, known = prep.one_hot_sparse(df)
    got = {r["id"]: r["encoded"] for r in made.collect()}
    assert {i: v.toArray().tolist() for i, v in got.items()} == {
        1: [1, 0, 0], 2: [0, 0, 0], 3: [0, 0, 0], 4: [0, 1, 0], 5: [1, 0, 0], 6: [0, 0, 1]
    }
    assert sorted(map(tuple, known.collect()), key=str) == sorted(
        [("k", "a", None), ("k", "b", 0), ("k", "c", 1), ("k", "d", 2), ("one", "x", None)], key=str
    )
    dense = {r["id"]: [r["k_b"], r["k_c"], r["k_d"]] for r in prep.one_hot(df).collect()}
    assert dense == {i: v.toArray().tolist() for i, v in got.items()}
    hollow, none = prep.one_hot_sparse(df.limit(0))
    assert hollow.count() == 0 and none.count() == 0 and hollow.columns == ["id", "encoded"]
    fitted = LinearRegression(featuresCol="encoded", labelCol="id", regParam=0.1).fit(made)
    assert fitted.numFeatures == 3


def test_sparse_one_hot_of_many_categories(spark):
    df = spark.range(300_000).select("id", F.concat(F.lit("v"), F.format_string("%06d", "id")).alias("k"))
    made, _ = prep.one_hot_sparse(df)
    last = made.filter("id = 299999").first()["encoded"]
    assert (last.size, list(last.indices), list(last.values)) == (299_999, [299_998], [1.0])
