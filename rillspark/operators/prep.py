"""Encoding and preprocessing."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.functions.dates import with_date_parts
from rillspark.operators.columns import categorical_columns
from rillspark.operators.numbering import numbered
from rillspark.operators.quantiles import Sketch, Subsets, subset_medians, subset_sketches
from rillspark.session import durable, working_folder


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def categories(df: DataFrame, column: str, limit: int | None = None) -> list[str]:
    """Sorted distinct values; more than a caller's ``limit`` is an error. They become columns."""
    values = df.select(_quoted(column)).filter(_quoted(column).isNotNull()).distinct()
    rows = (values if limit is None else values.limit(limit + 1)).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} categories")
    return sorted(row[0] for row in rows)


def one_hot(
    df: DataFrame, columns: Sequence[str] | None = None, values: dict[str, list[str]] | None = None
) -> DataFrame:
    """0/1 column per category but the first; a missing value is all zeros."""
    columns = categorical_columns(df) if columns is None else list(columns)
    flags = {}
    for column in columns:
        known = values[column] if values else categories(df, column)
        for v in known[1:]:
            flags[f"{column}_{v}"] = F.coalesce((_quoted(column) == v).cast("int"), F.lit(0))
    kept = [_quoted(c) for c in df.columns if c not in columns and c not in flags]
    return df.select(*kept, *(flag.alias(name) for name, flag in flags.items()))


def one_hot_sparse(
    df: DataFrame, columns: Sequence[str] | None = None, name: str = "encoded"
) -> tuple[DataFrame, DataFrame]:
    """One sparse vector instead of a column per category, for columns of any number of categories.

    Returns the rows, their categorical columns replaced by the vector ``name``, and the categories:
    column, value and place (in the vector; null for the first value of a column, which is all zeros, as a missing one is).
    Values are sorted, columns follow one another. Categories are numbered and looked up by Spark; only the
    number of categories per column comes to the driver.
    """
    columns = categorical_columns(df) if columns is None else list(columns)
    kept = [_quoted(c) for c in df.columns if c not in columns and c != name]
    coded, known, width = df, None, 0
    for i, column in enumerate(columns):
        found = df.select(_quoted(column).alias("value")).filter("value is not null").distinct()
        found = durable(numbered(found, ["value"], "_code"))
        n = found.count()
        place = F.when(F.col("_code") > 0, F.col("_code") - 1 + width)
        mine = found.select(F.lit(column).alias("column"), "value", place.alias("place"))
        known = mine if known is None else known.unionByName(mine)
        coded = coded.join(
            mine.select(F.col("value").alias(f"_value_{i}"), F.col("place").alias(f"_place_{i}")),
            _quoted(column) == F.col(f"_value_{i}"), "left",
        )
        width += max(n - 1, 0)
    places = F.array_compact(F.array(*(F.col(f"_place_{i}") for i in range(len(columns)))))
    # The layout of a sparse vector; read back under the type of vectors, it is one.
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(width).alias("size"),
        places.cast("array<int>").alias("indices"),
        F.transform(places, lambda _: F.lit(1.0)).alias("values"),
    )
    plain = coded.select(*kept, vector.alias(name))
    path = f"{working_folder(df.sparkSession)}/vectors"
    plain.write.parquet(path)
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField(name, VectorUDT())])
    nothing = df.sparkSession.createDataFrame([], "column string, value string, place long")
    return df.sparkSession.read.schema(schema).parquet(path), known if known is not None else nothing


def factorize(df: DataFrame, column: str, order: str, name: str | None = None) -> DataFrame:
    """Codes in order of first appearance by ``order``, then of the value; a missing one is -1."""
    name = name or f"{column}_code"
    seen = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min(order).alias("_first"))
    )
    codes = numbered(seen, ["_first", column], name).drop("_first")
    return df.join(codes, column, "left").select(
        *df.columns, F.coalesce(name, F.lit(-1)).cast("long").alias(name)
    )


def label_encode(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """Codes in sorted order of the text; a missing value counts as the text "nan"."""
    name = name or f"{column}_code"
    text = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    keyed = df.withColumn("_text", text)
    codes = numbered(keyed.select("_text").distinct(), ["_text"], name)
    return keyed.join(codes, "_text").select(*df.columns, name)


def encode_all(df: DataFrame, targets: Sequence[str] = ()) -> DataFrame:
    """Make every column numeric.

    Dates become year, month and day; text becomes label codes; what cannot be encoded goes.
    """
    texts, gone = [], []
    for field in df.schema.fields:
        name, kind = field.name, field.dataType
        if name in targets or isinstance(kind, T.NumericType | T.BooleanType):
            continue
        if isinstance(kind, T.StringType):
            texts.append(name)
            continue
        gone.append(name)
        if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            df = with_date_parts(df, name)
    # Codes come from the input itself, so no column's codes wait for the join of another's.
    codes = {
        name: numbered(
            df.select(F.coalesce(_quoted(name), F.lit("nan")).alias(f"_text_{i}")).distinct(),
            [f"_text_{i}"],
            f"_code_{i}",
        )
        for i, name in enumerate(texts)
    }
    order = [c for c in df.columns if c not in gone and c not in texts] + texts
    for i, name in enumerate(texts):
        df = df.join(codes[name], F.coalesce(_quoted(name), F.lit("nan")) == F.col(f"_text_{i}"))
    coded = {name: F.col(f"_code_{i}") for i, name in enumerate(texts)}
    return df.select(*(coded.get(c, _quoted(c)).alias(c) for c in order))


def _replaced(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Columns by name in their places, whatever the names contain."""
    return df.select(*(columns.get(c, _quoted(c)).alias(c) for c in df.columns))


@dataclass(frozen=True)
class Preprocessor:
    """Fitted statistics: one median, mean and population std per feature."""

    medians: dict[str, float | None]
    means: dict[str, float | None]
    stds: dict[str, float | None]

    def _filled(self, name: str) -> Column:
        median = self.medians[name]
        return _quoted(name) if median is None else F.coalesce(_quoted(name), F.lit(float(median)))

    def impute(self, df: DataFrame) -> DataFrame:
        return _replaced(df, {c: self._filled(c) for c in self.medians})

    def scale(self, df: DataFrame) -> DataFrame:
        """Standardise imputed features; a constant feature is only centred."""
        made = {}
        for c, mean in self.means.items():
            if mean is not None:
                made[c] = (_quoted(c) - F.lit(mean)) / F.lit(self.stds[c] or 1.0)
        return _replaced(df, made)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.scale(self.impute(df))


def _filled(known: Sketch, value: float | None) -> tuple[float | None, float | None]:
    """Mean and std of a column once every missing value is ``value``."""
    missing = known.rows - known.n
    if value is None or not missing or known.mean is None:
        return known.mean, known.std
    share, apart = missing / known.rows, value - known.mean
    variance = known.std * known.std * (1 - share) + share * (1 - share) * apart * apart
    return known.mean + share * apart, math.sqrt(variance)


def fit_preprocessor(df: DataFrame, features: Sequence[str]) -> Preprocessor:
    """Medians of the features, and mean and std of the imputed ones.

    Takes two passes over ``df``: hand in a table that is cheap to read.
    """
    return fit_subsets(df, {"": (None, features)})[""]


def fit_subsets(
    df: DataFrame, subsets: Subsets, known: Mapping[str, Mapping[str, Sketch]] | None = None
) -> dict[str, Preprocessor]:
    """``fit_preprocessor`` on the rows and features of every subset; two passes over ``df`` for all of them, one if they are sketched."""
    known = subset_sketches(df, subsets) if known is None else known
    medians = subset_medians(df, subsets, known)
    fitted = {}
    for name, (_, features) in subsets.items():
        filled = {c: _filled(known[name][c], medians[name][c]) for c in features}
        fitted[name] = Preprocessor(
            medians[name], {c: m for c, (m, _) in filled.items()}, {c: s for c, (_, s) in filled.items()}
        )
    return fitted


def scaler_of(known: Mapping[str, Sketch], medians: dict[str, float | None]) -> Preprocessor:
    """Mean and std of sketched features that are imputed already."""
    return Preprocessor(medians, {c: known[c].mean for c in medians}, {c: known[c].std for c in medians})


def fit_on(df: DataFrame, features: Sequence[str], rows: str = "train") -> Preprocessor:
    """Fit on the training side, or on all rows with ``rows="all"`` (which leaks)."""
    return fit_preprocessor(df if rows == "all" else df.filter(F.col("split") == rows), features)


def location_mean(
    df: DataFrame, place: Sequence[str], target: str, name: str
) -> DataFrame:
    """Mean of the target over the training rows of a place, else over all training rows."""
    train = df.filter(F.col("split") == "train")
    overall = train.agg(F.avg(target)).scalar()
    means = train.groupBy(*place).agg(F.avg(target).alias(name))
    return df.join(means, list(place), "left").withColumn(name, F.coalesce(name, overall))


def by_target(df: DataFrame, keys: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One row per (row, target) with a value, so all targets share one job."""
    return df.unpivot(list(keys), list(targets), "target", "y").filter(F.col("y").isNotNull())
