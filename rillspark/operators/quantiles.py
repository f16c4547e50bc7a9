"""Exact quantiles that hold no large group in one task.

The table is read once: equal values of a group (a column, or a key and a column) are counted, with partial
counts before the shuffle, and the counts are written down. A group of few different values, however many rows it
has, is put in order as it is. Values of the others get two whole numbers that keep their order: the place among
``OCTAVE`` steps between powers of two, and among ``FINER`` steps within one of those. Counts per first
number tell in which step a wanted rank lies, counts per second number where in that step, and only values
that share both are put in order. So a crowded group's work spreads over its steps. Infinities are values,
NaN is missing, whole numbers stay whole.

Whole columns of a large table that a ``Sketch`` was made of are counted by spans: the sketch shows about where
the quantile lies, and values beyond that span are counted only as below or above it, in Arrow batches, so that few
different values are moved. Every row is counted; a rank that turns out to lie beyond its span is sought without one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillspark.session import durable

# Different values of a group that one task puts in order.
ORDERED_VALUES = 250_000
OCTAVE = 2**12
FINER = 2**24
# Columns of more rows are counted by spans.
SPANNED_ROWS = 400_000
# Rows of every partition that a sketch shows, and half the width of a span in standard deviations of a rank.
SHOWN_ROWS = 512
SPAN_DEVIATIONS = 5.0
BELOW, ABOVE = -(2**63), 2**63 - 1
# Larger than any exponent of a double, so that steps of magnitudes are positive.
_SHIFT = 1100


def _whole(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.IntegralType)


def _value(df: DataFrame, c: str) -> tuple[Column, Column]:
    """A numeric column as x (double, NaN is missing) and y, which tells whole numbers of one x apart."""
    x = F.col(f"`{c}`").cast("double")
    if _whole(df, c):
        return x, F.col(f"`{c}`").cast("long")
    return F.when(~F.isnan(x), x), F.lit(0).cast("long")


def _with_steps(counted: DataFrame) -> DataFrame:
    """Add step and finer, whole numbers in the order of x."""
    a, e, part = F.abs("x"), F.col("_e"), F.col("_part")
    guess = F.floor(F.log2(F.when((a > 0) & (a < math.inf), a).otherwise(1.0)))
    p = F.pow(F.lit(2.0), F.col("_e").cast("double"))
    sign = F.signum("x").cast("long")
    return (
        counted.withColumn("_e", guess)
        # A logarithm may be off by a rounding next to a power of two.
        .withColumn("_e", e - (a < p).cast("long") + (a >= 2 * p).cast("long"))
        .withColumn("_part", (a / p - 1) * OCTAVE)
        .withColumns(
            {
                "step": F.when(a == math.inf, sign * (2 * _SHIFT * OCTAVE)).otherwise(
                    sign * ((e + _SHIFT) * OCTAVE + F.floor(part))
                ),
                "finer": F.when((a == math.inf) | (a == 0), F.lit(0)).otherwise(
                    sign * F.floor((part - F.floor(part)) * FINER)
                ),
            }
        )
        .drop("_e", "_part")
    )


def _counted(values: DataFrame) -> DataFrame:
    """The values g, x, y with the rows n of each, written down; a missing x stays."""
    return durable(values.groupBy("g", "x", "y").agg(F.count("*").alias("n")))


def _upto(by: list[str], order: list[str], n: str = "n") -> Column:
    return F.sum(n).over(Window.partitionBy(*by).orderBy(*order))


def _picked(counted: DataFrame, ranks: Callable[[Column, Column], Column]) -> DataFrame:
    """g, total, at, x, y: the values at the ranks (from 0) that ``ranks`` makes of g and its total."""
    known = counted.filter(F.col("x").isNotNull())
    sizes = known.groupBy("g").count()
    if (sizes.agg(F.max("count")).first()[0] or 0) <= ORDERED_VALUES:
        return _ordered(known, ranks)
    crowded = sizes.filter(F.col("count") > ORDERED_VALUES).select("g")
    few = _ordered(known.join(crowded, "g", "left_anti"), ranks)
    return few.unionByName(_stepwise(known.join(crowded, "g", "left_semi"), ranks))


def _between(ranks: Column, n: str) -> Column:
    """Those of the ranks that fall into the n rows up to ``upto``."""
    return F.filter(F.array_distinct(ranks), lambda r: (r >= F.col("upto") - F.col(n)) & (r < F.col("upto")))


def _ordered(known: DataFrame, ranks: Callable[[Column, Column], Column]) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("g"))
    placed = known.select("g", "x", "y", "n", _upto(["g"], ["x", "y"]).alias("upto"), total.alias("total"))
    here = _between(ranks(F.col("g"), F.col("total")), "n")
    return placed.select("g", "total", F.explode(here).alias("at"), "x", "y")


def _stepwise(known: DataFrame, ranks: Callable[[Column, Column], Column]) -> DataFrame:
    known = _with_steps(known)
    steps = known.groupBy("g", "step").agg(F.sum("n").alias("m"))
    total = F.sum("m").over(Window.partitionBy("g"))
    steps = steps.select("g", "step", "m", _upto(["g"], ["step"], "m").alias("upto"), total.alias("total"))
    here = _between(ranks(F.col("g"), F.col("total")), "m")
    steps = steps.select("g", "step", "total", (F.col("upto") - F.col("m")).alias("before"), F.explode(here).alias("at"))
    steps = durable(steps.select("g", "step", "total", "at", (F.col("at") - F.col("before")).alias("left")))

    def inside(n: str) -> Column:
        return (F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col(n))

    finer = known.join(steps.select("g", "step").distinct(), ["g", "step"], "left_semi")
    finer = finer.groupBy("g", "step", "finer").agg(F.sum("n").alias("m"))
    finer = finer.select("*", _upto(["g", "step"], ["finer"], "m").alias("upto"))
    finer = finer.join(steps, ["g", "step"]).filter(inside("m"))
    finer = finer.select("g", "step", "finer", "total", "at", (F.col("left") - (F.col("upto") - F.col("m"))).alias("left"))
    last = known.join(finer, ["g", "step", "finer"])
    last = last.select("*", _upto(["g", "step", "finer", "at"], ["x", "y"]).alias("upto"))
    return last.filter(inside("n")).select("g", "total", "at", "x", "y")


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns one below the other: g (place among ``cols``), x and y."""
    entries = [F.struct(F.lit(i).alias("g"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(_value(df, c) for c in cols)]
    return df.select(F.inline(F.array(*entries))).filter(F.col("x").isNotNull())


def order_statistics(df: DataFrame, wanted: dict[str, Sequence[int]]) -> dict[tuple[str, int], float]:
    """The k-th smallest non-missing values (k from 0) of several numeric columns, exactly.

    Whole numbers stay whole. All columns and ranks share one pass over the table.
    """
    cols = list(wanted)
    ranks = F.array(*(F.array(*(F.lit(k).cast("long") for k in wanted[c])) for c in cols))
    found = {}
    for r in _picked(_counted(_long(df, cols)), lambda g, _: F.element_at(ranks, g + 1)).collect():
        c = cols[r["g"]]
        found[c, r["at"]] = r["y"] if _whole(df, c) else r["x"]
    for c in cols:
        for k in wanted[c]:
            if (c, k) not in found:
                raise ValueError(f"rank {k} of {c}: there are fewer values")
    return found


@dataclass(frozen=True)
class Sketch:
    """Of a column: rows, values that are not NULL, their mean and population std, and the span of its median."""

    rows: int = 0
    n: int = 0
    mean: float | None = None
    std: float | None = None
    span: tuple[float | None, float | None] = (None, None)


# Subsets of the rows of a table by name: their condition (None: all rows) and the columns that are looked at there.
Subsets = Mapping[str, tuple[Column | None, Sequence[str]]]
# The place of a subset's condition and those of its columns.
Places = Sequence[tuple[int | None, Sequence[int]]]


def _numbers(df: DataFrame, subsets: Subsets) -> tuple[DataFrame, Places]:
    """The columns of all subsets, each once, as doubles or whole numbers, and the conditions; by their places."""
    cols = {c: i for i, c in enumerate(dict.fromkeys(c for _, own in subsets.values() for c in own))}
    made = [F.col(f"`{c}`").cast("long" if _whole(df, c) else "double") for c in cols]
    places = []
    for condition, own in subsets.values():
        places.append((None if condition is None else len(made), [cols[c] for c in own]))
        if condition is not None:
            made.append(F.coalesce(condition, F.lit(False)))
    return df.select(*(x.alias(f"c{i}") for i, x in enumerate(made))), places


def _rows_of(places: Places) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """The rows and columns of every subset in a batch."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for condition, cols in places:
            own = batch.select(list(cols))
            yield own if condition is None else own.filter(batch.column(condition))

    return rows


def _sketched(shown: int, places: Places) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per partition, subset and column: rows, values, mean, sum of squared deviations, and values of some rows."""
    rows_of = _rows_of(places)

    def sketch(width: int):
        draw = np.random.default_rng(0)
        rows, n, mean, squares = 0, np.zeros(width, "int64"), np.zeros(width), np.zeros(width)
        drawn, lots = np.empty((0, width)), np.empty(0)

        def add(batch: pa.RecordBatch) -> None:
            nonlocal rows, lots, drawn
            if not batch.num_rows:
                return
            rows += batch.num_rows
            mine = draw.random(batch.num_rows)
            few = np.argsort(mine)[:shown]
            picked = np.empty((len(few), width))
            with np.errstate(all="ignore"):
                for i, column in enumerate(batch.columns):
                    x = column.drop_null().to_numpy(zero_copy_only=False).astype("float64")
                    picked[:, i] = column.take(pa.array(few)).cast("float64", safe=False).to_numpy(zero_copy_only=False)
                    if len(x):
                        at = x[0] + (x - x[0]).mean()  # exact where all are equal
                        apart, both = at - mean[i], n[i] + len(x)
                        squares[i] += ((x - at) ** 2).sum() + apart * apart * n[i] * len(x) / both
                        mean[i] += apart * len(x) / both
                        n[i] = both
            lots, drawn = np.concatenate([lots, mine[few]]), np.concatenate([drawn, picked])
            kept = np.argsort(lots)[:shown]
            lots, drawn = lots[kept], drawn[kept]

        def made(first: int) -> pa.RecordBatch | None:
            if not rows:
                return None
            values = [c[~np.isnan(c)] for c in drawn.T]
            return pa.record_batch(
                [pa.array(range(first, first + width), "int32"), pa.array([rows] * width, "int64"), pa.array(n), pa.array(mean),
                 pa.array(squares), pa.array(values, pa.list_(pa.float64()))],
                names=["g", "rows", "n", "mean", "squares", "xs"],
            )

        return add, made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [sketch(len(cols)) for _, cols in places]
        for batch in batches:
            for (add, _), own in zip(held, rows_of(batch), strict=True):
                add(own)
        first = 0
        for (_, made), (_, cols) in zip(held, places, strict=True):
            if (out := made(first)) is not None:
                yield out
            first += len(cols)

    return run


def sketches(df: DataFrame, cols: Sequence[str]) -> dict[str, Sketch]:
    """A sketch of each column; one pass. Rows drawn from every partition count as much as it has rows."""
    return subset_sketches(df, {"": (None, cols)})[""]


def subset_sketches(df: DataFrame, subsets: Subsets) -> dict[str, dict[str, Sketch]]:
    """A sketch of each column over the rows of each subset; one pass over ``df`` for all of them."""
    if not any(cols for _, cols in subsets.values()):
        return {name: {} for name in subsets}
    numbers, places = _numbers(df, subsets)
    parts = durable(numbers.mapInArrow(
        _sketched(SHOWN_ROWS, places), "g int, rows long, n long, mean double, squares double, xs array<double>"
    ))
    of_g = Window.partitionBy("g")
    least = F.min("mean").over(of_g)
    whole = least + F.sum((F.col("mean") - F.col("least")) * F.col("n")).over(of_g) / F.sum("n").over(of_g)
    held = parts.filter("n > 0").withColumn("least", least).withColumn("whole", whole)
    apart = F.col("mean") - F.col("whole")
    moments = {
        r["g"]: r
        for r in held.groupBy("g")
        .agg(
            F.sum("n").alias("n"), F.first("whole").alias("mean"),
            F.sqrt(F.sum(F.col("squares") + F.col("n") * apart * apart) / F.sum("n")).alias("std"),
        )
        .collect()
    }
    rows = {r["g"]: r["n"] for r in parts.groupBy("g").agg(F.sum("rows").alias("n")).collect()}
    spans = _spans(parts) if max(rows.values(), default=0) > SPANNED_ROWS else {}
    found: dict[str, dict[str, Sketch]] = {name: {} for name in subsets}
    for i, (name, c) in enumerate((name, c) for name, (_, cols) in subsets.items() for c in cols):
        m = moments.get(i)
        found[name][c] = Sketch(
            rows.get(i, 0), m["n"] if m else 0, m["mean"] if m else None, m["std"] if m else None,
            spans.get(i, (None, None)),
        )
    return found


def _spans(parts: DataFrame) -> dict[int, tuple[float | None, float | None]]:
    """Per column the values between which its median most likely lies; None where the span is open."""
    shown = parts.filter(F.size("xs") > 0).select("g", F.explode("xs").alias("x"), (F.col("n") / F.size("xs")).alias("w"))
    of_g = Window.partitionBy("g")
    placed = shown.select(
        "g", "x", F.sum("w").over(of_g.orderBy("x")).alias("upto"), F.sum("w").over(of_g).alias("total"),
        F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_g)).alias("spread"), F.max("w").over(of_g).alias("most"),
    )
    # Squared weights add up to the variance of a sum of draws, at most a quarter of which is a rank's.
    reach = F.lit(SPAN_DEVIATIONS / 2) * F.col("spread") + 2 * F.col("most")
    below = F.col("upto") <= F.col("total") / 2 - reach
    above = F.col("upto") >= F.col("total") / 2 + reach
    ends = placed.groupBy("g").agg(F.max(F.when(below, F.col("x"))).alias("low"), F.min(F.when(above, F.col("x"))).alias("high"))
    return {r["g"]: (r["low"], r["high"]) for r in ends.collect()}


def _counted_within(spans: Sequence[tuple[float | None, float | None]], places: Places):
    """Rows g, x, y and n of batches; a value beyond its span counts as the end of it, with y BELOW or ABOVE."""
    rows_of = _rows_of(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beyond = np.zeros((len(spans), 2), "int64")
        for batch in batches:
            made = []
            columns = [column for own in rows_of(batch) for column in own.columns]
            for g, (column, (low, high)) in enumerate(zip(columns, spans, strict=True)):
                own = column.drop_null().to_numpy(zero_copy_only=False)
                x = own.astype("float64")
                inside = ~np.isnan(x)
                if low is not None:
                    under = x < low
                    beyond[g, 0] += under.sum()
                    inside &= ~under
                if high is not None:
                    over = x > high
                    beyond[g, 1] += over.sum()
                    inside &= ~over
                different, n = np.unique(own[inside], return_counts=True)
                whole = pa.types.is_integer(column.type)
                made.append((g, different.astype("float64"), different if whole else np.zeros(len(n), "int64"), n))
            yield counts(made)
        yield counts([
            (g, np.array([end]), np.array([mark]), np.array([beyond[g, side]]))
            for g, span in enumerate(spans) for side, (end, mark) in enumerate(zip(span, (BELOW, ABOVE), strict=True))
            if beyond[g, side]
        ])

    def counts(made: list[tuple]) -> pa.RecordBatch:
        g = np.repeat([m[0] for m in made], [len(m[3]) for m in made]).astype("int32") if made else np.empty(0, "int32")
        x, y, n = (
            np.concatenate([m[k].astype(kind) for m in made]) if made else np.empty(0, kind)
            for k, kind in ((1, "float64"), (2, "int64"), (3, "int64"))
        )
        return pa.record_batch([pa.array(g), pa.array(x), pa.array(y), pa.array(n)], names=["g", "x", "y", "n"])

    return run


def column_medians_exact(df: DataFrame, known: dict[str, Sketch]) -> dict[str, float | None]:
    """Exact medians of the sketched columns of ``df``, which is read once more."""
    return subset_medians(df, {"": (None, list(known))}, {"": known})[""]


def subset_medians(
    df: DataFrame, subsets: Subsets, known: Mapping[str, Mapping[str, Sketch]]
) -> dict[str, dict[str, float | None]]:
    """Exact medians of the columns of the subsets, all of which are sketched; one pass over ``df`` for those of large subsets."""
    found: dict[str, dict[str, float | None]] = {name: {} for name in subsets}

    def rows(name: str) -> DataFrame:
        condition = subsets[name][0]
        return df if condition is None else df.filter(condition)

    def by_themselves(name: str, cols: Sequence[str]) -> None:
        found[name] |= {c: q[0] for c, q in column_quantiles(rows(name), cols, [0.5]).items()}

    large = {}
    for name, (condition, cols) in subsets.items():
        if max((known[name][c].rows for c in cols), default=0) <= SPANNED_ROWS:
            by_themselves(name, cols)
        else:
            large[name] = (condition, list(cols))
    if not large:
        return found
    numbers, places = _numbers(df, large)
    groups = [(name, c) for name, (_, cols) in large.items() for c in cols]
    counts = numbers.mapInArrow(
        _counted_within([known[name][c].span for name, c in groups], places), "g int, x double, y long, n long"
    )
    counted = durable(counts.groupBy("g", "x", "y").agg(F.sum("n").alias("n")))
    medians, beyond = _quantiles([_whole(df, c) for _, c in groups], counted, [0.5])
    for (name, c), q in zip(groups, medians, strict=True):
        found[name][c] = q[0]
    for name in large:
        if again := [c for g, (of, c) in enumerate(groups) if of == name and g in beyond]:
            by_themselves(name, again)
    return found


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns with linear interpolation; missing values are skipped."""
    cols = list(cols)
    if not cols:
        return {}
    return dict(zip(cols, _quantiles([_whole(df, c) for c in cols], _counted(_long(df, cols)), probs)[0], strict=True))


def _quantiles(
    whole: Sequence[bool], counted: DataFrame, probs: Sequence[float]
) -> tuple[list[list[float | None]], set[int]]:
    """Quantiles from the counted values of every group, and the groups of which a rank lies beyond its span.

    Groups go by their places in ``whole``, which says where values are whole numbers.
    """
    places = [lambda total, p=p: F.lit(float(p)) * (total - 1) for p in probs]

    def ranks(_: Column, total: Column) -> Column:
        return F.array(*(f(place(total)).cast("long") for place in places for f in (F.floor, F.ceil)))

    totals: dict[int, int] = {}
    values: dict[tuple[int, int], float] = {}
    beyond = set()
    for r in _picked(counted, ranks).collect():
        g = r["g"]
        totals[g] = r["total"]
        if r["y"] in (BELOW, ABOVE):
            beyond.add(g)
        values[g, r["at"]] = r["y"] if whole[g] else r["x"]

    def between(g: int, at: float) -> float:
        low, high = math.floor(at), math.ceil(at)
        if low == high or values[g, low] == values[g, high]:
            return float(values[g, low])
        return (high - at) * values[g, low] + (at - low) * values[g, high]

    found = [
        [between(g, float(p) * (totals[g] - 1)) for p in probs] if g in totals else [None] * len(probs)
        for g in range(len(whole))
    ]
    return found, beyond


def _medians(values: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Medians of x per g = (key parts k0, k1, ..., place among ``cols``), a column each."""
    counted = _counted(values)
    middle = lambda _, total: F.array(F.floor((total - 1) / 2), F.floor(total / 2))
    picked = _picked(counted, middle).select("g", "x")
    # Groups without any value are rows of their own.
    rows = picked.unionByName(counted.filter("x is null").select("g", "x"))

    def median(at: int) -> Column:
        x = F.when(F.col("g.col") == at, F.col("x"))
        return F.when(F.min(x) == F.max(x), F.min(x)).otherwise(0.5 * F.min(x) + 0.5 * F.max(x))

    return rows.groupBy(*(F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys))).agg(
        *(median(at).alias(c) for at, c in enumerate(cols))
    )


def _group(keys: Sequence[str], at: Column) -> Column:
    return F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), at.alias("col")).alias("g")


def grouped_median(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact median of each column per group; missing values are skipped.

    Missing parts of a key are equal. A group without any value has no median but stays in the result.
    """
    values = ((F.lit(j), *_value(df, c)) for j, c in enumerate(cols))
    entries = [F.struct(_group(keys, at), x.alias("x"), y.alias("y")) for at, x, y in values]
    return _medians(df.select(F.inline(F.array(*entries))), list(keys), list(cols))


def named_medians(
    df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Exact median per group of the values that go by each of ``names``, a column per name.

    Groups stay as in ``grouped_median``, also those with other names only.
    """
    at = F.coalesce(*(F.when(F.col(name) == n, F.lit(i)) for i, n in enumerate(names)), F.lit(-1))
    x, y = _value(df, value)
    values = df.select(_group(keys, at), F.when(at >= 0, x).alias("x"), F.when(at >= 0, y).alias("y"))
    return _medians(values, list(keys), list(names))
