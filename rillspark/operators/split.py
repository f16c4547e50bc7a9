"""Splits and folds.

A random order is the order of md5(seed_key): the same on every run and every cluster, whatever
the partitioning. A split of an exact size then is one comparison with the digest at which
the size is reached, so no row has to be ranked, joined or moved.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.operators.numbering import numbered
from rillspark.operators.quantiles import order_statistics
from rillspark.session import durable

# Digests are counted by this many more hex digits in each pass: 65,536 ranges.
HEX_DIGITS = 4
ALL_DIGITS = 32
RANKED_ROWS = 100_000


def digest(keys: Sequence[Column], seed: int) -> Column:
    return F.md5(F.concat_ws("_", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def _digest_at(units: DataFrame, fraction: float) -> str | None:
    """The digest of the ceil(fraction * n)-th unit in digest order; None without units.

    One pass counts the units by the first digits, which gives their number, the rank and the range it lies
    in; a second one looks at that range alone. Only beyond some billions of units, or where one
    digest has more units than a task should sort, are there passes for further digits.
    """
    prefix, rank, n = "", None, None
    for digits in range(HEX_DIGITS, ALL_DIGITS + 1, HEX_DIGITS):
        ranges = F.substring("_digest", 1, digits).alias("_range")
        counts = units.filter(F.startswith("_digest", F.lit(prefix))).groupBy(ranges).agg(F.count("*").alias("n"))
        # At most 16 ** HEX_DIGITS rows.
        total = F.sum("n").over(Window.partitionBy())
        size = F.ceil(total * F.lit(float(fraction))) if rank is None else F.lit(rank)
        upto = F.sum("n").over(Window.orderBy("_range"))
        summed = counts.select("_range", "n", upto.alias("upto"), size.alias("size"))
        crossing = summed.filter("upto >= size and upto - n < size").first()
        if crossing is None:
            return None
        prefix, n = crossing["_range"], crossing["n"]
        rank = crossing["size"] - (crossing["upto"] - n)
        if n <= RANKED_ROWS or digits == ALL_DIGITS:
            break
    if len(prefix) == ALL_DIGITS:
        return prefix
    inside = units.filter(F.startswith("_digest", F.lit(prefix)))
    return inside.agg(F.sort_array(F.collect_list("_digest"))[rank - 1]).first()[0]


def _digests_at(units: DataFrame, flags: Sequence[str], fraction: float) -> dict[str, str | None]:
    """``_digest_at`` among the units of every flag, in two passes for all of them but where a range is crowded."""
    first = F.substring("_digest", 1, HEX_DIGITS).alias("_range")
    # At most 16 ** HEX_DIGITS rows.
    counts = durable(units.groupBy(first).agg(*(F.count_if(f).alias(f) for f in flags)))
    found: dict[str, str | None] = {}
    inside = {}
    for flag in flags:
        size = F.ceil(F.sum(flag).over(Window.partitionBy()) * F.lit(float(fraction)))
        upto = F.sum(flag).over(Window.orderBy("_range"))
        summed = counts.select("_range", F.col(flag).alias("n"), upto.alias("upto"), size.alias("size"))
        crossing = summed.filter("upto >= size and upto - n < size").first()
        if crossing is None:
            found[flag] = None
        elif crossing["n"] > RANKED_ROWS:
            found[flag] = _digest_at(units.filter(flag), fraction)
        else:
            inside[flag] = crossing["_range"], crossing["size"] - (crossing["upto"] - crossing["n"])
    if inside:
        met = {f: F.col(f) & F.startswith("_digest", F.lit(prefix)) for f, (prefix, _) in inside.items()}
        row = units.filter(F.array_contains(F.array(*met.values()), True)).agg(
            *(F.sort_array(F.collect_list(F.when(met[f], F.col("_digest"))))[rank - 1] for f, (_, rank) in inside.items())
        ).first()
        found |= dict(zip(inside, row, strict=True))
    return found


def _split(df: DataFrame, keys: Sequence[str], units: DataFrame, fraction: float, seed: int,
           exact: bool) -> DataFrame:
    own = digest([F.col(k) for k in keys], seed)
    if exact:
        last = F.lit(_digest_at(units.select(own.alias("_digest")), fraction))
    else:
        last = F.lit(f"{math.floor(fraction * 16 ** 8):08x}")
    test = own <= last if exact else own < last
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def random_split(
    df: DataFrame, key: Sequence[str], test_fraction: float = 0.2, seed: int = 42,
    exact: bool = True,
) -> DataFrame:
    """Random split by a unique row key; the test side has ceil(fraction * rows) rows.

    ``exact=False`` compares with a fixed digest and needs no pass over the table; the size is
    then right on average.
    """
    return _split(df, key, df, test_fraction, seed, exact)


def group_split(
    df: DataFrame, group: Sequence[str], test_fraction: float = 0.2, seed: int = 42,
    exact: bool = True,
) -> DataFrame:
    """Whole groups go to one side; the test side has ceil(fraction * groups) groups."""
    # Several passes read the groups, which may be far fewer than the rows.
    groups = df.select(*group).distinct()
    return _split(df, group, durable(groups) if exact else groups, test_fraction, seed, exact)


def target_splits(
    df: DataFrame, targets: Sequence[str], place: Sequence[str] = (), row_key: Sequence[str] | None = None,
    test_fraction: float = 0.2, seed: int = 42,
) -> tuple[DataFrame, dict[str, str]]:
    """The split of every target over the rows that have it, and the names of these columns by target.

    Each is that of ``random_split`` where there is a ``row_key``, else that of ``group_split``; groups and
    ranges are counted for all targets at once.
    """
    keys = list(row_key or place)
    own = digest([F.col(k) for k in keys], seed)
    has = {t: f"_has_{i}" for i, t in enumerate(targets)}
    if row_key:
        units = df.select(own.alias("_digest"), *(F.col(f"`{t}`").isNotNull().alias(n) for t, n in has.items()))
    else:
        groups = df.groupBy(*keys).agg(*(F.bool_or(F.col(f"`{t}`").isNotNull()).alias(n) for t, n in has.items()))
        units = durable(groups).select(own.alias("_digest"), *has.values())
    lasts = _digests_at(units, list(has.values()), test_fraction)
    names = {t: f"_split_{i}" for i, t in enumerate(targets)}
    sides = {names[t]: F.when(F.col("_digest") <= F.lit(lasts[n]), "test").otherwise("train") for t, n in has.items()}
    return df.withColumn("_digest", own).withColumns(sides).drop("_digest"), names


def k_fold(df: DataFrame, key: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Fold number 0 .. k-1 per row."""
    number = F.conv(F.substring(digest([F.col(c) for c in key], seed), 1, 8), 16, 10)
    return df.withColumn("fold", (number.cast("long") % k).cast("int"))


def _deal(classes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, list[int]]]:
    """Deal groups to k folds, each to the lightest one (the lower number among equals).

    ``classes`` lists (size, number of groups), largest size first. While groups of one size are
    dealt, the folds that are lighter than the lightest one plus that size take turns, until the
    next fold joins them. Returns these phases: (size, position of its first group in the size
    class, folds in turn).
    """
    totals = [0] * k
    phases = []
    for size, count in classes:
        dealt = 0
        while dealt < count:
            low = min(totals)
            turn = sorted((f for f in range(k) if totals[f] < low + size),
                          key=lambda f: (totals[f], f))
            others = [t for t in totals if t >= low + size]
            here = count - dealt
            if others:
                here = min(here, (min(others) - low) // size * len(turn))
            phases.append((size, dealt, turn))
            rounds, more = divmod(here, len(turn))
            for i, fold in enumerate(turn):
                totals[fold] += size * (rounds + (i < more))
            dealt += here
    return phases


def group_k_fold(df: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """Folds of whole groups with even sizes: the largest group left goes to the lightest fold.

    Among equal sizes the smaller group comes first. The deal itself depends only on how many
    groups there are of each size; n rows make at most sqrt(2 n) different sizes, so that table
    is small enough for the driver. Every group then finds its fold from its size and its position
    among the groups of that size.
    """
    group = list(group)
    sizes = durable(df.groupBy(*group).agg(F.count("*").alias("_size")))
    classes = [
        tuple(r)
        for r in sizes.groupBy("_size").count().orderBy(F.col("_size").desc()).collect()
    ]
    ranked = numbered(sizes, [F.col("_size").desc(), *group], "_at")
    rows, first = [], {}
    position = 0
    for size, count in classes:
        first[size] = position
        position += count
    phases = _deal(classes, k)
    for i, (size, start, turn) in enumerate(phases):
        last = i + 1 == len(phases) or phases[i + 1][0] != size
        end = None if last else first[size] + phases[i + 1][1]
        rows.append((size, first[size] + start, end, turn))
    turns = df.sparkSession.createDataFrame(
        rows, "_size long, _start long, _end long, _turn array<int>"
    )
    at = F.col("_at")
    folds = (
        ranked.join(turns, "_size")
        .filter((at >= F.col("_start")) & (F.col("_end").isNull() | (at < F.col("_end"))))
        .select(
            *group,
            F.element_at(
                "_turn", ((at - F.col("_start")) % F.size("_turn") + 1).cast("int")
            ).alias("fold"),
        )
    )
    named = {g: f"_group_{i}" for i, g in enumerate(group)}
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in named.items()]
    return df.join(folds.withColumnsRenamed(named), same).drop(*named.values())


def sequential_split(
    df: DataFrame, series: str, time: str, train_fraction: float = 0.8
) -> DataFrame:
    """The first floor(fraction * rows) rows in (series, time) order train, the others test.

    ``series`` is numeric and (series, time) is unique. The first test row is found by counting,
    first its series, then its time; the rows stay where they are.
    """
    n = df.count()
    first_test = int(n * train_fraction)
    if first_test >= n:
        return df.withColumn("split", F.lit("train"))
    border = order_statistics(df.select(series), {series: [first_test]})[series, first_test]
    before = df.filter(F.col(series) < border).count()
    inside = df.filter(F.col(series) == border).select(
        F.unix_micros(F.col(time).cast("timestamp")).alias("_us")
    )
    rank = first_test - before
    at = order_statistics(inside, {"_us": [rank]})["_us", rank]
    us = F.unix_micros(F.col(time).cast("timestamp"))
    test = (F.col(series) > border) | ((F.col(series) == border) & (us >= F.lit(int(at))))
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def groups_in_both(df: DataFrame, group: Sequence[str], split: str = "split") -> DataFrame:
    """How many groups have rows on both sides; 0 for a split without leakage."""
    return (
        df.groupBy(*group)
        .agg(
            F.bool_or(F.col(split) == "train").alias("_train"),
            F.bool_or(F.col(split) == "test").alias("_test"),
        )
        .agg(
            F.count("*").alias("groups"),
            F.count_if(F.col("_train") & F.col("_test")).alias("groups_in_both"),
        )
    )
