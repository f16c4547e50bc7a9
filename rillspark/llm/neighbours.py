"""Approximate nearest neighbours over shifted space-filling curves.

Each of ``CURVES`` curves projects the vectors onto a few random orthogonal directions, shifts them
inside a larger box and orders them along a Hilbert curve. A curve is cut into blocks at quantiles
of its keys; Spark deals vectors by (curve, block). A query goes to its own block and ``reach``
blocks to either side on every curve, is compared exactly with all vectors there, and keeps the
best of each; the merged best are its neighbours.

The index (scales and block borders) is fitted on a bounded sample, but every vector is in it.
How many blocks to look at is measured, not guessed: for a bounded sample of queries the true
neighbours are found among all vectors, and ``reach`` is the smallest that finds ``RECALL`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.tables import digest_number
from rillspark.session import durable

CURVES = 16
DIRECTIONS = 8
BITS = 6
BLOCK_ROWS = 2048
RECALL = 0.97
MOST_FITTED = 20_000
MOST_MEASURED = 64
_ONE = np.uint64(1)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points [n, d] of ``bits`` bits on the Hilbert curve through d dimensions.

    The transposed-axes form of Skilling (2004), over whole columns; d * bits is at most 64.
    """
    x = points.astype(np.uint64)
    n, d = x.shape
    bit = _ONE << np.uint64(bits - 1)
    while bit > 1:
        below = bit - _ONE
        for i in range(d):
            upper = (x[:, i] & bit) != 0
            swap = np.where(upper, below, (x[:, 0] ^ x[:, i]) & below)
            x[:, 0] ^= swap
            x[:, i] ^= np.where(upper, np.uint64(0), swap) if i else np.uint64(0)
        bit >>= _ONE
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint64)
    bit = _ONE << np.uint64(bits - 1)
    while bit > 1:
        flip ^= np.where((x[:, d - 1] & bit) != 0, bit - _ONE, np.uint64(0))
        bit >>= _ONE
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << _ONE) | ((x[:, i] >> np.uint64(b)) & _ONE)
    return key


@dataclass
class Curves:
    """Fitted curves; ``borders`` are the first keys of all blocks but the first."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shift: np.ndarray
    borders: list

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        at = vectors @ self.directions[curve]
        unit = np.clip((at - self.low[curve]) / (self.high[curve] - self.low[curve]), 0, 1)
        top = (1 << BITS) - 1
        return hilbert_keys(np.minimum((unit + self.shift[curve]) / 2 * (top + 1), top), BITS)

    def blocks(self, vectors: np.ndarray) -> np.ndarray:
        """Block of each vector on each curve [n, curves]."""
        made = [np.searchsorted(b, self.keys(vectors, c), "right") for c, b in enumerate(self.borders)]
        return np.array(made, np.int32).T.reshape(len(vectors), len(self.borders))


def fit_curves(sample: np.ndarray, blocks: int, curves: int = CURVES, seed: int = 9) -> Curves:
    draw = np.random.default_rng(seed)
    width = sample.shape[1]
    count = min(DIRECTIONS, width)
    directions = np.array([np.linalg.qr(draw.normal(size=(width, width)))[0][:, :count] for _ in range(curves)])
    at = np.einsum("nw,cwd->cnd", sample, directions)
    low, high = np.quantile(at, 0.001, axis=1), np.quantile(at, 0.999, axis=1)
    made = Curves(directions, low, np.maximum(high, low + 1e-12), draw.random((curves, count)), [])
    cuts = np.arange(1, blocks) * len(sample) // blocks
    for c in range(curves):
        made.borders.append(np.unique(np.sort(made.keys(sample, c))[cuts]))
    return made


def usable(table: DataFrame, name: str, vector: str) -> DataFrame:
    """id and vector of the rows that take part: finite, not zero, of the usual length."""
    v = F.col(vector).cast("array<double>")
    table = table.select(F.col(name).cast("long").alias("id"), v.alias("vector"))
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = table.filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    good = good.filter(~bad & F.exists("vector", lambda x: x != 0))
    usual = good.agg(F.mode(F.size("vector"), True)).first()[0]
    return good.filter(F.size("vector") == (usual or 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _nearest(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, k: int):
    """The k nearest of each query: (query position, vector position, distance)."""
    for q in range(len(queries)):
        gap = vectors - queries[q]
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        far[ids == own[q]] = np.inf
        kept = min(k, len(far))
        edge = np.partition(far, kept - 1)[kept - 1]
        at = np.flatnonzero((far <= edge) & np.isfinite(far))
        at = at[np.lexsort((ids[at], far[at]))][:k]
        yield q, at, far[at]


def _best(found: DataFrame, k: int) -> DataFrame:
    """Merge: each query's k nearest, ties to the smaller id."""
    once = found.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def true_nearest(candidates: DataFrame, queries: list, width: int, k: int) -> DataFrame:
    """Exact neighbours of a bounded list of (id, vector): every task compares its rows with all."""
    own = np.array([q[0] for q in queries], np.int64)
    wanted = np.array([q[1] for q in queries], float).reshape(len(queries), width)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch["id"].to_numpy(), _matrix(batch["vector"], width)
            for q, at, far in _nearest(wanted, ids, vectors, own, k):
                yield pa.record_batch(
                    {"query_id": np.full(len(at), own[q]), "id": ids[at], "score": far}
                )

    return _best(candidates.mapInArrow(scan, "query_id long, id long, score double"), k)


def nearest(
    table: DataFrame,
    every: int,
    k: int = 10,
    name: str = "vec_id",
    vector: str = "embedding",
    recall: float = RECALL,
    most_fitted: int = MOST_FITTED,
    most_measured: int = MOST_MEASURED,
) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each id divisible by ``every``.

    Distance is Euclidean in double precision, over all rows but those with the query's own id.
    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do those
    of another length than the commonest. Of equal vectors the k + 1 smallest ids are candidates,
    as no other can be among k. An id with several vectors counts with its nearest. Without a
    usable vector there are no rows. Other columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    rows = durable(usable(table, name, vector))
    queries = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    same = [F.xxhash64("vector"), F.xxhash64(F.lit(1), F.col("vector"))]
    of_same = F.row_number().over(Window.partitionBy(*same).orderBy("id"))
    # Row numbers up to a bound are cut before the shuffle, so a hot vector stays small.
    kept = rows.groupBy("id", F.xxhash64("vector").alias("_h")).agg(F.first("vector").alias("vector"))
    kept = durable(kept.select("id", "vector").withColumn("_n", of_same).filter(F.col("_n") <= k + 1).drop("_n"))
    n = kept.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    sample = kept.orderBy(digest_number(F.col("id")), "id").limit(most_fitted).toArrow()
    sample = np.array(sample["vector"].to_pylist(), float)
    width = sample.shape[1]
    blocks = int(max(1, min(n // BLOCK_ROWS, len(sample) // 4)))
    curves = fit_curves(sample, blocks)

    measured = queries.orderBy(digest_number(F.lit("q"), F.col("id")), "id").limit(most_measured).collect()
    reach = 0
    if blocks > 1 and measured:
        truth = true_nearest(kept, measured, width, k)
        truth = truth.select("query_id", "id").join(kept, "id").collect()
        at = {r["id"]: b for r, b in zip(measured, curves.blocks(np.array([r["vector"] for r in measured])), strict=True)}
        theirs = curves.blocks(np.array([r["vector"] for r in truth]))
        off = [np.abs(at[r["query_id"]] - b).min() for r, b in zip(truth, theirs, strict=True)]
        reach = int(np.quantile(off, recall, method="higher"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One block is all vectors: once is enough.
            made = curves.blocks(_matrix(batch["vector"], width))[:, : None if blocks > 1 else 1]
            for c in range(made.shape[1]):
                yield pa.record_batch(
                    {"curve": np.full(len(made), c, np.int32), "block": made[:, c], "id": batch["id"], "vector": batch["vector"]}
                )

    spot = "curve int, block int, id long, vector array<double>"
    placed = kept.mapInArrow(dealt, spot)
    # Blocks that turn out large are split by id; their queries go to every part. The table has
    # at most curves times most_fitted / 4 rows.
    parts = durable(
        placed.groupBy("curve", "block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("curve", "block", F.ceil(F.col("_rows") / (2 * BLOCK_ROWS)).cast("int").alias("parts"))
    )
    near = F.explode(F.sequence(F.col("block") - reach, F.col("block") + reach))
    asked = queries.mapInArrow(dealt, spot).withColumn("block", near)
    parts_of = F.broadcast(parts)
    held = placed.join(parts_of, ["curve", "block"]).withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    )
    asked = asked.join(parts_of, ["curve", "block"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    both = held.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True)))

    def compare(group: pa.Table) -> pa.Table:
        is_query = group["query"].to_numpy()
        ids = group["id"].to_numpy()
        vectors = _matrix(group["vector"].combine_chunks(), width)
        mine, theirs = ids[is_query], ids[~is_query]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(theirs):
            for q, at, far in _nearest(vectors[is_query], theirs, vectors[~is_query], mine, k):
                out.append((np.full(len(at), mine[q]), theirs[at], far))
        query_id, id_, score = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query_id": query_id, "id": id_, "score": score})

    found = both.groupBy("curve", "block", "part").applyInArrow(
        compare, "query_id long, id long, score double"
    )
    return _best(found, k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
