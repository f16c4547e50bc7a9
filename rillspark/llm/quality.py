"""Document quality by pairwise ranking.

The Bradley-Terry model: the odds that one document is preferred to another are the exponential
of the difference of their scores. Scores are linear in features of the text, so its likelihood is
logistic loss on feature differences of (preferred, other) pairs and has no intercept. The cut is
a quantile of the scores: as large a share passes as the labels call good.

The weights are fitted on a bounded sample of labelled rows (``most_labelled``), the smallest md5
first; the cut is the exact quantile over all of them, and scoring takes every document, whole.
Features come from the text alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillspark.llm.tables import digest_number, mapped, small_batches
from rillspark.operators.quantiles import order_statistics
from rillspark.session import durable

MOST_LABELLED = 20_000
PAIRS = 200_000
# The score at the cut.
PASSES = 0.5
AT_A_TIME = 10_000
PENALTY = 1e-3
LENGTHS = 12


def features(text: str | None) -> np.ndarray:
    """What a text looks like: shares of kinds of characters and words, and repetition."""
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(points))
    words = text.split()
    w = max(1, len(words))
    ascii_points = points[points < 128]
    kinds = np.bincount(ascii_points, minlength=128) / n
    upper, lower, digits = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
    symbols = np.r_[kinds[33:48], kinds[58:65], kinds[91:97], kinds[123:127]]
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    spread = np.bincount(np.minimum(lengths, LENGTHS), minlength=LENGTHS + 1) / w
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    capitals = sum(x.isupper() and len(x) > 1 for x in words)
    bare = sum(not any(map(str.isalnum, x)) for x in words)
    tails = sum(len(x) > 1 and not x[-1].isalnum() and not x[-2].isalnum() for x in words)
    return np.array(
        [
            math.log1p(len(words)),
            math.log1p(len(points)),
            upper,
            lower,
            digits,
            upper / max(1e-9, upper + lower),
            (points >= 128).mean() if len(points) else 0.0,
            kinds[32],
            kinds[10],
            kinds[9],
            symbols.sum(),
            (symbols > 0).sum() / len(symbols),
            -sum(p * math.log(p) for p in kinds[kinds > 0].tolist()),
            len(counts) / w,
            len(counts) / math.sqrt(w),
            top / w,
            repeated / w,
            capitals / w,
            bare / w,
            tails / w,
            len(set(lines)) / max(1, len(lines)),
            math.log1p(len(lines)),
            lengths.mean() if len(lengths) else 0.0,
            lengths.std() if len(lengths) else 0.0,
            *np.sqrt(symbols),
            *spread,
        ]
    )


@dataclass
class Ranker:
    """Score of a text: sigmoid of its linear score over the cut."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, vectors: np.ndarray) -> np.ndarray:
        # Row by row, so that a row's last bit does not depend on its batch: equal texts stay equal.
        return (np.clip((vectors - self.center) / self.scale, -8, 8) * self.weights).sum(1)

    def score(self, vectors: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(vectors) - self.cut, -500, 500)))


def rank(vectors: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 6) -> Ranker:
    """Fit by Newton steps on the pairs' logistic loss; pairs are drawn good against bad.

    Without both kinds there is no pair: all weights are 0 and the cut says the only label.
    """
    d = vectors.shape[1]
    center = vectors.mean(0) if len(vectors) else np.zeros(d)
    scale = np.maximum(vectors.std(0), 1e-6) if len(vectors) else np.ones(d)
    model = Ranker(center, scale, np.zeros(d), -1.0 if len(good) == 0 or good.any() else 1.0)
    yes, no = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(yes) or not len(no):
        return model
    z = np.clip((vectors - center) / scale, -8, 8)
    draw = np.random.default_rng(seed)
    n = min(pairs, len(yes) * len(no))
    first, second = draw.choice(yes, n), draw.choice(no, n)
    weights = np.zeros(d)
    for _ in range(25):
        slope, bend = -PENALTY * weights, PENALTY * np.eye(d)
        for i in range(0, n, AT_A_TIME):  # differences are made as they are needed
            x = z[first[i : i + AT_A_TIME]] - z[second[i : i + AT_A_TIME]]
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
            slope += x.T @ (1 - p) / n
            bend += (x * (p * (1 - p))[:, None]).T @ x / n
        step = np.linalg.solve(bend, slope)
        step *= min(1.0, 5 / max(1e-12, np.abs(step).max()))
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = weights
    scores = model.raw(vectors)
    # As large a share passes as is good; halfway between the two neighbours at that quantile.
    at = np.sort(scores)
    k = len(no)
    model.cut = float((at[k - 1] + at[k]) / 2)
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [features(t.as_py()).tolist() for t in batch["text"]]
        yield pa.RecordBatch.from_arrays(
            [batch["key"], batch["good"], pa.array(made, pa.list_(pa.float64()))],
            names=["key", "good", "vector"],
        )


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Ranker:
    """Learn from docs (doc_id, text) and labels (doc_id, quality 0 or 1).

    The weights use at most ``most_labelled`` labels, by md5 of their doc_id, and as many documents;
    that bounds the broadcast and what reaches the driver. Where there are more, the cut is taken
    over the scores of all labelled rows. Null ids and labels teach nothing.
    """
    small_batches(docs.sparkSession)
    order = digest_number(F.col("doc_id"), F.col("quality"))
    usable = labels.select("doc_id", "quality").filter("doc_id is not null and quality in (0, 1)")
    used = (
        usable.withColumn("key", order)
        .orderBy("key", "doc_id")
        .limit(most_labelled)
        .select("doc_id", "key", (F.col("quality") == 1).alias("good"))
    )
    found = (
        docs.select("doc_id", "text")
        .join(F.broadcast(used), "doc_id")
        .select("key", "good", "text")
        .mapInArrow(_vectors, "key long, good boolean, vector array<double>")
        .orderBy("key", "vector")
        .limit(most_labelled)
        .toArrow()
    )
    flat = found["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    model = rank(flat.reshape(len(found), len(features(""))), np.array(found["good"].to_pylist(), bool))
    if model.weights.any() and (len(found) == most_labelled or usable.count() > most_labelled):
        model.cut = cut_of_all(docs, usable, model)
    return model


def cut_of_all(docs: DataFrame, labels: DataFrame, model: Ranker) -> float:
    """The cut that lets as many of all labelled rows pass as are good, exactly.

    Texts become scores before the join, so only ids and scores are shuffled, whatever the number
    of labels.
    """

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([features(t.as_py()) for t in batch["text"]])
            scores = model.raw(made) if len(made) else []
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "raw"]
            )

    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    schema = StructType([texts.schema["doc_id"]]).add("raw", "double")
    rows = durable(texts.mapInArrow(raw, schema).join(labels, "doc_id").select("raw", "quality"))
    bad = rows.filter("quality = 0").count()
    at = order_statistics(rows, {"raw": [bad - 1, bad]})
    return (at["raw", bad - 1] + at["raw", bad]) / 2


def scored(docs: DataFrame, model: Ranker) -> DataFrame:
    """Add ``score`` (0 to 1) to every row; a null text scores like an empty one.

    Equal texts get equal scores; an existing column ``score`` is replaced.
    """

    def add(rows: pa.StructArray, _) -> list[pa.Array]:
        made = [features(t.as_py()) for t in rows.field("text")]
        return [pa.array(model.score(np.array(made)) if made else [], pa.float64())]

    return mapped(docs, add, StructType().add("score", "double"))


def held_out(doc_id: str = "doc_id"):
    """Documents whose label is never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))
