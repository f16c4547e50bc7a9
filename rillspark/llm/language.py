"""Language identification with error-correcting output codes.

Every language has a codeword. For each of its bits a binary naive-Bayes classifier over hashed
character n-grams tells the languages with a 1 from those with a 0. A text is given the language
whose codeword loses least against all bits, each weighted by how well its classifier tells the
two sides apart; wrong bits are outvoted. A text whose two best codewords are close is ambiguous.

Bits only say which side a text is nearer to, so a text like neither side may lose nothing. How
far it is from everything learned is its ``distance``: the nats that an n-gram of the text costs
under the profile of a language, over what one of that language costs on average, least of all
languages; short texts count less. ``distance_limit`` takes from the learned rows how far a text may be.

Training is one distributed sum: n-gram counts per language over all labelled rows, whole texts,
no sample. What reaches the driver is one vector of ``BUCKETS`` counts per language.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillspark.llm.tables import mapped, small_batches
from rillspark.operators.quantiles import column_quantiles
from rillspark.session import durable

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
# Languages up to which a code has all useful bits, and bits per doubling of their number beyond.
FULL_CODES = 64
BITS_PER_DOUBLING = 16
SMOOTHING = 0.5
AMBIGUOUS = 0.6
# The limit of the distance lies so many times as far above the median as the quantile does.
FAR_QUANTILE = 0.99
FAR_TIMES = 6
# So many n-grams are full evidence.
ENOUGH = 300
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_SPACE = np.uint32(32)


def _letter_table() -> np.ndarray:
    """Lower-case code point of every letter in the basic plane; everything else is a space."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_LETTERS: list[np.ndarray] = []


def letters_of(text: str) -> np.ndarray:
    """Code points in lower case with each run of other characters as one space."""
    if not _LETTERS:
        _LETTERS.append(_letter_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = points >= 0x10000
    low = _LETTERS[0][np.where(high, 0, points)]
    if high.any():
        at = np.flatnonzero(high)
        low[at] = [p if chr(p).isalpha() else 32 for p in points[at].tolist()]
    gap = low == _SPACE
    low = low[~(gap & np.r_[False, gap[:-1]])]
    return np.r_[_SPACE, low, _SPACE] if len(low) else low


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed character n-grams, or None where there is no letter."""
    points = letters_of(text) if text else np.zeros(0, np.uint32)
    if not (points != _SPACE).any():
        return None
    total = np.zeros(BUCKETS, np.int64)
    wide = points.astype(np.uint64) + np.uint64(1)
    hashed = np.zeros(len(wide), np.uint64)
    shift = np.uint64(64 - 15)
    for order in ORDERS:
        if len(wide) < order:
            break
        hashed = hashed[: len(wide) - order + 1] * _MIX[0] + wide[order - 1 :]
        slots = ((hashed ^ (hashed >> np.uint64(29))) * _MIX[1] + np.uint64(order)) * _MIX[2]
        total += np.bincount((slots >> shift).astype(np.int64), minlength=BUCKETS)
    return total


def codewords(languages: int) -> np.ndarray:
    """Rows of +1 and -1, far apart from each other and with no useless column.

    Up to six languages use every way of splitting them in two; more use a Hadamard matrix. Beyond
    ``FULL_CODES`` languages it is a fixed choice of its columns whose number grows with the logarithm of theirs.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 6:
        halves = [(1, *rest) for rest in itertools.product((1, -1), repeat=languages - 1)][1:]
        return np.array(halves, float).T
    size = 1 << (2 * languages - 1).bit_length()
    columns = range(1, size)
    if languages > FULL_CODES:
        by_digest = sorted(columns, key=lambda j: hashlib.md5(str(j).encode()).digest())
        columns = by_digest[: BITS_PER_DOUBLING * (languages - 1).bit_length()]
    bits = np.array([[(-1) ** (i & j).bit_count() for j in columns] for i in range(languages)])
    return bits[:, abs(bits.sum(0)) < languages].astype(float)


@dataclass
class Model:
    """``weights`` has a column per bit: log odds of the n-grams; ``trust`` weighs the bits.

    ``counts`` are the learned n-grams, a row per language.
    """

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    counts: np.ndarray
    ambiguous: float = AMBIGUOUS

    @cached_property
    def usual(self) -> np.ndarray:
        """Nats that an n-gram of each language costs on average under the language's own profile."""
        shares = _shares(self.counts)
        return -(shares * np.log(shares)).sum(1)

    @cached_property
    def totals(self) -> np.ndarray:
        return self.counts.sum(1)

    def distance(self, counts: np.ndarray | None, lang: str | None = None) -> float:
        """How many nats an n-gram costs over the usual under the language where that is least.

        ``lang`` names the language that learned from this very text; it then counts as not learned.
        """
        if counts is None or not self.languages:
            return float("inf")
        used = np.flatnonzero(counts)
        own = counts[used]
        learned, total = self.counts[:, used], self.totals.copy()
        if lang in self.languages:
            at = self.languages.index(lang)
            learned[at] -= own
            total[at] -= own.sum()
        shares = (learned + SMOOTHING) / (total + SMOOTHING * BUCKETS)[:, None]
        least = (-np.log(shares) @ own / own.sum() - self.usual).min()
        # The mean over few n-grams varies with the root of their number.
        return float(least * np.sqrt(min(own.sum(), ENOUGH) / ENOUGH))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score in [0, 1] and whether the decision is ambiguous."""
        return self.decided(ngram_counts(text))

    def decided(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        """``predict`` for the n-grams of a text."""
        if counts is None or not self.languages:
            return "und", 0.0, True
        # Evidence grows with the text, but neighbouring n-grams say the same: count them less.
        used = counts.sum()
        margins = (counts @ self.weights) / used * min(used, ENOUGH) / 10 + self.bias
        loss = np.logaddexp(0, -self.codes * margins) @ self.trust
        low = np.exp(loss.min() - loss)
        share = low / low.sum()
        best = int(share.argmax())
        return self.languages[best], float(share[best]), bool(share[best] < self.ambiguous)


def _language_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"].to_pylist(), strict=True):
            counts = ngram_counts(text.as_py())
            if counts is not None:
                sums[lang] = sums.get(lang, 0) + counts
                rows[lang] = rows.get(lang, 0) + 1
    for lang, counts in sums.items():
        used = np.flatnonzero(counts)
        yield pa.record_batch(
            {
                "lang": pa.array([lang] * (len(used) + 1), pa.string()),
                "slot": pa.array(np.r_[used, -1], pa.int32()),
                "n": pa.array(np.r_[counts[used], rows[lang]], pa.int64()),
            }
        )


def fit(labelled: DataFrame) -> Model:
    """Learn from all rows of text and lang; a null lang or a text without letters teaches nothing.

    Each language is one vector of counts (256 KB) on the driver and in the model, however many rows it has.
    """
    small_batches(labelled.sparkSession)
    pairs = labelled.select("text", "lang").filter("text is not null and lang is not null")
    sums = (
        pairs.mapInArrow(_language_sums, "lang string, slot int, n long")
        .groupBy("lang", "slot")
        .agg(F.sum("n").alias("n"))
    )
    # One row per language: its counts side by side. Bounded by languages times buckets.
    found = (
        sums.groupBy("lang")
        .agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("counts"))
        .orderBy("lang")
        .collect()
    )
    languages = [r["lang"] for r in found]
    counts, rows = np.zeros((len(found), BUCKETS)), np.zeros(len(found))
    for i, r in enumerate(found):
        slots, n = np.array(r["slots"]), np.array(r["counts"], float)
        counts[i, slots[slots >= 0]] = n[slots >= 0]
        rows[i] = n[slots < 0].sum()
    return _model(languages, counts, rows)


def _shares(counts: np.ndarray) -> np.ndarray:
    return (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)


def _model(languages: list[str], counts: np.ndarray, rows: np.ndarray) -> Model:
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((BUCKETS, 1)), np.zeros(1), np.ones(1), counts)
    # Every language counts the same inside a bit, however many rows it has.
    shares = _shares(counts)
    plus, minus = codes > 0, codes < 0
    ones = shares.T @ plus / plus.sum(0)
    zeros = shares.T @ minus / minus.sum(0)
    weights = np.log(ones) - np.log(zeros)
    # Mean margin of each language at each bit: the middle is the bias, the smallest gap the trust.
    means = shares @ weights
    lowest = np.where(plus, means, np.inf).min(0)
    highest = np.where(minus, means, -np.inf).max(0)
    bias = -(lowest + highest) / 2
    gap = np.maximum(lowest - highest, 1e-3)
    return Model(languages, codes, weights + bias, np.zeros(codes.shape[1]), gap / gap.sum() * len(gap), counts)


def distance_limit(labelled: DataFrame, model: Model) -> float | None:
    """The largest distance of a text that is like what was learned, from all rows learned from.

    Each row is held against the model without it. The limit lies ``FAR_TIMES`` as far above the
    median as the ``FAR_QUANTILE`` does, both exact, so clean rows stay and up to one odd row in a
    hundred does not move it much. None where nothing was learned.
    """
    small_batches(labelled.sparkSession)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["text"], batch["lang"].to_pylist(), strict=True)
            made = ((ngram_counts(text.as_py()), lang) for text, lang in pairs)
            far = [model.distance(counts, lang) for counts, lang in made if counts is not None]
            yield pa.record_batch({"distance": pa.array(far, pa.float64())})

    pairs = labelled.select("text", "lang").filter("text is not null and lang is not null")
    far = durable(pairs.mapInArrow(distances, "distance double"))
    middle, high = column_quantiles(far, ["distance"], [0.5, FAR_QUANTILE])["distance"]
    return None if middle is None else middle + FAR_TIMES * (high - middle)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score, ambiguous and distance to every row.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned; such
    rows count as ambiguous and are infinitely far. Equal texts get equal predictions; other columns are not looked at.
    """

    def predict(rows: pa.StructArray, _) -> list[pa.Array]:
        made = []
        for t in rows.field("text"):
            counts = ngram_counts(t.as_py())
            made.append((*model.decided(counts), model.distance(counts)))
        lang, score, unsure, far = zip(*made, strict=True) if made else ((), (), (), ())
        return [
            pa.array(lang, pa.string()),
            pa.array(score, pa.float64()),
            pa.array(unsure, pa.bool_()),
            pa.array(far, pa.float64()),
        ]

    added = StructType().add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    added = added.add("distance", "double")
    return mapped(docs, predict, added)


def held_out(doc_id: str = "doc_id"):
    """Documents that are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
