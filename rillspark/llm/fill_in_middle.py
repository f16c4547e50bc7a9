"""Fill-in-the-middle: texts cut at two unit ranks and put together in another order.

A unit is a run of ASCII letters or any other single character. The units of a text form an indexable
skip list: the lowest lane has a node per unit, each lane above a node per ``FAN`` nodes of the lane
below, and every node knows how many units and how many code points it spans. To reach a cut, one
goes along the highest lane as far as its unit widths stay within the rank, then down a lane, and has
passed exactly the rank and its code points at the bottom: about ``FAN`` steps a lane, for texts of
any length.

Ranks and form come from the digits of a keyed SHA-256 of the document id, so any rerun agrees. Work is row
by row, without a shuffle. Null texts are empty, a null id hashes like an empty one, equal rows give
equal results, and other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rillspark.llm.tables import mapped

# The marks in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM = 90
SPM_BELOW = 20
FAN = 16

ADDED = StructType(
    [
        StructField("n", LongType()),
        StructField("form", StringType()),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
        StructField("output", StringType()),
    ]
)


def unit_starts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the units of a UTF-8 text begin, and the code points of each."""
    octets = np.frombuffer(data, np.uint8)
    folded = octets | 0x20
    letter = (folded >= ord("a")) & (folded <= ord("z"))
    starts = (octets & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    offsets = np.flatnonzero(starts)
    return offsets, np.where(letter[offsets], np.diff(offsets, append=len(data)), 1)


class SkipList:
    """Lanes of (units, code points) spanned per node, the lowest first."""

    def __init__(self, code_points: np.ndarray, fan: int = FAN):
        self.fan = fan
        units = np.ones(len(code_points), np.int64)
        self.lanes = [(units, code_points.astype(np.int64))]
        while len(units) > fan:
            heads = np.arange(0, len(units), fan)
            units, code_points = np.add.reduceat(units, heads), np.add.reduceat(code_points, heads)
            self.lanes.append((units, code_points))

    def reach(self, rank: int) -> tuple[int, int]:
        """Node of the lowest lane in front of which ``rank`` units lie, and their code points."""
        node = passed = chars = 0
        for units, code_points in reversed(self.lanes):
            # The last node of the lane above may span fewer.
            node = min(node * self.fan, len(units))
            while node < len(units) and passed + units[node] <= rank:
                passed += int(units[node])
                chars += int(code_points[node])
                node += 1
        return node, chars


def _cut(data: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple[int, str, int | None, int | None, bytes]:
    if not data:
        return 0, "plain", None, None, data
    offsets, code_points = unit_starts(data)
    n = len(offsets)
    if h3 % 100 >= PLAIN_FROM or any(mark.encode() in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    lanes = SkipList(code_points)
    (first, prefix_chars), (second, chars) = (lanes.reach(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    a, b = (int(offsets[node]) if node < n else len(data) for node in (first, second))
    prefix, middle, suffix = (PREFIX.encode(), data[:a]), (MIDDLE.encode(), data[a:b]), (SUFFIX.encode(), data[b:])
    form, order = ("spm", (suffix, prefix, middle)) if h4 % 100 < SPM_BELOW else ("psm", (prefix, suffix, middle))
    return n, form, prefix_chars, chars - prefix_chars, b"".join(part for pair in order for part in pair)


def transformed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The rows with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = {f"_h{i}": F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)}

    names = list(draws)

    def work(_: pa.StructArray, batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch["_text"].cast(pa.binary()).to_pylist()
        made = [_cut(t, *h) for t, *h in zip(texts, *[batch[name].to_pylist() for name in names])]
        columns = list(zip(*made)) if made else [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return [*arrays[:4], arrays[4].cast(pa.string())]

    return mapped(docs, work, ADDED, _text=F.coalesce(F.col("text"), F.lit("")), **draws)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made.

    Marks occur nowhere but where they were put: a text that holds one stays plain, and as a mark has one
    ``<``, in front, and one ``>``, at its end, no piece can make one together with a real mark.
    """

    def between(left: str, right: str | None) -> Column:
        behind = F.substring_index(output, left, -1)
        return F.substring_index(behind, right, 1) if right else behind

    parts = {
        "psm": (between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE)),
        "spm": (between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX)),
    }
    choice = F.when(form == "psm", F.concat(*parts["psm"])).when(form == "spm", F.concat(*parts["spm"]))
    return choice.otherwise(output)
