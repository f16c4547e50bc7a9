"""The trie of conversation prefixes, by vertical bitmaps.

Each conversation is a row of turns; a node of the trie is a distinct sequence of first turns. Conversations
are dealt into shards of some thousands, in order of their ids. A shard keeps, for every (position, turn), a bitset
of the conversations that have that turn there. Depth first, the bitset of a node intersected with the
postings of the next position gives its children; bit counts are their sizes, and a bitset of the conversations that
end at a depth gives the end lists.

A node is named by the exclusive or of 128-bit codes of its (position, turn) pairs, the same in every shard. So
shards meet by adding up: a node met in many of them is one row from each, and a first turn that a third
of all conversations share costs a row per shard. A node belongs to the shard of its smallest
member; sums over subtrees are taken in each shard over the nodes it owns, and added by name.

A conversation longer than ``WINDOW`` turns is cut into windows of positions; each is a unit of its
own, whose trie starts at the node where the window before ends. What is below a border is handed up as one number per
border node. So neither a hot conversation nor a hot turn is ever one task's work. Only the digest of an end
list is, as SHA-256 runs from front to back: one task streams the pieces of a list, one at a time in memory.

Rows without a conv_id are left out. Turns of equal number are ordered by role, then text; repeated rows are
turns of their own. Null role and text are empty. An empty table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspark.llm.tables import small_batches
from rillspark.session import durable

HUNDRED = 100
HEADS = 6
WINDOW = 1024
# Turns a task, conversations a shard; a shard holds at most one window more than its turns.
UNIT_TURNS = 50_000
SHARD_CONVS = 4096
SHARD_TURNS = 100_000

_NODES = {
    "part": "int", "shard": "long", "node": "int", "parent": "int", "k1": "long", "k2": "long", "depth": "long",
    "n": "long", "least": "long", "chars": "long", "inner": "boolean", "ends": "string",
}
_SUMS = {
    "k1": "long", "k2": "long", "depth": "long", "n_convs": "long", "conv_id": "long", "parent_conv_id": "long",
    "n_children": "long", "n_leaves": "long", "saved_tokens": "long",
}
_ARROW = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


def _sixty_bits(hex_digits: Column, start: int) -> Column:
    return F.conv(F.substring(hex_digits, start, 15), 16, 10).cast("long")


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, t1, t2 (digest of the turn), chars and number: the place of the row in order of conversation and turn.

    The sort runs over ranges of all its columns, so a conversation may span many tasks. Texts go no
    further than this.
    """
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        # Equal rows may go to different tasks.
        F.monotonically_increasing_id().alias("any"),
    )
    rows = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "any")
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    written = durable(
        rows.select("conv_id", said.alias("said"), F.length("text").cast("long").alias("chars")).select(
            "conv_id",
            _sixty_bits(F.col("said"), 1).alias("t1"),
            _sixty_bits(F.col("said"), 16).alias("t2"),
            "chars",
            F.monotonically_increasing_id().alias("serial"),
        )
    )
    task = F.shiftright("serial", 33)
    sizes = written.groupBy(task.alias("task")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # A row per task of the sort.
    sizes = sizes.select("task", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.col("serial") - F.shiftleft("task", 33)
    return written.withColumn("task", task).join(sizes, "task").select("conv_id", "t1", "t2", "chars", number.alias("number"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, base, pos, k1, k2, chars) and the conversations (conv_id, base, length) after the rule of heads."""
    turns = ordered_turns(conversations)
    convs = turns.groupBy("conv_id").agg(F.min("number").alias("first"), F.count("*").alias("own"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEADS)
    bases = convs.filter(F.col("conv_id") == F.col("base")).select("conv_id", "first")
    # At most five turns of each.
    heads = (
        turns.join(bases, "conv_id")
        .filter(F.col("number") - F.col("first") < HEADS - 1)
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("number", "t1", "t2", "chars"))).alias("head"))
    )
    convs = convs.join(heads, "base", "left").withColumn(
        "head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int"))
    )
    taken = F.size("head").cast("long")
    convs = durable(
        convs.select("*", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    )
    own = turns.join(convs.select("conv_id", "base", "first", "h", "taken"), "conv_id")
    own = own.withColumn("place", F.col("number") - F.col("first")).filter(F.col("place") >= F.col("h"))
    own = own.select("conv_id", "base", (F.col("place") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "chars")
    lead = convs.select("conv_id", "base", F.posexplode("head").alias("pos", "turn"))
    lead = lead.select("conv_id", "base", F.col("pos").cast("long").alias("pos"), "turn.t1", "turn.t2", "turn.chars")
    codes = [F.xxhash64("pos", "t1", "t2").alias("k1"), F.xxhash64("t2", "pos", "t1").alias("k2")]
    return own.unionByName(lead).select("conv_id", "base", "pos", *codes, "chars"), convs.select("conv_id", "base", "length")


def _units(turns: DataFrame, convs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Turns by window with a marker row per conversation and window, and the markers past the first window.

    A marker has pos -1, the length, and the name of the node at which its window starts.
    """
    part = lambda pos: F.floor(pos / window).cast("int")
    rows = turns.withColumn("part", part(F.col("pos"))).withColumn("length", F.lit(None).cast("long"))
    long = convs.filter(F.col("length") > window)
    codes = rows.join(long.select("conv_id"), "conv_id").groupBy("conv_id", "part")
    codes = codes.agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = codes.select("conv_id", "part", *[F.bit_xor(k).over(before).alias(k) for k in ("k1", "k2")])
    later = durable(starts.filter(F.col("part") > 0).join(long, "conv_id"))
    zero = F.lit(0).cast("long")
    first = convs.select("*", F.lit(0).alias("part"), zero.alias("k1"), zero.alias("k2"))
    markers = first.unionByName(later).select("*", F.lit(-1).cast("long").alias("pos"), zero.alias("chars"))
    return durable(rows.unionByName(markers)), later


class _Shard:
    """Bitsets of one shard: conversations in order of id, within one window."""

    def __init__(self, part: int, window: int):
        self.part, self.window = part, window
        self.ids: list[int] = []
        self.turns: list[list[tuple[int, int, int]]] = []
        self.roots: dict[tuple[int, int], int] = defaultdict(int)
        self.ends: dict[int, int] = defaultdict(int)
        self.postings: dict[tuple[int, int, int], int] = defaultdict(int)
        self.size = 0

    def open(self, conv_id: int, start: tuple[int, int], length: int) -> None:
        bit = 1 << len(self.ids)
        self.ids.append(conv_id)
        self.turns.append([])
        self.roots[start] |= bit
        self.ends[length - self.part * self.window] |= bit

    def add(self, k1: int, k2: int, chars: int) -> None:
        mine = self.turns[-1]
        self.postings[len(mine), k1, k2] |= 1 << (len(self.ids) - 1)
        mine.append((k1, k2, chars))
        self.size += 1

    def nodes(self) -> pa.RecordBatch:
        out: list[tuple] = []
        shard, base = self.ids[0], self.part * self.window
        # A border node is only named here: it is counted in the window in which it is reached.
        stack = [(bits, 0, *start, -1, 0) for start, bits in self.roots.items()]
        while stack:
            bits, depth, k1, k2, parent, chars = stack.pop()
            me = len(out)
            over = bits & self.ends[depth]
            rest = bits & ~over
            if parent < 0 and self.part:
                out.append((self.part, shard, me, parent, k1, k2, base, 0, None, 0, True, None))
            else:
                least = self.ids[(bits & -bits).bit_length() - 1]
                ends = ",".join(str(self.ids[i]) for i in _members(over)) if over else None
                out.append((self.part, shard, me, parent, k1, k2, base + depth, bits.bit_count(), least, chars, bool(rest), ends))
            if depth == self.window:
                continue
            while rest:
                c1, c2, width = self.turns[(rest & -rest).bit_length() - 1][depth]
                child = rest & self.postings[depth, c1, c2]
                rest &= ~child
                stack.append((child, depth + 1, k1 ^ c1, k2 ^ c2, me, width))
        columns = zip(*out)
        return pa.record_batch({f: pa.array(c, _ARROW[kind]) for (f, kind), c in zip(_NODES.items(), columns)})


def _members(bits: int) -> Iterator[int]:
    """Places of the bits that are set, ascending."""
    octets = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
    yield from np.flatnonzero(np.unpackbits(octets, bitorder="little")).tolist()


def _local_nodes(units: DataFrame, window: int, shard_convs: int) -> DataFrame:
    """The nodes of every shard, a row from each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for part, conv_id, pos, k1, k2, chars, length in zip(*[c.to_pylist() for c in batch.columns]):
                if pos >= 0:
                    shard.add(k1, k2, chars)
                    continue
                full = shard and (len(shard.ids) >= shard_convs or shard.size >= SHARD_TURNS)
                if shard and (full or shard.part != part):
                    yield shard.nodes()
                    shard = None
                shard = shard or _Shard(part, window)
                shard.open(conv_id, (k1, k2), length)
        if shard:
            yield shard.nodes()

    columns = ["part", "conv_id", "pos", "k1", "k2", "chars", "length"]
    tasks = -(-units.count() // UNIT_TURNS) or 1
    dealt = units.repartitionByRange(tasks, "part", "base").sortWithinPartitions("part", "conv_id", "pos")
    return dealt.select(*columns).mapInArrow(run, _ddl(_NODES))


def _border_sums(owned: DataFrame, later: DataFrame, window: int) -> DataFrame:
    """For nodes where a window ends: leaves and savings of what the conversations through them own further down."""
    mine = owned.filter(F.col("depth") > window).groupBy(
        F.col("least").alias("conv_id"), F.floor((F.col("depth") - 1) / window).cast("int").alias("part")
    )
    mine = mine.agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    on = later.select("conv_id", "part", "k1", "k2").join(mine, ["conv_id", "part"], "left")
    below = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
    sums = on.select("k1", "k2", *[F.coalesce(F.sum(c).over(below), F.lit(0)).alias(c) for c in ("leaf", "saving")])
    return sums.groupBy("k1", "k2").agg(F.sum("leaf").alias("below_leaf"), F.sum("saving").alias("below_saving"))


def _subtrees(table: pa.Table) -> pa.Table:
    """One shard: sums of owned nodes, from the deepest to the roots."""
    node = table["node"].to_numpy()
    back = np.empty(len(node), np.int64)
    back[node] = np.arange(len(node))

    def column(name: str) -> np.ndarray:
        return table[name].to_numpy()[back]

    parent, depth, least = column("parent"), column("depth"), column("whole_least")
    owned, border = column("owned").astype(bool), column("border").astype(bool)
    leaves, savings = column("leaf") * owned, column("saving") * owned
    leaves, savings = leaves + column("below_leaf") * owned, savings + column("below_saving") * owned
    children = np.zeros(len(node), np.int64)
    inside = parent >= 0
    np.add.at(children, parent[inside & owned], 1)
    # Nodes were numbered from the top, so parents have smaller numbers; a level at a time is enough.
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        level = level[inside[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(savings, parent[level], savings[level])
    leaves[border], savings[border] = 0, 0
    above = pa.array(least[np.maximum(parent, 0)], mask=~(inside & owned))
    made = [column("k1"), column("k2"), depth, column("whole_n"), least, above, children, leaves, savings]
    return pa.table({f: pa.array(c, pa.int64()) for f, c in zip(_SUMS, made)})


def _end_digests(local: DataFrame) -> DataFrame:
    """SHA-256 of each end list; the pieces of a list follow one another in order of their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = state = None

        def made():
            return pa.record_batch(
                {"k1": pa.array([name[0]], pa.int64()), "k2": pa.array([name[1]], pa.int64()), "ends_sha256": [state.hexdigest()]}
            )

        for batch in batches:
            done: list[pa.RecordBatch] = []
            for k1, k2, ends in zip(*[c.to_pylist() for c in batch.columns]):
                if (k1, k2) == name:
                    state.update(b"," + ends.encode())
                    continue
                if name:
                    done.append(made())
                name, state = (k1, k2), hashlib.sha256(ends.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if name:
            yield made()

    pieces = local.filter(F.col("ends").isNotNull()).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "shard")
    return pieces.select("k1", "k2", "ends").mapInArrow(run, "k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, window: int = WINDOW, shard_convs: int = SHARD_CONVS) -> DataFrame:
    """The nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(conversations.sparkSession)
    turns, convs = rebuilt(conversations)
    units, later = _units(turns, convs, window)
    local = durable(_local_nodes(units, window, shard_convs))
    everywhere = Window.partitionBy("k1", "k2")
    whole = local.drop("ends").select(
        "*",
        F.sum("n").over(everywhere).alias("whole_n"),
        F.min("least").over(everywhere).alias("whole_least"),
        F.max("inner").over(everywhere).alias("whole_inner"),
    )
    whole = whole.select(
        "*",
        F.coalesce(F.col("least") == F.col("whole_least"), F.lit(False)).alias("owned"),
        F.col("least").isNull().alias("border"),
        F.when(F.col("whole_inner"), 0).otherwise(1).cast("long").alias("leaf"),
        ((F.col("whole_n") - 1) * F.col("chars")).alias("saving"),
    )
    whole = durable(whole.drop("least", "n", "chars", "inner", "whole_inner"))
    owned = whole.filter("owned").withColumn("least", F.col("whole_least"))
    sums = whole.join(_border_sums(owned, later, window), ["k1", "k2"], "left").na.fill(0, ["below_leaf", "below_saving"])
    made = sums.groupBy("part", "shard").applyInArrow(_subtrees, _ddl(_SUMS))
    nothing = [F.lit(None).cast(kind).alias(f) for f, kind in _SUMS.items() if f not in ("k1", "k2")]
    ends = _end_digests(local).select("k1", "k2", *nothing, "ends_sha256")
    both = made.withColumn("ends_sha256", F.lit(None).cast("string")).unionByName(ends)
    tops = ["depth", "n_convs", "conv_id", "parent_conv_id", "ends_sha256"]
    found = both.groupBy("k1", "k2").agg(
        *[F.max(c).alias(c) for c in tops], *[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")]
    )
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
