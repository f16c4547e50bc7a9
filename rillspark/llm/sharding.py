"""Sharding over fixed virtual slots.

A record hashes into one of a few thousand slots, for good. A small table says which shard holds
a slot. Its versions are kept: a change of the number of shards, or slots that have grown unevenly,
edit the table, and only the records of edited slots move.

Rows that agree in every column that the hash sees are told apart by a copy number, so that a
record repeated a million times spreads over the slots like a million records.

Everything is DataFrame work. The slot table has ``slots`` rows whatever the input, and that is
also the bound of the one broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillspark.llm.tables import digest_number, told_apart
from rillspark.session import durable

SLOTS = 4096
MOST_SLOTS = 65_536


def in_slots(rows: DataFrame, key: list[str], slots: int = SLOTS, slot: str = "slot") -> DataFrame:
    """Add the slot of each row: md5 of its key, modulo the number of slots."""
    if not 1 <= slots <= MOST_SLOTS:
        raise ValueError(f"between 1 and {MOST_SLOTS} slots")
    number = digest_number(*[F.col(c) for c in key], digits=8)
    return rows.withColumn(slot, (number % slots).cast("int"))


def slot_sizes(rows: DataFrame, size: str, slots: int = SLOTS, slot: str = "slot") -> DataFrame:
    """Bytes and rows of every slot, empty ones included."""
    found = rows.groupBy(slot).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias(slot))
    return every.join(found, slot, "left").select(
        slot, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bytes", "rows")]
    )


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slot modulo shards, which needs no data."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(
        F.lit(1).alias("version"), slot.alias("slot"), (slot % shards).alias("shard")
    )


def edited_map(current: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a slot table, balanced by bytes over ``shards`` shards.

    Slots are visited by falling size. One that fits under the mean load stays where it is; the
    others, and those of shards that are gone, go to the least loaded shard, again by falling
    size. No shard ends above the mean by more than the largest slot that moved, but for one that
    holds nothing else than a single slot above the mean.
    """
    largest_first = F.array_sort(
        F.collect_list(F.struct(-F.col("bytes"), F.col("slot"), F.col("shard"), F.col("version")))
    )
    one = sizes.join(current, "slot").agg(largest_first.alias("s"), F.sum("bytes").alias("total"))
    loads = f"array_repeat(0L, {shards})"
    add = "transform(a.loads, (v, i) -> if(i = {to}, v - x.col1, v))"
    # A slot above the mean fills a shard by itself and does not raise the mean of the others. The
    # mean starts the fold: written into its lambda it would be worked out for every slot.
    mean = f"""
        aggregate(s, named_struct('bytes', total, 'shards', {shards}),
            (a, x) -> if(a.shards > 1 and -x.col1 * a.shards > a.bytes,
                named_struct('bytes', a.bytes + x.col1, 'shards', a.shards - 1), a),
            a -> a.bytes div a.shards)"""
    keep = f"""
        aggregate(s, named_struct('mean', {mean}, 'loads', {loads}, 'to', cast(array() as array<int>)),
            (a, x) -> if(x.shard < {shards} and element_at(a.loads, least(x.shard + 1, {shards})) - x.col1 <= a.mean,
                named_struct('mean', a.mean, 'loads', {add.format(to="x.shard")}, 'to', a.to || array(x.shard)),
                named_struct('mean', a.mean, 'loads', a.loads, 'to', a.to || array(-1))))"""
    least = "cast(array_position(a.loads, array_min(a.loads)) - 1 as int)"
    place = f"""
        aggregate(arrays_zip(s, kept.to), named_struct('loads', kept.loads, 'to', cast(array() as array<int>)),
            (a, y) -> if(y.to >= 0,
                named_struct('loads', a.loads, 'to', a.to || array(y.to)),
                named_struct('loads', transform(a.loads, (v, i) -> if(i = {least}, v - y.s.col1, v)),
                             'to', a.to || array({least}))))"""
    return (
        one.select("s", F.expr(keep).alias("kept"))
        .select("s", F.expr(place).alias("placed"))
        .select(F.explode(F.arrays_zip("s", "placed.to")).alias("e"))
        .select(
            (F.col("e.s.version") + 1).alias("version"),
            F.col("e.s.slot").alias("slot"),
            F.col("e.to").alias("shard"),
            F.col("e.s.shard").alias("shard_before"),
            (-F.col("e.s.col1")).alias("bytes"),
        )
    )


def store_map(slot_map: DataFrame, path: str) -> None:
    """Append one version to the stored slot table; a folder per version, none rewritten."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the slot table, the newest by default."""
    every = spark.read.parquet(path)
    if version is None:
        version = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == version)


def placed(rows: DataFrame, slot_map: DataFrame, slot: str = "slot") -> DataFrame:
    """Add the shard of each row. The slot table has at most ``MOST_SLOTS`` rows."""
    shard_of = slot_map.select(F.col("slot").alias(slot), "shard")
    return rows.join(F.broadcast(shard_of), slot)


def positions(
    rows: DataFrame, sizes: DataFrame, slot_map: DataFrame, order: list[str], slot: str = "slot"
) -> DataFrame:
    """Add shard and position: gapless from 0 in each shard, slot by slot, ``order`` within one.

    Sorting happens per slot; the rows of earlier slots are an offset from the slot table.
    """
    before = Window.partitionBy("shard").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(slot_map.select(F.col("slot").alias(slot), "shard"), slot).select(
        slot, "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_before")
    )
    within = F.row_number().over(Window.partitionBy(slot).orderBy(*order))
    return (
        rows.withColumn("_within", within)
        .join(F.broadcast(offsets), slot)
        .withColumn("position", (F.col("_before") + F.col("_within") - 1).cast("long"))
        .drop("_within", "_before")
    )


def shard_documents(
    docs: DataFrame, shards: int, map_path: str, slots: int = SLOTS
) -> DataFrame:
    """Documents over shards 0 to ``shards`` - 1 with near equal bytes; the map is stored.

    Returns doc_id, size (UTF-8 bytes plus 1; 1 for a null text), text_crc32 (of the UTF-8 bytes;
    0 for a null or empty text), virtual_slot, shard and position. A null doc_id hashes like any
    other value. Equal rows are separate records. An empty table gives no rows (and a stored
    map). Other columns are ignored, whatever their names.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    key = ["doc_id", "size", "text_crc32"]
    apart = told_apart(rows, key, "_copy")
    apart = durable(in_slots(apart, [*key, "_copy"], slots, "virtual_slot"))
    sizes = slot_sizes(apart, "size", slots, "virtual_slot").withColumnRenamed("virtual_slot", "slot")
    store_map(first_map(docs.sparkSession, shards, slots), map_path)
    store_map(
        edited_map(stored_map(docs.sparkSession, map_path), sizes, shards).drop("shard_before", "bytes"),
        map_path,
    )
    newest = stored_map(docs.sparkSession, map_path)
    sizes = sizes.withColumnRenamed("slot", "virtual_slot")
    return positions(apart, sizes, newest, [*key, "_copy"], "virtual_slot").drop("_copy")
