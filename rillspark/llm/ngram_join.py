"""Similarity join on word n-grams: MinHash bands for candidates, full sets for the answer.

Texts are lower-cased words between white space; a text is the set of its runs of ``N`` words, or
its one shorter run. Texts with the same words are one class from the start, so exact copies cost
a row each and no comparison. A class gets ``bands`` hashes of ``rows`` minima; classes that
agree in a band are compared on their whole sets, and linked at Jaccard ``AT_LEAST`` and more.

Band and row counts come from the wanted recall at the threshold. A pair that agrees in several
bands is compared in the first of them only. Bands with the same members count once. A band with
many members is cut into blocks, every pair of blocks is a task's unit of work, and a unit gives
back a line per document (its links, its local component), never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.llm.components import components
from rillspark.llm.tables import packed, small_batches
from rillspark.session import durable

N = 5
AT_LEAST = 0.8
RECALL = 0.999
MOST_HASHES = 128
BLOCK_ROWS = 512
BLOCK_GRAMS = 1_000_000
BROADCAST_ROWS = 1_000_000  # keys of 16 bytes; more are joined by a shuffle
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    np.uint64,
)


def bands_for(at_least: float = AT_LEAST, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): most rows, so fewest chance candidates, that reach ``recall`` at ``at_least``."""
    best = None
    for rows in range(1, most + 1):
        agree = at_least**rows
        if agree < 1 / most**2:  # far too rare for so few hashes
            break
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-agree))) if agree < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no such recall with so few hashes")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_set(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of word hashes; of all words if there are fewer."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.view(np.uint64)
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total = _mixed(total * _ODD[k % len(_ODD)] + words[k : len(words) - size + 1 + k])
    return np.unique(total)


def band_hashes(grams: np.ndarray, bands: int, rows: int, seed: int = 4) -> np.ndarray:
    """One signed 64-bit hash per band of the minima of ``bands * rows`` hash functions."""
    draw = np.random.default_rng(seed)
    a = draw.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 2**64 - 1, bands * rows, np.uint64)
    least = np.full(bands * rows, 2**64 - 1, np.uint64)
    for i in range(0, len(grams), 2048):
        part = grams[i : i + 2048]
        # The high half of a product mixes all bits of the gram.
        np.minimum(least, ((part * a[:, None] + b[:, None]) >> np.uint64(20)).min(1), out=least)
    least = least.reshape(bands, rows)
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = _mixed(out * _ODD[0] + least[:, r])
    return out.view(np.int64)


def _words(text):
    """Hashes of the lower-case words of a text column, in order."""
    split = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    return F.transform(split, lambda w: F.xxhash64(w))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key: 16 bytes that texts share if and only if they share their words.

    The key is null where there is no word; such a text is like no other.
    """
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    key = F.when(F.coalesce(plain, F.lit("")) != "", F.unhex(F.md5(plain)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("key"))


def _signatures(bands: int, rows: int, n: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, signed = [], []
            words, offsets = batch["words"].flatten().to_numpy(), batch["words"].offsets.to_numpy()
            offsets = offsets - offsets[0]
            for a, b in zip(offsets, offsets[1:], strict=False):
                grams = gram_set(words[a:b], n)
                sizes.append(len(grams))
                signed.append(band_hashes(grams, bands, rows))
            flat = np.concatenate(signed) if signed else np.zeros(0, np.int64)
            ends = pa.array(np.arange(len(signed) + 1, dtype=np.int32) * bands)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["key"], pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(flat))],
                names=["doc_id", "key", "n_grams", "bands"],
            )

    return sign


def _gram_table(n: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, offsets = batch["words"].flatten().to_numpy(), batch["words"].offsets.to_numpy()
            offsets = offsets - offsets[0]
            made = [gram_set(words[a:b], n).tobytes() for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(made, pa.binary())], names=["key", "grams"])

    return grams


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs (i, j) of sorted sets."""
    n = len(sets)
    if len(pairs) <= 4 * n:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    # Shared grams only, a few thousand columns at a time: memory stays small.
    counts = np.bincount(column, minlength=len(values))
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((n, n), np.float32)
    for start in range(0, len(shared), 2048):
        a, b = np.searchsorted(column, [start, start + 2048])
        there = np.zeros((n, min(2048, len(shared) - start)), np.float32)
        there[row[a:b], column[a:b] - start] = 1
        total += there @ there.T
    return np.rint(total[pairs[:, 0], pairs[:, 1]]).astype(np.int64)


def unit_links(
    sets: list[np.ndarray], signed: np.ndarray, band: int, block: np.ndarray, crossing: bool, at_least: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a unit that are linked, and their Jaccard.

    A pair counts if ``band`` is the first band it agrees in and, in a unit of two blocks, if it
    lies across them.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ok = np.triu(signed[:, band, None] == signed[None, :, band], 1)
    for earlier in range(band):
        ok &= signed[:, earlier, None] != signed[None, :, earlier]
    if crossing:
        ok &= block[:, None] != block[None, :]
    ok &= np.minimum(sizes[:, None], sizes) >= at_least * np.maximum(sizes[:, None], sizes)
    pairs = np.argwhere(ok)
    if not len(pairs):
        return pairs, np.zeros(0)
    both = _overlaps(sets, pairs)
    jaccard = both / (sizes[pairs].sum(1) - both)
    linked = jaccard >= at_least
    return pairs[linked], jaccard[linked]


def _local_roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], root[pairs[:, 0]])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _verified(at_least: float, as_pairs: bool):
    """Reads rows sorted by unit and gives a line per linked document, or per linked pair."""

    def finish(unit: pa.Table) -> pa.RecordBatch | None:
        if len(unit) < 2:
            return None
        unit = unit.sort_by("key")
        sets = [np.frombuffer(g, np.uint64) for g in unit["grams"].to_pylist()]
        signed = np.array(unit["bands"].combine_chunks().flatten()).reshape(len(unit), -1)
        i, j = unit["i"][0].as_py(), unit["j"][0].as_py()
        pairs, jaccard = unit_links(
            sets, signed, unit["band"][0].as_py(), unit["block"].to_numpy(), i != j, at_least
        )
        if not len(pairs):
            return None
        keys, members = unit["key"].combine_chunks(), unit["members"].to_numpy()
        if as_pairs:
            return pa.record_batch({"key_a": keys.take(pairs[:, 0]), "key_b": keys.take(pairs[:, 1]), "jaccard": jaccard})
        links = np.bincount(pairs[:, 0], members[pairs[:, 1]], len(unit))
        links += np.bincount(pairs[:, 1], members[pairs[:, 0]], len(unit))
        roots = _local_roots(len(unit), pairs)
        at = np.flatnonzero(links)
        return pa.record_batch(
            {"key": keys.take(at), "root": keys.take(roots[at]), "links": pa.array(links[at].astype(np.int64))}
        )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            ids = list(zip(batch["bucket"].to_pylist(), batch["i"].to_pylist(), batch["j"].to_pylist(), strict=True))
            start = 0
            for row in range(len(ids) + 1):
                if row < len(ids) and ids[row] == (ids[start] if row > start else ids[row]):
                    continue
                if ids[start] != current and waiting:
                    if (made := finish(pa.Table.from_batches(waiting))) is not None:
                        yield made
                    waiting = []
                current = ids[start]
                waiting.append(batch.slice(start, row - start))
                start = row
        if waiting and (made := finish(pa.Table.from_batches(waiting))) is not None:
            yield made

    return verify


def _candidates(docs: DataFrame, at_least: float, recall: float, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with keys, classes of equal texts, and the rows of all units with their sets."""
    small_batches(docs.sparkSession)
    bands, rows = bands_for(at_least, recall)
    own = keyed(docs)
    with_words = own.filter("key is not null").select("doc_id", "key", _words(F.col("text")).alias("words"))
    signed = durable(
        with_words.mapInArrow(
            _signatures(bands, rows, n), "doc_id long, key binary, n_grams int, bands array<long>"
        )
    )
    classes = durable(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("members"),
            F.first("n_grams").alias("n_grams"),
            F.first("bands").alias("bands"),
        )
    )
    each = classes.select("key", "n_grams", F.posexplode("bands").alias("band", "bucket"))
    shared = (
        each.groupBy("band", "bucket")
        .agg(
            F.count(F.lit(1)).alias("_rows"),
            F.sum(F.col("n_grams").cast("long")).alias("_grams"),
            F.bit_xor(F.xxhash64("key")).alias("_same"),
        )
        .filter("_rows > 1")
        # The same members in several bands: the first band does.
        .groupBy("_rows", "_grams", "_same")
        .agg(F.min(F.struct("band", "bucket")).alias("at"))
        .select(
            "at.*",
            F.greatest(F.ceil(F.col("_rows") / BLOCK_ROWS), F.ceil(F.col("_grams") / BLOCK_GRAMS))
            .cast("int")
            .alias("blocks"),
        )
    )
    block = F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int")
    placed = durable(each.join(shared, ["band", "bucket"]).select("key", "band", "bucket", "blocks", block.alias("block")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = placed.withColumn("_other", other).select(
        "key",
        "band",
        "bucket",
        "block",
        F.least("block", "_other").alias("i"),
        F.greatest("block", "_other").alias("j"),
    )
    wanted = placed.select("key").distinct().join(classes, "key").select("key", "first_id")
    wanted = durable(wanted)
    first = wanted.select(F.col("key").alias("_key"), F.col("first_id"))
    if wanted.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    grams = (
        own.join(first, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
        .select("key", _words(F.col("text")).alias("words"))
        .mapInArrow(_gram_table(n), "key binary, grams binary")
        .dropDuplicates(["key"])
    )
    sets = grams.join(classes.select("key", "members", "bands"), "key")
    return signed, classes, units.join(sets, "key")


def _by_unit(units: DataFrame) -> DataFrame:
    return units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def similar_pairs(
    docs: DataFrame, at_least: float = AT_LEAST, recall: float = RECALL, n: int = N
) -> DataFrame:
    """The join itself: pairs of classes (by the smallest doc_id of each) and their Jaccard."""
    _, classes, units = _candidates(docs, at_least, recall, n)
    found = _by_unit(units).mapInArrow(
        _verified(at_least, True), "key_a binary, key_b binary, jaccard double"
    )
    name = lambda side: classes.select(F.col("key").alias(f"key_{side}"), F.col("first_id").alias(f"id_{side}"))
    return (
        found.join(name("a"), "key_a")
        .join(name("b"), "key_b")
        .select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "jaccard")
    )


def joined(docs: DataFrame, at_least: float = AT_LEAST, recall: float = RECALL, n: int = N) -> DataFrame:
    """doc_id, class_id, copy_of and n_links of every document.

    ``copy_of`` is the smallest doc_id with the same words, ``class_id`` the smallest doc_id that
    links lead to, and ``n_links`` the number of other documents at Jaccard ``at_least`` or more,
    copies included. A text without words (null, empty, white space) is alone: its own class, no
    link. Rows are kept one for one; rows that share a doc_id keep their own texts. A class whose
    doc_ids are all null has null names. Other columns are ignored, whatever their names.
    """
    signed, classes, units = _candidates(docs, at_least, recall, n)
    lines = durable(
        _by_unit(units).mapInArrow(_verified(at_least, False), "key binary, root binary, links long")
    )
    roots = components(lines.select(F.col("key").alias("u"), F.col("root").alias("v")))
    links = lines.groupBy("key").agg(F.sum("links").alias("links"))
    linked = classes.select("key", "first_id", "members").join(
        roots.withColumnRenamed("node", "key"), "key", "left"
    ).withColumn("root", F.coalesce("root", "key"))
    names = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    # Written down, so that the last join stands alone and a text with many copies can be split.
    named = durable(
        linked.join(names, "root")
        .join(links, "key", "left")
        .select(
            "key",
            "class_id",
            F.col("first_id").alias("copy_of"),
            (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        )
    )
    alone = keyed(docs).filter("key is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links")
    )
    return signed.select("doc_id", "key").join(named, "key").drop("key").unionByName(alone)


def one_of_each(docs: DataFrame, at_least: float = AT_LEAST, recall: float = RECALL, n: int = N) -> DataFrame:
    """The documents with one of each class of near-duplicates, all their columns kept.

    The one with the smallest doc_id stays; of rows that share that doc_id and their words, one.
    Texts without words are like no other and all stay. The join back is on words and doc_id, so
    that the copies of a hot text do not meet in one task.
    """
    _, classes, units = _candidates(docs, at_least, recall, n)
    lines = durable(
        _by_unit(units).mapInArrow(_verified(at_least, False), "key binary, root binary, links long")
    )
    roots = components(lines.select(F.col("key").alias("u"), F.col("root").alias("v")))
    stays = (
        classes.select("key", "first_id")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .groupBy(F.coalesce("root", "key").alias("root"))
        # A null doc_id stays only where there is no other.
        .agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("_one"))
        .select(F.col("_one.key").alias("_key"), F.col("_one.first_id").alias("_id"))
    )
    plain = F.trim(F.regexp_replace(F.lower("_doc.text"), r"\s+", " "))
    key = F.when(F.coalesce(plain, F.lit("")) != "", F.unhex(F.md5(plain)))
    own = packed(docs).withColumn("_words", key)
    kept = own.join(
        stays,
        (F.col("_words") == F.col("_key")) & F.col("_doc.doc_id").cast("long").eqNullSafe(F.col("_id")),
    )
    once = kept.groupBy("_words", "_id").agg(F.first("_doc").alias("_doc"))
    return once.select("_doc.*").unionByName(own.filter("_words is null").select("_doc.*"))
