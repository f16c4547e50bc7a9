"""Allow and block rules for urls, looked up in a sorted array of digests.

A rule is a host and a path: it fits that host and its subdomains where the path of the url starts with
its own; the longest fitting rule decides. Rules are written down as parts of a sorted array: 64-bit xxhash keys, and
beside them the full strings. A task maps the parts into memory, so that all tasks of a machine share
their pages, probes a whole batch by one vectorised binary search, and believes a hit only if the stored string
is the one asked for, so colliding digests do no harm.

Two kinds of entries keep the number of probes small: one per host, holding the lengths of that
host's rule paths, and one per rule. A batch first asks for the host suffixes of its distinct hosts, then,
for hosts found, for paths cut to the lengths that occur there. Urls are never shuffled; rules are
sorted by Spark and never pass through the driver, which holds one line per part.

A null url, or one without ``://``, has an empty host and path and no rule. Of equal rules with
different verdicts ``block`` holds. Null hosts and paths of rules are empty; an empty host fits
only urls whose host is empty. A url that no rule fits gets the verdict ``otherwise``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rillspark.llm.tables import mapped
from rillspark.llm.warc import qualified
from rillspark.session import durable

# The rules of the query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
PART_KEYS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = b"block"

ADDED = StructType([StructField(name, StringType()) for name in ("host", "path", "rule", "verdict")])


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, in lower-case ASCII, and path of a url; both empty where it has no ``://``."""
    behind = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    behind = F.coalesce(behind, F.lit(""))
    host = F.regexp_extract(behind, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(behind, F.length(host) + 1, F.length(behind)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def digest(entry: bytes) -> int:
    """The key of an entry, moved so that signed and unsigned order agree."""
    return xxhash.xxh64_intdigest(entry) - (1 << 63)


def host_entry(host: bytes) -> bytes:
    return b"h" + host


def rule_entry(host: bytes, path: bytes) -> bytes:
    return b"r%b\0%b" % (host, path)


def write_rules(rules: DataFrame, folder: str, part_keys: int = PART_KEYS) -> DataFrame:
    """Write the sorted array; returns its manifest: path, first key, entries and longest host of each part."""
    spark = rules.sparkSession
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    clean = rules.select(
        F.encode(F.translate(text("host"), UPPER, LOWER), "utf-8").alias("host"),
        F.encode(text("path"), "utf-8").alias("path"),
        F.encode("verdict", "utf-8").alias("verdict"),
    )
    clean = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    # The lengths of a host's paths: few, however many paths it has.
    lengths = clean.groupBy("host").agg(F.sort_array(F.collect_set(F.octet_length("path"))).alias("lengths"))
    entries = clean.select("host", "path", "verdict", F.lit(None).cast("array<int>").alias("lengths")).unionByName(
        lengths.select("host", F.lit(None).cast("binary").alias("path"), F.lit(None).cast("binary").alias("verdict"), "lengths")
    )

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values, longest = [], [], []
            for row in batch.to_pylist():
                whole = row["path"] is None
                names.append(host_entry(row["host"]) if whole else rule_entry(row["host"], row["path"]))
                values.append(np.array(row["lengths"], "<u4").tobytes() if whole else row["verdict"] or BLOCK)
                longest.append(len(row["host"]))
            keys = pa.array([digest(n) for n in names], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(names, pa.binary()), pa.array(values, pa.binary()), pa.array(longest, pa.int32())],
                names=["key", "name", "value", "longest"],
            )

    made = durable(entries.mapInArrow(keyed, "key long, name binary, value binary, longest int"))
    parts = -(-made.count() // part_keys) or 1
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        part = pa.Table.from_batches(rows)
        names, values = part["name"].to_pylist(), part["value"].to_pylist()
        store, base = fs.FileSystem.from_uri(folder)
        file = f"{uuid.uuid4().hex}.digests"
        with store.open_output_stream(f"{base}/{file}", compression=None) as out:
            out.write(np.array([len(names)], "<i8").tobytes())
            out.write(part["key"].to_numpy().astype("<i8").tobytes())
            for column in (names, values):
                out.write(np.cumsum([len(c) for c in column], dtype="<i8").tobytes())
            for column in (names, values):
                out.write(b"".join(column))
        made = {"path": [f"{folder}/{file}"], "first": [part["key"][0].as_py()], "entries": [len(names)]}
        yield pa.record_batch(made | {"longest": pa.array([max(part["longest"].to_pylist())], pa.int32())})

    ranged = made.repartitionByRange(parts, "key").sortWithinPartitions("key", "name")
    return durable(ranged.mapInArrow(write, "path string, first long, entries long, longest int"))


class DigestPart:
    """One sorted part, mapped into memory where its store is a mounted one, and read otherwise."""

    def __init__(self, path: str):
        store, place = fs.FileSystem.from_uri(path)
        if isinstance(store, fs.LocalFileSystem):
            data = np.memmap(place, np.uint8, "r")
        else:
            data = np.frombuffer(store.open_input_file(place).read(), np.uint8)
        n = int(data[:8].view("<i8")[0])
        self.keys, self.name_ends, self.value_ends = (data[8 + 8 * n * i : 8 + 8 * n * (i + 1)].view("<i8") for i in range(3))
        names_at = 8 + 24 * n
        values_at = names_at + int(self.name_ends[-1])
        self.names, self.values = data[names_at:values_at], data[values_at:]

    @staticmethod
    def _slice(blob: np.ndarray, ends: np.ndarray, i: int) -> bytes:
        return blob[int(ends[i - 1]) if i else 0 : int(ends[i])].tobytes()

    def find(self, names: list[bytes], keys: np.ndarray) -> list[bytes | None]:
        """The value of each name that is stored under its key, else None."""
        at = np.searchsorted(self.keys, keys, "left")
        found: list[bytes | None] = [None] * len(names)
        inside = at < len(self.keys)
        inside[inside] = self.keys[at[inside]] == keys[inside]
        for asked in np.flatnonzero(inside):
            i = int(at[asked])
            while i < len(self.keys) and self.keys[i] == keys[asked]:
                if self._slice(self.names, self.name_ends, i) == names[asked]:
                    found[asked] = self._slice(self.values, self.value_ends, i)
                    break
                i += 1
        return found


class Digests:
    """All parts of an array; a part is opened when a key first falls into it."""

    def __init__(self, manifest: list[tuple[str, int, int]]):
        manifest = sorted(manifest, key=lambda part: part[1])
        self.paths = [path for path, _, _ in manifest]
        self.first = np.array([first for _, first, _ in manifest], np.int64)
        self.longest = max((longest for _, _, longest in manifest), default=-1)
        self.parts: dict[int, DigestPart] = {}

    def find(self, names: list[bytes]) -> list[bytes | None]:
        found: list[bytes | None] = [None] * len(names)
        keys = np.array([digest(n) for n in names], np.int64)
        owner = np.searchsorted(self.first, keys, "right") - 1
        for part in np.unique(owner[owner >= 0]):
            if part not in self.parts:
                self.parts[part] = DigestPart(self.paths[part])
            rows = np.flatnonzero(owner == part)
            for row, value in zip(rows, self.parts[part].find([names[r] for r in rows], keys[rows])):
                found[row] = value
        return found

    def rule_hosts(self, hosts: list[bytes]) -> dict[bytes, list[tuple[bytes, list[int]]]]:
        """For each host the rule hosts that fit it, with the lengths of their paths.

        Suffixes longer than the longest host of a rule are not asked for: none can be stored.
        """
        asked, names = [], []
        for host in hosts:
            cut = len(host)
            while cut is not None:
                # From the right, suffix by suffix: behind each dot, and at last the whole host.
                dot = host.rfind(b".", 0, cut) if cut else -1
                suffix = host[dot + 1 :]
                if len(suffix) > self.longest:
                    break
                asked.append((host, suffix))
                names.append(host_entry(suffix))
                cut = dot if dot >= 0 else None
        fit: dict[bytes, list[tuple[bytes, list[int]]]] = {}
        for (host, suffix), value in zip(asked, self.find(names)):
            if value is not None and (suffix or not host):
                fit.setdefault(host, []).append((suffix, np.frombuffer(value, "<u4").tolist()))
        return fit

    def judged(self, hosts: list[bytes], paths: list[bytes]) -> list[tuple[bytes, bytes] | None]:
        """The longest fitting rule of each url, and its verdict; of equally long ones that of the longer host."""
        fit = self.rule_hosts(sorted(set(hosts)))
        asked, names = [], []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            for rule_host, lengths in fit.get(host, ()):
                for length in lengths:
                    if length <= len(path):
                        asked.append((row, rule_host, path[:length]))
                        names.append(rule_entry(rule_host, path[:length]))
        best: dict[int, tuple[int, int, bytes, bytes]] = {}
        for (row, host, path), verdict in zip(asked, self.find(names)):
            if verdict is not None:
                rule = host + path
                best[row] = max(best.get(row, (-1, -1, b"", b"")), (len(rule.decode()), len(host), rule, verdict))
        return [best[row][2:] if row in best else None for row in range(len(hosts))]


def judged(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """The rows with host, path, rule (null where none fits) and verdict; ``rules`` is a written manifest."""
    # One line per part of half a million entries.
    manifest = [(r.path, r.first, r.longest) for r in rules.select("path", "first", "longest").collect()]
    opened: list[Digests] = []

    def work(_: pa.StructArray, batch: pa.RecordBatch) -> list[pa.Array]:
        if not opened:
            opened.append(Digests(manifest))
        hosts, paths = (batch[name].cast(pa.binary()).to_pylist() for name in ("_host", "_path"))
        found = opened[0].judged(hosts, paths)
        rule = pa.array([f and f[0].decode() for f in found], pa.string())
        verdict = pa.array([f[1].decode() if f else otherwise for f in found], pa.string())
        return [batch["_host"], batch["_path"], rule, verdict]

    host, path = host_and_path(F.col("url"))
    return mapped(pages, work, ADDED, _host=host, _path=path)
