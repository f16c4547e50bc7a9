"""Session settings the operators count on."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Runtime SQL settings. Adaptive execution picks broadcast joins from measured sizes, splits hot
# join partitions and merges small shuffle partitions, so no operator hints a broadcast by itself.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Two joins on one key share their shuffle; split a hot partition there too.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings to a session that somebody else built."""
    for name, value in SQL_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "rillspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


_FOLDERS: list[tuple[SparkSession, str]] = []


def working_folder(spark: SparkSession) -> str:
    """A new folder in the shared place that ``spark.checkpoint.dir`` names.

    A session that names none works beside its tables, under ``spark.sql.warehouse.dir``, which
    driver and executors share as well. ``release`` removes the folders; so does the end of the
    program where the session is still running by then.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_working"
    )
    if spark._jsc.sc().getCheckpointDir().isEmpty():
        # Long chains of iterations cut their lineage there too.
        spark.sparkContext.setCheckpointDir(shared)
    folder = f"{shared}/{uuid.uuid4().hex}"
    _FOLDERS.append((spark, folder))
    return folder


def release(spark: SparkSession) -> None:
    """Remove the folders that this session made."""
    conf = spark._jsc.hadoopConfiguration()
    for entry in [e for e in _FOLDERS if e[0] is spark]:
        path = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(conf).delete(path, True)
        _FOLDERS.remove(entry)


def discard(df: DataFrame) -> None:
    """Remove the written table that ``durable`` returned. Nothing may read it any more."""
    spark, files = df.sparkSession, df.inputFiles()
    conf = spark._jsc.hadoopConfiguration()
    for entry in [e for e in _FOLDERS if e[0] is spark and any(f"/{e[1].rsplit('/', 1)[-1]}/" in f for f in files)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(entry[1])
        path.getFileSystem(conf).delete(path, True)
        _FOLDERS.remove(entry)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _FOLDERS}.values():
        try:
            if spark.sparkContext._jsc and not spark.sparkContext._jsc.sc().isStopped():
                release(spark)
        except Exception:  # the JVM may already be gone; the folder then stays
            pass


def durable(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write the rows down and go on from the written table, under ``schema`` where one is given.

    Later passes then read only the columns they need, know the size of the table, and do not
    depend on executors that held shuffle files or cached blocks.
    """
    path = f"{working_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
