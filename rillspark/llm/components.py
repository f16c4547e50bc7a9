"""Connected components over a table of links, by large-star and small-star rounds.

Each round hangs the neighbours of a node on the smallest of them; the number of links never
grows, and a few rounds leave stars. Rounds are group-by and join: the smallest neighbour comes
from a map-side minimum, and the join back is one that adaptive execution can split where a
node is hot. Every round is written down, so no lineage builds up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillspark.session import durable


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One half round over links (u, v); for large stars the links go both ways."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(least, "u")
    if large:
        made = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return made.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Node and root (the smallest node of its component) for every node that has a link.

    ``links`` has columns u and v of one orderable type, in any direction, repeats allowed.
    """
    links = durable(links.filter(F.col("u") != F.col("v")).select("u", "v").distinct())

    def mark(table: DataFrame):
        return table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = None
    while (now := mark(links)) != before:
        before = now
        links = durable(_star(_star(links, True), False))
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
