"""Connected components by stars with shortcuts, and pairs of a group dealt out in tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node that can be reached.

    An edge points from its larger node a to its smaller b.  In a round each node finds the smallest node it points to,
    m, and where m itself points on, takes that instead; then the node and all it pointed to point there.  Ways halve
    with every round, until two totals no longer change; nothing else goes to the driver.
    The tables of a round are written before they are joined, so that Spark can split the rows of a hub.
    """

    def written(rows: DataFrame) -> tuple[DataFrame, tuple]:
        out = C.materialize(rows, "edges")
        return out, tuple(out.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now, state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        least = C.materialize(now.groupBy("a").agg(F.min("b").alias("m")), "least")
        onward = least.select(F.col("a").alias("m"), F.col("m").alias("next"))
        target = least.join(onward, "m", "left").select("a", F.coalesce("next", "m").alias("r"))
        pointed = now.join(target, "a").select(F.explode(F.array(F.struct("a", F.col("r").alias("b")), F.struct(F.col("b").alias("a"), F.col("r").alias("b")))).alias("e"))
        now, after = written(pointed.select("e.a", "e.b").where("a <> b").distinct())
        if after == state:
            break
        state = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def tiled(members: DataFrame, member: str, parts: Column) -> DataFrame:
    """Members of groups, once for each tile of pairs: tile_a <= tile_b, and part, which of the two a row is of.

    A group is cut into ``parts`` by hash of the member; every pair of members meets in exactly one tile.
    """
    n = F.greatest(parts, F.lit(1)).cast("int")
    part = F.pmod(F.xxhash64(F.col(member)), n).cast("int")
    spread = members.withColumn("_parts", n).withColumn("part", part)
    other = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_other")
    out = spread.select("*", other)
    return out.withColumn("tile_a", F.least("part", "_other")).withColumn("tile_b", F.greatest("part", "_other")).drop("_parts", "_other")
