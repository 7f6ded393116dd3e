"""Merkle manifest of a data set, with a proof for every row by lookups of coordinates.

Rows are leaves.  The leaves of a group, in order, are the lowest level of the group's tree; every ``fan`` nodes of a
level make one of the next, up to the group's root.  The groups' roots, in order of their groups, are the leaves of one
more tree, whose root stands for the whole.

* ``numbered`` gives rows their places in a total order without bringing a group together: a range partitioning, the
  place within the partition, and the sizes of the partitions before.
* ``build`` makes the node table level by level; a row of it is a run: the ``fan`` nodes that are hashed together.  Each
  level is a sixteenth of the one below, and a hot group is as many runs as its size asks for.
* ``proofs`` computes from index and group size which runs a leaf's path meets, explodes these coordinates, joins them
  with the node table, and puts what came back in order.  Runs near the roots are wanted by all leaves below, so node
  and coordinate carry the number of the block of ``BLOCK`` leaves too; a run is listed once for each block that it
  covers, and no key of the join has more than ``BLOCK`` leaves.

Cases: a null is written as ``-`` and an empty string as ``0:``; a null group is a group and comes first; rows of one
group with equal order columns (repeated rows, null ids, which come first) are ordered by their leaf; a group of one row
is its own root, as is a single group; an empty table has no rows and no root; columns not named in ``keep`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import materialize

#: Consecutive leaves that may ask the same key of the node table.
BLOCK = 1024
#: The tree above all groups, among the groups' numbers.
TOP = -1
#: Levels that a tree can have: 16 to the 15th leaves.
LEVELS = 15


def digest(columns: list[Column]) -> Column:
    """SHA-256 in lower-case hex of the values, each with its length before it."""

    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, columns)), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, their place in the order of some columns, from 0."""
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = materialize(at.withColumn("_part", F.shiftright("_at", 33)), name)
    parts = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row a partition
    parts = parts.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return at.join(F.broadcast(parts), "_part").withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def _hex(b: Column) -> Column:
    return F.lower(F.hex(b))


@dataclass
class Manifest:
    """``leaves`` (place, leaf, kept columns, grp, idx, size), ``nodes`` (tree, level, run, lo, hi, hashes), ``root`` in hex or None."""

    leaves: DataFrame
    nodes: DataFrame
    groups: int
    root: str | None
    fan: int


def _levels(level_0: DataFrame, most: int, fan: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Runs of each level, and the roots (tree, lo, hi, h), of trees given by (tree, idx, size, lo, hi, h)."""
    runs, roots, now, level = [], [], level_0, 0
    while True:
        roots.append(now.where("size <= 1").select("tree", "lo", "hi", "h"))
        if most <= 1:
            break
        ordered = F.sort_array(F.collect_list(F.struct("idx", "h")))
        made = now.where("size > 1").groupBy("tree", _div(F.col("idx"), F.lit(fan)).alias("run"), "size").agg(ordered.alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        hashes = F.unhex(F.array_join(F.transform("c", lambda x: F.hex(x["h"])), ""))
        kept = materialize(made.select("tree", F.lit(level).alias("level"), "run", "size", "lo", "hi", hashes.alias("hashes")), name)
        runs.append(kept.drop("size"))
        now = kept.select("tree", F.col("run").alias("idx"), _div(F.col("size") + (fan - 1), F.lit(fan)).alias("size"), "lo", "hi", F.unhex(F.sha2(_hex(F.col("hashes")), 256)).alias("h"))
        most, level = -(-most // fan), level + 1
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return runs, out


def build(rows: DataFrame, *, group: str, order: list[str], leaf: str = "leaf", keep: list[str] | None = None, fan: int = 16) -> Manifest:
    """The manifest of rows whose digests are in the column ``leaf``."""
    keep = keep or []
    own = rows.select(F.col(group).alias("_group"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(leaf).alias("leaf"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
    placed = numbered(own, ["_group", *[f"_o{i}" for i in range(len(order))], "leaf"], "merkle-leaves")
    sizes = placed.groupBy("_group").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = materialize(numbered(sizes, ["_group"], "merkle-groups").withColumnRenamed("place", "grp"), "merkle-sizes")
    facts = groups.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).first()
    if not facts["n"]:
        empty = groups.select(F.col("grp").alias("tree"), F.lit(0).alias("level"), F.col("grp").alias("run"), F.col("grp").alias("lo"), F.col("grp").alias("hi"), F.lit(b"").alias("hashes"))
        return Manifest(placed.select("place", "leaf", "kept", F.col("place").alias("grp"), F.col("place").alias("idx"), F.col("place").alias("size")), empty, 0, None, fan)
    same = F.col("_group").eqNullSafe(F.col("_own"))
    joined = placed.join(groups.withColumnRenamed("_group", "_own"), same)
    leaves = materialize(joined.select("place", "leaf", "kept", "grp", (F.col("place") - F.col("first")).alias("idx"), "size"), "merkle-placed")
    level_0 = leaves.select(F.col("grp").alias("tree"), "idx", "size", F.col("place").alias("lo"), F.col("place").alias("hi"), F.unhex("leaf").alias("h"))
    runs, roots = _levels(level_0, int(facts["most"]), fan, "merkle-runs")
    top = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(facts["n"]).cast("long").alias("size"), "lo", "hi", "h")
    top = materialize(top, "merkle-subroots")
    above, root = _levels(top, int(facts["n"]), fan, "merkle-top")
    runs += above
    nodes = runs[0] if runs else leaves.select(F.col("grp").alias("tree"), F.lit(0).alias("level"), F.col("idx").alias("run"), F.col("place").alias("lo"), F.col("place").alias("hi"), F.lit(b"").alias("hashes")).where(F.lit(False))
    for r in runs[1:]:
        nodes = nodes.unionByName(r)
    return Manifest(leaves, nodes, int(facts["n"]), root.first()["h"].hex(), fan)


def paths(m: Manifest) -> DataFrame:
    """(place, leaf, kept, path): for every leaf the runs on its way up, (ord, at, run's nodes in hex), ``at`` the own node's place."""

    def along(tree: Column, idx: Column, size: Column, base: int) -> Column:
        levels = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.pow(F.lit(float(m.fan)), k) < size)
        unit = lambda k: F.pow(F.lit(float(m.fan)), k).cast("long")
        return F.transform(levels, lambda k: F.struct((k + base).alias("ord"), tree.alias("tree"), k.alias("level"), _div(idx, unit(k + 1)).alias("run"), (_div(idx, unit(k)) % m.fan).cast("int").alias("at")))

    wanted = F.concat(along(F.col("grp"), F.col("idx"), F.col("size"), 0), along(F.lit(TOP).cast("long"), F.col("grp"), F.lit(m.groups).cast("long"), LEVELS + 1))
    block = _div(F.col("place"), F.lit(BLOCK))
    asked = m.leaves.select("place", block.alias("block"), F.explode(wanted).alias("w")).select("place", "block", "w.*")
    listed = m.nodes.select("tree", "level", "run", "hashes", F.explode(F.sequence(_div(F.col("lo"), F.lit(BLOCK)), _div(F.col("hi"), F.lit(BLOCK)))).alias("block"))
    met = asked.join(listed, ["tree", "level", "run", "block"]).select("place", F.struct("ord", "at", "hashes").alias("s"))
    found = met.groupBy("place").agg(F.sort_array(F.collect_list("s")).alias("path"))
    both = m.leaves.join(found, "place", "left")
    none = F.array().cast("array<struct<ord:int,at:int,hashes:string>>")
    shown = F.transform("path", lambda s: F.struct(s["ord"].alias("ord"), s["at"].alias("at"), _hex(s["hashes"]).alias("hashes")))
    return both.select("place", "leaf", "kept", F.coalesce(shown, none).alias("path"))


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of numbers that are not negative."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def _before(s: Column) -> Column:
    return F.substr(s["hashes"], F.lit(1), 64 * s["at"])


def _after(s: Column) -> Column:
    return F.substr(s["hashes"], 64 * s["at"] + 65)


def siblings(path: Column) -> Column:
    """The digests that prove a leaf, level by level, from left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(_before(s), _after(s))), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings on its path."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(_before(s), h, _after(s)), 256))


def subroot(path: Column, leaf: Column) -> Column:
    """The root of the leaf's group."""
    return folded(F.filter(path, lambda s: s["ord"] <= LEVELS), leaf)


def proofs(m: Manifest) -> DataFrame:
    """(leaf, kept columns, subroot, root, siblings, path) of every row."""
    kept = [f.name for f in m.leaves.schema["kept"].dataType.fields][1:]
    leaf, path = F.col("leaf"), F.col("path")
    return paths(m).select("leaf", *[F.col("kept")[c].alias(c) for c in kept], subroot(path, leaf).alias("subroot"), F.lit(m.root).cast("string").alias("root"), siblings(path).alias("siblings"), "path")
