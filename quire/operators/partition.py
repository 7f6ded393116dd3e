"""Contiguous partitioning of ordered units into size-limited volumes, for many documents at once.

Units are rows (doc_id, unit_idx, sec_idx, start_page, end_page, size, protected, min_size).  Order is ``unit_idx``; a
volume is a run of units.  A run of one unit may exceed the cap, longer runs may not.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Partitions are exact for documents of any size.  Beyond 4,000,000 units of work the reference splits repeatedly instead,
#: which gives other volumes: who wants that of ``balanced`` sets it here; no query and no plan does.
WORK_LIMIT: int | None = None
#: A layer of the exact partition with no more ends times cuts is looked at as one table; this only saves time.
TABLE = 4096
#: More cuts than these of one document are not kept at once, but made again block by block.
CUTS = 1 << 24
BIG = "decimal(38,0)"


def build_units(sections: DataFrame, weights: DataFrame) -> DataFrame:
    """Units of sections: one for a protected or single-page section, else one per page by weight.

    ``sections`` is (doc_id, sec_idx, start_page, end_page, protected, size_bytes, min_size_bytes), ``weights`` is
    (doc_id, page_no, weight).  The last page of a section gets what the shares leave over; no unit is below 1.
    """
    split = ~F.col("protected") & (F.col("end_page") > F.col("start_page"))
    whole = sections.where(~split).select("doc_id", "sec_idx", "start_page", "end_page", F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size"), "protected", F.col("min_size_bytes").cast("long").alias("min_size"))
    pages = sections.where(split).select("doc_id", "sec_idx", "start_page", "end_page", "size_bytes", "min_size_bytes", F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    # dealt by document once, which serves all windows that follow
    weighted = pages.join(weights, ["doc_id", "page_no"], "left").withColumn("w", F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1)).cast("long")).repartition("doc_id")
    section = Window.partitionBy("doc_id", "sec_idx")
    total = F.sum("w").over(section)
    share = lambda c: F.floor(F.coalesce(F.col(c), F.lit(0)).cast(BIG) * F.col("w") / total).cast("long")
    shared = weighted.withColumn("share", share("size_bytes")).withColumn("min_size", F.when(F.col("min_size_bytes").isNotNull(), F.greatest(share("min_size_bytes"), F.lit(1))))
    others = F.sum(F.when(F.col("page_no") < F.col("end_page"), F.greatest("share", F.lit(1))).otherwise(0)).over(section)
    sized = shared.withColumn("size", F.greatest(F.when(F.col("page_no") == F.col("end_page"), F.coalesce("size_bytes", F.lit(0)) - others).otherwise(F.col("share")), F.lit(1)).cast("long"))
    each = sized.select("doc_id", "sec_idx", F.col("page_no").alias("start_page"), F.col("page_no").alias("end_page"), "size", F.lit(False).alias("protected"), "min_size")
    order = Window.partitionBy("doc_id").orderBy("start_page", "sec_idx")
    return whole.repartition("doc_id").unionByName(each).withColumn("unit_idx", F.row_number().over(order))


def greedy(units: DataFrame, cap: Column) -> DataFrame:
    """Volumes filled from left to right: (…, vol_idx).  ``cap`` is a column of ``units`` or a literal.

    The fold over a document's sizes carries only where volumes begin; units find their volume by counting those.
    """
    listed = units.withColumn("_cap", cap.cast("long")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("unit_idx", "size"))).alias("u"), F.first("_cap").alias("_cap"))

    def step(state: Column, unit: Column, limit: Column) -> Column:
        alone = unit["size"] > limit
        begins = alone | state["closed"] | (state["filled"] + unit["size"] > limit)
        return F.struct(alone.alias("closed"), F.when(begins, unit["size"]).otherwise(state["filled"] + unit["size"]).alias("filled"), F.when(begins, F.concat(state["starts"], F.array(unit["unit_idx"]))).otherwise(state["starts"]).alias("starts"))

    start = F.struct(F.lit(True).alias("closed"), F.lit(0).cast("long").alias("filled"), F.array().cast("array<int>").alias("starts"))
    starts = listed.select("doc_id", F.explode(F.aggregate("u", start, lambda s, u: step(s, u, F.col("_cap")), lambda s: s["starts"])).alias("unit_idx"), F.lit(1).alias("_begins"))
    order = Window.partitionBy("doc_id").orderBy("unit_idx", F.desc("_begins")).rowsBetween(Window.unboundedPreceding, 0)
    marked = units.repartition("doc_id").withColumn("_begins", F.lit(0)).unionByName(starts, allowMissingColumns=True)
    return marked.withColumn("vol_idx", F.sum("_begins").over(order).cast("int")).where("_begins = 0").drop("_begins")


def _settled(rows: DataFrame) -> DataFrame:
    """The same rows, their columns computed once: else a fold would compute the arrays it reads at every step."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("r")).select("r.*")


def _listed(units: DataFrame, counts: DataFrame | int | None = None) -> DataFrame:
    """One row per document: k if given, and arrays of its units in order: sizes, and the bytes up to each unit's end (upto)."""
    order = Window.partitionBy("doc_id").orderBy("unit_idx")
    summed = units.select("doc_id", "unit_idx", "size", F.sum("size").over(order).alias("upto"))
    rows = summed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("unit_idx", "size", "upto"))).alias("u"))
    rows = rows.select("doc_id", F.col("u.size").alias("sizes"), F.col("u.upto").alias("upto"), F.size("u").alias("n"))
    rows = _settled(rows)
    if counts is None:
        return rows
    return rows.withColumn("k", F.lit(counts)) if isinstance(counts, int) else rows.join(counts.select("doc_id", F.col("k").cast("int").alias("k")), "doc_id")


def min_cap(units: DataFrame, k: int | DataFrame, upper: Column | None = None) -> DataFrame:
    """(doc_id, cap): the least cap under which greedy filling needs at most k volumes, or the upper bound if none does.

    ``k`` is one number, or (doc_id, k); the bound is that of ``_least_cap`` where none is given.
    """
    rows = _listed(units, k) if upper is None else _listed(units, k).withColumn("upper", upper.cast("long"))
    ask = ["upto", "k"] if upper is None else ["upto", "k", "upper"]

    def halve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            caps = [_least_cap([0, *upto.tolist()], *map(int, given)) for upto, *given in zip(*(frame[c] for c in ask), strict=True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "cap": caps})

    return rows.select("doc_id", *ask).mapInPandas(halve, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, cap long")


def _least_cap(before: list[int], k: int, upper: int | None = None) -> int:
    """The least cap under which greedy filling needs at most k volumes, or the upper bound if none does; ``before`` as in ``_fits``.

    The number of volumes never grows with the cap, so the range of whole numbers is halved: it lies between total / k
    (unless one unit is larger) and total / k plus the largest unit, and takes one round for each of its bits.
    """
    share, largest = before[-1] // max(k, 1), max(b - a for a, b in pairwise(before))
    high = min(share + 1 + largest, before[-1]) if upper is None else upper
    low = min(high, share if largest <= share else 0)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _fits(before, middle, k) else (middle + 1, high)
    return high


def _fits(before: list[int], cap: int, k: int) -> bool:
    """Whether greedy filling under a cap needs at most k volumes; ``before`` are the bytes before each unit, and all."""
    at, n = 0, len(before) - 1
    while at < n and k > 0:
        at = max(at + 1, bisect_right(before, before[at] + cap) - 1)
        k -= 1
    return at >= n


def _needed(before: list[int], cap: int) -> int:
    """How many volumes greedy filling under a cap needs."""
    at, n, volumes = 0, len(before) - 1, 0
    while at < n:
        at = max(at + 1, bisect_right(before, before[at] + cap) - 1)
        volumes += 1
    return volumes


def work(units: DataFrame, caps: DataFrame, k: int | DataFrame) -> DataFrame:
    """A document's n, k and cap with work (units times volumes times the longest run within the cap) and exact.

    The reference does not try an exact partition beyond a limit of work; without a WORK_LIMIT every document is exact.
    """
    rows = _listed(units, k).join(caps.select("doc_id", "cap"), "doc_id").select("doc_id", "upto", "n", "k", "cap")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema if f.name != "upto"}

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            longest = [int((np.arange(1, len(upto) + 1) - _first(upto, cap) + 1).max()) for upto, cap in zip(frame["upto"], frame["cap"], strict=True)]
            yield frame[list(kinds)].assign(longest=longest)

    found = rows.mapInPandas(measure, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", longest long")
    total = F.col("n").cast(BIG) * F.col("k") * (F.col("longest") + 1)
    every = F.lit(True) if WORK_LIMIT is None else (total <= WORK_LIMIT) | (F.col("k") <= 1) | (F.col("k") >= F.col("n"))
    return found.withColumn("work", total).withColumn("exact", every)


def _first(upto: np.ndarray, cap: int) -> np.ndarray:
    """For each unit the earliest one that a run within the cap can begin with."""
    before = np.append(0, upto)
    # running sums don't fall; a unit over the cap begins its own run
    return np.minimum(np.searchsorted(before[:-1], before[1:] - cap, side="left"), np.arange(len(upto))) + 1


def _upto(i: Column) -> Column:
    """Bytes of the first i units."""
    return F.when(i > 0, F.get("upto", i - 1)).otherwise(F.lit(0).cast("long"))


def _least_squares(upto: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Where the runs begin (numbers of units before them), 1 < k < units; ``first`` as in ``_first``.

    One layer a volume: the least cost of the first e units in g runs, for the ends e that g runs reach and from which
    the other k - g reach the document's end.  The allowed cuts of an end lie side by side, there is one for each end,
    and neither their first nor their last falls as ends rise.  If k runs are too few under the cap, greedy ones are given.
    """
    n = len(first)
    last = np.searchsorted(first, np.arange(1, n + 1), side="right")  # the end of the longest run from each unit
    farthest, earliest = [0], [n]
    while len(farthest) <= k:
        farthest.append(int(last[farthest[-1]]) if farthest[-1] < n else n)
        earliest.append(int(first[earliest[-1] - 1]) - 1 if earliest[-1] else 0)
    if farthest[k] < n:
        while last[farthest[-1]] < n:
            farthest.append(int(last[farthest[-1]]))
        return np.array(farthest, dtype=np.int64)
    low = np.maximum(np.arange(k + 1), earliest[::-1])
    high = np.minimum(farthest, n - k + np.arange(k + 1))
    before = np.append(0, upto)
    # a sum of squares is no larger than the square of the sum
    before = before.astype(np.int64 if int(before[-1]) < 3_000_000_000 else object)

    def layer(g: int, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.arange(low[g], high[g] + 1)
        return _best_cuts(before, ends, np.maximum(first[ends - 1] - 1, low[g - 1]), np.minimum(ends - 1, high[g - 1]), ways, int(low[g - 1]))

    # costs are kept for some layers only where all cuts are too many to keep; the layers between are made again
    block = k if int((high - low + 1).sum()) <= CUTS else math.isqrt(k) + 1
    kept, ways = {0: before[:1] * 0}, before[:1] * 0
    for g in range(1, k - (k - 1) % block):
        ways, _ = layer(g, ways)
        if g % block == 0:
            kept[g] = ways
    out, end = [], n
    for base in range((k - 1) // block * block, -1, -block):
        ways, cuts = kept.pop(base), []
        for g in range(base + 1, min(base + block, k) + 1):
            ways, cut = layer(g, ways)
            cuts.append(cut)
        for g in range(min(base + block, k), base, -1):
            end = int(cuts.pop()[end - low[g]])
            out.append(end)
    return np.array(out[::-1], dtype=np.int64)


def _best_cuts(before: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, ways: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """For each end the least of ways[cut] plus the square of the run from cut to end, a <= cut <= b, and the latest such cut.

    ``ways`` begins at the cut ``offset``.  Squares of sums satisfy the quadrangle inequality, so the latest best cut never
    falls as ends rise: every second end lies between its neighbours' cuts, from the middle end to all of them.
    """
    n = len(ends)
    width = int((b - a).max()) + 1
    if n * width <= TABLE:  # rows go from the latest cut to the earliest, and the first least cost is taken
        cuts = np.maximum(b[:, None] - np.arange(width), a[:, None])
        total = ways[cuts - offset] + (before[ends][:, None] - before[cuts]) ** 2
        best = np.arange(n), np.argmin(total, axis=1)
        return total[best], cuts[best]
    least, cut = np.empty(n, dtype=before.dtype), np.empty(n, dtype=np.int64)
    stride = 1 << n.bit_length() - 1
    while stride:
        rows = np.arange(stride - 1, n, 2 * stride)
        lo, hi = a[rows], b[rows]
        left, right = rows >= stride, rows + stride < n
        lo[left] = np.maximum(lo[left], cut[rows[left] - stride])
        hi[right] = np.minimum(hi[right], cut[rows[right] + stride])
        count = hi - lo + 1
        at = np.cumsum(count) - count
        cuts = np.arange(int(count.sum())) - np.repeat(at - lo, count)
        total = ways[cuts - offset] + (np.repeat(before[ends[rows]], count) - before[cuts]) ** 2
        least[rows] = np.minimum.reduceat(total, at)
        cut[rows] = np.maximum.reduceat(np.where(total == np.repeat(least[rows], count), cuts, -1), at)
        stride //= 2
    return least, cut


def _begins(upto: np.ndarray, cap: int, k: int) -> np.ndarray:
    """The first units of a document's k volumes: single units for k at or above their number, one volume for 1 or less."""
    n = len(upto)
    if k >= n:
        return np.arange(1, n + 1)
    return np.ones(1, dtype=np.int64) if k <= 1 else _least_squares(upto, _first(upto, cap), k) + 1


def _solved(rows: DataFrame, ask: list[str], begins: Callable[..., np.ndarray]) -> DataFrame:
    """(doc_id, unit_idx): what ``begins`` gives for each document's columns ``ask``."""

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                found = [begins(*row) for row in zip(*(frame[c] for c in ask), strict=True)]
                yield pd.DataFrame({"doc_id": np.repeat(frame["doc_id"].to_numpy(), [len(x) for x in found]), "unit_idx": np.concatenate(found)})

    # units without a document are none's volumes
    return rows.where("doc_id is not null").select("doc_id", *ask).mapInPandas(solve, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, unit_idx int")


def balanced(units: DataFrame, caps: DataFrame, k: int | DataFrame) -> DataFrame:
    """Exactly k volumes of each document, runs of two units or more within the cap, least sum of squared sizes.

    A shortest path of k layers for each document by itself, vectorised within its row; on equal cost the later cut
    wins.  k at or above the number of units gives single units, k of 1 or less one volume.  ``caps`` is (doc_id, cap),
    ``k`` one number or (doc_id, k).
    """
    rows = _listed(units, k).join(caps.select("doc_id", "cap"), "doc_id")
    if WORK_LIMIT is None:
        return by_starts(units, _solved(rows, ["upto", "cap", "k"], _begins))
    judged = work(units, caps, k)
    found = _solved(rows.join(judged.where("exact").select("doc_id"), "doc_id"), ["upto", "cap", "k"], _begins)
    large = judged.where(~F.col("exact")).select("doc_id", "cap", "k")
    split = split_to(units.join(large.select("doc_id", "cap"), "doc_id"), F.col("cap"), large.select("doc_id", "k"))
    return by_starts(units, found.unionByName(split.groupBy("doc_id", "vol_idx").agg(F.min("unit_idx").alias("unit_idx")).select("doc_id", "unit_idx")))


def by_starts(units: DataFrame, starts: DataFrame) -> DataFrame:
    """Volumes that begin at given units (doc_id, unit_idx); the first unit always begins one."""
    order = Window.partitionBy("doc_id").orderBy("unit_idx")
    marked = units.join(starts.select("doc_id", "unit_idx", F.lit(1).alias("begins")).distinct(), ["doc_id", "unit_idx"], "left")
    begins = F.when(F.row_number().over(order) == 1, 1).otherwise(F.coalesce("begins", F.lit(0)))
    return marked.withColumn("b", begins).withColumn("vol_idx", F.sum("b").over(order).cast("int")).drop("b", "begins")


def split_to(units: DataFrame, cap: Column, k: int | DataFrame) -> DataFrame:
    """(doc_id, unit_idx, vol_idx): greedy volumes, then the largest of two units or more cut most evenly, until there are k.

    Ties go to the volume and to the cut further left.  A fold over the cuts still to make carries the volumes as
    (first, last, bytes); nothing leaves the document's row.  ``k`` is one number or (doc_id, k).
    """
    packed = greedy(units, cap).select("doc_id", "unit_idx", "size", "vol_idx")
    volumes = packed.groupBy("doc_id", "vol_idx").agg(F.min("unit_idx").alias("first"), F.max("unit_idx").alias("last"), F.sum("size").alias("bytes"))
    spans = volumes.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "bytes")).alias("spans"))
    rows = _listed(units, k).join(spans, "doc_id")

    def cut(spans: Column, _: Column) -> Column:
        largest = F.array_max(F.transform(F.filter(spans, lambda v: v["last"] > v["first"]), lambda v: F.struct(v["bytes"].alias("bytes"), (-v["first"]).alias("left"), v["last"].alias("last"))))
        a, b = -largest["left"], largest["last"]
        uneven = lambda c: F.abs(_upto(c) - _upto(a - 1) - (_upto(b) - _upto(c)))
        end = F.array_min(F.transform(F.sequence(a, b - 1), lambda c: F.struct(uneven(c).alias("by"), c.alias("end"))))["end"]
        part = lambda x, y: F.struct(x.alias("first"), y.alias("last"), (_upto(y) - _upto(x - 1)).alias("bytes"))
        return F.when(largest.isNull() | (F.size(spans) >= F.col("k")), spans).otherwise(F.concat(F.filter(spans, lambda v: v["first"] != a), F.array(part(a, end), part(end + 1, b))))

    todo = F.when(F.least("k", "n") > F.size("spans"), F.sequence(F.lit(1), F.least("k", "n") - F.size("spans"))).otherwise(F.array().cast("array<int>"))
    done = F.aggregate(todo, F.col("spans"), cut)
    starts = rows.select("doc_id", F.explode(F.transform(done, lambda v: v["first"])).alias("unit_idx"))
    return by_starts(units, starts).select("doc_id", "unit_idx", "vol_idx")


def start_errors(units: DataFrame, sections: DataFrame, starts: DataFrame) -> DataFrame:
    """(doc_id, start_page, error): wanted starts (doc_id, start_page) that are no unit's first page, and where they lie."""
    bad = starts.distinct().join(units.select("doc_id", "start_page"), ["doc_id", "start_page"], "left_anti")
    cover = sections.select("doc_id", "title", F.explode(F.sequence("start_page", "end_page")).alias("start_page"))
    inside = bad.join(cover, ["doc_id", "start_page"], "left")
    return inside.select("doc_id", "start_page", F.when(F.col("title").isNotNull(), F.concat(F.lit("inside "), F.col("title"))).otherwise("outside the document").alias("error"))


def plan(units: DataFrame, mode: str, *, max_bytes: int | None = None, k: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Units with vol_idx under a mode: max_size, num_volumes, both, or adjusted (``starts`` of doc_id, unit_idx)."""
    if mode == "adjusted":
        return by_starts(units, starts)
    # a document of fewer units than k has one volume for each, which is what the balanced partition gives
    def begins(upto: np.ndarray) -> np.ndarray:
        return _begins(upto, *_limits([0, *upto.tolist()], mode, max_bytes, k or 0))

    return by_starts(units, _solved(_listed(units), ["upto"], begins))


def _limits(before: list[int], mode: str, max_bytes: int | None, k: int) -> tuple[int, int]:
    """A document's cap and its number of volumes under a mode of ``plan``; ``before`` as in ``_fits``."""
    if mode == "max_size":
        k = _needed(before, max_bytes)
    fits = mode == "max_size" or mode == "both" and _needed(before, max_bytes) <= k
    return _least_cap(before, k, max_bytes if fits else None), k


def count_warnings(planned: DataFrame, requested: int) -> DataFrame:
    """Documents whose number of volumes is not the requested one (not asked of a plan by size)."""
    return planned.groupBy("doc_id").agg(F.max("vol_idx").alias("n_volumes")).where(F.col("n_volumes") != requested).select("doc_id", "n_volumes", F.lit(requested).alias("requested"))


def size_conflicts(units: DataFrame, max_bytes: int, k: int) -> DataFrame:
    """(doc_id, needed, requested): documents that the size asks more volumes of than were requested; the number wins.

    A document of fewer units than requested has only as many volumes, which is what the size is held against.
    """
    facts = greedy(units, F.lit(max_bytes)).groupBy("doc_id").agg(F.max("vol_idx").alias("needed"), F.count(F.lit(1)).alias("n"))
    wanted = F.least(F.lit(k), F.col("n")).cast("int")
    return facts.where(F.col("needed") > wanted).select("doc_id", "needed", wanted.alias("requested"))


def usable_floors(units: DataFrame, reaches_floor: Column) -> DataFrame:
    """Units whose least sizes count only where the settings can reach them (a column of ``units``)."""
    return units.withColumn("min_size", F.when(reaches_floor, F.col("min_size")))


def moved_starts(starts: DataFrame, moves: DataFrame, sections: DataFrame) -> DataFrame:
    """Starts (doc_id, vol_idx, start_page) after whole sections move across a boundary.

    ``moves`` is (doc_id, vol_idx, step): the volume's start goes to the next (1) or the previous (-1) start of a
    section; where that is none, or another volume's start or beyond it, it stays.
    """
    order = Window.partitionBy("doc_id").orderBy("start_page")
    around = Window.partitionBy("doc_id").orderBy("vol_idx")
    near = sections.select("doc_id", "start_page").distinct().withColumn("after", F.lead("start_page").over(order)).withColumn("before", F.lag("start_page").over(order))
    rows = starts.withColumn("upper", F.lead("start_page").over(around)).withColumn("lower", F.lag("start_page").over(around)).join(moves, ["doc_id", "vol_idx"], "left").join(near, ["doc_id", "start_page"], "left")
    target = F.when(F.col("step") == 1, F.col("after")).when(F.col("step") == -1, F.col("before"))
    free = F.col("lower").isNotNull() & (target > F.col("lower")) & (F.col("upper").isNull() | (target < F.col("upper")))
    return rows.select("doc_id", "vol_idx", F.when(F.coalesce(free, F.lit(False)), target).otherwise(F.col("start_page")).alias("start_page"))


def rollup(planned: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per volume: range, sizes, sections in order with clipped ranges, and whether its floor is above the limit."""
    clipped = planned.groupBy("doc_id", "vol_idx", "sec_idx").agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("units"), F.count_if(F.col("min_size").isNull()).alias("unknown"), F.sum("min_size").alias("floor"), F.bool_and("protected").alias("protected"))
    section = Window.partitionBy("doc_id", "sec_idx")
    parts = clipped.withColumn("partial", (F.col("start_page") > F.min("start_page").over(section)) | (F.col("end_page") < F.max("end_page").over(section)))
    over = F.lit(False) if max_bytes is None else F.col("estimated_bytes") > max_bytes
    reach = F.lit(True) if max_bytes is None else F.coalesce(F.col("min_estimated_bytes") <= max_bytes, F.lit(True))
    volumes = parts.groupBy("doc_id", "vol_idx").agg(
        F.min("start_page").alias("start_page"),
        F.max("end_page").alias("end_page"),
        F.sum("size").alias("estimated_bytes"),
        F.sum("units").alias("n_units"),
        F.when(F.sum("unknown") == 0, F.sum("floor")).alias("min_estimated_bytes"),
        F.bool_or("partial").alias("any_partial"),
        F.sort_array(F.collect_list(F.struct("start_page", "end_page", "sec_idx", "partial", "protected"))).alias("sections"),
    )
    counted = volumes.withColumn("page_count", F.col("end_page") - F.col("start_page") + 1)
    return counted.withColumn("over_limit", over).withColumn("achievable", reach)


def volume_warnings(volumes: DataFrame) -> DataFrame:
    """(doc_id, vol_idx, code) of what a volume's owner should know."""
    single = (F.col("n_units") == 1) & F.col("sections")[0]["protected"]
    code = F.array_compact(
        F.array(
            F.when(F.col("over_limit") & F.col("achievable"), F.when(single, "section_over_limit").otherwise("volume_over_limit")),
            F.when(~F.col("achievable"), "limit_unreachable"),
            F.when(F.col("any_partial"), "section_split"),
        )
    )
    return volumes.select("doc_id", "vol_idx", F.explode(code).alias("code"))


def refusals(volumes: DataFrame) -> DataFrame:
    """Volumes of an adjusted plan that no reduction can bring below the limit and that could be divided."""
    return volumes.where("not achievable and n_units > 1").select("doc_id", "vol_idx")


def summary(volumes: DataFrame, requested: int | None = None) -> DataFrame:
    """One row per document: volumes, bytes, whether all constraints hold."""
    satisfied = ~F.bool_or("over_limit") if requested is None else (~F.bool_or("over_limit") & (F.count(F.lit(1)) == requested))
    return volumes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_volumes"), F.sum("estimated_bytes").alias("total_bytes"), F.max("estimated_bytes").alias("largest_bytes"), satisfied.alias("constraints_satisfied"))


def integrity(planned: DataFrame) -> DataFrame:
    """(doc_id, code): gaps between volumes, and protected sections in more than one. Empty for a good plan."""
    volumes = planned.groupBy("doc_id", "vol_idx").agg(F.min("start_page").alias("s"), F.max("end_page").alias("e"))
    order = Window.partitionBy("doc_id").orderBy("vol_idx")
    gaps = volumes.withColumn("before", F.lag("e").over(order)).where("before + 1 <> s").select("doc_id", F.lit("not contiguous").alias("code"))
    torn = planned.where("protected").groupBy("doc_id", "sec_idx").agg(F.countDistinct("vol_idx").alias("n")).where("n > 1").select("doc_id", F.lit("protected section split").alias("code"))
    return gaps.unionByName(torn)
