"""Near-duplicate vectors by spherical-cap filters with structured random product codes.

A code divides the (randomly rotated) space into blocks; each block has a few random unit vectors, and every combination
of one vector per block is a filter direction.  A vector is list-decoded to all directions whose inner product with it
exceeds a threshold (at least to its ``LEAST`` best, as a structured code is uneven): sums of two halves of the blocks, sorted, meet from above, so only what is found costs time.  Two
vectors of a high cosine share directions with near certainty; several codes are used.  Vectors of one label that share
a direction are compared exactly, in double precision, in the first direction that they share.

Equal vectors of a label are one vector with a count; a direction's group is compared in tiles of ``tile`` vectors, so no
task holds a large group.  Links are counted where they are verified; only a spanning set of them is passed on.

Cases: a null or zero vector, one with null or non-finite components, or a null label has no links and is its own
component; labels are of any type that can be compared, ids are whole numbers (others fail in the cast); vectors of different length have no links; repeated rows (same id) are linked copies; ids are expected to be
set (a null id gives a component of its own); other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.components import components, tiled

BLOCKS = 4
#: A vector that exceeds fewer directions of a code has its own lower threshold, down to so many.
LEAST = 16


class ProductCode:
    """Filter directions of one code, for vectors of ``dim`` components and about ``directions`` filters."""

    def __init__(self, dim: int, directions: int, expected: float, seed: int):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.size = max(2, int(np.ceil(directions ** (1 / BLOCKS))))
        self.cuts = np.array_split(np.arange(dim), min(BLOCKS, dim))
        self.vectors = []
        for cut in self.cuts:
            v = rng.normal(size=(self.size, len(cut)))
            self.vectors.append(v / np.linalg.norm(v, axis=1, keepdims=True) * np.sqrt(len(cut) / dim))
        # the inner product of random unit vectors is close to normal with variance 1 / dim
        self.threshold = NormalDist().inv_cdf(1 - min(0.5, expected / self.size ** len(self.cuts))) / np.sqrt(dim)

    @property
    def columns(self) -> int:
        """Sums that decoding a vector makes of each half."""
        return self.size ** ((len(self.cuts) + 1) // 2)

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x @ self.rotation
        dots = [y[:, cut] @ v.T for cut, v in zip(self.cuts, self.vectors, strict=True)]
        half, out = (len(dots) + 1) // 2, []
        for part in (dots[:half], dots[half:]):
            total = np.zeros((len(x), 1))
            for d in part:
                total = (total[:, :, None] + d[:, None, :]).reshape(len(x), -1)
            out.append(total)
        return out[0], out[1]

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and direction numbers of all that exceed the threshold."""
        a, b = self._halves(x)
        order_a, order_b = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
        a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
        # the LEAST largest sums lie among the first LEAST of either half
        top = (a[:, :LEAST, None] + b[:, None, :LEAST]).reshape(len(x), -1)
        own = np.minimum(self.threshold, -np.partition(-top, LEAST - 1, axis=1)[:, LEAST - 1]) if top.shape[1] >= LEAST else np.full(len(x), -np.inf)
        rows, codes = [], []
        live = np.arange(len(x))
        for i in range(a.shape[1]):
            live = live[a[live, i] + b[live, 0] >= own[live]]
            if not len(live):
                break
            inside, j = live, 0
            while len(inside):
                rows.append(inside)
                codes.append(order_a[inside, i] * b.shape[1] + order_b[inside, j])
                j += 1
                inside = inside[a[inside, i] + b[inside, j] >= own[inside]] if j < b.shape[1] else inside[:0]
        none = np.zeros(0, dtype=np.int64)
        return (np.concatenate(rows), np.concatenate(codes)) if rows else (none, none)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members is linked to, directly or not."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _share_earlier(lists: list[np.ndarray], code: int) -> np.ndarray:
    """For each pair of vectors whether they share a direction numbered below ``code``."""
    earlier = [np.asarray(x)[np.asarray(x) < code] for x in lists]
    member = np.repeat(np.arange(len(lists)), [len(x) for x in earlier])
    _, number, times = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    shared = times[number] > 1
    place = np.cumsum(times > 1) - 1
    has = np.zeros((len(lists), int((times > 1).sum())), dtype=np.float32)
    has[member[shared], place[number[shared]]] = 1
    return has @ has.T > 0


def near(vectors: DataFrame, *, cosine: float = 0.98, codes: int = 4, expected: float = 8.0, tile: int = 512, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    whole = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).alias("label"))
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    ready = rows.where(usable)
    # a class is a vector under a label; it has a number of its own, as an id may stand on several vectors
    different = ready.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    classes = C.materialize(different.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    facts = classes.groupBy(F.size("v").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    made = {int(f["dim"]): [ProductCode(int(f["dim"]), max(128 * int(f["n"]), 256), expected, seed) for seed in range(codes)] for f in facts}

    def filters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f.iloc[at : at + 1024] for f in frames for at in range(0, len(f), 1024)):
            dims = frame["v"].map(len).to_numpy()
            found: list[np.ndarray] = [None] * len(frame)  # type: ignore[list-item]
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                x = np.stack(frame["v"].iloc[own].to_list()).astype(float)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                row, code = [], []
                for c, product in enumerate(made[int(dim)]):
                    step = max(1, 4_000_000 // product.columns)
                    for at in range(0, len(x), step):
                        r, d = product.decode(x[at : at + step])
                        row.append(r + at)
                        code.append((d * len(made[int(dim)]) + c) * 65536 + int(dim))
                row, code = np.concatenate(row), np.concatenate(code)
                order = np.lexsort((code, row))
                for i, part in zip(own, np.split(code[order], np.cumsum(np.bincount(row, minlength=len(own)))[:-1]), strict=True):
                    found[i] = part
            yield frame.assign(filters=found)

    coded = C.materialize(classes.mapInPandas(filters, f"label {classes.schema['label'].dataType.simpleString()}, v array<double>, least long, times long, rep long, filters array<long>"), "filters")
    dealt = coded.select("label", "rep", F.explode("filters").alias("filter"))
    groups = dealt.groupBy("label", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = tiled(dealt.join(groups, ["label", "filter"]), "rep", F.ceil(F.col("n") / tile)).drop("n")
    full = met.join(coded.withColumnRenamed("label", "_label"), "rep").drop("_label")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        keys = np.column_stack([pd.factorize(frame["label"])[0], frame[["filter", "tile_a", "tile_b", "part"]].to_numpy(dtype=np.int64)])
        cut = np.flatnonzero(np.append(True, (keys[1:, :4] != keys[:-1, :4]).any(axis=1)))
        reps, counts, vectors_, filters_ = frame["rep"].to_numpy(), frame["times"].to_numpy(), frame["v"].to_list(), frame["filters"].to_list()
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(frame)], strict=True):
            if e - s < 2:
                continue
            _, code, a, b, _ = keys[s]
            x = np.stack(vectors_[s:e])
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            rep, times = reps[s:e], counts[s:e]
            left, right = np.flatnonzero(keys[s:e, 4] == a), np.flatnonzero(keys[s:e, 4] == b)
            hit = x[left] @ x[right].T >= cosine - 1e-9
            i, j = np.nonzero(hit)
            i, j = left[i], right[j]
            on = i < j if a == b else np.ones(len(i), dtype=bool)
            i, j = i[on], j[on]
            exact = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[exact], j[exact]
            if not len(i):
                continue
            first = ~_share_earlier(filters_[s:e], code)[i, j]
            i, j = i[first], j[first]
            links = np.bincount(i, weights=times[j], minlength=e - s) + np.bincount(j, weights=times[i], minlength=e - s)
            order = np.argsort(rep, kind="stable")
            place = np.empty(len(rep), dtype=np.int64)
            place[order] = np.arange(len(rep))
            root = rep[order][spanning(len(rep), place[i], place[j])[place]]
            at = np.flatnonzero(links)
            out.append(pd.DataFrame({"rep": rep[at], "links": links[at].astype(np.int64), "root": root[at]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"rep": [], "links": [], "root": []})

    verified = C.materialize(C.by_runs(full, ["label", "filter", "tile_a", "tile_b"], [], compare, "rep long, links long, root long"), "links")
    counted = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    per_class = classes.join(counted, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    per_class = C.materialize(per_class.select("label", "v", "component", "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "vector-classes")
    named = per_class.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = ready.join(per_class.drop("least").join(named, "component"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
