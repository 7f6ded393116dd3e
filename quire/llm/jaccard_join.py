"""A similarity join of word-shingle sets by chosen paths.

In each run a set starts at the root and goes down to a child for every token whose hash, seeded with the path so far, is
below 1 / (similarity * size of the set): about 1 / similarity children, and a pair that is similar enough shares one
child on average or more.  Buckets of up to ``small`` sets are compared by brute force; larger ones are split again on
the next sampled token, down to ``DEPTH`` tokens; what is then left together is compared in tiles.  Runs are repeated
until a pair at the limit is found with the target recall.

Brute force in buckets uses small sketches of the sets (one-permutation minhash) with a wide margin.  It only yields
candidate groups: connected components of candidates.  Inside these the whole sets are compared exactly, all members of
a group with all others, in tiles bounded by sets and by tokens, so groups of any size are spread; links are counted
there and only a spanning set of them is passed on.

Equal sets are one set with a count from the start, numbered when it is written; ids play no part until the end, so one
id may have any number of texts.  A text of fewer words than a shingle is one shingle; one without words has no set and
no links.  Repeated rows are copies of each other; a null id gets the class null; ids are whole numbers (others fail in
the cast); other columns are ignored, and ``keep_one`` carries them along; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C
from quire.llm.components import components, tiled
from quire.llm.embedding_dedup import spanning

DEPTH = 3
BINS = 64
#: By how much a sketch may fall short of the wanted similarity: five standard deviations of 64 bins at 0.8.
MARGIN = 0.25
#: Tokens of the sets of a tile's part, at most, unless a single set has more.
TILE_TOKENS = 2_000_000
U64 = np.uint64
_FACTOR = U64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted unique hashes of the shingles of each text."""
    words, at = C.words_of(texts)
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        n = max(min(width, e - s), 1)
        own = words[s:e]
        if not len(own):
            out.append(own)
            continue
        h = np.zeros(len(own) - n + 1, dtype=U64)
        for i in range(n):
            h = (h ^ own[i : len(own) - n + 1 + i]) * _FACTOR
            h ^= h >> U64(29)
        out.append(np.unique(C.mix(h + U64(n))))
    return out


def sketch(tokens: np.ndarray) -> bytes:
    """For each of BINS ranges of hashes the smallest one in it, 32 bits of it; 0 if there is none."""
    h = np.sort(C.mix(tokens ^ U64(0x5851F42D4C957F2D)))
    width = 64 - int(math.log2(BINS))
    edge = np.searchsorted(h, np.arange(BINS, dtype=U64) << U64(width))
    some = np.append(edge[1:], len(h)) > edge
    out = np.zeros(BINS, dtype=np.uint32)
    out[some] = (h[edge[some]] & U64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
    return out.tobytes()


def paths(tokens: np.ndarray, runs: int, similarity: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth the parents and the paths of one set's nodes."""
    least = U64(min(int(2.0**64 / (similarity * len(tokens))), (1 << 64) - 1))
    now = C.mix(np.arange(1, runs + 1, dtype=U64) * _FACTOR)
    levels = []
    for _ in range(DEPTH):
        if len(now) > 64:  # many nodes at a time would make a large table of a long text
            found = [C.mix(tokens ^ p) for p in now]
            pick = [np.flatnonzero(h < least) for h in found]
            parent = np.repeat(now, [len(p) for p in pick])
            child = np.concatenate([h[p] for h, p in zip(found, pick, strict=True)])
        else:
            table = C.mix(tokens[None, :] ^ now[:, None])
            row, column = np.nonzero(table < least)
            parent, child = now[row], table[row, column]
        child = C.mix(child + parent * _FACTOR)
        levels.append((parent, child))
        now = child
        if not len(now):
            break
    return levels + [(now[:0], now[:0])] * (DEPTH - len(levels))


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair at the limit has met with the wanted probability.

    Two sets of that similarity share at least as many tokens as the larger has, times the similarity, so they share
    one child on average; a process with one Poisson child on average reaches DEPTH with probability q.
    """
    q = 1.0
    for _ in range(DEPTH):
        q = 1 - math.exp(-q)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, n_links (other documents linked directly), class_id (smallest id reachable) of every row."""
    described, classes = _classes(docs, **options)
    slim = described.select("doc_id", "set_key", "n_shingles")
    linked = slim.where(_USABLE).join(classes.select("set_key", "n_links", "class_id"), "set_key").select("doc_id", "n_shingles", "n_links", "class_id")
    alone = slim.where(f"not ({_USABLE})").select("doc_id", "n_shingles", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"))
    return linked.unionByName(alone)


_USABLE = "set_key is not null and doc_id is not null"


def _classes(docs: DataFrame, *, similarity: float = 0.8, width: int = 5, recall: float = 0.999, small: int = 64, tile: int = 256, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The described rows (doc_id, text_key, set_key, n_shingles), and (set_key, n_links, class_id, class_key, has_least) of every set.

    ``class_key`` tells classes apart whose smallest ids are the same.
    """
    runs = runs_for(recall, similarity)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in C.blocks_of_rows(frames, "text"):
            out = []
            for tokens in shingle_sets(_encoded(frame["text"]), width):
                if not len(tokens):
                    out.append((None, 0, None, *[None] * (2 * DEPTH - 1)))
                    continue
                levels = paths(tokens, runs, similarity)
                nodes = [levels[0][1].view(np.int64)]
                for parent, child in levels[1:]:
                    nodes += [parent.view(np.int64), child.view(np.int64)]
                out.append((xxhash.xxh3_128_digest(tokens.tobytes()), len(tokens), sketch(tokens), *nodes))
            made = pd.DataFrame(out, columns=["set_key", "n_shingles", "sketch", *names])
            made.insert(0, "text_key", frame["text_key"].to_numpy())
            made.insert(0, "doc_id", frame["doc_id"].astype("Int64").array)
            yield made

    names = ["path1", *(f"{k}{i}" for i in range(2, DEPTH + 1) for k in ("parent", "path"))]
    kind = "doc_id long, text_key long, set_key binary, n_shingles long, sketch binary, " + ", ".join(f"{n} array<long>" for n in names)
    described = C.materialize(rows.mapInPandas(describe, kind), "shingle-sets")
    # equal sets have equal sketches and nodes, so any of them will do; each set gets a number when it is written
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "sketch", *names)]
    sets = described.where(_USABLE).groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count(F.lit(1)).alias("times"), *firsts)
    sets = C.materialize(sets.select(F.monotonically_increasing_id().alias("sid"), "set_key", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("text_key"), "times", "n_shingles", "sketch", *names), "sets")

    # the sizes of the buckets of each level; only what lies below a large one goes on
    level, members, sizes = sets.select("sid", F.explode("path1").alias("path")), [], []
    for depth in range(1, DEPTH + 1):
        own = C.materialize(level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "path-sizes")
        members.append(level)
        sizes.append(own if depth == DEPTH else own.where(F.col("n") <= small))
        if depth < DEPTH:
            nodes = sets.select("sid", F.explode(F.arrays_zip(F.col(f"parent{depth + 1}").alias("parent"), F.col(f"path{depth + 1}").alias("path"))).alias("x")).select("sid", "x.parent", "x.path")
            level = C.materialize(nodes.join(own.where(F.col("n") > small).select(F.col("path").alias("parent")), "parent", "left_semi").select("sid", "path"), "paths")
    in_buckets = functools.reduce(DataFrame.unionByName, members).join(functools.reduce(DataFrame.unionByName, sizes), "path")
    dealt = tiled(in_buckets.join(sets.select("sid", "sketch"), "sid"), "sid", F.ceil(F.col("n") / (8 * small)))

    def candidates(frame: pd.DataFrame) -> pd.DataFrame:
        """Of each tile of a bucket the pairs that sketches find alike, as few of them as hold their members together."""
        keys = frame[["path", "tile_a", "tile_b", "part"]].to_numpy(dtype=np.int64)
        sid, marks = frame["sid"].to_numpy(), np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint32).reshape(len(frame), BINS)
        runs = np.array(_runs_of(keys[:, :3]))
        two = runs[runs[:, 1] - runs[:, 0] == 2, 0]  # most buckets are pairs
        two = two[(keys[two, 1] == keys[two, 2]) | (keys[two, 3] != keys[two + 1, 3])]
        two = two[_share(marks[two], marks[two + 1]) >= similarity - MARGIN]
        a, b = [np.maximum(sid[two], sid[two + 1])], [np.minimum(sid[two], sid[two + 1])]
        for s, e in runs[runs[:, 1] - runs[:, 0] > 2].tolist():
            left, right = np.flatnonzero(keys[s:e, 3] == keys[s, 1]), np.flatnonzero(keys[s:e, 3] == keys[s, 2])
            i, j = _alike(marks[s:e], left, right, similarity - MARGIN)
            order = np.argsort(sid[s:e], kind="stable")
            place = np.empty(e - s, dtype=np.int64)
            place[order] = np.arange(e - s)
            root = order[spanning(e - s, place[i], place[j])[place]]
            at = np.flatnonzero(root != np.arange(e - s))
            a.append(sid[s:e][at])
            b.append(sid[s:e][root[at]])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    found = C.by_runs(dealt, ["path", "tile_a", "tile_b"], ["sid"], candidates, "a long, b long")
    grouped = C.materialize(components(found).withColumnsRenamed({"node": "sid", "component": "comp"}), "candidate-groups")

    wanted = grouped.join(sets.select("sid", "rep", "text_key", "times", "n_shingles"), "sid")
    texts = rows.join(wanted.withColumnsRenamed({"rep": "doc_id"}), ["doc_id", "text_key"])

    def to_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # a row that repeats an id and its text would bring its set twice
        for frame in C.blocks_of_rows(frames, "text"):
            frame = frame[~frame["sid"].isin(seen)].drop_duplicates("sid")
            seen.update(frame["sid"].tolist())
            made = shingle_sets(_encoded(frame["text"]), width)
            yield frame[["sid", "comp", "times"]].assign(tokens=[t.tobytes() for t in made])

    held = C.materialize(texts.select("sid", "comp", "times", "text").mapInPandas(to_sets, "sid long, comp long, times long, tokens binary"), "candidate-sets")
    # a tile is bounded by sets and by their tokens
    groups = grouped.join(sets.select("sid", "n_shingles"), "sid").groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.ceil(F.sum("n_shingles") / TILE_TOKENS)).alias("parts"))
    tiles = tiled(held.join(groups, "comp"), "sid", F.col("parts")).drop("parts")

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["comp", "tile_a", "tile_b", "sid"])  # tasks may have brought a set each
        keys = frame[["comp", "tile_a", "tile_b", "part"]].to_numpy(dtype=np.int64)
        sid, times, tokens = frame["sid"].to_numpy(), frame["times"].to_numpy(), frame["tokens"].to_list()
        out = []
        for s, e in _runs_of(keys[:, :3]):
            _, a, b, _ = keys[s]
            own = [np.frombuffer(t, dtype=U64) for t in tokens[s:e]]
            i, j = _similar(own, keys[s:e, 3] == a, keys[s:e, 3] == b, a == b, similarity)
            if not len(i):
                continue
            n, ids, counts = e - s, sid[s:e], times[s:e]
            links = np.bincount(i, weights=counts[j], minlength=n) + np.bincount(j, weights=counts[i], minlength=n)
            order = np.argsort(ids, kind="stable")
            place = np.empty(n, dtype=np.int64)
            place[order] = np.arange(n)
            root = ids[order][spanning(n, place[i], place[j])[place]]
            at = np.flatnonzero(links)
            out.append(pd.DataFrame({"sid": ids[at], "links": links[at].astype(np.int64), "root": root[at]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"sid": [], "links": [], "root": []})

    verified = C.materialize(C.by_runs(tiles, ["comp", "tile_a", "tile_b"], ["sid"], verify, "sid long, links long, root long"), "links")
    counted = verified.groupBy("sid").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sid")
    named = C.materialize(joined.join(sets.select("sid", "rep"), "sid"), "linked-sets")
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    of_class = named.join(least, "component").join(counted, "sid").select("sid", "links", "class_id", "component")
    per_set = sets.select("sid", "set_key", "rep", "times").join(of_class, "sid", "left")
    return described, per_set.select("set_key", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("component", "sid").alias("class_key"), F.coalesce("class_id", "rep").eqNullSafe(F.col("rep")).alias("has_least"))


def _encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def _runs_of(keys: np.ndarray) -> list[tuple[int, int]]:
    """Where the runs of equal rows of ``keys`` begin and end."""
    cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist() if len(keys) else []
    return list(zip(cut, [*cut[1:], len(keys)], strict=True))


def _share(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the bins that either of two sketches fills, the share where they agree."""
    same = ((x == y) & (x > 0)).sum(axis=-1)
    return same / np.maximum(((x > 0) | (y > 0)).sum(axis=-1), 1)


def _alike(marks: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose sketches agree in at least that share of their bins."""
    i, j, step = [], [], max(1, 4096 // max(len(right), 1))
    for at in range(0, len(left), step):
        own = left[at : at + step]
        x, y = np.nonzero(_share(marks[own][:, None, :], marks[right][None, :, :]) >= least)
        i.append(own[x])
        j.append(right[y])
    i, j = np.concatenate(i), np.concatenate(j)
    return i[i != j], j[i != j]


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of exact similarity or more, by products of 0/1 matrices over the tokens that two sets or more have."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    member = np.repeat(np.arange(len(sets)), size)
    shared = times[token] > 1
    number = np.cumsum(times > 1) - 1
    token, member = number[token[shared]], member[shared]
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    both = np.zeros((len(a), len(b)), dtype=np.float32)
    row_a, row_b = np.full(len(sets), -1), np.full(len(sets), -1)
    row_a[a], row_b[b] = np.arange(len(a)), np.arange(len(b))
    order = np.argsort(token, kind="stable")
    token, member = token[order], member[order]
    step = 8192
    for first in range(0, int(times[times > 1].size), step):
        own = slice(*np.searchsorted(token, [first, first + step]))
        t, m = token[own] - first, member[own]
        x, y = np.zeros((len(a), step), dtype=np.float32), np.zeros((len(b), step), dtype=np.float32)
        on = row_a[m] >= 0
        x[row_a[m[on]], t[on]] = 1
        on = row_b[m] >= 0
        y[row_b[m[on]], t[on]] = 1
        both += x @ y.T
    union = size[a][:, None] + size[b][None, :] - both
    i, j = np.nonzero(both >= similarity * union - 1e-9)
    i, j = a[i], b[j]
    on = i < j if same else np.ones(len(i), dtype=bool)
    return i[on], j[on]


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, all columns kept: that with the smallest id, then set, then text.

    Rows without an id have no class and stay.  Of rows that repeat an id and its text one stays, any one.
    """
    described, classes = _classes(docs, doc_id=doc_id, text=text, **options)
    # sets that hold their class's smallest id; where two do, under the same id, the smaller set
    chosen = classes.where("has_least").groupBy("class_key").agg(F.min(F.struct("set_key", "class_id")).alias("least")).select("least.set_key", F.col("least.class_id").alias("winner"))
    ours = described.where("doc_id is not null").select("doc_id", "text_key", "set_key")
    rows = ours.join(chosen, ["set_key"], "left").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("set_key").isNull() | (F.col("doc_id") == F.col("winner"))).alias("ok"), F.first("set_key").alias("set_key"))
    rows = C.materialize(rows, "jaccard-rows")
    # two texts of one id that are the same set: the smaller key stays
    twins = rows.where("ok and set_key is not null").groupBy("set_key").agg(F.min("text_key").alias("least"))
    judged = rows.join(twins, "set_key", "left").withColumn("ok", F.coalesce(F.col("ok") & (F.col("least").isNull() | (F.col("least") == F.col("text_key"))), F.lit(False)))
    marks = C.materialize(judged.where("not ok or n > 1").select(F.col("doc_id").alias("id"), "text_key", "ok"), "jaccard-marks")
    keyed = docs.select(F.struct(*docs.columns).alias("d"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_key"))
    passed = keyed.join(marks, ["id", "text_key"], "left_anti").select("d.*")
    repeated = keyed.join(marks.where("ok").select("id", "text_key"), ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).select("d.*")
    return passed.unionByName(repeated)
