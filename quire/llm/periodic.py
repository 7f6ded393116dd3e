"""Runs of repeated words: a suffix automaton seeds squares, squares are extended to maximal runs.

Words are numbered within their text.  The automaton's states are visited from the longest strings to the shortest, and
the ordered sets of end positions of a state's children are merged, the smaller into the larger.  Two end positions that
become neighbours in a state no nearer to each other than its string is long make a square: the string occurs at both, so
what lies between repeats with that distance as its smallest period (a smaller one would give an occurrence in between).
A square is extended to both sides as far as the period holds; squares within a known run of that period are passed over.

The automaton is built where a run can be (``regions``).  All but the first period of a run of exponent 4 repeats what
stands at most one period before, so the words there (periods up to 3) or their groups of four (longer periods) have all
occurred at most that far back, three periods long.  What fails that is in no run; nothing else is left out.

Every row is worked on by itself, so nothing is shuffled and memory is bounded by the longest text.

Cases: a null or empty text, or one of fewer than 6 words, has no runs; repeated rows and ids are judged alike; a null id
stays null; runs are ordered by start, then period; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
#: Words of the groups that longer periods are looked for by.
GROUP = 4
FAR = np.iinfo(np.int64).max


def _back(keys: np.ndarray) -> np.ndarray:
    """How far back each key occurred last."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), FAR, dtype=np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def _streaks(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(ok.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def regions(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Disjoint ranges of places that hold every run of at least ``least`` words and ``times`` (4 or more) periods."""
    n = len(ids)
    if n < least:
        return []
    found = []
    start, end = _streaks(_back(ids) < GROUP)
    for a, z in zip(start.tolist(), end.tolist(), strict=True):
        if z - a >= min(max(least, times * q) - q for q in range(1, GROUP)):
            found.append((max(0, a - GROUP + 1), z))
    if n >= times * GROUP:
        h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        keys = h[: n - GROUP + 1].copy()
        for k in range(1, GROUP):  # equal groups have equal keys; other equal keys only make regions larger
            keys = keys * np.uint64(0xD1342543DE82EF95) + h[k : n - GROUP + 1 + k]
        back = _back(keys)
        near = back <= n // times
        start, end = _streaks(near)
        for a, z in zip(start.tolist(), end.tolist(), strict=True):
            most = (z - a + GROUP - 1) // (times - 1)  # the longest period that so long a streak allows
            if most >= GROUP and int(back[a:z].min()) <= most:
                found.append((max(0, a - most), z + GROUP - 1))
    found.sort()
    out: list[tuple[int, int]] = []
    for a, z in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def squares(ids: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first end, second end, length of the string) of neighbouring occurrences no further apart than the string is long."""
    length, link, after, last = [0], [-1], [{}], 0
    ends: list[list[int] | None] = [None]
    for at, c in enumerate(ids):
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        after.append({})
        ends.append([-at - 1])
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                after.append(after[q].copy())
                ends.append(None)
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    del after
    order = np.argsort(np.array(length), kind="stable")[:0:-1].tolist()
    for v in order:  # all that link to v are longer, so v's set is whole by now
        u, own = link[v], ends[v]
        ends[v] = None
        if u <= 0:
            continue
        into = ends[u]
        if into is None:
            ends[u] = own
            continue
        if len(own) > len(into):
            own, into = into, own
        for x in own:  # negative ends, so that a state's first end, its smallest, is appended
            insort(into, x)
        ends[u], most = into, length[u]
        for x in own:
            i = bisect_left(into, x)
            if i and x - into[i - 1] <= most:
                yield -x, -into[i - 1], most
            if i + 1 < len(into) and into[i + 1] - x <= most:
                yield -into[i + 1], -x, most


def _reach(ids: np.ndarray, at: int, period: int, step: int) -> int:
    """From ``at``, how many places in the direction of ``step`` go on with the period."""
    n, block, total = len(ids), 32, 0
    while True:
        if step > 0:
            size = min(block, n - at - total)
            here = ids[at + total : at + total + size] != ids[at + total - period : at + total - period + size]
        else:
            size = min(block, at - total)
            here = (ids[at - total - size : at - total] != ids[at - total - size + period : at - total + period])[::-1]
        stop = np.flatnonzero(here)
        if len(stop):
            return total + int(stop[0])
        total += size
        if size < block:
            return total
        block *= 2


def find(ids: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least ``least`` words and ``times`` periods, by start, then period."""
    known: dict[int, tuple[list[int], list[int]]] = {}
    for a, z in regions(ids, least, times):
        for first, second, long in squares(ids[a:z].tolist()):
            period, begin, end = second - first, a + first - long, a + second
            starts, stops = known.setdefault(period, ([], []))
            i = bisect_right(starts, begin) - 1
            if i >= 0 and end <= stops[i]:
                continue
            begin -= _reach(ids, begin, period, -1)
            end += _reach(ids, end, period, 1)
            i = bisect_left(starts, begin)
            starts.insert(i, begin)
            stops.insert(i, end)
    runs = [(s, e - s, p) for p, (starts, stops) in known.items() for s, e in zip(starts, stops, strict=True) if e - s >= max(least, times * p)]
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs(docs: DataFrame, *, least: int = 6, times: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row; ``collapsed`` keeps the first period of each run, words joined by a space."""
    if times < 4:
        raise ValueError("runs of fewer than 4 periods are not looked for")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, found, texts = [], [], []
            for value in b.column(1):
                words = (value.as_py() or "").encode().split()  # at ASCII white space
                number: dict[bytes, int] = {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
                own = find(ids, least, times)
                if own:
                    keep = np.ones(len(words), dtype=bool)
                    for s, n, p in own:
                        keep[s + p : s + n] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                counts.append(len(ids))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, SCHEMA)
