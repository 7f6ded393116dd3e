"""Helpers that the operators of this subpackage share.

*Chunks.*  Some operators must compare every document with the rest of the
corpus.  They work on chunks: all documents whose id falls into one range of
ids, cut where about ``CHUNK_BYTES`` of text have come together
(``Layout``).  A chunk sends sorted arrays of 64-bit keys, cut by key range
into buckets, and gets an aligned array of answers back, so that a key costs a
few bytes in a shuffle.  Both their numbers follow the size of the corpus.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
MOST_CHUNKS = 1 << 20
SEGMENT = 1 << 20
#: Stands for a missing id: the smallest long, which no other id should be.
NO_ID = -(1 << 63)
_OWN_DIRS: dict[str, str] = {}

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; an own one in local mode where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="quire-")
    return _OWN_DIRS[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut and sizes become known."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def blocks_of_rows(frames: Iterator[pd.DataFrame], column: str, limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut frames into blocks of at most ``limit`` characters (one longer row stands alone)."""
    for frame in frames:
        if not len(frame):
            continue
        sizes = frame[column].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy(dtype=np.int64)
        if sizes.sum() <= limit:
            yield frame
            continue
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield frame.iloc[start:i]
                start, total = i, 0
            total += int(size)
        yield frame.iloc[start:]


def by_runs(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``work`` to whole runs of rows with equal ``keys``: rows are dealt by key, sorted, and read run after run.

    ``work`` gets frames of one or more whole runs, in order; a task holds little more than one batch and one run, so
    runs must be bounded, but there may be any number of them and no fixed number of cells they fall into.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            if waiting and all(waiting[-1][k].iloc[-1] == frame[k].iloc[-1] for k in keys):
                waiting.append(frame)
                continue
            last = np.ones(len(frame), dtype=bool)
            for k in keys:
                last &= (frame[k] == frame[k].iloc[-1]).to_numpy()
            first = int(np.argmax(last))
            done = pd.concat([*waiting, frame.iloc[:first]], ignore_index=True)
            if len(done):
                yield work(done)
            waiting = [frame.iloc[first:]]
        if waiting:
            yield work(pd.concat(waiting, ignore_index=True))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(read, schema)


# --- hashing -------------------------------------------------------------------------------------------------------


def _power_table(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 4096)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * SEGMENT:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    n, i = len(starts), 0
    out = np.empty(n, dtype=U64)
    while i < n:
        base = int(starts[i])
        j = max(int(np.searchsorted(ends, base + SEGMENT, side="right")), i + 1)
        part = buf[base : int(ends[j - 1])]
        power = _power_table(_MULT, len(part) + 1)
        inverse = _power_table(_INVERSE, len(part) + 1)
        prefix = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)], out=prefix[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((prefix[e] - prefix[s]) * inverse[s] + (e - s).astype(U64))
        i = j
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line feed after each, as bytes, and where each begins (one more entry for the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8) if texts else np.zeros(0, dtype=np.uint8)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return buf, bounds


def words_of(texts: list[bytes], *, lower: bool = True, alphanumeric: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts, one after another, and the number of words up to each text.

    Words are runs of ASCII letters, digits and non-ASCII characters, or, without ``alphanumeric``, runs of anything
    but ASCII white space.
    """
    buf, bounds = joined(texts)
    if lower:
        buf = _LOWER[buf]
    inside = _IS_WORD[buf] if alphanumeric else ~_IS_SPACE[buf]
    starts, ends = spans_of(inside)
    return span_hashes(buf, starts, ends), np.searchsorted(starts, bounds)


# --- chunks --------------------------------------------------------------------------------------------------------


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def dump(**arrays: np.ndarray) -> bytes:
    """Some arrays as one compressed value; the reader names their types."""
    parts = [np.ascontiguousarray(a) for a in arrays.values()]
    head = np.array([len(p) for p in parts], dtype=np.int64)
    return squeeze(head.tobytes() + b"".join(p.tobytes() for p in parts))


def load(data: bytes, *types: str) -> list[np.ndarray]:
    raw = unsqueeze(data)
    sizes = np.frombuffer(raw, dtype=np.int64, count=len(types))
    at, out = 8 * len(types), []
    for kind, n in zip(types, sizes, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=int(n), offset=at))
        at += int(n) * np.dtype(kind).itemsize
    return out


@dataclass
class Layout:
    """The first ids of all chunks but the first, and how many chunks and buckets there are."""

    firsts: np.ndarray
    chunks: int
    buckets: int


def layout(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Layout:
    """Chunks of ids by the bytes of their texts, wherever the ids lie.

    Ids with their sizes are put in order over range partitions, and each partition is cut where a chunk is full; only
    rows of one id can make a chunk larger.  The ids at the cuts come to the driver: ``MOST_CHUNKS`` and one for each
    partition at most, as a very large corpus has larger chunks.
    """
    sizes = materialize(docs.select(F.col(doc_id).cast("long").alias("i"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n")), "sizes")
    size = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()["bytes"])
    each = max(CHUNK_BYTES, size // MOST_CHUNKS)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, filled, last = None, 0, None
        for frame in frames:
            out = []
            for i, n in zip(frame["i"].tolist(), frame["n"].tolist(), strict=True):
                if first is None:
                    first = i
                elif filled + n > each and i != last:
                    out.append((first, filled))
                    first, filled = i, 0
                filled, last = filled + n, i
            yield pd.DataFrame(out, columns=["i", "n"], dtype=np.int64)
        if first is not None:
            yield pd.DataFrame([(first, filled)], columns=["i", "n"])

    parts = max(1, min(-(-size // each), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ordered = sizes.where("i is not null").repartitionByRange(parts, "i").sortWithinPartitions("i")
    pieces = ordered.mapInPandas(cut, "i long, n long").toArrow().to_pandas().sort_values("i")
    firsts, filled = [], each
    for i, n in zip(pieces["i"].tolist(), pieces["n"].tolist(), strict=True):  # ends of partitions may be small
        if filled + n > each:
            firsts.append(i)
            filled = 0
        filled += n
    least = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return Layout(np.array(firsts[1:], dtype=np.int64), max(1, len(firsts)), max(least, -(-size // BUCKET_BYTES)))


def pack_chunks(docs: DataFrame, how: Layout, doc_id: str = "doc_id", text: str = "text", flag: Column | None = None) -> DataFrame:
    """(chunk, part): the documents of each chunk, compressed, in as many rows as batches that met it.

    Rows without id come before all others, dealt to chunks of their own by a hash of the text; a null text is an empty
    one.  Chunks are numbered in the order of their ids.
    """
    flag = F.lit(0) if flag is None else flag

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids = frame["i"].to_numpy(dtype=np.int64)
            texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in frame["t"]]
            flags, sizes = frame["f"].to_numpy(dtype=np.int8), np.array([len(t) for t in texts], dtype=np.int64)
            chunk = np.where(ids == NO_ID, NO_ID + frame["h"].to_numpy(dtype=np.int64), np.searchsorted(how.firsts, ids, side="right"))
            rows = []
            for c in np.unique(chunk):
                own = np.flatnonzero(chunk == c)
                data = np.frombuffer(b"".join(texts[i] for i in own), dtype=np.uint8)
                rows.append((int(c), dump(i=ids[own], f=flags[own], s=sizes[own], d=data)))
            yield pd.DataFrame(rows, columns=["chunk", "part"])

    spread = F.pmod(F.xxhash64(F.col(text)), F.lit(how.chunks))
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID).cast("long")).alias("i"), spread.alias("h"), F.col(text).alias("t"), flag.cast("byte").alias("f"))
    return source.mapInPandas(pack, "chunk long, part binary")


def unpack_chunk(parts: pd.Series) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, flags and texts of a chunk, ordered by id, then text."""
    rows: list[tuple[int, bytes, int]] = []
    for part in parts:
        ids, flags, sizes, data = load(part, "i8", "i1", "i8", "u1")
        raw, at = data.tobytes(), 0
        for i, f, n in zip(ids.tolist(), flags.tolist(), sizes.tolist(), strict=True):
            rows.append((i, raw[at : at + n], f))
            at += n
    rows.sort()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int8), [r[1] for r in rows]


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of 64-bit keys begins in sorted ``keys``; one more entry for the end."""
    step = (1 << 64) // buckets
    firsts = np.array([step * b for b in range(buckets)], dtype=U64)
    return np.append(np.searchsorted(keys, firsts), len(keys))


def ask(chunks: DataFrame, make: Callable[[pd.Series], dict[int, tuple[np.ndarray, ...]]], buckets: int) -> DataFrame:
    """(chunk, kind, bucket, keys): what ``make`` asks for a chunk, by kind: sorted unique keys and arrays aligned with them."""

    def requests(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind, (keys, *rest) in make(frame["part"]).items():
            edges = bucket_edges(keys, buckets)
            for b in np.flatnonzero(np.diff(edges)):
                cut = slice(edges[b], edges[b + 1])
                steps = np.diff(keys[cut], prepend=keys[cut][:1] * U64(0))
                rows.append((int(frame["chunk"].iloc[0]), kind, int(b), dump(k=steps, **{f"a{i}": x[cut] for i, x in enumerate(rest)})))
        return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "keys"])

    return chunks.groupBy("chunk").applyInPandas(requests, "chunk long, kind int, bucket int, keys binary")


def read_keys(data: bytes, *types: str) -> list[np.ndarray]:
    """Keys and aligned arrays as ``ask`` has written them."""
    steps, *rest = load(data, "u8", *types)
    return [np.cumsum(steps, dtype=U64), *rest]


def answers_by_bucket(frame: pd.DataFrame, kind: int, dtype: str) -> np.ndarray:
    """The answers for one kind of a chunk's keys, in the order of the keys."""
    own = frame[frame["kind"] == kind].sort_values("bucket")
    return np.concatenate([load(x, dtype)[0] for x in own["answer"]]) if len(own) else np.zeros(0, dtype=dtype)
