"""Packing of token sequences by the sum-of-squares rule.

A document's ids are cut into whole windows and one tail.  Whole windows are sequences of their own.  A tail goes,
online, to the fill level whose choice makes the sum over all levels of (number of partially filled windows)^2
smallest; the numbers of windows by level are an array.  Windows that are still partial when a task ends, or when it
holds ``max_open`` of them, are closed: the emptiest are cut up to fill the fullest, and what is left at the very end
is cut into sequences of a power of two, which need no padding.

Every task packs the documents it reads, so nothing is shuffled and a task's result depends on its input alone; a
sequence id is the partition's number, then a counter.

Cases: a null or empty text has the end id alone; repeated rows are packed as often as they come, ties between levels
go to the fullest; a null id stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END = (0).to_bytes(4, "little")
#: How a byte-level tokenizer splits a text before merging (a fixed value of the format).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenBytes:
    """Ids of a text as little-endian 32-bit bytes, for a byte-level BPE file of the tokenizers library.

    Where the file's ids are in the order of its merges they are ranks as well, and the faster of the two encoders for
    such ranks gives the same ids; any other file, and any text that is too much for that encoder's patterns (a million
    blanks), is left to the tokenizers library.  Added tokens in a text get their own ids, as they do there.
    """

    def __init__(self, path: str):
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens") or []
        plain = not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        ranks = self._ranks(spec) if plain else None
        self.encoding = None
        if ranks is not None:
            self.encoding = tiktoken.Encoding("file", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})

    @staticmethod
    def _ranks(spec: dict) -> dict[bytes, int] | None:
        """Bytes to id, if the file is plain byte-level BPE whose ids follow its merges."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
        if not plain:
            return None
        # bytes that print stand for themselves, the others for code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"].get(a + b) for a, b in pairs]
        if None in ids or any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
            return None
        singles = {c: model["vocab"].get(c) for c in byte_of}
        if None in singles.values() or max(singles.values()) >= min(ids, default=1 << 32):
            return None
        tokens = [*singles, *(a + b for a, b in pairs)]
        return {bytes(byte_of[c] for c in t): model["vocab"][t] for t in tokens}

    def one(self, text: str) -> bytes:
        if self.encoding is not None:
            try:
                return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except ValueError:  # the pattern's stack is limited
                pass
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


class SumOfSquares:
    """Open windows by fill level; a window is a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int, first_id: int, max_open: int):
        self.size, self.next_id, self.max_open = size, first_id, max_open
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.windows: dict[int, list[list]] = {}
        self.n_open = 0
        self.rows: list[tuple] = []

    def emit(self, window: list) -> None:
        offset = 0
        for doc_id, start, ids, total in window:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def level(self, n: int) -> int:
        """The level to put n tokens on: the least change of the sum of squares, then the fullest."""
        counts, top = self.counts, self.size - n
        change = 2 * counts[n : self.size + 1] + 1
        change[top] = 0  # a full window is no level
        change[1:] -= 2 * counts[1 : top + 1] - 1
        change[1:][counts[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, doc_id, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        piece = (doc_id, start, ids, total)
        if n == self.size:
            self.emit([piece])
            return
        h = self.level(n)
        if h:
            window = self.windows[h].pop()
            self.counts[h] -= 1
            self.n_open -= 1
            window.append(piece)
        else:
            window = [piece]
        if h + n == self.size:
            self.emit(window)
        else:
            self.windows.setdefault(h + n, []).append(window)
            self.counts[h + n] += 1
            self.n_open += 1
            if self.n_open > self.max_open:
                self.close(last=False)

    def close(self, *, last: bool) -> None:
        """Fill the fullest windows with what the emptiest hold, cut where needed."""
        open_ = [(h, w) for h in sorted(self.windows, reverse=True) for w in self.windows[h]]
        self.windows, self.n_open = {}, 0
        self.counts[:] = 0
        low = len(open_)
        spare: list[tuple] = []
        i = 0
        while i < low:
            h, window = open_[i]
            i += 1
            while h < self.size and (spare or low > i):
                if not spare:
                    low -= 1
                    spare = open_[low][1][::-1]
                doc_id, start, ids, total = spare.pop()
                n = min(len(ids) // 4, self.size - h)
                window.append((doc_id, start, ids[: 4 * n], total))
                h += n
                if 4 * n < len(ids):
                    spare.append((doc_id, start + n, ids[4 * n :], total))
            if h == self.size:
                self.emit(window)
            else:
                spare = window[::-1]
        if spare and not last:
            n = sum(len(p[2]) // 4 for p in spare)
            self.windows, self.n_open = {n: [spare[::-1]]}, 1
            self.counts[n] = 1
            return
        rest = sum(len(p[2]) // 4 for p in spare)
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            window = []
            while room:
                doc_id, start, ids, total = spare.pop()
                n = min(len(ids) // 4, room)
                window.append((doc_id, start, ids[: 4 * n], total))
                room -= n
                if 4 * n < len(ids):
                    spare.append((doc_id, start + n, ids[4 * n :], total))
            self.emit(window)


def pack(docs: DataFrame, tokenizer: str, *, size: int = 1024, max_open: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens; ``tokenizer`` is a file of the tokenizers library."""
    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = TokenBytes(tokenizer)
        bins = SumOfSquares(size, TaskContext.get().partitionId() << 33, max_open)
        columns = SCHEMA.replace(" long", "").split(", ")

        def take() -> pd.DataFrame:
            rows, bins.rows = bins.rows, []
            out = pd.DataFrame(rows, columns=columns)
            out["doc_id"] = out["doc_id"].astype("Int64")
            return out

        for frame in frames:
            for key, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = (tokens.one(text) if isinstance(text, str) else b"") + END
                key, total = None if pd.isna(key) else int(key), len(ids) // 4
                for start in range(0, total, size):
                    bins.place(key, start, ids[4 * start : 4 * (start + size)], total)
            yield take()
        bins.close(last=True)
        yield take()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(packed, SCHEMA)
