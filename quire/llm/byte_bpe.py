"""Byte-level BPE: ranked merges folded over distinct words by higher-order functions, and decoding.

A task cuts its texts into words by the tokenizer's pattern and lists each word once with the tokens that lie in it, Spark
folds their merges over the list, and the ids are dealt to the words' places again.  Texts flow in batches of ``BATCH`` characters; a word that a
batch before has listed is not listed again, until a task has ``WORDS`` of them and begins anew, which bounds its memory
and changes no result.  Nothing is shuffled, counted beforehand or kept between tasks, so a hot word or source costs no
more than others and a lost executor loses only its own tasks.

The fold: every token is one character, so a word of n bytes is n characters.  A merge can only matter to a word that
holds its bytes, so a trie of all tokens is walked from every place of the new words (``Parts``, in arrays over all words of
a batch; a walk ends where no token goes on).  Merges found are taken in the order of their ranks and each replaces its pair
of characters by the merged one from left to right.  This is what merging the pair of least rank again and again gives, as a merged token ranks above its two parts
and every token is made of one pair (``Ranks`` refuses a file where that does not hold).

Cases: a null or empty text has no ids; repeated rows and ids are encoded as often as they come; a null id stays null; a
word of any length is folded whole, with work near linear in its length; other columns are ignored; an empty table gives no rows; decoding null ids gives an empty value.
"""

from __future__ import annotations

import base64
import itertools
import json
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text whose new words are folded together, and words that a task remembers at least before it begins anew.
BATCH, WORDS = 4 << 20, 1 << 20
#: Places of words from which the trie is walked at once; bounds the memory for words of any length.
PLACES = 1 << 16


def char(token: int) -> str:
    """The character that stands for a token; surrogates are left out."""
    return chr(token + 256 if token + 256 < 0xD800 else token + 256 + 0x800)


def tokens_of(text: str) -> np.ndarray:
    """Tokens that characters stand for."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return np.where(code < 0xD800, code - 256, code - 256 - 0x800)


class Ranks:
    """The merges of a rank file (base64 of a token, its rank), as literals for Spark."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        self.pieces, self.chars, self.pairs = [b""] * size, [""] * size, [""] * size
        for token, rank in self.ranks.items():
            self.pieces[rank], self.chars[rank] = token, char(rank)
            if len(token) > 1:
                parts = self._parts(token, rank)
                if len(parts) != 2 or any(len(p) > 1 and self.ranks[p] >= rank for p in parts):
                    raise ValueError(f"the token of rank {rank} is not a merge of two tokens of lower rank")
                self.pairs[rank] = "".join(char(self.ranks[p]) for p in parts)
        self.bytes = [char(self.ranks[bytes([b])]) for b in range(256)]

    def _parts(self, token: bytes, rank: int) -> list[bytes]:
        """What merges below ``rank`` make of a token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            least, i = min((self.ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if least >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def literal(self) -> Column:
        """By rank, pairs and merged characters."""
        parse = lambda x: F.from_json(F.lit(json.dumps(x)), "array<string>")  # noqa: E731  folded to a literal before anything runs
        return F.struct(parse(self.pairs).alias("pairs"), parse(self.chars).alias("chars"))

    @staticmethod
    def fold(word: Column, found: Column, table: Column) -> Column:
        """A word, given as the characters of its bytes, and the ascending ranks of tokens in it, as the characters of its tokens."""
        return F.aggregate(found, word, lambda a, r: F.replace(a, F.get(table["pairs"], r), F.get(table["chars"], r)))


def _once(x: np.ndarray, kind: str | None = None) -> np.ndarray:
    """Distinct values in order (``numpy.unique`` hashes them, which is slower here)."""
    x = np.sort(x, kind=kind)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


class Parts:
    """The tokens of two bytes and more that lie anywhere in words, by a trie of all tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        # by length, then bytes: a single byte is its own node, and edges (node before, byte) ascend as the nodes behind them do
        nodes = sorted({t[:n] for t in ranks for n in range(1, len(t) + 1)}, key=lambda p: (len(p), p))
        number = {p: i for i, p in enumerate(nodes)}
        self.edges = np.array([*(number[p[:-1]] << 8 | p[-1] for p in nodes[256:]), np.iinfo(np.int32).max], dtype=np.int32)
        self.rank = np.array([ranks.get(p, -1) for p in nodes], dtype=np.int64)
        self.size = max(ranks.values()) + 1

    def find(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks, ascending and each once a word, and how many each word has; word i is the bytes up to ``ends[i]``."""
        found = [np.zeros(0, dtype=np.int64)]
        for start in range(0, len(flat), PLACES):
            at = np.arange(start, min(start + PLACES, len(flat)))
            word = np.searchsorted(ends, at, side="right")
            node, left, own, depth = flat[at].astype(np.int32), ends[word] - at, [], 1
            while len(at):
                on = left > depth
                at, word, left = at[on], word[on], left[on]
                edge = node[on] << 8 | flat[at + depth]
                to = np.searchsorted(self.edges, edge)
                on = self.edges[to] == edge
                at, word, left, node = at[on], word[on], left[on], (to[on] + 256).astype(np.int32)
                rank = self.rank[node]
                own.append((word * self.size + rank)[rank >= 0])
                depth += 1
            found.append(_once(np.concatenate(own)))
        both = _once(np.concatenate(found), kind="stable")  # a word may lie in several runs of places
        return both % self.size, np.bincount(both // self.size, minlength=len(ends))


class Words:
    """Cuts a text as the encoder's own regular expressions do, whose tables of Unicode can be of another version."""

    def __init__(self, pattern: str):
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([b]): b for b in range(256)}
        self.pattern, self.strict, self.low, odd = pattern, pattern, pattern, ""
        for kind in sorted(set(regex.findall(r"\\p\{\w+\}|\\s", pattern))):
            judge = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
            theirs = {c for n in range(0, len(every), 1 << 16) for c in judge.decode(judge.encode_ordinary(every[n : n + (1 << 16)]))}
            ours = set(regex.findall(kind, every))
            low = _ranges("".join(c for c in theirs if c < "\U00010000"))
            self.low = re.sub(r"\[[^\]]*\]", lambda m, k=kind, r=low: m[0].replace(k, r), self.low).replace(kind, f"[{low}]")
            self.low = self.low.replace(r"\S", f"[^{low}]") if kind == r"\s" and not re.search(r"\[[^\]]*\\S", self.pattern) else self.low
            more, less = "".join(sorted(theirs - ours)), "".join(sorted(ours - theirs))
            odd += more + less
            exact = kind + (f"||[{_ranges(more)}]" if more else "") + (f"--[{_ranges(less)}]" if less else "")
            self.strict = self.strict.replace(kind, f"[{exact}]") if more or less else self.strict
        self.odd = f"[{_ranges(odd)}]" if odd else "(?!)"

    def finder(self) -> Callable[[str], list[str]]:
        plain, strict, odd = regex.compile(self.pattern).findall, regex.compile(self.strict, regex.V1).findall, re.compile(self.odd).search
        # among ASCII characters the classes are those of the standard library, which is faster
        inside = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), self.pattern)
        simple = inside.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        ascii_ = re.compile(simple, re.ASCII).findall if r"\p" not in simple and r"\P" not in simple and "(?i" not in simple else plain
        # so are, with their characters below U+10000 listed, all classes of texts that have no others
        low = re.compile(self.low).findall if not re.search(r"\\[bBdDpPsSwWX]|\(\?[A-Za-z]", self.low) else None
        beyond = lambda text: len(text.encode("utf-16-le")) > 2 * len(text)
        return lambda text: ascii_(text) if text.isascii() else low(text) if low and not beyond(text) else plain(text) if not odd(text) else strict(text)


def _ranges(chars: str) -> str:
    """The inside of a character class."""
    code = np.unique(np.array([ord(c) for c in chars], dtype=np.int64))
    cut = np.flatnonzero(np.diff(code) > 1)
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(code[np.append(0, cut + 1)], code[np.append(cut, len(code) - 1)], strict=True))


def _split(words_of: Words, parts: Parts, chars: list[str], batch: int, most: int):
    """Texts to rows (doc_ids, counts, words, found, codes, first): new words as the characters of their bytes, numbered from ``first`` on, the tokens in them, and the words' numbers."""
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("words", pa.list_(pa.string())), ("found", pa.list_(pa.list_(pa.int32()))), ("codes", pa.binary()), ("first", pa.int64())])
    code, width = np.array([ord(c) for c in chars], dtype="<u4"), np.array([len(c.encode()) for c in chars])
    offsets = lambda n: pa.array(np.append(0, np.cumsum(n)), pa.int32())
    one = lambda array: pa.ListArray.from_arrays(pa.array([0, len(array)], pa.int32()), array)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = words_of.finder()
        ids: list = []
        counts: list[int] = []
        codes: list[np.ndarray] = []
        size = 0

        place: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        told = 0

        def take() -> pa.RecordBatch:
            flat = np.concatenate(codes) if codes else np.zeros(0, dtype="<i4")
            new = [w.encode() for w in itertools.islice(place, told, None)]
            long = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
            raw, ends = np.frombuffer(b"".join(new), dtype=np.uint8), np.cumsum(long)
            ranks, many = parts.find(raw, ends)
            found = pa.ListArray.from_arrays(offsets(many), pa.array(ranks, pa.int32()))
            starts = np.append(0, np.cumsum(width[raw]))[np.append(0, ends)]
            words = pa.StringArray.from_buffers(len(new), pa.py_buffer(starts.astype("<i4")), pa.py_buffer(code[raw].tobytes().decode("utf-32-le").encode()))
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(counts, dtype="<i8").tobytes()], pa.binary()), one(words), one(found), pa.array([flat.tobytes()], pa.binary()), pa.array([told], pa.int64())], schema=schema)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                words = find(text)
                codes.append(np.fromiter(map(place.__getitem__, words), dtype="<i4", count=len(words)))
                ids.append(key)
                counts.append(len(words))
                size += len(text)
                if size >= batch:
                    yield take()
                    ids, counts, codes, size, told = [], [], [], 0, len(place)
                    if told >= most:
                        place, told = defaultdict(itertools.count().__next__), 0
        if ids:
            yield take()

    return run


def _joined(words: pa.Array) -> str:
    if not len(words):
        return ""
    place = np.frombuffer(words.buffers()[1], dtype="<i8" if pa.types.is_large_string(words.type) else "<i4")[words.offset : words.offset + len(words) + 1]
    return words.buffers()[2][int(place[0]) : int(place[-1])].to_pybytes().decode() if place[-1] > place[0] else ""


def _pieces_of(ids: np.ndarray, pieces: np.ndarray) -> bytes:
    return b"".join(pieces[ids].tolist())


#: What ``encode`` can give of a text: its ids, the same as little-endian unsigned 32-bit integers, and its bytes by decoding them.
FORMS = {"ids": "array<int>", "packed": "binary", "decoded": "binary"}


def _gather(forms: tuple[str, ...], pieces: np.ndarray):
    """Ids of each document from the tokens of the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, long = np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64)
        for b in batches:
            for row in range(b.num_rows):
                words = b.column(2)[row].values
                if not b.column(4)[row].as_py():
                    flat, long = flat[:0], long[:0]
                flat = np.append(flat, tokens_of(_joined(words)).astype("<i4"))
                long = np.append(long, pc.utf8_length(words).to_numpy().astype(np.int64))
                del words
                first = np.cumsum(long) - long
                codes = np.frombuffer(b.column(3)[row].as_py(), dtype="<i4")
                ends = np.cumsum(np.frombuffer(b.column(1)[row].as_py(), dtype="<i8"))
                keys = b.column(0)[row].as_py()
                done = at = 0
                while done < len(keys):  # about 200,000 words of documents at a time
                    stop = max(done + 1, int(np.searchsorted(ends, at + 200_000, side="right")))
                    own = codes[at : ends[stop - 1]]
                    n = long[own]
                    upto = np.cumsum(n)
                    out = flat[np.repeat(first[own] - (upto - n), n) + np.arange(int(n.sum()))]
                    cuts = np.append(0, upto)[np.append(0, ends[done:stop] - at)]
                    spans = list(itertools.pairwise(cuts.tolist()))
                    columns = []
                    for form in forms:
                        if form == "ids":
                            columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(out, pa.int32())))
                        elif form == "packed":
                            columns.append(pa.array([out[a:z].tobytes() for a, z in spans], pa.binary()))
                        else:
                            columns.append(pa.array([_pieces_of(out[a:z], pieces) for a, z in spans], pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[done:stop], pa.int64()), *columns], names=["doc_id", *forms])
                    at, done = int(ends[stop - 1]), stop

    return run


def encode(docs: DataFrame, ranks: str, pattern: str, *, forms: tuple[str, ...] = ("ids",), batch: int = BATCH, most: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id and the ``forms`` asked for) of every row.

    ``ranks`` is a file of tiktoken's kind, read by the driver; ``pattern`` splits texts into words and must match all of them.
    """
    merges = Ranks(ranks)
    table = F.array(merges.literal())
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    cut = _split(Words(pattern), Parts(merges.ranks), merges.bytes, batch, most)
    split = source.mapInArrow(cut, "doc_ids array<long>, counts binary, words array<string>, found array<array<int>>, codes binary, first long")
    # an array of one binds the literals, so that they stand in the plan once
    folded = F.get(F.transform(table, lambda t: F.zip_with("words", "found", lambda w, f: merges.fold(w, f, t))), F.lit(0))
    schema = ", ".join(["doc_id long", *(f"{f} {FORMS[f]}" for f in forms)])
    return split.select("doc_ids", "counts", folded.alias("words"), "codes", "first").mapInArrow(_gather(forms, np.array(merges.pieces, dtype=object)), schema)


def decode(encoded: DataFrame, ranks: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, decoded): the pieces of the ids, concatenated."""
    pieces = np.array(Ranks(ranks).pieces, dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [_pieces_of(x.values.to_numpy(), pieces) if x.is_valid else b"" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
