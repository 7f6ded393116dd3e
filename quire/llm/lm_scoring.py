"""Bigram scoring by deleted interpolation.

p(w | v) = a_b * c(v, w) / c(v) + b_b * c(w) / N + g_b / (V + 1), where the weights of a context v depend on the
bucket b of its frequency c(v) (powers of two).  They are learned by expectation-maximisation on held-out counts: a
part of the training documents is deleted, the maximum-likelihood estimates come from what is retained, and the weights
are those under which the deleted tokens are likeliest.  The text is then scored with the estimates of all training
documents.  A context that was never seen has the weights of bucket 0, with no bigram term.

How it runs: a chunk of documents sends the 64-bit keys of its unigrams and bigrams with their counts to the buckets of
the key range; a bucket sums them over all chunks and sends back one count per key, aligned with the chunk's sorted
keys.  So the work and the traffic follow the number of different bigrams in each chunk, and no vocabulary is ever held
in one place.  Only the histogram for the expectation-maximisation (a fixed number of cells) and the totals go to the
driver.

Cases: a null or empty text is the end token alone; repeated rows count as often as they come; no training documents
gives uniform probabilities; a null id is a training document with id null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

UNI, BI = 0, 1
END_KEY = np.uint64(0x1F83D9ABFB41BD6B)
START_KEY = np.uint64(0x5BE0CD19137E2179)
BUCKETS_OF_CONTEXT = 64
#: Cells of probabilities, by quarters of a power of two down to 2^-63.
CELLS = 256
STEPS = 4
TRAIN, DELETED, UNSEEN = 0, 1, 2


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, each text's end included, and where each text's tokens begin (and the end)."""
    words, at = C.words_of(texts, alphanumeric=False)
    out = np.full(len(words) + len(texts), END_KEY, dtype=np.uint64)
    index = np.arange(len(words)) + np.repeat(np.arange(len(texts)), np.diff(at))
    out[index] = words
    return out, at + np.arange(len(at))


def _bigrams(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = START_KEY
    return C.mix(before * np.uint64(0x9E3779B97F4A7C15) ^ tokens)


def _sums(keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted unique keys with the counts of retained and of deleted training tokens."""
    unique, inverse = np.unique(keys, return_inverse=True)
    return (unique, *(np.bincount(inverse[part == p], minlength=len(unique)).astype(np.uint64) for p in (TRAIN, DELETED)))


def _read(parts: pd.Series):
    ids, flags, texts = C.unpack_chunk(parts)
    tokens, at = _tokens(texts)
    return ids, flags, texts, tokens, at, np.repeat(flags, np.diff(at))


def _with_contexts(keys: np.ndarray, at: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unigram keys and their parts, a start key for each text among them."""
    return np.concatenate([keys, np.full(len(at) - 1, START_KEY, dtype=np.uint64)]), np.concatenate([part, part[at[:-1]]])


def _lookup(unique: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return counts[np.searchsorted(unique, keys)]


def _ask(parts: pd.Series) -> dict:
    _, _, _, tokens, at, part = _read(parts)
    return {UNI: _sums(*_with_contexts(tokens, at, part)), BI: _sums(_bigrams(tokens, at), part)}


def _answer(frame: pd.DataFrame) -> pd.DataFrame:
    """Sum one bucket's keys over the chunks; a row with chunk null holds the bucket's totals."""
    read = [C.read_keys(x, "u8", "u8") for x in frame["keys"]]
    keys = np.concatenate([r[0] for r in read])
    unique, inverse = np.unique(keys, return_inverse=True)
    sums = [np.zeros(len(unique), dtype=np.uint64) for _ in range(2)]
    for i, total in enumerate(sums, 1):
        np.add.at(total, inverse, np.concatenate([r[i] for r in read]))
    rows, at, kind, bucket = [], 0, int(frame["kind"].iloc[0]), int(frame["bucket"].iloc[0])
    for chunk, r in zip(frame["chunk"].tolist(), read, strict=True):
        own = inverse[at : at + len(r[0])]
        at += len(r[0])
        rows.append((chunk, kind, bucket, C.dump(n=np.concatenate([s[own] for s in sums])), None, None, None))
    if kind == UNI:
        real = unique != START_KEY
        total = (sums[0] + sums[1]).astype(np.int64)
        rows.append((None, kind, bucket, None, int(total[real].sum()), int((total[real] > 0).sum()), int(sums[0][real].sum())))
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "answer", "tokens", "types", "retained"])


_ANSWER = "chunk long, kind int, bucket int, answer binary, tokens long, types long, retained long"


class _Counts:
    """The counts that a chunk's documents need; retained only, or all training tokens."""

    def __init__(self, docs: pd.DataFrame, answers: pd.DataFrame, *, retained: bool):
        self.ids, self.flags, _, tokens, self.at, self.part = _read(docs["part"])
        bigrams = _bigrams(tokens, self.at)
        uni, _ = _with_contexts(tokens, self.at, self.part)
        uni, bi = np.unique(uni), np.unique(bigrams)
        c1, c2 = self._counts(answers, UNI, retained), self._counts(answers, BI, retained)
        self.word = _lookup(uni, c1, tokens)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.at[:-1]] = _lookup(uni, c1, np.array([START_KEY]))[0] if len(self.at) > 1 else 0
        self.context, self.pair = before, _lookup(bi, c2, bigrams)
        self.bucket = np.where(before > 0, np.minimum(np.log2(np.maximum(before, 1)).astype(np.int64) + 1, BUCKETS_OF_CONTEXT - 1), 0)

    @staticmethod
    def _counts(answers: pd.DataFrame, kind: int, retained: bool) -> np.ndarray:
        own = answers[answers["kind"] == kind].sort_values("bucket")
        halves = [C.load(x, "u8")[0].reshape(2, -1) for x in own["answer"]]
        both = np.concatenate(halves, axis=1).astype(np.int64)
        return both[0] if retained else both.sum(axis=0)

    def ratios(self, total: int) -> tuple[np.ndarray, np.ndarray]:
        return self.pair / np.maximum(self.context, 1), self.word / max(total, 1)


def _cell(p: np.ndarray) -> np.ndarray:
    """Probabilities by quarters of a power of two; cell 0 is zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(CELLS - 1 + np.round(STEPS * np.log2(np.maximum(p, 1e-300))), 1, CELLS - 1), 0).astype(np.int64)


def _of_cell(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** ((cell - (CELLS - 1)) / STEPS), 0.0)


def learn_weights(cells: pd.DataFrame, types: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket x bigram, unigram, uniform) by expectation-maximisation over counted cells."""
    weights = np.tile([0.45, 0.45, 0.1], (BUCKETS_OF_CONTEXT, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for b, own in cells.groupby("b"):
        n = own["n"].to_numpy(dtype=float)
        p = np.stack([_of_cell(own["p2"].to_numpy()), _of_cell(own["p1"].to_numpy()), np.full(len(own), 1.0 / (types + 1))])
        w = weights[b]
        for _ in range(rounds):
            share = w[:, None] * p
            share /= share.sum(axis=0)
            w = (share * n).sum(axis=1) / n.sum()
            w = np.maximum(w, [0.0, 1e-6, 1e-6])
            w /= w.sum()
        weights[b] = w
    return weights


def score(docs: DataFrame, *, train, deleted, buckets: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log probabilities of all texts under the model of the training documents.

    ``train`` and ``deleted`` are conditions on a row: whether the model learns from it, and whether it belongs to the
    part whose tokens the weights are learned on.  Columns: doc_id, trained, n_tokens, n_known, train_tokens,
    base_score (add-half unigrams), score.
    """
    how = C.layout(docs, doc_id, text)
    buckets = buckets or how.buckets
    flag = F.when(train & deleted, DELETED).when(train, TRAIN).otherwise(UNSEEN)
    chunks = C.pack_chunks(docs, how, doc_id, text, flag)
    answers = C.ask(chunks, _ask, buckets).groupBy("kind", "bucket").applyInPandas(_answer, _ANSWER)
    answers = C.materialize(answers, "lm-counts")
    total = answers.where("chunk is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "retained"))).first()
    n, v, kept = int(total["tokens"]), int(total["types"]), int(total["retained"])
    answers = answers.where("chunk is not null").select("chunk", "kind", "bucket", "answer")

    def cells(_, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        c = _Counts(own, got, retained=True)
        p2, p1 = c.ratios(kept)
        on = c.part == DELETED
        code = (c.bucket[on] * CELLS + _cell(p2[on])) * CELLS + _cell(p1[on])
        code, times = np.unique(code, return_counts=True)
        return pd.DataFrame({"b": code // CELLS**2, "p2": code // CELLS % CELLS, "p1": code % CELLS, "n": times})

    by_chunk = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    table = by_chunk.applyInPandas(cells, "b long, p2 long, p1 long, n long").groupBy("b", "p2", "p1").agg(F.sum("n").alias("n"))
    weights = learn_weights(table.toArrow().to_pandas(), v)

    def scored(_, own: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        c = _Counts(own, got, retained=False)
        p2, p1 = c.ratios(n)
        w = weights[c.bucket]
        model = np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1))
        base = np.log10((c.word + 0.5) / (n + 0.5 * (v + 1)))
        over = lambda x: np.add.reduceat(x, c.at[:-1]) if len(c.at) > 1 else x[:0]
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if i == C.NO_ID else i for i in c.ids.tolist()], dtype="Int64"),
                "trained": c.flags != UNSEEN,
                "n_tokens": np.diff(c.at),
                "n_known": over((c.word > 0).astype(np.int64)),
                "train_tokens": n,
                "base_score": over(base),
                "score": over(model),
            }
        )

    schema = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk.applyInPandas(scored, schema)
