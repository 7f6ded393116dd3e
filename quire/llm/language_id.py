"""Language spans of mixed text: script ranges narrow the candidates, Viterbi decodes the words.

A model holds, for each language, log probabilities of hashed character trigrams, and which scripts its letters come
from.  A word (a run of letters) gets one score per language, the sum over its trigrams; a language that does not use
the word's script is as good as excluded.  Viterbi then labels the words of a text, where a change of language between
two words costs ``penalty``.  The decoder runs over equal segments of words at once: first the best way through a
segment from any language to any other, then the languages at the segments' ends, then the words.

The prediction for a text is the language that most letters are labelled with; its score is their share.

Cases: a null text or one without letters is ``und`` with score 0; ties go to the language that sorts first; repeated
rows are predicted alike; without any training rows everything is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

GRAMS = 1 << 16
SEGMENT_WORDS = 256
EXCLUDED = -60.0
#: First code points of script ranges, and the script's number (fixed values of Unicode blocks).
SCRIPT_STARTS = np.array(
    [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xB80, 0xC00, 0xE00, 0xE80, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000]
)
SCRIPTS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 0, 1, 0, 16, 17, 14, 16, 18, 14, 19, 16, 0, 16])
N_SCRIPTS = 20


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray  # GRAMS x languages, log probabilities
    uses: np.ndarray  # scripts x languages


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and its lower case where that is one code point."""
    n = 0x110000
    letter, lower = np.zeros(n, dtype=bool), np.arange(n, dtype=np.uint32)
    for block in (range(0, 0xD800), range(0xE000, 0x32000)):
        for cp in block:
            ch = chr(cp)
            if ch.isalpha():
                letter[cp] = True
                low = ch.lower()
                if len(low) == 1:
                    lower[cp] = ord(low)
    return letter, lower


def _words(texts: list[str | None]):
    """Lower-case code points with everything but letters blank, starts and ends of words, where each text begins."""
    letter, lower = _tables()
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) if t else np.zeros(0, dtype=np.uint32) for t in texts]
    bounds = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum([len(p) + 1 for p in points], out=bounds[1:])
    flat = np.full(int(bounds[-1]) + 1, 32, dtype=np.uint32)
    for at, p in zip(bounds[:-1].tolist(), points, strict=True):
        flat[at + 1 : at + 1 + len(p)] = p
    is_letter = letter[flat]
    flat = np.where(is_letter, lower[flat], 32).astype(np.uint32)
    starts, ends = C.spans_of(is_letter)
    return flat, starts, ends, bounds


def _grams(flat: np.ndarray) -> np.ndarray:
    """The hashed trigram around each position."""
    c = flat.astype(np.uint64)
    h = np.zeros(len(c), dtype=np.uint64)
    h[1:-1] = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return (C.mix(h) >> np.uint64(48)).astype(np.int64)


def _script(points: np.ndarray) -> np.ndarray:
    return SCRIPTS[np.searchsorted(SCRIPT_STARTS, points, side="right") - 1]


def fit(docs: DataFrame, *, lang: str = "lang", text: str = "text", share: float = 0.01) -> Model:
    """Count trigrams and scripts of all rows of ``docs`` that have a language; a fixed number of counts a language goes to the driver."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for block in C.blocks_of_rows(frames, "text"):
            for name, own in block.groupby("lang"):
                flat, starts, _, _ = _words(own["text"].tolist())
                on = flat != 32
                n = np.bincount(_grams(flat)[on], minlength=GRAMS + N_SCRIPTS)
                n[GRAMS:] = np.bincount(_script(flat[starts]), minlength=N_SCRIPTS)
                totals[name] = totals.get(name, 0) + n
        for name, n in totals.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": name, "cell": at, "n": n[at]})

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInPandas(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(counts["lang"].unique())
    table = np.zeros((GRAMS + N_SCRIPTS, len(languages)))
    for i, name in enumerate(languages):
        own = counts[counts["lang"] == name]
        table[own["cell"], i] = own["n"]
    grams, scripts = table[:GRAMS] + 0.05, table[GRAMS:]
    uses = scripts >= share * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), uses)


def viterbi(scores: np.ndarray, n_words: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of every word; ``scores`` has the words of all texts in a row, ``n_words`` how many each has."""
    total, k = scores.shape
    labels = np.zeros(total, dtype=np.int64)
    if not total or k < 2:
        return labels
    width = SEGMENT_WORDS
    n_segments = -(-n_words // width)
    first = np.cumsum(n_segments) - n_segments
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    within = np.arange(total) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    row, column = first[text_of] + within // width, within % width
    grid = np.zeros((width, int(n_segments.sum()), k), dtype=np.float64)  # words beyond a text's end don't tell
    grid[column, row] = scores
    segments = grid.shape[1]

    through = np.full((segments, k, k), -1e18)
    through[:, np.arange(k), np.arange(k)] = 0.0
    for step in range(width):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - penalty) + grid[step][:, None, :]

    begin = np.zeros((segments, k))
    for i in range(1, int(n_segments.max())):
        now = first[n_segments > i] + i
        begin[now] = (begin[now - 1][:, :, None] + through[now - 1]).max(axis=1)

    came = np.empty((width, segments, k), dtype=np.int32 if k > 127 else np.int8)
    state, same = begin, np.arange(k, dtype=came.dtype)
    for step in range(width):
        best = state.argmax(axis=1)
        jump = state.max(axis=1, keepdims=True) - penalty
        came[step] = np.where(jump > state, best[:, None].astype(came.dtype), same)
        state = np.maximum(state, jump) + grid[step]

    # the label after each segment's last word: from the right
    last = np.zeros(segments, dtype=np.int64)
    out = np.empty((width, segments), dtype=np.int64)
    for i in range(int(n_segments.max()) - 1, -1, -1):
        now = first[n_segments > i] + i
        final = n_segments[n_segments > i] == i + 1
        last[now[final]] = state[now[final]].argmax(axis=1)
        label = last[now]
        for step in range(width - 1, -1, -1):
            out[step, now] = label
            label = came[step, now, label].astype(np.int64)
        if i:
            last[now - 1] = label
    return out[column, row]


def label_words(texts: list[str | None], model: Model, penalty: float):
    """Labels, starts and ends of all words, and the number of words up to each text."""
    flat, starts, ends, bounds = _words(texts)
    at = np.searchsorted(starts, bounds)
    k = len(model.languages)
    if not len(starts) or not k:
        return np.zeros(0, dtype=np.int64), starts, ends, bounds, at
    on = flat != 32
    position = np.cumsum(on) - on
    scores = np.add.reduceat(model.grams[_grams(flat)[on]], position[starts], axis=0).astype(np.float64)
    allowed = model.uses[_script(flat[starts])]
    scores += np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0.0, EXCLUDED)
    return viterbi(scores, np.diff(at), penalty), starts, ends, bounds, at


def predict(docs: DataFrame, model: Model, *, penalty: float = 12.0, text: str = "text", keep: tuple[Column, ...] = (), spans: bool = False) -> DataFrame:
    """The ``keep`` columns of every row with lang_pred and score and, if asked for, spans (start, length, lang) in code points."""
    kind = "struct<lang_pred:string,score:double,spans:array<struct<start:int,length:int,lang:string>>>"

    def run(column: pd.Series) -> pd.DataFrame:
        out = [_of(block["text"].tolist()) for block in C.blocks_of_rows(iter([pd.DataFrame({"text": column})]), "text")]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"lang_pred": [], "score": [], "spans": []})

    def _of(texts: list[str | None]) -> pd.DataFrame:
        labels, starts, ends, bounds, at = label_words(texts, model, penalty)
        k, n = max(len(model.languages), 1), len(texts)
        letters = np.zeros((n, k))
        if len(labels):
            np.add.at(letters, (np.repeat(np.arange(n), np.diff(at)), labels), ends - starts)
        total = letters.sum(axis=1)
        names = np.array([*model.languages, "und"], dtype=object)
        best = np.where(total > 0, letters.argmax(axis=1), len(names) - 1)
        found = []
        for i in range(n if spans else 0):
            own, begin = labels[at[i] : at[i + 1]], bounds[i] + 1
            s, e = starts[at[i] : at[i + 1]] - begin, ends[at[i] : at[i + 1]] - begin
            cut = np.flatnonzero(np.diff(own, prepend=-1))
            stop = np.append(cut[1:], len(own))[: len(cut)] - 1
            found.append([{"start": int(s[a]), "length": int(e[b] - s[a]), "lang": model.languages[own[a]]} for a, b in zip(cut, stop, strict=True)])
        return pd.DataFrame({"lang_pred": names[best], "score": np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0), "spans": found if spans else [None] * n})

    made = F.pandas_udf(run, kind)
    out = docs.select(*keep, made(F.col(text)).alias("_found")).select("*", "_found.*").drop("_found")
    return out if spans else out.drop("spans")
