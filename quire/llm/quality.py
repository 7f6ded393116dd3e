"""A quality classifier by importance resampling.

Two generative models of hashed word n-grams (single words and pairs, a fixed number of buckets) are fitted: one to the
target, labelled good documents, one to the raw corpus, all documents.  A document's importance is the ratio of the two
probabilities, taken per n-gram and for a text of ``reach`` n-grams (a shorter text counts for what it has), so that
length alone does not decide.  N-grams that the target hardly ever has (``STRONG``) are also counted: of more than target
text of that length holds, the log likelihood ratio of their number counts against the text, so that a few bad words are
not lost in a long text, and the few that any long text has do not tell against it.  A sample
without replacement, in proportion to importance, of k documents is the Gumbel top-k: the k largest sums of the log
importance and a Gumbel variate.  k is the share of good documents among the labelled ones, of all documents.  The k-th
largest is found by counting in ever finer ranges; the scores themselves never meet in one place.

The target model may be fitted on a bounded sample of labelled documents (``sample``, those with the smallest hashed
ids); the raw model counts all documents.

Cases: a null or empty text has no n-grams and log importance 0; equal keys at the limit are all selected; the variate
comes from the id, so repeated rows share their fate; without labels all are selected; labels that contradict each other
count as bad; other columns are carried along by ``keep`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

BUCKETS = 1 << 18
SCALE = 1 << 20
#: Below this log ratio an n-gram is one that the target hardly ever has.
STRONG = -1.5


@dataclass
class Model:
    log_ratio: np.ndarray
    share: float
    #: The share of n-grams below ``STRONG`` in text of the target, by the smoothed model.
    strong_rate: float = 0.0


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the text of each: the lower half for words, the upper for pairs."""
    words, at = C.words_of(texts, lower=False, alphanumeric=False)
    n = np.diff(at)
    text_of = np.repeat(np.arange(len(texts)), n)
    half = np.uint64(BUCKETS // 2)
    single = words % half
    follows = text_of[1:] == text_of[:-1]
    pair = C.mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:])[follows] % half + half
    return np.concatenate([single, pair]).astype(np.int64), np.concatenate([text_of, text_of[1:][follows]])


def _bytes(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 50_000, doc_id: str = "doc_id", text: str = "text", smooth: float = 64.0) -> Model:
    """Fit both models; ``labels`` has doc_id, quality and toxic (0 or 1)."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg((F.coalesce(F.min("quality"), F.lit(0)) * (1 - F.coalesce(F.max("toxic"), F.lit(0)))).alias("good"))
    share = good.agg(F.avg(F.col("good").cast("double")).alias("s")).first()["s"]
    if share is None:
        return Model(np.zeros(BUCKETS), 1.0)
    # at most ``sample`` ids, so the broadcast is bounded by that parameter
    chosen = good.where("good = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), F.lit(True).alias("_good"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for block in C.blocks_of_rows(frames, "t"):
            bucket, text_of = _grams(_bytes(block["t"]))
            is_good = block["g"].to_numpy(dtype=bool)[text_of]
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[is_good], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"), "left")
    rows = rows.select("t", F.coalesce("_good", F.lit(False)).alias("g"))
    counts = rows.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow().to_pandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    out, strong = np.zeros(BUCKETS), 0.0
    for half in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS)):
        # both are smoothed in proportion, so that what is rare in the raw corpus tells little
        part = max(target[half].sum(), 1.0) / max(raw[half].sum(), 1.0)
        out[half] = np.log((target[half] + smooth * part) / (raw[half] + smooth) / part)
        strong += (raw[half] * np.exp(out[half]))[out[half] < STRONG].sum()
    return Model(out, float(share), float(strong / max(raw.sum(), 1.0)))


def _surplus(found: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of the expected against the found number (Poisson); 0 where no more than expected are found."""
    more = (found > expected) & (expected > 0)
    ratio = np.divide(found, expected, out=np.ones(len(found)), where=more)
    return np.where(more, found - expected - found * np.log(ratio), 0.0)


def _score_udf(model: Model, reach: float, seed: int):
    def score(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        parts = []
        for block in C.blocks_of_rows(iter([pd.DataFrame({"i": ids, "t": texts})]), "t"):
            bucket, text_of = _grams(_bytes(block["t"]))
            n = np.bincount(text_of, minlength=len(block))
            total = np.bincount(text_of, weights=model.log_ratio[bucket], minlength=len(block))
            own = block["i"].to_numpy(dtype=np.int64).view(np.uint64)
            uniform = ((C.mix(own * np.uint64(2) + np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
            strong = np.bincount(text_of, weights=(model.log_ratio < STRONG)[bucket].astype(float), minlength=len(block))
            log_importance = total * (reach / np.maximum(n, reach)) + _surplus(strong, n * model.strong_rate)
            parts.append(pd.DataFrame({"n_grams": n, "log_importance": log_importance, "key": np.round((log_importance - np.log(-np.log(uniform))) * SCALE).astype(np.int64)}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"n_grams": [], "log_importance": [], "key": []})

    return F.pandas_udf(score, "struct<n_grams:long,log_importance:double,key:long>")


def kth_largest(keys: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a column of whole numbers, by counting in ranges of 2^24, then 2^12, then 1."""
    lower, rest = None, k
    for shift in (24, 12, 0):
        within = keys if lower is None else keys.where(F.shiftright(F.col(column), shift + 12) == lower)
        counts = within.groupBy(F.shiftright(F.col(column), shift).alias("range")).count().orderBy(F.desc("range")).toArrow().to_pandas()
        reached = counts["count"].cumsum()
        at = int(np.searchsorted(reached, rest))
        if at >= len(counts):
            return None
        rest -= int(reached[at - 1]) if at else 0
        lower = int(counts["range"].iloc[at])
    return lower


def score(docs: DataFrame, model: Model, *, reach: float = 150.0, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_grams, log_importance and key of every document."""
    found = _score_udf(model, reach, seed)(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1).cast("long")), F.col(text))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), found.alias("_found")).select("doc_id", "_found.*")


def threshold(scores: DataFrame, share: float) -> int | None:
    """The smallest key that is selected; None selects all."""
    if share >= 1:
        return None
    n = scores.count()
    return kth_largest(scores, "key", max(1, round(share * n))) if n else None


def select(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Scores of all documents and whether each is selected."""
    names = {k: v for k, v in options.items() if k in ("doc_id", "text")}
    model = fit(docs, labels, **names)
    scores = C.materialize(score(docs, model, **options), "quality-scores")
    least = threshold(scores, model.share)
    chosen = F.lit(True) if least is None else F.col("key") >= least
    return scores.select("doc_id", "n_grams", "log_importance", (F.col("key") / SCALE).alias("key"), chosen.alias("selected"))


def keep(docs: DataFrame, labels: DataFrame, *, reach: float = 150.0, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The selected documents with all their columns; scores are made once more, where the texts are, instead of a join."""
    model = fit(docs, labels, doc_id=doc_id, text=text)
    least = threshold(C.materialize(score(docs, model, reach=reach, seed=seed, doc_id=doc_id, text=text).select("key"), "quality-keys"), model.share)
    if least is None:
        return docs
    own = "_quality_" + "_".join(docs.columns)
    found = _score_udf(model, reach, seed)(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1).cast("long")), F.col(text))
    return docs.withColumn(own, found).where(F.col(own)["key"] >= least).drop(own)
