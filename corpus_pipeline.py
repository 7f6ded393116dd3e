"""A corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.  The first three drop documents, the
fourth masks secrets inside the texts, the last returns pieces of packed sequences.  ``run`` writes each stage's result
as Parquet to the shared folder and reads it again as the next one's input.

Cases: a null or empty text has importance 0 in the first stage and is kept or not like any other there; later stages find
nothing in it and keep it (of rows that repeat an id and a text one stays after the second); a null id has no class of near
duplicates and stays; other columns are carried along, up to the last stage; an empty table gives no rows.  Ties and
repeated rows are as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, jaccard_join, packing, quality, secret_scan
from quire.llm.common import materialize
from quire.llm.queries import TOKENIZER, public_tokenizers, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secret_scan.redact(docs, secret_scan.fit(secret_scan.labelled_findings(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]

#: A random forest and a tokenizer stand between the documents and the rows, so SQL cannot give them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
