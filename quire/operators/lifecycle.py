"""Documents and jobs over time: events, expiry, cascading deletes, lookups, downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import is_id

#: The levels of an event.
LEVELS = ("info", "ok", "warn", "error")


def events(messages: DataFrame, at: Column) -> DataFrame:
    """Rows (key, t, level, msg) to be appended to the table of events; one of an unknown or no level is an error."""
    level = F.when(F.col("level").isin(*LEVELS), F.col("level")).otherwise("error")
    return messages.select("key", at.alias("t"), level.alias("level"), "msg")


def totals(sections: DataFrame) -> DataFrame:
    """Per document: sections, protected ones, pages and known bytes."""
    pages = F.col("end_page") - F.col("start_page") + 1
    return sections.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.count_if("protected").alias("n_protected"), F.sum(pages).alias("pages"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"))


def expired(last_access: DataFrame, now: Column, ttl_seconds: int, active: DataFrame) -> DataFrame:
    """Keys (key, last_access) not used for longer than the time to live, and without an active job (key)."""
    # to the microsecond, whether the times have a zone or not
    old = last_access.where(F.col("last_access") + F.make_dt_interval(secs=F.lit(ttl_seconds)) < now)
    return old.join(active.select("key").distinct(), "key", "left_anti").select("key")


def cascade(documents: DataFrame, children: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of documents and of what belongs to them (key) once some keys are removed."""
    return documents.join(removed, "key", "left_anti"), children.join(removed, "key", "left_anti")


def downloadable(volumes: DataFrame) -> DataFrame:
    """Volumes of completed jobs that did not fail, and whether the job's whole archive may be given."""
    done = volumes.where("state = 'completed'")
    ready = done.groupBy("doc_id").agg(F.bool_and(F.col("status").isin("PASS", "ACCEPTED_OVER_LIMIT")).alias("archive_ready"))
    return done.where("status <> 'FAIL'").join(ready, "doc_id").select("doc_id", "vol_idx", "archive_ready")


def touched(records: DataFrame, lookups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lookups by id, and the records after them.

    ``records`` is (key, last_access), ``lookups`` (key, at).  The first result is (key, at, found): an id that is not 32
    hexadecimal digits is never looked for.  The second is the records with the time of their last lookup, if later.
    """
    wanted = lookups.where(is_id(F.col("key")))
    last = wanted.groupBy("key").agg(F.max("at").alias("at"))
    known = records.select("key", F.lit(True).alias("known"))
    found = lookups.join(known, "key", "left").select("key", "at", (F.coalesce("known", F.lit(False)) & F.coalesce(is_id(F.col("key")), F.lit(False))).alias("found"))
    return found, records.join(last, "key", "left").select("key", F.greatest("last_access", "at").alias("last_access"))


def latest(events: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, last_event, n_events) of the wanted keys, from events (key, event_id, ts); the larger id on equal times."""
    wanted = events.join(keys.select("key").distinct(), "key", "left_semi")
    return wanted.groupBy("key").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("last_event"), F.count(F.lit(1)).alias("n_events"))
