"""Queries that write files of the given tables and read them again: sources, sinks and the stream of job events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import intervals
from quire.plans import fixtures as fx
from quire.plans.queries import ORACLES, QUERIES, register
from quire.sources import tables, versions, volumes
from quire.sources.tables import table
from quire.streaming import events as streams
from quire.streaming import expiry

__all__ = ["ORACLES", "QUERIES"]  # with those of the other queries


def _folder(spark, name: str) -> str:
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: A file for every supplier: text that begins with the mark, or holds it behind 1020 signs, or not, under names of three kinds.
_FILES = """files as (select case s_suppkey % 3 when 0 then 'f' || s_suppkey || '.pdf' when 1 then 'f' || s_suppkey || '.PDF' else 'f' || s_suppkey || '.txt' end as filename,
    case when s_suppkey % 4 = 0 then repeat(' ', 1020) || '%PDF-' when s_suppkey % 5 = 0 then s_name else '%PDF-1.7 ' || s_name end || chr(10) as body from supplier)"""


@register(
    f"with {_FILES} select filename, strlen(body) as size_bytes, case when filename like '%.txt' then 'suffix' when strlen(body) > 1000 and body like ' %' and strlen(body) > 1024 then 'too_large' when body not like '%\\%PDF-%' escape '\\' then 'not_pdf' end as code from files",
    prelude=False,
)
def d1_uploads(spark, sf_dir):
    """What is wrong with files of suppliers, of 1024 bytes at most."""
    key = F.col("s_suppkey")
    ending = F.when(key % 3 == 0, ".pdf").when(key % 3 == 1, ".PDF").otherwise(".txt")
    body = F.when(key % 4 == 0, F.concat(F.repeat(F.lit(" "), 1020), F.lit("%PDF-"))).when(key % 5 == 0, F.col("s_name")).otherwise(F.concat(F.lit("%PDF-1.7 "), F.col("s_name")))
    files = table(spark, sf_dir, "supplier").select(key.alias("doc_id"), F.lit(1).alias("vol_idx"), F.concat(F.lit("f"), key.cast("string"), ending).alias("name"), F.lit(1).alias("page_no"), body.alias("body"))
    path = _folder(spark, "uploads")
    volumes.write_volume_files(files, path)
    return tables.uploads(spark, path, 1024).select("filename", "size_bytes", "code")


@register(", ranges as (select doc_id, page_count // 3 + 1 as a, page_count // 3 + 1 + page_count // 4 as z from counts where doc_id % 5 = 0) select r.doc_id, r.a as start_page, r.z as end_page, page_no, size from ranges r join pages p on p.doc_id = r.doc_id and page_no between a and z")
def d5_page_ranges(spark, sf_dir):
    """A range of every fifth document, from pages that are laid out by document and page."""
    path, third = _folder(spark, "pages"), F.expr("page_count div 3 + 1").cast("int")
    tables.lay_out(fx.pages(spark, sf_dir).select("doc_id", "page_no", "size"), path, 8)
    ranges = fx.counts(spark, sf_dir).where("doc_id % 5 = 0").select("doc_id", third.alias("start_page"), (third + F.expr("page_count div 4")).cast("int").alias("end_page"))
    return tables.page_ranges(spark, path, ranges)


@register(
    """select 'job' || s_suppkey as job_id, case when s_suppkey % 3 = 0 then 'completed' else 'queued' end as state, case when s_suppkey % 3 = 0 then cast(1 + s_nationkey as bigint) else 0 end as n_volumes,
        case when s_suppkey % 3 = 0 then 'job' || s_suppkey || '-' || (1 + s_nationkey) end as last_volume, s_suppkey % 3 = 0 as readable from supplier""",
    prelude=False,
)
def d12_status(spark, sf_dir):
    """Status of a job for every supplier: a third have files, a third broken ones, a third none."""
    key = F.col("s_suppkey")
    job = F.concat(F.lit("job"), key.cast("string"))
    each = F.transform(F.sequence(F.lit(1), F.col("s_nationkey") + 1), lambda v: F.struct(v.alias("vol_idx"), F.lit("PASS").alias("status"), (v * 10).cast("bigint").alias("size")))
    whole = F.to_json(F.struct(job.alias("job_id"), F.lit("completed").alias("state"), F.lit(1.0).alias("progress"), each.alias("volumes")))
    jobs = table(spark, sf_dir, "supplier")
    files = jobs.where(key % 3 < 2).select(key.alias("doc_id"), F.lit(1).alias("vol_idx"), F.concat(job, F.lit(".json")).alias("name"), F.lit(1).alias("page_no"), F.when(key % 3 == 0, whole).otherwise(F.substring(whole, 1, 30)).alias("body"))
    path = _folder(spark, "status")
    volumes.write_volume_files(files, path)
    found = tables.status(spark, path, jobs.select(job.alias("job_id")))
    return found.select("job_id", "state", F.size("volumes").alias("n_volumes"), F.try_element_at("volumes", F.lit(-1))["volume_id"].alias("last_volume"), "readable")


@register("select o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 0", prelude=False)
def d7_replaced(spark, sf_dir):
    """The current version of a table that was replaced once."""
    path = _folder(spark, "orders")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    tables.write_json(o, path)
    tables.write_json(o.where("o_orderkey % 2 = 0"), path)
    return versions.current(spark, path, "o_orderkey long, o_orderstatus string")


@register(
    """select source || '_Audit_Report_Volume_' || lpad((doc_id % 3 + 1)::varchar, 2, '0') || '.pdf' as name, sha256(string_agg(doc_id || ' ' || n_chars || chr(10), '' order by doc_id)) as content_sha256
    from documents group by source, doc_id % 3""",
    prelude=False,
)
def d8_volume_files(spark, sf_dir):
    """A file for every source and volume, three volumes a source."""
    d = table(spark, sf_dir, "documents")
    number = F.col("doc_id") % 3 + 1
    body = F.concat_ws(" ", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    pages = d.select(F.col("source").alias("doc_id"), number.alias("vol_idx"), scalars.volume_file_name(F.col("source"), number, F.lit(3)).alias("name"), F.col("doc_id").alias("page_no"), body.alias("body"))
    path = _folder(spark, "volumes")
    volumes.write_volume_files(pages, path)
    read = spark.read.text(path, wholetext=True)
    return read.select(F.col("_metadata.file_name").alias("name"), F.sha2("value", 256).alias("content_sha256"))


_RANGES = "select doc_id, 'size' as kind, start_page, end_page from sections where doc_id % 4 = 0 union all select doc_id, 'min', start_page, end_page from sections where doc_id % 8 = 0"


@register(f", wanted as ({_RANGES}) select w.*, cast(sum(case kind when 'size' then p.size else p.small end) as bigint) as value from wanted w join pages p on p.doc_id = w.doc_id and page_no between start_page and end_page group by all")
def s12_measured_once(spark, sf_dir):
    """Sizes of sections; a first call measures a part of the documents, the second the rest alone."""
    s, memo = fx.sections(spark, sf_dir), _folder(spark, "measures")
    pages = fx.pages(spark, sf_dir).select(F.col("doc_id").alias("_doc"), "page_no", F.col("size").alias("_size"), F.col("small").alias("_small"))
    of = lambda kind, rows: rows.select("doc_id", F.lit(kind).alias("kind"), F.col("start_page").cast("int").alias("start_page"), F.col("end_page").cast("int").alias("end_page"))
    wanted = of("size", s.where("doc_id % 4 = 0")).unionByName(of("min", s.where("doc_id % 8 = 0")))

    def measure(ranges):
        each = ranges.withColumn("page_no", F.explode(F.sequence("start_page", "end_page")))
        both = each.join(pages, (each["doc_id"] == pages["_doc"]) & (each["page_no"] == pages["page_no"]))
        return both.groupBy("doc_id", "kind", "start_page", "end_page").agg(F.sum(F.when(F.col("kind") == "size", F.col("_size")).otherwise(F.col("_small"))).alias("value"))

    intervals.measured_once(wanted.where("doc_id % 3 = 0"), memo, measure)
    return intervals.measured_once(wanted, memo, measure)


@register("select user_id as key, event_id % 4 as batch, count(*) as n, count(*) filter (event_type = 'error') as n_errors from events group by user_id, event_id % 4", prelude=False)
def j4_appended(spark, sf_dir):
    """A log of events in four batches, of which two come twice."""
    path = _folder(spark, "events")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_type", "event_id")
    write = streams.append_once(path)
    for n in (0, 1, 1, 2, 0, 3):
        write(e.where(F.col("event_id") % 4 == n), n)
    log = streams.appended(spark, path, "key long, event_type string, event_id long")
    return log.groupBy("key", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_errors"))


_IDLE = 36_000


@register(
    f"""with moments as (select user_id, ts, sum(case event_type when 'signup' then 1 when 'purchase' then -1 else 0 end) as d from events where event_id % 3 > 0 group by user_id, ts),
    states as (select user_id, ts, sum(d) over (partition by user_id order by ts) as active, coalesce(lead(ts) over (partition by user_id order by ts), (select max(ts) from events)) as until from moments)
    select cast(user_id as varchar) as key, epoch_us(ts) as last_access from states where active <= 0 and epoch_us(until) - epoch_us(ts) > {_IDLE * 1_000_000}""",
    prelude=False,
)
def j6_expirations(spark, sf_dir):
    """Jobs of users that expire after ten hours; a signup begins a task and a purchase ends one."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    what = F.when(F.col("event_type") == "signup", expiry.BEGIN).when(F.col("event_type") == "purchase", expiry.END).otherwise("use")
    now = tables.written(e.agg(F.max("ts").alias("now")), "now").first()["now"]
    uses = e.where("event_id % 3 > 0").select(F.col("user_id").cast("string").alias("key"), F.col("ts").alias("at"), what.alias("what"))
    return expiry.expirations(uses, _IDLE, F.lit(now)).select("key", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(last_access AS TIMESTAMP_NTZ))").alias("last_access"))
