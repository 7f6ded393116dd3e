"""Reading and writing: tables, uploads of binary files, JSON status, volumes, reports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.scalars import file_name, format_bytes_exact, format_size, has_magic, short_list
from quire.sources import versions

STATUS = "job_id string, state string, progress double, error string, volumes array<struct<vol_idx:int,status:string,size:long>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; an own one in local mode where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="quire-tables-")
    return _own_dirs[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uploads(spark: SparkSession, path: str, max_bytes: int = 1_000_000_000) -> DataFrame:
    """Files with a code of what is wrong with them, or null: suffix, size, mark at the beginning.

    The listing reads names and lengths only; files are opened where those pass, as both bounds reach the reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    # the reader passes over files of no bytes; their names are in the listing that the driver has made anyway
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    every = spark.createDataFrame([(f,) for f in files.inputFiles()], "file string").select(plain(F.url_decode("file")).alias("file"))
    sized = files.select(plain(F.col("path")).alias("path"), "length")
    listed = every.join(sized, F.col("file") == F.col("path"), "left").select(F.col("file").alias("path"), F.coalesce("length", F.lit(0)).alias("length"))
    return _judged(listed, _opened(spark.read, path, max_bytes), max_bytes)


def _opened(reader, path: str, max_bytes: int) -> DataFrame:
    files = reader.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    small = files.where((F.col("length") > 0) & (F.col("length") <= max_bytes))
    return small.select(F.regexp_replace("path", "^file:/+", "file:/").alias("_path"), has_magic(F.col("content")).alias("_marked"))


def _judged(listed: DataFrame, opened: DataFrame, max_bytes: int) -> DataFrame:
    name = file_name(F.col("path"))
    code = F.when(~F.lower(name).endswith(".pdf"), "suffix").when(F.col("length") > max_bytes, "too_large").when(F.col("length") == 0, "empty").when(~F.coalesce("_marked", F.lit(False)), "not_pdf")
    return listed.join(opened, F.col("path") == F.col("_path"), "left").select("path", name.alias("filename"), F.col("length").alias("size_bytes"), code.alias("code"))


BINARY = "path string, modificationTime timestamp, length long, content binary"


def new_uploads(spark: SparkSession, path: str, out: str, seen: str, max_bytes: int = 1_000_000_000):
    """A stream that judges the files that have come since it ran last and adds them to ``out``; ``seen`` remembers which.

    Give ``seen`` and ``out`` folders that are kept.  Files of no bytes never come to a stream.  Returns the query; it ends when all that is there is judged.
    """
    files = spark.readStream.schema(BINARY).format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = file_name(F.col("path"))
    openable = F.lower(name).endswith(".pdf") & (F.col("length") > 0) & (F.col("length") <= max_bytes)
    code = F.when(~F.lower(name).endswith(".pdf"), "suffix").when(F.col("length") > max_bytes, "too_large").when(openable & ~has_magic(F.col("content")), "not_pdf")
    judged = files.select("path", name.alias("filename"), F.col("length").alias("size_bytes"), code.alias("code"))
    return judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start()


def status(spark: SparkSession, path: str, jobs: DataFrame) -> DataFrame:
    """Public part of the status of jobs (job_id), from files ``path``/<job_id>.json, volumes with their ids.

    A job without a file, or whose file can't be read, is queued and has no volumes; ``readable`` tells them apart from
    jobs whose file says so.  Files of other jobs are left out.
    """
    raw = spark.read.schema(f"{STATUS}, _broken string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    found = raw.json(path).select("*", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("_job"))
    whole = found.where("_broken is null and job_id is not null").dropDuplicates(["_job"])
    joined = jobs.select(F.col("job_id").alias("wanted")).join(whole, F.col("wanted") == F.col("_job"), "left")
    ids = F.transform("volumes", lambda v: F.struct(F.concat_ws("-", "wanted", v["vol_idx"].cast("string")).alias("volume_id"), v["vol_idx"].alias("vol_idx"), v["status"].alias("status"), v["size"].alias("size")))
    none = F.array().cast("array<struct<volume_id:string,vol_idx:int,status:string,size:bigint>>")
    return joined.select(F.col("wanted").alias("job_id"), F.coalesce("state", F.lit("queued")).alias("state"), F.coalesce("progress", F.lit(0.0)).alias("progress"), "error", F.coalesce(ids, none).alias("volumes"), F.col("_job").isNotNull().alias("readable"))


def write_json(df: DataFrame, path: str) -> None:
    """Replace a table of JSON as a whole: readers by ``versions.current`` see the old or the new one at any time."""
    versions.replace(df, path, "json")


def append_events(events: DataFrame, path: str) -> None:
    """Add rows to the table of events; what is there is neither read nor rewritten."""
    events.write.mode("append").parquet(path)


def outlines(spark: SparkSession, path: str) -> DataFrame:
    """Outlines of JSON lines (doc_id, entries of level, title, page) as rows in order, ids from 1, for ``outline.normalize``.

    A document without entries has no rows; an entry without a level is of level 1.
    """
    raw = spark.read.schema("doc_id long, entries array<struct<level:int,title:string,page:int>>").json(path)
    each = raw.select("doc_id", F.posexplode("entries").alias("at", "e"))
    return each.select("doc_id", (F.col("at") + 1).alias("id"), F.coalesce("e.level", F.lit(1)).alias("level"), "e.title", "e.page")


def write_volumes(pages: DataFrame, path: str) -> None:
    """Pages with vol_idx, one folder a document and volume; a volume's rows meet before they are written."""
    pages.repartition("doc_id", "vol_idx").sortWithinPartitions("doc_id", "vol_idx", "page_no").write.mode("overwrite").partitionBy("doc_id", "vol_idx").parquet(path)


def lay_out(pages: DataFrame, path: str, files: int) -> None:
    """Pages in about so many files, each a range of (doc_id, page_no), with an index of what each has.

    The index has a row for each file and document in it: files, plus documents that end in the middle of one.
    """
    pages.repartitionByRange(files, "doc_id", "page_no").sortWithinPartitions("doc_id", "page_no").write.mode("overwrite").parquet(f"{path}/pages")
    kept = pages.sparkSession.read.parquet(f"{path}/pages").select("doc_id", "page_no", F.col("_metadata.file_path").alias("file"))
    kept.groupBy("file", "doc_id").agg(F.min("page_no").alias("first"), F.max("page_no").alias("last")).write.mode("overwrite").parquet(f"{path}/index")


def page_ranges(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """The pages of closed ranges (doc_id, start_page, end_page), from the files that have any of them; fails if one is missing.

    The names of those files come to the driver, which names them to the reader; each range's pages are counted.
    """
    index = spark.read.parquet(f"{path}/index")
    met = index.join(ranges, "doc_id").where("first <= end_page and last >= start_page")
    files = [r["file"] for r in met.select("file").distinct().collect()]
    schema = spark.read.parquet(f"{path}/pages").schema
    own = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    kept = ranges.withColumn("_range", F.struct("doc_id", "start_page", "end_page"))
    found = kept.withColumnRenamed("doc_id", "_doc").join(own, (F.col("_doc") == F.col("doc_id")) & F.col("page_no").between(F.col("start_page"), F.col("end_page")), "left")
    counted = found.withColumn("_n", F.count("page_no").over(Window.partitionBy("_range")))
    wrong = F.col("_n") != F.col("end_page") - F.col("start_page") + 1
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("pages are missing from "), F.col("_range").cast("string"))).cast("int")).otherwise(F.lit(1))
    return counted.withColumn("_ok", checked).where("_ok = 1").select("start_page", "end_page", *schema.names)


def page_range(pages: DataFrame, start: int, end: int) -> DataFrame:
    return pages.where(F.col("page_no").between(start, end))


def stale(results: DataFrame, archives: DataFrame) -> DataFrame:
    """Jobs (job_id, changed) whose archive (job_id, built) is missing or older."""
    return results.join(archives, "job_id", "left").where("built is null or built < changed").select("job_id")


def report(volumes: DataFrame, checks: DataFrame) -> DataFrame:
    """Lines of a job's text report, in order: its volumes, then failed checks."""
    lines = volumes.select("doc_id", F.lit(1).alias("part"), "vol_idx", F.format_string("Volume %d: pages %d-%d, %d bytes, %s", "vol_idx", "start_page", "end_page", "size", "status").alias("line"))
    failed = checks.where("not ok").groupBy("doc_id", "vol_idx").agg(F.sort_array(F.collect_list("name")).alias("names"))
    bad = failed.select("doc_id", F.lit(2).alias("part"), "vol_idx", F.concat(F.lit("Failed in volume "), F.col("vol_idx").cast("string"), F.lit(": "), short_list(F.col("names"))).alias("line"))
    return lines.unionByName(bad)


def report_totals(volumes: DataFrame, coverage: DataFrame) -> DataFrame:
    """The last lines of a job's report (doc_id, part, line): checks of the whole document, total size, verdict.

    ``volumes`` is (doc_id, vol_idx, size, status), ``coverage`` (doc_id, name, ok).
    """
    whole = coverage.groupBy("doc_id").agg(F.bool_and("ok").alias("covered"))
    sums = volumes.groupBy("doc_id").agg(F.sum(F.coalesce("size", F.lit(0))).alias("n"), F.count_if(~F.col("status").isin("PASS", "ACCEPTED_OVER_LIMIT")).alias("bad"))
    facts = sums.join(whole, "doc_id", "left")
    passed = (F.col("bad") == 0) & F.coalesce("covered", F.lit(True))
    mark = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    checks = coverage.select("doc_id", F.lit(3).alias("part"), F.concat(F.lit("["), mark(F.col("ok")), F.lit("] "), F.col("name")).alias("line"))
    total = facts.select("doc_id", F.lit(4).alias("part"), F.concat(F.lit("Final total size: "), format_size(F.col("n")), F.lit(" ("), format_bytes_exact(F.col("n")), F.lit(")")).alias("line"))
    verdict = facts.select("doc_id", F.lit(5).alias("part"), F.concat(F.lit("Overall: "), mark(passed)).alias("line"))
    return checks.unionByName(total).unionByName(verdict)
