"""Checks of produced volumes against their source: pages, coverage, protected sections, sizes, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page_differences(expected: DataFrame, produced: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(doc_id, pages, size_mismatches, text_mismatches): positional comparison of (doc_id, page_no, w, h, t)."""
    other = produced.select("doc_id", "page_no", F.col("w").alias("w2"), F.col("h").alias("h2"), F.col("t").alias("t2"))
    joined = expected.join(other, ["doc_id", "page_no"])
    size = (F.abs(F.col("w") - F.col("w2")) > tolerance) | (F.abs(F.col("h") - F.col("h2")) > tolerance)
    return joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(size).alias("size_mismatches"), F.count_if(~F.col("t").eqNullSafe(F.col("t2"))).alias("text_mismatches"))


def count_check(expected: DataFrame, produced: DataFrame) -> DataFrame:
    a = expected.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected"))
    b = produced.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"))
    return a.join(b, "doc_id", "full").select("doc_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("found", F.lit(0)).alias("found")).withColumn("ok", F.col("expected") == F.col("found"))


def protected_in_range(ranges: DataFrame, protected: DataFrame) -> DataFrame:
    """Per volume: protected sections that lie inside it, and those it cuts. Both are intervals of one document."""
    met = ranges.alias("r").join(protected.alias("p"), (F.col("r.doc_id") == F.col("p.doc_id")) & (F.col("p.start_page") <= F.col("r.end_page")) & (F.col("p.end_page") >= F.col("r.start_page")))
    inside = (F.col("p.start_page") >= F.col("r.start_page")) & (F.col("p.end_page") <= F.col("r.end_page"))
    return met.groupBy("r.doc_id", "r.vol_idx").agg(F.count_if(inside).alias("contained"), F.count_if(~inside).alias("split"))


def coverage(ranges: DataFrame, pages: DataFrame, protected: DataFrame) -> DataFrame:
    """Per document: pages that no volume has, that several have, whether volumes are in order, protected sections cut."""
    # how many volumes have a page changes only where one begins or ends, so those places are enough
    place = lambda at, d: F.struct(at.cast("long").alias("at"), F.lit(d).alias("d"))
    places = ranges.select("doc_id", F.explode(F.array(place(F.col("start_page"), 1), place(F.col("end_page") + 1, -1))).alias("p")).select("doc_id", "p.*")
    ends = pages.select("doc_id", F.explode(F.array(F.lit(1).cast("long"), F.col("page_count").cast("long") + 1)).alias("at"), F.lit(0).alias("d"), "page_count")
    line = Window.partitionBy("doc_id").orderBy("at")  # a sum takes all changes at a place; between those there are no pages
    parts = places.unionByName(ends, allowMissingColumns=True).select("doc_id", "at", F.sum("d").over(line).alias("n"), (F.lead("at").over(line) - F.col("at")).alias("long"), F.max("page_count").over(Window.partitionBy("doc_id")).alias("page_count"))
    inside = (F.col("at") >= 1) & (F.col("at") <= F.col("page_count"))
    counted = parts.groupBy("doc_id").agg(F.sum(F.when((F.col("n") == 0) & inside, F.col("long"))).alias("missing"), F.sum(F.when(F.col("n") > 1, F.col("long"))).alias("duplicated"))
    order = Window.partitionBy("doc_id").orderBy("vol_idx")
    sorted_ = ranges.withColumn("b", F.lag("end_page").over(order)).groupBy("doc_id").agg(F.coalesce(F.bool_and(F.col("b").isNull() | (F.col("start_page") >= F.col("b"))), F.lit(True)).alias("in_order"))
    cover = protected.select("doc_id", F.col("start_page").alias("s"), F.col("end_page").alias("e")).join(ranges, "doc_id").where("s <= end_page and e >= start_page")
    whole = (F.col("s") >= F.col("start_page")) & (F.col("e") <= F.col("end_page"))
    torn = cover.groupBy("doc_id", "s", "e").agg(F.count(F.lit(1)).alias("n"), F.bool_and(whole).alias("inside")).where("n <> 1 or not inside").groupBy("doc_id").agg(F.count(F.lit(1)).alias("protected_split"))
    out = pages.select("doc_id")
    for part in (counted, sorted_, torn):
        out = out.join(part, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("missing", "duplicated", "protected_split")}
    return out.withColumns(zero).withColumn("in_order", F.coalesce("in_order", F.lit(True)))


def bookmark_check(outline: DataFrame, counts: DataFrame) -> DataFrame:
    """Whether an outline's destinations are all in range and as many as expected (doc_id, page_count, expected)."""
    found = outline.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), F.max("page").alias("last"), F.min("page").alias("first"))
    return counts.join(found, "doc_id", "left").select("doc_id", (F.coalesce("found", F.lit(0)) == F.col("expected")).alias("count_ok"), F.coalesce((F.col("last") <= F.col("page_count")) & (F.col("first") >= 1), F.lit(True)).alias("range_ok"))


def passed(checks: DataFrame) -> DataFrame:
    """A volume passes if all its checks of severity error do."""
    return checks.groupBy("doc_id", "vol_idx").agg(F.coalesce(F.bool_and(F.when(F.col("severity") == "error", F.col("ok"))), F.lit(True)).alias("passed"))


def size_severity(limit: Column) -> Column:
    return F.when(limit.isNull(), "info").otherwise("limit")


def check_mode(kind: Column) -> Column:
    return F.when(kind == "raster", "visual").when(kind == "ghostscript", "lenient").otherwise("strict")


def open_code(readable: Column, is_pdf: Column, locked: Column, password_given: Column, pages: Column) -> Column:
    """Why a document can't be used, or null."""
    return F.when(~is_pdf, "not_pdf").when(~readable, "corrupted").when(locked & password_given, "password_incorrect").when(locked, "password_required").when(pages < 1, "empty")


def volume_status(is_passed: Column, size: Column, limit: Column) -> Column:
    return F.when(~is_passed, "FAIL").when(size > limit, "OVER_LIMIT").otherwise("PASS")


def summarize(volumes: DataFrame) -> DataFrame:
    """Per job: bytes, counts, what is unresolved or failed, whether all is ready (vol_idx, size, status)."""
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("vol_idx"))))
    out = volumes.groupBy("doc_id").agg(F.sum(F.coalesce("size", F.lit(0))).alias("total_bytes"), F.count(F.lit(1)).alias("n_volumes"), of("OVER_LIMIT").alias("unresolved"), of("FAIL").alias("failed"))
    message = F.when(F.size("failed") > 0, "failed").when(F.size("unresolved") > 0, "unresolved").otherwise("ok")
    return out.withColumn("ready", (F.size("failed") == 0) & (F.size("unresolved") == 0)).withColumn("message", message)


def resolve(volumes: DataFrame, actions: DataFrame) -> DataFrame:
    """Apply accept or fail actions (doc_id, vol_idx, action, has_candidate) to volumes over the limit."""
    joined = volumes.join(actions, ["doc_id", "vol_idx"], "left")
    open_ = F.col("status").isin("OVER_LIMIT", "ACCEPTED_OVER_LIMIT") & F.col("action").isNotNull()
    new = F.when(open_ & F.coalesce("has_candidate", F.lit(False)), "ACCEPTED_OVER_LIMIT").when(open_, "FAIL").otherwise(F.col("status"))
    return joined.select("doc_id", "vol_idx", "size", new.alias("status"))


def progress(done: DataFrame) -> DataFrame:
    """Progress while volumes finish (doc_id, vol_idx, finished, pages): 0.05 + 0.75 of the share of pages, to three places."""
    document = Window.partitionBy("doc_id")
    upto = document.orderBy("finished", "vol_idx").rowsBetween(Window.unboundedPreceding, 0)
    share = F.lit(0.75) * F.sum("pages").over(upto) / F.greatest(F.sum("pages").over(document), F.lit(1))
    return done.select("doc_id", "vol_idx", three_places(F.lit(0.05) + share).alias("progress"))


def check_progress(checked: DataFrame) -> DataFrame:
    """Progress while volumes are checked (doc_id, vol_idx, finished): 0.8 + 0.18 of the share of volumes, to three places."""
    document = Window.partitionBy("doc_id")
    upto = document.orderBy("finished", "vol_idx").rowsBetween(Window.unboundedPreceding, 0)
    share = F.lit(0.18) * F.count(F.lit(1)).over(upto) / F.count(F.lit(1)).over(document)
    return checked.select("doc_id", "vol_idx", three_places(F.lit(0.8) + share).alias("progress"))


def three_places(value: Column) -> Column:
    """A share, held between 0 and 1, rounded to thousandths by what the double exactly is, halves to even.

    From 1/32 up a double is a whole number of 2**-57; below, its last bits can't change a thousandth but near zero ones.
    """
    scale = 1 << 57
    exact = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * float(scale)).cast("long").cast("decimal(20,0)") * F.lit(1000).cast("decimal(5,0)")
    whole = F.call_function("div", exact, F.lit(scale).cast("decimal(20,0)"))  # a long
    rest = exact - whole.cast("decimal(5,0)") * F.lit(scale).cast("decimal(20,0)")
    half = F.lit(scale // 2).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / 1000
