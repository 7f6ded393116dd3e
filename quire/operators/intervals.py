"""Sections as closed page intervals: derivation, gaps, overlaps, lookups, measures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.scalars import even_sample
from quire.operators.outline import paths

COLUMNS = ["doc_id", "title", "start_page", "end_page", "protected", "path", "source"]


def sections_for_level(outline: DataFrame, pages: DataFrame, level: int) -> DataFrame:
    """Sections that begin at the pages of entries down to ``level``; front matter before, the whole document if none.

    ``pages`` is (doc_id, page_count).  The deepest entries on a page name its section, several joined in order; the
    path is that of the first of them.
    """
    low = outline.where(F.col("level") <= level)
    chosen = low.where(F.col("page").isNotNull()).join(paths(low), ["doc_id", "id"])
    deepest = F.max("level").over(Window.partitionBy("doc_id", "page"))
    named = chosen.withColumn("deepest", deepest).where("level = deepest").groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("id", "title", "path"))).alias("e"))
    order = Window.partitionBy("doc_id").orderBy("page")
    starts = pages.join(named, "doc_id", "left").withColumn("next", F.lead("page").over(order) - 1).withColumn("before", F.lag("page").over(order))
    kind = pages.schema["page_count"].dataType
    section = lambda title, start, end, protected, path, source: F.struct(title.alias("title"), start.cast(kind).alias("start_page"), end.cast(kind).alias("end_page"), F.lit(protected).alias("protected"), path.alias("path"), F.lit(source).alias("source"))
    page, one, empty = F.col("page"), F.lit(1), F.lit("")
    whole = section(F.lit("Entire document (no usable bookmarks)"), one, F.col("page_count"), False, empty, "whole-document")
    front = section(F.lit("Front pages (before the first bookmark)"), one, page - 1, True, empty, "front-matter")
    own = section(F.array_join(F.col("e.title"), " / "), page, F.coalesce("next", "page_count"), True, F.get("e", 0)["path"], "bookmark")
    made = F.when(page.isNull(), F.array(whole)).when(F.col("before").isNull() & (page > 1), F.array(front, own)).otherwise(F.array(own))
    return starts.select("doc_id", F.explode(made).alias("s")).select("doc_id", "s.*")


def out_of_order(outline: DataFrame, level: int) -> DataFrame:
    """Documents whose chosen entries are not in page order."""
    order = Window.partitionBy("doc_id").orderBy("id")
    chosen = outline.where((F.col("level") <= level) & F.col("page").isNotNull()).withColumn("before", F.lag("page").over(order))
    return chosen.groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("page") < F.col("before")), F.lit(False)).alias("out_of_order"))


def violations(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, code, start_page, end_page): bad bounds, and overlaps with what comes before."""
    joined = sections.join(pages, "doc_id")
    bounds = joined.where("start_page > end_page or end_page > page_count or start_page < 1").select("doc_id", F.lit("bounds").alias("code"), "start_page", "end_page")
    before = Window.partitionBy("doc_id").orderBy("start_page", "end_page").rowsBetween(Window.unboundedPreceding, -1)
    overlaps = joined.withColumn("reached", F.max("end_page").over(before)).where("start_page <= reached").select("doc_id", F.lit("overlap").alias("code"), "start_page", "end_page")
    return bounds.unionByName(overlaps)


def fill_gaps(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections with blank titles named, and an unprotected section for every hole."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), _page_range(F.col("start_page"), F.col("end_page")))
    marks, gap = _marks(sections, pages), _gap()
    had = [c for c in sections.columns if c != "doc_id"]
    names = had + [c for c in gap if c not in had]
    kinds = {f.name: f.dataType for f in marks.schema}
    row = lambda values: F.struct(*[(values.get(c, F.lit(None)).cast(kinds[c]) if c in kinds else values.get(c, F.lit(None))).alias(c) for c in names])
    own = row({c: F.col(c) for c in had} | {"title": title})
    made = F.array_compact(F.array(F.when(F.expr(_HOLE), row(gap)), F.when(~F.col("_end"), own)))
    filled = marks.select("doc_id", F.explode(made).alias("r")).select("doc_id", "r.*")
    return filled.select(*sections.columns, *names[len(had) :])


def gaps(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """The sections alone that ``fill_gaps`` adds; nothing of the others but where they are is sorted."""
    return _marks(sections.select("doc_id", "start_page", "end_page"), pages).where(_HOLE).select("doc_id", *[v.alias(c) for c, v in _gap().items()])


_HOLE = "_from < start_page"


def _marks(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections and documents' ends with the first page after what comes before: a hole is made by what is after it."""
    order = Window.partitionBy("doc_id").orderBy("start_page")
    ends = pages.select("doc_id", (F.col("page_count") + 1).alias("start_page"), (F.col("page_count") + 1).alias("end_page"), F.lit(True).alias("_end"))
    return sections.withColumn("_end", F.lit(False)).unionByName(ends, allowMissingColumns=True).withColumn("_from", F.coalesce(F.lag("end_page").over(order), F.lit(0)) + 1)


def _gap() -> dict[str, Column]:
    s, e = F.col("_from"), F.col("start_page") - 1
    return {"title": F.concat(_page_range(s, e), F.lit(" (not in a defined section)")), "start_page": s, "end_page": e, "protected": F.lit(False), "path": F.lit(""), "source": F.lit("gap")}


def _page_range(first: Column, last: Column) -> Column:
    return F.concat(F.lit("Pages "), first.cast("string"), F.lit("–"), last.cast("string"))


def gap_warning(filled: DataFrame) -> DataFrame:
    gaps = filled.where("source = 'gap'").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_page", "end_page"))).alias("g"))
    shown = F.transform("g", lambda x: F.concat(x["start_page"].cast("string"), F.lit("–"), x["end_page"].cast("string")))
    return gaps.select("doc_id", F.size("g").alias("n_gaps"), F.array_join(shown, ", ").alias("ranges"))


def pages_in(sections: DataFrame, pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per page of each section, joined to (doc_id, page_no, ...) by equality instead of a range."""
    spread = sections.select("doc_id", *keep, F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    return spread.join(pages, ["doc_id", "page_no"])


def measure(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """size_bytes of each section, the sum over its pages (doc_id, page_no, size)."""
    return pages_in(sections, pages, ["start_page", "end_page"]).groupBy("doc_id", "start_page", "end_page").agg(F.sum("size").alias("size_bytes"))


def minimum_sizes(sections: DataFrame, pages: DataFrame, sample: int = 5) -> DataFrame:
    """Estimated least size: the mean reduced size of evenly spaced pages (doc_id, page_no, size, small) times all."""
    n = F.col("end_page") - F.col("start_page") + 1
    spread = sections.select("doc_id", "start_page", "end_page", F.explode(even_sample(F.col("start_page"), n, F.lit(sample))).alias("page_no"))
    mean = spread.join(pages.select("doc_id", "page_no", "small"), ["doc_id", "page_no"]).groupBy("doc_id", "start_page", "end_page").agg(F.avg("small").alias("mean"))
    both = measure(sections, pages).join(mean, ["doc_id", "start_page", "end_page"])
    return both.select("doc_id", "start_page", "end_page", "size_bytes", F.least("size_bytes", F.floor(F.col("mean") * n).cast("long")).alias("min_size_bytes"))


def page_weights(pages: DataFrame) -> DataFrame:
    """A page's weight: 200, its content and its images; what can't be read counts nothing."""
    return pages.select("doc_id", "page_no", (F.lit(200) + F.coalesce("content_bytes", F.lit(0)) + F.coalesce("image_bytes", F.lit(0))).alias("weight"))


def section_of_page(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """The first section that contains each page."""
    spread = sections.select("doc_id", "start_page", "title", F.explode(F.sequence("start_page", "end_page")).alias("page_no"))
    best = spread.groupBy("doc_id", "page_no").agg(F.min(F.struct("start_page", "title")).alias("s"))
    return pages.join(best, ["doc_id", "page_no"], "left").select("doc_id", "page_no", F.col("s.title").alias("section"))


MEASURED = "doc_id long, kind string, start_page int, end_page int, value long"


def measured_once(wanted: DataFrame, memo: str, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, kind, start_page, end_page, value) of wanted ranges, each measured once over all calls.

    ``memo`` is a folder that keeps what was measured; ``measure`` adds ``value`` to ranges, and is given those alone that
    no call before has measured, each once.  What it gives is added to the folder before it is used.
    """
    spark, keys = wanted.sparkSession, ["doc_id", "kind", "start_page", "end_page"]
    asked = wanted.select(*keys).distinct()
    try:
        known = spark.read.schema(MEASURED).parquet(memo)
    except AnalysisException:  # the first call
        known = spark.createDataFrame([], MEASURED)
    missing = asked.join(known, keys, "left_anti")
    if not missing.isEmpty():
        measure(missing).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in known.schema]).write.mode("append").parquet(memo)
        known = spark.read.schema(MEASURED).parquet(memo)
    # two calls at one time may both have measured a range
    return wanted.select(*keys).join(known.dropDuplicates(keys), keys)
