"""Outline hierarchies: rows (doc_id, id, level, title, page, parent) in document order of ``id``.

All windows are partitioned by doc_id; a document's outline is a small part of it, so no partition is large.  Nothing
gathers an outline in a row: work grows with the entries, and with the ancestors where those are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that tell of an annexed part (a fixed list), matched as whole words of any script.
KEYWORDS = "annex(?:ure)?s?|appendi(?:x|ces)|schedules?|exhibits?|attachments?|enclosures?|encl"


def is_keyword(title: Column) -> Column:
    return F.lower(title).rlike(rf"(?U)\b({KEYWORDS})\b")


def _with_above(outline: DataFrame, depths: Column, order: list[str], carried: list[str]) -> DataFrame:
    """Rows of ``outline`` once for each of ``depths`` (down to their own level) with ``above``: the last entry before of that level.

    Levels are corrected, so what is above an entry at a level is the last entry before of that level.  A row at its
    own level (depth = level) has itself there.  ``above`` is a struct of the ``carried`` columns, null where there is none.
    """
    each = outline.select("*", F.explode(depths).alias("depth"))
    line = Window.partitionBy("doc_id", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("above", F.last(F.when(F.col("depth") == F.col("level"), F.struct(*carried)), ignorenulls=True).over(line))


def _every_above(outline: DataFrame, carried: list[str]) -> DataFrame:
    return _with_above(outline, F.sequence(F.lit(1), F.col("level").cast("int")), ["id"], carried)


def normalize(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Correct levels that jump, drop destinations outside the document, name blank titles, find parents.

    ``raw`` is (doc_id, id, level, title, page), ``pages`` is (doc_id, page_count).  A level may be one deeper than the
    corrected level before it.  So level less place is the least of given level less place up to there (zero before the
    first), a running minimum; the parent is the last entry before of one level less, to any depth.
    """
    order = Window.partitionBy("doc_id").orderBy("id", "level", "title", "page")
    placed = raw.withColumn("at", F.row_number().over(order)).withColumn("less", F.when(F.col("level").isNotNull(), F.greatest("level", F.lit(1)).cast("long") - F.col("at")))
    least = F.min("less").over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    fixed = placed.withColumnRenamed("level", "raw_level").withColumn("level", (F.col("at") + F.least(least, F.lit(0))).cast("int")).drop("less")
    rows = _with_above(fixed, F.array(F.col("level"), F.col("level") - 1), ["at"], ["id"]).where("depth < level").join(pages, "doc_id")
    return rows.select(
        "doc_id",
        "id",
        "raw_level",
        "level",
        F.when(F.trim(F.coalesce("title", F.lit(""))) == "", F.concat(F.lit("(untitled bookmark "), F.col("id").cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("page").between(1, F.col("page_count")), F.col("page")).alias("page"),
        F.col("above.id").alias("parent"),
    )


def warnings(outline: DataFrame) -> DataFrame:
    """Counts of invalid destinations and of corrected levels."""
    return outline.groupBy("doc_id").agg(F.count_if(F.col("page").isNull()).alias("invalid_pages"), F.count_if(F.col("raw_level") != F.col("level")).alias("corrected_levels"))


def level_stats(outline: DataFrame) -> DataFrame:
    """Per level: entries, valid ones, and valid ones with a keyword."""
    valid = F.col("page").isNotNull()
    return outline.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("count"), F.count_if(valid).alias("valid"), F.count_if(valid & is_keyword(F.col("title"))).alias("keyword_hits"))


def suggest_level(stats: DataFrame) -> DataFrame:
    """The level to cut at: most keywords among levels with two valid entries or more, the shallower on a tie; if no
    level has two keywords, the shallowest such level, or the shallowest with one."""
    usable, any_ = F.col("valid") >= 2, F.col("valid") >= 1
    best = F.max(F.when(usable, F.struct("keyword_hits", (-F.col("level")).alias("neg"))))
    picked = stats.groupBy("doc_id").agg(best.alias("best"), F.min(F.when(usable, F.col("level"))).alias("first"), F.min(F.when(any_, F.col("level"))).alias("any"))
    return picked.select("doc_id", F.coalesce(F.when(F.col("best.keyword_hits") >= 2, -F.col("best.neg")), "first", "any").alias("suggested_level"))


def ancestors(outline: DataFrame) -> DataFrame:
    """(doc_id, id, ancestor, distance): one row for every ancestor of every entry, to any depth.

    Levels are as ``normalize`` corrects them, so an entry has one ancestor at each level above its own.
    """
    every = _every_above(outline.select("doc_id", "id", "level"), ["id"]).where("depth < level")
    return every.select("doc_id", "id", F.col("above.id").alias("ancestor"), (F.col("level") - F.col("depth")).alias("distance"))


def expected_count(remapped: DataFrame) -> DataFrame:
    """(doc_id, vol_idx, expected): the number of outline entries that each page range is to have."""
    return remapped.groupBy("doc_id", "vol_idx").agg(F.count(F.lit(1)).alias("expected"))


def children(outline: DataFrame) -> DataFrame:
    """The tree as rows: (doc_id, id, n_children, children), the ids of an entry's children in order; id null holds the roots."""
    # an entry is given to its parent, and without a child to itself
    none = F.lit(None).cast(outline.schema["id"].dataType)
    given = F.array(F.struct(F.col("parent").alias("id"), F.col("id").alias("child")), F.struct(F.col("id").alias("id"), none.alias("child")))
    named = outline.select("doc_id", F.explode(given).alias("g")).groupBy("doc_id", F.col("g.id").alias("id")).agg(F.sort_array(F.collect_list("g.child")).alias("children"))
    return named.select("doc_id", "id", F.size("children").alias("n_children"), "children")


def paths(outline: DataFrame) -> DataFrame:
    """Titles of all ancestors, root first, joined."""
    titles = F.collect_list(F.when(F.col("depth") < F.col("level"), F.struct("depth", F.col("above.title").alias("title"))))
    chain = _every_above(outline.select("doc_id", "id", "level", "title"), ["title"]).groupBy("doc_id", "id").agg(F.sort_array(titles).alias("chain"))
    return chain.select("doc_id", "id", F.array_join(F.col("chain.title"), " › ").alias("path"))


def remap(outline: DataFrame, ranges: DataFrame) -> DataFrame:
    """The outline of each page range: (doc_id, vol_idx, pos, level, title, page).

    Entries with a page in range are renumbered.  Before each comes every ancestor that has not been given yet, on the
    page of that first descendant, with a suffix where the ancestor itself begins before the range.
    """
    r = ranges.select("doc_id", "vol_idx", F.col("start_page").alias("s"), F.col("end_page").alias("e"))
    above = _every_above(outline.select("doc_id", "id", "level", "title", "page"), ["id", "level", "title", "page"])
    met = above.where("page is not null").join(r, "doc_id").where("page between s and e")
    # an entry itself, and the ancestors that the range does not have of themselves
    own = F.col("depth") == F.col("level")
    wanted = met.withColumn("own", F.when(own, 1).otherwise(0)).where(own | ~F.coalesce(F.col("above.page").between(F.col("s"), F.col("e")), F.lit(False)))
    given = wanted.groupBy("doc_id", "vol_idx", F.col("above.id").alias("entry"), "own").agg(F.min(F.struct("id", "page", "s", "above")).alias("f"))
    title = F.when((F.col("own") == 0) & (F.col("f.above.page") < F.col("f.s")), F.concat("f.above.title", F.lit(" (continued)"))).otherwise(F.col("f.above.title"))
    rows = given.select("doc_id", "vol_idx", F.col("f.id").alias("at"), F.col("f.above.level").alias("level"), title.alias("title"), (F.col("f.page") - F.col("f.s") + 1).alias("page"), "own")
    order = Window.partitionBy("doc_id", "vol_idx").orderBy("at", "own", "level")
    return rows.select("doc_id", "vol_idx", F.row_number().over(order).alias("pos"), "level", "title", "page")
