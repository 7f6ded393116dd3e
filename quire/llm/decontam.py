"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations alone.

A window is ``width`` consecutive words of an item (a shorter item is one window).  To contain a window a document must
contain every token of it, so one token is prefix enough: the rarest.  The steps:

1. windows of all items, each once, with the items that have it;
2. its tokens are shingles of ``SHINGLE`` neighbouring words, ordered by how many windows have them;
3. document positions of a window's rarest token are candidates; where the window would begin and end there must be
   inside the document (the positional and length bounds);
4. candidates meet their document again and the window is compared there word by word, exactly.

The windows' table is broadcast only if it holds at most ``broadcast_bytes``, words and lists of items counted; beyond,
the joins shuffle.

Cases: a null or empty text has no words and is clean; repeated rows are judged alike, one result a row; an item without words has no window; empty tables give clean documents or no rows; other
columns are ignored by ``report``, and ``clean`` carries them along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import common as C

#: Words of a token: what is looked up is so many neighbouring words of a window, or all of a shorter one.
SHINGLE = 4
_UPPER = "".join(map(chr, range(65, 91)))
_OTHERS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words(text: Column) -> Column:
    """Words of a text: runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased.

    One translation lower-cases and blanks whatever separates words; cutting at blanks is much faster than a pattern.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHERS, _UPPER.lower() + " " * len(_OTHERS))
    return F.array_remove(F.split(plain, " "), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _token(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def windows_of(items: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, n, items): every window once."""
    listed = items.select(F.col(item_id).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(width - 1), F.lit(1)))
    cut = listed.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(width)))).alias("window"))
    return cut.groupBy("window").agg(F.size("window").alias("n"), F.array_sort(F.collect_set("item")).alias("items"))


def report(docs: DataFrame, items: DataFrame, *, width: int = 13, share: float = 0.05, broadcast_bytes: int = 48_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, for every row of ``docs``."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = matches(own, items, width=width, broadcast_bytes=broadcast_bytes)
    return verdicts(own, found, share)


def matches(docs: DataFrame, items: DataFrame, *, width: int, broadcast_bytes: int) -> DataFrame:
    """(doc_id, text_key, n_hit, item_list): what verified windows cover, for each document that has any."""
    items_type = windows_of(items, width).schema["items"].dataType
    windows = C.materialize(windows_of(items, width).withColumn("window_id", F.monotonically_increasing_id()), "benchmark-windows")
    size = windows.agg(F.sum(F.octet_length(F.to_json(F.struct("window", "items"))) + 64).alias("n")).first()["n"] or 0
    small = size <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)

    split = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    sizes = [r["q"] for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("q")).distinct().orderBy("q").collect()]  # SHINGLE numbers at most
    candidates = None
    for q in sizes:
        own = windows.where((F.col("n") == q) if q < SHINGLE else (F.col("n") >= q))
        spread = own.select("window_id", "n", "window", F.explode(F.sequence(F.lit(0), F.col("n") - q)).alias("offset"))
        tokens = spread.select("window_id", "n", "offset", _token([F.get("window", F.col("offset") + i) for i in range(q)]).alias("token"))
        rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
        rarest = tokens.join(hint(rarity), "token").groupBy("window_id", "n").agg(F.min(F.struct("times", "offset", "token")).alias("r"))
        prefix = C.materialize(rarest.select("window_id", "n", "r.offset", "r.token"), "benchmark-prefix")
        # split before the words are dealt out, or each word's row would carry the whole text
        shifted = F.arrays_zip(*[(F.col("w") if i == 0 else F.slice("w", F.lit(i + 1), F.size("w"))).alias(f"w{i}") for i in range(q)])
        zipped = split.select("doc_id", "text_key", F.posexplode(shifted).alias("at", "x"))
        positions = zipped.select("doc_id", "text_key", "at", _token([F.col(f"x.w{i}") for i in range(q)]).alias("token"))
        found = positions.join(hint(prefix), "token").where("at >= offset").select("doc_id", "text_key", (F.col("at") - F.col("offset")).alias("start"), "window_id", "n")
        candidates = found if candidates is None else candidates.unionByName(found)
    if candidates is None:
        return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.lit(0).cast("long").alias("n_hit"), F.array().cast(items_type).alias("item_list")).where(F.lit(False))
    with_words = candidates.join(hint(windows.select("window_id", "window", "items")), "window_id")
    listed = with_words.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "n", "window", "items")).alias("candidates"))
    listed = listed.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    joined = texts.join(listed, F.equal_null("doc_id", "_doc") & (F.col("text_key") == F.col("_key")))
    # an array of one binds the words: they are split once a document, not once a candidate
    whole = F.array(words(F.col("text")))
    held = F.flatten(F.transform(whole, lambda w: F.filter("candidates", lambda c: (c["start"] + c["n"] <= F.size(w)) & (F.slice(w, c["start"] + 1, c["n"]) == c["window"]))))
    kept = joined.select("doc_id", "text_key", F.explode(held).alias("h")).groupBy("doc_id", "text_key")
    spans = kept.agg(F.collect_set(F.struct("h.start", "h.n")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("h.items"))).alias("item_list"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda c: F.sequence(c["start"], c["start"] + c["n"] - 1))))
    return spans.select("doc_id", "text_key", F.size(covered).cast("long").alias("n_hit"), "item_list")


def verdicts(docs: DataFrame, found: DataFrame, share: float) -> DataFrame:
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_key"), count_words(F.col("text")).alias("n_words"))
    found = found.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"})
    both = counted.join(found, F.equal_null("doc_id", "_doc") & (F.col("text_key") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce(F.array_sort(F.transform("item_list", lambda i: i.cast("string"))), F.array().cast("array<string>"))
    return both.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * F.lit(round(1 / share)) >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, width: int = 13, share: float = 0.05, broadcast_bytes: int = 48_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = C.materialize(matches(own, items, width=width, broadcast_bytes=broadcast_bytes), "contaminated")
    bad = found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.col("n_hit").alias("_hit"))
    joined = docs.alias("d").join(
        bad.alias("b"),
        F.equal_null(F.col(f"d.{doc_id}").cast("long"), F.col("b._doc"))
        & (F.xxhash64(F.col(f"d.{text}")) == F.col("b._key"))
        & (F.col("b._hit") * F.lit(round(1 / share)) >= count_words(F.col(f"d.{text}"))),
        "left_anti",
    )
    return joined
