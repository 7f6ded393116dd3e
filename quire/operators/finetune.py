"""Fine-tuning of chosen settings: the sharpest file inside a band below the limit, for all volumes at once.

A volume goes through three searches, each along a line from settings that fit to sharper ones:

1. both settings together, towards the least sharper attempt that was too big, or upwards where none was measured;
2. quality alone;
3. sharper settings for a share of the items.

``tuned`` works in rounds.  A round measures at most four probes of every volume that still looks (one join, as the caller
likes), and each volume's state, one row with its too big attempts, moves by what they gave.  Rounds are few, a state is
small whatever the volume's size, and volumes that are settled leave the frontier, so later rounds touch less and less.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ladder import AIMS, FINE_ROUNDS, LOSSLESS, size_band

SETTINGS = "struct<dpi:int,quality:int,alt_dpi:int,alt_quality:int,alt_share:int>"
OVER = "struct<dpi:int,quality:int,size:bigint>"
LINE = "struct<phase:int,from_dpi:int,from_quality:int,to_dpi:int,to_quality:int,lo_x:double,lo_size:bigint,hi_x:double,hi_size:bigint>"
STATE = f"struct<line:{LINE},left:int,target:bigint,best:struct<size:bigint,at:{SETTINGS}>,over:array<{OVER}>>"
#: Phases: not begun, the three searches, settled.
NEW, BOTH, QUALITY, SHARE, SETTLED = range(5)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _floor(s: Column) -> Column:
    return s["target"] - size_band(s["target"])


def _at(line: Column, x: Column) -> Column:
    """Settings at x of the way along a line."""
    number = lambda c: F.bround(line[f"from_{c}"] + x * (line[f"to_{c}"] - line[f"from_{c}"])).cast("int")
    share = F.least(F.lit(999), F.bround(1000 * x).cast("int"))
    none = F.lit(None).cast("int")
    mixed = F.struct(line["from_dpi"], line["from_quality"], F.when(share > 0, line["to_dpi"]), F.when(share > 0, line["to_quality"]), share).cast(SETTINGS)
    return F.when(line["phase"] == SHARE, mixed).otherwise(F.struct(number("dpi"), number("quality"), none, none, F.lit(0)).cast(SETTINGS))


def _probes(s: Column, parallel: int) -> Column:
    """(x, at) of what a volume's next round measures, sharpest first; none if its search is at an end."""
    line, band = s["line"], size_band(s["target"])
    lo, width = line["lo_x"], line["hi_x"] - line["lo_x"]
    aimed = F.array(*[lo + (s["target"] - band * f - line["lo_size"]) / F.nullif(line["hi_size"] - line["lo_size"], F.lit(0)) * width for f in AIMS[parallel]])
    even = F.array(*[lo + width * (i + 1) / (parallel + 1) for i in range(parallel)])
    points = F.when(line["hi_size"] > line["lo_size"], aimed).otherwise(even)
    pair = lambda x: F.struct(x.alias("x"), _at(line, x).alias("at"))
    inside = F.transform(F.sort_array(F.filter(points, lambda x: (x > lo) & (x < line["hi_x"])), asc=False), pair)
    ends = F.array(_at(line, lo), _at(line, line["hi_x"]))

    def new(ps: Column) -> Column:
        # of probes with equal settings the sharpest counts
        return F.filter(ps, lambda p, i: ~F.exists(ends, lambda e: e.eqNullSafe(p["at"])) & ~F.exists(F.slice(ps, F.lit(1), i), lambda q: q["at"].eqNullSafe(p["at"])))

    some = _let(inside, new)
    chosen = _let(some, lambda ps: F.when(F.size(ps) > 0, ps).otherwise(new(F.array(pair(lo + width / 2)))))
    looking = line["phase"].between(BOTH, SHARE) & (s["left"] > 0) & (s["best"]["size"] < _floor(s))
    return F.when(looking, chosen).otherwise(F.array().cast(f"array<struct<x:double,at:{SETTINGS}>>"))


def _lines(s: Column, max_dpi: int, max_quality: int) -> Column:
    """The lines of the searches behind the present one, each null where it has nothing to offer."""
    best, null = s["best"]["at"], F.lit(None)
    low = s["best"]["size"] < _floor(s)
    over = F.filter(s["over"], lambda o: (o["dpi"] >= best["dpi"]) & (o["quality"] >= best["quality"]) & ((o["dpi"] != best["dpi"]) | (o["quality"] != best["quality"])))

    def line(phase: int, dpi: Column, quality: Column, size: Column) -> Column:
        return F.struct(F.lit(phase), best["dpi"], best["quality"], dpi, quality, F.lit(0.0), s["best"]["size"], F.lit(1.0), size).cast(LINE)

    def of(over: Column) -> Column:
        both = F.array_min(over)
        up_dpi = F.least(F.greatest(F.floor(best["dpi"] * 1.5).cast("int"), best["dpi"]), F.lit(max_dpi))
        up_quality = F.least(best["quality"] + 25, F.lit(max_quality))
        same = F.array_min(F.filter(over, lambda o: o["dpi"] == best["dpi"]))
        small = F.array_min(F.transform(over, lambda o: F.struct(o["size"].alias("size"), o["dpi"].alias("dpi"), o["quality"].alias("quality"))))
        found = F.array(
            F.when(both.isNotNull(), line(BOTH, both["dpi"], both["quality"], both["size"])).when((up_dpi != best["dpi"]) | (up_quality != best["quality"]), line(BOTH, up_dpi, up_quality, null)),
            F.when(low & (best["quality"] < max_quality), F.when(same.isNotNull(), line(QUALITY, same["dpi"], same["quality"], same["size"])).otherwise(line(QUALITY, best["dpi"], F.lit(max_quality), null))),
            F.when(low & small.isNotNull(), line(SHARE, small["dpi"], small["quality"], small["size"])),
        )
        return F.filter(found, lambda x: x["phase"] > s["line"]["phase"])

    return _let(over, of)


def _with(s: Column, **new: Column) -> Column:
    names = ("line", "left", "target", "best", "over")
    return F.struct(*[new.get(n, s[n]) for n in names]).cast(STATE)


def _advanced(s: Column, parallel: int, max_dpi: int, max_quality: int) -> Column:
    """The state with the first search, from the present one on, that has something to measure."""
    done = F.struct(F.lit(SETTLED), *[F.lit(None)] * 8).cast(LINE)

    def step(s: Column, _: Column) -> Column:
        ended = (s["line"]["phase"] < SETTLED) & (F.size(_probes(s, parallel)) == 0)
        return F.when(ended, _with(s, line=F.coalesce(F.get(_lines(s, max_dpi, max_quality), F.lit(0)), done))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(SETTLED - 1)), s, step)


def _moved(s: Column, tried: Column) -> Column:
    """The state after a round: probes count from the sharpest down to the first that fits; failed ones (null size) move nothing."""

    def by(fit: Column) -> Column:
        over = F.filter(tried, lambda t: (t["size"] > s["target"]) & (fit["x"].isNull() | (t["x"] > fit["x"])))
        return _let(over, lambda over: using(fit, F.array_min(over), over))

    def using(fit: Column, hi: Column, over: Column) -> Column:
        line, best = s["line"], s["best"]
        moved = F.struct(
            *[line[c] for c in ("phase", "from_dpi", "from_quality", "to_dpi", "to_quality")],
            F.coalesce(fit["x"], line["lo_x"]),
            F.greatest(line["lo_size"], fit["size"]),
            F.coalesce(hi["x"], line["hi_x"]),
            F.when(hi["x"].isNotNull(), hi["size"]).otherwise(line["hi_size"]),
        ).cast(LINE)
        sharper = F.when(fit["size"] > best["size"], F.struct(fit["size"].alias("size"), fit["at"].alias("at"))).otherwise(best)
        plain = F.transform(F.filter(over, lambda t: t["at"]["alt_share"] == 0), lambda t: F.struct(t["at"]["dpi"], t["at"]["quality"], t["size"]).cast(OVER))
        return _with(s, line=moved, left=s["left"] - 1, best=sharper, over=F.concat(s["over"], plain))

    return _let(F.array_max(F.filter(tried, lambda t: t["size"] <= s["target"])), by)


def begin(attempts: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, vol_idx, s): states of chosen attempts (doc_id, vol_idx, pos, target) that leave room below their target.

    ``attempts`` is (doc_id, vol_idx, pos, kind, grayscale, dpi, quality, size); those of the chosen one's kind and
    colour that are over the target bound the search.  Lossless attempts have nothing to sharpen.
    """
    keys = ["doc_id", "vol_idx"]
    own = attempts.where(F.col("kind").isin("images", "raster") & ~F.col("kind").isin(*LOSSLESS))
    best = own.join(chosen, [*keys, "pos"]).where(F.col("size") < F.col("target") - size_band(F.col("target")))
    big = own.select(*keys, F.col("kind").alias("_kind"), F.col("grayscale").alias("_gray"), F.struct("dpi", "quality", "size").cast(OVER).alias("o"))
    same = [best[k] == big[k] for k in keys] + [F.col("kind") == F.col("_kind"), F.col("grayscale") == F.col("_gray"), F.col("o.size") > F.col("target")]
    joined = best.join(big, same, "left").groupBy(best["doc_id"], best["vol_idx"]).agg(F.first("target").alias("target"), F.first(F.struct("size", "dpi", "quality")).alias("b"), F.array_sort(F.collect_list("o")).alias("over"))
    none = F.lit(None)
    state = F.struct(F.struct(F.lit(NEW), *[none] * 8).cast(LINE), F.lit(FINE_ROUNDS), F.col("target"), F.struct(F.col("b.size"), F.struct("b.dpi", "b.quality", none, none, F.lit(0))), F.col("over"))
    return joined.select(*keys, state.cast(STATE).alias("s"))


def tuned(states: DataFrame, measure: Callable[[DataFrame], DataFrame], written: Callable[[DataFrame], DataFrame], *, parallel: int = 4, rounds: int = FINE_ROUNDS, max_dpi: int = 300, max_quality: int = 95) -> DataFrame:
    """(doc_id, vol_idx, size, dpi, quality, alt_dpi, alt_quality, alt_share, rounds) of every state: the best found and the rounds it took.

    ``measure`` adds ``size`` (null where it fails) to probes (doc_id, vol_idx, x, at); ``written`` cuts lineage, say by a
    written table.  Settings that a share of the items has are the ``alt`` ones, the share in thousandths.
    """
    keys = ["doc_id", "vol_idx"]
    settled: list[DataFrame] = []
    states = states.withColumn("s", _with(F.col("s"), left=F.lit(rounds)))
    for turn in range(rounds + 1):
        states = written(states.withColumn("s", _advanced(F.col("s"), parallel, max_dpi, max_quality)))
        settled.append(states.where(F.col("s.line.phase") == SETTLED))
        states = states.where(F.col("s.line.phase") < SETTLED)
        if turn == rounds or states.isEmpty():
            break
        probes = states.select(*keys, F.explode(_probes(F.col("s"), parallel)).alias("p")).select(*keys, "p.x", "p.at")
        tried = measure(probes).groupBy(*keys).agg(F.collect_list(F.struct("x", F.col("size").cast("bigint").alias("size"), "at")).alias("tried"))
        states = states.join(tried, keys).select(*keys, _moved(F.col("s"), F.col("tried")).alias("s"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.select(*keys, "s.best.size", "s.best.at.*", (F.lit(rounds) - F.col("s.left")).alias("rounds"))
