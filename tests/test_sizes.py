"""Findings of round 3: results and work at sizes where the tables of the other tests are too small."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import intervals, ladder, lifecycle, outline, partition, validate
from quire.plans import fixtures, queries


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_expiry_within_a_second(spark, kind):
    now = dt.datetime(2024, 1, 2, 12, 0, 0, 900_000)
    ago = lambda us: now - dt.timedelta(seconds=3600, microseconds=us)
    rows = [(1, ago(1), now), (2, ago(0), now), (3, ago(-1), now), (4, ago(950_000), now), (5, None, now)]
    seen = spark.createDataFrame(rows, f"key long, last_access {kind}, now {kind}")
    got = lifecycle.expired(seen, F.col("now"), 3600, spark.createDataFrame([(4,)], "key long"))
    assert [r.key for r in got.collect()] == [1]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_a_long_outline_is_never_gathered(spark):
    rng = random.Random(3)
    raw = [(1, i, rng.choice([None, -1, 0, 1, 2, 3, 7]), f"T{i}", i) for i in range(1, 5001)]
    open_, want = [], {}
    for _, i, given, _, _ in raw:
        deepest = open_[-1][0] + 1 if open_ else 1
        level = max(min(deepest if given is None else given, deepest), 1)
        open_ = [x for x in open_ if x[0] < level]
        want[i] = (level, open_[-1][1] if open_ else None, [x[1] for x in open_])
        open_.append((level, i))
    pages = spark.createDataFrame([(1, 5000)], "doc_id long, page_count int")
    o = outline.normalize(spark.createDataFrame(raw, "doc_id long, id int, level int, title string, page int"), pages)
    ranges = spark.createDataFrame([(1, 1, 1, 2500), (1, 2, 2501, 5000)], "doc_id long, vol_idx int, start_page int, end_page int")
    made = {"normalize": o, "ancestors": outline.ancestors(o), "remap": outline.remap(o, ranges)}
    assert not [name for name, df in made.items() if "collect_list" in plan_of(df)]
    assert {r.id: (r.level, r.parent) for r in o.collect()} == {i: w[:2] for i, w in want.items()}
    assert {(r.id, r.ancestor, r.distance) for r in made["ancestors"].collect()} == {(i, a, len(w[2]) - n) for i, w in want.items() for n, a in enumerate(w[2])}
    late = {a for i, w in want.items() if i > 2500 for a in w[2] if a <= 2500}
    assert {r.vol_idx: r.expected for r in outline.expected_count(made["remap"]).collect()} == {1: 2500, 2: 2500 + len(late)}


def test_sections_and_children_read_the_outline_once(spark):
    raw = spark.createDataFrame([(1, 1, 1, "A", 3), (1, 2, 2, "B", 5)], "doc_id long, id int, level int, title string, page int")
    pages = spark.createDataFrame([(1, 10), (2, 4)], "doc_id long, page_count int")
    o = outline.normalize(raw, pages)
    got = sorted((r.doc_id, r.start_page, r.end_page, r.title, r.path, r.source) for r in intervals.sections_for_level(o, pages, 1).collect())
    assert got == [(1, 1, 2, "Front pages (before the first bookmark)", "", "front-matter"), (1, 3, 10, "A", "", "bookmark"), (2, 1, 4, "Entire document (no usable bookmarks)", "", "whole-document")]
    assert "Union" not in plan_of(intervals.sections_for_level(o, pages, 1)) and "Join LeftAnti" not in plan_of(outline.children(o))


def test_ladders_and_probes_stay_in_their_rows(spark):
    rows = [(1, "automatic", 200, 210, 60, 90, True, True, True), (2, "off", 80, 300, 30, 90, True, True, True), (3, None, 200, 200, 50, 50, False, True, False)]
    settings = spark.createDataFrame(rows, "job_id long, mode string, min_dpi int, max_dpi int, min_quality int, max_quality int, grayscale boolean, raster boolean, ghostscript boolean")
    steps = ladder.ladders(settings, spark)
    got = {}
    for r in steps.collect():
        got.setdefault(r.job_id, []).append(r.pos)
    assert {j: sorted(p) for j, p in got.items()} == {1: [0, 1, 2, 3, 4, 5, 6, 7, 9, 11, 12], 2: [0], 3: [0, 1, 2, 7]}
    line = spark.createDataFrame([(1, 1, 100, 50, 102, 50, 0.0, 1000, 1.0, None)], "doc_id long, vol_idx int, from_dpi int, from_quality int, to_dpi int, to_quality int, lo_x double, lo_size long, hi_x double, hi_size long")
    probes = ladder.probes(line, 1500)
    assert [(round(r.x, 2), r.dpi, r.quality) for r in probes.collect()] == [(0.6, 101, 50)]
    assert "Exchange" not in plan_of(steps) and "Exchange" not in plan_of(probes)


def test_gaps_read_sections_once_and_no_page_has_a_row(spark, tmp_path):
    # customer 1: orders of 2, 1, 3 lines, one of them without a quantity; customer 2: one; an order of no lines, lines of no order
    spark.createDataFrame([(10, 1), (11, 1), (15, 1), (12, 2), (13, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(10, 1, 5.0), (10, 2, 6.0), (11, 1, None), (15, 3, 1.0), (15, 1, 2.0), (15, 1, 2.0), (12, 1, 9.0), (99, 1, 1.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    s, n = fixtures.sections(spark, str(tmp_path)), fixtures.counts(spark, str(tmp_path))
    paged = fixtures.pages(spark, str(tmp_path))
    for made, of in ((s, fixtures.sections(spark, "", paged)), (n, fixtures.counts(spark, "", paged))):
        assert made.dtypes == of.dtypes and sorted(made.collect()) == sorted(of.collect())
    filled = intervals.fill_gaps(s.where("sec_idx <> 2").withColumn("title", F.when(F.col("sec_idx") == 1, " ").otherwise(F.col("title"))), n)
    got = sorted((r.doc_id, r.start_page, r.end_page, r.title, r.protected, r.source) for r in filled.withColumn("source", F.coalesce("source", F.lit("own"))).collect())
    assert got == [(1, 1, 2, "Pages 1–2", True, "own"), (1, 3, 3, "Pages 3–3 (not in a defined section)", False, "gap"), (1, 4, 6, "Order 15", False, "own"), (2, 1, 1, "Pages 1–1", False, "own")]
    assert [tuple(r) for r in intervals.gap_warning(filled).collect()] == [(1, 1, "3–3")]
    # the lines are read for the sections and for the counts, and counted before they are joined
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2 and "l_linenumber ASC" not in plan


def test_volumes_and_coverage_deal_units_once(spark, tmp_path):
    rng, cap = random.Random(20), 30
    rows, want = [], {}
    for d in range(20):
        n, filled, vol, closed = rng.randint(1, 25), 0, 0, True
        for i in range(1, n + 1):
            size = rng.choice([1, 5, 9, 14, 31, 40])
            if size > cap or closed or filled + size > cap:
                vol, filled = vol + 1, 0
            filled, closed = filled + size, size > cap
            rows.append((d, i, (i + 2) // 3, i, i, size, i % 2 == 0, None))
            want.setdefault((d, vol), []).append(i)
    kind = "doc_id long, unit_idx int, sec_idx int, start_page int, end_page int, size long, protected boolean, min_size long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/units")
    v = partition.rollup(partition.greedy(spark.read.parquet(f"{tmp_path}/units"), F.lit(cap)))
    last = {d: max(i for x, i, *_ in rows if x == d) for d in range(20)}
    torn = lambda d, pages: any((i in pages) != (j in pages) for s in range(1, last[d] + 1, 3) for i in range(s, min(s + 3, last[d] + 1)) for j in range(s, min(s + 3, last[d] + 1)))
    assert {(r.doc_id, r.vol_idx): (r.start_page, r.end_page, r.any_partial) for r in v.collect()} == {k: (p[0], p[-1], torn(k[0], p)) for k, p in want.items()}
    ranges = v.select("doc_id", "vol_idx", "start_page", "end_page")
    plan = ranges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == plan.count("Exchange ") == 2 and "Join" not in plan
    # some volumes left out, some longer than they were
    kept = [(d, n, p[0], p[-1] + 2 * (n % 3 == 0)) for (d, n), p in want.items() if n % 4]
    guards = [(d, s, min(s + 2, last[d])) for d in range(20) for s in range(1, last[d] + 1, 6)]
    pages = spark.createDataFrame(list(last.items()), "doc_id long, page_count int")
    made = validate.coverage(spark.createDataFrame(kept, "doc_id long, vol_idx int, start_page int, end_page int"), pages, spark.createDataFrame(guards, "doc_id long, start_page int, end_page int"))

    def counted(d):
        own = [(s, e) for x, _, s, e in kept if x == d]
        times = [sum(s <= p <= e for s, e in own) for p in range(1, last[d] + 3)]
        met = [[(a, b) for a, b in own if a <= e and b >= s] for x, s, e in guards if x == d]
        bad = sum(bool(m) and (len(m) > 1 or not (m[0][0] <= g[1] and g[2] <= m[0][1])) for m, g in zip(met, [g for g in guards if g[0] == d], strict=True))
        return times[: last[d]].count(0), sum(t > 1 for t in times), all(b[0] >= a[1] for a, b in zip(own, own[1:])), bad

    assert {r.doc_id: (r.missing, r.duplicated, r.in_order, r.protected_split) for r in made.collect()} == {d: counted(d) for d in range(20)}


def test_gap_warning_counts_lines_before_it_joins_them(spark, tmp_path):
    # customer d has orders of 1 to 4 lines; every fourth section is left out
    orders = [(10 * d + i, d) for d in range(3) for i in range(1, 10)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, n, 1.0) for k, _ in orders for n in range(k % 4 + 1)], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = queries.QUERIES["s10_gap_warning"](spark, str(tmp_path))
    want = {}
    for d in range(3):
        at = 1
        for i, k in enumerate(sorted(k for k, c in orders if c == d), 1):
            if i % 4 == 0:
                want.setdefault(d, []).append(f"{at}–{at + k % 4}")
            at += k % 4 + 1
    assert {r.doc_id: (r.n_gaps, r.ranges) for r in made.collect()} == {d: (len(g), ", ".join(g)) for d, g in want.items()}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 2


def test_gap_warning_and_its_counts_share_one_shuffle(spark, tmp_path):
    # order 4 is listed twice for customer 1, order 6 for two customers, order 8 for none
    orders = [(1, 1), (2, 1), (3, 1), (4, 1), (4, 1), (5, 1), (6, 1), (6, 2), (7, 2), (8, None), (9, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, n, float(k)) for k in range(1, 10) for n in range(k % 3 + 1)], "l_orderkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    s = fixtures.sections(spark, str(tmp_path))
    paged = fixtures.pages(spark, str(tmp_path))
    of = fixtures.sections(spark, "", paged)
    assert s.dtypes == of.dtypes and sorted(map(str, s.collect())) == sorted(map(str, of.collect()))
    n = fixtures.lengths(s)
    assert n.dtypes == fixtures.counts(spark, "", paged).dtypes and sorted(map(str, n.collect())) == sorted(map(str, fixtures.counts(spark, "", paged).collect()))
    # the holes alone are those among the filled sections; a document none of whose sections is kept is one hole
    kept = s.where("doc_id = 1 and sec_idx % 4 <> 0")
    holes, filled = intervals.gaps(kept, n), intervals.fill_gaps(kept.withColumn("source", F.lit("own")), n)
    assert sorted(map(str, holes.collect())) == sorted(map(str, filled.where("source = 'gap'").select(*holes.columns).collect()))
    assert {r.doc_id: r.ranges for r in intervals.gap_warning(holes).collect()} == {1: "7–10", 2: "1–3", None: "1–4"}
    for name in ("s10_gap_warning", "s8_fill_gaps"):
        made = queries.QUERIES[name](spark, str(tmp_path))
        got = made.collect()
        final, initial = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")
        assert "ReusedExchange [doc_id" in final and not re.search(r"Aggregate\(keys=\[doc_id#\d+L?, o_orderkey", initial)
        if name == "s10_gap_warning":
            assert [tuple(r) for r in got] == [(1, 1, "7–10")] and "Order " not in initial
