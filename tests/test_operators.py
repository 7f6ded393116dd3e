import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import intervals, ladder, lifecycle, outline, partition, validate
from quire.sources import tables

UNITS = "doc_id long, unit_idx int, sec_idx int, start_page int, end_page int, size long, protected boolean, min_size long"


def units(spark, docs):
    return spark.createDataFrame([(d, i + 1, i + 1, i + 1, i + 1, s, True, None) for d, sizes in docs.items() for i, s in enumerate(sizes)], UNITS)


def groups(df):
    out = {}
    for r in sorted(df.select("doc_id", "unit_idx", "size", "vol_idx").collect(), key=lambda r: (r.doc_id, r.unit_idx)):
        out.setdefault(r.doc_id, {}).setdefault(r.vol_idx, []).append(r.size)
    return {d: list(v.values()) for d, v in out.items()}


def greedy(sizes, cap):
    out = []
    for s in sizes:
        if out and sum(out[-1]) + s <= cap and s <= cap and not (len(out[-1]) == 1 and out[-1][0] > cap):
            out[-1].append(s)
        else:
            out.append([s])
    return out


def test_greedy_examples(spark):
    docs = {1: [11, 4, 21, 3, 20, 2], 2: [7, 5, 1, 13, 12, 9, 4, 4], 3: [2, 40, 9], 4: [25, 25]}
    got = groups(partition.greedy(units(spark, docs), F.lit(25)))
    assert got == {d: greedy(s, 25) for d, s in docs.items()}
    assert got[1] == [[11, 4], [21, 3], [20, 2]] and got[3] == [[2], [40], [9]]


def splits(sizes, k):
    n = len(sizes)
    for cuts in itertools.combinations(range(1, n), k - 1):
        at = [0, *cuts, n]
        yield [sizes[a:b] for a, b in itertools.pairwise(at)]


@pytest.mark.parametrize("k", [2, 3, 4])
def test_balanced_against_brute_force(spark, k):
    rng = random.Random(k)
    docs = {d: [rng.randint(1, 40) for _ in range(rng.randint(3, 9))] for d in range(25)}
    u = units(spark, docs)
    caps = partition.min_cap(u, k)
    got, cap = groups(partition.balanced(u, caps, k)), {r.doc_id: r.cap for r in caps.collect()}
    for d, sizes in docs.items():
        wanted = min(k, len(sizes))
        least = min(c for c in {0, *(sum(sizes[a:b]) for a in range(len(sizes)) for b in range(a + 2, len(sizes) + 1))} if len(greedy(sizes, c)) <= k)
        assert cap[d] == least
        assert len(got[d]) == wanted and [s for g in got[d] for s in g] == sizes
        fair = [p for p in splits(sizes, wanted) if all(len(g) == 1 or sum(g) <= least for g in p)]
        cost = lambda p: sum(sum(g) ** 2 for g in p)
        assert cost(got[d]) == min(map(cost, fair or [got[d]]))


def test_min_cap_of_a_long_document(spark):
    # one unit as large as total / k leaves all runs as candidates: some 50 million pairs of units, over 2^24
    rng = random.Random(6)
    sizes = [rng.randint(1, 1 << 40) for _ in range(10_000)]
    sizes[5000] = sum(sizes)
    docs = {1: sizes, 2: [5, 1, 1], 3: [0, 0, 0], 4: [7]}
    k = 40

    def least(sizes):
        lo, hi = 0, sum(sizes)
        while lo < hi:
            mid = (lo + hi) // 2
            count, filled, closed = 0, 0, True
            for s in sizes:
                if s > mid or closed or filled + s > mid:
                    count, filled = count + 1, s
                else:
                    filled += s
                closed = s > mid
            lo, hi = (lo, mid) if count <= k else (mid + 1, hi)
        return hi

    assert {r.doc_id: r.cap for r in partition.min_cap(units(spark, docs), k).collect()} == {d: least(s) for d, s in docs.items()}
    assert partition.min_cap(units(spark, {1: [5, 6, 7]}), 1, F.lit(9)).first().cap == 9


def best_of(sizes, k, cap):
    """Brute force: the partition of least squares, the latest cuts first among equals."""
    fair = [p for p in splits(sizes, k) if all(len(g) == 1 or sum(g) <= cap for g in p)]
    return min(fair, key=lambda p: (sum(sum(g) ** 2 for g in p), [-len(sizes) + len(g) for g in reversed(p)]), default=None)


def least_cap(sizes, k, upper):
    return next((c for c in range(upper) if len(greedy(sizes, c)) <= k), upper)


def test_plans(spark):
    exact = {1: [4, 2, 4, 2, 15, 2, 4, 2, 4, 2, 7, 8]}
    got = groups(partition.plan(units(spark, exact), "num_volumes", k=5))[1]
    assert len(got) == 5 and max(map(sum, got)) == 15
    assert len(groups(partition.plan(units(spark, {1: [7, 7, 7]}), "num_volumes", k=5))[1]) == 3
    both = groups(partition.plan(units(spark, {1: [12, 6, 13, 7, 9, 10, 8, 7, 11, 6], 2: [8] * 18}), "both", max_bytes=25, k=5))
    assert len(both[1]) == 5 and max(map(sum, both[1])) <= 25 and len(both[2]) == 5
    rng = random.Random(21)
    docs = {d: [rng.randint(1, 30) for _ in range(rng.randint(1, 9))] for d in range(30)}
    got = groups(partition.plan(units(spark, docs), "max_size", max_bytes=30))
    for d, sizes in docs.items():
        k = len(greedy(sizes, 30))
        want = best_of(sizes, k, least_cap(sizes, k, 30)) if 1 < k < len(sizes) else [[x] for x in sizes] if k >= len(sizes) else [sizes]
        assert sum(sum(g) ** 2 for g in got[d]) == sum(sum(g) ** 2 for g in want) and len(got[d]) == k


def best_by_loops(sizes, k, cap):
    """Sizes of the volumes of least squares, the latest cuts first among equals, by a plain loop over layers, ends and cuts."""
    before = [0, *itertools.accumulate(sizes)]
    n, ways, backs = len(sizes), {0: 0}, []
    for g in range(1, k + 1):
        now, back = {}, {}
        for end in range(g, n + 1):
            for cut in range(end - 1, -1, -1):
                if end - cut > 1 and before[end] - before[cut] > cap:
                    break
                if cut in ways and (end not in now or ways[cut] + (before[end] - before[cut]) ** 2 < now[end]):
                    now[end], back[end] = ways[cut] + (before[end] - before[cut]) ** 2, cut
        ways = now
        backs.append(back)
    ends = [n]
    for back in reversed(backs):
        ends.append(back[ends[-1]])
    return [sizes[a:b] for a, b in itertools.pairwise(reversed(ends))]


@pytest.mark.parametrize("table, cuts", [(4096, 1 << 24), (0, 0)])
def test_balanced_partition_of_a_document(monkeypatch, table, cuts):
    # no Spark: tables and halved layers, cuts kept and made again give the same
    monkeypatch.setattr(partition, "TABLE", table)
    monkeypatch.setattr(partition, "CUTS", cuts)
    rng = random.Random(11)
    for _ in range(300):
        n, largest = rng.randint(3, 25), rng.choice([2, 10, 1 << 40])
        sizes = [rng.randint(0, largest) for _ in range(n)]
        k = rng.randint(2, n - 1)
        upto = np.cumsum(sizes)
        least = partition._least_cap([0, *upto.tolist()], k)
        for cap in (least, int(upto[-1]), least + largest):
            starts = partition._least_squares(upto, partition._first(upto, cap), k).tolist()
            assert [sizes[a:b] for a, b in itertools.pairwise([*starts, n])] == best_by_loops(sizes, k, cap)


def test_large_documents_are_partitioned_exactly(spark):
    # units times volumes times the longest run are beyond 4,000,000 for each, where volumes were split from greedy ones
    rng = random.Random(12)
    loose, long = [rng.randint(1, 50) for _ in range(220)], [rng.randint(1, 50) for _ in range(1800)]
    caps = spark.createDataFrame([(1, sum(loose))], "doc_id long, cap long")
    assert groups(partition.balanced(units(spark, {1: loose}), caps, 110)) == {1: best_by_loops(loose, 110, sum(loose))}
    k = len(greedy(long, 300))
    assert groups(partition.plan(units(spark, {1: long, 2: [5, 6]}), "max_size", max_bytes=300)) == {1: best_by_loops(long, k, least_cap(long, k, 300)), 2: [[5, 6]]}
    most = sum(long) // 3 + 50
    assert len(greedy(long, most)) == 3
    limit = next(c for c in range(sum(long) // 3, most + 1) if len(greedy(long, c)) <= 3)
    assert groups(partition.plan(units(spark, {1: long}), "both", max_bytes=most, k=3)) == {1: best_by_loops(long, 3, limit)}


@pytest.mark.parametrize("mode, given", [("max_size", {"max_bytes": 30}), ("both", {"max_bytes": 30, "k": 3})])
def test_plans_join_no_union(spark, mode, given):
    # Spark joins a union of parts as if it had the parts of one side ("can't zip RDDs with unequal numbers of partitions")
    plan = partition.plan(units(spark, {1: [7, 20, 9]}), mode, **given)
    assert "Union" not in plan._jdf.queryExecution().toString()


def test_too_much_work_is_split(spark, monkeypatch):
    docs = {1: [9, 2, 2, 30, 4, 4, 6, 1], 2: [3, 3]}
    monkeypatch.setattr(partition, "WORK_LIMIT", 20)
    caps = spark.createDataFrame([(1, 12), (2, 6)], "doc_id long, cap long")
    assert {r.doc_id: r.exact for r in partition.work(units(spark, docs), caps, 6).collect()} == {1: False, 2: True}
    got = groups(partition.balanced(units(spark, docs), caps, 6))
    assert got == {1: split_by_hand(docs[1], 12, 6), 2: [[3], [3]]}


def split_by_hand(sizes, cap, k):
    spans = greedy(sizes, cap)
    while len(spans) < k and any(len(g) > 1 for g in spans):
        i = max((i for i, g in enumerate(spans) if len(g) > 1), key=lambda i: (sum(spans[i]), -i))
        g = spans[i]
        c = min(range(1, len(g)), key=lambda c: (abs(sum(g[:c]) - sum(g[c:])), c))
        spans = [*spans[:i], g[:c], g[c:], *spans[i + 1 :]]
    return spans


def test_split_to(spark):
    rng = random.Random(9)
    docs = {d: [rng.randint(0, 12) for _ in range(rng.randint(1, 14))] for d in range(40)}
    u = units(spark, docs)
    for k in (1, 4, 20):
        got = groups(u.join(partition.split_to(u, F.lit(25), k), ["doc_id", "unit_idx"]))
        assert got == {d: split_by_hand(s, 25, k) for d, s in docs.items()}


def test_starts_and_moves(spark):
    s = spark.createDataFrame([(1, p) for p in (1, 11, 21, 31, 41)], "doc_id long, start_page int")
    starts = spark.createDataFrame([(1, 1, 1), (1, 2, 21), (1, 3, 31)], "doc_id long, vol_idx int, start_page int")
    move = lambda v, step: {r.vol_idx: r.start_page for r in partition.moved_starts(starts, spark.createDataFrame([(1, v, step)], "doc_id long, vol_idx int, step int"), s).collect()}
    assert move(2, -1) == {1: 1, 2: 11, 3: 31} and move(3, 1) == {1: 1, 2: 21, 3: 41} and move(2, 1) == {1: 1, 2: 21, 3: 31} and move(1, 1)[1] == 1


def test_units_keep_totals(spark):
    s = spark.createDataFrame([(1, 1, 1, 3, False, 100, 30), (1, 2, 4, 9, True, 50, None), (1, 3, 10, 12, False, 2, None)], "doc_id long, sec_idx int, start_page int, end_page int, protected boolean, size_bytes long, min_size_bytes long")
    w = spark.createDataFrame([(1, p, p % 3 + 1) for p in range(1, 13)], "doc_id long, page_no int, weight int")
    rows = sorted(partition.build_units(s, w).collect(), key=lambda r: r.unit_idx)
    assert [r.size for r in rows] == [33, 50, 17, 50, 1, 1, 1]
    assert [r.min_size for r in rows[:4]] == [10, 15, 5, None]


def test_outline_levels_and_sections(spark):
    raw = spark.createDataFrame([(1, 1, 1, "A", 3), (1, 2, 3, " ", 5), (1, 3, 4, "C", 99), (1, 4, 1, "D", 8), (1, 5, 2, "E", 8)], "doc_id long, id int, level int, title string, page int")
    pages = spark.createDataFrame([(1, 10), (2, 4)], "doc_id long, page_count int")
    o = outline.normalize(raw, pages)
    rows = sorted(o.collect(), key=lambda r: r.id)
    assert [(r.level, r.parent, r.page) for r in rows] == [(1, None, 3), (2, 1, 5), (3, 2, None), (1, None, 8), (2, 4, 8)]
    assert rows[1].title == "(untitled bookmark 2)"
    s = sorted((r.doc_id, r.start_page, r.end_page, r.title, r.path) for r in intervals.sections_for_level(o, pages, 2).collect())
    assert [x[:3] for x in s] == [(1, 1, 2), (1, 3, 4), (1, 5, 7), (1, 8, 10), (2, 1, 4)]
    assert s[3][3:] == ("E", "D")


def test_deep_outline(spark):
    raw = spark.createDataFrame([(1, i, i, f"T{i}", i) for i in range(1, 31)] + [(1, 31, 2, "back", 31)], "doc_id long, id int, level int, title string, page int")
    o = outline.normalize(raw, spark.createDataFrame([(1, 40)], "doc_id long, page_count int"))
    assert {r.id: (r.level, r.parent) for r in o.collect()} == {1: (1, None), **{i: (i, i - 1) for i in range(2, 31)}, 31: (2, 1)}
    above = {(r.id, r.ancestor): r.distance for r in outline.ancestors(o).collect()}
    assert above == {**{(i, a): i - a for i in range(2, 31) for a in range(1, i)}, (31, 1): 1}
    tree = {r.id: r.children for r in outline.children(o).collect()}
    assert tree[None] == [1] and tree[1] == [2, 31] and tree[30] == []


def test_keywords(spark):
    rows = spark.createDataFrame([("Annex A",), ("annexé",), ("Éannex",), ("(Schedule)",), ("appendix_1",), ("Encl. 2",)], "t string")
    assert [r[0] for r in rows.select(outline.is_keyword(F.col("t"))).collect()] == [True, False, False, True, False, True]


def test_prediction(spark):
    kind = "doc_id long, vol_idx int, pos int, sample long, sample_plain long, full long"
    rows = [(1, 1, p, s, 100, 1000) for p, s in enumerate([90, 50, 80, None, 70, 60])] + [(2, 1, p, 90, 100, 1000) for p in range(6)] + [(3, 1, p, 90, 0, 1000) for p in range(3)] + [(4, 1, 0, 90, None, 1000)]
    got = {}
    for r in ladder.predicted(spark.createDataFrame(rows, kind), 400).collect():
        got.setdefault(r.doc_id, []).append(r.pos)
    assert {d: sorted(p) for d, p in got.items()} == {1: [1, 3, 4, 5], 2: [2, 3, 4, 5], 3: [0, 1, 2], 4: [0]}


def test_remap(spark):
    o = spark.createDataFrame([(1, 1, 1, 1, "P", 1, None), (1, 2, 2, 2, "a", 5, 1), (1, 3, 2, 2, "b", 12, 1), (1, 4, 3, 3, "c", 15, 3), (1, 5, 1, 1, "Q", 21, None)], "doc_id long, id int, raw_level int, level int, title string, page int, parent int")
    ranges = spark.createDataFrame([(1, 1, 10, 19), (1, 2, 20, 25)], "doc_id long, vol_idx int, start_page int, end_page int")
    got = [(r.vol_idx, r.level, r.title, r.page) for r in sorted(outline.remap(o, ranges).collect(), key=lambda r: (r.vol_idx, r.pos))]
    assert got == [(1, 1, "P (continued)", 3), (1, 2, "b", 3), (1, 3, "c", 6), (2, 1, "Q", 2)]


def test_gaps_and_coverage(spark):
    s = spark.createDataFrame([(1, "x", 3, 5, True), (1, "", 8, 10, True)], "doc_id long, title string, start_page int, end_page int, protected boolean").withColumn("path", F.lit("")).withColumn("source", F.lit("manual"))
    pages = spark.createDataFrame([(1, 12)], "doc_id long, page_count int")
    filled = sorted((r.start_page, r.end_page, r.source) for r in intervals.fill_gaps(s, pages).collect())
    assert filled == [(1, 2, "gap"), (3, 5, "manual"), (6, 7, "gap"), (8, 10, "manual"), (11, 12, "gap")]
    ten = spark.createDataFrame([(1, 10)], "doc_id long, page_count int")
    guard = spark.createDataFrame([(1, 5, 8)], "doc_id long, start_page int, end_page int")
    kind = "doc_id long, vol_idx int, start_page int, end_page int"
    check = lambda rows: validate.coverage(spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], kind), ten, guard).first()
    assert check([(1, 4), (5, 10)])[1:] == (0, 0, True, 0) or check([(1, 4), (5, 10)]).asDict() == {"doc_id": 1, "missing": 0, "duplicated": 0, "in_order": True, "protected_split": 0}
    assert check([(1, 6), (7, 10)]).protected_split == 1
    assert check([(1, 4), (6, 10)]).missing == 1
    assert check([(1, 5), (5, 10)]).duplicated == 1


def test_ladder_and_choice(spark):
    assert ladder.ladder(spark).count() == 14 and ladder.ladder(spark, mode="off").count() == 1 and ladder.ladder(spark, mode="lossless").count() == 2
    a = spark.createDataFrame([(1, 1, 0, "plain", 90), (1, 1, 1, "optimize", 70), (1, 1, 2, "images", 40), (1, 1, 3, "raster", 40), (1, 2, 0, "plain", None)], "doc_id long, vol_idx int, pos int, kind string, size long")
    one, two = sorted(ladder.choose(a, 50).collect(), key=lambda r: r.vol_idx)
    assert (one.chosen_pos, one.smallest_pos, one.lossless_pos, one.status) == (2, 2, 1, "achieved")
    assert two.status == "volume_failed"


def test_scalars(spark):
    df = spark.createDataFrame([(999_999,), (2_500_000,), (500,), (None,)], "n long")
    assert [r[0] for r in df.select(scalars.format_size(F.col("n"))).collect()] == ["1000 KB", "2.5 MB", "500 bytes", "-"]
    one = spark.range(1)
    assert one.select(scalars.even_sample(F.lit(1), F.lit(10), F.lit(5))).first()[0] == [1, 3, 5, 8, 10]
    assert one.select(scalars.short_list(F.array(*[F.lit(str(i)) for i in range(14)]))).first()[0].endswith("… (+2 more)")


def setting(bracket, x):
    return tuple(round(a + x * (b - a)) for a, b in zip(bracket[:2], bracket[2:], strict=True))


@pytest.mark.parametrize("parallel", [1, 4])
def test_fine_tuning_reaches_the_band_or_a_neighbour(spark, tmp_path, parallel):
    """Sizes that grow with the settings: at the end the size is in the band, or no setting of the line is left above it that fits."""
    target, rng = 3_000_000, random.Random(9)
    band = 200_000
    lines = {d: (rng.randint(60, 120), rng.randint(20, 50), rng.randint(130, 300), rng.randint(60, 95)) for d in range(12)}
    weight = {d: rng.uniform(0.7, 1.3) * target * 2 / (b[2] * b[3] + b[0] * b[1]) for d, b in lines.items()}
    size = lambda d, dpi, quality: int(weight[d] * dpi * quality)
    usable = [d for d, b in lines.items() if size(d, *b[:2]) <= target < size(d, *b[2:])]
    assert len(usable) > 5
    rows = [(d, 1, *lines[d], 0.0, size(d, *lines[d][:2]), 1.0, size(d, *lines[d][2:]) if d % 2 else None) for d in usable]
    start = spark.createDataFrame(rows, "doc_id long, vol_idx int, from_dpi int, from_quality int, to_dpi int, to_quality int, lo_x double, lo_size long, hi_x double, hi_size long")
    weights = F.create_map(*[F.lit(v) for d in usable for v in (d, weight[d])])
    turn = itertools.count()

    def written(df):
        path = str(tmp_path / str(next(turn)))
        df.write.parquet(path)
        return spark.read.parquet(path)

    measure = lambda p: p.withColumn("size", F.floor(weights[F.col("doc_id")] * F.col("dpi") * F.col("quality")))
    done = ladder.fine_tuned(start, measure, target, written, parallel).collect()
    assert {r.doc_id for r in done} == set(usable)
    for r in done:
        b = lines[r.doc_id]
        assert r.lo_size == size(r.doc_id, *setting(b, r.lo_x)) <= target
        if r.lo_size < target - band:
            between = {setting(b, r.lo_x + (r.hi_x - r.lo_x) * i / 1000) for i in range(1001)}
            assert between == {setting(b, r.lo_x), setting(b, r.hi_x)}


def test_narrowed_ignores_failures_and_empty_rounds(spark):
    kind = "doc_id long, vol_idx int, from_dpi int, from_quality int, to_dpi int, to_quality int, lo_x double, lo_size long, hi_x double, hi_size long"
    start = spark.createDataFrame([(d, 1, 100, 50, 200, 90, 0.0, 10, 1.0, None) for d in (1, 2, 3)], kind)
    measured = spark.createDataFrame([(1, 1, 0.2, 30), (1, 1, 0.4, 120), (1, 1, 0.6, 90), (1, 1, 0.8, 150), (2, 1, 0.5, None)], "doc_id long, vol_idx int, x double, size long")
    got = {r.doc_id: (r.lo_x, r.lo_size, r.hi_x, r.hi_size) for r in ladder.narrowed(start, measured, 100).collect()}
    assert got == {1: (0.6, 90, 0.8, 150), 2: (0.0, 10, 1.0, None), 3: (0.0, 10, 1.0, None)}


def test_events_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ok", "x"), ("a", "loud", "y"), ("b", None, None)], "key string, level string, msg string")
    path = str(tmp_path / "events")
    for _ in range(2):
        tables.append_events(lifecycle.events(rows, F.lit("2024-01-01").cast("timestamp")), path)
    got = sorted((r.key, r.level, r.msg or "") for r in spark.read.parquet(path).collect())
    assert got == sorted([("a", "ok", "x"), ("a", "error", "y"), ("b", "error", "")] * 2)


def test_outline_scan(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"doc_id": 4, "entries": [{"level": 1, "title": "A", "page": 1}, {"title": "B"}, {"level": 2, "title": "C", "page": 3}]}\n{"doc_id": 5, "entries": []}\n')
    got = [tuple(r) for r in tables.outlines(spark, str(tmp_path / "o.json")).orderBy("doc_id", "id").collect()]
    assert got == [(4, 1, 1, "A", 1), (4, 2, 1, "B", None), (4, 3, 2, "C", 3)]


def test_progress_and_totals(spark):
    done = spark.createDataFrame([(1, 1, 2, 3), (1, 2, 1, 5), (2, 1, 1, 7)], "doc_id long, vol_idx int, finished int, pages int")
    assert {(r.doc_id, r.vol_idx): r.progress for r in validate.progress(done).collect()} == {(1, 2): 0.519, (1, 1): 0.8, (2, 1): 0.8}
    assert {(r.doc_id, r.vol_idx): r.progress for r in validate.check_progress(done).collect()} == {(1, 2): 0.89, (1, 1): 0.98, (2, 1): 0.98}
    sections = spark.createDataFrame([(1, 1, 4, True, 10), (1, 5, 5, False, None)], "doc_id long, start_page int, end_page int, protected boolean, size_bytes long")
    assert [tuple(r) for r in lifecycle.totals(sections).collect()] == [(1, 2, 1, 5, 10)]


def test_progress_is_rounded_as_python_does(spark):
    """Every share of up to 120 pages: halves go by what the double is, not by how it is written."""
    rows = [(f"{n}-{k}", n, k) for n in range(1, 121) for k in range(n + 1)]
    frame = spark.createDataFrame(rows, "key string, n long, k long")
    own = frame.select("n", "k", validate.three_places(F.lit(0.05) + F.lit(0.75) * F.col("k") / F.col("n")).alias("a"), validate.three_places(F.lit(0.8) + F.lit(0.18) * F.col("k") / F.col("n")).alias("b")).collect()
    assert all(r.a == round(0.05 + 0.75 * r.k / r.n, 3) and r.b == round(0.8 + 0.18 * r.k / r.n, 3) for r in own)
    odd = spark.createDataFrame([(-1.0,), (2.0,), (0.0,), (1.0,), (0.0625,), (0.1875,)], "x double")
    assert [r.p for r in odd.select(validate.three_places(F.col("x")).alias("p")).collect()] == [0.0, 1.0, 0.0, 1.0, 0.062, 0.188]
