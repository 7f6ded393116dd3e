"""Sources and sinks against files: what is opened, what is left after a failure, what readers see meanwhile."""

import datetime as dt
import json
import os
import random
import threading

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quire.functions import scalars
from quire.operators import intervals
from quire.sources import tables, versions, volumes
from quire.streaming import events, expiry


def names(folder):
    return sorted(f for f in os.listdir(folder) if not f.endswith(".crc"))


@pytest.fixture
def inbox(tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for name, data in {"a.pdf": b"%PDF-1.7 x", "b.PDF": b"junk %PDF-", "c.txt": b"%PDF-", "d.pdf": b"", "e.pdf": b"no mark", "f.pdf": b"%PDF-" + b"x" * 500, "deep/g.pdf": b"\x02\x55\x04\x44\x62\xd0%PDF-1.7", "h.pdf": b" " * 1020 + b"%PDF-"}.items():
        (folder / name).write_bytes(data)
    return folder


CODES = {"a.pdf": None, "b.PDF": None, "c.txt": "suffix", "d.pdf": "empty", "e.pdf": "not_pdf", "f.pdf": "too_large", "g.pdf": None, "h.pdf": "too_large"}


def test_uploads(spark, inbox):
    found = tables.uploads(spark, str(inbox), max_bytes=400)
    assert {r.filename: r.code for r in found.collect()} == CODES
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan binaryFile" in line]
    opening = [line for line in scans if "content" in line]
    assert 0 < len(opening) < len(scans)
    assert all("LessThanOrEqual(length,400)" in line and "GreaterThan(length,0)" in line for line in opening)


def test_new_uploads_are_judged_once(spark, inbox, tmp_path):
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")

    def run():
        query = tables.new_uploads(spark, str(inbox), out, seen, max_bytes=400)
        query.awaitTermination()
        return sorted((r.filename, r.code or "") for r in spark.read.parquet(out).collect())

    first = sorted((n, c or "") for n, c in CODES.items() if n != "d.pdf")
    assert run() == first == run()
    (inbox / "new.pdf").write_bytes(b"%PDF-")
    assert run() == sorted([*first, ("new.pdf", "")])


def test_status_of_missing_and_broken_files(spark, tmp_path):
    (tmp_path / "j1.json").write_text(json.dumps({"job_id": "j1", "state": "running", "progress": 0.5, "volumes": [{"vol_idx": 1, "status": "PASS", "size": 7}]}, indent=1))
    (tmp_path / "j2.json").write_text('{"job_id": "j2", "state": "runn')
    (tmp_path / "other.json").write_text('{"job_id": "other", "state": "completed"}')
    jobs = spark.createDataFrame([("j1",), ("j2",), ("j3",)], "job_id string")
    got = {r.job_id: (r.state, r.progress, [tuple(v) for v in r.volumes], r.readable) for r in tables.status(spark, str(tmp_path), jobs).collect()}
    assert got == {"j1": ("running", 0.5, [("j1-1", 1, "PASS", 7)], True), "j2": ("queued", 0.0, [], False), "j3": ("queued", 0.0, [], False)}
    empty = tmp_path / "none"
    empty.mkdir()
    assert [r.state for r in tables.status(spark, str(empty), jobs).collect()] == ["queued"] * 3


def test_replacing_a_table(spark, tmp_path):
    """A reader that looks again and again while versions are written sees whole versions only, and never none."""
    path, kind = str(tmp_path / "t"), "n long"
    assert versions.current(spark, path, kind).count() == 0
    make = lambda n: spark.range(n, n + 200).select(F.lit(n).cast("long").alias("n"))
    tables.write_json(make(0), path)
    stop, seen = threading.Event(), []

    def look():
        while not stop.is_set():
            seen.append(sorted({(r.n, r["count"]) for r in versions.current(spark, path, kind).groupBy("n").count().collect()}))

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(1, 5):
        tables.write_json(make(n), path)
    stop.set()
    reader.join()
    assert seen and all(len(s) == 1 and s[0][1] == 200 for s in seen)
    assert len([x for x in names(path) if x.startswith("v-")]) == 3
    broken = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("n"))
    with pytest.raises(PySparkException):
        tables.write_json(broken, path)
    assert {r.n for r in versions.current(spark, path, kind).collect()} == {4}


def test_volume_files(spark, tmp_path):
    path = tmp_path / "volumes"
    path.mkdir()
    rows = [(d, v, p, f"page {p} of {d}") for d in range(4) for v in (1, 2) for p in range(v * 10, v * 10 + 5)]
    random.Random(1).shuffle(rows)
    pages = spark.createDataFrame(rows, "doc_id long, vol_idx int, page_no int, body string").repartition(3)
    named = pages.withColumn("name", scalars.volume_file_name(F.concat(F.lit("Client "), F.col("doc_id").cast("string")), F.col("vol_idx"), F.lit(2)))
    volumes.write_volume_files(named, str(path))
    assert names(path) == sorted(f"Client_{d}_Audit_Report_Volume_0{v}.pdf" for d in range(4) for v in (1, 2))
    assert (path / "Client_2_Audit_Report_Volume_02.pdf").read_text() == "".join(f"page {p} of 2\n" for p in range(20, 25))
    before = {n: (path / n).read_text() for n in names(path)}
    lost = named.withColumn("body", F.when((F.col("doc_id") == 3) & (F.col("page_no") == 24), F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))
    with pytest.raises(PySparkException):
        volumes.write_volume_files(lost, str(path))
    assert {n: (path / n).read_text() for n in names(path)} == before
    with pytest.raises(PySparkException):
        volumes.write_volume_files(named.withColumn("name", F.lit("../up")), str(path))
    assert {n: (path / n).read_text() for n in names(path)} == before


def test_page_ranges(spark, tmp_path):
    pages = spark.range(6000).select((F.col("id") % 60).alias("doc_id"), F.floor(F.col("id") / 60).cast("int").alias("page_no"), F.lit("x").alias("text"))
    tables.lay_out(pages, str(tmp_path), 12)
    ranges = spark.createDataFrame([(3, 10, 14), (3, 14, 15), (41, 99, 99)], "doc_id long, start_page int, end_page int")
    got = tables.page_ranges(spark, str(tmp_path), ranges)
    assert sorted((r.doc_id, r.start_page, r.page_no) for r in got.collect()) == sorted([(3, 10, p) for p in range(10, 15)] + [(3, 14, 14), (3, 14, 15), (41, 99, 99)])
    assert len(got.inputFiles()) <= 4 < len(spark.read.parquet(str(tmp_path / "pages")).inputFiles())
    assert tables.page_ranges(spark, str(tmp_path), ranges.limit(0)).count() == 0
    for missing in ((3, 98, 101), (77, 1, 1)):
        with pytest.raises(PySparkException, match="pages are missing"):
            tables.page_ranges(spark, str(tmp_path), spark.createDataFrame([missing], ranges.schema)).collect()


def test_measured_once(spark, tmp_path):
    counted = spark.sparkContext.accumulator(0)

    def measure(ranges):
        def value(frames):
            for f in frames:
                counted.add(len(f))
                yield f.assign(value=(f["end_page"] - f["start_page"] + 1) * 10)

        return ranges.mapInPandas(value, "doc_id long, kind string, start_page int, end_page int, value long")

    kind, memo = "doc_id long, kind string, start_page int, end_page int", str(tmp_path / "memo")
    wanted = [(1, "size", 1, 4), (1, "min", 1, 4), (2, "size", 3, 3), (2, "size", 3, 3)]
    ask = lambda rows: sorted(tuple(r) for r in intervals.measured_once(spark.createDataFrame(rows, kind), memo, measure).collect())
    first = ask(wanted)
    assert first == sorted((*w, (w[3] - w[2] + 1) * 10) for w in wanted) and counted.value == 3
    assert ask(wanted) == first and counted.value == 3
    assert len(ask([*wanted, (9, "size", 1, 1)])) == 5 and counted.value == 4
    assert spark.read.parquet(memo).count() == 4
    assert ask([]) == []


def test_a_batch_given_twice_is_there_once(spark, tmp_path):
    path, kind = str(tmp_path / "events"), "key string, t timestamp, level string, msg string"
    batch = lambda n: spark.createDataFrame([(f"k{n}", dt.datetime(2024, 1, 1), "ok", "x")] * 3, kind)
    write = events.append_once(path)
    for n in (0, 1, 1, 0, 2):
        write(batch(n), n)
    os.remove(f"{path}/batch=2/_SUCCESS")  # as if it had broken off
    write(batch(2), 2)
    got = events.appended(spark, path, kind)
    assert sorted((r.key, r.batch, r["count"]) for r in got.groupBy("key", "batch").count().collect()) == [("k0", 0, 3), ("k1", 1, 3), ("k2", 2, 3)]


def test_live_expiry_equals_the_batch_form(spark, tmp_path):
    """A replayed stream, in some batches, expires what the batch form does up to the last moment that the watermark passes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, start, ttl = random.Random(3), dt.datetime(2024, 1, 1), 600
    rows = []
    for k in range(25):
        at, open_ = start, 0
        for _ in range(rng.randint(1, 12)):
            at += dt.timedelta(seconds=rng.choice([1, 60, 599, 600, 601, 900, 4000]))
            what = rng.choice(["use", "use", expiry.BEGIN, expiry.END if open_ else "use"])
            open_ += {expiry.BEGIN: 1, expiry.END: -1}.get(what, 0)
            rows.append((f"job{k}", at, what))
    rows.sort(key=lambda r: r[1])
    last = start + dt.timedelta(days=2)
    rows.append(("clock", last, "use"))
    parts = tmp_path / "parts"
    for i in range(0, len(rows), 40):
        spark.createDataFrame(rows[i : i + 40], "key string, at timestamp, what string").coalesce(1).write.mode("append").parquet(str(parts))
    stream = spark.readStream.schema("key string, at timestamp, what string").option("maxFilesPerTrigger", 1).parquet(str(parts))
    query = expiry.live_expirations(stream, ttl).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.key, r.last_access) for r in spark.read.schema(expiry.EXPIRED).parquet(str(tmp_path / "out")).collect())
    all_ = spark.createDataFrame(rows, "key string, at timestamp, what string")
    want = sorted((r.key, r.last_access) for r in expiry.expirations(all_, ttl, F.lit(last)).collect())
    assert len(want) > 20 and got == want
