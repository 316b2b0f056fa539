"""Job logs and checkpointed stream ingestion."""

import base64
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallybook.operators import logs as lg
from tallybook.sources.packed_log import can_read, read_packed_log
from tallybook.streaming import transactions as tx

EVENTS = [
    {"Event": "SparkListenerApplicationStart", "App Name": "job", "App ID": "a1", "Timestamp": 1_000_000},
    {"Event": "SparkListenerEnvironmentUpdate", "Spark Properties": {"spark.app.name": "job", "spark.ui.port": "0", "spark.executor.memoryOverhead": "1g"}},
    *[{"Event": "SparkListenerJobEnd", "Job ID": i, "Completion Time": 2_000_000 - i, "Job Result": {"Result": "JobSucceeded"}} for i in range(12)],
    {"Event": "SparkListenerJobEnd", "Job ID": 99, "Completion Time": 1},
    {"Event": "SparkListenerStageCompleted", "Stage Info": {"Stage ID": 0, "Stage Name": "s", "Number of Tasks": 4, "Number of Complete Tasks": 4}},
    {"Event": "SparkListenerTaskEnd", "Task Info": {"Failed": False}, "Timestamp": 5},
    {"Event": "SparkListenerTaskEnd", "Task End Reason": {"Class": "java.lang.Exception"}, "Timestamp": 6},
    {"Timestamp": 7},
    {"Event": "SparkListenerApplicationEnd", "Timestamp": 1_083_500},
]


@pytest.fixture(scope="module", params=[lg.read_lines, lg.read_whole_files])
def log(request, spark, tmp_path_factory):
    """The lines split over a plain, two gzip and a zip file, two of them under other names, with one broken line."""
    folder = tmp_path_factory.mktemp("logs")
    lines = [json.dumps(e) for e in EVENTS] + ["{broken"]
    (folder / "a.log").write_text("\n".join(lines[:6]) + "\n")
    with gzip.open(folder / "b.gz", "wt") as stream:
        stream.write("\n".join(lines[6:9]) + "\n")
    with gzip.open(folder / "b.packed", "wt") as stream:
        stream.write("\n".join(lines[9:12]) + "\n")
    with zipfile.ZipFile(folder / "c.old", "w") as archive:
        archive.writestr("one.log", "\n".join(lines[12:15]) + "\r\n")
        archive.writestr("two.log", "\n".join(lines[15:]) + "\n")
    return lg.parse_log(request.param(spark, str(folder))).persist()


def test_counts(log):
    counts = {r.event: r.events for r in lg.event_counts(log).collect()}
    assert counts["SparkListenerJobEnd"] == 13 and counts["Unknown"] == 1 and sum(counts.values()) == len(EVENTS)


def test_application(log):
    app = lg.application(log).first()
    assert (app.name, app.id, app.duration_sec, app.duration_formatted) == ("job", "a1", 83.5, "1m 23.5s")
    assert app.start_time_formatted == "1970-01-01 00:16:40"


def test_details(log):
    assert {r.property for r in lg.config_props(log).collect()} == {"spark.app.name", "spark.executor.memoryOverhead"}
    jobs = lg.jobs(log).collect()
    assert len(jobs) == 10 and (jobs[0].id, jobs[0].result) == (99, "Unknown")
    assert tuple(lg.stages(log).first()) == (0, "s", 4, 4, 0)


def test_exceptions(log):
    assert lg.exceptions(log, limit=None).count() == 2
    assert [r.at for r in lg.exceptions(log, strict=True).collect()] == [6]


def test_members_are_partitions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.bin", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.mkdir("folder")
        for n in range(12):
            archive.writestr(f"folder/{n % 11}.log", "".join(f"line {n} {k}\n" for k in range(300)))  # one name twice
    (tmp_path / "empty.zip").write_bytes(b"PK\x05\x06" + b"\0" * 18)
    (tmp_path / "nothing.log").write_bytes(b"")
    (tmp_path / "_SUCCESS").write_bytes(b"no")
    rows = read_packed_log(spark, str(tmp_path), batchLines="7")
    assert rows.where("error is not null").count() == 0
    assert sorted(r.line for r in rows.collect()) == sorted(f"line {n} {k}" for n in range(12) for k in range(300))
    assert rows.select("path", "member", F.spark_partition_id().alias("p")).distinct().count() == 12


def test_damaged_files_are_told(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("good.log", "one\ntwo\r\nthree")
        archive.writestr("bad.log", "spoiled\n" * 5)
    spoiled = (tmp_path / "a.zip").read_bytes().replace(b"spoiled\nspoiled", b"spoiled\nSPOILED", 1)
    (tmp_path / "a.zip").write_bytes(spoiled)
    (tmp_path / "cut.zip").write_bytes(spoiled[:60])
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b"x\n" * 50_000)[:-30])
    (tmp_path / "odd.log").write_bytes(b"\xff\xfe ok\n\n last")
    rows = read_packed_log(spark, str(tmp_path)).collect()
    wrong = {(r.path.rsplit("/", 1)[1], r.member): r.error.split(":")[0] for r in rows if r.error}
    assert wrong == {("a.zip", "bad.log"): "BadZipFile", ("cut.zip", None): "BadZipFile", ("cut.gz", None): "EOFError"}
    assert [r.line for r in rows if r.member == "good.log"] == ["one", "two", "three"]
    assert [r.line for r in rows if r.path.endswith("odd.log")] == ["\ufffd\ufffd ok", "", " last"]
    assert {r.line for r in lg.read_lines(spark, str(tmp_path)).collect()} >= {"one", "x"}


@pytest.mark.parametrize("size", [1, 3, 10, 64, 1000])
def test_ranges_of_a_plain_file(spark, tmp_path, size):
    lines = ["", "a", "bb" * 9, "", "é" * 7, "last without end"]
    (tmp_path / "p.log").write_bytes("\n".join(lines).encode())
    rows = read_packed_log(spark, f"file://{tmp_path}/p.log", rangeBytes=str(size))
    assert sorted(r.line for r in rows.collect()) == sorted(lines)


def test_no_files(spark, tmp_path):
    assert read_packed_log(spark, str(tmp_path)).count() == 0
    assert not can_read("viewfs://store/in") and can_read(str(tmp_path)) and can_read(f"file://{tmp_path}")


def test_file_format(spark, tmp_path):
    (tmp_path / "p").write_bytes(b"{}")
    with gzip.open(tmp_path / "g", "wb") as stream:
        stream.write(b"{}")
    with zipfile.ZipFile(tmp_path / "z", "w") as archive:
        archive.writestr("x", "{}")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: r.kind for r in files.select("path", lg.file_format(F.col("content")).alias("kind")).collect()}
    assert found == {"p": "plain", "g": "gzip", "z": "zip"}


def bodies():
    plain = json.dumps({"Step": 1, "Type": "PAYMENT", "Amount": 2.5, "NameOrig": "C1", "DateTimeNow": "2024-01-01T00:00:00"})
    padded = base64.b64encode((plain + " " * (1 - len(plain) % 3)).encode()).decode()
    while not padded.endswith("="):
        plain += " "
        padded = base64.b64encode(plain.encode()).decode()
    return [plain, padded, padded.rstrip("="), plain.replace("PAYMENT", "a=b"), "nonsense"]


def test_decode_and_parse(spark):
    rows = spark.createDataFrame([(i, bytearray(b.encode())) for i, b in enumerate(bodies())], "id int, body binary")
    got = {r.id: r.Type for r in tx.parse_events(tx.decode_events(rows), keep=("id",)).collect()}
    assert got == {0: "PAYMENT", 1: "PAYMENT", 2: None, 3: "a=b", 4: None}


def test_ingest_restart_adds_nothing(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events = spark.range(60).select(F.concat(F.lit('{"Step": '), F.col("id") % 4, F.lit(', "Type": "T"}')).cast("binary").alias("body"))
    events.repartition(6).write.parquet(source)
    for _ in range(2):
        tx.ingest(spark, source, out, state, max_files=2, files_per_batch=1).awaitTermination()
    assert spark.read.parquet(out).count() == 60
    events.limit(5).coalesce(1).write.mode("append").parquet(source)
    tx.ingest(spark, source, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 65


def test_synthetic_ranges(spark):
    made = tx.synthetic_transactions(spark.range(5000).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), "id", "ts")
    again = tx.synthetic_transactions(spark.range(5000).repartition(3).withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")), "id", "ts")
    assert made.exceptAll(again).count() == 0
    low = made.agg(F.min("Step"), F.max("Step"), F.min("Amount"), F.max("Amount"), F.countDistinct("Type"), F.avg("IsFraud"), F.min("OldBalanceOrig"), F.max("OldBalanceOrig")).first()
    assert (low[0], low[1], low[4]) == (1, 4, 5)
    assert 50 <= low[2] and low[3] <= 50000 and 0.03 < low[5] < 0.07 and 1 <= low[6] and low[7] <= 10**6
