"""Audit events through the data source, and line numbers of log files."""

from __future__ import annotations

import gzip
import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import audit
from sparkveil.schemas import AUDIT_EVENT
from sparkveil.sources import logs
from sparkveil.sources.datasource import AuditEvents, Reader

START = datetime(2024, 1, 1, 22, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("audit"))
    rows = []
    for i in range(400):
        context = None if i % 50 == 0 else {"user_id": f"u{i % 7}", "security_relevant": i % 3 == 0, "pii_types": None}
        rows.append(json.dumps({"id": str(i), "timestamp": (START + timedelta(hours=i)).isoformat(), "event_type": ["login", "view", "error"][i % 3], "severity": ["info", "error"][i % 2], "message": "é", "context": context, "metadata": {"k": "v"} if i % 2 else None}))
    events = spark.createDataFrame([(r,) for r in rows], "value string").select(F.from_json("value", AUDIT_EVENT).alias("e")).select("e.*")
    logs.write_events(events, path)
    return path


@pytest.fixture
def pushed(spark):
    spark.dataSource.register(AuditEvents)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark.read.format("audit_events")
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def plain(spark, folder):
    """The same rows by Spark's own reader."""
    e = spark.read.schema(AUDIT_EVENT).json(folder)
    return e.select("id", "timestamp", "event_type", "severity", "context.user_id", "context.security_relevant", "message")


def test_rows_equal_spark_own_reader(spark, folder, pushed):
    both = [plain(spark, folder), pushed.load(folder).select(*plain(spark, folder).columns)]
    a, b = ([tuple(r) for r in df.orderBy(F.col("id").cast("int")).collect()] for df in both)
    assert a == b and len(a) == 400


@pytest.mark.parametrize("where", [
    "timestamp >= '2024-01-05' AND timestamp < '2024-01-07'", "timestamp = '2024-01-03 04:00:00'", "timestamp <= '2024-01-02 00:00:00' AND severity = 'error'", "user_id IN ('u1', 'u2') AND event_type = 'view'",
    "user_id IS NULL", "security_relevant AND timestamp > '2024-01-10'", "message LIKE 'é%' AND timestamp IN (timestamp'2024-01-02 01:00:00', timestamp'2024-01-09 01:00:00')", "id <> '3'",
])
def test_filters(spark, folder, pushed, where):
    got, want = (sorted(map(tuple, df.where(where).select("id", "timestamp", "user_id").collect())) for df in (pushed.load(folder), plain(spark, folder)))
    assert got == want


def test_days_are_skipped_and_filters_are_in_the_scan(spark, folder, pushed):
    df = pushed.load(folder).where("timestamp >= '2024-01-05' AND timestamp < '2024-01-06' AND severity = 'error'")
    assert df.rdd.getNumPartitions() <= 8 < len(Reader(folder, AUDIT_EVENT).partitions())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")
    assert df.count() == 12


def test_audit_query_runs_on_the_source(spark, folder, pushed):
    q = audit.AuditQuery(user_id="u1", ascending=True, limit=5)
    got, want = (list(map(tuple, q.run(df).select("id").collect())) for df in (pushed.load(folder), plain(spark, folder)))
    assert got == want and len(got) == 5


def test_stream_takes_new_files_over_a_restart(spark, folder, pushed, tmp_path):
    path, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "c"))
    spark.read.text(folder).limit(30).coalesce(1).select("value").write.text(path)

    def run():
        live = spark.readStream.format("audit_events").load(path).select("id", "timestamp")
        q = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return spark.read.parquet(out).count()

    assert run() == 30
    with gzip.open(f"{path}/more.json.gz", "wt") as f:
        f.write(json.dumps({"id": "x", "timestamp": "2030-01-01T00:00:00Z"}) + "\nnot json\n[1]\n")
    assert run() == 31 and run() == 31


def test_empty_and_missing_folders(spark, pushed, tmp_path):
    assert pushed.load(str(tmp_path)).collect() == [] and pushed.load(str(tmp_path / "none")).collect() == []


def test_line_numbers_over_blocks_and_files(spark, tmp_path):
    """Files cut into many blocks, with blank lines and lines that don't parse; one is compressed."""
    rng, want = random.Random(2), []
    good = json.dumps({"id": "1", "timestamp": "2024-01-01T00:00:00Z"})
    for name in ("audit.log", "audit.log.1", "audit.log.2.gz", "audit.log.3"):
        lines = [rng.choice([good, "", f"not json {rng.random()}" * rng.randrange(1, 9)]) for _ in range(0 if name.endswith("3") else 700)]
        with (gzip.open if name.endswith("gz") else open)(tmp_path / name, "wt") as f:
            f.write("\n".join(lines))
        want += [(name, i, t[:100]) for i, t in enumerate(lines, 1) if t.startswith("not")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths = logs.log_paths(str(tmp_path / "audit.log"))
        blocks = logs.numbered_lines(spark, paths).sparkSession.read.text(paths).select("_metadata.file_block_start").distinct().count()
        got = [(r.file.rpartition("/")[2], r.line, r.preview) for r in logs.parse_errors(spark, paths).collect()]
        assert blocks > 5 and sorted(got) == sorted(want)
        assert logs.numbered_lines(spark, paths).groupBy("file").agg(F.max("line").alias("n"), F.count("*").alias("c")).where("n <> c").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_log_for_people_is_refused(spark, tmp_path):
    (tmp_path / "human.log").write_text("2024-01-01 00:00:00 [INFO] login x\n\n2024-01-01 00:00:01 [INFO] login y\n")
    with pytest.raises(ValueError, match="can't be queried"):
        logs.require_events(spark, str(tmp_path / "human.log"))
    (tmp_path / "mixed.log").write_text('not json\n{"id": "1"}\n')
    logs.require_events(spark, str(tmp_path / "mixed.log"))
