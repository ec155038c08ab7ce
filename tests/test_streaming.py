import pytest
from pyspark.sql import functions as F

from loomgrid.plans import events as E
from loomgrid.plans.registry import Tables
from loomgrid.streaming import bus as B

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events"))
    every = spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("event_id")
    n = every.count()
    for k in range(4):
        every.filter((F.col("event_id") >= k * n // 4) & (F.col("event_id") < (k + 1) * n // 4)).coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp_path, mode="append"):
    rows = []
    q = df.writeStream.foreachBatch(lambda b, _: rows.extend(b.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    return rows


def test_fan_out(spark, source, tmp_path):
    t = Tables(spark, FOLDER)
    rows = run(B.deliveries(source(), E.subscriptions(t), "event_type").select("event_id", "subscription"), tmp_path)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, E.fan_out(t).collect()))


def test_once(spark, source, tmp_path):
    t = Tables(spark, FOLDER)
    rows = run(B.once(B.deliveries(source(), E.subscriptions(t), "event_type")), tmp_path)
    assert sorted(r.subscription for r in rows) == ["s4", "s6"]


def test_snapshots(spark, source, tmp_path):
    rows = {r.start: (r.n, r.failed) for r in run(B.snapshots(source(), "1 day"), tmp_path, "complete")}
    assert {k.replace(tzinfo=None): v for k, v in rows.items()} == {r.start: (r.n, r.failed) for r in E.snapshots(Tables(spark, FOLDER)).collect()}


def test_latest_status(spark, source, tmp_path):
    rows = {r.user_id: (r.status, r.since) for r in run(B.latest_status(source(), "user_id", "event_type", "event_id"), tmp_path, "update")}
    assert rows == {r.user_id: (r.status, r.since) for r in E.lifecycle(Tables(spark, FOLDER)).collect()}


def test_sweep_and_progress(spark, source, tmp_path):
    rows = run(B.live_tasks(source(), "user_id", ttl_hours=24), tmp_path)
    assert rows and all(r.events > 0 for r in rows)
    last = {}
    for r in run(B.progress(source(), "user_id", 10), tmp_path / "p"):
        last[r.user_id] = max(r.progress, last.get(r.user_id, 0))
    n = {r.user_id: r["count"] for r in spark.read.parquet(f"{FOLDER}/events.parquet").groupBy("user_id").count().collect()}
    assert last == {k: min(100.0, 10.0 * v) for k, v in n.items()}


def test_handlers_are_isolated(spark, source, tmp_path):
    seen = []

    def bad(df):
        raise RuntimeError("no")

    subs = spark.createDataFrame([("a", "*", 0, False, True), ("b", "error", 1, False, True), ("c", "*", 2, False, False)], "subscription string, pattern string, priority int, once boolean, enabled boolean")
    q = B.publish(source(), subs, {"a": bad, "b": lambda df: seen.append(df.count())}, str(tmp_path / "c"), "0 seconds", "event_type")
    q.processAllAvailable()
    q.stop()
    assert sum(seen) == spark.read.parquet(f"{FOLDER}/events.parquet").filter("event_type = 'error'").count()


def test_once_is_spent(spark, source, tmp_path):
    seen, stats, failed = [], {}, []

    def fails_first(df):
        failed.append(1)
        if len(failed) == 1:
            raise RuntimeError("no")

    subs = spark.createDataFrame([("a", "*", 0, True, True), ("b", "*", 1, True, True)], "subscription string, pattern string, priority int, once boolean, enabled boolean")
    handlers = {"a": lambda df: seen.extend(r.event_id for r in df.collect()), "b": fails_first}
    for _ in range(2):
        q = B.publish(source(), subs, handlers, str(tmp_path / "c"), "0 seconds", "event_type", stats=stats)
        q.processAllAvailable()
        q.stop()
    first = spark.read.parquet(f"{FOLDER}/events.parquet").agg(F.min("event_id")).first()[0]
    assert len(seen) == 1 and seen[0] >= first and len(failed) == 2 and stats == {"handlers_called": 2, "errors": 1}
    q = B.publish(source(), subs, handlers, str(tmp_path / "d"), "0 seconds", "event_type")
    q.processAllAvailable()
    q.stop()
    assert len(seen) == 2
