"""Streams with state of their own."""

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import stateful

SCHEMA = "graph_id string, kind string, entity_id string, node_id string, sec long"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, stateful.ROCKSDB)
    yield spark
    spark.conf.set(key, was) if was else spark.conf.unset(key)


def add(spark, path, *rows):
    spark.createDataFrame([("g", "K", *r) for r in rows], SCHEMA).withColumn("t", F.timestamp_seconds("sec")).coalesce(1).write.mode("append").parquet(path)


def test_entities_are_reused_across_batches_until_they_are_forgotten(rocksdb, tmp_path):
    spark, path, seen = rocksdb, str(tmp_path / "in"), set()

    def new():
        stream = spark.readStream.schema(SCHEMA + ", t timestamp").parquet(path)
        out = stateful.reuse_stream(stream, "t", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
        out.trigger(availableNow=True).start().awaitTermination()
        rows = {(r.entity_id, r.node_id, r.winner) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        got = rows - seen
        seen.update(rows)
        return got

    add(spark, path, ("a", "n10", 1000), ("a", "n2", 2000), ("b", "n3", 1500), (None, "n5", 1000))
    assert new() == {("a", "n10", "n2"), ("a", "n2", "n2"), ("b", "n3", "n3")}
    add(spark, path, ("a", "n1", 2500), ("c", "n9", 30000))  # the first one stays, whatever comes later
    assert new() == {("a", "n1", "n2"), ("c", "n9", "n9")}
    add(spark, path, ("a", "n0", 31000))  # the timer has dropped a
    assert new() == {("a", "n0", "n0")}


def test_entities_of_a_bucket_share_a_call_and_are_forgotten_one_by_one(rocksdb, tmp_path):
    spark, path = rocksdb, str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(SCHEMA + ", t timestamp").parquet(path)
        out = stateful.reuse_stream(stream, "t", "1 hour", buckets=2)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])

    # one group or two for 300 entities, not one for each
    add(spark, path, *((f"e{k}", f"n{i}{k:03}", 1000 + 10 * k) for k in range(300) for i in (2, 1)))
    assert run() <= 2
    assert {(r.entity_id, r.winner) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(f"e{k}", f"n1{k:03}") for k in range(300)}
    add(spark, path, ("x", "x", 1000 + 1000 + 3600 + 600))  # the watermark comes to 5600: e0 to e99 are forgotten
    run()
    add(spark, path, *((f"e{k}", "late", 9000) for k in (0, 50, 150, 299)))
    run()
    late = spark.read.parquet(str(tmp_path / "out")).where("node_id = 'late'").collect()
    assert {(r.entity_id, r.winner) for r in late} == {("e0", "late"), ("e50", "late"), ("e150", "n1150"), ("e299", "n1299")}


def test_late_rows_go_into_a_table_of_their_own(spark, tmp_path):
    path, got = str(tmp_path / "in"), {}

    def run():
        stream = spark.readStream.schema(SCHEMA + ", t timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        keep = lambda batch, number: got.setdefault(number, sorted(r.node_id for r in batch.collect()))
        out = stateful.split_late(stream, "t", "100 seconds", keep, str(tmp_path / "late"), str(tmp_path / "marks"))
        out.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    add(spark, path, ("a", "n1", 1000), ("a", "n2", 10))
    run()
    add(spark, path, ("a", "n3", 900), ("a", "n4", 899), ("a", "n5", 2000))
    run()
    add(spark, path, ("a", "n6", 950))
    run()
    assert got == {0: ["n1", "n2"], 1: ["n3", "n5"], 2: []}
    assert sorted((r.batch, r.node_id) for r in spark.read.parquet(str(tmp_path / "late")).collect()) == [(1, "n4"), (2, "n6")]


def test_sessions(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 600), ("a", 5000), ("b", 0)], "k string, sec long").withColumn("t", F.timestamp_seconds("sec"))
    got = [(r.k, r.n, r.session_start.timestamp(), r.session_end.timestamp()) for r in stateful.sessions(rows, "t", ["k"], "15 minutes").collect()]
    assert sorted(got) == [("a", 1, 5000, 5900), ("a", 2, 0, 1500), ("b", 1, 0, 900)]
