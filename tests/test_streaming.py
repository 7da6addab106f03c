import uuid

from knotwork.streaming import events as ev

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def test_sessions_match_the_batch(spark, folder, tmp_path):
    table = spark.read.parquet(f"{folder}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in ev.sessions(table.withColumn("ts", table.ts.cast("timestamp")), "1 hour").collect()}
    name = f"s_{uuid.uuid4().hex}"
    stream = ev.sessions(ev.event_stream(spark, str(tmp_path / "in"), table.schema), "1 hour", watermark="0 seconds")
    ev.run_available(stream, name, str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.table(name).collect()}
    assert got <= batch and len(batch - got) < len(batch) * 0.1  # the last ones stay open behind the watermark


def test_tumbling_and_sliding(spark, folder):
    e = spark.read.parquet(f"{folder}/events.parquet")
    e = e.withColumn("ts", e.ts.cast("timestamp"))
    assert ev.tumbling(e).groupBy().sum("events").first()[0] == e.count()
    assert ev.tumbling(e, "1 hour", "30 minutes").groupBy().sum("events").first()[0] == 2 * e.count()


def test_keyed_state(spark, folder, tmp_path):
    table = spark.read.parquet(f"{folder}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    name = f"k_{uuid.uuid4().hex}"
    ev.run_available(ev.keyed_state(ev.event_stream(spark, str(tmp_path / "in"), table.schema)), name, str(tmp_path / "cp"), "update")
    want = {r.user_id: r["count"] for r in table.groupBy("user_id").count().collect()}
    assert {r.user_id: r.seen for r in spark.table(name).collect()} == want


def test_watch_collapses_a_burst(spark, tmp_path):
    changes = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "c")], "root string, path string")
    changes.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = ev.watch(spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in")), lambda dirty, n: seen.append(sorted(r.root for r in dirty.collect())), str(tmp_path / "cp"))
    q.awaitTermination()
    assert seen == [["r1", "r2"]]
