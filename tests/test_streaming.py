from orderloom.operators import succession
from orderloom.sources import event_log
from orderloom.streaming import incremental


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    got = run(spark, incremental.windowed_activity(stream), "w", "complete")
    want = incremental.windowed_activity(events)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    pairs = run(spark, incremental.successions(stream), "s").groupBy("a", "b").count()
    log = event_log.case_log(events, events.user_id)
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == {(r.a, r.b): r.n for r in succession.direct(log).collect()}


def test_sessions(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert incremental.sessions(events).agg({"n": "sum"}).first()[0] == events.count()
