"""Streams give what batches give, once each, with late corrections."""

from datetime import datetime

from sitelode import streaming

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp, value double"


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def at(hour, minute=0):
    return datetime(2024, 1, 1, hour, minute)


def test_counts_follow_late_corrections(spark, tmp_path):
    source, table, checkpoint = (str(tmp_path / x) for x in ("events", "counts", "checkpoint"))
    first = [(1, 1, "view", at(1, 5), 1.0), (2, 2, "view", at(1, 30), 2.0), (3, 1, "click", at(2, 5), None), (4, 1, "view", None, 1.0)]
    late = [(5, 3, "view", at(1, 45), 4.0), (6, 3, "view", at(3, 0), 1.0)]
    write(spark, source, first)
    counts = lambda: streaming.hourly_counts(streaming.event_stream(spark, source, spark.read.parquet(source).schema))
    streaming.write_partitions(counts(), table, checkpoint).awaitTermination()
    got = {(r.hour, r.event_type): (r.events, r.value) for r in streaming.current(spark, table).collect()}
    assert got == {(at(1), "view"): (2, 3.0), (at(2), "click"): (1, None)}
    write(spark, source, late)
    streaming.write_partitions(counts(), table, checkpoint).awaitTermination()
    got = {(r.hour, r.event_type): (r.events, r.value) for r in streaming.current(spark, table).collect()}
    assert got == {(at(1), "view"): (3, 7.0), (at(2), "click"): (1, None), (at(3), "view"): (1, 1.0)}
    batch = streaming.hourly_counts(spark.read.parquet(source))
    assert {(r.hour, r.event_type): (r.events, r.value) for r in batch.collect()} == got


def test_no_table_before_the_first_batch(spark, tmp_path):
    assert streaming.current(spark, str(tmp_path / "none")) is None


def test_repeated_events_and_active_users(spark, tmp_path):
    source = str(tmp_path / "events")
    row = (1, 1, "view", at(1, 1), 1.0)
    write(spark, source, [row, row, (2, 2, "view", at(1, 2), 1.0)])
    stream = streaming.distinct_events(streaming.event_stream(spark, source, spark.read.parquet(source).schema))
    query = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("once").count() == 2
    users = streaming.active_users(spark.read.parquet(source)).collect()
    assert {r.users for r in users} == {2} and len(users) == 6
