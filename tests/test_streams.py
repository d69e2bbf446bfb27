"""The shift machine and the notification sink against their batch twins."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from comuna.operators import activity
from comuna.streaming import shifts, sink

UTC = dt.timezone.utc
T0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
SCHEMA = "user_id long, shift_id string, at timestamp, kind string"


def plain_shifts(events, expiry):
    """One user's shifts by a loop."""
    open_, out = None, []
    for at, kind, shift in sorted((at, {"start": 0, "position": 1, "end": 2}[kind], shift) for _, shift, at, kind in events):
        if open_ and expiry is not None and (at - open_[2]).total_seconds() > expiry:
            out.append((open_[0], open_[1], open_[2] + dt.timedelta(seconds=expiry), "expired"))
            open_ = None
        if open_ and kind != 1:
            out.append((open_[0], open_[1], at, "end" if kind == 2 else "next start"))
            open_ = None
        open_ = (shift, at, at) if kind == 0 else open_ and (open_[0], open_[1], at)
    if open_ and expiry is not None:  # nothing came for long
        out.append((open_[0], open_[1], open_[2] + dt.timedelta(seconds=expiry), "expired"))
    return out


@pytest.mark.parametrize("expiry", [1200, None])
def test_shift_machine_on_shuffled_and_late_input(spark, tmp_path, expiry):
    rng = random.Random(7)
    events = []
    for user in range(6):
        at = T0
        for k in range(60):
            at += dt.timedelta(seconds=rng.choice([0, 1, 60, 599, 1200, 1201, 4000]), microseconds=rng.randrange(3))
            events.append((user, f"{user}-{k:02d}", at, rng.choice(["start", "position", "position", "end"])))
    events += [(None, "x", T0, "start"), (1, "y", None, "start"), (1, "z", T0, "pause")]
    frame = spark.createDataFrame(events, SCHEMA)
    want = sorted((u, *row) for u in range(6) for row in plain_shifts([e for e in events if e[0] == u and e[2] and e[3] != "pause"], expiry))
    batch = activity.shift_runs(frame, "user_id", "shift_id", "at", "kind", expiry, T0 + dt.timedelta(days=89))
    shown = lambda rows: sorted((r["user"], r["shift_id"], r["started_at"].replace(tzinfo=UTC), r["ended_at"].replace(tzinfo=UTC), r["reason"]) for r in rows)
    assert shown(batch.where("reason IS NOT NULL").collect()) == want
    # In the order of arrival events are up to an hour late, so neighbours are swapped across batches.
    late = sorted((e for e in events if e[2]), key=lambda e: e[2] + dt.timedelta(seconds=rng.randrange(3500)))
    late += [(99, "far", T0 + dt.timedelta(days=90), "start"), (99, "farther", T0 + dt.timedelta(days=91), "start")]
    source = tmp_path / "in"
    for i, start in enumerate(range(0, len(late), 80)):
        spark.createDataFrame(late[start : start + 80], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{source}/{i:02d}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{source}/*")
        name = f"shifts_{expiry}"
        found = shifts.shifts(stream, "user_id", "shift_id", "at", "kind", expiry, "1 hour")
        running = found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        running.awaitTermination()
        assert shown(spark.table(name).where("user < 99").collect()) == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_batch_run_twice_is_delivered_once(spark, tmp_path):
    people = spark.createDataFrame([(1, 1, "a", "both", True, "x@y"), (2, 2, "a", "email", True, None), (3, 3, "b", "panel", True, None), (4, None, "a", "both", True, "n"), (5, 5, "a", "both", False, "o")], "subscriber_id long, user_id long, zone string, channel string, active boolean, email string")
    schema = "broadcast_id long, zones array<string>, channel string, message string"
    first = spark.createDataFrame([(10, ["a", " a ", "", "b"], "all", None), (11, ["a"], "email", "ya sale"), (12, [], "all", "x"), (13, ["c"], None, "x")], schema)
    second = spark.createDataFrame([(20, ["b"], "", " ")], schema)
    write = sink.notification_sink(f"file://{tmp_path}/out", lambda: people)
    write(first, 0)
    once = sorted(map(tuple, sink.read_deliveries(spark, f"file://{tmp_path}/out").drop("batch").collect()), key=repr)
    write(second, 1)
    write(first, 0)
    write(second, 1)
    rows = sink.read_deliveries(spark, f"file://{tmp_path}/out")
    assert sorted(map(tuple, rows.where("batch = 0").drop("batch").collect()), key=repr) == once
    assert sorted((r["broadcast_id"], r["subscriber_id"], r["delivery"], r["message"]) for r in rows.collect()) == [
        (10, 1, "email", sink.MESSAGE), (10, 1, "panel", sink.MESSAGE), (10, 2, "email", sink.MESSAGE), (10, 3, "panel", sink.MESSAGE), (11, 1, "email", "ya sale"), (11, 2, "email", "ya sale"), (20, 3, "panel", sink.MESSAGE)]
    counts = {r["broadcast_id"]: (r["count"], r["attempted"], r["skipped"]) for r in spark.read.parquet(f"file://{tmp_path}/out/counts").collect()}
    assert counts == {10: (4, 1, 1), 11: (2, 1, 1), 20: (1, 0, 0)}


def test_sink_in_a_stream(spark, tmp_path):
    schema = "broadcast_id long, zones array<string>, channel string, message string"
    people = spark.createDataFrame([(1, 1, "a", "panel", True, None)], "subscriber_id long, user_id long, zone string, channel string, active boolean, email string")
    for i in range(3):
        spark.createDataFrame([(i, ["a"], "all", "x")], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream.writeStream.foreachBatch(sink.notification_sink(f"file://{tmp_path}/out", lambda: people)).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert sink.read_deliveries(spark, f"file://{tmp_path}/out").agg(F.count("*"), F.count_distinct("broadcast_id", "batch")).first()[:] == (3, 3)


def test_deliveries_are_counted_without_a_list_of_them(spark):
    asked = [(1, ["a", " a", " "], "all", " "), (2, ["a", "b"], "email", "x"), (3, ["c"], None, "y"), (4, [], "", "z"), (5, ["b"], "panel", None), (5, ["a"], "panel", "a")]
    people = [(i, None if i == 7 else i, "ab"[i % 2], ["both", "email", "panel", "all", None][i % 5], i % 6 > 0, [None, " ", "a@b.py"][i % 3]) for i in range(40)]
    broadcasts = spark.createDataFrame(asked, "broadcast_id long, zones array<string>, channel string, message string")
    subscribers = spark.createDataFrame(people, "subscriber_id long, user_id long, zone string, channel string, active boolean, email string")
    rows = sink.deliveries(broadcasts, subscribers)
    want = sink.email_counts(rows).join(rows.groupBy("broadcast_id").agg(F.min("message").alias("message")), "broadcast_id")
    found = sink.delivery_counts(broadcasts, subscribers)
    shown = lambda df: sorted(tuple(r) for r in df.select("broadcast_id", "count", "attempted", "skipped", "message").collect())
    assert shown(found) == shown(want) != []
    assert rows.count() == sum(r[1] for r in shown(found))


def test_fan_out_stands_by_place_and_event(spark, monkeypatch):
    monkeypatch.setattr(activity, "PAIRS", 500, raising=False)
    events = spark.range(120).select(F.col("id").alias("event_id"), (F.col("id") % 4).alias("zone"))
    people = spark.range(90).select(F.col("id").alias("subscriber"), (F.col("id") % 5).alias("zone"), F.element_at(F.array(F.lit("all"), F.lit("email"), F.lit("push")), (F.col("id") % 3 + 1).cast("int")).alias("channel"))
    found = activity.fan_out(events, people, "zone")
    rows = found.select("event_id", "subscriber", "delivery", "zone", F.spark_partition_id().alias("task")).collect()
    kinds = (("email", "push"), ("email",), ("push",))
    assert sorted(r[:3] for r in map(tuple, rows)) == sorted((e, s, d) for e in range(120) for s in range(90) if e % 4 == s % 5 for d in kinds[s % 3])
    runs = [(r["task"], r["event_id"]) for i, r in enumerate(rows) if not i or (r["task"], r["event_id"]) != (rows[i - 1]["task"], rows[i - 1]["event_id"])]
    zones = {(r["task"], r["zone"]) for r in rows}
    changes = sum(not i or (r["task"], r["zone"]) != (rows[i - 1]["task"], rows[i - 1]["zone"]) for i, r in enumerate(rows))
    assert len(runs) == len(set(runs)) == 120 and changes <= 2 * len(zones) and len({r["task"] for r in rows}) > 1
    none = activity.fan_out(events.where("zone > 9"), people, "zone")
    assert none.count() == 0 and activity.fan_out(spark.readStream.format("rate").load().select("value", F.col("value").alias("zone")), people, "zone").isStreaming
