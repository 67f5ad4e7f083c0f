"""ST-1 sensor ingest and ST-2 reminders: stream = batch twin, restart."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from farmspark.functions import exprs as X
from farmspark.sources.tables import Tables
from farmspark.streaming import alerts as AL
from farmspark.streaming import reminders as RM
from farmspark.streaming import sensor_ingest as SI


def test_docs_to_readings_drops_malformed(spark):
    docs = spark.createDataFrame(
        [('{"waterLevelInside": 12.5, "waterTemp": 27, "tds": 300}', dt.datetime(2024, 1, 1, 6)),
         ('{"waterLevelInside": 11.0, "waterTemp": 26}', dt.datetime(2024, 1, 1, 12)),
         ('{"waterLevelInside": 11.0, "waterTe', dt.datetime(2024, 1, 1, 18))],
        "doc string, arrived_at timestamp_ntz")
    got = sorted(SI.docs_to_readings(docs).collect(), key=lambda r: r.Updated_at)
    assert [(r.Pond_ID, r.Water_Level, r.pH, r.WaterTemp, r.TDS) for r in got] == [
        (1, 12.5, None, 27.0, 300.0), (1, 11.0, None, 26.0, None)]


def test_sensor_stream_two_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    os.makedirs(src)

    def drop(name, lines):
        with open(os.path.join(src, name), "w") as f:
            f.write("\n".join(lines) + "\n")

    drop("a.json", [json.dumps({"waterLevelInside": 1.0, "waterTemp": 20.0, "tds": 5.0}), "{broken"])
    SI.start_ingest(spark, src, out, ck).awaitTermination()
    assert Tables.from_snapshot(spark, out).sensors_data.count() == 1
    drop("b.json", [json.dumps({"waterLevelInside": 2.0, "waterTemp": 21.0})])
    SI.start_ingest(spark, src, out, ck).awaitTermination()  # restart from the checkpoint
    rows = Tables.from_snapshot(spark, out).sensors_data.orderBy("Water_Level").collect()
    assert [(r.Water_Level, r.TDS) for r in rows] == [(1.0, 5.0), (2.0, None)]


def test_schedule_edges(spark):
    sched = spark.createDataFrame([(1, 1, 3600), (2, 1, 3600 + 900), (3, 1, 3600 + 901), (4, 1, 3599),
                                   (5, 2, 120)], "feeding_ID long, Pond_ID int, feeding_sec int")
    ticks = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1, 0),), (dt.datetime(2024, 1, 1, 23, 50),)],
                                  "tick_ts timestamp_ntz")
    got = sorted((r.tick_ts.hour, r.feeding_ID) for r in RM.due_events(sched, ticks).collect())
    # tick, tick+900 in; tick+901 and tick-1 out; 00:02 is not due at 23:50 (no wrap)
    assert got == [(1, 1), (1, 2)]


def _reminder_inputs(spark):
    sched = spark.createDataFrame([(7, 3, 600)], "feeding_ID long, Pond_ID int, feeding_sec int")
    ticks = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m),) for m in (0, 1, 2, 4)],
                                  "tick_ts timestamp_ntz")
    acks = spark.createDataFrame([(7, dt.datetime(2024, 1, 1, 0, 3, 10)), (9, dt.datetime(2024, 1, 1, 0, 0, 5))],
                                 "feeding_ID long, ack_ts timestamp_ntz")
    return RM.due_events(sched, ticks), acks


def test_reminder_batch_fires_after_ack(spark):
    dues, acks = _reminder_inputs(spark)
    got = sorted((r.reminder_time, r.message) for r in RM.reminder_batch(dues, acks).collect())
    # due, due, due, ack, due -> fires at 00:00 and 00:04
    assert got == [("00:00:00", "Feeding reminder: Pond 3 needs feeding at 00:10:00"),
                   ("00:04:00", "Feeding reminder: Pond 3 needs feeding at 00:10:00")]
    assert [r.reminder_time for r in RM.reminder_open(dues, acks).collect()] == ["00:04:00"]


def test_reminder_stream_matches_batch_across_restart(spark, tmp_path):
    dues, acks = _reminder_inputs(spark)
    ev = RM.stream_events(dues, acks)
    schema = ev.schema
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    first = ev.where(F.col("seq") < RM.to_ms(F.lit("2024-01-01 00:03:30").cast("timestamp_ntz")))
    second = ev.subtract(first)

    def run():
        s = spark.readStream.schema(schema).parquet(src)
        q = (RM.reminder_stream(s.where(F.col("kind") == RM.DUE),
                                s.where(F.col("kind") == RM.ACK)
                                .select("feeding_ID", X.ntz_from_millis("seq").alias("ack_ts")))
             .writeStream.format("parquet").option("checkpointLocation", ck)
             .trigger(availableNow=True).start(out))
        q.awaitTermination()

    first.coalesce(1).write.mode("append").parquet(src)
    run()
    assert [(r.feeding_ID, r.reminder_time) for r in RM.reminders_in_state(spark, ck).collect()] == []
    second.coalesce(1).write.mode("append").parquet(src)
    run()  # restart: the open reminder survives in the state store
    assert sorted(map(str, RM.reminders_in_state(spark, ck).collect())) == sorted(map(str, RM.reminder_open(dues, acks).collect()))
    got = sorted(r.reminder_time for r in spark.read.parquet(out).collect())
    assert got == ["00:00:00", "00:04:00"]


def test_threshold_alert_lines(spark):
    r = spark.createDataFrame([(1, 50.0, None, 20.0, 95.5), (2, 10.0, None, 25.0, 50.0), (3, None, None, 40.0, None)],
                              "Pond_ID int, Water_Level double, pH double, WaterTemp double, TDS double")
    got = {x.ref_id: x.body for x in AL.threshold_alerts(r).collect()}
    assert got == {1: "⚠️ Water level out of range: 50\n⚠️ Temperature out of range: 20\n"
                      "⚠️ TDS out of range: 95.5",
                   3: "⚠️ Temperature out of range: 40"}


@pytest.mark.parametrize("n", [1])
def test_dues_plan_is_equi_join(spark, n):
    from tests.plan_util import explain_text
    dues, _ = _reminder_inputs(spark)
    plan = explain_text(dues)
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_naive_time_helpers_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("2024-03-10 02:30:15.123",)], "x string").select(
            F.col("x").cast("timestamp_ntz").alias("t"))
        r = df.select(X.ntz_millis("t").alias("ms"), X.ntz_minute("t").alias("m"),
                      X.ntz_from_millis(X.ntz_millis("t")).alias("back")).first()
        assert r.ms == 1710037815123  # 2024-03-10T02:30:15.123 as naive UTC-less arithmetic
        assert r.m == dt.datetime(2024, 3, 10, 2, 30) and r.back == dt.datetime(2024, 3, 10, 2, 30, 15, 123000)
        dues, acks = _reminder_inputs(spark)
        got = sorted(x.reminder_time for x in RM.reminder_batch(dues, acks).collect())
        assert got == ["00:00:00", "00:04:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_every_ack_is_answered_and_one_without_id_rejected(spark):
    acks = spark.createDataFrame([(7, dt.datetime(2024, 1, 1, 0, 3, 10)), (9, dt.datetime(2024, 1, 1, 0, 4)),
                                  (None, dt.datetime(2024, 1, 1, 0, 5)), (0, dt.datetime(2024, 1, 1, 0, 6))],
                                 "feeding_ID long, ack_ts timestamp_ntz")
    got = [(r.feeding_ID, r.ack_ts, r.message) for r in RM.reminder_ack(acks).collect()]
    assert got == [(7, dt.datetime(2024, 1, 1, 0, 3, 10), "Reminder 7 acknowledged"),
                   (9, dt.datetime(2024, 1, 1, 0, 4), "Reminder 9 acknowledged")]
    assert {r.reason for r in RM.reminder_ack_rejects(acks).collect()} == {"feeding_ID is required"}
    assert RM.reminder_ack_rejects(acks).count() == 2


def test_state_function_reduces_chunks_and_matches_the_batch(spark, tmp_path):
    import random
    rnd = random.Random(5)
    day = dt.datetime(2024, 1, 1)
    dues = [(day + dt.timedelta(minutes=m), k, 3, 600, "00:10:00") for k in (1, 2) for m in rnd.sample(range(1440), 200)]
    acks = [(1 if i % 3 else 2, day + dt.timedelta(seconds=rnd.randrange(86_400))) for i in range(3000)]
    due_df = spark.createDataFrame(dues, "tick_ts timestamp_ntz, feeding_ID long, Pond_ID int, feeding_sec int, "
                                         "feeding_time string")
    ack_df = spark.createDataFrame(acks, "feeding_ID long, ack_ts timestamp_ntz")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ev = RM.stream_events(due_df, ack_df)
    ev.repartition(4).write.parquet(src)
    s = spark.readStream.schema(ev.schema).parquet(src)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        (RM.reminder_stream(s.where(F.col("kind") == RM.DUE),
                            s.where(F.col("kind") == RM.ACK).select("feeding_ID", X.ntz_from_millis("seq").alias("ack_ts")))
         .writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
         .trigger(availableNow=True).start(out).awaitTermination())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted((r.feeding_ID, r.tick_ts) for r in spark.read.parquet(out).collect())
    assert got == sorted((r.feeding_ID, r.tick_ts) for r in RM.reminder_batch(due_df, ack_df).collect())
    now = RM.reminders_in_state(spark, str(tmp_path / "ck"))
    assert sorted(map(str, now.collect())) == sorted(map(str, RM.reminder_open(due_df, ack_df).collect()))
    assert now.dtypes == RM.reminder_open(due_df, ack_df).dtypes


def test_open_reminders_equal_the_replay_after_each_restart(spark, tmp_path):
    import random
    rnd = random.Random(9)
    day = dt.datetime(2024, 1, 1)
    dues = [(day + dt.timedelta(minutes=m), k, 2 + k, 600, "00:10:00") for k in range(1, 6) for m in rnd.sample(range(600), 25)]
    acks = [(k, day + dt.timedelta(seconds=rnd.randrange(36_000))) for k in range(1, 7) for _ in range(12)]
    due_df = spark.createDataFrame(dues, "tick_ts timestamp_ntz, feeding_ID long, Pond_ID int, feeding_sec int, feeding_time string")
    ack_df = spark.createDataFrame(acks, "feeding_ID long, ack_ts timestamp_ntz")
    ev = RM.stream_events(due_df, ack_df).checkpoint()
    src, ck = str(tmp_path / "src"), str(tmp_path / "ck")
    for hour in range(0, 10, 2):
        start, stop = (F.lit(day + dt.timedelta(hours=h)).cast("timestamp_ntz") for h in (hour, hour + 2))
        (ev.where((F.col("seq") >= RM.to_ms(start)) & (F.col("seq") < RM.to_ms(stop))).coalesce(1).write.mode("append").parquet(src))
        s = spark.readStream.schema(ev.schema).parquet(src)
        (RM.reminder_stream(s.where(F.col("kind") == RM.DUE),
                            s.where(F.col("kind") == RM.ACK).select("feeding_ID", X.ntz_from_millis("seq").alias("ack_ts")))
         .writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True)
         .start(str(tmp_path / "out")).awaitTermination())
        want = RM.reminder_open(due_df.where(F.col("tick_ts") < stop), ack_df.where(F.col("ack_ts") < stop))
        assert sorted(map(str, RM.reminders_in_state(spark, ck).collect())) == sorted(map(str, want.collect())), hour


def test_dues_of_the_replay_are_made_by_many_tasks(spark, tables):
    """One schedule file and one partition of ticks made all dues in one task."""
    from farmspark.keys import streams_keys as K
    day = dt.datetime(2024, 1, 1)
    t = tables(feeding_schedule=[(k, 1 + k % 5, (k * 3540) % 86_400) for k in range(200)])
    t.raw = lambda name: spark.createDataFrame(
        [(i, i % 200, day + dt.timedelta(minutes=7 * i)) for i in range(500)], "event_id long, user_id long, ts timestamp_ntz").coalesce(1)
    t.spark = spark
    made = K._dues(t).select(F.spark_partition_id().alias("p"), "feeding_ID", "tick_ts").collect()
    want = RM.due_events(t.feeding_schedule, RM.minute_ticks(t.raw("events"))).collect()
    assert sorted((r.feeding_ID, r.tick_ts) for r in made) == sorted((r.feeding_ID, r.tick_ts) for r in want)
    assert len({r.p for r in made}) > spark.sparkContext.defaultParallelism // 2


def test_state_function_gives_bare_rows_of_arrays():
    """Its texts are built by Spark, not row by row for every key in Python."""
    import numpy as np
    import pandas as pd

    class State:
        exists, value = False, None

        def update(self, value):
            self.exists, self.value = True, value

        def remove(self):
            self.exists, self.value = False, None

    # a due, another in the second chunk, an ack after it, a due that fires again
    chunks = [pd.DataFrame({"seq": [60_000], "k": [0], "Pond_ID": [3.0], "feeding_time": ["00:10:00"]}),
              pd.DataFrame({"seq": [120_000, 130_000, 180_000], "k": [0, 1, 0], "Pond_ID": [3.0, np.nan, 3.0],
                            "feeding_time": ["00:10:00", None, "00:10:00"]})]
    state = State()
    out = pd.concat(RM.reminder_state_fn((7,), iter(chunks), state))
    assert out.to_dict("list") == {"feeding_ID": [7, 7], "Pond_ID": [3.0, 3.0], "feeding_time": ["00:10:00"] * 2,
                                   "seq": [60_000, 180_000]}
    assert state.value == (180_000, 3, "00:10:00")
    # an ack alone closes what is open and fires nothing
    assert not list(RM.reminder_state_fn((7,), iter([chunks[1].iloc[1:2]]), state)) and not state.exists


def test_one_call_of_the_state_function_takes_many_keys(spark, tmp_path):
    """One call a key took most of the stream's time.  Ids of both signs and beyond
    2 ** 53, through a restart."""
    import random
    rnd = random.Random(3)
    day = dt.datetime(2024, 1, 1)
    ids = [-130, -65, -64, -1, *range(1, 150), 2 ** 60 + 1, 2 ** 60 + 63, 2 ** 60 + 64]
    dues = [(day + dt.timedelta(minutes=m), k, 1 + abs(k) % 5, 600, f"00:{abs(k) % 60:02d}:00") for k in ids
            for m in rnd.sample(range(600), 12)]
    acks = [(k, day + dt.timedelta(seconds=rnd.randrange(36_000))) for k in [*ids, 777] for _ in range(6)]
    due_df = spark.createDataFrame(dues, "tick_ts timestamp_ntz, feeding_ID long, Pond_ID int, feeding_sec int, feeding_time string")
    ack_df = spark.createDataFrame(acks, "feeding_ID long, ack_ts timestamp_ntz")
    ev = RM.stream_events(due_df, ack_df).checkpoint()
    src, ck, out = (str(tmp_path / n) for n in ("src", "ck", "out"))
    for low, high in ((0, 300), (300, 600)):
        start, stop = (F.lit(day + dt.timedelta(minutes=m)).cast("timestamp_ntz") for m in (low, high))
        ev.where((F.col("seq") >= RM.to_ms(start)) & (F.col("seq") < RM.to_ms(stop))).repartition(3).write.mode("append").parquet(src)
        s = spark.readStream.schema(ev.schema).parquet(src)
        (RM.reminder_stream(s.where(F.col("kind") == RM.DUE),
                            s.where(F.col("kind") == RM.ACK).select("feeding_ID", X.ntz_from_millis("seq").alias("ack_ts")))
         .writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out).awaitTermination())
        want = RM.reminder_open(due_df.where(F.col("tick_ts") < stop), ack_df.where(F.col("ack_ts") < stop))
        assert sorted(map(str, RM.reminders_in_state(spark, ck).collect())) == sorted(map(str, want.collect()))
    assert sorted(map(str, spark.read.schema(RM.REMINDER_SCHEMA).parquet(out).collect())) == \
        sorted(map(str, RM.reminder_batch(due_df, ack_df).collect()))
    groups = spark.read.format("statestore").load(ck).count()
    assert 0 < groups <= len({k >> 6 for k in ids}) < RM.reminders_in_state(spark, ck).count()
