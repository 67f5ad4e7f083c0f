"""Keys for SRC-1, SRC-2, ST-1, C-17, ST-2a … ST-2e and ST-3."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from farmspark.plans.broadcast import KEYS_BROADCAST_BYTES, materialized
from farmspark.registry import query
from farmspark.session import scratch_path
from farmspark.sources import feeds, schemas
from farmspark.streaming import alerts as AL
from farmspark.streaming import reminders as RM
from farmspark.streaming import sensor_ingest as SI

# SRC-1: every business table loads, with its row count -----------------------
_TABLES = {"customer_order": "co", "customer": "cu", "supplier": "su", "worker": "wk", "users": "us",
           "inventory": "inv", "supply_orders": "so", "sensors_data": "sd", "task": "tk",
           "feeding_schedule": "fd"}


def _load_tables(t):
    """Rows and filled-in values of every table: reads all columns."""
    out = None
    for name in _TABLES:
        df = t.frames[name]
        filled = sum((F.col(c).isNotNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
        c = df.agg(F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(filled), F.lit(0)).cast("long").alias("n_values"))
        c = c.select(F.lit(name).alias("table_name"), "row_count", "n_values")
        out = c if out is None else out.unionByName(c)
    return out


query("load_tables", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST(count(*) AS BIGINT) AS row_count, CAST(coalesce(sum("
    + " + ".join(f"CAST({f.name} IS NOT NULL AS BIGINT)" for f in schemas.BUSINESS[n].fields)
    + f"), 0) AS BIGINT) AS n_values FROM {a}" for n, a in _TABLES.items()))(
    _load_tables)

# SRC-2 / ST-1 / C-17 -----------------------------------------------------------
_READINGS = """
    SELECT CAST(1 AS INTEGER) AS Pond_ID,
           CAST(json_extract(doc, '$.waterLevelInside') AS DOUBLE) AS Water_Level,
           CAST(NULL AS DOUBLE) AS pH,
           CAST(json_extract(doc, '$.waterTemp') AS DOUBLE) AS WaterTemp,
           CAST(json_extract(doc, '$.tds') AS DOUBLE) AS TDS,
           arrived_at AS Updated_at
    FROM sensor_docs WHERE CASE WHEN json_valid(doc) THEN json_type(doc) = 'OBJECT' ELSE FALSE END"""
query("sensor_source", """
    SELECT CAST(json_extract(doc, '$.waterLevelInside') AS DOUBLE) AS waterLevelInside,
           CAST(json_extract(doc, '$.waterTemp') AS DOUBLE) AS waterTemp,
           CAST(json_extract(doc, '$.tds') AS DOUBLE) AS tds, arrived_at
    FROM sensor_docs WHERE CASE WHEN json_valid(doc) THEN json_type(doc) = 'OBJECT' ELSE FALSE END""", feeds=("sensor_docs",))(
    lambda t: SI.docs_to_source_rows(feeds.sensor_docs(t)))
query("sensor_ingest", _READINGS, feeds=("sensor_docs",))(
    lambda t: SI.docs_to_readings(feeds.sensor_docs(t)))
query("sensor_ingest_rejects", """
    SELECT doc, arrived_at, CASE WHEN json_valid(doc) THEN 'not an object' ELSE 'not JSON' END AS reason
    FROM sensor_docs WHERE CASE WHEN json_valid(doc) THEN json_type(doc) <> 'OBJECT' ELSE TRUE END""", feeds=("sensor_docs",))(
    lambda t: SI.rejected_docs(feeds.sensor_docs(t)))
query("append_readings", "SELECT Pond_ID, Water_Level, pH, WaterTemp, TDS, Updated_at FROM sd UNION ALL "
      "SELECT * FROM readings", feeds=("sensor_docs",), extra={"readings": _READINGS})(
    lambda t: SI.append_readings(t.sensors_data, SI.docs_to_readings(feeds.sensor_docs(t))))

# ST-2 ---------------------------------------------------------------------------
_TIME_TEXT = ("lpad(CAST(f.feeding_sec // 3600 AS VARCHAR), 2, '0') || ':' || "
              "lpad(CAST((f.feeding_sec % 3600) // 60 AS VARCHAR), 2, '0') || ':' || "
              "lpad(CAST(f.feeding_sec % 60 AS VARCHAR), 2, '0')")
_DUES = f"""
    SELECT t.tick_ts, f.feeding_ID, f.Pond_ID, f.feeding_sec, {_TIME_TEXT} AS feeding_time
    FROM ticks t JOIN fd f
      ON f.feeding_sec BETWEEN hour(t.tick_ts) * 3600 + minute(t.tick_ts) * 60
                           AND hour(t.tick_ts) * 3600 + minute(t.tick_ts) * 60 + 900"""
_EV = {
    "dues": _DUES,
    "ev": """SELECT feeding_ID, epoch_ms(tick_ts) AS seq, 0 AS k, 'due' AS kind, tick_ts, Pond_ID, feeding_time
             FROM dues
             UNION ALL
             SELECT feeding_ID, epoch_ms(ack_ts), 1, 'ack', NULL, NULL, NULL FROM feeding_acks
             WHERE feeding_ID <> 0""",
    "lagged": "SELECT *, lag(kind) OVER (PARTITION BY feeding_ID ORDER BY seq, k) AS prev FROM ev",
    "fired": "SELECT * FROM lagged WHERE kind = 'due' AND (prev IS NULL OR prev = 'ack')",
}
_REMINDER_COLS = """feeding_ID, CAST(Pond_ID AS INTEGER) AS pond_ID, strftime(tick_ts, '%H:%M:00') AS reminder_time,
    'Feeding reminder: Pond ' || CAST(Pond_ID AS VARCHAR) || ' needs feeding at ' || feeding_time AS message,
    false AS acknowledged, tick_ts"""


def _ticks(t):
    """The ticks of the replay, written once: one row a minute, however many
    events there are."""
    return materialized(RM.minute_ticks(t.raw("events")), "ticks")


def _dues_at(t, ticks, small):
    """The schedule is a small table with some hundred dues a row and month: it is
    dealt to all tasks and probes the ticks, so that no task makes the dues of all."""
    parts = 2 * t.spark.sparkContext.defaultParallelism
    return RM.due_events(t.feeding_schedule.repartition(parts), F.broadcast(ticks) if small else ticks)


def _dues(t):
    ticks, size = _ticks(t)
    return _dues_at(t, ticks, size <= KEYS_BROADCAST_BYTES)


query("reminder_due", "SELECT tick_ts, feeding_ID, Pond_ID, feeding_sec, feeding_time FROM dues",
      feeds=("ticks",), extra={"dues": _DUES})(_dues)
query("reminder_batch", f"SELECT {_REMINDER_COLS} FROM fired", feeds=("ticks", "feeding_acks"), extra=_EV)(
    lambda t: RM.reminder_batch(_dues(t), feeds.feeding_acks(t)))
_OPEN = f"""
    SELECT {_REMINDER_COLS} FROM (
      SELECT feeding_ID, arg_max(tick_ts, seq) AS tick_ts, arg_max(Pond_ID, seq) AS Pond_ID,
             arg_max(feeding_time, seq) AS feeding_time
      FROM fired GROUP BY feeding_ID)
    WHERE feeding_ID IN (SELECT feeding_ID FROM (SELECT feeding_ID, arg_max(kind, seq * 2 + k) AS lk
                                                 FROM ev GROUP BY feeding_ID) WHERE lk = 'due')"""
query("reminder_open", _OPEN, feeds=("ticks", "feeding_acks"), extra=_EV)(
    lambda t: RM.reminder_open(_dues(t), feeds.feeding_acks(t)))

query("reminder_ack", """
    SELECT feeding_ID, ack_ts, 'Reminder ' || CAST(feeding_ID AS VARCHAR) || ' acknowledged' AS message
    FROM feeding_acks WHERE feeding_ID <> 0""", feeds=("feeding_acks",))(
    lambda t: RM.reminder_ack(feeds.feeding_acks(t)))
query("reminder_ack_rejects", """
    SELECT ack_ts, 'feeding_ID is required' AS reason FROM feeding_acks
    WHERE feeding_ID IS NULL OR feeding_ID = 0""",
      feeds=("feeding_acks",))(lambda t: RM.reminder_ack_rejects(feeds.feeding_acks(t)))


def _run_reminders(t) -> str:
    """ST-2b/c through Structured Streaming, as the job runs it: dues and raw
    acks arrive in two scratch folders under ``spark.checkpoint.dir`` in three
    parts by time, and the stateful stream is run after each (availableNow), so
    its state goes through restarts.  Every part is made from the ticks and the
    events of its time alone.  Returns the folder of its files."""
    spark = t.spark
    base = scratch_path(spark, f"reminder_fire/{uuid.uuid4().hex}")
    ticks, size = _ticks(t)
    acks = feeds.feeding_acks(t)
    ends = ticks.select(RM.to_ms("tick_ts").alias("ms")).unionByName(acks.select(RM.to_ms("ack_ts").alias("ms")))
    low, high = ends.agg(F.min("ms"), F.max("ms")).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    for k in range(3):
        def part(ts):
            return F.floor((RM.to_ms(ts) - (low or 0)) / third) == k  # noqa: B023
        dues = _dues_at(t, ticks.where(part("tick_ts")), size <= KEYS_BROADCAST_BYTES).drop("feeding_sec")
        now = acks.where(part("ack_ts"))
        dues.write.mode("append").parquet(f"{base}/dues")
        now.write.mode("append").parquet(f"{base}/acks")
        fired = RM.reminder_stream(spark.readStream.schema(dues.schema).parquet(f"{base}/dues"),
                                   spark.readStream.schema(now.schema).parquet(f"{base}/acks"))
        (fired.writeStream.format("parquet").option("checkpointLocation", f"{base}/ckpt")
         .trigger(availableNow=True).start(f"{base}/out").awaitTermination())
    return base


def _reminder_fire(t):
    """The reminders that the stream has appended."""
    return t.spark.read.schema(RM.REMINDER_SCHEMA).parquet(f"{_run_reminders(t)}/out")


query("reminder_open_state", _OPEN, feeds=("ticks", "feeding_acks"), extra=_EV)(
    lambda t: RM.reminders_in_state(t.spark, f"{_run_reminders(t)}/ckpt"))
query("reminder_fire", f"SELECT {_REMINDER_COLS} FROM fired", feeds=("ticks", "feeding_acks"), extra=_EV)(
    _reminder_fire)

# ST-3 ---------------------------------------------------------------------------
_TH = AL.Thresholds()


def _js(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


def _line(c: str, lo: float, hi: float, label: str) -> str:
    return f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{AL.WARN} {label} out of range: ' || {_js(c)} END"


query("threshold_alerts", f"""
    SELECT 'pond_alert' AS kind, CAST(Pond_ID AS BIGINT) AS ref_id, 'workers@farm.example' AS recipient,
           '{AL.SUBJECT}' AS subject, msg AS body
    FROM (SELECT Pond_ID, concat_ws(chr(10),
                 {_line('Water_Level', _TH.min_water_level, _TH.max_water_level, 'Water level')},
                 {_line('WaterTemp', _TH.min_temperature, _TH.max_temperature, 'Temperature')},
                 {_line('TDS', _TH.min_tds, _TH.max_tds, 'TDS')}) AS msg
          FROM sd)
    WHERE msg <> ''""")(lambda t: AL.threshold_alerts(t.sensors_data, _TH))
