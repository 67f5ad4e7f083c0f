"""spark-submit jobs/reminders.py --snapshot IN --acks ACK_DIR --out OUT --checkpoint DIR [--ticks TICK_DIR] [--open PATH]

ST-2: a minute tick stream joined with the feeding schedule, unioned with
the acknowledgement stream, through the keyed reminder state; reminders are
appended to OUT.  Ticks come from a rate source (one per wall-clock minute)
or, with ``--ticks``, from JSON files ``{tick_ts}`` (replay).  State lives
in the checkpoint, so, unlike the in-memory list of the reference, it
survives a restart.
"""

import argparse

from pyspark.sql import functions as F

from farmspark.functions import exprs as X
from farmspark.plans.sinks import write_rows
from farmspark.session import get_session
from farmspark.sources.tables import Tables
from farmspark.streaming import reminders as RM


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--snapshot", required=True)
    p.add_argument("--acks", required=True, help="folder of JSON lines {feeding_ID, ack_ts}")
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--ticks", help="folder of JSON lines {tick_ts} instead of the minute clock")
    p.add_argument("--available-now", action="store_true", help="process what has arrived, then stop")
    p.add_argument("--open", help="write the reminders that are open in the checkpoint's state there, as JSON lines, and stop")
    a = p.parse_args()
    spark = get_session()
    if a.open:
        write_rows(RM.reminders_in_state(spark, a.checkpoint), a.open, order=[F.col("feeding_ID")])
        return
    t = Tables.from_snapshot(spark, a.snapshot)
    if a.ticks:
        ticks = (spark.readStream.schema("tick_ts timestamp_ntz").json(a.ticks)
                 .select(X.ntz_minute("tick_ts").alias("tick_ts")))
    else:
        ticks = (spark.readStream.format("rate").option("rowsPerSecond", 1).load()
                 .where(F.second("timestamp") == 0)
                 .select(F.date_trunc("minute", "timestamp").cast("timestamp_ntz").alias("tick_ts")))
    acks = spark.readStream.schema("feeding_ID long, ack_ts timestamp_ntz").json(a.acks)
    w = (RM.reminder_stream(RM.due_events(t.feeding_schedule, ticks), acks)
         .writeStream.format("parquet").option("checkpointLocation", a.checkpoint))
    w = w.trigger(availableNow=True) if a.available_now else w.trigger(processingTime="1 minute")
    w.start(a.out).awaitTermination()


if __name__ == "__main__":
    main()
