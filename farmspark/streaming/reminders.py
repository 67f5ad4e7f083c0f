"""ST-2 feeding reminders.

Reference behaviour: every minute ``m`` the schedule rows with
``feeding_time BETWEEN m AND m + 15 min`` (both ends in, no wrap at midnight)
become *due*; a due row fires a reminder only if no reminder of that
``feeding_ID`` is open; an acknowledgement removes it, after which the next
due tick fires again.  So a due event fires iff the previous event of its
key (by time) is absent or an ack.

* ST-2a :func:`due_events` — ticks ⋈ schedule.  The BETWEEN condition is
  turned into an equi-join: a schedule row at second ``f`` can only be due at
  the (at most 16) minutes ``ceil((f-900)/60) … floor(f/60)`` of the same
  day, so each row is expanded to those minutes and joined on minute of day.
  No range or nested-loop join, no wrap past midnight.
* ST-2e :func:`reminder_batch` — the batch twin: fire iff the previous event
  is not a due.  Acks are first reduced to the latest ack per (key, minute)
  — dues sit on whole minutes, so nothing else can matter — which bounds a
  hot key to 2 × 1440 events per day before any window; the window runs per
  (key, day) with the previous day's last event carried in.
* ST-2b/c :func:`reminder_block_fn` — the stream: ``applyInPandasWithState``
  keyed by blocks of 64 neighbouring ``feeding_ID`` whose state is their open
  reminders, each removed on ack; :func:`reminder_state_fn` is the same for a
  stream keyed by ``feeding_ID``.
* ST-2d :func:`reminder_open` — keys whose last event is a due, over a replay;
  :func:`reminders_in_state` — the same list from the state of the live stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from farmspark.functions import exprs as X

WINDOW = X.REMINDER_WINDOW_SEC
DAY_MS = 86_400_000
MINUTE_MS = 60_000
DUE, ACK = "due", "ack"

REMINDER_SCHEMA = ("feeding_ID long, pond_ID int, reminder_time string, message string, "
                   "acknowledged boolean, tick_ts timestamp_ntz")


def to_ms(ts) -> Column:
    """TIMESTAMP_NTZ → epoch milliseconds, whatever the session time zone."""
    return X.ntz_millis(ts)


def schedule_minutes(schedule: DataFrame) -> DataFrame:
    """Each schedule row with the minutes of day at which it is due."""
    f = F.col("feeding_sec")
    lo = F.greatest(F.lit(0), F.ceil((f - WINDOW) / 60)).cast("int")
    hi = F.least(F.lit(1439), F.floor(f / 60)).cast("int")
    return (schedule.where(lo <= hi)
            .select("feeding_ID", "Pond_ID", "feeding_sec",
                    F.explode(F.sequence(lo, hi)).alias("tick_min")))


def minute_ticks(ts_frame: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Distinct whole-minute ticks covering the timestamps of a frame."""
    return ts_frame.select(X.ntz_minute(ts_col).alias("tick_ts")).distinct()


def due_events(schedule: DataFrame, ticks: DataFrame) -> DataFrame:
    """ST-2a schedule rows due at each tick (works on a streaming ``ticks``)."""
    t = ticks.select("tick_ts", (F.hour("tick_ts") * 60 + F.minute("tick_ts")).alias("tick_min"))
    j = t.join(schedule_minutes(schedule), "tick_min", "inner")
    return j.select("tick_ts", "feeding_ID", "Pond_ID", "feeding_sec",
                    X.sec_to_time_text("feeding_sec").alias("feeding_time"))


def reminder_fields(df: DataFrame) -> DataFrame:
    """The reminder object of the reference, built from a due row."""
    return df.select(
        F.col("feeding_ID").cast("long").alias("feeding_ID"),
        F.col("Pond_ID").cast("int").alias("pond_ID"),
        X.minute_text("tick_ts").alias("reminder_time"),
        F.concat(F.lit("Feeding reminder: Pond "), F.col("Pond_ID").cast("string"), F.lit(" needs feeding at "),
                 F.col("feeding_time")).alias("message"),
        F.lit(False).alias("acknowledged"),
        F.col("tick_ts").cast("timestamp_ntz").alias("tick_ts"))


def _events(dues: DataFrame, acks: DataFrame) -> DataFrame:
    """Dues and (per key and minute reduced) acks as one event frame.
    ``acks``: feeding_ID, ack_ts.  ``k`` orders a due before an ack at the
    same instant."""
    d = dues.select("feeding_ID", to_ms("tick_ts").alias("seq"), F.lit(DUE).alias("kind"), F.lit(0).alias("k"),
                    "tick_ts", "Pond_ID", "feeding_time")
    a = (acks.where(~X.falsy_number("feeding_ID"))
         .select(F.col("feeding_ID").cast("long").alias("feeding_ID"), to_ms("ack_ts").alias("_ms"))
         .groupBy("feeding_ID", F.floor(F.col("_ms") / MINUTE_MS).alias("_min"))
         .agg(F.max("_ms").alias("seq"))
         .select("feeding_ID", "seq", F.lit(ACK).alias("kind"), F.lit(1).alias("k"),
                 F.lit(None).cast("timestamp_ntz").alias("tick_ts"), F.lit(None).cast("int").alias("Pond_ID"),
                 F.lit(None).cast("string").alias("feeding_time")))
    return d.unionByName(a).withColumn("day", F.floor(F.col("seq") / DAY_MS))


def _with_prev_kind(ev: DataFrame) -> DataFrame:
    """``prev`` = kind of the previous event of the key, computed per
    (key, day) with the previous active day's last event carried in.

    The events are shuffled once, by (key, day): the in-day ``lag`` and the
    day's last event come from windows over that partitioning, the per-day
    summary is aggregated without another exchange, and only that summary
    (one row per key and active day) is re-partitioned for the carry."""
    w = Window.partitionBy("feeding_ID", "day").orderBy("seq", "k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ev2 = (ev.withColumn("_prev", F.lag("kind").over(w))
           .withColumn("_day_last", F.last("kind").over(whole)))
    days = ev2.groupBy("feeding_ID", "day").agg(F.first("_day_last").alias("_last"))
    carry = days.select("feeding_ID", "day",
                        F.lag("_last").over(Window.partitionBy("feeding_ID").orderBy("day")).alias("_carry"))
    return (ev2.join(carry, ["feeding_ID", "day"], "inner")
            .withColumn("prev", F.coalesce(F.col("_prev"), F.col("_carry"))))


def reminder_batch(dues: DataFrame, acks: DataFrame) -> DataFrame:
    """ST-2e reminders fired over a replay of ticks and acks."""
    ev = _with_prev_kind(_events(dues, acks))
    fired = ev.where((F.col("kind") == DUE) & (F.col("prev").isNull() | (F.col("prev") == ACK)))
    return reminder_fields(fired)


def reminder_open(dues: DataFrame, acks: DataFrame) -> DataFrame:
    """ST-2d the open reminder list after the replay: the last fired
    reminder of every key whose last event is a due."""
    ev = _with_prev_kind(_events(dues, acks))
    last = ev.groupBy("feeding_ID").agg(F.max_by("kind", F.struct("seq", "k")).alias("_last"))
    fired = ev.where((F.col("kind") == DUE) & (F.col("prev").isNull() | (F.col("prev") == ACK)))
    latest_fire = (fired.groupBy("feeding_ID")
                   .agg(F.max_by(F.struct("tick_ts", "Pond_ID", "feeding_time"), "seq").alias("_f"))
                   .select("feeding_ID", "_f.*"))
    return reminder_fields(latest_fire.join(last.where(F.col("_last") == DUE), "feeding_ID", "left_semi"))


def reminder_ack(acks: DataFrame) -> DataFrame:
    """ST-2c the reply to every acknowledgement that names a reminder, whether
    or not one was open (what an acknowledgement closes shows in
    :func:`reminder_open`)."""
    return acks.where(~X.falsy_number("feeding_ID")).select(
        F.col("feeding_ID").cast("long").alias("feeding_ID"), F.col("ack_ts").cast("timestamp_ntz").alias("ack_ts"),
        F.concat(F.lit("Reminder "), F.col("feeding_ID").cast("string"), F.lit(" acknowledged")).alias("message"))


def reminder_ack_rejects(acks: DataFrame) -> DataFrame:
    """ST-2c acknowledgements without a feeding_ID (0 counts as none)."""
    return acks.where(X.falsy_number("feeding_ID")).select(
        F.col("ack_ts").cast("timestamp_ntz").alias("ack_ts"), F.lit("feeding_ID is required").alias("reason"))


# ------------------------------------------------------------------ streaming
#: a call of the state function costs Spark some milliseconds whatever it is given,
#: so one call takes a block of 2 ** BLOCK_BITS neighbouring ids (running numbers).
#: A checkpoint keeps its blocks: it can be continued with the same value only
BLOCK_BITS = 6
#: the open reminders of a block by place in it; no state when none is open
STATE_SCHEMA = "open array<struct<slot: int, tick_ms: long, Pond_ID: int, feeding_time: string>>"
#: what the state function sees of an event, and what it gives of a fired due
STATE_FN_COLS = ["block", "slot", "seq", "k", "Pond_ID", "feeding_time"]
FIRED_SCHEMA = "feeding_ID long, Pond_ID int, feeding_time string, seq long"


def stream_events(dues: DataFrame, acks: DataFrame) -> DataFrame:
    """Union of the due stream and the ack stream in one event shape."""
    d = dues.select(F.col("feeding_ID").cast("long").alias("feeding_ID"), to_ms("tick_ts").alias("seq"),
                    F.lit(0).alias("k"), F.lit(DUE).alias("kind"), "tick_ts", "Pond_ID", "feeding_time")
    a = acks.where(~X.falsy_number("feeding_ID")).select(
                    F.col("feeding_ID").cast("long").alias("feeding_ID"), to_ms("ack_ts").alias("seq"),
                    F.lit(1).alias("k"), F.lit(ACK).alias("kind"),
                    F.lit(None).cast("timestamp_ntz").alias("tick_ts"), F.lit(None).cast("int").alias("Pond_ID"),
                    F.lit(None).cast("string").alias("feeding_time"))
    return d.unionByName(a)


def _last_per_minute(slot: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dues sit on whole minutes, so of a key's acks within one minute only the last
    can matter."""
    order = np.lexsort((seq, slot))
    slot, seq = slot[order], seq[order]
    minute = seq // MINUTE_MS
    last = np.ones(len(seq), bool)
    last[:-1] = (minute[1:] != minute[:-1]) | (slot[1:] != slot[:-1])
    return slot[last], seq[last]


def _text(value) -> str | None:
    return None if pd.isna(value) else value


def _int(value) -> int | None:
    return None if pd.isna(value) else int(value)


def _replay(chunks: Iterator[tuple[np.ndarray, pd.DataFrame]], opened: dict) -> tuple[np.ndarray, ...]:
    """The events of some keys (``slot`` tells them apart) of a micro-batch: fire a
    due when nothing is open; an ack closes.  A reminder is open exactly after a
    due, so a due fires unless the event before it is one.  ``opened`` holds the open
    reminder by slot and is brought up to date.  Gives slot, pond, time and seq of
    what fires.  Chunks are reduced as they come: at most one ack a minute is held of
    a key, however many arrive."""
    dues, slots, acks = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    for slot, chunk in chunks:
        seq, due = chunk["seq"].to_numpy(), chunk["k"].to_numpy() == 0
        slots, acks = _last_per_minute(np.concatenate((slots, slot[~due])), np.concatenate((acks, seq[~due])))
        if due.any():
            dues.append((slot[due], chunk["Pond_ID"].to_numpy()[due], chunk["feeding_time"].to_numpy()[due], seq[due]))
    due_slot, pond, at, due_seq = ([np.concatenate(c) for c in zip(*dues)] if dues
                                   else (slots[:0], acks[:0], acks[:0], acks[:0]))
    slot, seq = np.concatenate((due_slot, slots)), np.concatenate((due_seq, acks))
    is_ack = np.arange(len(seq)) >= len(due_seq)
    order = np.lexsort((is_ack, seq, slot))
    slot, is_ack = slot[order], is_ack[order]
    begins = np.r_[True, slot[1:] != slot[:-1]]
    free = np.empty(len(slot), bool)
    free[1:] = is_ack[:-1]
    free[begins] = ~np.isin(slot[begins], list(opened))
    fired = order[~is_ack & free]
    at_slot = due_slot[fired]
    for i in fired[np.r_[at_slot[1:] != at_slot[:-1], True]] if len(fired) else ():
        opened[int(due_slot[i])] = (int(due_seq[i]), _int(pond[i]), _text(at[i]))
    for closed in slot[np.r_[begins[1:], True] & is_ack]:
        opened.pop(int(closed), None)
    return at_slot, pond[fired], at[fired], due_seq[fired]


def reminder_state_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """ST-2b/c per key, for a stream keyed by ``feeding_ID``: the state is the open
    reminder and is removed when closed.  It gives the bare due rows; their texts are
    built by :func:`reminder_stream`."""
    opened = {0: None} if state.exists else {}
    slot, pond, at, seq = _replay(((np.zeros(len(c), np.int64), c) for c in pdfs), opened)
    if 0 not in opened:
        if state.exists:
            state.remove()
    elif opened[0]:
        state.update(opened[0])
    if len(slot):
        yield pd.DataFrame({"feeding_ID": np.full(len(slot), key[0], np.int64), "Pond_ID": pond, "feeding_time": at, "seq": seq})


def reminder_block_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """ST-2b/c per block of keys: :func:`reminder_state_fn` for up to 64 keys in one
    call.  The state is the block's open reminders, at most one a key, and is removed
    when all are closed."""
    before = {row[0]: tuple(row[1:]) for row in state.get[0]} if state.exists else {}
    opened = dict(before)
    slot, pond, at, seq = _replay(((c["slot"].to_numpy().astype(np.int64), c) for c in pdfs), opened)
    if opened:
        if opened != before:
            state.update(([(s, *opened[s]) for s in sorted(opened)],))
    elif before:
        state.remove()
    if len(slot):
        yield pd.DataFrame({"feeding_ID": (key[0] << BLOCK_BITS) + slot, "Pond_ID": pond, "feeding_time": at, "seq": seq})


def reminders_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """ST-2d the open reminder list of a stream, read from the state in its
    checkpoint: what is open after its last finished micro-batch."""
    state = spark.read.format("statestore").load(checkpoint).select(F.col("key.block").alias("block"), F.inline("value.groupState.open"))
    return reminder_fields(state.select(
        (F.shiftleft("block", BLOCK_BITS) + F.col("slot")).alias("feeding_ID"), "Pond_ID", "feeding_time",
        X.ntz_from_millis("tick_ms").alias("tick_ts")))


def reminder_stream(dues: DataFrame, acks: DataFrame) -> DataFrame:
    """ST-2b/c streaming reminders (append)."""
    events = (stream_events(dues, acks).withColumn("block", F.shiftright("feeding_ID", BLOCK_BITS))
              .withColumn("slot", F.col("feeding_ID").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")))
    fired = (events.select(*STATE_FN_COLS).groupBy("block")
             .applyInPandasWithState(reminder_block_fn, FIRED_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout))
    return reminder_fields(fired.withColumn("tick_ts", X.ntz_from_millis("seq")))
