"""The reminder replay (per-minute ack reduction, per-(key, day) windows with
a carried-in previous day) against a plain sequential simulation of the
reference's in-memory list, on random event streams with many acks per
minute, acks on exact minute boundaries and reminders left open overnight."""

import datetime as dt
import random

import pytest

from farmspark.streaming import reminders as RM

T0 = dt.datetime(2024, 1, 1)


def _simulate(dues, acks):
    """Sequential truth: dues (key, ts), acks (key, ts)."""
    ev = sorted([(ts, 0, k) for k, ts in dues] + [(ts, 1, k) for k, ts in acks])
    open_, fires = set(), []
    for ts, kind, k in ev:
        if kind == 0:
            if k not in open_:
                open_.add(k)
                fires.append((k, ts))
        elif k in open_:
            open_.discard(k)
    return sorted(fires), open_


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_matches_sequential_simulation(spark, seed):
    rnd = random.Random(seed)
    dues, acks = [], []
    for k in range(1, 5):
        minutes = sorted(rnd.sample(range(0, 3 * 1440), 60))
        dues += [(k, T0 + dt.timedelta(minutes=m)) for m in minutes]
        for _ in range(150 if k == 1 else 40):  # key 1 is hot
            m = rnd.randrange(0, 3 * 1440)
            sec = rnd.choice([0, 0.0, rnd.random() * 60])
            acks.append((k, T0 + dt.timedelta(minutes=m, seconds=sec)))
    acks = [(k, ts.replace(microsecond=(ts.microsecond // 1000) * 1000)) for k, ts in acks]  # ms precision
    due_df = spark.createDataFrame(
        [(ts, k, 10 + k, 600, "00:10:00") for k, ts in dues],
        "tick_ts timestamp_ntz, feeding_ID long, Pond_ID int, feeding_sec int, feeding_time string")
    ack_df = spark.createDataFrame(acks, "feeding_ID long, ack_ts timestamp_ntz")
    fires, still_open = _simulate(dues, acks)
    got = sorted((r.feeding_ID, r.tick_ts) for r in RM.reminder_batch(due_df, ack_df).collect())
    assert got == fires
    # every acknowledgement is answered
    assert sorted((r.feeding_ID, r.ack_ts) for r in RM.reminder_ack(ack_df).collect()) == sorted(acks)
    assert {r.feeding_ID for r in RM.reminder_open(due_df, ack_df).collect()} == still_open
