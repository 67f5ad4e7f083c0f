"""The spark-submit entry points in jobs/, run in-process with arguments."""

import glob
import json
import os
import runpy
import sys

from farmspark.plans import jobs
from farmspark.sources import change_feeds as CF
from farmspark.sources.tables import Tables
from tests.conftest import SF_SMALL

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(script, args, capsys):
    old = sys.argv
    sys.argv = [script] + args
    try:
        runpy.run_path(os.path.join(ROOT, "jobs", script), run_name="__main__")
    finally:
        sys.argv = old
    return capsys.readouterr().out


def test_apply_changes_and_report_mains(spark, tmp_path, capsys):
    snap = str(tmp_path / "snap")
    t = Tables.from_driver(spark, SF_SMALL)
    jobs.write_snapshot(t, snap)
    ch = str(tmp_path / "moves")
    CF.stock_moves(t).write.parquet(ch)
    out = _run("apply_changes.py", ["--snapshot", snap, "--changes", ch, "--rule", "stock_changes",
                                    "--out", str(tmp_path / "next")], capsys)
    paths = json.loads(out.strip().splitlines()[-1])
    assert 0 < spark.read.parquet(paths["table"]).count() <= t.inventory.count()
    assert Tables.from_snapshot(spark, str(tmp_path / "next")).inventory.count() == t.inventory.count()
    rep = str(tmp_path / "water")
    _run("report.py", ["--snapshot", snap, "--name", "water", "--out", rep,
                       "--start", "2024-01-05", "--end", "2024-01-10"], capsys)
    lines = sum(len(open(f).read().splitlines()) - 1 for f in glob.glob(os.path.join(rep, "part-*.csv")))
    from farmspark.operators import reports as RP
    assert lines == RP.rows(RP.water_report(Tables.from_snapshot(spark, snap), "2024-01-05", "2024-01-10")).count()


def test_reminders_main_replay_equals_batch(spark, tmp_path, capsys):
    import datetime as dt
    from farmspark.streaming import reminders as RM
    snap = str(tmp_path / "snap")
    sched = spark.createDataFrame([(7, 3, 600), (8, 4, 1200)], "feeding_ID long, Pond_ID int, feeding_sec int")
    jobs.write_table(sched, snap, "feeding_schedule")
    ticks = [dt.datetime(2024, 1, 1, 0, m) for m in range(0, 20)]
    acks = [(7, dt.datetime(2024, 1, 1, 0, 3, 10)), (8, dt.datetime(2024, 1, 1, 0, 9, 1))]
    tdir, adir = str(tmp_path / "ticks"), str(tmp_path / "acks")
    spark.createDataFrame([(x,) for x in ticks], "tick_ts timestamp_ntz").write.json(tdir)
    spark.createDataFrame(acks, "feeding_ID long, ack_ts timestamp_ntz").write.json(adir)
    out = str(tmp_path / "out")
    _run("reminders.py", ["--snapshot", snap, "--acks", adir, "--out", out, "--checkpoint",
                          str(tmp_path / "ck"), "--ticks", tdir, "--available-now"], capsys)
    got = sorted((r.feeding_ID, r.reminder_time) for r in spark.read.parquet(out).collect())
    tick_df = spark.createDataFrame([(x,) for x in ticks], "tick_ts timestamp_ntz")
    want = sorted((r.feeding_ID, r.reminder_time) for r in RM.reminder_batch(
        RM.due_events(sched, tick_df), spark.createDataFrame(acks, "feeding_ID long, ack_ts timestamp_ntz")).collect())
    assert got == want and len(got) >= 3


def test_sensor_ingest_main(spark, tmp_path, capsys):
    src = tmp_path / "docs"
    src.mkdir()
    (src / "a.json").write_text('{"waterLevelInside": 3.5, "waterTemp": 21, "tds": 40}\n{"waterLevelInside"\n')
    out = str(tmp_path / "snap")
    _run("sensor_ingest.py", ["--src", str(src), "--out", out, "--checkpoint", str(tmp_path / "ck")], capsys)
    rows = Tables.from_snapshot(spark, out).sensors_data.collect()
    assert [(r.Pond_ID, r.Water_Level, r.WaterTemp, r.TDS) for r in rows] == [(1, 3.5, 21.0, 40.0)]
