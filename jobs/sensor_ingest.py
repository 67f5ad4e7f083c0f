"""spark-submit jobs/sensor_ingest.py --src DOCS_DIR --out SNAPSHOT_ROOT --checkpoint DIR

ST-1: run by an outside scheduler every 6 h (availableNow) in place of the
in-process cron; appends the new readings to sensors_data of the snapshot, once.
"""

import argparse

from farmspark.session import get_session
from farmspark.streaming.sensor_ingest import start_ingest


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--src", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--continuous", action="store_true", help="keep running with a 6 h processing-time trigger")
    a = p.parse_args()
    start_ingest(get_session(), a.src, a.out, a.checkpoint, available_now=not a.continuous).awaitTermination()


if __name__ == "__main__":
    main()
