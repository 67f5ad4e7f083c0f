"""spark-submit jobs/report.py --snapshot IN --name sales|purchase|water|inventory --out OUT [--start D --end D]

SNK-2: writes one date-bounded report as CSV with header labels, in report order.
"""

import argparse

from farmspark.plans import jobs
from farmspark.session import get_session


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--snapshot", required=True)
    p.add_argument("--name", required=True, choices=["sales", "purchase", "water", "inventory"])
    p.add_argument("--out", required=True)
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--format", default="csv")
    a = p.parse_args()
    jobs.report(get_session(), a.snapshot, a.name, a.out, a.start, a.end, a.format)


if __name__ == "__main__":
    main()
