"""spark-submit jobs/apply_changes.py --snapshot IN --changes PATH --rule NAME --out OUT [--outbox PATH]

Applies one validated change batch (C-1 … C-16) to a snapshot; writes the
new table snapshot, the rejects and the rule's notices (outbox).
"""

import argparse
import json

from farmspark.plans import jobs
from farmspark.session import get_session


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--snapshot", required=True)
    p.add_argument("--changes", required=True)
    p.add_argument("--rule", required=True, choices=sorted(jobs.RULES) + ["register_accounts"])
    p.add_argument("--out", required=True)
    p.add_argument("--outbox")
    a = p.parse_args()
    spark = get_session()
    if a.rule == "register_accounts":
        out = jobs.register_batch(spark, a.snapshot, a.changes, a.out, a.outbox)
    else:
        out = jobs.apply_batch(spark, a.snapshot, a.changes, a.rule, a.out, a.outbox)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
