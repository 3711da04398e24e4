"""Print the plan facts (exchanges, broadcasts, pushed filters) of every registered query.

usage: python tools/plan_report.py [sf_dir] [name ...]
"""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from packetlens import get_spark  # noqa: E402
from packetlens.plans import queries as Q  # noqa: E402
from packetlens.plans.checks import summary  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")] or list(Q.QUERIES)
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    Q.CHECK = False
    for n in names:
        if n.startswith("stream_") or n in ("csv_scan",):
            continue
        df = Q.QUERIES[n](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        print(n, json.dumps(summary(df)))


if __name__ == "__main__":
    main()
