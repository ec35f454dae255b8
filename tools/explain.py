"""Print the formatted physical plan of registered queries.

Usage: python tools/explain.py <name> [<name> ...] [--sf /root/testdata/sf0.01] [--final]

``--final`` runs the query first and prints the adaptive plan Spark actually
executed (with reused exchanges and AQE's join choices).
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tuneframe.plans.queries import REGISTRY  # noqa: E402
from tuneframe.session import builder  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        sf = args[args.index("--sf") + 1]
        args = [a for a in args if a not in ("--sf", sf)]
    final = "--final" in args
    names = [a for a in args if a != "--final"]
    spark = builder().getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        df = REGISTRY[name](spark, sf)
        print(f"==== {name}")
        if final:
            df.write.format("noop").mode("overwrite").save()
            print(df._jdf.queryExecution().executedPlan().toString())
        else:
            df.explain("formatted")


if __name__ == "__main__":
    main()
