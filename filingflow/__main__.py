"""Command line: list, run or explain registered queries.

    python -m filingflow list
    python -m filingflow run NAME [--sf-dir DIR] [--show N]
    python -m filingflow explain NAME [--sf-dir DIR]
"""

from __future__ import annotations

import argparse
import os
import sys
import time


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="filingflow")
    ap.add_argument("command", choices=["list", "run", "explain"])
    ap.add_argument("name", nargs="?")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    ap.add_argument("--show", type=int, default=10)
    a = ap.parse_args(argv)

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from filingflow.plans import catalog

    catalog.queries()
    if a.command == "list":
        for name, q in catalog.REGISTRY.items():
            print(f"{name:28s} {'oracle' if q.oracle else 'rows-only':9s} {' '.join(q.operators)}")
        return 0
    if a.name not in catalog.REGISTRY:
        ap.error(f"unknown query {a.name!r}; see 'list'")
    from filingflow.session import local_session

    spark = local_session()
    df = catalog.REGISTRY[a.name].run(spark, a.sf_dir)
    if a.command == "explain":
        df.explain("formatted")
        return 0
    t0 = time.perf_counter()
    rows = df.count()
    print(f"{a.name}: {rows} rows in {time.perf_counter() - t0:.2f} s")
    df.show(a.show, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
