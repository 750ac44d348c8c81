"""``python -m palimpsest JOBS.yaml...``: mask the documents of job files."""

from __future__ import annotations

import sys

from palimpsest.plans.pipeline import run_jobs
from palimpsest.session import build_session
from palimpsest.sources.jobs import ConfigFault

VERSION = "0.1.0"
USAGE = "usage: python -m palimpsest JOBS.yaml..."


def main(args: list[str]) -> int:
    if args[:1] in (["-h"], ["--help"]):
        print(USAGE)
        return 0
    if args[:1] in (["-V"], ["--version"]):
        print(VERSION)
        return 0
    if not args:
        print(USAGE, file=sys.stderr)
        return 1
    spark = build_session()
    try:
        rows = run_jobs(spark, args)
    except (ConfigFault, OSError) as fault:
        print(f"error: {fault}", file=sys.stderr)
        return 1
    failed = 0
    for row in rows:
        if row["error"]:
            failed += 1
            print(f"failed: {row['input']}: {row['error']}", file=sys.stderr)
        else:
            print(f"done: {row['output']}: {row['pages']} pages")
        if row.get("linearize_error"):
            failed += 1
            print(f"not linearized: {row['output']}: {row['linearize_error']}", file=sys.stderr)
    print(f"{len(rows) - sum(bool(r['error']) for r in rows)} of {len(rows)} jobs succeeded")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
