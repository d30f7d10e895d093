"""Validate releases from the command line.

    python -m exprlake CATALOG [--job JOB ...] [--output-dir DIR | --no-write] [--reports PATH]

Exit code 0: all releases are clean; 1: there are warnings; 2: a release failed, is unknown,
or there is none.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.release_check import validate_releases
from .session import engine_session
from .sources.files import ReleaseFiles


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="exprlake", description="Validate releases and export them.")
    parser.add_argument("catalog", help="JSON catalog of the releases")
    parser.add_argument("--job", action="append", dest="jobs", help="a release id or name; may be repeated")
    parser.add_argument("--output-dir", help="where to write the samples x genes tables")
    parser.add_argument("--no-write", action="store_true", help="validate only")
    parser.add_argument("--reports", help="also write the reports there, as Parquet")
    args = parser.parse_args(argv)

    spark = engine_session(SparkSession.builder.appName("exprlake").getOrCreate())
    output = None if args.no_write else args.output_dir
    check = validate_releases(spark, ReleaseFiles(args.catalog), args.jobs, output)
    if check.unknown:
        print(f"unknown release(s): {', '.join(check.unknown)}", file=sys.stderr)
        return 2
    reports = check.reports.cache()
    if args.reports:
        reports.write.parquet(args.reports)
    # One partition of reports at a time.
    for r in reports.orderBy("job_id").toLocalIterator():
        print(
            f"[{r['status']}] {r['job_id']} ({r['job_name']}) genes={r['n_genes']} "
            f"metadata={r['n_samples_metadata']} parquet={r['n_samples_parquet']} shared={r['n_samples_intersection']}"
        )
        for line in ([f"fatal: {r['fatal']}"] if r["fatal"] else []) + [f"- {i}" for i in r["issues"]]:
            print(f"    {line}")
        if r["output_path"]:
            print(f"    wrote {r['output_path']}")
    totals = check.summary.first()
    print(f"{totals['n_ok']} OK  {totals['n_warn']} WARN  {totals['n_fail']} FAIL  ({totals['n_total']} releases)")
    reports.unpersist()
    return totals["code"]


if __name__ == "__main__":
    raise SystemExit(main())
