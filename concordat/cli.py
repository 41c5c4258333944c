"""Command line: check a mapping against tables, list its rules, run a reconciliation.

python -m concordat.cli check --tables DIR [--bundle]
python -m concordat.cli rules [--markdown]
python -m concordat.cli run --tables DIR --out DIR [--bundle] [--feedback FILE] [--choose INTERPRETATION=READING ...]

Exit codes: 0 done, 1 problems found in the data or inputs changed meanwhile, 2 the mapping or the arguments are wrong.
"""

from __future__ import annotations

import argparse
import sys

from concordat import config
from concordat.operators import hypotheses, report
from concordat.operators.feedback import Store
from concordat.plans import pipeline
from concordat.session import local_session, release, table
from concordat.sources import files


def _tables(spark, mapping: config.Mapping, tables: str, bundle: bool):
    """The tables, and what is wrong with them."""
    try:
        d = pipeline.bundle_tables(spark, tables) if bundle else tables
    except (ValueError, OSError) as e:
        return None, str(e).splitlines()
    return d, config.against_data(mapping, table(spark, d, "rh_source").columns, table(spark, d, "temps_target").columns)


def _check(spark, mapping: config.Mapping, tables: str, bundle: bool) -> int:
    d, problems = _tables(spark, mapping, tables, bundle)
    for p in problems:
        print(p)
    if d is not None:
        for r in pipeline.uncovered(spark, d).orderBy("gap", "code").collect():  # codes of a fixed lookup
            print(f"note: code {r['code']} {r['gap']} ({r['n']} rows)")
    if bundle and d is not None:
        for r in files.manifest_status(spark, tables).orderBy("name").collect():  # the files of a folder
            print(f"note: {r['name']} {r['status']}")
    return 1 if problems else 0


def run(spark, mapping: config.Mapping, tables: str, out: str, bundle: bool = False, feedback: str | None = None) -> dict[str, int]:
    """A run's sheets and one CSV of what is to be investigated, written to `out`; returns the verdict counts, those of
    assignments without partner included."""
    return _written(_done(spark, mapping, tables, bundle, feedback), out)


def _done(spark, mapping: config.Mapping, tables: str, bundle: bool, feedback: str | None) -> pipeline.Run:
    if bundle:
        return pipeline.run_bundle(spark, tables, mapping, feedback_path=feedback)
    return pipeline.run(spark, tables, mapping, Store.load(feedback, [f.target for f in mapping.fields]) if feedback else None)


def _written(done: pipeline.Run, out: str) -> dict[str, int]:
    report.export_sheets(done.sheets(), out)
    report.export_csv(hypotheses.investigated(done.findings), f"{out}/to_investigate.csv")
    report.export_csv(done.findings, f"{out}/verdicts.csv")
    return done.counts()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="concordat")
    p.add_argument("--mapping", default=str(config.DEFAULT))
    sub = p.add_subparsers(dest="what", required=True)
    c = sub.add_parser("check")
    x = sub.add_parser("run")
    for y in (c, x):
        y.add_argument("--tables", required=True)
        y.add_argument("--bundle", action="store_true", help="the folder holds XLSX or CSV files, not Parquet tables")
    r = sub.add_parser("rules")
    r.add_argument("--markdown", action="store_true")
    x.add_argument("--out", required=True)
    x.add_argument("--feedback", help="YAML file of expert rules and corrections")
    x.add_argument("--choose", action="append", default=[], metavar="INTERPRETATION=READING")
    a = p.parse_args(argv)
    try:
        mapping = config.load(a.mapping)
        if a.what == "run":
            mapping = mapping.with_choices(dict(v.split("=", 1) for v in a.choose))
    except (config.ConfigError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 2
    if a.what == "rules":
        print(config.documentation(mapping) if a.markdown else "\n".join(f"{f.target} <- {', '.join(f.sources)} ({f.rule})" for f in mapping.fields))
        return 0
    spark = local_session("concordat")
    if a.what == "check":
        return _check(spark, mapping, a.tables, a.bundle)
    _, problems = _tables(spark, mapping, a.tables, a.bundle)
    if problems:
        print("\n".join(problems))
        return 1
    try:
        done = _done(spark, mapping, a.tables, a.bundle, a.feedback)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    for verdict, n in sorted(_written(done, a.out).items()):
        print(f"{verdict}: {n}")
    touched = 0 if done.integrity is None else done.integrity.where("status <> 'INCHANGE'").count()
    release(spark)
    return 1 if touched else 0


if __name__ == "__main__":
    sys.exit(main())
