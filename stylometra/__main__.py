"""Command line: list the registered queries, print the SQL of one, run some over a folder of tables, or run the stages of the workflow."""

from __future__ import annotations

import argparse
import sys
import time


def staged(given) -> int:
    from . import workflow

    if given.command == "stages":
        for k, stage in enumerate(workflow.STAGES, 1):
            print(f"{k} {stage.name}: {', '.join(stage.outputs)}; {', '.join(f'{n}={v}' for n, v in stage.parameters.items()) or 'no parameters'}")
        for name in ("MODELS", "TRANSFORMS", "SCENARIOS"):
            print(f"{name.lower()}: {', '.join(getattr(workflow, name))}")
        return 0
    chosen: dict[str, dict] = {}
    try:
        for item in given.set:
            (stage, _, name), value = item.partition("=")[0].partition("."), item.partition("=")[2]
            chosen.setdefault(stage, {})[name] = value
        for stage in workflow.STAGES:
            workflow.settings(stage, chosen.get(stage.name, {}))
        if unknown := set(chosen) - {s.name for s in workflow.STAGES}:
            raise ValueError(f"no stage is named {', '.join(sorted(unknown))}")
        if not given.snapshot and not given.tables:
            raise ValueError("--tables is needed to run stages")
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("stylometra").getOrCreate()
    if given.snapshot:
        print(f"{workflow.snapshot(spark, given.out)} outputs recorded")
        return 0
    workflow.run(spark, given.tables, given.out, given.start, given.to, chosen)
    try:
        for r in workflow.compared(spark, given.out).orderBy("output").collect():
            print(f"{r['output']}: {r['status']}")
    except FileNotFoundError as none:
        print(none)
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m stylometra", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the registered queries, with * where there is SQL to compare with")
    sql = commands.add_parser("sql", help="the SQL of a query")
    sql.add_argument("query")
    run = commands.add_parser("run", help="run queries; write each as Parquet or CSV, or show its first rows")
    run.add_argument("query", nargs="+")
    run.add_argument("--tables", required=True, help="folder of Parquet tables")
    run.add_argument("--out", help="folder for results; without it they are shown")
    run.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    flow = commands.add_parser("pipeline", help="run the stages, from one of them on, and compare the outputs with a snapshot; or take the snapshot")
    flow.add_argument("--tables", help="folder of Parquet tables")
    flow.add_argument("--out", required=True, help="folder of the stages' outputs")
    flow.add_argument("--snapshot", action="store_true", help="record the outputs that are there")
    flow.add_argument("--from", dest="start", type=int, default=1, help="number of the first stage to run")
    flow.add_argument("--to", type=int, help="number of the last")
    flow.add_argument("--set", action="append", default=[], metavar="STAGE.NAME=VALUE", help="a parameter of a stage; lists by commas")
    commands.add_parser("stages", help="the stages with their outputs and parameters, and named models, transforms and scenarios")
    given = parser.parse_args(argv)

    if given.command in ("pipeline", "stages"):
        return staged(given)
    from .plans import registry

    if given.command == "list":
        print(*[f"{n}{' *' if n in registry.ORACLE_SQL else ''}" for n in sorted(registry.QUERIES)], sep="\n")
        return 0
    names = [given.query] if given.command == "sql" else given.query
    if unknown := [n for n in names if n not in registry.QUERIES]:
        print(f"no such query: {', '.join(unknown)}", file=sys.stderr)
        return 2
    if given.command == "sql":
        print(registry.ORACLE_SQL.get(given.query, "-- none"))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("stylometra").getOrCreate()
    for name in names:
        begin, out = time.time(), registry.QUERIES[name](spark, given.tables)
        if given.out:
            writer = out.write.mode("overwrite")
            path = f"{given.out.rstrip('/')}/{name}"
            writer.parquet(path) if given.format == "parquet" else writer.option("header", True).csv(path)
        else:
            out.show(given.rows, truncate=False)
        print(f"{name}: {time.time() - begin:.1f} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
