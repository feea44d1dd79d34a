"""Command line: python -m graphloom TOOL [--name value ...] after optional --data files, or python -m graphloom batch FILE [--bail]."""

from __future__ import annotations

import argparse
import inspect
import json
import sys

from pyspark.sql import SparkSession

from graphloom.engine import Engine, run_batch


def value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("--data", action="append", default=[], help="RDF files to load first")
    p.add_argument("--pretty", action="store_true")
    sub = p.add_subparsers(dest="tool", required=True)
    batch = sub.add_parser("batch")
    batch.add_argument("file", help="a batch file, or - for standard input")
    batch.add_argument("--bail", action="store_true")
    for tool in Engine.tools():
        own = sub.add_parser(tool.rstrip("_").replace("_", "-"))
        own.set_defaults(tool=tool)
        for name, q in inspect.signature(getattr(Engine, tool)).parameters.items():
            if name != "self":
                own.add_argument(f"--{name.replace('_', '-')}", dest=f"arg_{name}", type=value, required=q.default is inspect.Parameter.empty, default=argparse.SUPPRESS)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark)
    for path in args.data:
        engine.load(path)
    if args.tool == "batch":
        text = sys.stdin.read() if args.file == "-" else open(args.file, encoding="utf-8").read()
        return min(1, run_batch(engine, text, args.bail))
    answer = engine.call(args.tool, **{k[4:]: v for k, v in vars(args).items() if k.startswith("arg_")})
    print(json.dumps(answer, indent=2 if args.pretty else None, default=str, ensure_ascii=False))
    return int("error" in answer)


if __name__ == "__main__":
    sys.exit(main())
