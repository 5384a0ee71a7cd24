"""Command line: catalog, inspect, layers, read, convert. Each prints one JSON envelope."""

from __future__ import annotations

import argparse
import json
import sys

from .errors import EdgeError, exit_code


def _options(items: list[str]) -> dict:
    out = {}
    for item in items:
        key, found, value = item.partition("=")
        if not found:
            raise EdgeError("USAGE", "an option is key=value", category="usage", phase="open")
        out[key] = value
    return out


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cartolith")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("catalog")
    for name in ("inspect", "layers", "read"):
        own = commands.add_parser(name)
        own.add_argument("path")
        own.add_argument("--option", action="append", default=[])
        if name == "read":
            own.add_argument("--layer", default="0")
            own.add_argument("--limit", type=int)
    own = commands.add_parser("convert")
    own.add_argument("source")
    own.add_argument("target")
    own.add_argument("--layer")
    own.add_argument("--option", action="append", default=[], help="of the source")
    own.add_argument("--target-option", action="append", default=[])
    return parser


def run(argv: list[str], spark=None) -> dict:
    args = build_parser().parse_args(argv)
    if args.command == "catalog":
        from .plans.catalog import catalog_json

        return json.loads(catalog_json())
    from pyspark.sql import SparkSession

    from .dataset import ReadRequest, open_dataset
    from .plans.convert import convert

    spark = spark or SparkSession.builder.appName("cartolith").getOrCreate()
    key = lambda v: int(v) if v is not None and str(v).isdigit() else v
    if args.command == "convert":
        return convert(spark, args.source, args.target, key(args.layer), source_options=_options(args.option), **_options(args.target_option))
    dataset = open_dataset(spark, args.path, **_options(args.option))
    if args.command == "inspect":
        return dataset.inspect()
    if args.command == "layers":
        return dataset.layers_summary()
    return {"schema": "read-v1", **dataset.read_summary(ReadRequest(key(args.layer), limit=args.limit))}


def main(argv: list[str] | None = None) -> int:
    try:
        print(json.dumps(run(sys.argv[1:] if argv is None else argv), sort_keys=True))
        return 0
    except EdgeError as error:
        print(json.dumps({"schema": "error-v1", "error": error.to_dict()}, sort_keys=True), file=sys.stderr)
        return exit_code(error)


if __name__ == "__main__":
    sys.exit(main())
