"""``python -m docshape.cli analyze PATH``: discovery on a folder, as JSON."""

from __future__ import annotations

import os
import sys
from argparse import ArgumentParser
from collections.abc import Sequence

from docshape import __version__


def parser() -> ArgumentParser:
    p = ArgumentParser("docshape", description="Discover the implicit schema of mixed documents.")
    p.add_argument("--version", action="version", version=f"docshape {__version__}")
    a = p.add_subparsers(dest="command", required=True).add_parser("analyze", help="analyze a folder or file")
    a.add_argument("path")
    a.add_argument("-m", "--model", help="language model that names the types; rules without it")
    a.add_argument("-k", "--min-cluster-size", type=int, default=3)
    a.add_argument("-o", "--output", help="file for the JSON, else standard output")
    a.add_argument("-q", "--quiet", action="store_true")
    return p


def main(arguments: Sequence[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    from docshape.sources.files import supported_files

    if not os.path.exists(args.path) or (os.path.isdir(args.path) and not supported_files(args.path)):
        print(f"docshape: nothing to read at {args.path}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from docshape.plans.pipeline import discover_folder
    from docshape.plans.provider import ModelProvider
    from docshape.sources.export import payload

    spark = SparkSession.builder.appName("docshape").getOrCreate()
    tell = None if args.quiet else lambda stage, message, percent: print(f"[{percent:.0f}%] {stage} | {message}", file=sys.stderr)
    found = discover_folder(spark, args.path, provider=ModelProvider(args.model) if args.model else None, min_cluster_size=args.min_cluster_size, on_progress=tell)
    text = payload(found)
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
