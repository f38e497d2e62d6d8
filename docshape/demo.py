"""``python -m docshape.demo OUT``: discovery on seeded documents, as the JSON that a page shows."""

from __future__ import annotations

import json
import sys
from argparse import ArgumentParser
from collections.abc import Sequence

from pyspark.sql import SparkSession

from docshape.plans.pipeline import discover
from docshape.sources.export import demo_payload
from docshape.sources.fixtures import fixtures


def main(arguments: Sequence[str] | None = None) -> int:
    p = ArgumentParser("docshape.demo", description="Discover the schema of seeded documents.")
    p.add_argument("output")
    p.add_argument("-n", type=int, default=60, help="documents")
    args = p.parse_args(arguments)
    spark = SparkSession.builder.appName("docshape demo").getOrCreate()
    shown = demo_payload(discover(fixtures(spark, args.n)))
    with open(args.output, "w", encoding="utf-8") as f:
        json.dump(shown, f, indent=2, default=str)
    print(f"{len(shown['clusters'])} types, {len(shown['schemas'])} fields in {shown['stats']['duration_s']} s", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
