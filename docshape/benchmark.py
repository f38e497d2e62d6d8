"""``python -m docshape.benchmark FOLDER``: discovery on a labelled corpus, compared with its manifest by file name.

FOLDER holds ``manifest.json`` (filename, doc_type) and ``documents``.
"""

from __future__ import annotations

import json
import os
import sys
import time
from argparse import ArgumentParser
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshape.operators.metrics import clustering_metrics, report
from docshape.plans.pipeline import Discovery, discover
from docshape.plans.provider import ModelProvider
from docshape.sources.files import read_folder, read_manifest


def compared(found: Discovery, truth: DataFrame) -> DataFrame:
    """Documents that both know: ``name``, ``type_id``, ``doc_type``, ``cluster_id``."""
    return truth.join(found.assignments.select("name", "cluster_id"), "name")


def run_benchmark(spark: SparkSession, folder: str, *, provider: Any = None, min_cluster_size: int = 3) -> dict[str, Any]:
    """Clustering metrics, types and fields of a corpus."""
    began = time.time()
    found = discover(read_folder(spark, f"{folder}/documents"), provider=provider, min_cluster_size=min_cluster_size)
    met = compared(found, read_manifest(spark, f"{folder}/manifest.json"))
    metrics = clustering_metrics(met, "type_id", "cluster_id").first().asDict()
    n_fields = found.fields.groupBy("cluster_id").agg(F.count("*").alias("schema_fields"))
    clusters = found.clusters.join(n_fields, "cluster_id", "left").select("cluster_id", "name", "doc_count", F.coalesce("schema_fields", F.lit(0)).alias("schema_fields")).orderBy("cluster_id")
    return {"dataset": os.path.basename(folder.rstrip("/")), "model": found.stats["model"], "n_documents": found.stats["total_docs"], "elapsed_seconds": round(time.time() - began, 2), "clustering": metrics, "clusters": [r.asDict() for r in clusters.collect()]}


def main(arguments: Sequence[str] | None = None) -> int:
    p = ArgumentParser("docshape.benchmark", description="Compare discovered types with a manifest.")
    p.add_argument("folder")
    p.add_argument("-m", "--model", help="language model; rules without it")
    p.add_argument("-k", "--min-cluster-size", type=int, default=3)
    p.add_argument("-o", "--output", help="file for the JSON")
    args = p.parse_args(arguments)
    if not os.path.exists(f"{args.folder}/manifest.json"):
        print(f"no manifest in {args.folder}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("docshape benchmark").getOrCreate()
    result = run_benchmark(spark, args.folder, provider=ModelProvider(args.model) if args.model else None, min_cluster_size=args.min_cluster_size)
    print(report(result["clustering"]))
    for c in result["clusters"]:
        print(f"{c['cluster_id']:>4} {c['name']} ({c['doc_count']} documents, {c['schema_fields']} fields)")
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            json.dump(result, f, indent=2)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
