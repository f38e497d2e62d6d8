"""Types and fields of a few strings, and their JSON Schemas: ``python examples/quickstart.py``."""

from pyspark.sql import SparkSession

from docshape.plans.pipeline import discover_from_strings
from docshape.sources.export import json_schema

spark = SparkSession.builder.master("local[*]").getOrCreate()
texts = [f"INVOICE\nInvoice Number: {i}\nTotal: ${i * 10}.00\nDue Date: 2024-01-{i + 10}" for i in range(12)]
texts += [f"MEMO\nFrom: person {i}\n" + "please read this before the meeting on the plan " * 5 for i in range(13)]
found = discover_from_strings(spark, texts)
found.clusters.select("name", "doc_count").show()
found.fields.select("cluster_id", "name", "type", "frequency", "group").show()
for row in json_schema(found.fields).collect():
    print(row.json_schema)
