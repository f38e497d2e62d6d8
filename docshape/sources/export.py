"""Schemas as JSON Schema, entity lists, CSV headers, Markdown, Spark types and result payloads."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON_TYPE = {"number": "number", "integer": "integer", "boolean": "boolean"}
_DRAFT = "https://json-schema.org/draft/2020-12/schema"
_SPARK_TYPE = {"number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType()}


def _lines(value: Column) -> Column:
    """A cluster's values in order of ``ord``; a schema's fields are few."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord"), value.alias("v")))), lambda x: x["v"])


def csv_headers(fields: DataFrame) -> DataFrame:
    """``cluster_id``, ``csv``: a header row and an example row."""
    needs = F.col("name").rlike('[,"\\n\\r]')
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    rows = fields.groupBy("cluster_id").agg(_lines(F.when(needs, quote(F.col("name"))).otherwise(F.col("name"))).alias("h"), _lines(quote(F.coalesce("example", F.lit("")))).alias("e"))
    return rows.select("cluster_id", F.concat(F.array_join("h", ","), F.lit("\n"), F.array_join("e", ","), F.lit("\n")).alias("csv"))


def markdown(fields: DataFrame) -> DataFrame:
    """``cluster_id``, ``markdown``: a table of five columns; pipes are escaped."""
    bar = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|"))
    row = F.concat(F.lit("| "), bar(F.col("name")), F.lit(" | "), F.col("type"), F.lit(" | "), F.when(F.col("required"), "Yes").otherwise("No"), F.lit(" | "), F.col("frequency").cast("decimal(18,1)").cast("string"), F.lit("% | "), bar(F.col("description")), F.lit(" |"))
    head = F.concat(F.lit("## "), F.col("cluster_id"), F.lit("\n\n| Field | Type | Required | Frequency | Description |\n" + "|---" * 5 + "|\n"))
    return fields.groupBy("cluster_id").agg(_lines(row).alias("rows")).select("cluster_id", F.concat(head, F.array_join("rows", "\n")).alias("markdown"))


def entities(fields: DataFrame) -> DataFrame:
    kind = F.when(F.col("type") == "number", "float").when(F.col("type") == "integer", "int").when(F.col("type") == "boolean", "string").otherwise(F.col("type"))
    return fields.select("cluster_id", "name", "description", kind.alias("type"), "required")


def json_schema(fields: DataFrame) -> DataFrame:
    """``cluster_id``, ``json_schema``: draft 2020-12, built in the JVM; up to five examples a field."""
    kind = F.when(F.col("type").isin(*_JSON_TYPE), F.col("type")).otherwise("string")
    one = F.when(F.coalesce("example", F.lit("")) != "", F.array("example"))
    shown = F.coalesce(F.when(F.size("examples") > 0, F.slice("examples", 1, 5)), one) if "examples" in fields.columns else one
    of = F.struct(kind.alias("type"), F.col("description"), F.when(F.col("type") == "date", "date").alias("format"), shown.alias("examples"))
    rows = fields.groupBy("cluster_id").agg(_lines(F.struct(F.col("name"), of.alias("of"))).alias("p"), F.filter(_lines(F.when(F.col("required"), F.col("name"))), lambda x: x.isNotNull()).alias("required"))
    whole = F.struct(F.lit(_DRAFT).alias("$schema"), F.col("cluster_id").alias("title"), F.lit("object").alias("type"), F.map_from_entries("p").alias("properties"), F.col("required"))
    return rows.select("cluster_id", F.to_json(whole).alias("json_schema"))


def spark_schema(fields: list[dict[str, Any]]) -> T.StructType:
    """The fields as a type for ``from_json``."""
    return T.StructType([T.StructField(f["name"], _SPARK_TYPE.get(f.get("type"), T.StringType()), True) for f in fields])


def as_dict(result: Any) -> dict[str, Any]:
    """A discovery's result: stats, clusters, schemas (fields by falling frequency), groups, shared fields, document names and clusters."""
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    return {
        "stats": result.stats, "clusters": rows(result.clusters_with_parts().orderBy("cluster_id")), "schemas": rows(result.fields.orderBy("cluster_id", F.desc("frequency"), "ord")), "groups": rows(result.groups),
        "shared": rows(result.shared), "merges": rows(result.merges), "documents": rows(result.assignments.select("name", "cluster_id").orderBy("name")),
    }


def payload(result: Any, indent: int | None = 2) -> str:
    """``as_dict`` as JSON."""
    return json.dumps(as_dict(result), indent=indent, default=str)


def demo_payload(result: Any, most: int = 500) -> dict[str, Any]:
    """What a page that shows a result needs: ``as_dict``, and of at most ``most`` documents a type their points and which fields they have."""
    shown = result.assignments.select("doc_id", "name", "cluster_id", "coord_3d")
    few = Window.partitionBy("cluster_id").orderBy("doc_id")
    points = shown.withColumn("at", F.row_number().over(few)).where(F.col("at") <= most).drop("at")
    held = result.matrix.where("present").join(points.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("fields"))
    return as_dict(result) | {"points": [r.asDict(True) for r in points.join(held, "doc_id", "left").orderBy("cluster_id", "name").collect()]}
