"""Which document has which field: extraction, chunk merging, frequency, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshape.functions.text import field_name, key_values, value_type


def extract_fields(docs: DataFrame) -> DataFrame:
    """Key-value lines of ``docs`` (cluster_id, doc_id, text): name, normal name, value, type, line and its text as ``quote``."""
    lines = docs.select("cluster_id", "doc_id", "text", F.explode(key_values(F.coalesce("text", F.lit("")))).alias("kv"))
    return lines.select("cluster_id", "doc_id", F.col("kv.line").alias("line"), F.col("kv.name").alias("name"), field_name(F.col("kv.name")).alias("norm"), F.col("kv.value").alias("value"), value_type(F.col("kv.value")).alias("type"), F.substring(F.concat("kv.name", F.lit(": "), "kv.value"), 1, 200).alias("quote")).where("norm <> ''")


def merge_chunks(found: DataFrame, keys: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """One row per ``keys``, document and field, of (doc_id, field, chunk, present, grounded, quote, value).

    The first present chunk gives value and quote, a later one fills a missing value; the
    last one that is grounded and quotes gives the quote.
    """
    sure = F.col("grounded") & (F.coalesce("quote", F.lit("")) != "")
    return found.where("present").groupBy(*keys).agg(
        F.coalesce(F.max_by("quote", F.when(sure, F.col("chunk"))), F.min_by("quote", "chunk")).alias("quote"),
        F.min_by("value", F.when(F.coalesce("value", F.lit("")) != "", F.col("chunk"))).alias("value"),
        (F.coalesce(F.bool_or(sure), F.lit(False)) | F.coalesce(F.min_by("grounded", "chunk"), F.lit(False))).alias("grounded"),
    )


def field_frequency(docs: DataFrame, found: DataFrame, *, required: float = 80.0) -> DataFrame:
    """Per cluster and field: documents that hold it, those that also quote it (``grounded_count``), their share in percent (one decimal), whether it is required.

    A document counts once, whatever its lines; both steps are pre-aggregated in each task.
    """
    total = docs.groupBy("cluster_id").agg(F.count("*").alias("n_docs"))
    quoted = F.coalesce(F.col("quote"), F.lit("")) != ""
    sure = (F.col("grounded") & quoted) if "grounded" in found.columns else quoted
    once = found.groupBy("cluster_id", "norm", "doc_id").agg(F.max(F.coalesce(sure, F.lit(False))).alias("sure"))
    held = once.groupBy("cluster_id", "norm").agg(F.count("*").alias("doc_count"), F.count_if("sure").alias("grounded_count"))
    share = F.round(F.least(F.col("doc_count") * 100.0 / F.col("n_docs"), F.lit(100.0)), 1)
    return held.join(total, "cluster_id").select("cluster_id", F.col("norm").alias("name"), "doc_count", "grounded_count", "n_docs", share.alias("frequency")).withColumn("required", F.col("frequency") >= required)


def presence_matrix(docs: DataFrame, fields: DataFrame, found: DataFrame) -> DataFrame:
    """A row for every document (cluster_id, doc_id) and field (cluster_id, name) of its cluster: ``present``, ``quote``."""
    once = found.groupBy("cluster_id", "doc_id", F.col("norm").alias("name")).agg(F.min("quote").alias("quote"), F.lit(True).alias("found"))
    cells = docs.select("cluster_id", "doc_id").join(fields.select("cluster_id", "name").distinct(), "cluster_id")
    return cells.join(once, ["cluster_id", "doc_id", "name"], "left").select("cluster_id", "doc_id", "name", F.coalesce("found", F.lit(False)).alias("present"), "quote")


def coverage(frequency: DataFrame) -> DataFrame:
    """Per cluster: fields, and the share of (field, document) cells that are filled, in percent."""
    return frequency.groupBy("cluster_id").agg(F.count("*").alias("n_fields"), F.round(F.sum("doc_count") * 100.0 / (F.count("*") * F.max("n_docs")), 1).alias("coverage"))
