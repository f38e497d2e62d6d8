"""Field counts kept up to date over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docshape.operators.presence import extract_fields


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id long, cluster_id string, text string, ts timestamp", *, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_field_counts(docs: DataFrame, *, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Documents per field and event-time window; a repeated (document, field) counts once, state older than ``late`` goes."""
    found = extract_fields(docs).join(docs.select("doc_id", F.col(time_col).alias("event_time")), "doc_id") if not docs.isStreaming else _stream_fields(docs, time_col)
    once = found.withWatermark("event_time", late).dropDuplicates(["doc_id", "norm", "event_time"])
    return once.groupBy(F.window("event_time", window).alias("w"), "cluster_id", "norm").agg(F.count("*").alias("doc_count")).select(F.col("w.start").alias("window_start"), "cluster_id", F.col("norm").alias("field"), "doc_count")


def _stream_fields(docs: DataFrame, time_col: str) -> DataFrame:
    from docshape.functions.text import field_name, key_values

    lines = docs.select("cluster_id", "doc_id", F.col(time_col).alias("event_time"), F.explode(key_values(F.coalesce("text", F.lit("")))).alias("kv"))
    return lines.select("cluster_id", "doc_id", "event_time", field_name(F.col("kv.name")).alias("norm")).where("norm <> ''")


def keep_totals(docs: DataFrame, path: str, checkpoint: str):
    """A running query: each micro-batch's (cluster, field) counts are written under its number, so a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        found = extract_fields(df).select("cluster_id", "norm", "doc_id").distinct()
        found.groupBy("cluster_id", "norm").agg(F.count("*").alias("doc_count")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("cluster_id", "norm").agg(F.sum("doc_count").alias("doc_count"))
