"""Quality of a clustering against true classes, from the contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = tuple("n n_clusters n_classes ari nmi v_measure homogeneity completeness purity".split())


def clustering_metrics(labelled: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: counts, ARI, NMI (arithmetic), V-measure, homogeneity, completeness, purity; four decimals.

    Rows are counted once into a table of (class, cluster); all else runs over that.
    """
    cells = labelled.groupBy(F.col(truth).alias("a"), F.col(predicted).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("an")), cells.groupBy("b").agg(F.sum("n").alias("bn"), F.max("n").alias("top"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    total = cells.agg(F.sum("n").alias("n"), pairs("n").alias("pairs_ab"))
    of_rows = rows.crossJoin(F.broadcast(total.select("n"))).agg(pairs("an").alias("pairs_a"), F.count("*").alias("n_classes"), F.sum(-F.col("an") / F.col("n") * F.log(F.col("an") / F.col("n"))).alias("h_a"))
    of_columns = columns.crossJoin(F.broadcast(total.select("n"))).agg(pairs("bn").alias("pairs_b"), F.count("*").alias("n_clusters"), F.sum("top").alias("top"), F.sum(-F.col("bn") / F.col("n") * F.log(F.col("bn") / F.col("n"))).alias("h_b"))
    shared = cells.withColumnRenamed("n", "ab").join(rows, "a").join(columns.drop("top"), "b").crossJoin(F.broadcast(total.select("n")))
    mutual = shared.agg(F.sum(F.col("ab") / F.col("n") * F.log(F.col("n") * F.col("ab") / (F.col("an") * F.col("bn")))).alias("mi"))
    all_ = total.crossJoin(of_rows).crossJoin(of_columns).crossJoin(mutual)  # one row each
    expected = F.col("pairs_a") * F.col("pairs_b") / (F.col("n") * (F.col("n") - 1) / 2)
    spread = (F.col("pairs_a") + F.col("pairs_b")) / 2 - expected
    h, c = F.when(F.col("h_a") == 0, 1.0).otherwise(F.col("mi") / F.col("h_a")), F.when(F.col("h_b") == 0, 1.0).otherwise(F.col("mi") / F.col("h_b"))
    v = F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c))
    ari = F.when(spread == 0, 1.0).otherwise((F.col("pairs_ab") - expected) / spread)
    r = lambda x: F.round(x, 4)
    return all_.select(F.col("n").cast("long").alias("n"), F.col("n_clusters"), F.col("n_classes"), r(ari).alias("ari"), r(v).alias("nmi"), r(v).alias("v_measure"), r(h).alias("homogeneity"), r(c).alias("completeness"), r(F.col("top") / F.col("n")).alias("purity"))


def report(metrics: dict) -> str:
    """Fixed-width text."""
    return "\n".join(f"{k:<16}{metrics[k]:>12}" for k in NAMES if k in metrics)
