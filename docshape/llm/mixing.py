"""Mixing sources to target weights by entropy balancing.

Method: every source has a token constraint, the words it should give. The document
rates nearest to one (in relative entropy) that meet it are exponentially tilted,
``rate = min(most, exp(lambda_source x size / mean size))``, where the lambdas solve
a convex dual. Newton iterations find them for all sources at once, safeguarded by a
bracket; each is one aggregation over (source, size, number of documents). Rates are
then rounded into whole copies, carrying the words still owed from the longest sizes
to the shortest and then moving single copies while that helps, so that a source
misses its target by a few words where it has more than a few documents.

Plan: texts are read once and become one small written row each; everything else
runs over counts per (source, size), where a source of any number of documents has
no more rows than it has sizes. Which documents of a size get the odd copy is decided
by rank in salted groups of about ``GROUP`` documents.

Defined cases: null text has size 0 and is taken 0 times, as is any document without
words; null source is a source of its own, last; null ids stay null; repeated rows
are documents of their own; other columns are ignored (``mixed_documents`` keeps
them); very long texts are counted whole; an empty table gives no rows.
Reruns over the same rows agree: ranks depend on hashes of the rows alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshape.llm.common import drop_written, n_words, written

#: Documents of one (source, size) that are ranked together, about.
GROUP = 10_000


def source_ranks(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 in code-point order, null last: ranks inside ranges of sources, and the sizes of the ranges before."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = written(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    # One row a range, no more than there are partitions.
    before = ranged.groupBy("range").count().withColumn("before", F.sum("count").over(Window.orderBy("range")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(before, "range").withColumn("rank", F.col("before") + inside - 1).drop("range", "before")


def source_targets(sources: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """``source``, ``source_size`` -> with ``target``: by weight, at most ``most`` x its size, the excess reshared.

    A table of one row per source; weights repeat in code-point order, null last.
    """
    weight = F.array(*map(F.lit, weights))[F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")]
    table = source_ranks(sources).withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        # Sources whose limit lies below level x weight give just that; the others share what is left.
        over = F.col("limit") <= level * F.col("weight")
        n, fixed, free = table.agg(F.count_if(over), F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (share * total - (fixed or 0.0)) / free
    return table.select("source", "source_size", F.least("limit", F.lit(float(level)) * F.col("weight")).cast("double").alias("target"))


def tilted_rates(sizes: DataFrame, targets: DataFrame, *, most: float = 3.0, tolerance: float = 1e-9, rounds: int = 100) -> DataFrame:
    """Rates by (source, size): ``sizes`` has source, size, n; the result adds ``rate``.

    Distributed Newton iterations on the dual of all sources; the driver sees one number a round.
    """
    per_source = sizes.groupBy("source").agg(F.sum("n").alias("docs"))
    unit = targets.where("source_size > 0").join(per_source, targets["source"].eqNullSafe(per_source["source"])).select(targets["source"].alias("s"), "target", (F.col("source_size") / F.col("docs")).alias("mean"), "source_size")
    state = unit.withColumn("tilt", F.lit(0.0)).withColumn("low", F.lit(-1e6)).withColumn("high", F.lit(1e6)).withColumn("wrong", F.lit(1.0))
    full = F.col("target") >= most * F.col("source_size") * (1 - 1e-12)
    state = written(state.withColumn("full", full), "tilts")

    def rate(d: DataFrame) -> DataFrame:
        free = F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))
        return d.withColumn("rate", F.when(F.col("full"), most).otherwise(F.least(F.lit(most), free)))

    counted = sizes.where("size > 0")
    for _ in range(rounds):
        met = rate(counted.join(state, F.col("source").eqNullSafe(F.col("s"))))
        words = F.col("n") * F.col("size") * F.col("rate")
        sums = met.groupBy(F.col("source").alias("of")).agg(F.sum(words).alias("got"), F.sum(F.when(F.col("rate") < most, words * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"))
        seen = state.join(sums, F.col("s").eqNullSafe(F.col("of")))
        low = F.when(F.col("got") < F.col("target"), F.col("tilt")).otherwise(F.col("low"))
        high = F.when(F.col("got") > F.col("target"), F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - (F.col("got") - F.col("target")) / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        # Outside the bracket: halve it, or step away from zero geometrically while it is still wide open.
        half = F.when(F.col("high") > 1e5, 2 * F.abs(F.col("low")) + 1).when(F.col("low") < -1e5, -2 * F.abs(F.col("high")) - 1).otherwise((F.col("low") + F.col("high")) / 2)
        moved = seen.withColumn("low", low).withColumn("high", high).withColumn("wrong", F.when(F.col("full"), 0.0).otherwise(F.abs(F.col("got") - F.col("target")) / F.greatest("target", F.lit(1.0))))
        # The round that ends it still takes its step, so that sums in another order give the same rates.
        tilt = F.when(F.col("wrong") <= 1e-12, F.col("tilt")).when(inside, newton).otherwise(half)
        moved = moved.withColumn("tilt", tilt).select(*state.columns)
        following = written(moved, "tilts")
        drop_written(state)
        state = following
        if (state.agg(F.max("wrong")).first()[0] or 0.0) <= tolerance:
            break
    rated = rate(sizes.join(state, F.col("source").eqNullSafe(F.col("s")), "left"))
    return rated.select("source", "size", "n", F.round(F.when(F.col("size") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0), 6).alias("rate"), F.coalesce("target", F.lit(0.0)).alias("target"))


def settle(size: np.ndarray, copies: np.ndarray, most: np.ndarray, owed: float, rounds: int = 50) -> float:
    """Moves single copies, or one copy from one size to another, while that brings ``owed`` nearer to zero; sizes fall."""
    for _ in range(rounds):
        if not len(size) or abs(owed) < 0.5:
            break
        step = np.clip(np.rint(owed / size), -copies, most - copies).astype(np.int64)
        left = np.abs(owed - step * size)
        one = int(left.argmin())
        # For every size that can give a copy, the size nearest to what should replace it.
        taker, giver = np.flatnonzero(copies < most), np.flatnonzero(copies > 0)
        best = (np.inf, 0, 0)
        if len(taker) and len(giver):
            rising = size[taker][::-1]
            at = np.searchsorted(rising, owed + size[giver])
            for near in (np.clip(at, 0, len(rising) - 1), np.clip(at - 1, 0, len(rising) - 1)):
                gap = np.abs(owed + size[giver] - rising[near])
                k = int(gap.argmin())
                best = min(best, (float(gap[k]), int(giver[k]), int(taker[len(taker) - 1 - near[k]])))
        if min(left[one], best[0]) >= abs(owed) - 1e-9:
            break
        if left[one] <= best[0]:
            copies[one] += step[one]
            owed -= step[one] * size[one]
        else:
            copies[best[1]] -= 1
            copies[best[2]] += 1
            owed -= size[best[2]] - size[best[1]]
    return owed


def rounded_copies(rates: DataFrame, *, most: int = 3) -> DataFrame:
    """(source, size, n, rate) -> ``base`` copies of every document and ``odd``, the number of documents with one more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows[rows["size"] > 0].sort_values("size", ascending=False, kind="stable")
        size, n, rate = (rows[c].to_numpy() for c in ("size", "n", "rate"))
        copies, owed = np.zeros(len(rows), np.int64), 0.0
        for j in range(len(rows)):
            whole = n[j] * min(int(rate[j]), most)
            owed += (n[j] * rate[j] - whole) * size[j]
            extra = min(n[j] * most - whole, n[j], max(0, round(owed / size[j])))
            owed -= extra * size[j]
            copies[j] = whole + extra
        settle(size, copies, n * most, owed)
        return pd.DataFrame({"source": rows["source"], "size": size, "base": (copies // np.maximum(n, 1)).astype("int32"), "odd": copies % np.maximum(n, 1)})

    # One row per size: a source's rows are bounded by its longest document.
    return rates.groupBy("source").applyInPandas(run, "source string, size long, base int, odd long")


def copies_by_document(docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3, share: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, group: int = GROUP) -> DataFrame:
    """Per document: ``doc_id``, ``size`` (words), ``source_size``, ``target``, ``copies`` (0 to ``most``) and ``row_id``, the number in ``row_col``."""
    small = written(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col)).alias("h"),
        (F.col(row_col) if row_col else F.lit(None)).cast("long").alias("row_id"),
    ), "sizes")
    sizes = written(small.groupBy("source", "size").agg(F.count("*").alias("n")), "size_counts")
    targets = written(source_targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights=weights, most=float(most), share=share), "targets")
    copies = rounded_copies(tilted_rates(sizes, targets, most=float(most)), most=most)
    decided = written(copies.join(sizes.select(F.col("source").alias("s"), F.col("size").alias("z"), "n"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).select("s", "z", "base", "odd", F.ceil(F.col("n") / group).cast("long").alias("salts")), "copies")

    # Documents without words have no copies, and no row in ``decided``.
    wordless = small.where("size = 0").select("doc_id", "source", "size", F.lit(0).alias("copies"), "row_id")
    salted = small.where("size > 0").join(decided, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).withColumn("salt", F.pmod(F.shiftright("h", 20), F.col("salts")))
    before = salted.groupBy("s", "z", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("s", "z").orderBy("salt")) - F.col("count"))
    before = before.select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("salt").alias("salt2"), "before")
    placed = salted.join(before, F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2")) & (F.col("salt") == F.col("salt2")))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("s", "z", "salt").orderBy("h", "doc_id"))
    chosen = placed.withColumn("copies", F.col("base") + (rank <= F.col("odd")).cast("int")).select("doc_id", "source", "size", "copies", "row_id").union(wordless)
    t = targets.select(F.col("source").alias("t"), "source_size", "target")
    return chosen.join(t, F.col("source").eqNullSafe(F.col("t"))).drop("t")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The contract's columns: ``taken`` is the words that the mix takes of a document, repeats counted."""
    mixed = copies_by_document(docs, **options)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns.

    Rows are numbered in a written table, as one struct, so that no two are taken for
    one and their columns can't clash with ours.
    """
    rows = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("row_number")), "rows")
    own = rows.select("row_number", *(F.col("row").getField(c).alias(a) for c, a in ((id_col, "doc_id"), (text_col, "text"), (source_col, "source"))))
    copies = copies_by_document(own, row_col="row_number", **options).where("copies > 0").select("row_id", F.col("copies").cast("int").alias("copies"))
    met = rows.join(copies, F.col("row_number") == F.col("row_id"))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
