"""Seeded documents of known types, made in the JVM from hashes of their numbers: any amount, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORDS = ("left", "right", "upper", "lower", "forward", "aft", "panel", "seal", "valve", "pump", "bracket", "hose", "sensor", "bearing", "filter", "duct")


def _pick(choices: tuple[str, ...], seed: int, salt: str) -> Column:
    return F.element_at(F.array(*map(F.lit, choices)), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(choices))) + 1).cast("int"))


def _number(low: int, high: int, seed: int, salt: str) -> Column:
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(high - low)) + low).cast("string")


def _sentence(seed: int, salt: str, n: int = 12) -> Column:
    return F.concat_ws(" ", *(_pick(_WORDS, seed, f"{salt}{k}") for k in range(n)))


def fixtures(spark: SparkSession, n: int, *, seed: int = 7) -> DataFrame:
    """``doc_id``, ``name``, ``doc_type``, ``text``: ``n`` documents, of three types in turn; some fields are missing from some."""
    line = lambda k, v: F.concat(F.lit(f"{k}: "), v)
    date = F.concat(F.lit("20"), _number(18, 26, seed, "y"), F.lit("-0"), _number(1, 10, seed, "m"), F.lit("-"), _number(10, 29, seed, "d"))
    some = lambda k, v, salt: F.when(F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(5)) != 0, line(k, v))
    kinds = {
        "inspection": F.concat_ws("\n", F.lit("INSPECTION RECORD"), line("Record Number", _number(1000, 9999, seed, "r")), line("Inspection Date", date), line("Inspector", _pick(("Ada", "Ben", "Cleo", "Dana"), seed, "i")), some("Hours", _number(100, 9000, seed, "h"), "hm"), line("Finding", _sentence(seed, "f"))),
        "fault report": F.concat_ws("\n", F.lit("FAULT REPORT"), line("Report Number", _number(1000, 9999, seed, "r")), line("Reported On", date), line("Severity", _pick(("low", "medium", "high"), seed, "s")), some("Cost", F.concat(F.lit("$"), _number(50, 5000, seed, "c"), F.lit(".00")), "cm"), _sentence(seed, "t", 60)),
        "bulletin": F.concat_ws("\n", F.lit("SERVICE BULLETIN"), F.lit(""), _sentence(seed, "a", 90), F.lit(""), _sentence(seed, "b", 90), F.lit(""), line("Effective", date), some("Applies To", _pick(("series one", "series two"), seed, "p"), "pm")),
    }
    names = list(kinds)
    at = F.pmod("id", F.lit(len(names)))
    text, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(names):
        text, kind = F.when(at == i, kinds[k]).otherwise(text), F.when(at == i, k).otherwise(kind)
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.replace(kind, F.lit(" "), F.lit("_")), F.lit("_"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".txt")).alias("name"), kind.alias("doc_type"), text.alias("text"))
