"""Shared helpers: reading tables, bit filters, Arrow columns; tables that end lineage are ``docshape.storage``'s."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docshape.storage import drop_written, work_folder, written

__all__ = ["bit_filter", "drop_written", "held", "in_filter", "maybe_in", "n_words", "table", "texts", "tokenizer_path", "trim", "work_folder", "written"]
T = TypeVar("T")
#: A word: a maximal run without ASCII white space (``bytes.split()`` yields the same words).
WORD = r"[^\x20\x09-\x0D]+"


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives memory that was freed back to the system: an idle Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


_HELD: dict = {}


def held(owner: Hashable, make: Callable[[], T] = dict) -> T:
    """What an operator keeps in a Python worker between tasks; made anew when another operator had the worker.

    Workers outlive a query, and caches of one operator would crowd the next one's memory.
    """
    if owner not in _HELD:
        _HELD.clear()
        trim()
        _HELD[owner] = make()
    return _HELD[owner]


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else pa.binary()
    return [b"" if x is None else x for x in col.cast(kind).to_pylist()]


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bit_of(x: np.ndarray, bits: int) -> np.ndarray:
    return ((x.view(np.uint64) * _ODD) >> np.uint64(64 - bits)).astype(np.int64)


def bit_filter(values: DataFrame, expected: int, most_bits: int = 26) -> np.ndarray:
    """A filter of the one long column of ``values``: a bit set for the hash of each, eight bits or more a value.

    Tasks set their own bits; the driver gets at most ``2 ** (most_bits - 6)`` words, 8 MB. Where
    there are too many values for that, it lets more and more through, but is never wrong.
    """
    bits = min(most_bits, max(18, (8 * expected).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for b in batches:
            own[_bit_of(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        words = np.packbits(own, bitorder="little").view("<i8")
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used])], names=["word", "set_bits"])

    found = values.mapInArrow(run, "word int, set_bits long").groupBy("word").agg(F.bit_or("set_bits").alias("set_bits")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[found.column("word").to_numpy()] = found.column("set_bits").to_numpy()
    return out


def in_filter(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether each long may be among the values of a ``bit_filter``; true for all that are."""
    at = _bit_of(x, (len(words) * 64).bit_length() - 1)
    return (words[at >> 6] >> (at & 63)) & 1 != 0


def maybe_in(column: Column, words: np.ndarray) -> Column:
    """``in_filter`` of a column without nulls."""

    @F.pandas_udf("boolean")
    def test(x):
        import pandas as pd

        return pd.Series(in_filter(x.to_numpy(), words))

    return test(column)
