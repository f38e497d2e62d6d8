"""Substring dedup: sentences covered by a repeated run of sentences are removed.

Method: sliding sentence spans. From every sentence on, and up to every sentence, the
shortest run of at least ``LEAST_SENTENCES`` consecutive sentences with at least
``LEAST_WORDS`` words is hashed (each sentence of a longer repeated run lies in one of
these that the run holds too, so all runs are covered); hashes meet globally; of equal spans the first (smallest document,
then position) stays, and every sentence that any other of them covers goes. A run
depends on its own words only, so equal passages have equal runs wherever they
stand; sentences longer than ``LONG_WORDS`` are cut after the word of least hash of
every ``WINDOW`` consecutive words. Cuts that two long sentences may set apart lie
within 7 words of a stretch they share, so of a shared stretch of L words without
full stops at least L - 29 lie between equal cuts: of 51 words 22, which hold a run.
Up to 14 words at either end may stay, and a sentence of at most ``LONG_WORDS`` words
that shares only a part stays whole.

Plan: an Arrow map over whole texts emits one row of four numbers a span; hashes alone
are counted (partial sums first), a bit filter of the repeated ones leaves single spans
where they are, and one shuffle by hash brings the others together, where a window takes
their first place (it spills the rows of a frequent span). Removed spans meet their document by a hash of the row.

Defined cases: null text stays null, empty stays empty; texts shorter than a span
stay whole; repeats inside one document go as well; rows equal in id and text are
one document, the copies all cleaned alike; null ids come after all others, ordered
by row hash; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docshape.llm.common import bit_filter, maybe_in, written

LEAST_SENTENCES, LEAST_WORDS, LONG_WORDS, WINDOW = 2, 20, 24, 8
_END = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?=\s|$)|\n")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentences(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, words, hash) of each sentence with a word; ends exclude the white space that follows."""
    out = []
    at = 0
    bounds = [m.end() for m in _END.finditer(text)]
    if not bounds or bounds[-1] != len(text):
        bounds.append(len(text))
    for end in bounds:
        part = text[at:end]
        words = part.split()
        n = len(words)
        if n and n <= LONG_WORDS:
            a = at + len(part) - len(part.lstrip())
            out.append((a, at + len(part.rstrip()), n, xxhash.xxh3_64_intdigest(" ".join(words).lower())))
        elif n:
            out += _pieces(part, at)
        at = end
    return out


def _pieces(part: str, at: int) -> list[tuple[int, int, int, int]]:
    """A long sentence cut after the word of least hash (the last of equals) of every ``WINDOW`` consecutive words."""
    met = list(re.finditer(r"\S+", part))
    words = [m[0].lower() for m in met]
    hashes = np.array([zlib.crc32(w.encode()) for w in words], np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    ends = np.unique(np.arange(WINDOW, len(words) + 1) - windows.argmin(axis=1)).tolist()
    out, start = [], 0
    for end in ends if ends[-1] == len(words) else [*ends, len(words)]:
        out.append((at + met[start].start(), at + met[end - 1].end(), end - start, xxhash.xxh3_64_intdigest(" ".join(words[start:end]))))
        start = end
    return out


def spans(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(hash, first sentence, sentences) of the shortest run from each sentence on, and up to each, where the text holds one."""
    n = len(found)
    if n < LEAST_SENTENCES:
        return []
    words = np.concatenate(([0], np.cumsum([s[2] for s in found])))
    place = np.arange(n + 1)
    ends = np.maximum(np.searchsorted(words, words[:-1] + LEAST_WORDS), place[:-1] + LEAST_SENTENCES)
    starts = np.minimum(np.searchsorted(words, words[1:] - LEAST_WORDS, side="right") - 1, place[1:] - LEAST_SENTENCES)
    hashes = np.array([s[3] for s in found], np.uint64)
    runs = [(i, e) for i, e in enumerate(ends.tolist()) if e <= n]
    # A run ending at e is new unless the one from its start on is the same.
    runs += [(i, e) for e, i in enumerate(starts.tolist(), 1) if i >= 0 and ends[i] != e]
    data = hashes.tobytes()
    return [(xxhash.xxh3_64_intdigest(data[8 * i : 8 * e]) - (1 << 63), i, e - i) for i, e in runs]


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(doc, text).alias("row_key"))


def sentence_spans(own: DataFrame) -> DataFrame:
    """``span``, ``doc_id``, ``row_key``, ``covered`` (``place << 32 | length``): one row a span."""
    schema = pa.schema([("span", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("covered", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, covered, counts = [], [], []
            for text in batch.column(1).to_pylist():
                found = spans(sentences(text)) if text else []
                counts.append(len(found))
                for h, i, n in found:
                    hashes.append(h)
                    covered.append(i << 32 | n)
            of = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column(0).take(of), batch.column(2).take(of), pa.array(covered, pa.int64())], schema=schema)

    return own.select("doc_id", "text", "row_key").mapInArrow(run, "span long, doc_id long, row_key long, covered long")


def repeated_spans(found: DataFrame) -> DataFrame:
    """(row_key, places as ``place << 32 | length``) of the spans that aren't the first of their hash."""
    # Most spans occur once: their hashes are counted first, and only repeated ones move with their places.
    counted = written(found.groupBy("span").count().where("count > 1").select("span"), "repeated")
    found = found.where(maybe_in(F.col("span"), bit_filter(counted, counted.count())))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key", "covered")
    later = found.withColumn("first", F.min(order).over(Window.partitionBy("span"))).where((F.col("row_key") != F.col("first.row_key")) | (F.col("covered") != F.col("first.covered")))
    # A document's rows are bounded by its sentences.
    return later.groupBy("row_key").agg(F.collect_set("covered").alias("covered"))


def removed_spans(text: str, covered: list[int]) -> tuple[int, list[tuple[int, int]], int]:
    """Number of sentences, merged (start, end) of what goes, number of sentences that go."""
    found = sentences(text)
    gone = np.zeros(len(found) + 1, np.int64)
    for c in covered:
        gone[c >> 32] += 1
        gone[(c >> 32) + (c & 0xFFFFFFFF)] -= 1
    goes = np.cumsum(gone)[:-1] > 0
    out: list[list[int]] = []
    before = -2
    for i in np.flatnonzero(goes).tolist():
        if before == i - 1:
            out[-1][1] = found[i][1]
        else:
            out.append([found[i][0], found[i][1]])
        before = i
    return len(found), [(a, b) for a, b in out], int(goes.sum())


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the spans, and without the white space that would be left doubled."""
    if not gone:
        return text
    kept, at = [], 0
    for a, b in gone:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    out = kept[0]
    for part in kept[1:]:
        out = out + part.lstrip() if not out or out[-1].isspace() else out + part
    return out.rstrip() if gone[-1][1] >= len(text.rstrip()) else out


def dedup_sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_sentences``, ``n_removed``, ``removed`` (start:end, code points, comma-joined) and the cleaned ``text``."""
    own = _own(docs, id_col, text_col)
    covered = repeated_spans(written(sentence_spans(own), "spans")).select(F.col("row_key").alias("of_key"), "covered")
    met = own.join(covered, F.col("row_key") == F.col("of_key"), "left").select("doc_id", "text", "covered")
    schema = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, gone, k = removed_spans(text or "", places or [])
                rows.append((n, k, ",".join(f"{a}:{b}" for a, b in gone), text if text is None else without(text, gone)))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    return met.mapInArrow(run, "doc_id long, n_sentences long, n_removed long, removed string, text string")
