"""Best-fit packing of tokenized documents into sequences of bounded length.

Method: best-two-fit. A sequence is filled greedily with the longest piece that
still fits; then its smallest piece gives way to two unpacked pieces whenever
those fit the widened gap more tightly.

Plan: one pass over the texts tokenizes them (no shuffle, whole texts only) and
writes one small row per piece to the shared folder. Pieces are then dealt out
to shards of ``shard_pieces`` and each shard is packed on its own by a
histogram of lengths, so that a task's memory is bounded, whatever ids, texts or
lengths repeat; a shard loses at most about one sequence against a global run.

Defined cases: null or empty text is the end token alone; null ids stay null;
repeated rows are packed once each; columns other than id and text are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docshape.llm.common import held, texts, written

#: Entries of a Python worker's word cache, about 100 bytes each.
CACHE = 1_000_000
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.!?;:]?)")


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level BPE vocabularies use for bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokenizer:
    """Token ids of texts, word by word, for a tokenizer that drops white space.

    Such a tokenizer's pre-tokens never span white space, so the ids of a text are
    its words' ids in a row; each worker tokenizes a word once. Words that are plain
    letters with at most one punctuation mark go to the BPE model directly, all
    others (and all added tokens) through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.alphabet = _byte_alphabet()
        self.cache: dict[bytes, bytes] = {}
        self.marks = {m: self._slow([m])[0] for m in ",.!?;:"} | {"": b""}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        return held((cls, path), lambda: cls(path))

    def _slow(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        new: dict[bytes, bytes] = {}
        rest: list[bytes] = []
        stems: dict[str, bytes] = {}
        alphabet, tokenize = self.alphabet, self.model.tokenize
        for w in words:
            if len(w) < 64 and (m := _PLAIN.fullmatch(w.decode())):
                stem = m[1].lower()
                if (ids := stems.get(stem)) is None:
                    mapped = stem if stem.isascii() else "".join(alphabet[b] for b in stem.encode())
                    ids = stems[stem] = np.array([t.id for t in tokenize(mapped)], "<u4").tobytes()
                new[w] = ids + self.marks[m[2]]
            else:
                rest.append(w)
        new.update(zip(rest, self._slow([w.decode() for w in rest])))
        return new

    def encode(self, batch: list[bytes]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        for at in range(0, len(batch), 256):
            split = [t.split() for t in batch[at : at + 256]]
            unseen = set().union(*split).difference(self.cache)
            if len(self.cache) + len(unseen) > CACHE:
                self.cache = {}
                unseen = set().union(*split)
            self.cache.update(self._learn(unseen))
            get = self.cache.__getitem__
            for words in split:
                yield b"".join(map(get, words))


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; lengths are in 1..capacity.

    Unpacked lengths are kept as a bit set, so that the longest fitting piece is one
    mask away and a pair with a given sum is found by a shifted, mirrored mask.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.argsort(lengths, kind="stable")
    sorted_lengths = lengths[order]
    stacks: dict[int, list[int]] = {}
    mask = mirror = 0
    edges = np.flatnonzero(np.diff(sorted_lengths, prepend=-1))
    for a, b in zip(edges, [*edges[1:], n]):
        size = int(sorted_lengths[a])
        stacks[size] = order[a:b][::-1].tolist()
        mask |= 1 << size
        mirror |= 1 << (capacity - size)

    def take(size: int) -> int:
        nonlocal mask, mirror
        item = stacks[size].pop()
        if not stacks[size]:
            mask ^= 1 << size
            mirror ^= 1 << (capacity - size)
        return item

    def pair(most: int, least: int) -> tuple[int, int] | None:
        """Two unpacked lengths whose sum is the largest in least..most."""
        for total in range(most, least - 1, -1):
            both = mask & (mirror >> (capacity - total))
            while both:
                a = both.bit_length() - 1
                if 2 * a != total:
                    return a, total - a
                if len(stacks[a]) > 1:
                    return a, a
                both ^= 1 << a
        return None

    number = 0
    while mask:
        gap, held = capacity, []
        while gap and (fits := mask & ((2 << gap) - 1)):
            size = fits.bit_length() - 1
            held.append((size, take(size)))
            gap -= size
        if gap and len(held) > 1 and mask:
            size, item = held[-1]  # taken last, so the smallest
            if two := pair(gap + size, size + 1):
                held.pop()
                held += [(x, take(x)) for x in two]
                if size not in stacks or not stacks[size]:
                    stacks[size] = []
                    mask |= 1 << size
                    mirror |= 1 << (capacity - size)
                stacks[size].append(item)
        at = 0
        for size, item in held:
            bins[item], offsets[item] = number, at
            at += size
        number += 1
    return bins, offsets


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def tokenized_pieces(docs: DataFrame, tokenizer: str, *, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``max_tokens``: every document's ids and ``end_id``, cut only if longer."""
    wanted = PIECES.names if with_ids else PIECES.names[:-1]
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
    end, width = np.array([end_id], "<u4").tobytes(), 4 * max_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.of(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(texts(batch))):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(schema)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, T.StructType([PIECES[c] for c in wanted]))


def pack_documents(docs: DataFrame, tokenizer: str, *, max_tokens: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, shard_pieces: int = 200_000) -> DataFrame:
    """Packs all documents into sequences of at most ``max_tokens`` tokens.

    Returns the pieces with ``sequence_id`` and their gapless ``offset`` in it
    (and their ``ids`` as little-endian unsigned 32-bit integers, if asked).
    """
    pieces = written(tokenized_pieces(docs, tokenizer, max_tokens=max_tokens, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids).withColumn("piece_key", F.monotonically_increasing_id()), "pieces")
    # The written rows' own numbers deal them out: no key of the data decides, so none can be hot.
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.select("piece_key", "length", F.pmod(F.xxhash64("piece_key"), F.lit(shards)).alias("shard"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece_key", kind="stable")
        bins, offsets = best_two_fit(rows["length"].to_numpy(), max_tokens)
        return pd.DataFrame({"piece_key": rows["piece_key"].to_numpy(), "sequence_id": bins * shards + key[0], "offset": offsets})

    placed = dealt.groupBy("shard").applyInPandas(pack, "piece_key long, sequence_id long, offset long")
    return pieces.join(placed, "piece_key").drop("piece_key")
