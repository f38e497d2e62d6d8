"""Exact n-gram Jaccard self-join of documents, all links and components.

Method: grouped prefix join. Every set's shingles are ordered from rare to frequent
by their exact document frequency; two sets that reach the threshold share a
shingle of their prefixes, and enough of both follows the first such. Sets of identical prefix and size are collapsed into one
group; group pairs that share a prefix shingle and pass the length and position
filters are candidates; then groups are expanded and their members verified.

Plan, per pass:

1. Texts become (doc, set key, size); sets that are equal share a key, so copies,
   however many, are one set from here on. Shingles that are frequent inside blocks
   of documents are summed; the ``HOT`` most frequent (a fixed bound) are known to
   all tasks, come last in the order and are never gathered by shingle.
2. Texts again: shingles go to buckets as packed arrays (6 bytes a shingle), a block
   sends each set once. A bucket counts exact frequencies, drops shingles that
   occur in one set (no pair can share them) and sends the rest back by set.
3. Each set orders its shingles and takes its prefix; sets whose prefix holds only
   unique shingles end here. Sets with the same shared shingles and size are one
   *class*: whatever a member links with, all do, so pages of one template with
   tails of their own are verified once and counted by multiplication.
4. Groups of classes are joined on prefix shingles by a sort-merge self-join.
   Shingles that no set has in its index prefix (the part where a smaller set can
   first meet a larger one) are left out by a bit filter. A pair is emitted only
   where the shingle *before* the common one differs: otherwise the pair was emitted
   there already. Pairs of a shingle of more than ``FREQUENT`` groups are never
   listed: its groups are dealt to a grid of cells, and a cell counts the pairs
   whose first common shingle it is. Large groups are cut into blocks likewise.
5. Candidate pairs are binned near their neighbours, each cell gets its classes once
   (a bit filter leaves classes without candidates behind), and intersections are
   counted by array look-ups. A cell returns one row a class: the number of documents
   it links with and a class of its component, never the links themselves.

Nothing is sampled, capped or dropped, and the number of tasks grows with the work.
Sets are told apart by 64-bit keys that a second hash checks (two sets of one key
start the first pass anew), classes by 128 bits, shingles by 64 bits (48 and their
bucket after the first pass).

Defined cases: null or empty text, or text without words, has an empty set, no links
and is its own component; fewer words than ``size`` make one shingle; equal texts
link with each other; null ids stay null (and give null components where all ids of
a component are null); repeated rows count as other documents; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docshape.llm.common import bit_filter, drop_written, held, in_filter, maybe_in, texts, trim, written
from docshape.llm.components import connected_components

#: Most frequent shingles known to all tasks; least share of a block's sets, and least number, to be reported.
HOT, HOT_SHARE, HOT_LEAST = 65_536, 1 / 512, 8
#: Shingles of a block; of a bucket, about; entries of the word memo.
BLOCK, BUCKET, MEMO = 750_000, 6_000_000, 250_000
#: Parts of a bucket's shingles that are sorted, and of its sets that are sent, one at a time.
SLICES = 8
#: Rows of (class, cell), of about 60 bytes, that are sent to all tasks at most.
FEW = 200_000
#: Groups of a prefix shingle beyond which its pairs aren't listed but dealt to a grid of cells.
FREQUENT = 1000
#: A class weighs one, and one more for so many shared shingles. Weight of a block of a group's members, of a cell's side, and (squared) of a task's pairs.
WEIGHT, ATOM, SIDE, BIN_WORK = 256, 400, 3000, 400_000
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_LOW48 = np.uint64((1 << 48) - 1)
_SALT = np.uint64(0x5851F42D4C957F2D)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.empty(0, np.uint64)
        memo = self.memo
        try:
            h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(memo) > MEMO:
                memo.clear()
            for w in set(words):
                if w not in memo:
                    memo[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(h) - self.size + 1)
        x = np.full(n, min(len(h), self.size), np.uint64)
        for k in range(min(len(h), self.size)):
            x = (x ^ h[k : k + n]) * _K[0]
            x ^= x >> np.uint64(29)
            x *= _K[2]
            x ^= x >> np.uint64(32)
        return np.unique(x)


def set_key(shingles: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed) - (1 << 63)


def _check(shingles: np.ndarray) -> int:
    """Another hash of a set, by which two sets of one key are noticed."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 1) - (1 << 63)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, block: int, seed: int) -> Iterator[tuple[list, list[int], list[np.ndarray]]]:
    """Ids, keys and sets of runs of documents with about ``BLOCK`` shingles."""
    held("jaccard")
    shingle = Shingler(size)
    ids, keys, sets, total = [], [], [], 0
    for batch in batches:
        for at in range(0, len(batch), 256):
            few = batch.slice(at, 256)
            for doc, text in zip(few.column(0).to_pylist(), texts(few)):
                s = shingle(text)
                ids.append(doc)
                sets.append(s)
                keys.append(set_key(s, seed))
                total += len(s)
                if total >= block:
                    yield ids, keys, sets
                    ids, keys, sets, total = [], [], [], 0
                    trim()
    if ids:
        yield ids, keys, sets


def _first_of_each(keys: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    first = {k: i for i, k in reversed(list(enumerate(keys))) if len(sets[i])}
    return np.array(list(first), np.int64), [sets[i] for i in first.values()]


def _pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _pack_counts(x: np.ndarray) -> bytes:
    """Two bytes each where they do, else four; the reader tells by the length."""
    return x.astype("<u2" if not len(x) or x.max() < 1 << 16 else "<u4").tobytes()


def _unpack_counts(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, "<u2" if len(b) == 2 * n else "<u4")


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, which compresses the high bytes away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _runs(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    if not len(owner):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(owner)])))


def document_sets(docs: DataFrame, size: int, block: int, hot_least: int, seed: int) -> DataFrame:
    """Rows of documents (``kind`` 0: doc_id, key, n, check) and of frequent shingles (``kind`` 1: key, n)."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("check", pa.int64())])

    def rows_of(ids: list, keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        _, own = _first_of_each(keys, sets)
        token, count = np.unique(np.concatenate(own) if own else np.empty(0, np.uint64), return_counts=True)
        hot = count >= max(hot_least, HOT_SHARE * len(own))
        k, h = len(ids), int(hot.sum())
        return pa.RecordBatch.from_arrays([
            pa.array(np.repeat([0, 1], [k, h]), pa.int32()), pa.array(ids + [None] * h, pa.int64()),
            pa.array(np.concatenate((np.array(keys, np.int64), token[hot].view(np.int64)))), pa.array(np.concatenate((np.array([len(s) for s in sets], np.int64), count[hot]))),
            pa.array([_check(s) for s in sets] + [None] * h, pa.int64()),
        ], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block_ in _blocks(batches, size, block, seed):
            yield rows_of(*block_)
        block_ = None
        trim()  # an idle worker keeps nothing

    return docs.mapInArrow(run, "kind int, doc_id long, key long, n long, check long")


_ROWS = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("dfs", pa.binary())])
_ROWS_DDL = "bucket int, keys binary, counts binary, tokens binary, dfs binary"


def bucketed_shingles(docs: DataFrame, size: int, block: int, hot: np.ndarray, buckets: int, parts: int, seed: int) -> DataFrame:
    """Per block and bucket its sets' shingles; above ``buckets``, by part, the sets' sizes, copies and hot shingles (as ranks)."""
    by_value = np.argsort(hot)
    sorted_hot = hot[by_value]

    def rows_of(keys: list[int], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        key, own = _first_of_each(keys, sets)
        if not own:
            return None
        lengths = np.array([len(s) for s in own])
        number = Counter(keys)
        copies = np.array([number[k] for k in key.tolist()])
        token, owner = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), lengths)
        at = np.minimum(np.searchsorted(sorted_hot, token), max(0, len(sorted_hot) - 1))
        is_hot = sorted_hot[at] == token if len(sorted_hot) else np.zeros(len(token), bool)
        rows: list[tuple] = []
        cold, cold_owner = token[~is_hot], owner[~is_hot]
        bucket = ((cold >> np.uint64(48)) ^ (cold * _K[1] >> np.uint64(32))) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        starts, sizes = _runs(bucket[order])
        for s, n in zip(starts, sizes):
            o = order[s : s + n]
            a, c = _runs(cold_owner[o])
            rows.append((int(bucket[o[0]]), key[cold_owner[o][a]].tobytes(), _pack_counts(c), _pack(cold[o], 6), b""))
        rank = by_value[at[is_hot]] if is_hot.any() else np.empty(0, np.int64)
        n_hot = np.bincount(owner[is_hot], minlength=len(own))
        ends = np.cumsum(n_hot)
        part = key % parts
        for p in np.unique(part):
            of = np.flatnonzero(part == p)
            ranks = np.concatenate([rank[ends[i] - n_hot[i] : ends[i]] for i in of])
            rows.append((buckets + int(p) % sizes_at(buckets), key[of].tobytes(), _pack_counts(n_hot[of]), ranks.astype("<u2").tobytes(), np.stack((lengths[of], copies[of])).astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, sets in _blocks(batches, size, block, seed):
            rows = rows_of(keys, sets)
            if rows is not None:
                yield rows
        keys = sets = rows = None
        trim()

    return docs.mapInArrow(run, _ROWS_DDL)


def sizes_at(buckets: int) -> int:
    """Numbers above ``buckets`` that rows of sizes, which only pass through, are dealt to."""
    return max(1, buckets // 4)


def _joined(table: pa.Table | pa.RecordBatch, name: str) -> list[bytes]:
    return table.column(name).to_pylist()


def count_frequencies(bucket_rows: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Per bucket and part: the shingles found in two sets or more, by set; rows of sizes pass through."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = key[0].as_py()
        if b >= buckets:
            for batch in filter(len, batches):
                yield _batch([(int(np.frombuffer(r[0], np.int64, 1)[0] % parts), -1, *r) for r in zip(*(_joined(batch, c) for c in ("keys", "counts", "tokens", "dfs")))])
        else:
            held("jaccard")
            yield from _counted(b, batches)
        trim()

    def _counted(b: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A slice of the shingles at a time is sorted, and a slice of the sets is sent; nothing else is held twice.
        keys, n_keys, tokens, places = [], 0, [[] for _ in range(SLICES)], [[] for _ in range(SLICES)]
        for batch in filter(len, batches):
            for k, c, t in zip(*(map(pa.BinaryScalar.as_buffer, batch.column(x)) for x in ("keys", "counts", "tokens"))):
                k = np.frombuffer(k, np.int64).copy()
                place = np.repeat(np.arange(n_keys, n_keys + len(k), dtype=np.uint32), _unpack_counts(c, len(k)))
                t = _unpack(t, 6)
                slice_ = (t % np.uint64(SLICES)).astype(np.uint8)
                order = np.argsort(slice_, kind="stable")
                ends = np.cumsum(np.bincount(slice_, minlength=SLICES))[:-1]
                for x, own in ((tokens, t), (places, place)):
                    for into, piece in zip(x, np.split(own[order], ends)):
                        into.append(piece.copy())
                keys.append(k)
                n_keys += len(k)
            del k, c, t  # views of the batch
        del batch
        known, own = np.unique(np.concatenate(keys), return_inverse=True)
        own = own.astype(np.uint32)
        del keys, order, slice_, place, piece
        trim()
        part = (known % parts).astype(np.int64)
        group = (part * SLICES // parts).astype(np.uint8)
        dfs, found = [], 0
        numbers, owners = ([[] for _ in range(SLICES)] for _ in range(2))
        for slice_ in range(SLICES):
            t, o = np.concatenate(tokens[slice_]), own[np.concatenate(places[slice_])]
            tokens[slice_] = places[slice_] = None
            order = np.lexsort((o, t))
            t, o = t[order], o[order]
            new = np.concatenate(([True], t[1:] != t[:-1]))[: len(t)]
            fresh = new.copy()
            fresh[1:] |= o[1:] != o[:-1]
            o = o[fresh]
            starts = np.flatnonzero(new[fresh])
            df = np.diff(np.concatenate((starts, [len(o)])))
            shared = df > 1
            o = o[np.repeat(shared, df)]
            number = np.repeat(np.arange(found, found + int(shared.sum()), dtype=np.int32), df[shared])
            order = np.argsort(group[o], kind="stable")
            ends = np.cumsum(np.bincount(group[o], minlength=SLICES))[:-1]
            for x, entries in ((numbers, number), (owners, o)):
                for into, piece in zip(x, np.split(entries[order], ends)):
                    into.append(piece.copy())
            dfs.append(df[shared])
            found += len(dfs[-1])
        del t, o, order, new, fresh, number, entries, piece, own
        trim()
        df = np.concatenate(dfs)
        # Shared shingles are numbered by frequency, so the numbers alone give the order inside a bucket.
        by_df = np.argsort(df, kind="stable")
        rank = np.empty(found, np.uint64)
        rank[by_df] = np.arange(found)
        values, first = np.unique(df[by_df], return_index=True)
        steps = np.stack((first, values)).astype("<u4").tobytes()
        width = 3 if found < 1 << 24 else 4
        del dfs, df, by_df
        by_part = np.argsort(part, kind="stable")
        known, part = known[by_part], part[by_part]
        at = np.empty(len(known), np.uint64)
        at[by_part] = np.arange(len(known))
        for g in range(SLICES):
            both = at[np.concatenate(owners[g])] << np.uint64(32) | rank[np.concatenate(numbers[g])]
            owners[g] = numbers[g] = None
            both.sort()
            owner, number = (both >> np.uint64(32)).astype(np.int64), both & np.uint64((1 << 32) - 1)
            rows = []
            for s, n in zip(*_runs(part[owner])):
                a, c = _runs(owner[s : s + n])
                rows.append((int(part[owner[s]]), b, known[owner[s : s + n][a]].tobytes(), _pack_counts(c), _pack(number[s : s + n], width), steps))
            del both, owner, number
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "bucket", "keys", "counts", "tokens", "dfs"])

    # A task for each bucket, so that none has two.
    return bucket_rows.repartitionById(buckets + sizes_at(buckets), F.col("bucket")).groupBy("bucket").applyInArrow(run, "part int, bucket long, keys binary, counts binary, tokens binary, dfs binary")


def prefix_length(n: int, percent: int) -> int:
    """Shingles of a set of n of which one is shared with any set that reaches the threshold."""
    return n - -(-percent * n // 100) + 1


def prefixes(returned: DataFrame, percent: int, parts: int) -> DataFrame:
    """Per set with a shared shingle in its prefix: key, copies, n, n_shared, its group and class, prefix and all its shared shingles (``shared``).

    Sets of one class have the same shared shingles and size, so all of them meet any other set alike.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        owners, tokens, dfs, sizes, copies = [], [], [], {}, {}
        for b, k, c, t, d in zip(*(_joined(table, x) for x in ("bucket", "keys", "counts", "tokens", "dfs"))):
            k = np.frombuffer(k, np.int64)
            c = _unpack_counts(c, len(k))
            owners.append(np.repeat(k, c))
            if b < 0:
                length, number = np.frombuffer(d, "<u4").reshape(2, -1).tolist()
                sizes.update(zip(k.tolist(), length))
                for own, more in zip(k.tolist(), number):
                    copies[own] = copies.get(own, 0) + more
                rank = np.frombuffer(t, "<u2").astype(np.uint64)
                tokens.append(rank)
                dfs.append(rank.astype(np.int64) + (1 << 40))  # after all others
            else:
                number = _unpack(t, len(t) // int(c.sum()))
                first, value = np.frombuffer(d, "<u4").astype(np.int64).reshape(2, -1)
                tokens.append(number | np.uint64(b + 1) << np.uint64(32))
                dfs.append(value[np.searchsorted(first, number.astype(np.int64), side="right") - 1])
        owner, token, df = np.concatenate(owners), np.concatenate(tokens), np.concatenate(dfs)
        order = np.lexsort((token, df, owner))
        owner, token = owner[order], token[order]
        if len(owner):  # a set that several blocks sent has its hot shingles from each
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])))
            owner, token = owner[fresh], token[fresh]
        del owners, tokens, dfs, df, order
        trim()
        rows = []
        for s, m in zip(*_runs(owner)):
            k = int(owner[s])
            n = sizes[k]
            need = prefix_length(n, percent) - (n - int(m))
            if need > 0:
                own = token[s : s + m]
                prefix = own[:need]
                size = n.to_bytes(8, "little")
                group = xxhash.xxh3_64_intdigest(prefix.tobytes() + size) - (1 << 63)
                of_class = xxhash.xxh3_128_digest(own.tobytes() + size)
                rows.append((k, copies[k], n, int(m), group, of_class, prefix.astype(np.int64), planes(own)))
        columns = list(zip(*rows)) if rows else [[]] * 8
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "copies", "n", "n_shared", "group_id", "class_id", "prefix", "shared"])

    return returned.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(run, "key long, copies long, n long, n_shared long, group_id long, class_id binary, prefix array<long>, shared binary")


def classes_of(sets: DataFrame) -> DataFrame:
    """Per class: its smallest key ``rep``, its ``docs``, size, group, whether it ``leads`` it, the group's ``members``, its ``blocks`` and their ``weight``, and its own block (``atom``)."""
    classes = sets.groupBy("class_id").agg(F.min("key").alias("rep"), F.sum("copies").alias("docs"), *(F.min(c).alias(c) for c in ("group_id", "n", "n_shared")))
    weight = 1 + F.floor(F.col("n_shared") / WEIGHT)
    groups = classes.groupBy("group_id").agg(F.count("*").alias("members"), F.ceil(F.sum(weight) / ATOM).cast("int").alias("blocks"), F.sum(weight).alias("of_group"), F.min("rep").alias("first"))
    own = atom(F.col("group_id"), F.pmod(F.xxhash64("rep"), F.col("blocks")))
    return classes.join(groups, "group_id").select("class_id", "rep", "docs", "n", "n_shared", "group_id", (F.col("rep") == F.col("first")).alias("leads"), "blocks", "members", (F.col("of_group") / F.col("blocks")).alias("weight"), own.alias("atom"))


def atom(group: Column, block: Column) -> Column:
    """A block of a group's members, which no task holds more of than one at a time."""
    return F.xxhash64(group, block.cast("int"))


def _exploded(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of (group_id, n, n_shared, prefix) each shingle's row, itself, the one before it (-1: none), the set's size, what it has from there on."""
    prefix = batch.column(3)
    lengths = prefix.value_lengths().to_numpy()
    of = np.repeat(np.arange(len(batch)), lengths)
    token = prefix.flatten().to_numpy()
    at = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    before = np.where(at == 0, -1, np.concatenate(([-1], token[:-1])) if len(token) else token)
    n = batch.column(1).to_numpy()[of]
    return of, token, before, n, batch.column(2).to_numpy()[of] - at


class Leads:
    """Tells which sets may lead their group; all leads pass, and few others. Both filters are small where few groups have several classes."""

    def __init__(self, classes: DataFrame) -> None:
        several = classes.where("leads and members > 1").select("group_id")
        self.several = bit_filter(several, several.count())
        first = classes.where(F.col("leads") & maybe_in(F.col("group_id"), self.several)).select("rep")
        self.first = bit_filter(first, first.count())

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of (group_id, n, n_shared, prefix, key) that may lead."""
        return batch.filter(pa.array(~in_filter(batch.column(0).to_numpy(), self.several) | in_filter(batch.column(4).to_numpy(), self.first)))


def index_filter(sets: DataFrame, leads: Leads, percent: int, expected: int) -> np.ndarray:
    """Shingles that can be a pair's first common one in its smaller set, whose prefix is shorter: few sets have any."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, token, _, n, rest = _exploded(leads.of(batch))
            yield pa.RecordBatch.from_arrays([pa.array(token[(100 + percent) * rest >= 2 * percent * n])], names=["token"])

    return bit_filter(sets.select("group_id", "n", "n_shared", "prefix", "key").mapInArrow(tokens, "token long"), expected)


def postings(sets: DataFrame, leads: Leads, index: np.ndarray) -> DataFrame:
    """Prefix shingles that some set may have in its index prefix: group_id, n, token, before, rest (a few of them twice)."""
    names = ["group_id", "n", "token", "before", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = leads.of(whole)
            of, token, before, n, rest = _exploded(batch)
            keep = np.flatnonzero(in_filter(token, index))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[keep])), *(pa.array(x[keep]) for x in (n, token, before, rest))], names=names)

    return sets.select("group_id", "n", "n_shared", "prefix", "key").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def group_pairs(rows: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of groups that meet in a shingle of at most ``FREQUENT`` groups: a posting meets no more than so many."""
    rare = rows.join(frequent.select("token"), "token", "left_anti")
    a, b = rare.alias("a"), rare.alias("b")
    return a.join(
        b,
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.group_id") < F.col("b.group_id"))
        & ((F.col("a.before") != F.col("b.before")) | (F.col("a.before") == -1))
        & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
        & ((100 + percent) * F.least("a.rest", "b.rest") >= percent * (F.col("a.n") + F.col("b.n"))),
    ).select(F.col("a.group_id").alias("group_id_a"), F.col("b.group_id").alias("group_id_b")).distinct()


def atom_pairs(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """Group pairs, and every group of several classes beside itself, as pairs of their blocks: a, b, and the pair's work."""
    numbers = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    weight = lambda s: F.col(f"weight_{s}").alias(f"weight_{s}")
    of = lambda s: classes.where("leads").select(*(F.col(c).alias(f"{c}_{s}") for c in ("group_id", "blocks", "weight")))
    apart = groups.join(of("a"), "group_id_a").join(of("b"), "group_id_b").withColumn("i", numbers("blocks_a")).withColumn("j", numbers("blocks_b"))
    apart = apart.select(atom(F.col("group_id_a"), F.col("i")).alias("a"), atom(F.col("group_id_b"), F.col("j")).alias("b"), weight("a"), weight("b"))
    # Inside a group all pairs are candidates: same prefix, same size.
    alone = classes.where("leads and members > 1").select("group_id", "blocks", F.col("weight").alias("weight_a"), F.col("weight").alias("weight_b")).withColumn("i", numbers("blocks"))
    alone = alone.withColumn("j", F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)))
    return apart.union(alone.select(atom(F.col("group_id"), F.col("i")).alias("a"), atom(F.col("group_id"), F.col("j")).alias("b"), weight("a"), weight("b")))


def pair_cells(pairs: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Where each pair of blocks is verified (ship_to, a, b), and which block goes where (ship_to, atom)."""
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight_b").alias("weight_a"), F.col("weight_a").alias("weight_b"))
    ends = pairs.unionByName(turned)
    # Pairs of one neighbourhood share a cell; where its sets have many partners it is a grid of cells.
    near = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("place"), F.ceil(F.sum("weight_b") / SIDE).alias("side"))
    cell = F.xxhash64("place", F.pmod(F.xxhash64("a"), "side"), F.pmod(F.xxhash64("b"), "side"))
    placed = pairs.join(near, "a").select(F.pmod(cell, F.lit(4 * tasks)).alias("ship_to"), "a", "b")
    return placed, placed.select("ship_to", F.col("a").alias("atom")).union(placed.select("ship_to", F.col("b").alias("atom"))).distinct()


def frequent_cells(rows: DataFrame, frequent: DataFrame, classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Shingles of very many groups, whose pairs are never listed: cells (ship_to, token, alone) and what goes there (ship_to, atom, before, half).

    A shingle's groups are told apart by size class (only neighbours can link) and by
    the shingle before it, where many have that one in common: such groups have met
    there already. What is left is dealt to strips of weight ``SIDE``; a cell is two
    strips, or one and itself.
    """
    met = rows.join(frequent.select("token"), "token").select("token", "group_id", "n", "before").distinct().join(classes.where("leads").select("group_id", "blocks", "weight"), "group_id")
    spread = met.withColumn("atom", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: atom(F.col("group_id"), k))))
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    spread = spread.select("token", level.alias("level"), "before", "atom", "weight")
    common = spread.groupBy("token", "before").agg(F.sum("weight").alias("w")).where((F.col("w") > SIDE) & (F.col("before") != -1)).select(F.col("token").alias("t"), F.col("before").alias("b"))
    spread = spread.join(common, (F.col("token") == F.col("t")) & (F.col("before") == F.col("b")), "left").select("token", "level", "before", F.col("b").alias("lot"), "atom", "weight")
    strips = spread.groupBy("token", "level", "lot").agg(F.ceil(F.sum("weight") / SIDE).cast("int").alias("strips"))
    of = lambda s: strips.select(F.col("token").alias(f"token_{s}"), F.col("level").alias(f"level_{s}"), F.col("lot").alias(f"lot_{s}"), F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias(f"strip_{s}"))
    place = lambda s: F.struct(F.col(f"level_{s}").alias("x"), F.coalesce(f"lot_{s}", F.lit(-2)).alias("y"), F.col(f"strip_{s}").alias("z"))
    # Groups that share the shingle before have no first meeting here, unless that one is none.
    new = F.col("lot_a").isNull() | F.col("lot_b").isNull() | (F.col("lot_a") != F.col("lot_b"))
    cells = of("a").join(of("b"), (F.col("token_a") == F.col("token_b")) & (F.abs(F.col("level_a") - F.col("level_b")) <= 1) & new & (place("a") <= place("b")))
    one = place("a") == place("b")
    # Below all numbers of the other cells.
    number = F.xxhash64("token_a", place("a"), place("b")).bitwiseOR(F.lit(-(1 << 63)))
    cells = cells.select("*", number.alias("ship_to"), one.alias("alone"))
    ends = cells.select("ship_to", F.col("token_a").alias("c_token"), F.col("level_a").alias("c_level"), F.col("lot_a").alias("c_lot"), F.col("strip_a").alias("c_strip"), F.lit(0).alias("half"))
    ends = ends.union(cells.where(~F.col("alone")).select("ship_to", "token_b", "level_b", "lot_b", "strip_b", F.lit(1)))
    dealt = spread.join(strips.select(F.col("token").alias("s_token"), F.col("level").alias("s_level"), F.col("lot").alias("s_lot"), "strips"), (F.col("token") == F.col("s_token")) & (F.col("level") == F.col("s_level")) & F.col("lot").eqNullSafe(F.col("s_lot")))
    dealt = dealt.select("token", "level", "lot", "before", "atom", F.pmod(F.xxhash64("atom"), "strips").cast("int").alias("strip"))
    sent = dealt.join(ends, (F.col("token") == F.col("c_token")) & (F.col("level") == F.col("c_level")) & F.col("lot").eqNullSafe(F.col("c_lot")) & (F.col("strip") == F.col("c_strip")))
    return cells.select("ship_to", F.col("token_a").alias("token"), "alone"), sent.select("ship_to", "atom", "before", "half")


class _Cell:
    """The classes of a cell, their links' counts and components."""

    def __init__(self, n: np.ndarray, docs: np.ndarray, own: list[np.ndarray], percent: int) -> None:
        self.n, self.docs, self.percent = n, docs, percent
        self.lengths = np.array([len(x) for x in own], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.lengths)))
        self.values, self.ids = np.unique(np.concatenate(own) if own else np.empty(0, np.uint64), return_inverse=True)
        self.flag = np.zeros(len(self.values), bool)
        self.others = np.zeros(len(n), np.int64)
        self.parent = np.arange(len(n))

    def link(self, i: int, js: np.ndarray, where: np.ndarray, lengths: np.ndarray, met: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
        """Verifies class ``i`` against ``js``, whose shingles' numbers are ``where``; ``met`` tells from the first common one who is to be counted."""
        own = self.ids[self.at[i] : self.at[i + 1]]
        self.flag[own] = True
        hit = self.flag[where]
        starts = np.cumsum(lengths) - lengths
        both = np.add.reduceat(hit, starts, dtype=np.int64)
        good = 100 * both >= self.percent * (self.n[i] + self.n[js] - both)
        if met is not None and good.any():
            found = np.flatnonzero(hit)
            first = where[found[np.minimum(np.searchsorted(found, starts[good]), len(found) - 1)]]
            good[good] = met(js[good], first)
        self.flag[own] = False
        j = js[good]
        if len(j):
            self.others[i] += self.docs[j].sum()
            self.others[j] += self.docs[i]
            top = self.parent[np.append(j, i)]
            while (self.parent[top] != top).any():
                top = self.parent[top]
            self.parent[top] = top.min()

    def listed(self, i: int, js: np.ndarray, met: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> None:
        for s in range(0, len(js), 2000):
            j = js[s : s + 2000]
            self.link(i, j, np.concatenate([self.ids[self.at[x] : self.at[x + 1]] for x in j]), self.lengths[j], met)

    def roots(self) -> np.ndarray:
        while (self.parent[self.parent] != self.parent).any():
            self.parent = self.parent[self.parent]
        return self.parent


def verified_cells(sets: DataFrame, sent: DataFrame, work: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Per cell and class with links there: ``rep``, ``others`` (documents of the classes linked), ``root`` (a class of its component)."""
    # Sets that no pair needs are left where they are.
    reps = sent.select("rep").distinct()
    used = sets.select("key", "shared").where(maybe_in(F.col("key"), bit_filter(reps, reps.count())))
    # These rows are narrow: where they are few, sets go to their cells in one step.
    shipped = used.join(F.broadcast(sent) if sent.count() <= FEW else sent, F.col("key") == F.col("rep")).drop("rep")
    schema = pa.schema([("rep", pa.int64()), ("others", pa.int64()), ("root", pa.int64())])

    def run(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        key, group = left.column("key").to_numpy(), left.column("group_id").to_numpy()
        own = [from_planes(x) for x in left.column("shared").to_pylist()]
        trim()
        cell = _Cell(left.column("n").to_numpy(), left.column("docs").to_numpy(), own, percent)
        del own
        tokens = [t for t in right.column("token").to_pylist() if t is not None]
        if tokens:
            _all_of(cell, group, left.column("before").to_numpy(), left.column("half").to_numpy(), np.uint64(tokens[0]), bool(right.column("alone")[0].as_py()))
        else:
            _pairs_of(cell, left.column("atom").to_pylist(), group, left.column("frequent").to_pylist(), zip(right.column("a").to_pylist(), right.column("b").to_pylist()))
        root = cell.roots()
        seen = np.flatnonzero(cell.others > 0)
        return pa.Table.from_arrays([pa.array(key[seen]), pa.array(cell.others[seen]), pa.array(key[root[seen]])], schema=schema)

    return shipped.repartition(tasks, "ship_to").groupBy("ship_to").cogroup(work.withColumnRenamed("ship_to", "cell").repartition(tasks, "cell").groupBy("cell")).applyInArrow(run, "rep long, others long, root long")


def _pairs_of(cell: _Cell, atoms: list[int], group: np.ndarray, frequent: list[list[int] | None], pairs: Iterable[tuple[int, int]]) -> None:
    """Members of listed pairs of blocks. Those whose first common shingle is a frequent one are counted in its own cells."""
    members: dict[int, list[int]] = {}
    for i, a in enumerate(atoms):
        members.setdefault(a, []).append(i)
    partners: dict[int, list[np.ndarray]] = {}
    for a, b in pairs:
        here, there = np.array(members.get(a, ()), np.int64), np.array(members.get(b, ()), np.int64)
        for k, i in enumerate(here):
            partners.setdefault(int(i), []).append(there if a != b else here[k + 1 :])
    hidden = [np.array(x, np.int64).view(np.uint64) if x else None for x in frequent]
    for i, parts in partners.items():
        js = np.concatenate(parts)
        if not len(js):
            continue
        met = None
        if hidden[i] is not None:
            met = lambda j, first, i=i: (group[j] == group[i]) | ~np.isin(cell.values[first], hidden[i])
        cell.listed(i, js, met)


def _all_of(cell: _Cell, group: np.ndarray, before: np.ndarray, half: np.ndarray, token: np.uint64, alone: bool) -> None:
    """All pairs of a frequent shingle's cell that meet in it first, but those of one group."""
    number = int(np.searchsorted(cell.values, token))
    right = np.flatnonzero(half == (0 if alone else 1))
    for a in range(0, len(right), 2000):
        js = right[a : a + 2000]
        where = np.concatenate([cell.ids[cell.at[x] : cell.at[x + 1]] for x in js])
        lengths = cell.lengths[js]
        for i in np.flatnonzero(half == 0):
            ok = (group[js] != group[i]) & ((before[js] != before[i]) | (before[i] == -1))
            if alone:
                ok &= js > i
            if ok.any():
                cell.link(int(i), js, where, lengths, lambda j, first, i=i: (first == number) & (group[j] != group[i]) & (~np.bool_(alone) | (j > i)))


def linked_classes(sets: DataFrame, percent: int, frequent_at: int) -> tuple[DataFrame, DataFrame]:
    """(classes, links): ``links`` has rep, others, root, from every cell (a written table)."""
    cores = sets.sparkSession.sparkContext.defaultParallelism
    classes = written(classes_of(sets), "classes")
    shared = classes.where("leads").agg(F.sum("n_shared")).first()[0] or 0
    leads = Leads(classes)
    rows = written(postings(sets, leads, index_filter(sets, leads, percent, shared // 4)), "postings")
    frequent = written(rows.groupBy("token").count().where(F.col("count") > frequent_at), "frequent")
    pairs = written(atom_pairs(group_pairs(rows, frequent, percent), classes), "pairs")
    listed = pairs.agg(F.sum(F.col("weight_a") * F.col("weight_b"))).first()[0] or 0.0
    tasks = max(1, min(cores, int(listed // 20_000) + 1), int(listed // BIN_WORK) + 1)
    work, sent = pair_cells(pairs, tasks)
    work = work.select("ship_to", "a", "b", F.lit(None).cast("long").alias("token"), F.lit(None).cast("boolean").alias("alone"))
    sent = sent.select("ship_to", "atom", F.lit(None).cast("long").alias("before"), F.lit(None).cast("int").alias("half"))
    told = classes.select("rep", "docs", "n", "group_id", "atom")
    spent = [rows, frequent, pairs]
    if frequent.isEmpty():
        told = told.withColumn("frequent", F.lit(None).cast("array<long>"))
    else:
        cells, goods = frequent_cells(rows, frequent, classes, percent)
        cells, goods = written(cells, "cells"), written(goods, "cells")
        spent += [cells, goods]
        tasks += min(cells.count(), max(cores, goods.count() // 20_000))
        work = work.union(cells.select("ship_to", F.lit(None).cast("long"), F.lit(None).cast("long"), "token", "alone"))
        sent = sent.union(goods)
        # A group's frequent shingles are no more than its prefix.
        of_group = rows.join(frequent.select("token"), "token").groupBy(F.col("group_id").alias("g")).agg(F.collect_set("token").alias("frequent"))
        told = told.join(of_group, F.col("group_id") == F.col("g"), "left").drop("g")
    sent = written(sent.join(told, "atom"), "sent")
    links = written(verified_cells(sets, sent, work, percent, tasks), "links")
    for t in (*spent, sent):
        drop_written(t)
    return classes, links


def similar_documents(docs: DataFrame, *, size: int = 2, percent: int = 60, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, bucket: int = BUCKET, hot_most: int = HOT, hot_least: int = HOT_LEAST, frequent: int = FREQUENT) -> DataFrame:
    """Per document: ``n_shingles``, ``n_similar`` (other documents linked directly) and ``component_id``.

    Documents link when 100 x intersection >= ``percent`` x union of their shingle sets.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seed = 0
    while True:
        listed = written(document_sets(own, size, block, hot_least, seed), "sets")
        documents = listed.where("kind = 0").select("doc_id", "key", "n", "check")
        copies = written(documents.where("n > 0").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), (F.min("check") != F.max("check")).alias("mixed")), "copies")
        if copies.where("mixed").isEmpty():
            break
        drop_written(listed)  # two sets of one key: all keys are made anew
        seed += 1
    # At most ``hot_most`` rows reach the driver, the rarest first.
    top = listed.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(hot_most).collect()
    hot = np.array([r.key for r in reversed(top)], np.int64).view(np.uint64)
    total = documents.agg(F.sum("n")).first()[0] or 0
    # Enough buckets to occupy all cores twice, unless they would be small.
    busy = min(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // max(1, bucket // 8)))
    buckets = max(1, -(-total // bucket), busy)
    parts = 3 * buckets
    returned = count_frequencies(bucketed_shingles(own, size, block, hot, buckets, parts, seed), buckets, parts)
    sets = written(prefixes(returned, percent, parts), "prefixes")
    classes, links = linked_classes(sets, percent, frequent)

    met = written(links.groupBy("rep").agg(F.sum("others").alias("others")).join(connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep"), "rep", "left"), "met")
    # Members of a class link with each other where its shared shingles are enough for that.
    inside = 100 * F.col("n_shared") >= percent * (2 * F.col("n") - F.col("n_shared"))
    of_class = classes.select("class_id", "rep", "docs", inside.alias("inside")).join(met, "rep", "left")
    per_key = sets.select("key", "class_id").join(of_class, "class_id").select("key", "docs", "inside", F.coalesce("others", F.lit(0)).alias("others"), F.when(F.col("inside") | F.col("others").isNotNull(), F.coalesce("root", "rep")).alias("root"))
    per_key = copies.join(per_key, "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = per_key.groupBy("root").agg(F.min("first_id").alias("component_id"))
    similar = F.col("copies") - 1 + F.when(F.coalesce("inside", F.lit(False)), F.col("docs") - F.col("copies")).otherwise(0) + F.coalesce("others", F.lit(0))
    per_key = written(per_key.join(first, "root").select("key", similar.alias("n_similar"), "component_id"), "by_set")
    for t in (sets, classes, links, copies, met):
        drop_written(t)
    return documents.join(per_key, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("n_similar")).otherwise(F.lit(0)).alias("n_similar"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those linked, directly or through others, to one that stays: the smallest id of its component.

    All columns are kept. Null ids are the largest; of equal ids the row read first
    stays. Rows are numbered in a written table, as one struct, so that no two are
    taken for one and their columns can't clash with ours.
    """
    rows = written(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("row_id")), "rows")
    doc = F.col("row").getField(id_col).cast("long")
    found = similar_documents(rows.select(F.col("row_id").alias("doc_id"), F.col("row").getField(text_col).alias("text")), **options).select(F.col("doc_id").alias("of_row"), "component_id")
    order = F.struct(doc.isNull().alias("last"), doc.alias("id"), "row_id")
    kept = rows.select("row_id", order.alias("o")).join(found, F.col("row_id") == F.col("of_row")).groupBy("component_id").agg(F.min("o").alias("first")).select(F.col("first.row_id").alias("kept_id"))
    return rows.join(kept, F.col("row_id") == F.col("kept_id"), "left_semi").select("row.*")
