import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docshape.llm import jaccard
from docshape.llm.components import connected_components
from docshape.llm.jaccard import one_per_group, similar_documents


def brute(rows, size=2, percent=60):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])] for i in range(n)]
    comp = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp[i] = min(ids) if ids else None
    return sorted(((rows[i][0], len(sets[i]), len(links[i]), comp[i]) for i in range(n)), key=str)


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    texts = ["", " \n", None, "one", "ONE", "Two words", "two  WORDS", "a b a b a b", "x" * 3000 + " y", "w " * 2000]
    while len(texts) < n:
        if rng.random() < 0.6 and len(texts) > 12:
            words = (rng.choice(texts[10:]) or "a").split()
            for _ in range(rng.randint(0, max(1, len(words) // 6))):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words[: rng.randint(max(1, len(words) * 2 // 3), len(words))]))
        else:
            texts.append(" ".join(word() for _ in range(rng.randint(1, 60))))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [(None, texts[20]), (None, ""), (5, texts[5]), (5, texts[5])]


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"hot_least": 4, "hot_most": 50}), (3, {"hot_least": 4, "hot_most": 50, "block": 100, "bucket": 500})])
def test_equals_brute_force(spark, seed, sizes):
    rows = made(seed)
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, n int, key string").repartition(3)
    got = sorted((tuple(r) for r in similar_documents(docs, **sizes).select("doc_id", "n_shingles", "n_similar", "component_id").collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("options", [{}, {"frequent": 3}, {"frequent": 0, "block": 100, "bucket": 500}])
def test_templates_with_tails(spark, monkeypatch, options):
    from docshape.llm import jaccard

    if options:
        monkeypatch.setattr(jaccard, "SIDE", 4)
        monkeypatch.setattr(jaccard, "ATOM", 3)
    rng = random.Random(5)
    template = [f"t{i}" for i in range(30)]
    few = [f"v{i}" for i in range(9)]
    texts = [" ".join([*template, f"u{i}"]) for i in range(40)]  # tails of their own: one class
    texts += [" ".join([*template, *rng.choices(few, k=rng.randint(1, 9))]) for _ in range(60)]  # tails that others share
    texts += [" ".join(template[: rng.randint(15, 30)]) for _ in range(20)]
    texts += [" ".join(["u", *rng.choices(few, k=3), f"w{i}"]) for i in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in similar_documents(docs, **options).collect()), key=str)
    assert got == brute(rows)


class Grouped:
    """Stands for a table whose groups are counted: runs the function on one group, given as it asks for it, without Spark."""

    def repartitionById(self, *_):
        return self

    groupBy = repartitionById

    def applyInArrow(self, f, _):
        whole = f.__annotations__["return"] == "pa.Table"
        return lambda key, batches: f(key, pa.Table.from_batches(batches)).to_batches() if whole else f(key, iter(batches))


def test_a_bucket_is_counted_exactly_in_little_memory(spark):
    rng = np.random.default_rng(3)
    sets = {int(k): np.unique(rng.integers(0, 1 << 48, 300) if k % 9 == 0 else rng.integers(0, 40_000, 300)).astype(np.uint64) for k in rng.choice(1 << 60, 2400, replace=False)}
    keys = list(sets)
    # Blocks of 150 sets, some in two of them; three batches.
    blocks = [keys[i : i + 150] + keys[:5] * (i > 0) for i in range(0, len(keys), 150)]
    rows = [(0, np.array(b, np.int64).tobytes(), jaccard._pack_counts(np.array([len(sets[k]) for k in b])), jaccard._pack(np.concatenate([sets[k] for k in b]), 6), b"") for b in blocks]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), jaccard._ROWS)], schema=jaccard._ROWS) for part in (rows[:1], rows[1:9], rows[9:])]
    total = sum(len(sets[k]) for b in blocks for k in b)
    parts, out, most = 7, [], 0
    tracemalloc.start()
    try:
        for batch in jaccard.count_frequencies(Grouped(), 1, parts)((pa.scalar(0),), batches):
            most = max(most, tracemalloc.get_traced_memory()[1])
            out += batch.to_pylist()
    finally:
        tracemalloc.stop()
    df = Counter(x for own in sets.values() for x in own.tolist())
    shared = {k: sorted(df[x] for x in own.tolist() if df[x] > 1) for k, own in sets.items()}
    seen, number_of = {}, {}
    for r in out:
        here = np.frombuffer(r["keys"], np.int64)
        counts = jaccard._unpack_counts(r["counts"], len(here))
        number = jaccard._unpack(r["tokens"], len(r["tokens"]) // int(counts.sum())).astype(np.int64)
        first, value = np.frombuffer(r["dfs"], "<u4").astype(np.int64).reshape(2, -1)
        for k, own in zip(here.tolist(), np.split(number, np.cumsum(counts)[:-1])):
            assert k % parts == r["part"] and k not in seen and (np.diff(own) > 0).all()
            seen[k] = value[np.searchsorted(first, own, side="right") - 1].tolist()
            number_of[k] = set(own.tolist())
    assert seen == {k: x for k, x in shared.items() if x}
    # Numbers stand for shingles: two sets have as many in common as before.
    for a, b in zip([k for k in keys if k % 9][:60], [k for k in keys if k % 9][1:61]):
        assert len(number_of[a] & number_of[b]) == len(set(sets[a].tolist()) & set(sets[b].tolist()))
    assert most / total < 24, f"{most / total:.1f} bytes a shingle"


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {300: 300, 301: 300}


def test_one_of_each_group_stays(spark):
    rows = made(7) + [(900, "x y z q"), (900, "x y z q"), (901, "x y z q"), (None, "x y z q")]
    docs = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, row_key int")
    got = one_per_group(docs)
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert {i for i in kept if i is not None} == {c for i, _, _, c in brute(rows) if c is not None and c in {d for d, _ in rows}}
    assert kept.count(900) == 1 and 901 not in kept and one_per_group(docs.limit(0)).count() == 0
