import random
import re
from collections import Counter, defaultdict

import pytest

from docshape.llm.mixing import mix_sources, mixed_documents


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: float(1 + i % 3) for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] >= 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def made(seed):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "zz", None, "Z"]
    rows = [(i, " ".join("w" for _ in range(int(rng.lognormvariate(3, 1)) + 1)), rng.choices(sources, [30, 8, 4, 1, 5, 2])[0]) for i in range(600)]
    return rows + [(700, None, "a"), (701, "", "b"), (702, " ", "only empty"), (None, "x y", "a"), (None, "x y", "a"), (5, "p q r", "b"), (5, "p q r", "b")]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, source string, size int")
    got = mix_sources(docs, group=50).collect()
    assert len(got) == len(rows)
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    source_of = {(d, size_of(t)): s for d, t, s in rows}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size_of(t)
    target, taken = water_fill(sizes), Counter()
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(12, 0.01 * target[s]), s
    again = mix_sources(docs.repartition(3), group=50).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_documents_are_repeated(spark):
    rows = made(3)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, row_hash string")
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mix_sources(docs).collect():
        want[r.doc_id, r.size] += r.copies
    assert Counter((r.doc_id, len((r.text or "").split())) for r in mixed.collect()) == +want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(docs).count() == 0 and mixed_documents(docs).count() == 0
