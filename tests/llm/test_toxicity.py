import math
import random
import zlib

import numpy as np
import pytest

from docshape.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity, word_counts

BAD = ["idiot", "moron", "trash", "scum"]


def made(n=900, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 4))) for _ in range(rng.randint(8, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", ".", "s", "ish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def model_of(ids, data, labels, shares):
    return ToxicityModel(ids, [word_counts(t) for t in data], [zlib.crc32(t) for t in data], labels, shares).open()


@pytest.fixture(scope="module")
def model():
    rows, labels = made()
    return model_of([i for i, _ in rows], [t.encode() for _, t in rows], [y for _, y in labels], (0.7, 0.3))


def brute_cosines(model, examples, text):
    """Cosine of a text's TF-IDF vector with every example's, by dictionaries."""
    def vector(t):
        words = {}
        for w in t.lower().split():
            w = w.strip(".,!?;:\"'()[]#*$%&|<>")
            for x in [w, *(f"{n}:{w[:n]}" for n in (4, 5) if len(w) > n)]:
                if x and (x == w or x in model.tied):
                    words[x] = words.get(x, 0) + 1
        v = {x: (1 + math.log(n)) * (model.idf[model.vocabulary[x]] if x in model.vocabulary else model.rare) for x, n in words.items()}
        norm = math.sqrt(sum(a * a for a in v.values())) or 1.0
        return {x: a / norm for x, a in v.items()}

    q = vector(text)
    return {i: sum(q.get(x, 0.0) * a for x, a in vector(t).items()) for i, t in examples.items()}


def test_block_max_search_is_exact_over_all_words(model):
    rows = dict(made()[0])
    assert model.blocks > 2 and "idiot" in model.tied
    assert set(model.vocabulary) >= {w.strip(".") for t in rows.values() for w in t.split()}
    for _, text in [*made(60, seed=8)[0], (0, "unheard of words idiot"), (0, "idiot " * 300)]:
        want = brute_cosines(model, {i: rows[i] for i in model.ids.tolist()}, text)
        best = sorted((v for v in want.values() if v > 0), reverse=True)[: model.k]
        at, got = model.nearest(*model.query(text.encode()))
        assert np.allclose(got, best, atol=1e-5)
        assert np.allclose([want[model.ids[i]] for i in at], got, atol=1e-5)


def test_held_out_accuracy_and_calibration(model):
    rows, labels = made(800, seed=5)
    p = np.array([model.score(t.encode())[0] for _, t in rows])
    y = np.array([c for _, c in labels])
    assert ((p >= 0.5) == y).mean() > 0.95 and p.min() >= 0 and p.max() <= 1
    assert abs(p.mean() - y.mean()) < 0.06


def test_labels_of_one_class_or_none():
    for labels in ([0, 0], [1, 1]):
        assert model_of([1, 2], [b"a b", b"c"], labels, (1.0, 0.0)).score(b"a") == (0.0, "")
    assert model_of([], [], [], (1.0, 0.0)).score(b"") == (0.0, "")


def test_held_out_documents(spark):
    """Held-out accuracy on the driver's labels: recall and precision of planted toxicity, and neighbours for every text."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    marked = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    scored = score_toxicity(marked, fit_toxicity(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", "toxic", "evidence").collect()
    hit = sum(r.predicted and r.toxic for r in scored)
    assert hit / sum(r.toxic for r in scored) > 0.85 and hit / sum(r.predicted for r in scored) > 0.85
    assert sum(bool(r.evidence) for r in scored) / len(scored) > 0.99


def test_table(spark):
    rows, labels = made(500)
    # Held-out labels are turned round: nothing may be learnt from them.
    labels = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    odd = [(9000, None), (9001, ""), (9002, "idiot " * 3000), (None, "you moron"), (3, rows[3][1])]
    docs = spark.createDataFrame([(a, b, 0.5) for a, b in rows + odd], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels + [(None, 1), (7, None), (77777, 1), (0, labels[0][1])], "doc_id long, toxic int")
    got = score_toxicity(docs, fit_toxicity(docs, marks)).collect()
    assert len(got) == len(rows + odd)
    truth = {i: y for i, y in made(500)[1]}
    held = [r for r in got if r.held_out and r.doc_id < 500]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9 and all(r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[9000].score == by_id[9001].score < 0.5 < by_id[9002].score and by_id[9002].evidence
    assert score_toxicity(docs.limit(0), fit_toxicity(docs.limit(0), marks.limit(0))).count() == 0
