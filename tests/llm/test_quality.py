import bisect
import math
import random
import re
import zlib

import numpy as np
import pytest

from docshape.llm import quality
from docshape.llm.quality import COUNTS, RULES, apply_quality_rules, binomial_cdf, choose_step, counts, design_path, keep_good

ODD = ["", " \t\n", "one", "é ü x y", "a b\na b\n \na b\n", "w " * 50, "a b c d e f g h i a b c d e f g h", "#*$%&|<> x\n#", "x" * 500, "HEY!! YOU!!\nHEY!! YOU!!"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_equal_brute_force():
    rng = random.Random(3)
    for t in ODD + ["".join(rng.choices(["a", "b ", "\n", " ", "c\t", "é ", "#", "!", " "], k=rng.randint(0, 120))) for _ in range(500)]:
        got = dict(zip(COUNTS, counts(t.encode())))
        assert tuple(got[c] for c in COUNTS[:5]) == brute(t), t


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (30, 0.01), (200, 0.3), (5000, 0.005)])
def test_binomial_cdf_is_exact(n, p):
    total = 0.0
    for k in range(min(n, 60)):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        assert binomial_cdf(k, n, p) == pytest.approx(total, rel=1e-9, abs=1e-12)
    assert binomial_cdf(10**8, 10**10, 0.011) < 1e-9


def test_few_labels_give_no_step_and_many_give_the_most_useful():
    level = 0.05 / 4
    assert choose_step([0, 0], [5, 9], 70, 10, alpha=0.06, level=level) == 0
    assert choose_step([0, 0, 0], [5, 9, 9], 71, 10, alpha=0.06, level=level) == 2  # of equally useful ones the most lenient
    assert choose_step([0, 30, 0], [5, 9, 10], 200, 10, alpha=0.06, level=level) == 1  # the first failure ends the sequence
    assert choose_step([0], [0], 5000, 0, alpha=0.06, level=level) == 0


def test_path_is_nested_and_useful():
    rng = np.random.default_rng(2)
    good = rng.random(600) < 0.7
    ratios = rng.random((600, len(RULES))) * np.where(good, 0.5, 1.0)[:, None]
    path = design_path(ratios, good)
    assert path and all(all(b <= a for a, b in zip(x, y)) for x, y in zip(path, path[1:]))
    gone = (ratios > np.array(path[-1])).any(axis=1)
    assert gone[~good].mean() > 0.5 and gone[good].mean() < 0.05 and design_path(ratios[:0], good[:0]) == []


def plain_path(ratios, good):
    """``design_path`` by trying every cutoff of every rule at each step."""
    cut, path, left = [math.inf] * len(RULES), [], list(zip(ratios.tolist(), good.tolist()))
    number = [max(1, sum(y == k for _, y in left)) for k in (False, True)]
    while True:
        best, to = 0.0, None
        for k, r in enumerate(RULES):
            for g in (g for g in quality.GRIDS[r] if g < cut[k]):
                gone = [y for x, y in left if x[k] > g]
                gain = gone.count(False) / number[0] - quality.CARE * gone.count(True) / number[1]
                if gain > best + 1e-12:
                    best, to = gain, (k, g)
        if not to:
            return path
        cut[to[0]] = to[1]
        left = [(x, y) for x, y in left if x[to[0]] <= to[1]]
        path.append(tuple(cut))


@pytest.mark.parametrize("seed", range(4))
def test_path_equals_trying_every_cutoff(seed):
    rng = np.random.default_rng(seed)
    good = rng.random(300) < 0.6
    ratios = np.round(rng.random((300, len(RULES))) * np.where(good, 0.6, 1.5)[:, None], 2)
    ratios[:60, seed] = rng.choice(quality.GRIDS["symbols"], 60)  # a ratio that equals a cutoff isn't above it
    path = design_path(ratios, good)
    assert len(path) > 3 and path == plain_path(ratios, good)


def test_all_of_the_first_half_designs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(16000):  # a half has some 6,000 of one label and 2,000 of the other
        good, lang = i % 4 > 0, None if i % 50 == 7 else "en"
        n = 10_000
        x = np.minimum(rng.exponential(200 if good else 600, 5), n).astype(int).tolist()
        rows.append((i, lang, n, 5 * n + x[0], x[1], x[2], x[2], n, x[3], x[4]))
    counted = spark.createDataFrame(rows, ", ".join(["doc_id long", "stratum string", *(f"{c} long" for c in COUNTS)])).repartition(3)
    labels = spark.createDataFrame([(r[0], int(r[0] % 4 > 0)) for r in rows], "doc_id long, quality int")
    want = {}
    for lang in (None, "en"):
        halves = {0: [], 1: []}
        for r in (r for r in rows if r[1] == lang):
            c = dict(zip(COUNTS, r[2:]))
            halves[zlib.crc32(str(r[0]).encode()) % 2].append(([c[a] / c[b] for a, b in RULES.values()], r[0] % 4 > 0))
        path = design_path(np.array([x for x, _ in halves[1]]), np.array([y for _, y in halves[1]]))
        by_step = [[sum(y == k and any(a > b for a, b in zip(x, c)) for x, y in halves[0]) for c in path] for k in (True, False)]
        number = [sum(y == k for _, y in halves[0]) for k in (True, False)]
        k = choose_step(*by_step, *number, alpha=0.06, level=0.05 / 2)
        want |= {(lang, r): c for r, c in zip(RULES, path[k - 1] if k else ()) if c < math.inf}
    assert {s for s, _ in want} >= {"en"}
    assert quality.fit_cutoffs(counted, labels) == want


def test_false_rejections_stay_limited(monkeypatch):
    monkeypatch.setattr(quality, "CARE", 0.0)  # the strictest safe step is taken
    rng = random.Random(5)
    rates = [k / 600 for k in range(60)]
    broken = 0
    for _ in range(300):  # good documents are uniform: a step's true rate is its number over 600
        draws = sorted(rng.random() for _ in range(900))
        k = choose_step([bisect.bisect_left(draws, q) for q in rates], list(range(60)), 900, 60, alpha=0.06, level=0.05)
        broken += bool(k) and rates[k - 1] > 0.06
    assert broken <= 300 * 0.05 + 5


def brute_kept(rows, marks, alpha=0.06, delta=0.05):
    """Verdicts of (doc_id, text, lang) by plain loops over the same method."""
    def ratios(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n, chars, symbols, dup, rep = brute(text)
        upper, shouts = len(re.findall("[A-Z]", text)), text.count("!")
        share = lambda a, b: a / b if b else 0.0
        return n < 20 or 100 * rep > 30 * n, [share(symbols, n), share(dup, len(lines)), share(rep, n), share(upper, chars), share(shouts, n), share(chars, len(words))]

    seen = [(i, lang, *ratios(t or "")) for i, t, lang in rows]
    parts = {}
    for i, lang, failed, x in seen:
        if i in marks and not failed:
            parts.setdefault(lang, {0: [], 1: []})[zlib.crc32(str(i).encode()) % 2].append((marks[i], x))
    strata = [s for s, p in parts.items() if any(y for half in p.values() for y, _ in half)]
    cut = {}
    for s in strata:
        path, held = design_path(np.array([x for _, x in parts[s][1]]).reshape(-1, len(RULES)), np.array([y == 1 for y, _ in parts[s][1]], bool)), parts[s][0]
        goes = lambda x, c: any(a > b for a, b in zip(x, c))
        counted = [[sum(goes(x, c) for y, x in held if y == label) for c in path] for label in (1, 0)]
        k = choose_step(*counted, sum(y for y, _ in held), sum(1 - y for y, _ in held), alpha=alpha, level=delta / len(strata))
        cut[s] = path[k - 1] if k else [math.inf] * len(RULES)
    return {i: not failed and not any(a > b for a, b in zip(x, cut.get(lang, [math.inf] * len(RULES)))) for i, lang, failed, x in seen}, cut


def test_kept_equals_brute_force_on_the_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    marks = {r.doc_id: r.quality for r in labels.collect()}
    want, cut = brute_kept(rows, marks)
    got = apply_quality_rules(docs, labels)
    assert {r.doc_id: r.kept for r in got.collect()} == want
    assert {r.doc_id for r in keep_good(docs, labels).collect()} == {i for i, k in want.items() if k}
    assert any(c < math.inf for c in cut["en"])  # the method has a say beyond the base rules


def test_table(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    good = [(i, " ".join(word() for _ in range(40)), "en") for i in range(1500)]
    bad = [(5000 + i, " ".join(word() + "###" for _ in range(40)), "en") for i in range(30)]
    odd = [(9000 + i, t, None) for i, t in enumerate(ODD)] + [(9100, None, "en"), (None, " ".join(word() for _ in range(30)), "de")]
    docs = spark.createDataFrame([(*r, 1) for r in good + bad + odd], "doc_id long, text string, lang string, kept int")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad[:20]] + [(None, 1), (77777, 1), (3, None), (4, 0)], "doc_id long, quality int")
    got = apply_quality_rules(docs, labels).collect()
    assert len(got) == len(good + bad + odd)
    kept = {r.doc_id for r in got if r.kept}
    assert kept >= {i for i, _, _ in good} and not kept & {i for i, _, _ in bad} and None in kept
    for r, (_, t, _) in zip(sorted((r for r in got if r.doc_id and 9000 <= r.doc_id < 9100), key=lambda r: r.doc_id), odd):
        n, _, _, _, rep = brute(t or "")
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and (not r.base_failed or not r.kept)
    assert {r.doc_id for r in keep_good(docs, labels).collect()} == kept and keep_good(docs, labels).columns == docs.columns
    assert apply_quality_rules(docs.limit(0), labels.limit(0)).count() == 0
