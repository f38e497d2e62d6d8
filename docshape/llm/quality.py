"""Quality rules with cutoffs whose false rejections are limited by exact binomial bounds.

Method: each rule compares one ratio of a document with a cutoff, and a document is
rejected above any. Per stratum (language) the labelled documents are split in two
by their ids. The first half designs a nested path of joint cutoffs, from none to
strict: each step tightens the rule that rejects most bad documents for the good
ones it costs. On the second half, the holdout, the exact binomial test of "these
cutoffs reject more than ``alpha`` of good documents" must reject that hypothesis at
level ``delta / strata`` (Bonferroni), step by step; the first failure ends the
sequence (fixed-sequence testing, so that steps cost no further correction), and the
most useful step before it is taken. Hence, with probability 1 - delta and for all
strata at once, all rules together reject at most ``alpha`` of a stratum's good
documents. A stratum with too few good labels in the holdout (71 at the defaults and
four strata) gets no cutoffs and rejects nothing by these rules.

Plan: one Arrow map turns whole texts into a dozen numbers a document (no shuffle).
The path is fitted on the whole first half: its documents are counted by the levels
their ratios reach (the number of cutoffs each exceeds), and every step is chosen for
all strata at once from one count of those left by stratum, label, rule and level, so
that the driver holds 732 numbers a stratum however many the labels. The test runs
over the whole holdout, counted per stratum and step before the driver sees it.

Defined cases: null or empty text has no words (and fails the base rules); null
language is a stratum of its own; labels that disagree count as good; null labels
and labels of unknown documents don't count; repeated rows are repeated; empty
tables give no rows; other columns are ignored, and kept by ``keep_good``; very long
texts are counted whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docshape.llm.common import bit_filter, drop_written, held, maybe_in, texts, written

_SPACE = bytes([32, *range(9, 14)])
_UNSEEN = _SPACE + bytes(range(0x80, 0xC0))  # white space, and all but the first byte of a code point
_UPPER = bytes(range(65, 91))
_WINDOW = 8
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(_WINDOW)], np.uint64)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaimed")
#: Each rule's ratio of counts.
RULES = {
    "symbols": ("n_symbols", "n_words"), "duplicate_lines": ("n_dup_lines", "n_lines"), "repeated_words": ("n_repeat_words", "n_words"),
    "upper_case": ("n_upper", "word_chars"), "exclamations": ("n_exclaimed", "n_words"), "word_length": ("word_chars", "n_words"),
}
#: Cutoffs that may be chosen, from lenient to strict; fixed beforehand, so that they don't depend on the labels.
GRIDS = {r: [round(2.0 * 0.9**k, 6) for k in range(60)] for r in RULES} | {"word_length": [round(60 * 0.95**k, 6) for k in range(60)]}
#: The same from strict to lenient. A ratio's level is the number of them that it exceeds.
_ASCENDING = {r: sorted(g) for r, g in GRIDS.items()}
_TOP = len(GRIDS["symbols"])

#: A good document rejected weighs as much as so many bad ones kept (in shares).
CARE = 10.0


def repeated_words(words: list[bytes], window: int = _WINDOW) -> int:
    """Words that lie in a run of ``window`` words found at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    runs = h[:n].copy()
    for k in range(1, window):
        runs += h[k : k + n] * _POWERS[k]
    order = np.argsort(runs)
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """``COUNTS`` of one UTF-8 text."""
    words = text.split()
    if not words:
        return (0,) * len(COUNTS)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words), len(text.translate(None, _UNSEEN)), len(text) - len(text.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), len(text) - len(text.translate(None, _UPPER)), text.count(b"!"),
    )


def quality_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``doc_id``, ``stratum`` and ``COUNTS`` of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality")
        for batch in batches:
            rows = np.array([counts(t) for t in texts(batch)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *(pa.array(c) for c in rows.T)], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, ", ".join(["doc_id long", "stratum string", *(f"{c} long" for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), by the continued fraction of the incomplete beta function (any n)."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = float(n - k), k + 1.0, 1 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return 1 - front * f if flip else front * f


def _next_step(left: np.ndarray, cut: list[int], number: np.ndarray) -> tuple[int, int] | None:
    """The rule and the level that are most useful to cut at next, if any is. ``left`` counts documents by label, rule and level; ``number`` those of a label."""
    above = left[:, :, ::-1].cumsum(axis=2)[:, :, ::-1]
    best, step = 0.0, None
    for k in range(len(RULES)):
        bad, good = above[:, k, cut[k] : 0 : -1]  # lenient first: cutoffs cut[k] - 1 to 0 reject the levels above them
        gain = bad / number[0] - CARE * good / number[1]
        at = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[at] > best + 1e-12:
            best, step = float(gain[at]), (k, cut[k] - 1 - at)
    return step


def design_paths(counted: Callable[[dict[str | None, list[int]]], dict[str | None, np.ndarray]]) -> dict[str | None, list[tuple[float, ...]]]:
    """Per stratum nested cutoffs, one of each rule (infinite: none), each step the most useful next one; ends where none is of use.

    ``counted`` takes the strata that go on and the level each rule is cut at there (none:
    all strata, uncut), and counts their documents left by label, rule and level.
    """
    left = counted({})
    number = {s: np.maximum(1, x[:, 0].sum(axis=1)) for s, x in left.items()}
    cuts = {s: [_TOP] * len(RULES) for s in left}
    paths: dict[str | None, list[tuple[float, ...]]] = {s: [] for s in left}
    while left:
        on = {}
        for s, x in left.items():
            step = _next_step(x, cuts[s], number[s])
            if step:
                cuts[s][step[0]] = step[1]
                paths[s].append(tuple(_ASCENDING[r][c] if c < _TOP else math.inf for r, c in zip(RULES, cuts[s])))
                on[s] = cuts[s]
        left = counted(on) if on else {}
    return paths


def design_path(ratios: np.ndarray, good: np.ndarray) -> list[tuple[float, ...]]:
    """The path of one stratum whose ratios are at hand."""
    levels = np.stack([np.searchsorted(g, ratios[:, k]) for k, g in enumerate(_ASCENDING.values())], axis=1)

    def counted(cuts: dict[str | None, list[int]]) -> dict[str | None, np.ndarray]:
        stay = (levels <= cuts.get(None, _TOP)).all(axis=1)
        return {None: np.array([[np.bincount(x, minlength=_TOP + 1) for x in levels[stay & (good == y)].T] for y in (False, True)])}

    return design_paths(counted)[None]


def _counted_left(design: DataFrame) -> Callable[[dict[str | None, list[int]]], dict[str | None, np.ndarray]]:
    """``design_paths``'s counts of a table of (stratum, good, levels, number)."""

    def counted(cuts: dict[str | None, list[int]]) -> dict[str | None, np.ndarray]:
        left = design
        if cuts:
            table = design.sparkSession.createDataFrame(list(cuts.items()), "cut_stratum string, cut array<int>")
            gone = F.exists(F.zip_with("levels", "cut", lambda x, c: x > c), lambda y: y)
            left = design.join(F.broadcast(table), F.col("stratum").eqNullSafe(F.col("cut_stratum"))).where(~gone)
        out: dict[str | None, np.ndarray] = {}
        for s, y, rule, level, n in left.select("stratum", "good", F.posexplode("levels").alias("rule", "level"), "number").groupBy("stratum", "good", "rule", "level").agg(F.sum("number")).collect():
            out.setdefault(s, np.zeros((2, len(RULES), _TOP + 1), np.int64))[y, rule, level] = n
        return out

    return counted


def choose_step(rejected: list[int], bad: list[int], n_good: int, n_bad: int, *, alpha: float, level: float) -> int:
    """Steps of the path to take, 0 for none: the most useful of those before the first failed test.

    ``rejected`` and ``bad`` count the holdout's good and bad documents that each step rejects.
    """
    chosen, best = 0, 0.0
    for k, (r, b) in enumerate(zip(rejected, bad), 1):
        if binomial_cdf(r, n_good, alpha) > level:
            break
        gain = b / max(1, n_bad) - CARE * r / max(1, n_good)
        if gain > best:
            chosen, best = k, gain
    return chosen


def _ratio(rule: str) -> Column:
    top, bottom = RULES[rule]
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def _level(rule: str, ratio: Column) -> Column:
    return F.size(F.filter(F.lit(_ASCENDING[rule]), lambda c: ratio > c))


def in_holdout(doc_id: Column) -> Column:
    """Whether a labelled document tests the path, rather than designs it."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0


def fit_cutoffs(counted: DataFrame, labels: DataFrame, *, alpha: float = 0.06, delta: float = 0.05, label_col: str = "quality") -> dict[tuple[str | None, str], float]:
    """Learns the cutoffs from ``labels`` (doc_id, 1 for good or 0); the driver gets counts by level and by step."""
    known = known_labels(labels, label_col)
    # Documents that fail the base rules go anyway, so the cutoffs are judged on those that remain.
    met = counted.where(~base_failed()).join(known, "doc_id").select("stratum", "good", in_holdout(F.col("doc_id")).alias("holdout"), F.array(*map(_ratio, RULES)).alias("ratios"))
    held_ = written(met, "labelled")
    levels = F.array(*(_level(r, F.col("ratios")[k]) for k, r in enumerate(RULES))).alias("levels")
    design = written(held_.where("not holdout").groupBy("stratum", "good", levels).agg(F.count("*").alias("number")), "design")
    paths = design_paths(_counted_left(design))
    strata = {s for s, y in held_.groupBy("stratum", "good").count().select("stratum", "good").toLocalIterator() if y == 1}
    table = held_.sparkSession.createDataFrame([(s, [list(c) for c in p]) for s, p in paths.items()], "path_stratum string, path array<array<double>>")
    # A step rejects all that the steps before it do: a document counts from the first that rejects it.
    steps = F.size("path") - F.size(F.filter("path", lambda cut: F.exists(F.zip_with("ratios", cut, lambda x, c: x > c), lambda y: y)))
    tested = held_.where("holdout").join(table, F.col("stratum").eqNullSafe(F.col("path_stratum")), "left").groupBy("stratum", "good", F.coalesce(steps, F.lit(0)).alias("passed")).count().collect()
    chosen: dict[tuple[str | None, str], float] = {}
    for s in strata:
        path = paths.get(s, [])
        by_step, number = [[0] * (len(path) + 1) for _ in (0, 1)], [0, 0]
        for r in tested:
            if r.stratum == s:
                number[r.good] += r["count"]
                by_step[r.good][r.passed] += r["count"]
        bad, good = ([sum(x[: k + 1]) for k in range(len(path))] for x in by_step)
        k = choose_step(good, bad, number[1], number[0], alpha=alpha, level=delta / len(strata))
        if k:
            chosen |= {(s, r): c for r, c in zip(RULES, path[k - 1]) if c < math.inf}
    drop_written(held_)
    drop_written(design)
    return chosen


def known_labels(labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """``doc_id`` and ``good`` of the labels that count."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("good"))


def with_verdict(counted: DataFrame, cutoffs: dict[tuple[str | None, str], float]) -> DataFrame:
    """Adds ``base_failed`` and ``kept``."""
    spark = counted.sparkSession
    strata = list(dict.fromkeys(s for s, _ in cutoffs))
    table = spark.createDataFrame([(s, [cutoffs.get((s, r)) for r in RULES]) for s in strata], "rule_stratum string, cutoffs array<double>")
    above = F.array(*(F.coalesce(_ratio(r) > F.col("cutoffs")[k], F.lit(False)) for k, r in enumerate(RULES)))
    judged = counted.join(table, F.col("stratum").eqNullSafe(F.col("rule_stratum")), "left")
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.exists(above, lambda x: x)).drop("rule_stratum", "cutoffs")


def apply_quality_rules(docs: DataFrame, labels: DataFrame, *, alpha: float = 0.06, delta: float = 0.05) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document; the counts are written once and read by both passes."""
    counted = written(quality_counts(docs), "quality")
    return with_verdict(counted, fit_cutoffs(counted, labels, alpha=alpha, delta=delta))


def keep_good(docs: DataFrame, labels: DataFrame, *, alpha: float = 0.06, delta: float = 0.05, text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns, in the place where they are: no row is moved by a key."""
    # Only labelled documents are counted for the cutoffs: a bit filter finds them where they are.
    known = known_labels(labels)
    ids = known.select("doc_id")
    labelled = docs.where(F.col("doc_id").isNotNull()).where(maybe_in(F.col("doc_id").cast("long"), bit_filter(ids, ids.count())))
    cutoffs = fit_cutoffs(quality_counts(labelled, text_col=text_col, stratum_col=stratum_col), labels, alpha=alpha, delta=delta)
    names = list(RULES)

    @F.pandas_udf("boolean")
    def kept(text, stratum):
        import pandas as pd

        held("quality")
        out = []
        for t, s in zip(text, stratum):
            c = dict(zip(COUNTS, counts(b"" if t is None else t.encode())))
            bad = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
            for r in names:
                top, bottom = RULES[r]
                bad = bad or ((s, r) in cutoffs and c[bottom] > 0 and c[top] / c[bottom] > cutoffs[s, r])
            out.append(not bad)
        return pd.Series(out, dtype=bool)

    return docs.where(kept(F.col(text_col), F.col(stratum_col).cast("string")))
