"""Toxicity from the nearest labelled examples, with evidence.

Method: labelled documents are TF-IDF vectors over all their words; a block-max
inverted index (posting lists cut into blocks of examples, each with its largest
weight) bounds what a block can score, and blocks are scored from the highest bounds
down until none can enter the ``k`` nearest: the exact nearest examples by cosine.
Their votes, weighted by squared cosine and class share, are mapped to probabilities
by isotonic regression on leave-one-out votes of the examples.

Terms are words (lower-case, without punctuation at the ends); all words of the
examples count. Words that a chi-square test ties to the label in both halves of the
examples weigh ``BOOST`` times as much, and so do first four and five letters that it
ties (inflections share those); halves are told apart by the text's checksum, so
copies of one text can't vouch for a term twice.

The index is fitted on at most ``sample`` labelled rows (half for each class, chosen
by hash; a documented bound); words are counted where the texts are, and one task
builds the index from those counts. Every document is scored on its whole text in one
Arrow map without a shuffle. Held-out rows, whose id has a checksum divisible by 5, are
never learnt from; language, source and id aren't inputs of a score.

Defined cases: null or empty text, or text without a word of any example, has the
score of examples without a vote; labels without class or document don't count; a
document labelled twice is toxic if any label says so; without examples of both
classes all scores are 0; ids are passed through; repeated rows are repeated; an empty
table gives no rows; other columns are ignored; very long texts are counted whole.
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docshape.llm.common import held, texts

#: Labelled rows to fit on, at most; neighbours; examples of a block; weight of terms tied to the label.
SAMPLE, NEIGHBOURS, BLOCK, BOOST = 6000, 15, 256, 8.0
#: Chi-square of a term in each half (1 % level) and documents of a half that hold it.
CHI_SQUARE, LEAST = 6.63, 5
#: Blocks scored at first; lists of terms in more than this share of the examples are stored as rows; texts scored together.
FIRST, DENSE, BATCH = 2, 1 / 16, 64
MEMO = 400_000
_EDGE = ".,!?;:\"'()[]#*$%&|<>"


def normal(word: bytes) -> str:
    return word.decode().lower().strip(_EDGE)


def word_counts(text: bytes) -> Counter:
    out: Counter = Counter()
    for word, n in Counter(text.split()).items():
        if w := normal(word):
            out[w] += n
    return out


def starts_of(word: str) -> list[str]:
    return [f"{n}:{word[:n]}" for n in (4, 5) if len(word) > n]


def with_starts(words: Counter, only: frozenset[str] | None = None) -> Counter:
    """Word counts, and those of the words' first letters (all, or ``only`` some)."""
    out = Counter(words)
    for w, n in words.items():
        for t in starts_of(w):
            if only is None or t in only:
                out[t] += n
    return out


def _telling(counted: list[Counter], labels: np.ndarray, halves: np.ndarray) -> list[tuple[float, str]]:
    """(least chi-square, term) of the terms tied to the label in both halves, strongest first."""
    score: dict[str, float] = {}
    for h in (0, 1):
        own = np.flatnonzero(halves == h)
        n, p = len(own), int(labels[own].sum())
        df, dfp = Counter(), Counter()
        for i in own:
            terms = with_starts(counted[i]).keys()
            df.update(terms)
            if labels[i]:
                dfp.update(terms)
        now = {}
        for t, c in df.items():
            if c < LEAST or (h and t not in score):
                continue
            a = dfp[t]
            b, miss, rest = c - a, p - a, n - p - (c - a)
            chi = n * (a * rest - b * miss) ** 2 / max(1.0, float(c) * (miss + rest) * (a + miss) * (b + rest))
            if chi >= CHI_SQUARE:
                now[t] = min(chi, score.get(t, chi))
        score = now
    return sorted(((c, t) for t, c in score.items()), key=lambda x: (-x[0], x[1]))


class ToxicityModel:
    """The examples' vectors, and the calibration; ``open`` builds the index."""

    def __init__(self, ids: list[int], words: list[Counter], halves: list[int], labels: list[int], shares: tuple[float, float], k: int = NEIGHBOURS) -> None:
        """``halves``: checksums of the texts; ``shares``: of the two classes among all rows that may be learnt from."""
        seen: dict[tuple, int] = {}
        for i in sorted(range(len(words)), key=lambda i: (ids[i] is None, ids[i] or 0)):
            seen.setdefault((halves[i], tuple(sorted(words[i].items()))), i)
        keep = list(seen.values())
        y = np.array([labels[i] for i in keep], np.int64)
        self.k, self.vocabulary, self.tied, self.ids, self.name = k, {}, frozenset(), np.empty(0, np.int64), uuid.uuid4().hex
        self.idf, self.labels, self.vote_weight, self.rare = np.empty(0), np.empty(0, np.int64), np.empty(0), 1.0
        self.knots, self.values, self.silent = np.array([0.0]), np.array([0.0]), 0.0
        self.at, self.of, self.weight = np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)
        if not len(y) or y.min() == y.max():
            return
        counted = [words[i] for i in keep]
        self.tied = frozenset(t for _, t in _telling(counted, y, np.array([halves[i] & 1 for i in keep])))
        counted = [with_starts(c, self.tied) for c in counted]
        df = Counter(t for c in counted for t in c)
        self.vocabulary = {t: j for j, t in enumerate(sorted(df))}
        self.rare = math.log(1 + len(y)) + 1
        self.idf = np.array([(math.log((1 + len(y)) / (1 + df[t])) + 1) * (BOOST if t in self.tied else 1.0) for t in self.vocabulary])
        vectors = [self._vector(np.array(sorted(self.vocabulary[t] for t in c), np.int64), c_) for c in counted for c_ in [np.array([n for _, n in sorted((self.vocabulary[t], n) for t, n in c.items())], float)]]
        # Examples that lead with the same terms lie together, so that blocks' bounds are sharp.
        share = np.bincount(np.concatenate([v[0] for v in vectors]), minlength=len(df)) / len(y)
        common = share > 0.05

        def place(i: int) -> tuple:
            at, w = vectors[i]
            strong = [t for t in at[np.argsort(-w, kind="stable")[:1]].tolist() if self.idf[t] > self.rare]
            usual = at[common[at]]
            return (strong, int(usual[(w[common[at]]).argmax()]) if len(usual) else -1, i)

        order = sorted((i for i in range(len(y)) if len(vectors[i][0])), key=place)
        self.ids = np.array([ids[keep[i]] if ids[keep[i]] is not None else -1 for i in order], np.int64)
        self.labels = y[order]
        weight = np.array([shares[c] / max(1e-12, float((y == c).mean())) for c in (0, 1)])
        self.vote_weight = weight[self.labels] if order else np.empty(0)
        lengths = np.array([len(vectors[i][0]) for i in order], np.int64)
        self.at = np.concatenate(([0], np.cumsum(lengths)))
        if order:
            self.of = np.concatenate([vectors[i][0] for i in order]).astype(np.int32)
            self.weight = np.concatenate([vectors[i][1] for i in order]).astype(np.float32)
        self._calibrate(y, weight, [i for i in range(len(y)) if not len(vectors[i][0])])

    def _vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of unit length; terms beyond the vocabulary only count for the length."""
        idf = np.full(len(at), self.rare)
        known = at < len(self.idf)
        idf[known] = self.idf[at[known]]
        w = (1 + np.log(n)) * idf
        length = math.sqrt((w * w).sum()) if len(w) else 1.0
        return at[known], w[known] / length

    def open(self) -> ToxicityModel:
        """Builds the index in the process that uses it; the stored form has the vectors only."""
        size, n = len(self.vocabulary), len(self.ids)
        self.blocks = -(-n // BLOCK)
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.at))
        order = np.argsort(self.of, kind="stable")  # by term, examples in order
        term, self.example, self.value = self.of[order], owner[order], self.weight[order]
        df = np.bincount(term, minlength=size)
        # Lists of frequent terms are rows of all blocks; the others (term, block) pieces of one list.
        self.row = np.full(size, -1, np.int64)
        frequent = np.flatnonzero(df > max(BLOCK, DENSE * n))
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), self.blocks * BLOCK), np.float32)
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], self.example[dense]] = self.value[dense]
        # As wide as sums need them, which saves a conversion for each text.
        term, self.example, self.value = term[~dense], self.example[~dense].astype(np.intp), self.value[~dense].astype(float)
        block = self.example // BLOCK
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(term) else np.empty(0, np.int64)
        self.piece_at = np.concatenate((first, [len(term)]))
        self.piece_block = block[first].astype(np.intp)
        self.piece_max = np.maximum.reduceat(self.value, first) if len(first) else np.empty(0)
        self.pieces = np.searchsorted(term[first], np.arange(size + 1))
        self.memo: dict[bytes, int] = {}
        self.unknown: dict[str, int] = {}
        # Terms that a word brings along: first letters that are tied to the label.
        starts = [[self.vocabulary[t] for t in starts_of(w) if t in self.tied] for w in self.vocabulary]
        self.starts = np.array([(x + [-1, -1])[:2] for x in starts], np.int64).reshape(-1, 2)
        self.new_starts: dict[int, list[int]] = {}
        return self

    def _term(self, word: bytes) -> int:
        """Number of a word's term, -1 for none; words of no example have numbers beyond the vocabulary."""
        w = normal(word)
        if not w:
            return -1
        if (own := self.vocabulary.get(w)) is None:
            own = self.unknown.setdefault(w, len(self.vocabulary) + len(self.unknown))
            if brought := [self.vocabulary[t] for t in starts_of(w) if t in self.tied]:
                self.new_starts[own] = brought
        return own

    def query(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a text, of unit length."""
        memo, words = self.memo, text.split()
        try:
            ids = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(memo) + len(words) > MEMO:
                memo.clear()
                self.unknown.clear()
                self.new_starts.clear()
            for w in set(words).difference(memo):
                memo[w] = self._term(w)
            ids = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        ids = ids[ids >= 0]
        known = ids < len(self.starts)
        brought = self.starts[ids[known]].ravel()
        more = [t for i in ids[~known].tolist() if i in self.new_starts for t in self.new_starts[i]] if self.new_starts else []
        return self._vector(*np.unique(np.concatenate((ids, brought[brought >= 0], np.array(more, np.int64))), return_counts=True))

    def dense_scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the rows of frequent terms add to each example's cosine, for several queries by one product."""
        q = np.zeros((len(queries), len(self.rows)), np.float32)
        for k, (at, w) in enumerate(queries):
            row = self.row[at]
            q[k, row[row >= 0]] = w[row >= 0]
        return q @ self.rows

    def nearest(self, at: np.ndarray, w: np.ndarray, skip: int = -1, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples with positive cosine (ties by place) and their cosines; exact. ``dense``: its row of ``dense_scores``."""
        if not len(at) or not self.blocks:
            return np.empty(0, np.int64), np.empty(0)
        dense = (self.dense_scores([(at, w)])[0] if dense is None else dense).reshape(-1, BLOCK)
        listed = self.row[at] < 0
        q, terms = w[listed], at[listed]
        a, b = self.pieces[terms], self.pieces[terms + 1]
        piece, q_piece = _ranges(a, b), np.repeat(q, b - a)
        block = self.piece_block[piece]
        bound = (dense.max(axis=1) + np.bincount(block, weights=q_piece * self.piece_max[piece], minlength=self.blocks)) * (1 + 1e-5)
        order = np.argsort(-bound, kind="stable")
        best_i, best_s = np.empty(0, np.int64), np.empty(0, np.float32)
        for some in (order[:FIRST], order[FIRST:]):
            floor = best_s[-1] if len(best_s) == self.k else np.float32(0)
            some = some[(bound[some] > 0) & (bound[some] >= floor)]
            if not len(some):
                break
            chosen = np.zeros(self.blocks, bool)
            chosen[some] = True
            use = np.flatnonzero(chosen[block])
            p = piece[use]
            a, b = self.piece_at[p], self.piece_at[p + 1]
            post = _ranges(a, b)
            s = np.bincount(self.example[post], weights=np.repeat(q_piece[use], b - a) * self.value[post], minlength=self.blocks * BLOCK).reshape(-1, BLOCK)
            s = (s[some] + dense[some]).ravel().astype(np.float32)
            ok = np.flatnonzero((s > 0) & (s >= floor))
            if len(ok) > 4 * self.k:  # all that reach the k-th largest, one more for the one to skip
                ok = ok[s[ok] >= np.partition(s[ok], len(ok) - self.k - 1)[len(ok) - self.k - 1]]
            of = some[ok // BLOCK] * BLOCK + ok % BLOCK
            here = of != skip
            i, s = np.concatenate((best_i, of[here])), np.concatenate((best_s, s[ok[here]]))
            top = np.lexsort((i, -s))[: self.k]
            best_i, best_s = i[top], s[top]
        return best_i, best_s.astype(float)

    def vote(self, at: np.ndarray, w: np.ndarray, skip: int = -1, dense: np.ndarray | None = None) -> tuple[float | None, np.ndarray, np.ndarray]:
        i, s = self.nearest(at, w, skip, dense)
        if not len(i):
            return None, i, s
        share = s * s * self.vote_weight[i]
        return float((share * self.labels[i]).sum() / share.sum()), i, s

    def _calibrate(self, y: np.ndarray, weight: np.ndarray, silent: list[int]) -> None:
        self.open()
        own = [(self.of[a:b].astype(np.int64), self.weight[a:b].astype(float)) for a, b in zip(self.at, self.at[1:])]
        votes = [(v, int(c)) for n, (x, c) in enumerate(zip(own, self.labels)) if (v := self.vote(*x, skip=n)[0]) is not None]
        # Pool adjacent violators: [weight, weighted sum of labels, highest vote].
        pools: list[list[float]] = []
        for v, c in sorted(votes):
            if pools and pools[-1][2] == v:
                pools[-1][0] += weight[c]
                pools[-1][1] += weight[c] * c
            else:
                pools.append([weight[c], weight[c] * c, v])
            while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
                b = pools.pop()
                pools[-1] = [pools[-1][0] + b[0], pools[-1][1] + b[1], b[2]]
        prior = float((weight[y] * y).sum() / weight[y].sum())
        self.knots = np.array([p[2] for p in pools] or [0.0])
        self.values = np.array([(p[1] + prior) / (p[0] + 1) for p in pools] or [prior])
        w = weight[y[silent]] if silent else np.empty(0)
        self.silent = float(((w * y[silent]).sum() if silent else 0.0) + prior) / float(w.sum() + 1)
        for name in ("example", "value", "row", "rows", "piece_at", "piece_block", "piece_max", "pieces", "memo", "unknown", "starts", "new_starts"):
            delattr(self, name)

    @classmethod
    def opened(cls, model: ToxicityModel) -> ToxicityModel:
        """The open model, kept in a Python worker between tasks."""
        return held((cls, model.name), model.open)

    def scores(self, data: list[bytes]) -> list[tuple[float, str]]:
        """For each text its probability and evidence, ``id:cosine`` of the three nearest examples."""
        out = []
        for k in range(0, len(data), BATCH):
            queries = [self.query(t) for t in data[k : k + BATCH]]
            for q, dense in zip(queries, self.dense_scores(queries)):
                v, i, s = self.vote(*q, dense=dense)
                p = self.silent
                if v is not None:
                    # The vote orders documents within a step.
                    p = 0.999 * self.values[min(int(np.searchsorted(self.knots, v)), len(self.values) - 1)] + 0.001 * v
                out.append((float(min(1.0, max(0.0, p))), ",".join(f"{self.ids[a]}:{b:.4f}" for a, b in zip(i[:3], s[:3]))))
        return out

    def score(self, text: bytes) -> tuple[float, str]:
        return self.scores([text])[0]


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers from each a to its b, one range after the other."""
    n = b - a
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(a - (ends - n), n)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fits on at most ``sample`` labelled rows that aren't held out, in one task; the driver gets the model only."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1))
    number = dict.fromkeys((0, 1), 0) | dict(map(tuple, known.groupBy("label").count().collect()))
    total = sum(number.values())
    shares = (number[0] / total, number[1] / total) if total else (1.0, 0.0)
    # The rarer class gets its half, or all it has; the other one the rest.
    toxic = min(number[1], max(sample // 2, sample - number[0]))
    chosen = {}
    for label, n in ((1, toxic), (0, sample - toxic)):
        for r in known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect():
            chosen[r.doc_id] = label
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = own.where(F.col("doc_id").isin(list(chosen))) if chosen else own.limit(0)

    counts_schema = pa.schema([("doc_id", pa.int64()), ("half", pa.int64()), ("words", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = texts(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(zlib.crc32, data), pa.int64()), pa.array([pickle.dumps(word_counts(t)) for t in data], pa.binary())], schema=counts_schema)

    def fit(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_pylist()
        model = ToxicityModel(ids, [pickle.loads(x) for x in table.column("words").to_pylist()], table.column("half").to_pylist(), [chosen[i] for i in ids], shares, k)
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    fitted = rows.mapInArrow(count, "doc_id long, half long, words binary").groupBy().applyInArrow(fit, "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else ToxicityModel([], [], [], [], shares, k)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``held_out``, ``score``, ``predicted``, ``evidence``."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("evidence", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = ToxicityModel.opened(model)
        for batch in batches:
            scored = opened.scores(texts(batch))
            p = [s for s, _ in scored]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array([e for _, e in scored], pa.string())], schema=schema)

    doc = F.col(id_col).cast("long")
    own = docs.select(doc.alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out(doc).alias("held_out"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence string")
