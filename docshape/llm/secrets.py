"""Secret scans: fixed patterns, and random-looking strings told from identifiers.

Method: two character Markov chains, one of random strings and one of ordinary
identifiers, are trained from labelled samples; a long token is a secret where the
log-likelihood ratio of the two exceeds a threshold that held-out identifiers
exceed at most once in ``FALSE_ALARMS`` tokens. The fixed patterns find theirs
first; the chains judge whole tokens of ``LEAST`` characters or more and only add
spans, of kind ``markov``, beside them: 97 % and more of random strings of 12 to 15
characters of the usual alphabets, 99 % of longer ones; digits alone are never judged.

One Arrow map over whole texts, no shuffle; the model is a few tens of kB and its
size does not depend on the data.

Defined cases: null or empty text has no spans; positions count code points, ends
exclusive; ids are passed through (null too), other columns are ignored by
``scan_secrets`` and kept by ``redact_secrets``; repeated rows are repeated; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Characters of the shortest token that the chains judge.
LEAST = 12
#: Tokens that the chains judge: whole runs of these, not beside other letters or digits.
_TOKEN = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{12,}(?![\w+/=-])")
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(_SYMBOLS.encode(), np.uint8)] = np.arange(len(_SYMBOLS))
#: One false alarm in so many held-out identifiers.
FALSE_ALARMS = 2000


class MarkovChain:
    """First-order character chain with start symbol and additive smoothing."""

    def __init__(self, samples: Iterable[str], smoothing: float = 0.5) -> None:
        n = len(_SYMBOLS)
        counts = np.full((n + 1, n), smoothing)
        for s in samples:
            c = codes(s)
            if len(c):
                np.add.at(counts, (np.concatenate(([n], c[:-1])), c), 1)
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)

    def score(self, s: str) -> float:
        c = codes(s)
        return float(self.log[np.concatenate(([len(_SYMBOLS)], c[:-1])), c].sum()) if len(c) else 0.0


def codes(s: str) -> np.ndarray:
    c = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
    return c[c >= 0]


class SecretModel:
    """Two chains and the threshold of their log-likelihood ratio."""

    def __init__(self, samples: Iterable[tuple[str, int]]) -> None:
        """``samples``: (string, 1 for random or 0 for an ordinary identifier); every fifth is held out for the threshold."""
        rows = list(samples)
        fit = [x for i, x in enumerate(rows) if i % 5]
        self.random = MarkovChain(s for s, y in fit if y)
        self.ordinary = MarkovChain(s for s, y in fit if not y)
        held = sorted((self.ratio(s) for i, (s, y) in enumerate(rows) if not i % 5 and not y), reverse=True)
        self.threshold = max(5.0, held[len(held) // FALSE_ALARMS] if held else 0.0)

    def ratio(self, s: str) -> float:
        return self.random.score(s) - self.ordinary.score(s)

    def is_secret(self, s: str) -> bool:
        return not s.isdigit() and self.ratio(s) > self.threshold


_WORDS = (
    "access account action active address agent array async auth backup balance base batch binary block body buffer build button cache call card channel char check child class click client close cluster code color column command commit config connect console const content context control cookie copy count create current cursor data date debug default delete depth detail device dialog digest disk document domain download driver edge element email enable encode engine entity error event export factory feature field file filter find first flag folder font format frame function gateway global graph group handler hash header height hidden host image import index info init input insert instance item job join key label language last layer layout length level library limit line link list load local location lock log login loop main manager map mask match max memory menu merge message method min mode model module mount name next node note null number object offset open option order output owner package page panel param parent parse part password path pattern pending person phone pixel player point policy pool port position post prefix print process product profile project property proxy public query queue random range rate reader record region register release remote remove render reply report request reset resource response result return role root route row rule sample save scan schema scope score screen script search section select sender server service session shared signal simple size socket sort source space stack start state status step storage stream string style submit suffix support switch system table tag target task template term test text thread time title token tool total track transaction tree trigger type union unit update upload user util value vector version video view visible wait watch width window worker write zone"
).split()
#: Syllables of ordinary prose in several languages: words may be long without being random.
_SYLLABLES = "the er in on an re ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ing ion tion ent ment ance able ness ship der die und sch ein ich lich keit heit ung ver ber gen zu auf ge be ach tz pf que eau eux aux oi ou ai pa vi tre elle aire eur con com pro ado ción dad mente ar er ir os as lo la el es ue ra ro co ca bo za ja ll rr ez ia to ta te ti wh sh ch st ly th ng ck is ff ss tt ous ful ght str ph sch qu oo ee ea ai".split()


@lru_cache(maxsize=4)
def labelled_samples(n: int = 40_000, seed: int = 7) -> tuple[tuple[str, int], ...]:
    """Labelled strings to train from: random ones of the usual alphabets, and identifiers and words."""
    rng = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", _SYMBOLS[:62], _SYMBOLS[:62] + "+/", _SYMBOLS[:62] + "_-"]
    out: list[tuple[str, int]] = []
    for i in range(n // 2):
        out.append(("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(LEAST, 48))), 1))
        parts = rng.choices(_WORDS, k=rng.randint(2, 5))
        shape = rng.randrange(7)
        if shape == 0:
            s = parts[0] + "".join(p.title() for p in parts[1:])
        elif shape == 1:
            s = "_".join(parts)
        elif shape == 2:
            s = "-".join(parts)
        elif shape == 3:
            s = "_".join(parts).upper()
        elif shape == 4:
            s = "/".join(parts)
        else:
            s = "".join(x for x in rng.choices(_SYLLABLES, k=rng.randint(4, 9)) if x.isascii())
            s = s.title() if rng.random() < 0.3 else s.upper() if rng.random() < 0.1 else s
        out.append((s + (str(rng.randint(1, 2030)) if rng.random() < 0.15 else ""), 0))
    return tuple(out)


@lru_cache(maxsize=1)
def default_model() -> SecretModel:
    return SecretModel(labelled_samples())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans


def all_spans(text: str, model: SecretModel, memo: dict[str, bool] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and the spans that the method adds, each sorted."""
    base, added = base_spans(text), []
    long = [w for w in text.split() if len(w) >= LEAST]
    at = 0
    for w in long:  # hex runs and judged tokens hold no white space, so they lie in long words
        at = text.index(w, at)
        base += [(at + m.start(), 2, at + m.end()) for m in _HEX.finditer(w)]
        for m in _TOKEN.finditer(w):
            s = m[0]
            if memo is None:
                secret = model.is_secret(s)
            elif (secret := memo.get(s)) is None:
                if len(memo) >= 100_000:
                    memo.clear()
                secret = memo[s] = model.is_secret(s)
            if secret:
                added.append((at + m.start(), 3, at + m.end()))
        at += len(w)
    return sorted(base), sorted(x for x in added if not any(a <= x[0] and x[2] <= b for a, _, b in base))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, model: SecretModel | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: numbers of base matches, their digest, and all spans as ``kind:start:end``."""
    model = model or default_model()
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, added = all_spans(text or "", model, memo)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added))))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, model: SecretModel, mark: str, memo: dict[str, bool] | None = None) -> str:
    base, added = all_spans(text, model, memo)
    out, at = [], 0
    for a, _, b in sorted(base + added):
        if a > at or not out:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact_secrets(docs: DataFrame, model: SecretModel | None = None, *, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns with every span in the text replaced by ``mark``; null stays null."""
    model = model or default_model()

    @F.pandas_udf(T.StringType())
    def redact(column):
        memo: dict[str, bool] = {}
        return column.map(lambda t: t if t is None else redacted(t, model, mark, memo))

    return docs.withColumn(text_col, redact(F.col(text_col)))
