"""Chat formatting: raw transcripts parsed into turns and rendered canonically.

Method: a hidden Markov model over lines. Its states are the roles, each as the
first line of a turn or a later one; a line shows which speaker marker it begins
with (in any of many spellings, or none), its length, whether it asks, and whether a
blank line goes before. Parameters are smoothed counts over all labelled transcripts
that aren't held out, counted in tasks and summed; Viterbi's algorithm recovers the
likeliest roles of a whole transcript, and turns are rendered as
``<|role|>\\ntext<|end|>\\n``.

Plan: one shuffle by conversation gathers its turns, as one transcript is one value;
fitting and parsing are Arrow maps, and the driver gets the sums of some hundred counts.

The registered query renders each conversation of the table as a raw transcript (in
six marker styles, every eighth marker missing), learns from four fifths of them and
parses all. Those held out (by a checksum of their id) are written in other styles
and with other speaker names, which the model has not been fitted on.

Defined cases: null text is an empty turn, null or unknown role is the user's; rows
without conversation or turn are transcripts of their own; equal turns are ordered
by role and text, repeated rows are repeated turns; a transcript without lines has
no turns; an empty table gives no rows; other columns are ignored; very long turns
and conversations are parsed whole. Markers inside a text are escaped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
_NAMES = {"system": 0, "sys": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "q": 1, "question": 1, "you": 1, "prompt": 1, "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "a": 2, "answer": 2, "gpt": 2, "model": 2, "response": 2}
_MARKER = re.compile(r"\s*(?:#{1,4}\s*|\*{1,2}|\[|<\|?|>\s*)?(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")(?:\s*(?:\*{1,2}\s*:|:\s*\*{0,2}|\]\s*:?|\|?>|\*{1,2}$|$))\s*", re.IGNORECASE)
_SYMBOLS = 4 * 4 * 2 * 2


def marker(line: str) -> tuple[int, int]:
    """(role's number or -1, length of the marker)."""
    m = _MARKER.match(line)
    return (_NAMES[m[1].lower()], m.end()) if m else (-1, 0)


def symbols(lines: list[str]) -> np.ndarray:
    """What each line shows, as one number."""
    out = np.empty(len(lines), np.int64)
    blank_before = True
    for i, line in enumerate(lines):
        n = len(line)
        size = 0 if not line.strip() else 1 if n < 80 else 2 if n < 250 else 3
        out[i] = ((marker(line)[0] + 1) * 4 + size) * 4 + line.rstrip().endswith("?") * 2 + blank_before
        blank_before = size == 0
    return out


def role_counts(labelled: Iterable[tuple[list[str], list[int]]]) -> np.ndarray:
    """Sums over transcripts (lines and their states): first states, moves, symbols by state, one after the other."""
    n = 2 * len(ROLES)
    start, move, show = np.zeros(n, np.int64), np.zeros((n, n), np.int64), np.zeros((n, _SYMBOLS), np.int64)
    for lines, states in labelled:
        if lines:
            s = np.array(states)
            start[s[0]] += 1
            np.add.at(move, (s[:-1], s[1:]), 1)
            np.add.at(show, (s, symbols(lines)), 1)
    return np.concatenate((start, move.ravel(), show.ravel()))


class RoleModel:
    """State 2 x role is a turn's first line, 2 x role + 1 a later one."""

    def __init__(self, counts: np.ndarray, smoothing: float = 0.1) -> None:
        """``counts``: of first states, of moves and of symbols by state, as ``role_counts`` gives them."""
        n = 2 * len(ROLES)
        start, move, show = (x + smoothing for x in np.split(counts.astype(float), [n, n + n * n]))
        move, show = move.reshape(n, n), show.reshape(n, _SYMBOLS)
        start[1::2] = 0
        for a in range(n):  # a later line follows a line of its own role only
            move[a, [2 * r + 1 for r in range(len(ROLES)) if r != a // 2]] = 0
        with np.errstate(divide="ignore"):
            self.start, self.move, self.show = (np.log(x / x.sum(axis=-1, keepdims=True)) for x in (start, move, show))

    def viterbi(self, shown: np.ndarray) -> list[int]:
        """The likeliest states; of equals the first."""
        if not len(shown):
            return []
        score, back = self.start + self.show[:, shown[0]], []
        for x in shown[1:]:
            reach = score[:, None] + self.move
            back.append(reach.argmax(axis=0))
            score = reach.max(axis=0) + self.show[:, x]
        states = [int(score.argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return states[::-1]

    def turns(self, transcript: str) -> list[tuple[str, str]]:
        """(role, text) of each turn; markers and the blank lines around a turn are dropped."""
        lines = transcript.split("\n") if transcript else []
        out: list[tuple[int, list[str]]] = []
        for line, s in zip(lines, self.viterbi(symbols(lines))):
            if s % 2 == 0:
                role, end = marker(line)
                out.append((s // 2, [line[end:] if role == s // 2 else line]))
            else:
                out[-1][1].append(line)
        return [(ROLES[r], "\n".join(x).strip("\n")) for r, x in out]


def render(turns: Iterable[tuple[str, str]]) -> str:
    """Canonical form; a backslash keeps markers inside a text apart from ours."""
    return "".join(f"<|{role}|>\n{re.sub(r'<(?=[\\|])', lambda m: '<' + chr(92), text)}<|end|>\n" for role, text in turns)


def unrender(chat: str) -> list[tuple[str, str]]:
    """Inverse of ``render``."""
    return [(r, re.sub(r"<\\(?=[\\|])", "<", t)) for r, t in re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", chat, re.DOTALL)]


_STYLES = (
    ("System: ", "User: ", "Assistant: "), ("### System:\n", "### Human:\n", "### Assistant:\n"), ("[system] ", "[user] ", "[assistant] "),
    ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"), ("Instructions: ", "Q: ", "A: "), ("**System**: ", "**You**: ", "**AI**: "),
)
#: Styles of the held-out transcripts, with markers that the others don't have.
_OTHER_STYLES = (("SYS: ", "Customer: ", "Agent: "), ("## Instructions:\n", "## Prompt:\n", "## Response:\n"), ("[sys] ", "[question] ", "[answer] "))


def is_held_out(conv_id: int | None) -> bool:
    return conv_id is not None and zlib.crc32(str(conv_id).encode()) % 5 == 0


def as_transcript(conv_id: int | None, turns: list[tuple[str | None, str | None]], styles: tuple[tuple[str, str, str], ...] = _STYLES) -> tuple[str, list[int]]:
    """A raw transcript as exports have it, and its lines' states: one style of markers each, every eighth marker or so missing."""
    h = zlib.crc32(str(conv_id).encode()) // 5
    style = styles[h % len(styles)]
    lines: list[str] = []
    states: list[int] = []
    for k, (role, text) in enumerate(turns):
        r = ROLES.index(role) if role in ROLES else 1
        bare = zlib.crc32(f"{conv_id}:{k}".encode()) % 8 == 0
        body = (("" if bare else style[r]) + (text or "")).split("\n")
        if k and (bare or h % 2):
            lines.append("")
            states.append(states[-1] | 1)
        lines += body
        states += [2 * r] + [2 * r + 1] * (len(body) - 1)
    return "\n".join(lines), states


def gathered(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``, an array of (turn, role, text) in order; rows without conversation or turn stay alone."""
    conv, turn = F.col(id_col).cast("long"), F.col(turn_col).cast("long")
    alone = F.when(conv.isNull() | turn.isNull(), F.monotonically_increasing_id())
    rows = conversations.select(conv.alias("conv_id"), alone.alias("alone"), F.struct(turn.alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("row"))
    return rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("row")).alias("turns")).select("conv_id", "turns")


def transcripts_of(conversations: DataFrame, **columns) -> DataFrame:
    """The table's conversations as raw transcripts: ``conv_id``, ``held_out``, ``n_true``, ``true_roles``, ``transcript``, ``states`` of its lines."""
    names = ["conv_id", "held_out", "n_true", "true_roles", "transcript", "states"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            turns = [[(x["role"], x["text"]) for x in t] for t in batch.column(1).to_pylist()]
            apart = [is_held_out(c) for c in ids]
            raw = [as_transcript(c, t, _OTHER_STYLES if h else _STYLES) for c, t, h in zip(ids, turns, apart)]
            roles = [",".join(r if r in ROLES else "user" for r, _ in t) for t in turns]
            columns = [batch.column(0), pa.array(apart), pa.array(map(len, turns), pa.int64()), pa.array(roles, pa.string()), pa.array([r for r, _ in raw], pa.string()), pa.array([bytes(s) for _, s in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return gathered(conversations, **columns).mapInArrow(run, "conv_id long, held_out boolean, n_true long, true_roles string, transcript string, states binary")


def fit_roles(transcripts: DataFrame) -> RoleModel:
    """Fits on all of ``transcripts`` (transcript, states, held_out) that aren't held out."""
    n = 2 * len(ROLES)
    size = n + n * n + n * _SYMBOLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += role_counts((t.split("\n"), list(s)) for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if s)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["place", "seen"])

    rows = transcripts.where("not held_out").select("transcript", "states").mapInArrow(run, "place long, seen long").groupBy("place").agg(F.sum("seen").alias("seen")).collect()
    counts = np.zeros(size, np.int64)
    for r in rows:
        counts[r.place] = r.seen
    return RoleModel(counts)


def parse_transcripts(transcripts: DataFrame, model: RoleModel, *, keep: tuple[str, ...] = (), text_col: str = "transcript") -> DataFrame:
    """``keep`` columns, ``n_turns``, ``roles`` (comma-joined) and ``chat``, the canonical form of each whole transcript."""
    own = transcripts.select(*keep, F.col(text_col).cast("string").alias("raw_transcript"))
    names = [*keep, "n_turns", "roles", "chat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [model.turns(t or "") for t in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(map(len, parsed), pa.int64()), pa.array([",".join(r for r, _ in p) for p in parsed], pa.string()), pa.array(map(render, parsed), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-1])
    return own.mapInArrow(run, kept + "n_turns long, roles string, chat string")
