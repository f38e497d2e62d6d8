"""Token counts from a tokenizer compiled to a finite-state transducer.

Method: a byte-level BPE tokenizer is compiled into a deterministic transducer
whose transitions carry the number of tokens they emit (less where tokens merge);
the chunks of a text over ``CHUNK`` bytes become maps from an entry state to an exit
state with a count, and these compose associatively in a tree (the up-sweep of a
prefix scan, of which only the last value is wanted), in the task that has the text.
A chunk's map doesn't depend on its entry beyond its first sure start of a pre-token,
so that every character is read once, in any language, and time is linear.

*Inside a pre-token.* BPE has one tokenization for every prefix, and a token may
end a prefix only if it survives next to the token before it (Berglund and van der
Merwe, "Formalizing BPE tokenization"). A state therefore is the set of open
vocabulary prefixes, each with the token before it and its count relative to the
state's own; both are bounded, so the states are finitely many. They are
determinized on demand in each Python worker and kept. A transition's emission
is the change of the count, which may be negative when tokens merge.

*Between pre-tokens.* ``TextTransducer.run`` steps from any state. A space (or line feed) between two characters that are not
white space always starts a pre-token. What lies between two such places is an
atom; the transducer's whole run over an atom is kept as one composite transition.

Defined cases: null or empty text has 0 bytes and 0 tokens; texts of any length
are counted whole; special strings inside a text count as one token each; ids are
passed through (null too); repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshape.llm.common import held, texts
from docshape.llm.packing import _byte_alphabet

#: How byte-level BPE cuts a text into pre-tokens (published with the vocabulary).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a chunk of a long text; entries of the memos of composite transitions; compiled transitions.
CHUNK, MEMO, ARCS = 65_536, 1_000_000, 1_500_000
#: Bytes of an atom that is remembered.
LONG_ATOM = 64

_SPACE = regex.compile(r"\s")
_PLAIN = regex.compile("(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.!?;:]?)")


class BpeTransducer:
    """Deterministic transducer over the bytes of one pre-token."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        alphabet = _byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        # Tokens are numbered by age: bytes first, then merges in order of rank.
        number = {alphabet[b]: b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.merged: dict[tuple[int, int], int] = {}
        spelled = [alphabet[b] for b in range(256)]
        for merge in merges:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            if a + b in vocabulary and a + b not in number:
                pair = number[a], number[b]
                number[a + b] = self.merged[pair] = len(self.parts)
                self.parts.append(pair)
                spelled.append(a + b)
        self.sound: dict[tuple[int, int], bool] = {}
        # The vocabulary as a trie: arcs[node << 8 | byte] is the next node, ends[node] its token.
        self.arcs: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for token, s in enumerate(spelled):
            node = 0
            for c in s:
                key = node << 8 | back[c]
                if key not in self.arcs:
                    self.arcs[key] = nodes
                    nodes += 1
                node = self.arcs[key]
            self.ends[node] = token
        self.reachable: dict[int, bool] = {b: True for b in range(256)}
        # A state: open trie nodes, each with the token before it (-1: none) and its count less the state's.
        start = ((0, -1, 0),)
        self.states: dict[tuple, int] = {start: 0}
        self.open: list[tuple] = [start]
        self.step: dict[int, tuple[int, int]] = {}

    def trim(self) -> None:
        """Forgets the compiled states once they are many; they are compiled anew when met."""
        if len(self.step) > ARCS:
            start = self.open[0]
            self.states, self.open = {start: 0}, [start]
            self.step.clear()
            self.sound.clear()

    def _can_stay(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b as they are when they adjoin.

        Undoing the younger of the two at the seam again and again shows every pair
        that met there; one that merges before the seam's tokens were complete spoils it.
        """
        key = a, b
        if (known := self.sound.get(key)) is not None:
            return known
        parts, merged, before, good = self.parts, self.merged, 1 << 60, True
        while True:
            if (m := merged.get((a, b))) is not None and m < before:
                good = False
                break
            left, right = parts[a], parts[b]
            if left is None and right is None:
                break
            if right is None or (left is not None and a > b):
                before, a = a, left[1]
            else:
                before, b = b + 1, right[0]
        self.sound[key] = good
        return good

    def _is_reachable(self, token: int) -> bool:
        if (known := self.reachable.get(token)) is None:
            a, b = self.parts[token]
            # The seam's own merge is this token; no earlier merge may cross it.
            known = self._is_reachable(a) and self._is_reachable(b) and self._seam_merges_last(a, b, token)
            self.reachable[token] = known
        return known

    def _seam_merges_last(self, a: int, b: int, token: int) -> bool:
        del self.merged[(a, b)]
        self.sound.pop((a, b), None)
        good = self._can_stay(a, b)
        self.merged[(a, b)] = token
        self.sound[(a, b)] = False
        return good

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from a state by a byte: next state, emitted tokens."""
        arcs, ends = self.arcs, self.ends
        grown, last, emitted = [], -1, 0
        for node, before, count in self.open[state]:
            if (to := arcs.get(node << 8 | byte)) is not None:
                grown.append((to, before, count))
                token = ends.get(to, -1)
                if token >= 0 and last < 0 and self._is_reachable(token) and (before < 0 or self._can_stay(before, token)):
                    last, emitted = token, count + 1
        key = (*((n, t, c - emitted) for n, t, c in grown), (0, last, 0))
        if (to := self.states.get(key)) is None:
            to = self.states[key] = len(self.open)
            self.open.append(key)
        self.step[state << 8 | byte] = to, emitted
        return to, emitted

    def trim_long(self) -> None:
        """As ``trim``, between the chunks of a long text: states that are held stay what they are."""
        if len(self.step) > ARCS:
            self.step.clear()

    def count(self, pre_token: bytes) -> int:
        return self.run(0, pre_token)[1]

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """(state after ``data``, tokens emitted) from a state inside a pre-token."""
        total = 0
        step = self.step
        for byte in data:
            arc = step.get(state << 8 | byte)
            if arc is None:
                arc = self._compile(state, byte)
            state = arc[0]
            total += arc[1]
        return state, total


class TextTransducer:
    """Counts the tokens of whole texts for a byte-level BPE tokenizer file.

    A state is what is open where the text was left: nothing; a run of letters, numbers
    or other signs with the state of its bytes; white space, whose last character may
    yet belong to what follows; or an apostrophe that may become a contraction. Each
    transition emits the change of the count, as if the text ended there.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
        self.bpe = BpeTransducer(spec["model"]["vocab"], spec["model"]["merges"])
        self.special = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.split = regex.compile(PRE_TOKEN)
        self.special_split = regex.compile(b"|".join(map(regex.escape, self.special))) if self.special else None
        self.atoms: dict[bytes, int | None] = {}
        self.words: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> TextTransducer:
        return held((cls, path), lambda: cls(path))

    def pre_tokens(self, text: str) -> int:
        """Tokens of a text, pre-token by pre-token."""
        return sum(self.bpe.count(p.encode()) for p in self.split.findall(text))

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """(state after ``text``, tokens emitted): the transducer itself, from any state."""
        total, bpe = 0, self.bpe
        for m in _RUNS.finditer(text):
            kind, part = m.lastgroup, m[0]
            # An apostrophe that began a pre-token, and the letter after it, may be a contraction.
            while state[0] == "quote" and kind == "letter" and part:
                pending = state[1] + part[0]
                if pending in _CONTRACTIONS:
                    total += bpe.count(pending.encode()) - len(state[1])
                    state, part = START, part[1:]
                elif pending in _HALF:
                    state, part = ("quote", pending), part[1:]
                    total += 1
                else:
                    state = ("letter", bpe.run(0, state[1][1:].encode())[0]) if len(state[1]) > 1 else START
            if not part:
                continue
            if state[0] == "quote":
                state = ("other", bpe.run(0, b"'")[0]) if state[1] == "'" else ("letter", bpe.run(0, state[1][1:].encode())[0])
            if kind == "space":
                own, before = (state[1], state[2]) if state[0] == "space" else (0, 0)
                for c in part:
                    own, before = bpe.run(own, c.encode())
                    total += before
                state = ("space", own, before, part[-1])
                continue
            at = 0
            if state[0] == "space":
                # All but the last character were a pre-token; that one is a space before this run, or alone.
                total -= state[2]
                if state[3] == " ":
                    at, emitted = bpe.run(0, b" ")
                    total += emitted
                    state = (kind, at)
                else:
                    total += bpe.count(state[3].encode())
                    state = START
            if state[0] == kind:
                at = state[1]
            elif kind == "other" and part[0] == "'":
                if part == "'":
                    state = ("quote", "'")
                    total += 1
                    continue
            at, emitted = bpe.run(at, part.encode())
            total += emitted
            state = (kind, at)
        return state, total

    def _learn(self, atom: bytes) -> int | None:
        """Composite transition of an atom after a space; None where its ends don't bound pre-tokens."""
        text = atom.decode()
        if m := _PLAIN.fullmatch(text):
            line, word, mark = m.groups()
            spelled = word if line else " " + word
            if (n := self.words.get(spelled)) is None:
                n = self.words[spelled] = self.bpe.count(spelled.encode())
            return n + bool(line) + bool(mark)
        line = text[:1] == "\n"
        word = text[1:] if line else text
        if not word or _SPACE.match(word[0]) or _SPACE.match(word[-1]):
            return None
        return self.pre_tokens(text) if line else self.pre_tokens(" " + text)

    def plain(self, part: bytes) -> int:
        """Tokens of a part of at most some chunks, without special strings."""
        # A line feed becomes an atom's first character, so that lines needn't be split apart.
        atoms = part.replace(b"\n", b" \n").split(b" ")
        first = atoms[0]
        memo = self.atoms
        try:
            # First atom has no space before it and may start with anything.
            text = first.decode()
            if not text or _SPACE.match(text[-1]):
                raise TypeError
            total = self.pre_tokens(text)
            rest = atoms[1:]
            try:
                return total + sum(map(memo.__getitem__, rest))
            except KeyError:
                if len(memo) + len(rest) > MEMO:
                    memo.clear()
                    self.words.clear()
                    self.bpe.trim()
                long: dict[bytes, int | None] = {}
                for a in set(rest).difference(memo):
                    (memo if len(a) <= LONG_ATOM else long)[a] = self._learn(a)
                return total + (sum(long[a] if a in long else memo[a] for a in rest) if long else sum(map(memo.__getitem__, rest)))
        except TypeError:  # runs of white space: pre-tokens reach over atoms
            return self.pre_tokens(part.decode())

    def count(self, text: bytes) -> int:
        parts = self.special_split.split(text) if self.special_split and any(s in text for s in self.special) else [text]
        return len(parts) - 1 + sum(self.plain(p) if len(p) <= CHUNK else scan(self.chunks(p), self)(START, self)[1] for p in parts)

    def chunks(self, data: bytes) -> list[ChunkMap]:
        """Maps of the chunks of a long text, which end between characters."""
        out, at = [], 0
        while at < len(data):
            end = at + CHUNK
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
            out.append(self.chunk(data[at:end].decode()))
            self.bpe.trim_long()
            at = end
        return out

    def chunk(self, text: str) -> ChunkMap:
        first = _BOUND.search(text)
        if not first:
            return ChunkMap([text], None, 0)
        a = b = first.start()
        for w in (256, 4096, len(text)):
            for last in _BOUND.finditer(text, max(a, len(text) - w)):
                b = last.start()
            if b > a:
                break
        state, emitted = self.run(START, text[b:])
        return ChunkMap([text[:a]] if a else [], state, (self.plain(text[a:b].encode()) if b > a else 0) + emitted)


START = ("start",)
_CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
_HALF = frozenset(["'r", "'v", "'l"])
_RUNS = regex.compile(r"(?P<letter>\p{L}+)|(?P<number>\p{N}+)|(?P<other>[^\s\p{L}\p{N}]+)|(?P<space>\s+)")
#: A pre-token surely starts here, whatever went before: the kind of sign changes (a letter after an apostrophe may be a contraction's).
_BOUND = regex.compile(r"(?<=\S)\s|(?<=\p{L})[^\s\p{L}]|(?<=\p{N})[^\s\p{N}]|(?<=[^\s\p{L}\p{N}])\p{N}|(?<=[^\s\p{L}\p{N}'])\p{L}")


class ChunkMap:
    """A chunk as a map from the state on entry to (the state on exit, tokens emitted).

    From the chunk's first sure start of a pre-token on, the entry no longer matters:
    ``state`` and ``count`` hold for all entries, and only ``head``, what lies before,
    is run from the state that comes in. Without such a start all of it is head
    (``state`` None). Heads are kept as lists, so that joining copies no text.
    """

    __slots__ = ("head", "state", "count")

    def __init__(self, head: list[str], state: tuple | None, count: int) -> None:
        self.head, self.state, self.count = head, state, count

    def __call__(self, entry: tuple, machine: TextTransducer) -> tuple[tuple, int]:
        total = 0
        for text in self.head:
            entry, emitted = machine.run(entry, text)
            total += emitted
        return (entry, total) if self.state is None else (self.state, total + self.count)

    def then(self, other: ChunkMap, machine: TextTransducer) -> ChunkMap:
        """The map of both chunks in a row; associative. ``other``'s head is run where the state it meets is known, so once."""
        if self.state is None:
            return ChunkMap(self.head + other.head, other.state, other.count)
        state, emitted = other(self.state, machine)
        return ChunkMap(self.head, state, self.count + emitted)


def scan(maps: list[ChunkMap], machine: TextTransducer) -> ChunkMap:
    """Composition of all maps by pairs: a logarithmic number of rounds of independent compositions, linear work."""
    while len(maps) > 1:
        maps = [a.then(b, machine) for a, b in zip(maps[::2], maps[1::2])] + maps[len(maps) & ~1 :]
    return maps[0]


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``. No shuffle."""

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = TextTransducer.of(tokenizer)
        for batch in batches:
            data = texts(batch)
            counts = [machine.count(t) if t else 0 for t in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
