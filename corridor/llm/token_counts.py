"""Token counts by a compiled finite-state tokenizer whose chunk state maps compose.

The tokenizer is a deterministic machine over characters. Its state is what kind of word is open, the state of the piece transducer inside it (see bpe.py), and the
byte that is held back until it is known whether the word ends with it. Every transition carries the number of tokens that it emits; transitions over whole words are
stored as such, with the sum. The map of a chunk has, for each entry state that can occur, the exit state and the number of tokens between; maps of neighbouring chunks
compose by looking one's exit states up in the other, and the maps of a text's chunks are combined by a parallel prefix scan: pairs, pairs of pairs, and so on.

Which entry states can occur is told by the characters before a chunk. White space, digits, and a change between letters and other characters bring the machine into a
known state, so mostly there is one. In a stretch of one kind the state is that of a piece which ended not long before, and of the symbols since; all pieces that can have
ended there are followed, and soon most of them agree. An entry state that was not foreseen is read from the text itself; that costs time, nothing else.

Empty and null texts have 0 bytes and 0 tokens, an empty table gives none. Rows are independent: repeated and null ids keep a row each. Texts of any length are read
whole, in chunks of ``CHUNK`` characters; memory per task is bounded by one text and the stored words and transitions. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corridor.llm import bpe
from corridor.llm.common import documents, map_arrow, uncollected

CHUNK = 1 << 13
#: Fixed value: the words that the machine below cuts, in lower-case text.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Characters for which NFC changes nothing and lower case is one character, whatever the library's version of Unicode: Latin letters, no combining marks.
PLAIN = re.compile("[\x00-įı-ſ‐-‧‰-⁞€]*")


class Words(dict):
    """Word to what the transducer emits for it. Holds a bounded number of words, in two generations: when one is full, those that it has not been asked for go."""

    def __init__(self, emit) -> None:
        super().__init__()
        self.emit, self.older = emit, {}

    def __missing__(self, word: str):
        if len(self) >= bpe.WORDS:
            self.older = dict(self)
            self.clear()
        out = self.older.get(word)
        out = self[word] = self.emit(word) if out is None else out
        return out


#: What a word is so far: none is open; letters; neither letters nor digits; an apostrophe that began it; and that with r, v or l, which may yet become a word of three.
OUT, LETTERS, OTHERS, MARK, MARKED = range(5)


@dataclass
class Map:
    """ways: by the key of an entry state, the exit state and the number of tokens. lo, hi: the places of the text that it leads from and to."""

    ways: dict[tuple, tuple[tuple, int]]
    lo: int
    hi: int


def key(state: tuple) -> tuple:
    mode, inner, held = state
    return mode, inner.last, inner.waiting, held


class Counter:
    """Counts tokens as the tokenizers library does for a file with lower-casing word-end BPE."""

    def __init__(self, path: str) -> None:
        self.machine, spec = bpe.from_json(path)
        self.special = re.compile("|".join(re.escape(a["content"]) for a in spec["added_tokens"]) or r"(?!)")
        parts = spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else [spec["pre_tokenizer"]]
        split = next((p for p in parts if p["type"] == "Split"), None)
        known = spec["model"].get("end_of_word_suffix") and split and split["behavior"] == "Removed" and split["invert"] and split["pattern"]["Regex"] == CUTS
        if not known or [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: the transducer is compiled for NFC, lower case and words without white space")
        self.split = bpe.splitter(CUTS)
        self.white, self.kinds = (regex.compile(bpe.white(p)) for p in (r"\s", r"(\s)|(\p{L})|(\p{N})"))
        self.stretches = {LETTERS: regex.compile(r"\p{L}+"), OTHERS: regex.compile(bpe.white(r"[^\s\p{L}\p{N}]+"))}
        self.longest = max(map(len, self.machine.pieces))
        self.normal = _normalizer(path)
        self.words = Words(self.emitted)
        self.outside = (OUT, self.machine.start, "")

    def emitted(self, word: str) -> int:
        own = word.encode().decode("latin-1")
        return self.machine.count(own[:-1] + chr(ord(own[-1]) + 256))

    def read(self, text: str) -> int:
        """The tokens of a text that begins and ends outside of words."""
        return sum(map(self.words.__getitem__, self.split(text)))

    def fed(self, state: tuple, chars: str, mode: int) -> tuple[tuple, int]:
        """Characters more of the open word: their bytes go to the transducer, but for the last, which is held back."""
        _, inner, held = state
        total, own = 0, held + chars.encode().decode("latin-1")
        for x in own[:-1]:
            inner, _, n = inner.next.get(x) or self.machine.step(inner, x)
            total += n
        return (mode, inner, own[-1]), total

    def closed(self, state: tuple) -> int:
        """The tokens that are emitted when the open word ends here."""
        mode, inner, held = state
        if mode == OUT:
            return 0
        if len(held) > 1:  # an apostrophe and a letter that turn out to be two words
            return self.emitted(held[0]) + self.emitted(held[1])
        inner, _, n = inner.next.get(x := chr(ord(held) + 256)) or self.machine.step(inner, x)
        return n + len(inner.final)

    def begun(self, char: str, kind: int | None) -> tuple[tuple, int]:
        if kind == 1:
            return self.outside, 0
        if kind == 3:
            return self.outside, self.emitted(char)
        return self.fed((OUT, self.machine.start, ""), char, LETTERS if kind == 2 else MARK if char == "'" else OTHERS)

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The transition of a character: the next state, and the tokens emitted."""
        kind = m.lastindex if (m := self.kinds.match(char)) else None
        mode, inner, held = state
        if (mode == LETTERS and kind == 2) or (mode in (OTHERS, MARK) and kind is None):
            return self.fed(state, char, LETTERS if kind == 2 else OTHERS)
        if mode == MARK and char in "stmd":
            return self.outside, self.emitted("'" + char)
        if mode == MARK and char in "rvl":
            return (MARKED, inner, "'" + char), 0
        if mode == MARKED:
            if held + char in ("'re", "'ve", "'ll"):
                return self.outside, self.emitted(held + char)
            open_, _ = self.begun(held[1], 2)
            after, n = self.step(open_, char)
            return after, self.emitted("'") + n
        after, n = self.begun(char, kind)
        return after, self.closed(state) + n

    def run(self, state: tuple, text: str, at: int = 0, end: int | None = None) -> tuple[tuple, int]:
        """All transitions from one place of a text to another."""
        total, end = 0, len(text) if end is None else end
        while at < end:
            own = self.stretches.get(state[0])
            if own and (m := own.match(text, at, end)):
                state, n = self.fed(state, m[0], state[0])
                at = m.end()
            else:
                state, n = self.step(state, text[at])
                at += 1
            total += n
        return state, total

    def kind(self, char: str) -> int | None:
        return m.lastindex if (m := self.kinds.match(char)) else None

    def known(self, text: str, at: int) -> tuple | None:
        """The state behind the character at a place, where it is the same whatever came before."""
        kind, before = self.kind(text[at]), self.kind(text[at - 1]) if at else 1
        if kind in (1, 3):
            return self.outside
        if before in (1, 3) or (kind is None and before == 2) or (kind == 2 and before is None and text[at - 1] != "'"):
            return self.begun(text[at], kind)[0]
        return None

    def entries(self, text: str, at: int) -> list[tuple]:
        """The states that can occur at a place of a text."""
        back = 4 * self.longest
        for k in range(at - 1, max(-1, at - 1 - back), -1):
            if (state := self.known(text, k)) is not None:
                return [self.run(state, text, k + 1, at)[0]]
        if at <= back:
            return [self.run(self.outside, text, 0, at)[0]]
        own = text[at - back : at].encode().decode("latin-1")
        live: dict[tuple, bpe.State] = {}
        for k, x in enumerate(own[:-1], 1):
            after = {}
            for state in live.values():
                try:
                    found = (state.next.get(x) or self.machine.step(state, x))[0]
                except ValueError:  # nothing that the vocabulary has goes on like this
                    continue
                after[found.last, found.waiting] = found
            live = after
            if self.longest <= k <= 2 * self.longest:
                for n in range(1, self.longest + 1):
                    piece = self.machine.pieces.get(own[k - n : k])
                    if piece is not None and self.machine.alone[piece]:
                        live.setdefault((piece, self.machine.start.waiting), bpe.State(piece, self.machine.start.waiting))
        mode = LETTERS if self.kind(text[at - 1]) == 2 else OTHERS
        return [(mode, state, own[-1]) for state in live.values()]

    def state_map(self, text: str, lo: int, hi: int) -> Map:
        """From each state that can occur at lo to the state at hi, and the tokens between."""
        first = self.white.search(text, lo, hi)
        if first is None:
            ends, rest = {key(s): (s, 0) for s in self.entries(text, lo)}, lo
            names = {k: (k, 0) for k in ends}
            while rest < hi:
                step = hi if len(ends) == 1 else min(hi, rest + 64)  # they soon agree
                after, to = {}, {}
                for k, (state, _) in ends.items():
                    state, n = self.run(state, text, rest, step)
                    to[k] = key(state), n
                    after[to[k][0]] = state, 0
                names = {k: (to[k2][0], n + to[k2][1]) for k, (k2, n) in names.items()}
                ends, rest = after, step
            return Map({k: (ends[k2][0], n) for k, (k2, n) in names.items()}, lo, hi)
        last = hi
        while not self.white.match(text, last - 1, hi):
            last -= 1
        leaves, n = self.run(self.outside, text, last, hi)
        n += self.read(text[first.end() : last])
        heads = ((key(s), self.run(s, text, lo, first.start())) for s in self.entries(text, lo))
        return Map({k: (leaves, m + self.closed(state) + n) for k, (state, m) in heads}, lo, hi)

    def passed(self, one: Map, state: tuple, text: str) -> tuple[tuple, int]:
        """Where a map leads a state."""
        return one.ways.get(key(state)) or self.run(state, text, one.lo, one.hi)

    def compose(self, a: Map, b: Map, text: str) -> Map:
        ways = {}
        for k, (state, n) in a.ways.items():
            leaves, m = self.passed(b, state, text)
            ways[k] = leaves, n + m
        return Map(ways, a.lo, b.hi)

    def scan(self, maps: list[Map], text: str) -> Map:
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2], text) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def applied(self, whole: Map, text: str) -> int:
        """The tokens of a text of which that is the map."""
        state, n = self.passed(whole, self.outside, text)
        return n + self.closed(state)

    def normalized(self, text: str) -> str:
        return text.lower() if PLAIN.fullmatch(text) else self.normal(text)

    def count(self, text: str) -> int:
        parts = self.special.split(text)
        total = len(parts) - 1
        for part in map(self.normalized, parts):
            if len(part) <= CHUNK:
                total += self.read(part)
            else:
                total += self.applied(self.scan([self.state_map(part, k, min(k + CHUNK, len(part))) for k in range(0, len(part), CHUNK)], part), part)
        return total


def _normalizer(path: str):
    """The library's own normalizer, for text outside ``PLAIN``."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).normalizer.normalize_str


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row. vocabulary: path of a tokenizers file, as workers see it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            sizes, counts = [], []
            with uncollected():
                for text in batch.column(1):
                    text = text.as_py() or ""
                    sizes.append(len(text.encode()))
                    counts.append(own.count(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(documents(docs), run, SCHEMA)
