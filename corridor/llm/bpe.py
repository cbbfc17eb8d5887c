"""Byte-pair merges compiled into a lazily determinised finite-state transducer.

Two neighbouring pieces are compatible if merging their union by itself gives them again. A word's pieces are the one way to cut it into compatible pieces, and so
are those of each of its beginnings. After some symbols, a configuration is a beginning that ends in a whole piece, and the part of a next piece that has been
read since; a state holds all configurations that may still go on, with the pieces on which they differ. A transition reads a symbol: it drops the configurations
that no piece continues, adds the one that ends here, and emits the pieces on which all that are left agree. A part is never longer than the longest piece, so a
piece is emitted after a bounded lookahead; nothing is ever taken back. States and transitions are made when first met, and those that are met again are kept;
a transition carries what it emits and how many pieces that is.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import regex

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Transitions and pairs of pieces that a worker keeps, at most, those met first, and words in each of two generations. What isn't kept is made again: that changes speed alone.
TRANSITIONS, WORDS = 200_000, 100_000
#: A state keeps transitions from the visit of this number on that leads to a new one.
RARE = 3


def byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, and the byte it stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Node:
    """A start of pieces: what may follow, and the piece that it is itself."""

    __slots__ = ("next", "piece")

    def __init__(self) -> None:
        self.next: dict[str, Node] = {}
        self.piece: int | None = None


class State:
    """last: the piece emitted last (-1: none). waiting: configurations, each the pieces not emitted yet and the start of a piece that has been read since; the last has read nothing. final: what is emitted if the word ends here."""

    __slots__ = ("final", "last", "left", "next", "waiting")

    def __init__(self, last: int, waiting: tuple[tuple[tuple[int, ...], Node], ...]) -> None:
        self.last, self.waiting = last, waiting
        self.next: dict[str, tuple[State, tuple[int, ...], int]] = {}
        self.final = waiting[-1][0]
        self.left = RARE


class Transducer:
    """pieces: a piece's symbols, as a string, to its id. formed: a pair of ids that merge to (rank, id of the union)."""

    def __init__(self, pieces: dict[str, int], formed: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.pieces, self.formed = pieces, formed
        self.root = Node()
        for symbols, v in pieces.items():
            at = self.root
            for x in symbols:
                if x not in at.next:
                    at.next[x] = Node()
                at = at.next[x]
            at.piece = v
        self.born, self.alone = {}, {}
        for symbols, v in pieces.items():
            steps = self.merging([pieces[s] for s in symbols])
            whole = [x for x in steps if len(x) == 1]
            self.alone[v] = whole == [[v]]
            self.born[v] = (formed[tuple(steps[-2])][0], *steps[-2]) if self.alone[v] and len(symbols) > 1 else (-1, v, v)
        self.states: dict[tuple, State] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.start = self.state(-1, (((), self.root),))
        self.made = 0

    def state(self, last: int, waiting: tuple) -> State:
        if (found := self.states.get((last, waiting))) is None:
            found = self.states[last, waiting] = State(last, waiting)
        return found

    def merging(self, ids: list[int]) -> list[list[int]]:
        """Merging by the definition, step by step: the pair of lowest rank first, the leftmost of equals. For compiling only."""
        steps = [ids]
        while len(ids) > 1:
            best = min(((r[0], k, r[1]) for k in range(len(ids) - 1) if (r := self.formed.get((ids[k], ids[k + 1])))), default=None)
            if best is None:
                break
            ids = [*ids[: best[1]], best[2], *ids[best[1] + 2 :]]
            steps.append(ids)
        return steps

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a (-1: the start)."""
        if (found := self.pairs.get((a, b))) is None:
            found = self.alone[b] and (a < 0 or self.border(a, b))
            if len(self.pairs) < TRANSITIONS:
                self.pairs[a, b] = found
        return found

    def step(self, state: State, symbol: str) -> tuple[State, tuple[int, ...], int]:
        """The transition of a symbol: the next state, the pieces emitted, and their number."""
        going, ended, last = [], None, state.last
        pairs = self.pairs
        for own, node in state.waiting:
            node = node.next.get(symbol)
            if node is None:
                continue
            if ended is None and (piece := node.piece) is not None:
                before = own[-1] if own else last
                fits = pairs.get((before, piece))
                if fits or (fits is None and self.follows(before, piece)):
                    ended = (*own, piece)
            if node.next:
                going.append((own, node))
        if ended is None:
            raise ValueError("symbols outside the vocabulary")
        if not going:
            agreed = len(ended)
        elif len(going) == 1:
            first, agreed = going[0][0], 0
            for x, y in zip(first, ended, strict=False):
                if x != y:
                    break
                agreed += 1
        else:
            agreed = 0
            for column in zip(ended, *[own for own, _ in going], strict=False):
                if column.count(column[0]) != len(column):
                    break
                agreed += 1
        emitted = ended[:agreed]
        if agreed:
            last = emitted[-1]
            waiting = (*[(own[agreed:], node) for own, node in going], (ended[agreed:], self.root))
        else:
            waiting = (*going, (ended, self.root))
        if state.left > 1 or self.made >= TRANSITIONS:  # what is met once may never be met again
            state.left -= 1
            return State(last, waiting), emitted, agreed
        key = (last, waiting)
        if (after := self.states.get(key)) is None:
            after = self.states[key] = State(last, waiting)
        found = state.next[symbol] = (after, emitted, agreed)
        self.made += 1
        return found

    def border(self, a: int, b: int) -> bool:
        """Takes the later of the two apart, again and again: no pair that meets at the border may merge before the piece that was taken apart last was whole."""
        left_until = right_until = float("inf")  # when the neighbours in hand become part of something larger
        while True:
            meets = self.formed.get((a, b))
            if meets and meets[0] < left_until and meets[0] <= right_until:
                return False
            (ra, _, a_end), (rb, b_start, _) = self.born[a], self.born[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, left_until = a_end, ra
            else:
                b, right_until = b_start, rb

    def ids(self, symbols: str) -> list[int]:
        """The pieces of a word, as they are emitted."""
        state, out = self.start, []
        for x in symbols:
            state, emitted, n = state.next.get(x) or self.step(state, x)
            if n:
                out += emitted
        out += state.final
        return out

    def count(self, symbols: str) -> int:
        """How many those are: the sum of what the transitions carry."""
        state, total = self.start, 0
        for x in symbols:
            state, _, n = state.next.get(x) or self.step(state, x)
            total += n
        return total + len(state.final)


@lru_cache(maxsize=4)
def from_ranks(path: str) -> tuple[Transducer, list[bytes]]:
    """Of a rank file: any two neighbours merge whose union has a rank. The symbols are bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f)}
    formed = {}
    for p, r in ranks.items():
        for k in range(1, len(p)):
            if (a := ranks.get(p[:k])) is not None and (b := ranks.get(p[k:])) is not None:
                formed[a, b] = (r, r)
    words: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for p, r in ranks.items():
        words[r] = p.encode("latin-1")
    return Transducer(ranks, formed), words


@lru_cache(maxsize=4)
def from_json(path: str) -> tuple[Transducer, dict]:
    """Of a tokenizers file with byte-level pieces. The last byte of a word that ends in the suffix is a symbol of its own: byte + 256."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, byte = spec["model"], byte_characters()
    suffix = model.get("end_of_word_suffix") or ""

    def symbols(piece: str) -> str:
        ends = bool(suffix) and piece.endswith(suffix)
        own = "".join(chr(byte[c]) for c in (piece[: -len(suffix)] if ends else piece))
        return own[:-1] + chr(ord(own[-1]) + 256) if ends else own

    pieces = {symbols(p): k for p, k in model["vocab"].items()}
    formed = {}
    for r, (a, b) in enumerate((m.split(" ") if isinstance(m, str) else m) for m in model["merges"]):
        formed[model["vocab"][a], model["vocab"][b]] = (r, model["vocab"][a + b])
    return Transducer(pieces, formed), spec


def white(pattern: str) -> str:
    r"""The pattern with \s and \S as the Unicode property White_Space, which Python's own classes exceed by four control characters."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def narrow(pattern: str) -> str:
    r"""The pattern for texts of the first 256 characters alone: \p{L}, \p{N} and \s are listed as what they hold of those."""
    first = [chr(c) for c in range(256)]
    listed = {k: "".join(f"\\x{ord(c):02x}" for c in first if regex.match(white(k), c)) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out = []
    for part in re.split(r"(\[[^\]]*\])", pattern):
        inside = part.startswith("[")
        part = part.replace(r"\S", f"[^{listed[chr(92) + 's']}]")
        for k, own in listed.items():
            part = part.replace(k, own if inside else f"[{own}]")
        out.append(part)
    return "".join(out)


def splitter(pattern: str):
    """Text to its words by the pattern; the narrow form of it, which costs half, wherever it says the same."""
    wide, quick = regex.compile(white(pattern)).findall, re.compile(narrow(pattern)).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return wide(text)
        return quick(text)

    return split
