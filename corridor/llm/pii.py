"""Personal data: exact base spans, and further spans that generators propose and boosted trees judge.

Base spans are those of four fixed patterns with their checks. Generators of high recall then propose spans of other kinds: ``secret`` (long tokens),
``account`` (digit groups), ``phone_local`` (digits in a national form), ``email_written`` (addresses spelled out), ``iban`` and ``identity`` (3-2-4 digits).
Their spans may overlap. Gradient-boosted trees score each by its format and its context. A kind's threshold is the least score from which on its precision
reaches ``PRECISION`` on snippets of a second writer, whose phrases, prose and share of formats the trees have not seen, weighed as if ``PRIOR`` of proposals were personal. Of accepted spans that overlap each
other or a base span, base spans stay, then the higher score, then the earlier.

Both writers are here (``TRAINING``, ``CALIBRATION``): templates with a fixed seed, no corpus text, no outside model. Both write hard negatives: lookalikes in plain
prose, lookalikes behind other cues, and harmless strings behind the cues of personal data.

Null and empty texts have no spans, an empty table gives none. Rows are independent; repeated and null ids keep a row each. Whole texts of any length are read;
every scan is linear in the text. Columns beyond those named are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corridor.llm.common import documents, map_arrow

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "account", "phone_local", "email_written", "iban", "identity")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
PRECISION, ROUNDS, DEPTH, RATE, BINS = 0.95, 60, 3, 0.3, 32
#: The share of proposals that are taken to be personal when thresholds are set.
PRIOR = 0.1

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a text must hold for anything to be found in it: a digit (of all kinds but three), an at sign, a long run, or "at" and "dot" spelled out.
_ANY = r"[0-9]|@|[A-Za-z0-9+/_-]{20}|(?is:\bat\b.*\bdot\b)|[\[({](?i:at)[\])}]"
_GENERATORS = {
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"),
    "account": re.compile(r"(?<![0-9A-Za-z.,-])[0-9]{8,19}(?![0-9A-Za-z])|(?<![0-9A-Za-z.,-])[0-9]{4}(?:[ -][0-9]{4}){2,3}(?![0-9A-Za-z])"),
    "phone_local": re.compile(r"(?<![0-9A-Za-z+)])(?:\([0-9]{2,5}\)[ ]?|0[0-9]{1,4}[ /-])[0-9]{3,4}[ -]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])"),
    "email_written": re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\s?+(?:[\[({]at[\])}]|\bat\b)\s?+[A-Za-z0-9-]++(?:\s?(?:[\[({]dot[\])}]|\bdot\b)\s?[A-Za-z]{2,}+)++(?![A-Za-z])", re.I),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "identity": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
}
_CUES = {
    "secret": ("token", "secret", "key", "password", "passwd", "pwd", "credential", "bearer", "auth"),
    "account": ("account", "card", "customer", "konto", "cuenta", "compte", "passport", "insurance", "acct"),
    "phone_local": ("phone", "tel", "call", "mobile", "fax", "cell", "contact"),
    "email_written": ("mail", "contact", "write", "reach"),
    "iban": ("iban", "bank", "account", "transfer"),
    "identity": ("ssn", "social", "security", "tax", "identity"),
}


_LETTERS, _DIGITS, _PARTS, _HEX = (re.compile(x) for x in (r"[A-Za-z]+", r"[0-9]+", r"[A-Za-z]+|[0-9]+", r"[0-9a-fA-F]+"))
#: A short name before a mark, as keys of services begin with.
_PREFIX = re.compile(r"[A-Za-z]{2,5}[_-](?:[a-z]{4}_)?|[A-Z]{4}(?=[A-Z0-9]{16})")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's leftmost matches by way of their at signs: everything before one belongs to a single run of allowed characters."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor, at = m.end(), text.find("@", m.end())
        else:
            floor, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *x) for x in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format and context of a proposed span."""
    s, before, after = text[start:end], text[max(0, start - 32) : start].lower(), text[end : end + 16].lower()
    n, counts = len(s), Counter(s)
    digits = sum(counts[d] for d in "0123456789")
    cues = [any(c in before for c in own) for own in _CUES.values()]
    own = _CUES[kind]
    alpha = "".join(_DIGITS.findall(s))
    near = max((len(before) - (before.rfind(c) + len(c)) < 8 for c in own if c in before), default=False)
    words, parts = _LETTERS.findall(s), _PARTS.findall(s)
    entropy = math.log2(n) - sum(c * math.log2(c) for c in counts.values()) / n
    switches = 2 * len(_DIGITS.findall(s)) - s[0].isdigit() - s[-1].isdigit()
    return [
        *(float(kind == k) for k in ADDED), n, digits / n, entropy, len(counts) / n, switches / n,
        sum(k for c, k in counts.items() if c.isupper()) / n, sum(k for c, k in counts.items() if not c.isalnum()), float(bool(_HEX.fullmatch(s))), float(bool(alpha) and luhn(alpha)),
        *map(float, cues), float(near), float(any(c in after for c in own)), float(before[-1:] in "\"'"), float(before.rstrip(" \"'")[-1:] in ":="), float(before[-1:] in "#$€£"),
        float(any(x in before for x in ("version", "order", "isbn", "page", "sha", "commit", "id ", "part", "total", "http", "doi"))), float(s.islower()), float("-" in s), float("_" in s or "/" in s),
        sum(counts[c] for c in "aeiouAEIOU") / max(1, sum(map(len, words))), max(map(len, words), default=0), len(parts) / n, float(bool(_PREFIX.match(s))), len(words[-1]) if words else 0,
    ]


#: What the writers put before spans: for personal ones of a kind, for harmless ones, and between a cue and its span.
TRAINING = {
    "secret": ('token = "', "api_key: ", "secret=", 'password: "', "Bearer ", "auth_token=", 'TOKEN = "', "access key "), "account": ("account number ", "account no. ", "Konto: ", "cuenta ", "card no ", "customer account #", "passport "),
    "phone_local": ("phone ", "call ", "tel. ", "Tel: ", "mobile: ", "fax ", "contact: ", ""), "email_written": ("mail ", "contact ", "write to ", "reach me: ", ""),
    "iban": ("IBAN ", "iban: ", "bank transfer to ", "account ", ""), "identity": ("SSN ", "ssn: ", "social security number ", "tax id ", ""),
    "harmless": ("", "see ", "the word ", "https://example.org/", "in ", "from ", "sha256 ", "commit ", "order ", "total ", "page ", "isbn ", "part ", "version "), "filler": ("", "", "", "is ", "for you: "),
}
CALIBRATION = {
    "secret": ("client_secret => ", "export API_TOKEN=", "pwd is ", "Authorization: Basic ", "key id ", "credentials: ", "jeton (token) "), "account": ("acct ", "compte ", "my insurance number: ", "Kontonummer ", "bank card "),
    "phone_local": ("ring my cell ", "Telefon ", "Mobiltelefon ", "for contact dial ", "phone/fax "), "email_written": ("e-mail: ", "please write ", "reach us under ", "Mail an ", ""),
    "iban": ("Bankverbindung ", "transfer it to ", "Konto (IBAN) ", ""), "identity": ("security no. ", "Social Security: ", "taxpayer ", ""),
    "harmless": ("", "and ", "revision ", "checksum: ", "digest ", "build ", "etag=", "ticket ", "item no. ", "edition ", "row ", "serial ", "about ", "model ", "nearly ", "release ", "$"), "filler": ("", "", "", "was ", "of mine, "),
}


def snippets(seed: int, each: int, style: dict[str, tuple[str, ...]]) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, start, end, label): spans in invented sentences, personal and not, with the phrases of a style."""
    rng = random.Random(seed)
    pick = lambda *xs: xs[int(rng.random() * len(xs))]
    some = lambda a, b: a + int(rng.random() * (b - a))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    letters = lambda n, of="abcdefghijklmnopqrstuvwxyz": "".join(rng.choices(of, k=n))
    hexa = lambda n: letters(n, "0123456789abcdef")
    mixed = lambda n: letters(n, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    syllable = lambda: pick(*"bcdfglmnprst") + pick("a", "e", "i", "o", "u", "ie", "ou") + pick("", "", "n", "r", "s", "tion")
    word = lambda: letters(some(2, 9)) if style is TRAINING else "".join(syllable() for _ in range(some(1, 4)))
    prose = lambda n: "".join(word() + pick(" ", " ", " ", ", ", ". ", "\n" if style is CALIBRATION else " ") for _ in range(n))
    longer = lambda: "".join(syllable() for _ in range(some(8, 12)))
    joined = lambda mark: mark.join(word() + word() + word() for _ in range(5))
    name = lambda: pick("com", "org", "net", "de", "fr", "es")
    yes = {
        "secret": lambda: pick(hexa(40), hexa(32), mixed(32), mixed(40), hexa(64), hexa(40).upper(), mixed(24) + digits(2), f"sk_live_{mixed(24)}", f"ghp_{mixed(36)}", f"AKIA{letters(16, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')}", mixed(some(20, 300))),
        "account": lambda: pick(digits(10), digits(12), digits(16), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", digits(9)),
        "phone_local": lambda: pick(f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(4)} {digits(3)}", f"{digits(3)}.{digits(3)}.{digits(4)}"),
        "email_written": lambda: pick(f"{letters(6)} at {letters(7)} dot {name()}", f"{letters(5)}.{letters(6)} [at] {letters(6)} [dot] {name()}", f"{letters(6)}(at){letters(6)}(dot){name()}", f"{word()} AT {word()} DOT {name()}"),
        "iban": lambda: pick("DE", "FR", "ES", "GB") + digits(2) + pick(f" {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", digits(16), digits(20)),
        "identity": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    no = {
        "secret": lambda: pick(letters(some(20, 40)), longer(), joined("-"), joined("_"), joined("/"), "-" * some(20, 80), "_" * 24, letters(1) * 25, digits(some(20, 30)), hexa(40), hexa(64), longer().capitalize() + longer().capitalize()),
        "account": lambda: pick(digits(8), digits(9), digits(10), digits(13), digits(16), digits(12), "1" + "0" * some(7, 12), f"{digits(4)}-{digits(4)}-{digits(4)}", f"20{digits(2)}0{some(1, 9)}1{some(0, 9)}"),
        "phone_local": lambda: pick(f"{digits(3)}-{digits(3)}-{digits(4)}", f"({digits(4)}) {digits(4)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"),
        "email_written": lambda: pick(f"{letters(5)} at {letters(6)} dot {letters(9)}", f"{word()} at the dot {word()}xx", f"{letters(4)} at {letters(3)} dot {letters(7)} dot {letters(8)}", f"look at the dot {longer()}"),
        "iban": lambda: pick("AB", "XZ", "QT", "NO") + digits(2) + pick(f" {digits(4)} {mixed(4).upper()}", mixed(8).upper(), mixed(12).upper()),
        "identity": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    #: Harmless even behind a cue of their kind: words, rules, dates.
    plain = {"secret": lambda: pick(longer(), joined("_"), joined("-"), "-" * 30, letters(1) * 25), "account": lambda: f"20{digits(2)}0{some(1, 9)}1{some(0, 9)}", "email_written": lambda: f"{word()} at the dot {longer()}"}
    out = []
    for kind in ADDED:
        for label in (1, 0):
            for k in range(each):
                behind = label or (kind in plain and k % 4 == 0)
                lead = pick(*style[kind]) + pick(*style["filler"]) if behind else pick(*[x for x in style["harmless"] if x or label == 0])
                if not label and kind in ("phone_local", "identity", "iban") and not lead.strip():
                    lead = pick("order ", "part ", "version ") if style is TRAINING else pick("ticket ", "serial ", "build ")
                span = yes[kind]() if label else plain[kind]() if behind else no[kind]()
                before = prose(4)
                out.append((kind, f"{before}{lead}{span}{pick('', '.', ',', chr(34))} {prose(3)}", len(before + lead), len(before + lead + span), label))
    return out


@dataclass
class Trees:
    """Boosted trees of fixed depth: for each round, DEPTH levels of (feature, cut) shared by a level's nodes, and the leaves."""

    rounds: list[tuple[list[tuple[int, float]], np.ndarray]]
    thresholds: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for levels, leaves in self.rounds:
            at = np.zeros(len(x), int)
            for f, c in levels:
                at = 2 * at + (x[:, f] > c)
            total += leaves[at]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray) -> list[tuple[list[tuple[int, float]], np.ndarray]]:
    """Newton boosting of the logistic loss with symmetric trees over quantile cuts: a level's cut is the one of greatest gain, by sums over histograms."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = [np.searchsorted(own, c, "left") for own, c in zip(cuts, x.T, strict=True)]  # above cut j are the bins beyond j
    total, rounds = np.zeros(len(x)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        at, levels = np.zeros(len(x), int), []
        for depth in range(DEPTH):
            best = (-1.0, 0, 0)
            for f, own in enumerate(bins):
                n = len(cuts[f]) + 1
                sg, sh = (np.bincount(at * n + own, w, n << depth).reshape(-1, n).cumsum(1) for w in (g, h))
                gain = (sg[:, :-1] ** 2 / (sh[:, :-1] + 1) + (sg[:, -1:] - sg[:, :-1]) ** 2 / (sh[:, -1:] - sh[:, :-1] + 1)).sum(0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), f, int(gain.argmax()))
            _, f, c = best
            levels.append((f, float(cuts[f][c])))
            at = 2 * at + (bins[f] > c)
        leaves = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + 1)
        total += leaves[at]
        rounds.append((levels, leaves))
    return rounds


def threshold(score: np.ndarray, good: np.ndarray) -> float:
    """The least score from which on a proposal is personal with PRECISION, if PRIOR of all proposals are; infinite if no score is. A harmless snippet and a half more are reckoned than were seen above a score."""
    order = np.argsort(-score, kind="stable")
    hit, miss = np.cumsum(good[order]) / max(1, good.sum()), (np.cumsum(1 - good[order]) + 0.5) / max(1, len(good) - good.sum())
    last = np.r_[np.diff(score[order]) != 0, True]  # equal scores are accepted together
    precise = np.flatnonzero(last & (PRIOR * hit >= PRECISION * (PRIOR * hit + (1 - PRIOR) * miss)))
    return float(score[order][precise[-1]]) if len(precise) else math.inf


@lru_cache(maxsize=1)
def trained() -> Trees:
    own, check = snippets(5, 600, TRAINING), snippets(6, 800, CALIBRATION)
    x, y = (np.array(v, float) for v in ([features(k, t, a, b) for k, t, a, b, _ in own], [label for *_, label in own]))
    trees = Trees(boost(x, y), {})
    score, good = trees.score(np.array([features(*r[:4]) for r in check])), np.array([r[4] for r in check], float)
    for kind in ADDED:
        rows = np.array([r[0] == kind for r in check])
        trees.thresholds[kind] = threshold(score[rows], good[rows])
    return trees


def proposals(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *m.span()) for kind, pattern in _GENERATORS.items() for m in pattern.finditer(text)]


def spans(texts: list[str], trees: Trees) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Base spans and added spans of each text, each by kind, then start. All proposals are scored at once."""
    place = {k: n for n, k in enumerate((*BASE, *ADDED))}
    by = lambda x: (place[x[0]], x[1])
    some = [proposals(t) for t in texts]
    rows = [features(k, t, a, b) for t, own in zip(texts, some, strict=True) for k, a, b in own]
    scores = iter(trees.score(np.array(rows)).tolist() if rows else [])
    for text, own in zip(texts, some, strict=True):
        base = base_spans(text)
        added: list[tuple[str, int, int]] = []
        accepted = sorted((-s, a, b, k) for (k, a, b), s in zip(own, [next(scores) for _ in own], strict=True) if s >= trees.thresholds[k])
        busy = bytearray(len(text)) if accepted else bytearray()
        for _, a, b in base if accepted else []:
            busy[a:b] = b"\1" * (b - a)
        for _, a, b, k in accepted:
            if not any(busy[a:b]):
                busy[a:b] = b"\1" * (b - a)
                added.append((k, a, b))
        yield sorted(base, key=by), sorted(added, key=by)


#: Texts whose proposals are scored together.
SCORED = 256


def _each(column: pa.Array, trees: Trees) -> Iterator[tuple[str, list, list]]:
    """Text and spans of every row; texts in which a linear scan of the whole batch sees nothing to find are not read again."""
    may = pc.fill_null(pc.match_substring_regex(column, _ANY), False).to_pylist()
    for lo in range(0, len(column), SCORED):
        texts, read = [t.as_py() or "" for t in column[lo : lo + SCORED]], may[lo : lo + SCORED]
        found = spans([t for t, some in zip(texts, read, strict=True) if some], trees)
        for text, some in zip(texts, read, strict=True):
            yield (text, *next(found)) if some else (text, [], [])


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans, the digest of the base spans, all spans and their number, of every row."""
    trees = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, texts, totals = [], [], [], []
            for _, base, added in _each(batch.column(1), trees):
                counts.append([sum(k == kind for k, *_ in base) for kind in BASE])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(base + added))
                totals.append(len(base) + len(added))
            numbers = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(totals, pa.int64())], [c.split()[0] for c in SCHEMA.split(", ")])

    return map_arrow(documents(docs), run, SCHEMA)


def redact(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every stretch of touching spans replaced by the kind of the first."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in found):
        if a >= end:
            out += [text[end:a], f"<{kind}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars of every row, with personal data replaced; null texts stay null."""
    trees = trained()
    rows = documents(docs, "lang", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redact(text, base + added) if base or added else text for text, base, added in _each(batch.column(1), trees)]
            texts = [t if ok else None for t, ok in zip(texts, batch.column(1).is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array([None if t is None else len(t) for t in texts], pa.int64())], ["doc_id", "text", "lang", "source", "n_chars"])

    return map_arrow(rows, run, "doc_id long, text string, lang string, source string, n_chars long")
