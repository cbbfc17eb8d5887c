"""Trajectories in generated text: parsing by pattern ladders, formatting, sections. All are column expressions; what can't be parsed is null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corridor.functions.formats import MARKER

#: The number and pair formats that texts use, in order of preference.
NUMBER = r"-?\d+\.?\d*"
PAIRS = (
    rf"\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)",
    rf"\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]",
    rf"""\[\s*['"]({NUMBER})['"]\s+['"]({NUMBER})['"]\s*\]""",
    rf"\[\s*({NUMBER})\s+({NUMBER})\s*\]",
)
#: A list of pairs of numbers as a literal: what evaluates to an n x 2 array.
LITERAL = rf"^\[\s*(?:\(\s*{NUMBER}\s*,\s*{NUMBER}\s*\)|\[\s*{NUMBER}\s*,\s*{NUMBER}\s*\])(?:\s*,\s*(?:\(\s*{NUMBER}\s*,\s*{NUMBER}\s*\)|\[\s*{NUMBER}\s*,\s*{NUMBER}\s*\]))*\s*,?\s*\]$"


def let(value: Column, expression) -> Column:
    """An expression of a value that is computed once, however often the expression uses it."""
    return F.get(F.transform(F.array(value), expression), F.lit(0))


def after_marker(text: Column, marker: str = MARKER) -> Column:
    """The text between the first and the second marker, trimmed; null without one."""
    return F.when(F.contains(text, F.lit(marker)), F.regexp_replace(F.split_part(text, F.lit(marker), F.lit(2)), r"^\s+|\s+$", ""))


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda s: s.cast("double"))


def paired(values: Column, drop_odd: bool = False) -> Column:
    """Neighbours in pairs; null for fewer than two, or for an odd number unless its last is dropped."""

    def read(v: Column) -> Column:
        n = F.size(v)
        pairs = F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), lambda k: F.struct(F.get(v, 2 * k).alias("x"), F.get(v, 2 * k + 1).alias("y")))
        return F.when((n >= 2) & (F.lit(drop_odd) | (n % 2 == 0)), pairs)

    return let(values, read)


def bracketed(text: Column) -> tuple[Column, Column]:
    """The first shortest [...] and the first shortest (...), null where there is none."""
    first = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return first(r"(\[[\s\S]*?\])"), first(r"(\([\s\S]*?\))")


def parse_trajectory(text: Column) -> Column:
    """The plain parser: the first bracket after the marker, read as numbers in pairs. Of nested brackets it sees the first pair only."""
    return let(after_marker(text), lambda t: F.coalesce(*[paired(numbers(part)) for part in bracketed(t)]))


def repaired(text: Column) -> Column:
    """Numbers torn apart at their point (``11.  .6``) joined again."""
    return F.regexp_replace(text, r"(\d+)\.\s+\.(\d+)", "$1.$2")


def pairs_of(text: Column, pattern: str) -> Column:
    """All matches of a pattern with two groups; null without any."""
    xs, ys = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return let(F.zip_with(xs, ys, lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))), lambda z: F.when(F.size(z) > 0, z))


def parse_robust(text: Column) -> Column:
    """The tolerant parser: torn numbers are joined, then the pair formats in order of preference, then bare pairs within bounds, if at least two."""
    def read(fixed: Column) -> Column:
        bare = pairs_of(F.regexp_replace(fixed, r"""['"]""", ""), rf"({NUMBER})\s+({NUMBER})")
        bare = let(bare, lambda p: F.when(F.contains(fixed, F.lit("[")) & (F.size(p) >= 2) & F.forall(p, lambda q: (F.abs(q["x"]) < 1000) & (F.abs(q["y"]) < 1000)), p))
        return F.coalesce(F.when(fixed.rlike(LITERAL), paired(numbers(fixed))), *[pairs_of(fixed, p) for p in PAIRS], bare)

    return let(after_marker(text), lambda t: F.coalesce(*[let(repaired(part), read) for part in bracketed(t)]))


def parse_strict(text: Column, steps: int = 6) -> Column:
    """The first [...] of a line, which must hold exactly ``steps`` pairs."""
    found = pairs_of(F.regexp_extract(text, r"\[(.*?)\]", 1), rf"\(\s*({NUMBER})\s*,\s*({NUMBER})\s*\)")
    return F.when(F.size(found) == steps, found)


def parse_trace(text: Column) -> Column:
    """A trace of nested lists or tuples; else all numbers in pairs, an odd last one dropped; null for fewer than two numbers, empty if it decodes to no pairs."""
    deep = lambda a, b: rf"({a}\s*{a}[\d\s,.-]+{b}\s*(?:,\s*{a}[\d\s,.-]+{b}\s*)*{b})"
    square = F.nullif(F.regexp_extract(text, deep(r"\[", r"\]"), 1), F.lit(""))
    rounds = F.nullif(F.regexp_extract(text, deep(r"\(", r"\)"), 1), F.lit(""))
    json = F.coalesce(square, F.translate(rounds, "()", "[]"))
    points = F.from_json(json, "array<array<double>>")
    good = F.forall(points, lambda p: F.size(p) == 2)
    return F.when(json.isNull() | (points.isNotNull() & ~good), paired(numbers(text), drop_odd=True)).when(points.isNull(), F.array().cast("array<struct<x:double,y:double>>")).otherwise(F.transform(points, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))


def first_list(text: Column) -> Column:
    """From the first [ to the first ], both included; null without either in that order."""
    a, b = F.instr(text, "["), F.instr(text, "]")
    return F.when((a > 0) & (b > a), F.substring(text, a, b - a + 1))


def action_suffix(text: Column, marker: str = MARKER, compat: bool = False) -> Column:
    """From the marker to the end; null without it, or, with compat, the last character."""
    at = F.instr(text, marker)
    found = F.when(at > 0, F.substring(text, at, F.length(text)))
    return F.coalesce(found, F.substring(text, -1, 1)) if compat else found


def section(text: Column, start: str, end: str) -> Column:
    """What stands between two marks, or ``\\nNone.`` if that is blank; null without the first."""
    part = F.split_part(F.split_part(text, F.lit(start), F.lit(2)), F.lit(end), F.lit(1))
    return F.when(F.contains(text, F.lit(start)), F.when(F.trim(F.regexp_replace(part, r"\s+", " ")) == "", F.lit("\nNone.")).otherwise(part))


def two_decimals(value: Column) -> Column:
    """As ``%.2f`` prints it: the hundredth nearest to the exact binary value, ties to even, small negatives with their sign; null for null.

    The product with 100 and what rounding it lost are held apart (Dekker's splitting), so a product that only looks like a tie is told from a real one.
    """
    v = value.cast("double")
    high = v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)
    product = v * F.lit(100.0)
    lost = (high * F.lit(100.0) - product) + (v - high) * F.lit(100.0)
    below = F.floor(product).cast("double")
    nearest = F.when((product - below == 0.5) & (lost != 0), below + F.when(lost > 0, 1.0).otherwise(0.0)).otherwise(F.rint(product))
    cents = F.abs(nearest.try_cast("long"))
    sign = F.when((v < 0) | ((v == 0) & (v.cast("string") == "-0.0")), "-").otherwise("")  # only zeros are written out to tell
    plain = F.concat(sign, (cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return F.when(F.isnan(v), "nan").when(F.abs(v) < 1e13, plain).when(v.isNotNull(), F.format_string("%.2f", v))


def hundredths(*columns: pa.Array) -> list[pa.Array]:
    """``two_decimals`` of columns of a batch: each different number is printed once."""
    n = [len(c) for c in columns]
    every = pa.concat_arrays([c.cast("double") for c in columns])
    bits = pa.array(every.to_numpy(zero_copy_only=False).view(np.int64), mask=every.is_null().to_numpy(zero_copy_only=False)).dictionary_encode()
    texts = pa.array(["%.2f" % v for v in bits.dictionary.to_numpy().view(np.float64).tolist()], pa.string()).take(bits.indices)
    return [texts.slice(at - k, k) for at, k in zip(np.cumsum(n).tolist(), n, strict=True)]


def points_text(points: Column) -> Column:
    """[(x,y), ...] of an array of x, y structs."""
    return F.concat(F.lit("["), F.array_join(F.transform(points, lambda p: F.concat(F.lit("("), two_decimals(p["x"]), F.lit(","), two_decimals(p["y"]), F.lit(")"))), ", "), F.lit("]"))


def planning_target(points: Column) -> Column:
    return F.concat(F.lit(f"{MARKER}\n"), points_text(points))


def last_code_block(text: Column, languages: str = "python|html") -> Column:
    """The last fenced block, trimmed; null without one."""
    blocks = F.regexp_extract_all(text, F.lit(rf"```(?:{languages})\s*\n([\s\S]*?)```"), F.lit(1))
    return F.when(F.size(blocks) > 0, F.trim(F.regexp_replace(F.element_at(blocks, -1), r"^\s+|\s+$", "")))


def first_code(text: Column) -> Column:
    """The text of the first code element of Markdown, a fenced block or a span between single marks, whichever comes first; null without one."""
    mark = r"(?:```[^\n`]*\n([\s\S]*?)```|`([^`\n]+)`)"
    block, span = F.regexp_extract(text, mark, 1), F.regexp_extract(text, mark, 2)
    return F.when(text.rlike(mark), F.when(span != "", span).otherwise(block))


def fenced_json(text: Column) -> Column:
    """The body of a fenced json block, else from the first [ to the last ]."""
    fenced = F.nullif(F.regexp_extract(text, r"```json\s*([\s\S]*?)\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(\[[\s\S]*\])", 1), F.lit("")))


def labelled_points(text: Column) -> Column:
    """point_2d entries of fenced JSON with their labels, ``point_{n}`` (from 1) where there is none."""
    found = F.from_json(fenced_json(text), "array<struct<point_2d:array<double>,label:string>>")
    return F.transform(found, lambda p, k: F.struct(p["point_2d"].alias("point"), F.coalesce(p["label"], F.concat(F.lit("point_"), (k + 1).cast("string"))).alias("label")))


def boxed_answer(text: Column) -> Column:
    """What the last ``\\boxed{`` holds up to its closing brace; null without one or if it never closes."""
    tail = F.when(F.contains(text, F.lit("\\boxed{")), F.element_at(F.split(text, r"\\boxed\{"), -1))
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))
    walked = F.aggregate(F.split(tail, ""), start, lambda s, c: F.when(s["depth"] == 0, s).otherwise(F.struct(
        (s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"),
        F.concat(s["out"], F.when((s["depth"] == 1) & (c == "}"), F.lit("")).otherwise(c)).alias("out"))))
    return F.when(walked["depth"] == 0, walked["out"])
