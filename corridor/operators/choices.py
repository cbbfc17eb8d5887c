"""Multiple choice: options read out of free answers, accuracy, prompts. Options are a map of letter to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.functions import formats

#: Answers that decline, and the marks that part words.
REJECTIONS = ("Sorry, I can't help with images of people yet.", "I can't process this file.", "I'm sorry, but without the image provided", "Cannot determine the answer")
FAILED = "Failed to obtain answer via API"
MARKS = ".()[],:;!*#{}"


def infer_option(answer: Column, options: Column) -> Column:
    """The one option letter that stands as a word of its own; Z for a refusal; null if unclear or if an A may be an article."""
    words = F.filter(F.split(F.translate(answer, MARKS, " " * len(MARKS)), r"\s+"), lambda w: w != "")
    letters = F.array_intersect(F.map_keys(options), words)
    refused = F.lit(False)
    for r in REJECTIONS:
        refused = refused | F.contains(answer, F.lit(r))
    article = F.array_contains(words, "A") & (F.size(words) > 3)
    return (
        F.when(F.contains(answer, F.lit(FAILED)), F.lit(None).cast("string")).when(refused, "Z").when((F.size(letters) == 1) & ~article, F.get(letters, 0))
        .when((F.size(letters) == 0) & F.array_contains(words, "Z"), "Z")
    )


def infer_text(answer: Column, options: Column) -> Column:
    """The one option whose text the answer holds, case aside."""
    found = F.filter(F.map_entries(options), lambda e: F.contains(F.lower(answer), F.lower(e["value"])))
    return F.when(F.size(found) == 1, F.get(found, 0)["key"])


def infer(answer: Column, options: Column) -> Column:
    answer = F.coalesce(answer, F.lit(""))
    return F.coalesce(infer_option(answer, options), infer_text(answer, options))


def options(*letters: str) -> Column:
    """The map of those option columns that are not null."""
    return F.map_filter(F.create_map(*[x for c in letters for x in (F.lit(c.upper()), F.col(c))]), lambda _, v: v.isNotNull())


def complete(rows: DataFrame) -> DataFrame:
    """Open questions become choices: without option a, it is the answer, and b stands for all others; an answer that is no letter is then A."""
    opened = F.col("a").isNull()
    return rows.withColumns({"a": F.coalesce("a", "answer"), "b": F.when(opened, "Other Answers").otherwise(F.col("b")), "answer": F.when(F.col("answer").rlike("^[A-Z]$"), F.col("answer")).otherwise("A")})


def accuracy(rows: DataFrame) -> DataFrame:
    """split (null: all), n, accuracy, in one pass."""
    return rows.rollup("split").agg(F.count("*").alias("n"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy"))


def option_lines(opts: Column, between: str = "\n") -> Column:
    return F.array_join(F.transform(F.map_entries(opts), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), between)


def mcq_prompt(question: Column, opts: Column, hint: Column | None = None) -> Column:
    """Hint, question, options and what is asked for; that in Chinese if the text has Chinese characters. Without options the question alone."""
    lead = F.lit("") if hint is None else F.coalesce(F.concat(F.lit("Hint: "), hint, F.lit("\n")), F.lit(""))
    head = F.concat(lead, F.lit("Question: "), question)
    full = F.concat(head, F.lit("\nOptions:\n"), option_lines(opts), F.lit("\n"))
    return F.when(F.size(opts) > 0, F.concat(full, F.when(full.rlike("[一-鿿]"), formats.SELECT_CHINESE).otherwise(formats.SELECT))).otherwise(head)


def judge_prompt(question: Column, opts: Column, prediction: Column) -> Column:
    options = F.concat(F.lit("There are several options: \n"), option_lines(opts), F.lit("\n"))
    return F.concat(F.lit(formats.JUDGE), question, F.lit("?\nOptions: "), options, F.lit("\nAnswer: "), prediction, F.lit("\nYour output: "))


def yes_no_prompt(question: Column) -> Column:
    return F.concat(question, F.lit(formats.YES_NO))


def short_prompt(question: Column) -> Column:
    return F.concat(question, F.lit(formats.SHORT))


def interleaved(text: Column) -> Column:
    """kind and value of the pieces of a text with ``<image N>`` references."""
    cut = F.filter(F.split(F.regexp_replace(text, r"<image (\d+)>", "\x01@$1\x01"), "\x01"), lambda p: F.trim(p) != "")
    return F.transform(cut, lambda p: F.when(p.rlike(r"^@\d+$"), F.struct(F.lit("image").alias("kind"), F.substring(p, 2, 20).alias("value"))).otherwise(F.struct(F.lit("text").alias("kind"), p.alias("value"))))


def as_list(text: Column) -> Column:
    """A JSON list of strings as it is, any other text as a list of itself."""
    return F.coalesce(F.when(F.startswith(F.trim(text), F.lit("[")), F.from_json(text, "array<string>")), F.array(text))


def code_prompt(question: Column, starter: Column, has_function: Column) -> Column:
    """Standard input and output, or a function to call if one is named or begun."""
    starter = F.nullif(starter, F.lit(""))
    call = has_function | starter.isNotNull()
    begun = F.coalesce(F.concat(F.lit(formats.STARTER), starter, F.lit("\n")), F.lit(""))
    return F.concat(F.lit("\nQUESTION:\n"), question, F.when(call, formats.CALL_BASED).otherwise(formats.STANDARD_IO), begun, F.lit("\nANSWER:\n"))


def output_rung(got: Column, want: Column) -> Column:
    """The first rung of the comparison ladder that holds: trimmed, lines, numbers (nearly, in order), words (as sets), rounded (sets of numbers to three places); null if none."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    numbers = lambda c: F.transform(words(c), lambda x: x.try_cast("double"))
    a, b = numbers(got), numbers(want)
    numeric = (F.size(a) == F.size(b)) & (F.size(a) > 0) & F.forall(F.zip_with(a, b, lambda x, y: F.coalesce(F.abs(x - y) <= 1e-8 + 1e-5 * F.abs(y), F.lit(False))), lambda x: x)
    sets = F.array_sort(F.array_distinct(words(got))) == F.array_sort(F.array_distinct(words(want)))
    rounded = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.round(x, 3))))
    near = ~F.exists(a, lambda x: x.isNull()) & ~F.exists(b, lambda x: x.isNull()) & (F.size(a) > 0) & (rounded(a) == rounded(b))
    return F.when(trim(got) == trim(want), "trimmed").when(lines(got) == lines(want), "lines").when(numeric, "numbers").when(sets, "words").when(near, "rounded")


def same_output(got: Column, want: Column) -> Column:
    return output_rung(got, want).isNotNull()


def test_summary(rows: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Counts of passed (1), failed (0), timed out (-1) and broken (-2) tests, and the share that passed."""
    n = lambda v: F.sum((F.col(outcome) == v).cast("int"))
    return rows.agg(F.count("*").alias("total"), n(1).alias("passed"), n(0).alias("failed"), n(-1).alias("timed_out"), n(-2).alias("broken"), F.round(F.avg((F.col(outcome) == 1).cast("double")), 6).alias("accuracy"), F.bool_and(F.col(outcome) == 1).alias("all_passed"))
