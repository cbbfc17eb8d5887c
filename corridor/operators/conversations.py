"""Training conversations: assembly from blocks, masks, media placeholders, validation, token statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corridor.functions import formats
from corridor.functions.formats import IMAGE, VIDEO
from corridor.functions.keyed import uniform
from corridor.functions.trajectory_text import section

#: What a conversation's answer may hold, in order; and what a question-and-answer conversation's may.
BLOCKS = ("goal", "perception", "commonsense", "experience", "cot", "reasoning")
VQA_BLOCKS = ("goal", "perception", "experience", "collidable", "plan", "objects")


def parted_ego(ego: Column) -> tuple[Column, Column]:
    """What stands before the mission goal, and the goal's text; null without one."""
    mark = F.lit(f"\n{formats.GOAL}")
    has = F.contains(ego, mark)
    return F.when(has, F.split_part(ego, mark, F.lit(1))), F.when(has, F.split_part(ego, mark, F.lit(2)))


def blocks() -> dict[str, Column]:
    """The texts of a planner sample's blocks: columns ego, perception, commonsense, experiences, chain_of_thoughts, reasoning."""
    return {
        "goal": F.concat(F.lit(formats.GOAL), parted_ego(F.col("ego"))[1]), "perception": F.col("perception"), "commonsense": F.col("commonsense"), "experience": F.coalesce("experiences", F.lit(formats.NO_EXPERIENCE)),
        "cot": F.coalesce("chain_of_thoughts", F.lit("")), "reasoning": F.col("reasoning"),
    }


def vqa_blocks() -> dict[str, Column]:
    """The same as answers to fixed questions; blank ones say None."""
    asked = dict(zip(VQA_BLOCKS, formats.QUESTIONS, strict=True))
    after = lambda c, mark: F.when(F.contains(F.col(c), F.lit(mark)), F.split_part(F.col(c), F.lit(mark), F.lit(2)))
    filled = lambda t: F.when(F.trim(F.regexp_replace(t, r"\s+", " ")) == "", F.lit(formats.NONE)).otherwise(t)
    texts = {
        "goal": parted_ego(F.col("ego"))[1], "perception": filled(after("perception", formats.PERCEPTION)), "experience": F.coalesce(filled(after("experiences", formats.EXPERIENCE)), F.lit(formats.NO_SIMILAR)),
        "collidable": section(F.col("chain_of_thoughts"), "\nThoughts:", "\nDriving Plan:"), "plan": filled(after("chain_of_thoughts", "\nDriving Plan:")), "objects": section(F.col("reasoning"), "\nThoughts:", "\nDriving Plan:"),
    }
    return {k: F.concat(F.lit(asked[k]), texts[k]) for k in VQA_BLOCKS}


def sft_rows(rows: DataFrame, system: str = "", with_goal: bool = True, with_perception: bool = True, with_experience: bool = True, own_reasoning: bool = False) -> DataFrame:
    """conversations: a human turn of image, system text and ego state, and an assistant turn of what is asked for, common sense, reasoning and the target. Rows without a goal are null."""
    own = blocks()
    parts = [own[k] for k, on in (("goal", with_goal), ("perception", with_perception)) if on] + [F.coalesce("experiences", F.lit(""))] * with_experience + [own["commonsense"], own["cot" if own_reasoning else "reasoning"], F.col("planning_target")]
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    human = F.concat(F.lit(f"{IMAGE}\n{system}"), parted_ego(F.col("ego"))[0])
    return rows.withColumn("conversations", F.array(turn("human", human), turn("assistant", F.concat(*parts))))


def expand_masks(rows: DataFrame, key: str, n: int, prior: float = 0.5, dropout: float = 0.2, seed: str = "42") -> DataFrame:
    """2n rows for each: prior ones take each block with probability ``prior``, posterior ones drop it with ``dropout``; keep_{block} says which are in."""
    kinds = F.array(F.struct(F.lit("prior").alias("kind"), F.lit(prior).alias("p")), F.struct(F.lit("posterior").alias("kind"), F.lit(1 - dropout).alias("p")))
    out = rows.withColumn("_k", F.explode(kinds)).withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("conversation_type", F.col("_k.kind"))
    return out.withColumns({f"keep_{b}": uniform(seed, F.col(key), F.col("conversation_type"), F.col("index"), b) < F.col("_k.p") for b in BLOCKS}).drop("_k")


def masked_conversation(rows: DataFrame, system: str = "", vqa: bool = False) -> DataFrame:
    """user and assistant of masked planner samples: blocks that are in go to the assistant; a posterior row is given the target, a prior row must produce it."""
    own = vqa_blocks() if vqa else blocks()
    gap = "\n\n" if vqa else ""
    kept = F.concat(*[F.when(F.col(f"keep_{b}"), text).otherwise("") for b, text in own.items()])
    posterior = F.col("conversation_type") == "posterior"
    target = F.concat(F.lit(gap), F.col("planning_target"))
    head = F.concat(F.lit(f"{IMAGE}\n{system}"), F.col("commonsense") if vqa else F.lit(""), parted_ego(F.col("ego"))[0])
    return rows.withColumns({"user": F.concat(head, F.when(posterior, target).otherwise("")), "assistant": F.concat(kept, F.when(posterior, "").otherwise(target))})


def one_kind(rows: DataFrame, key: str, n: int, dropout: float = 0.3, seed: str = "42") -> DataFrame:
    """n rows for each, all prior or all posterior by one coin a row; keep_{block} holds with probability 1 - dropout."""
    out = rows.withColumn("conversation_type", F.when(uniform(seed, F.col(key), "coin") < 0.5, "prior").otherwise("posterior")).withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns({f"keep_{b}": uniform(seed, F.col(key), F.col("index"), b) < 1 - dropout for b in VQA_BLOCKS})


def prior_and_posterior(rows: DataFrame) -> DataFrame:
    """The two ways to score a latent: posterior asks with the action given, prior answers with latent and action."""
    return rows.withColumns({"posterior_user": F.concat("user", F.lit("\n"), F.col("action")), "posterior_assistant": F.col("latent"), "prior_user": F.col("user"), "prior_assistant": F.concat("latent", F.lit("\n\n"), F.col("action"))})


def words(text: Column) -> Column:
    """The number of words between white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def length_estimate(text: Column, has_image: Column, per_image: int = 128) -> Column:
    """Words and ``per_image`` for an image; rows without one count negative, so that a sort keeps modalities apart."""
    n = words(text) + F.when(has_image, per_image).otherwise(0)
    return F.when(has_image, n).otherwise(-n)


def token_statistics(rows: DataFrame, user: str, answer: str) -> DataFrame:
    u, a = words(F.col(user)), words(F.col(answer))
    return rows.agg(F.count("*").alias("n"), F.sum(u).alias("user_tokens"), F.sum(a).alias("assistant_tokens"), F.max(u + a).alias("longest"), F.round(F.avg(u + a), 6).alias("average"))


def over_limit(rows: DataFrame, user: str, limit: int, reserve: int = 256) -> DataFrame:
    """Adds tokens and over: whether the user's words and the reserve exceed the limit. Rows stay."""
    n = words(F.col(user))
    return rows.withColumns({"tokens": n, "over": n + reserve > limit})


def parts(rows: DataFrame, text: str, *key: str) -> DataFrame:
    """key, place, kind, value, media: the text cut at its media placeholders, blank texts left out; media numbers each kind's placeholders from 0."""
    cut = F.split(F.replace(F.replace(F.col(text), F.lit(IMAGE), F.lit(f"\x01{IMAGE}\x01")), F.lit(VIDEO), F.lit(f"\x01{VIDEO}\x01")), "\x01")
    clean = F.filter(F.transform(cut, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    kinds = F.transform(clean, lambda p: F.struct(F.when(p == IMAGE, "image").when(p == VIDEO, "video").otherwise("text").alias("kind"), p.alias("value")))
    numbered = F.transform(kinds, lambda p, k: F.struct(k.alias("place"), p["kind"].alias("kind"), p["value"].alias("value"), F.when(p["kind"] != "text", F.size(F.filter(F.slice(kinds, 1, k), lambda q: q["kind"] == p["kind"]))).alias("media")))
    return rows.select(*key, F.explode(numbered).alias("p")).select(*key, "p.*")


def occurrences(text: Column, token: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int")


def media_check(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Adds images, videos (placeholders), and problem: missing media, or surplus media if strict; or placeholders in an assistant's turn; else null."""
    i, v = occurrences(F.col("text"), IMAGE), occurrences(F.col("text"), VIDEO)
    answer = F.col("role").isin("gpt", "assistant")
    problem = F.when(answer & ((i > 0) | (v > 0)), "placeholder in an answer").when((i > F.col("n_images")) | (v > F.col("n_videos")), "missing media")
    if strict:
        problem = problem.when((i < F.col("n_images")) | (v < F.col("n_videos")), "surplus media")
    return rows.withColumns({"images": i, "videos": v, "problem": problem})


def validation_statistics(checked: DataFrame) -> DataFrame:
    """One row: how many are valid, and how many have each problem or kind of media."""
    n = lambda c: F.sum(c.cast("int"))
    problem = F.col("problem")
    return checked.agg(
        F.count("*").alias("total"), n(problem.isNull()).alias("valid"), n(F.coalesce(problem == "missing media", F.lit(False))).alias("missing"), n(F.coalesce(problem == "surplus media", F.lit(False))).alias("surplus"),
        n(F.coalesce(problem == "placeholder in an answer", F.lit(False))).alias("in_answer"), n(F.col("images") > 0).alias("with_images"), n(F.col("videos") > 0).alias("with_videos"), F.round(F.avg(problem.isNull().cast("double")), 6).alias("ratio"),
    )


def prefix_lengths(rows: DataFrame, length: str, order: str, by: str) -> DataFrame:
    """Adds start, end: the running sums of lengths inside a group, as packed sequences need them."""
    so_far = F.sum(length).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"start": so_far - F.col(length), "end": so_far})


def without_marks(text: Column) -> Column:
    """Grounding tags removed, their contents kept for refs and dropped for boxes."""
    return F.regexp_replace(F.regexp_replace(text, r"<box>.*?</box>", ""), r"</?ref>", "")


def vision_elements(content: Column) -> Column:
    """The parts of a message's content (structs of type, image, video) that are images or videos."""
    return F.filter(content, lambda e: e["image"].isNotNull() | e["video"].isNotNull() | F.coalesce(e["type"].isin("image", "image_url", "video"), F.lit(False)))


def packed_estimate(text: Column, turns: Column, media_tokens: Column, base: int = 21, per_turn: int = 5) -> Column:
    """Tokens of a packed conversation: a base, what each turn costs, words, and media."""
    return base + turns * per_turn + words(text) + F.coalesce(media_tokens, F.lit(0))


def plain_names(rows: DataFrame) -> DataFrame:
    """Column names in lower case, except single capitals (option columns). A name that would then occur twice is refused."""
    names = [c if len(c) == 1 and c.isupper() else c.lower() for c in rows.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"names clash: {sorted({n for n in names if names.count(n) > 1})}")
    return rows.toDF(*names)
