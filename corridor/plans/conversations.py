"""Queries on conversations, multiple choice and media sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.functions import formats, images, media, trajectory_text
from corridor.operators import choices, conversations, history, refine
from corridor.sources.fixtures import view, with_views

_WORDS = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_BLOCKS, _VQA = conversations.BLOCKS, conversations.VQA_BLOCKS
_U = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
_MASKS = """, ki(conversation_type, p) AS (VALUES ('prior', 0.5::DOUBLE), ('posterior', 0.8::DOUBLE)),
mk AS (SELECT planner.*, conversation_type, i::INT AS index, """ + ", ".join(_U.format(f"'42|' || id || '|' || conversation_type || '|' || i || '|{b}'") + f" < p AS keep_{b}" for b in _BLOCKS) + " FROM planner, ki, generate_series(0, 7) g(i))"
_COINS = ", cn AS (SELECT planner.*, CASE WHEN " + _U.format("'42|' || id || '|coin'") + " < 0.5 THEN 'prior' ELSE 'posterior' END AS conversation_type, i::INT AS index, " + ", ".join(_U.format(f"'42|' || id || '|' || i || '|{b}'") + f" < 0.7::DOUBLE AS keep_{b}" for b in _VQA) + " FROM planner, generate_series(0, 3) g(i))"
_GOAL, _HEAD = "split_part(ego, chr(10) || 'Mission Goal:', 2)", "split_part(ego, chr(10) || 'Mission Goal:', 1)"
_TEXTS = {"goal": f"'Mission Goal:' || {_GOAL}", "perception": "perception", "commonsense": "commonsense", "experience": "coalesce(experiences, chr(10) || 'Experience: None.' || chr(10))", "cot": "chain_of_thoughts", "reasoning": "reasoning"}
_FILL = "CASE WHEN trim({0}, ' ' || chr(10)) = '' THEN chr(10) || 'None.' ELSE {0} END"
_ASKED = dict(zip(_VQA, formats.QUESTIONS, strict=True))
_VQA_TEXTS = {
    "goal": _GOAL, "perception": _FILL.format("split_part(perception, '*****Perception Results:*****', 2)"), "experience": "coalesce(split_part(experiences, '*****Past Driving Experience for Reference:*****', 2), chr(10) || 'No similar past experience available.')",
    "collidable": _FILL.format("split_part(split_part(chain_of_thoughts, chr(10) || 'Thoughts:', 2), chr(10) || 'Driving Plan:', 1)"), "plan": _FILL.format("split_part(chain_of_thoughts, chr(10) || 'Driving Plan:', 2)"), "objects": _FILL.format("split_part(split_part(reasoning, chr(10) || 'Thoughts:', 2), chr(10) || 'Driving Plan:', 1)"),
}
_CHOICE = ", op AS (SELECT *, [struct_pack(k := 'A', v := a), struct_pack(k := 'B', v := b), struct_pack(k := 'C', v := c), struct_pack(k := 'D', v := d)] AS o FROM mcq)"
_INFER = _CHOICE + f""", t AS (SELECT *, list_filter(regexp_split_to_array(translate(prediction, '{choices.MARKS}', '{' ' * len(choices.MARKS)}'), '\\s+'), lambda w: w <> '') AS w FROM op),
l AS (SELECT *, list_filter(['A', 'B', 'C', 'D'], lambda x: list_contains(w, x)) AS letters, list_filter(o, lambda e: contains(lower(prediction), lower(e.v))) AS texts FROM t),
f AS (SELECT doc_id, split, answer, coalesce(CASE WHEN contains(prediction, 'Cannot determine the answer') THEN 'Z' WHEN len(letters) = 1 AND NOT (list_contains(w, 'A') AND len(w) > 3) THEN letters[1] WHEN len(letters) = 0 AND list_contains(w, 'Z') THEN 'Z' END,
  CASE WHEN len(texts) = 1 THEN texts[1].k END) AS inferred FROM l)"""
_CHECK = """, ck AS (SELECT *, ((length(text) - length(replace(text, '<image>', ''))) // 7)::INT AS images, ((length(text) - length(replace(text, '<video>', ''))) // 7)::INT AS videos FROM media_rows),
pr AS (SELECT *, CASE WHEN role IN ('gpt', 'assistant') AND (images > 0 OR videos > 0) THEN 'placeholder in an answer' WHEN images > n_images OR videos > n_videos THEN 'missing media' WHEN images < n_images OR videos < n_videos THEN 'surplus media' END AS problem FROM ck)"""
_RESIZE = """, z AS (SELECT *, greatest(32, round_even(height / 32, 0) * 32)::BIGINT AS hb, greatest(32, round_even(width / 32, 0) * 32)::BIGINT AS wb, sqrt(height::DOUBLE * width / 16777216) AS dn, sqrt(4096 / (height::DOUBLE * width)) AS up FROM sizes),
rs AS (SELECT *, CASE WHEN hb * wb > 16777216 THEN floor(height / dn / 32) * 32 WHEN hb * wb < 4096 THEN ceil(height * up / 32) * 32 ELSE hb END::BIGINT AS rh,
  CASE WHEN hb * wb > 16777216 THEN floor(width / dn / 32) * 32 WHEN hb * wb < 4096 THEN ceil(width * up / 32) * 32 ELSE wb END::BIGINT AS rw FROM z)"""


def _sample(s, d):
    return view(s, d, "planner")


def _inferred(s, d):
    return view(s, d, "mcq").select("doc_id", "split", "answer", choices.infer(F.col("prediction"), choices.options("a", "b", "c", "d")).alias("inferred"))


def _hits(s, d):
    return _inferred(s, d).withColumn("hit", F.coalesce(F.col("inferred") == F.col("answer"), F.lit(False)))


def _sizes(s, d):
    return view(s, d, "sizes")


def _stdout(s, d):
    k = F.col("p_partkey") % 8
    got = F.when(k == 0, "3 4").when(k == 1, " 3 4\n").when(k == 2, "4 3").when(k == 3, "3.0000001 4").when(k == 4, "3\n4").when(k == 6, "4.0001 3").when(k == 7, "3 4\nx ").otherwise("5 6")
    return view(s, d, "part").select("p_partkey", k.alias("k"), got.alias("got"), F.when(k == 7, "3 4\n\nx").otherwise("3 4").alias("want"))


#: Tokens (words here) that a conversation's history may have.
_BUDGET = 60


def _history(s, d):
    turns = view(s, d, "conversations").select("conv_id", "turn", "role", F.size(F.split("text", " ")).alias("tokens"))
    return history.within_budget(turns, _BUDGET)


def _images(s, d):
    """Data URIs of image files that are broken off behind their headers; every sixth before its size."""
    hexed = lambda x, n: F.lpad(F.hex(x), 2 * n, "0")
    big = lambda x, n=2: hexed(x, n)
    small = lambda x, n=2: F.concat(*[F.substring(hexed(x, n), 2 * k - 1, 2) for k in range(n, 0, -1)])
    h, w, text = F.col("height").cast("long"), F.col("width").cast("long"), lambda t: F.lit(t.encode().hex())
    riff = lambda kind, body: F.concat(text("RIFF"), F.lit("00000000"), text("WEBP" + kind), F.lit("00000000"), body)
    png = F.concat(F.lit("89504e470d0a1a0a0000000d"), text("IHDR"), big(w, 4), big(h, 4), F.lit("0806000000"))
    jpeg = F.concat(F.lit("ffd8ffe00010"), text("JFIF"), F.lit("00" * 10), F.lit("ffffdb0004aabb"), F.lit("ffc2001108"), big(h), big(w), F.lit("03"))
    forms = [png, jpeg, F.concat(text("GIF89a"), small(w), small(h)), riff("VP8X", F.concat(F.lit("10000000"), small(w - 1, 3), small(h - 1, 3))), riff("VP8L", F.concat(F.lit("2f"), small((w - 1) + (h - 1) * 16384, 4))), F.substring(jpeg, 1, 40)]
    kind = F.get(F.array(*[F.lit(k) for k in ("png", "jpeg", "gif", "webp", "webp", "jpeg")]), (F.col("id") % 6).cast("int"))
    uri = F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(F.unhex(F.get(F.array(*forms), (F.col("id") % 6).cast("int")))))
    rows = images.with_headers(view(s, d, "sizes").select("id", images.image_bytes(uri).alias("content")), "content")
    return rows.select("id", "image.*").withColumn("z", media.smart_resize(F.col("height"), F.col("width"))).select("id", "format", "width", "height", "channels", F.col("z.height").alias("resized_height"), F.col("z.width").alias("resized_width"))


QUERIES = {
    "history_within_budget": (_history, f"""WITH c AS (SELECT conv_id, turn, role, len(string_split(text, ' '))::INT AS tokens FROM conversations), s AS (SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC))::BIGINT AS upto FROM c),
w AS (SELECT conv_id, min(turn) AS f, max(upto) AS a, min(turn) FILTER (role = 'user' AND upto <= {_BUDGET}) AS st FROM s GROUP BY conv_id)
SELECT s.conv_id, s.turn, s.role, s.tokens, s.upto FROM s JOIN w ON w.conv_id = s.conv_id WHERE s.turn >= CASE WHEN a <= {_BUDGET} THEN f ELSE st END"""),
    "image_headers": (_images, with_views(_RESIZE + """ SELECT id, CASE id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'webp' END AS format, CASE WHEN id % 6 < 5 THEN s.width END AS width, CASE WHEN id % 6 < 5 THEN s.height END AS height,
  CASE id % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 4 WHEN 4 THEN 3 END AS channels, CASE WHEN id % 6 < 5 THEN rh END AS resized_height, CASE WHEN id % 6 < 5 THEN rw END AS resized_width FROM sizes s JOIN rs USING (id)""", "sizes")),
    "mask_expansion": ((lambda s, d: conversations.expand_masks(_sample(s, d), "id", 8).select("id", "conversation_type", "index", *[f"keep_{b}" for b in _BLOCKS])), with_views(_MASKS + " SELECT id, conversation_type, index, " + ", ".join(f"keep_{b}" for b in _BLOCKS) + " FROM mk", "planner")),
    "masked_conversations": ((lambda s, d: conversations.masked_conversation(conversations.expand_masks(_sample(s, d), "id", 8)).select("id", "conversation_type", "index", "user", "assistant")), with_views(_MASKS + f" SELECT id, conversation_type, index, '<image>' || chr(10) || {_HEAD} || CASE WHEN conversation_type = 'posterior' THEN planning_target ELSE '' END AS user, " + " || ".join(f"CASE WHEN keep_{b} THEN {_TEXTS[b]} ELSE '' END" for b in _BLOCKS) + " || CASE WHEN conversation_type = 'posterior' THEN '' ELSE planning_target END AS assistant FROM mk", "planner")),
    "vqa_coin": ((lambda s, d: conversations.one_kind(_sample(s, d), "id", 4).select("id", "conversation_type", "index", *[f"keep_{b}" for b in _VQA])), with_views(_COINS + " SELECT id, conversation_type, index, " + ", ".join(f"keep_{b}" for b in _VQA) + " FROM cn", "planner")),
    "vqa_conversations": ((lambda s, d: conversations.masked_conversation(conversations.one_kind(_sample(s, d), "id", 4), vqa=True).select("id", "conversation_type", "index", "user", "assistant")), with_views(_COINS + f" SELECT id, conversation_type, index, '<image>' || chr(10) || commonsense || {_HEAD} || CASE WHEN conversation_type = 'posterior' THEN chr(10) || chr(10) || planning_target ELSE '' END AS user, " + " || ".join(f"CASE WHEN keep_{b} THEN '{_ASKED[b]}' || {_VQA_TEXTS[b]} ELSE '' END" for b in _VQA) + " || CASE WHEN conversation_type = 'posterior' THEN '' ELSE chr(10) || chr(10) || planning_target END AS assistant FROM cn", "planner")),
    "sft_rows": ((lambda s, d: conversations.sft_rows(_sample(s, d)).select("id", F.posexplode("conversations").alias("place", "c")).select("id", "place", F.col("c.from").alias("who"), F.col("c.value").alias("value"))), with_views(f"SELECT id, 0 AS place, 'human' AS who, '<image>' || chr(10) || {_HEAD} AS value FROM planner UNION ALL SELECT id, 1, 'assistant', 'Mission Goal:' || {_GOAL} || perception || coalesce(experiences, '') || commonsense || reasoning || planning_target FROM planner", "planner")),
    "prior_posterior_messages": ((lambda s, d: conversations.prior_and_posterior(_sample(s, d).select("id", F.col("ego").alias("user"), F.col("planning_target").alias("action"), F.col("reasoning").alias("latent"))).drop("user", "action", "latent")), with_views("SELECT id, ego || chr(10) || planning_target AS posterior_user, reasoning AS posterior_assistant, ego AS prior_user, reasoning || chr(10) || chr(10) || planning_target AS prior_assistant FROM planner", "planner")),
    "goal_split": ((lambda s, d: _sample(s, d).select("id", conversations.parted_ego(F.col("ego"))[0].alias("ego"), conversations.parted_ego(F.col("ego"))[1].alias("goal"))), with_views(f"SELECT id, {_HEAD} AS ego, {_GOAL} AS goal FROM planner", "planner")),
    "vqa_sections": ((lambda s, d: _sample(s, d).select("id", *[t.alias(b) for b, t in conversations.vqa_blocks().items()])), with_views("SELECT id, " + ", ".join(f"'{_ASKED[b]}' || {_VQA_TEXTS[b]} AS {b}" for b in _VQA) + " FROM planner", "planner")),
    "token_stats": ((lambda s, d: conversations.token_statistics(_sample(s, d), "ego", "reasoning")), with_views(f", c AS (SELECT {_WORDS.format('ego')} AS u, {_WORDS.format('reasoning')} AS a FROM planner) SELECT count(*) AS n, sum(u)::BIGINT AS user_tokens, sum(a)::BIGINT AS assistant_tokens, max(u + a) AS longest, round(avg(u + a), 6) AS average FROM c", "planner")),
    "token_limit_flags": ((lambda s, d: conversations.over_limit(_sample(s, d).select("id", "ego"), "ego", 400).drop("ego")), with_views(f"SELECT id, {_WORDS.format('ego')}::INT AS tokens, {_WORDS.format('ego')} + 256 > 400 AS over FROM planner", "planner")),
    "word_lengths": ((lambda s, d: view(s, d, "media_rows").select("conv_id", "turn", conversations.length_estimate(F.col("text"), F.col("n_images") > 0).alias("length"))), with_views(f"SELECT conv_id, turn, (CASE WHEN n_images > 0 THEN {_WORDS.format('text')} + 128 ELSE -{_WORDS.format('text')} END)::INT AS length FROM media_rows", "media_rows")),
    "message_tokenise": ((lambda s, d: conversations.parts(view(s, d, "media_rows"), "text", "conv_id", "turn")), with_views(r""", sp AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(replace(text, '<image>', chr(1) || '<image>' || chr(1)), '<video>', chr(1) || '<video>' || chr(1)), chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS p FROM media_rows),
un AS (SELECT conv_id, turn, unnest(generate_series(1, len(p))) AS i, p FROM sp), kd AS (SELECT conv_id, turn, (i - 1)::INT AS place, CASE p[i] WHEN '<image>' THEN 'image' WHEN '<video>' THEN 'video' ELSE 'text' END AS kind, p[i] AS value FROM un)
SELECT *, CASE WHEN kind <> 'text' THEN (row_number() OVER (PARTITION BY conv_id, turn, kind ORDER BY place) - 1)::INT END AS media FROM kd""", "media_rows")),
    "media_validation": ((lambda s, d: conversations.media_check(view(s, d, "media_rows")).select("conv_id", "turn", "images", "videos", "problem")), with_views(_CHECK + " SELECT conv_id, turn, images, videos, problem FROM pr", "media_rows")),
    "media_validation_lenient": ((lambda s, d: conversations.media_check(view(s, d, "media_rows"), strict=False).select("conv_id", "turn", "problem")), with_views(_CHECK + " SELECT conv_id, turn, nullif(problem, 'surplus media') AS problem FROM pr", "media_rows")),
    "yes_no_prompts": ((lambda s, d: view(s, d, "part").select("p_partkey", choices.yes_no_prompt(F.col("p_name")).alias("prompt"))), "SELECT p_partkey, p_name || ' Please answer yes or no.' AS prompt FROM part"),
    "short_prompts": ((lambda s, d: view(s, d, "part").select("p_partkey", choices.short_prompt(F.col("p_name")).alias("prompt"))), "SELECT p_partkey, p_name || chr(10) || 'Please try to answer the question with short words or phrases if possible.' AS prompt FROM part"),
    "strict_resize": ((lambda s, d: _sizes(s, d).select("id", media.strict_resize(F.col("height"), F.col("width"), 32, 4096, 16777216).alias("z")).select("id", "z.height", "z.width")), with_views(_RESIZE + " SELECT id, CASE WHEN height >= 32 AND width >= 32 THEN rh END AS height, CASE WHEN height >= 32 AND width >= 32 THEN rw END AS width FROM rs", "sizes")),
    "fixed_nframes": ((lambda s, d: _sizes(s, d).select("id", media.fixed_nframes(F.col("id") % 50, F.col("frames")).alias("n"))), with_views(", n AS (SELECT id, frames, (round_even((id % 50) / 2, 0) * 2)::BIGINT AS n FROM sizes) SELECT id, CASE WHEN n >= 2 AND n <= frames THEN n END AS n FROM n", "sizes")),
    "sft_rows_plain": ((lambda s, d: conversations.sft_rows(_sample(s, d), "", False, False, False, True).select("id", F.posexplode("conversations").alias("place", "c")).select("id", "place", F.col("c.from").alias("who"), F.col("c.value").alias("value"))), with_views(f"SELECT id, 0 AS place, 'human' AS who, '<image>' || chr(10) || {_HEAD} AS value FROM planner UNION ALL SELECT id, 1, 'assistant', commonsense || coalesce(chain_of_thoughts, '') || planning_target FROM planner", "planner")),
    "refined_type_counts": ((lambda s, d: refine.type_counts(conversations.expand_masks(_sample(s, d), "id", 8).where("keep_goal AND NOT keep_cot"))), with_views(_MASKS + " SELECT conversation_type, count(*) AS n FROM mk WHERE keep_goal AND NOT keep_cot GROUP BY conversation_type", "planner")),
    "validation_stats": ((lambda s, d: conversations.validation_statistics(conversations.media_check(view(s, d, "media_rows")))), with_views(_CHECK + " SELECT count(*) AS total, sum((problem IS NULL)::INT) AS valid, count(*) FILTER (problem = 'missing media') AS missing, count(*) FILTER (problem = 'surplus media') AS surplus, count(*) FILTER (problem = 'placeholder in an answer') AS in_answer, sum((images > 0)::INT) AS with_images, sum((videos > 0)::INT) AS with_videos, round(avg((problem IS NULL)::INT), 6) AS ratio FROM pr", "media_rows")),
    "packed_prefix_lengths": ((lambda s, d: conversations.prefix_lengths(view(s, d, "media_rows").select("conv_id", "turn", conversations.words(F.col("text")).alias("n")), "n", "turn", "conv_id")), with_views(f", w AS (SELECT conv_id, turn, {_WORDS.format('text')}::INT AS n FROM media_rows), c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM w) SELECT conv_id, turn, n, (e - n)::BIGINT AS start, e::BIGINT AS \"end\" FROM c", "media_rows")),
    "mcq_option_infer": (_inferred, with_views(_INFER + " SELECT * FROM f", "mcq")),
    "mcq_accuracy_by_split": ((lambda s, d: choices.accuracy(_hits(s, d))), with_views(_INFER + " SELECT split, count(*) AS n, round(avg(coalesce(inferred = answer, false)::INT), 6) AS accuracy FROM f GROUP BY ROLLUP (split)", "mcq")),
    "answer_key_anti_check": ((lambda s, d: view(s, d, "documents").select("doc_id").join(view(s, d, "labels").select("doc_id"), "doc_id", "left_anti")), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "mcq_complete": ((lambda s, d: choices.complete(view(s, d, "mcq").withColumns({"a": F.when(F.col("doc_id") % 3 != 0, F.col("a")), "answer": F.when(F.col("doc_id") % 3 != 0, F.col("answer")).otherwise(F.col("c"))})).select("doc_id", "a", "b", "answer")), with_views("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN a ELSE c END AS a, CASE WHEN doc_id % 3 <> 0 THEN b ELSE 'Other Answers' END AS b, CASE WHEN doc_id % 3 <> 0 THEN answer ELSE 'A' END AS answer FROM mcq", "mcq")),
    "mcq_prompts": ((lambda s, d: view(s, d, "mcq").select("doc_id", choices.mcq_prompt(F.concat(F.lit("What in "), F.col("split"), F.when(F.col("doc_id") % 2 == 0, "?").otherwise("中?")), choices.options("a", "b", "c", "d")).alias("prompt"))), with_views("SELECT doc_id, 'Question: What in ' || split || CASE WHEN doc_id % 2 = 0 THEN '?' ELSE '中?' END || chr(10) || 'Options:' || chr(10) || 'A. ' || a || chr(10) || 'B. ' || b || chr(10) || 'C. ' || c || chr(10) || 'D. ' || d || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Please select the correct answer from the options above.' ELSE '请直接回答选项字母。' END AS prompt FROM mcq", "mcq")),
    "judge_prompts": ((lambda s, d: view(s, d, "mcq").select("doc_id", choices.judge_prompt(F.lit("Which"), choices.options("a", "b", "c", "d"), F.col("prediction")).alias("prompt"))), with_views("SELECT doc_id, '" + formats.JUDGE.replace("\n", "' || chr(10) || '") + "' || 'Which?' || chr(10) || 'Options: There are several options: ' || chr(10) || 'A. ' || a || chr(10) || 'B. ' || b || chr(10) || 'C. ' || c || chr(10) || 'D. ' || d || chr(10) || chr(10) || 'Answer: ' || prediction || chr(10) || 'Your output: ' AS prompt FROM mcq", "mcq")),
    "unresolved_answers": ((lambda s, d: _inferred(s, d).where("inferred IS NULL").select("doc_id", F.lit("Z").alias("option"), F.lit(False).alias("extracted"))), with_views(_INFER + " SELECT doc_id, 'Z' AS option, false AS extracted FROM f WHERE inferred IS NULL", "mcq")),
    "output_comparison": ((lambda s, d: _stdout(s, d).select("p_partkey", choices.same_output(F.col("got"), F.col("want")).alias("same"), choices.output_rung(F.col("got"), F.col("want")).alias("rung"))), "SELECT p_partkey, p_partkey % 8 <> 5 AS same, ['trimmed', 'trimmed', 'words', 'numbers', 'numbers', NULL, 'rounded', 'lines'][p_partkey % 8 + 1] AS rung FROM part"),
    "code_test_summary": ((lambda s, d: choices.test_summary(_stdout(s, d).select((F.when(F.col("k") == 4, -1).when(F.col("k") == 3, -2).when(F.col("k") == 5, 0).otherwise(1)).alias("outcome")))), "WITH o AS (SELECT CASE p_partkey % 8 WHEN 4 THEN -1 WHEN 3 THEN -2 WHEN 5 THEN 0 ELSE 1 END AS o FROM part) SELECT count(*) AS total, count(*) FILTER (o = 1) AS passed, count(*) FILTER (o = 0) AS failed, count(*) FILTER (o = -1) AS timed_out, count(*) FILTER (o = -2) AS broken, round(avg((o = 1)::INT), 6) AS accuracy, bool_and(o = 1) AS all_passed FROM o"),
    "smart_resize": ((lambda s, d: _sizes(s, d).select("id", media.smart_resize(F.col("height"), F.col("width")).alias("z")).select("id", "z.height", "z.width")), with_views(_RESIZE + " SELECT id, rh AS height, rw AS width FROM rs", "sizes")),
    "smart_nframes": ((lambda s, d: _sizes(s, d).select("id", media.smart_nframes(F.col("frames"), F.col("fps")).alias("n"))), with_views(", n AS (SELECT id, frames, (floor(least(least(greatest(frames / fps * 2, 4), floor(least(768, frames) / 2) * 2), frames) / 2) * 2)::BIGINT AS n FROM sizes) SELECT id, CASE WHEN n >= 2 AND n <= frames THEN n END AS n FROM n", "sizes")),
    "frame_range": ((lambda s, d: _sizes(s, d).select("id", media.frame_range(F.col("frames"), F.col("fps"), F.when(F.col("id") % 3 != 0, (F.col("id") % 40).cast("double")), F.when(F.col("id") % 4 != 0, (F.col("id") % 70).cast("double"))).alias("z")).select("id", "z.first", "z.last", "z.frames")), with_views(""", q AS (SELECT id, frames, fps, CASE WHEN id % 3 <> 0 THEN (id % 40)::DOUBLE END AS s, CASE WHEN id % 4 <> 0 THEN (id % 70)::DOUBLE END AS e FROM sizes),
r AS (SELECT id, s, e, CASE WHEN s IS NULL THEN 0 ELSE ceil(greatest(0, least(s, frames / fps)) * fps) END::BIGINT AS a, CASE WHEN e IS NULL THEN frames - 1 ELSE least(floor(greatest(0, least(e, frames / fps)) * fps), frames - 1) END::BIGINT AS b FROM q)
SELECT id, CASE WHEN a < b OR (s IS NULL AND e IS NULL) THEN a END AS first, CASE WHEN a < b OR (s IS NULL AND e IS NULL) THEN b END AS last, CASE WHEN a < b OR (s IS NULL AND e IS NULL) THEN b - a + 1 END AS frames FROM r""", "sizes")),
    "frame_ids": ((lambda s, d: _sizes(s, d).select("id", F.posexplode(media.frame_ids(F.lit(0), F.col("frames") - 1, F.lit(4))).alias("k", "frame"))), with_views("SELECT id, k::INT AS k, round_even((frames - 1) / 3 * k, 0)::BIGINT AS frame FROM sizes, generate_series(0, 3) g(k)", "sizes")),
    "pixel_budget": ((lambda s, d: _sizes(s, d).select("id", media.pixel_budget(F.col("frames")).alias("pixels"))), with_views("SELECT id, greatest(least(786432::DOUBLE, 25165824::DOUBLE / frames * 2), 137625::DOUBLE) AS pixels FROM sizes", "sizes")),
    "media_tokens": ((lambda s, d: _sizes(s, d).select("id", media.media_tokens(F.lit(1), F.ceil(F.col("height") / 16), F.ceil(F.col("width") / 16)).alias("tokens"))), with_views("SELECT id, floor(ceil(height / 16) * ceil(width / 16) / 4)::BIGINT AS tokens FROM sizes", "sizes")),
    "bbox_rel1000": ((lambda s, d: _sizes(s, d).select("id", media.box_per_mille((F.col("id") * 13 % 2000).cast("double"), F.col("width")).alias("x"), media.box_resized((F.col("id") * 13 % 2000).cast("double"), F.col("width"), F.lit(448).cast("long")).alias("resized"))), with_views("SELECT id, greatest(0, least(1000, round_even((id * 13 % 2000)::DOUBLE / width * 1000, 0)))::INT AS x, greatest(0, least(447, round_even((id * 13 % 2000)::DOUBLE / width * 448, 0)))::BIGINT AS resized FROM sizes", "sizes")),
    "rescaled_points": ((lambda s, d: _sizes(s, d).select("id", media.rescaled(F.col("id") % 1000, F.col("width")).alias("x"), media.unnormalised((F.col("id") % 1000) / F.lit(1000.0), F.col("width")).alias("trace"))), with_views("SELECT id, round_even((id % 1000) / 999 * width, 0)::INT AS x, trunc((id % 1000) / 1000 * width)::INT AS trace FROM sizes", "sizes")),
    "camera_parameters": ((lambda s, d: _sizes(s, d).select("id", media.camera(F.col("width"), F.col("height")).alias("c")).select("id", "c.cx", "c.cy", F.round("c.fx", 1).alias("fx"), F.round("c.fy", 1).alias("fy"))), with_views("SELECT id, round(width / 2, 2) AS cx, round(height / 2, 2) AS cy, round(round(width / 1.154700538379251, 2), 1) AS fx, round(round(height / 1.154700538379251, 2), 1) AS fy FROM sizes", "sizes")),
    "project_box3d": ((lambda s, d: _sizes(s, d).select("id", F.posexplode(media.projected_box((F.lit(1.0), F.lit(0.5), (F.col("id") % 7 - 1).cast("double")), (F.lit(2.0), F.lit(1.5), F.lit(4.0)), ((F.col("id") % 90).cast("double"), (F.col("id") % 45).cast("double"), (F.col("id") % 30).cast("double")), media.camera(F.lit(1000), F.lit(600)))).alias("k", "p")).select("id", "k", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))), with_views(""", s(k, a, b, c) AS (VALUES (0,1,1,1), (1,1,1,-1), (2,1,-1,1), (3,1,-1,-1), (4,-1,1,1), (5,-1,1,-1), (6,-1,-1,1), (7,-1,-1,-1)),
q AS (SELECT id, k, a * 1.0::DOUBLE AS u, b * 0.75::DOUBLE AS v, c * 2.0::DOUBLE AS w, radians(id % 90) AS p, radians(id % 45) AS y, radians(id % 30) AS r, (id % 7 - 1)::DOUBLE AS z0 FROM sizes, s),
q1 AS (SELECT *, v * cos(p) - w * sin(p) AS v1, v * sin(p) + w * cos(p) AS w1 FROM q), q2 AS (SELECT *, u * cos(y) + w1 * sin(y) AS u2, w1 * cos(y) - u * sin(y) AS w2 FROM q1),
q3 AS (SELECT id, k, u2 * cos(r) - v1 * sin(r) + 1 AS x, u2 * sin(r) + v1 * cos(r) + 0.5 AS y, w2 + z0 AS z FROM q2)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INT AS k, round(866.03 * x / z + 500, 3) AS x, round(519.62 * y / z + 300, 3) AS y FROM q3 WHERE z > 0""", "sizes")),
    "media_types": ((lambda s, d: view(s, d, "pages").select("page_id", media.media_type(F.col("url")).alias("mime"), media.scheme(F.col("url")).alias("scheme"))), r"SELECT page_id, CASE WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1) IN ('jpg','jpeg','png','gif','webp','mp4','avi','txt','json') THEN 'other' WHEN regexp_matches(url, '^https?://') THEN 'url' ELSE 'text' END AS mime, CASE WHEN regexp_matches(url, '^https?://') THEN 'http' ELSE 'path' END AS scheme FROM pages"),
}
