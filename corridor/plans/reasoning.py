"""Queries on reasoning texts, refinement, rules and experience."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.functions import keyed
from corridor.operators import driving, experience, reasoning, refine, spatial
from corridor.sources.fixtures import view, with_views

_KINDS = ", m(place, kind) AS (VALUES " + ", ".join(f"({k}, '{m}')" for k, m in enumerate(reasoning.MARKERS)) + ")"
_PAIRS = _KINDS + """, p AS (SELECT row_number() OVER (ORDER BY a.place, b.place) - 1 AS place, a.kind AS a, b.kind AS b FROM m a JOIN m b ON a.place < b.place),
c AS (SELECT p.place::INT AS place, p.a, p.b, count(*) FILTER (contains(answer, p.a) AND contains(answer, p.b)) AS n, count(*) AS total FROM p, samples GROUP BY ALL)"""
_MATRIX = _PAIRS + ", x AS (SELECT a, b, n FROM c UNION ALL SELECT b, a, n FROM c UNION ALL SELECT kind, kind, 0 FROM m)"
_SOFT = """, w AS (SELECT *, lp_prior - lp_post AS log_weight FROM latents),
e AS (SELECT *, exp(log_weight - max(log_weight) OVER (PARTITION BY doc_id)) AS e FROM w), s AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS weight FROM e)"""
_DRAWN = _SOFT + """, r AS (SELECT *, sum(weight) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM s),
u AS (SELECT doc_id, draw, @h('u|7|' || doc_id || '|' || draw) / 4294967296.0::DOUBLE AS u FROM (SELECT doc_id, unnest(generate_series(0, 1)) AS draw FROM documents)),
d AS (SELECT u.doc_id, u.draw::INT AS draw, coalesce(min(r.k) FILTER (r.upto > u.u), 7) AS k FROM u JOIN r ON r.doc_id = u.doc_id GROUP BY u.doc_id, u.draw)"""
_TOKENS = """, tk AS (SELECT doc_id, k, pos, CASE WHEN @h('n|' || doc_id || '|' || k || '|' || pos) % 10 = 0 THEN NULL ELSE -(@h('t|' || doc_id || '|' || k || '|' || pos) % 100) / 8::DOUBLE END AS lp
FROM (SELECT doc_id, k, unnest(generate_series(0, 4)) AS pos FROM latents))"""
_EGO = ", ego AS (SELECT o_orderkey AS token, (o_orderkey % 5 - 2) / 8::DOUBLE AS vx, (o_orderkey % 9) / 4::DOUBLE AS vy, (o_orderkey % 3 - 1) / 8::DOUBLE AS ax, (o_orderkey % 4 - 2) / 8::DOUBLE AS ay FROM orders)"
_PATH = _EGO + """, st AS (SELECT token, t::INT AS t, CASE WHEN t > 0 THEN vx + (t - 1) * ax ELSE 0 END AS dx, CASE WHEN t = 0 THEN 0 WHEN t = 1 THEN vy ELSE greatest(vy + (t - 1) * ay, 0) END AS dy FROM ego, generate_series(0, 6) g(t)),
path AS (SELECT token, t, sum(dx) OVER w AS x, sum(dy) OVER w AS y, dx, dy FROM st WINDOW w AS (PARTITION BY token ORDER BY t))"""
_HIT = _PATH + """, w AS (SELECT token, ord, dx, dy, t::INT AS t, x + t * vx AS x, y + t * 0.5 AS y FROM objects, generate_series(0, 6) s(t)),
h AS (SELECT w.token, w.ord, min(w.t) AS t FROM w JOIN path p ON p.token = w.token AND p.t = w.t WHERE abs(p.x - w.x) < 0.925 + w.dx / 2 + 2 AND w.y > p.y AND w.y - p.y < 2.042 + w.dy / 2 + 6 AND w.y + (6 - w.t) * 0.5 > 0 GROUP BY w.token, w.ord)"""
_ACTION = _PATH + """, f AS (SELECT token, max(abs(x)) FILTER (t > 0) AS aside, arg_max(x, t) AS x, arg_max(sqrt(dx * dx + dy * dy), t) AS th FROM path GROUP BY token),
s AS (SELECT f.*, sqrt(vx * vx + vy * vy) AS nw FROM f JOIN ego USING (token)),
v AS (SELECT *, CASE WHEN nw < 0.5 AND th < 0.5 THEN 'STOP' WHEN th < 0.5 THEN 'A DECELERATION TO ZERO' WHEN abs(th - nw) < 0.5 THEN 'A CONSTANT SPEED' WHEN nw > 2 * th THEN 'A QUICK DECELERATION' WHEN nw > th THEN 'A DECELERATION'
  WHEN th > 2 * nw THEN 'A QUICK ACCELERATION' ELSE 'AN ACCELERATION' END AS speed FROM s),
act AS (SELECT token, CASE WHEN speed = 'STOP' THEN speed ELSE (CASE WHEN aside < 2 THEN 'MOVE FORWARD' ELSE (CASE WHEN abs(x) > 4 THEN 'TURN ' ELSE 'CHANGE LANE TO ' END) || CASE WHEN x < 0 THEN 'LEFT' ELSE 'RIGHT' END END) || ' WITH ' || speed END AS action FROM v)"""
_MEMORY = ", mem AS (SELECT vec_id AS ord, embedding::DOUBLE[] AS e FROM embeddings)"


def _tokens(s, d):
    rows = view(s, d, "latents").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(4))))
    key = [F.col(c) for c in ("doc_id", "k", "pos")]
    return rows.select("doc_id", "k", "pos", F.when(keyed.hashed("n", *key) % 10 != 0, -(keyed.hashed("t", *key) % 100) / F.lit(8.0)).alias("lp"))


def _ego(s, d):
    k = F.col("o_orderkey")
    return view(s, d, "orders").select(k.alias("token"), ((k % 5 - 2) / F.lit(8.0)).alias("vx"), ((k % 9) / F.lit(4.0)).alias("vy"), ((k % 3 - 1) / F.lit(8.0)).alias("ax"), ((k % 4 - 2) / F.lit(8.0)).alias("ay"))


def _first(s, d):
    return _hits(s, d).select("token", "ord", "t")


def _hits(s, d, half_length=driving.HALF_LENGTH):
    return driving.moving_first_hits(driving.roll_out(_ego(s, d)), view(s, d, "objects"), half_length)


def _thoughts(s, d):
    ego = _ego(s, d)
    return driving.moving_reasoning_text(ego, _hits(s, d), driving.meta_actions(ego, driving.roll_out(ego)))


def _memory(s, d):
    v = F.col("embedding").cast("array<double>")
    return view(s, d, "embeddings").select(F.col("vec_id").alias("ord"), F.slice(v, 1, 9).alias("k1"), F.slice(v, 10, 3).alias("k2"), F.slice(v, 13, 8).alias("k3"))


def _pairs(s, d):
    return reasoning.pairs(view(s, d, "samples"), "answer")


def _soft(s, d):
    return refine.weights(view(s, d, "latents"), "doc_id")


def _drawn(s, d):
    return refine.resample(_soft(s, d), "doc_id", 2, "7")


def _by(*by):
    names = "".join(f"{b}, " for b in by)
    return (lambda s, d: reasoning.share(view(s, d, "samples"), "answer", *by)), with_views(_KINDS + f" SELECT {names}kind, sum(contains(answer, kind)::INT) AS with_kind, count(*) AS total, round(avg(contains(answer, kind)::INT), 6) AS share FROM samples, m GROUP BY {names}kind", "samples")


def _norm(by):
    over = f"PARTITION BY {by}" if by else ""
    return (lambda s, d: reasoning.normalised(reasoning.matrix(_pairs(s, d)), by)), with_views(_MATRIX + f" SELECT a, b, n, round(coalesce(n / nullif(sum(n) OVER ({over}), 0), 0), 6) AS share FROM x", "samples")


QUERIES = {
    "marker_share": _by(),
    "marker_share_by_goal": _by("goal"),
    "marker_share_by_location": _by("location"),
    "marker_share_goal_location": ((lambda s, d: reasoning.share(view(s, d, "samples").where(~F.contains(F.lower("location"), F.lit("asia"))), "answer", "goal")), with_views(_KINDS + " SELECT goal, kind, sum(contains(answer, kind)::INT) AS with_kind, count(*) AS total, round(avg(contains(answer, kind)::INT), 6) AS share FROM samples, m WHERE NOT contains(lower(location), 'asia') GROUP BY goal, kind", "samples")),
    "marker_double_count": ((lambda s, d: reasoning.repeats(view(s, d, "samples"), "answer")), with_views(_KINDS + " SELECT kind, sum(greatest((length(answer) - length(replace(answer, kind, ''))) // length(kind) - 1, 0))::BIGINT AS repeats FROM samples, m GROUP BY kind", "samples")),
    "pair_cooccurrence": (_pairs, with_views(_PAIRS + " SELECT place, a, b, n, round(n / total, 6) AS share FROM c", "samples")),
    "pair_top10": ((lambda s, d: reasoning.top_pairs(_pairs(s, d))), with_views(_PAIRS + " SELECT place, a, b, n, round(n / total, 6) AS share FROM c ORDER BY n DESC, place LIMIT 10", "samples")),
    "cooccurrence_matrix": ((lambda s, d: reasoning.matrix(_pairs(s, d))), with_views(_MATRIX + " SELECT * FROM x", "samples")),
    "matrix_total_norm": _norm(None),
    "matrix_row_norm": _norm("a"),
    "matrix_column_norm": _norm("b"),
    "matrix_wide": ((lambda s, d: reasoning.wide(reasoning.matrix(_pairs(s, d)))), with_views(_MATRIX + " SELECT a, " + ", ".join(f"sum(n) FILTER (b = '{m}')::BIGINT AS \"{m}\"" for m in reasoning.MARKERS) + " FROM x GROUP BY a", "samples")),
    "pair_statistics": ((lambda s, d: reasoning.pair_statistics(_pairs(s, d))), with_views(_PAIRS + " SELECT count(*) AS pairs, sum((n > 0)::INT) AS non_zero, round(avg(n), 6) AS average FROM c", "samples")),
    "field_inventory": ((lambda s, d: reasoning.fields(view(s, d, "pages"), F.col("html"), r"<([a-zA-Z][a-zA-Z0-9]*)")), r"SELECT field, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS field FROM pages) GROUP BY field"),
    "field_names": ((lambda s, d: reasoning.fields(view(s, d, "pages"), F.col("html"), r"<([a-zA-Z][a-zA-Z0-9]*)").select("field").distinct().orderBy("field")), r"SELECT DISTINCT unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS field FROM pages"),
    "elbo_weights": ((lambda s, d: _soft(s, d).withColumn("weight", F.round("weight", 6))), with_views(_SOFT + " SELECT doc_id, k, lp_post, lp_prior, log_weight, round(weight, 6) AS weight FROM s", "latents")),
    "resample": (_drawn, with_views(_DRAWN + " SELECT doc_id, draw, k FROM d", "latents")),
    "refined_rows": ((lambda s, d: refine.refined(_drawn(s, d), _soft(s, d), "doc_id").withColumn("weight", F.round("weight", 6))), with_views(_DRAWN + " SELECT d.doc_id, d.draw, d.k, s.lp_prior AS joint_prob, s.lp_post AS generation_prob, round(s.weight, 6) AS weight, 'prior' AS conversation_type FROM d JOIN s ON s.doc_id = d.doc_id AND s.k = d.k", "latents")),
    "unflattened_generations": ((lambda s, d: refine.unflattened(view(s, d, "latents").select((F.col("doc_id") * 8 + F.col("k")).alias("place"), "lp_post"), view(s, d, "documents").select("doc_id", (F.col("doc_id") * 8).alias("start"), (F.col("doc_id") % 9).alias("length")), "doc_id")), with_views("SELECT s.doc_id, g.k::INT AS k, l.lp_post FROM documents s, generate_series(0, 8) g(k) LEFT JOIN latents l ON l.doc_id * 8 + l.k = s.doc_id * 8 + g.k WHERE g.k < s.doc_id % 9", "latents")),
    "prior_logprob": ((lambda s, d: refine.prior_log_probability(_tokens(s, d), 2, "doc_id", "k")), with_views(_TOKENS + " SELECT doc_id, k, coalesce(sum(lp) FILTER (pos >= 2), 0) AS lp FROM tk GROUP BY doc_id, k", "latents")),
    "corpus_loss_perplexity": ((lambda s, d: refine.corpus_loss(_tokens(s, d))), with_views(_TOKENS + " SELECT count(lp) AS tokens, round(sum(-lp) / count(lp), 6) AS loss, round(exp(sum(-lp) / count(lp)), 3) AS perplexity FROM tk", "latents")),
    "exact_sample": ((lambda s, d: keyed.sample(view(s, d, "documents").select("doc_id", "lang"), 0.3, "42", "doc_id")), with_views("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (ORDER BY @h('42|' || doc_id), doc_id) <= floor(0.3 * count(*) OVER ())").replace("WITH RECURSIVE \n", "")),
    "hash_shuffle_rank": ((lambda s, d: keyed.ranked(view(s, d, "documents").select("doc_id"), "7", "doc_id")), with_views("SELECT doc_id, row_number() OVER (ORDER BY @h('7|' || doc_id), doc_id) AS place FROM documents").replace("WITH RECURSIVE \n", "")),
    "ego_rollout": ((lambda s, d: driving.roll_out(_ego(s, d))), "WITH" + _PATH[1:] + " SELECT token, t, x, y, dx, dy FROM path"),
    "ego_goals": ((lambda s, d: view(s, d, "orders").select(F.col("o_orderkey").alias("token"), driving.goal(F.col("o_orderkey") % 3 - 1, F.col("o_orderkey") % 2).alias("goal"))), "SELECT o_orderkey AS token, CASE WHEN o_orderkey % 3 - 1 > 0 THEN 'RIGHT' WHEN o_orderkey % 2 > 0 THEN 'LEFT' ELSE 'FORWARD' END AS goal FROM orders"),
    "safe_zone_first_hit": (_first, with_views(_HIT + " SELECT token, ord, t FROM h", "objects")),
    "safe_zone_newer": ((lambda s, d: _hits(s, d, driving.NEWER_HALF_LENGTH).select("token", "ord", "t")), with_views(_HIT.replace("2.042", "2.04") + " SELECT token, ord, t FROM h", "objects")),
    "meta_action": ((lambda s, d: driving.meta_actions(_ego(s, d), driving.roll_out(_ego(s, d)))), "WITH" + _ACTION[1:] + " SELECT * FROM act"),
    "rule_reasoning_text": (_thoughts, with_views(_HIT + _ACTION[len(_PATH):] + """, n AS (SELECT h.token, string_agg(' - Notable Objects: ' || o.name || ' at (' || printf('%.2f', o.x::DOUBLE) || ',' || printf('%.2f', o.y::DOUBLE) || '), moving to (' || printf('%.2f', w.x::DOUBLE) || ',' || printf('%.2f', w.y::DOUBLE) || ') at ' || (h.t * 0.5::DOUBLE) || ' second' || chr(10) || '   Potential Effects: within the safe zone of the ego-vehicle at ' || (h.t * 0.5::DOUBLE) || ' second' || chr(10), '' ORDER BY h.ord) AS l
  FROM h JOIN objects o ON o.token = h.token AND o.ord = h.ord JOIN w ON w.token = h.token AND w.ord = h.ord AND w.t = h.t GROUP BY h.token)
SELECT act.token, '*****Chain of Thoughts Reasoning:*****' || chr(10) || 'Thoughts:' || chr(10) || coalesce(l, ' - Notable Objects: None' || chr(10) || '   Potential Effects: None' || chr(10)) || 'Driving Plan: ' || action || chr(10) AS thoughts FROM act LEFT JOIN n ON n.token = act.token""", "objects")),
    "planner_messages": ((lambda s, d: driving.planner_message(view(s, d, "planner"))), with_views("SELECT id, ego || perception || coalesce(experiences, '') || commonsense || reasoning AS message FROM planner", "planner")),
    "planner_messages_long": ((lambda s, d: driving.planner_message(view(s, d, "planner").withColumn("long_experiences", F.upper("experiences")), False, True)), with_views("SELECT id, ego || perception || coalesce(upper(experiences), '') || commonsense || coalesce(chain_of_thoughts, '') AS message FROM planner", "planner")),
    "common_sense": ((lambda s, d: s.range(1).select(F.lit(driving.common_sense()).alias("prompt"))), "SELECT chr(10) || '*****Traffic Rules:*****' || chr(10) || '- " + "' || chr(10) || '- ".join(driving.TRAFFIC_RULES) + "' || chr(10) AS prompt"),
    "experience_topk": ((lambda s, d: experience.nearest_experiences(_memory(s, d), _memory(s, d).where("ord % 100 = 0")).withColumn("confidence", F.round("confidence", 6))), "WITH" + _MEMORY[1:] + """, c AS (SELECT q.ord AS query, m.ord, CASE WHEN q.ord = m.ord THEN 0 ELSE exp(-(list_sum(list_transform(generate_series(1, 9), lambda i: (q.e[i] - m.e[i]) ** 2))
  + 10 * list_sum(list_transform(generate_series(10, 12), lambda i: (q.e[i] - m.e[i]) ** 2)) + list_sum(list_transform(generate_series(13, 20), lambda i: (q.e[i] - m.e[i]) ** 2)))) END AS confidence FROM mem q, mem m WHERE q.ord % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, ord)::INT AS place FROM c) SELECT query, ord, round(confidence, 6) AS confidence, place FROM r WHERE place <= 3"""),
    "experience_pick": ((lambda s, d: experience.nearest_experiences(_memory(s, d), _memory(s, d).where("ord % 100 = 0")).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "ord"))).alias("c")).select("query", driving.picked((F.col("query") / 100 % 4).cast("int"), F.col("c.ord")).alias("picked"))), "WITH" + _MEMORY[1:] + """, c AS (SELECT q.ord AS query, m.ord, CASE WHEN q.ord = m.ord THEN 0 ELSE exp(-(list_sum(list_transform(generate_series(1, 9), lambda i: (q.e[i] - m.e[i]) ** 2))
  + 10 * list_sum(list_transform(generate_series(10, 12), lambda i: (q.e[i] - m.e[i]) ** 2)) + list_sum(list_transform(generate_series(13, 20), lambda i: (q.e[i] - m.e[i]) ** 2)))) END AS confidence FROM mem q, mem m WHERE q.ord % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, ord) AS place FROM c) SELECT query, max(ord) FILTER (place - 1 = query // 100 % 4) AS picked FROM r WHERE place <= 3 GROUP BY query"""),
    "experience_pick_compat": ((lambda s, d: experience.nearest_experiences(_memory(s, d), _memory(s, d).where("ord % 100 = 0")).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "ord"))).alias("c")).select("query", driving.picked((F.col("query") / 100 % 4).cast("int"), F.col("c.ord"), compat=True).alias("picked"))), "WITH" + _MEMORY[1:] + """, c AS (SELECT q.ord AS query, m.ord, CASE WHEN q.ord = m.ord THEN 0 ELSE exp(-(list_sum(list_transform(generate_series(1, 9), lambda i: (q.e[i] - m.e[i]) ** 2))
  + 10 * list_sum(list_transform(generate_series(10, 12), lambda i: (q.e[i] - m.e[i]) ** 2)) + list_sum(list_transform(generate_series(13, 20), lambda i: (q.e[i] - m.e[i]) ** 2)))) END AS confidence FROM mem q, mem m WHERE q.ord % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY confidence DESC, ord) AS place FROM c) SELECT query, max(ord) FILTER (place - 1 = query // 100 % 4 AND place < 3) AS picked FROM r WHERE place <= 3 GROUP BY query"""),
}
