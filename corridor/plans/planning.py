"""Queries on trajectories: metrics, collisions, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corridor.functions import trajectory_text as text
from corridor.operators import planning
from corridor.sources.fixtures import view, with_views

_ALIGNED = """, a AS (SELECT gt.token, gt.t, gt.x, gt.y, gt.mask, coalesce(pred.x, 0) AS px, coalesce(pred.y, 0) AS py, pred.token IS NOT NULL AS found FROM gt LEFT JOIN pred ON pred.token = gt.token AND pred.t = gt.t),
l AS (SELECT t, count(*) AS n, sum((NOT found)::INT) AS missing, avg(sqrt(mask * (px - x) * (px - x) + mask * (py - y) * (py - y))) AS v FROM a GROUP BY t)"""
_HITS = """, a AS (SELECT gt.token, gt.t, gt.x, gt.y, coalesce(pred.x, 0) AS px, coalesce(pred.y, 0) AS py FROM gt LEFT JOIN pred ON pred.token = gt.token AND pred.t = gt.t),
o AS (SELECT r.r AS orow, c.c AS ocol FROM generate_series(97, 104) r(r), generate_series(98, 101) c(c)),
g AS (SELECT DISTINCT a.token, a.t FROM a, o, cells s WHERE s.token = a.token AND s.t = a.t AND s.r = greatest(0, least(199, trunc(a.y / 0.5 + orow)::INT)) AND s.c = greatest(0, least(199, trunc(a.x / 0.5 + ocol)::INT))),
b AS (SELECT DISTINCT a.token, a.t FROM a, o, cells s WHERE s.token = a.token AND s.t = a.t AND s.r = greatest(0, least(199, trunc(a.py / 0.5 + orow)::INT)) AND s.c = greatest(0, least(199, trunc(a.px / 0.5 + ocol)::INT))),
p AS (SELECT DISTINCT a.token, a.t FROM a, cells s WHERE s.token = a.token AND s.t = a.t AND s.r = trunc((a.py + 49.75) / 0.5)::INT AND s.c = trunc((a.px + 49.75) / 0.5)::INT),
h AS (SELECT a.token, a.t, g.token IS NOT NULL AS gt_hit, p.token IS NOT NULL AND g.token IS NULL AS point_hit, b.token IS NOT NULL AND g.token IS NULL AS box_hit
  FROM a LEFT JOIN g ON g.token = a.token AND g.t = a.t LEFT JOIN b ON b.token = a.token AND b.t = a.t LEFT JOIN p ON p.token = a.token AND p.t = a.t)"""
_NUM = r"-?\d+\.?\d*"


def _hits(s, d):
    return planning.collisions(view(s, d, "gt"), view(s, d, "pred"), view(s, d, "cells"))


def _points(s, d, parse, source="generations"):
    found = view(s, d, source).select("token", parse(F.col("generated_text")).alias("p"))
    return found.select("token", F.posexplode("p").alias("k", "w")).select("token", (F.col("k") + 1).alias("t"), F.col("w.x").alias("x"), F.col("w.y").alias("y"))


def _report(s, d, cumulative):
    return planning.report(planning.errors(planning.align(view(s, d, "gt"), view(s, d, "pred"))).groupBy("t").agg(F.avg("l2").alias("v")), "v", cumulative)


def _last(s, d):
    """Every generation twice, the second time changed or broken."""
    own = view(s, d, "generations")
    again = F.when(F.col("token") % 3 == 0, "broken").otherwise(F.replace(F.col("generated_text"), F.lit("("), F.lit("(1")))
    records = own.select("token", F.lit(0).alias("line"), "generated_text").union(own.select("token", F.lit(1), again))
    found = planning.last_written(records.withColumn("p", text.parse_strict(F.col("generated_text"))), "p")
    return found.select("token", F.posexplode("p").alias("k", "w")).select("token", (F.col("k") + 1).alias("t"), "w.x", "w.y")


def _written(s, d, forms):
    """token, generated_text: each token's predicted path in one of some formats, by turns. forms: (before, of a point with x and y, between, after)."""
    points = view(s, d, "pred").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("p"))  # a path has a fixed number of points

    def told(before, point, between, after):
        return F.concat(F.lit(before), F.array_join(F.transform("p", lambda q: point(q["x"].cast("string"), q["y"].cast("string"), q["t"])), between), F.lit(after))

    return points.select("token", F.get(F.array(*[told(*f) for f in forms]), (F.col("token") % len(forms)).cast("int")).alias("generated_text"))


def _read(rows, parse):
    found = rows.select("token", parse(F.col("generated_text")).alias("p"))
    return found.select("token", F.posexplode("p").alias("k", "w")).select("token", (F.col("k") + 1).alias("t"), F.col("w.x").alias("x"), F.col("w.y").alias("y"))


_HEAD = "Thoughts: go.\nPlanned Trajectory:\n"
#: Texts that the tolerant parser meets: a literal, quoted and spaced pairs (of brackets in brackets the first is seen), bare pairs within and out of bounds, torn numbers, one bare pair alone.
_ROBUST = [
    (_HEAD + "[", lambda x, y, t: F.concat(F.lit("("), x, F.lit(", "), y, F.lit(")")), ", ", "]"), (_HEAD, lambda x, y, t: F.concat(F.lit("['"), x, F.lit("' '"), y, F.lit("']")), ", ", "."),
    (_HEAD, lambda x, y, t: F.concat(F.lit("[ "), x, F.lit(" "), y, F.lit(" ]")), ", ", "."), (_HEAD + "[", lambda x, y, t: F.concat(x, F.lit(" "), y), "; ", "]"),
    (_HEAD + "[", lambda x, y, t: F.concat(x, F.lit(" 99999"), F.replace(y, F.lit("-"), F.lit(""))), "; ", "]"), (_HEAD + "[", lambda x, y, t: F.concat(F.lit("("), F.replace(x, F.lit("."), F.lit(".  .")), F.lit(" , "), y, F.lit(")")), "; ", "]"),
    (_HEAD + "[", lambda x, y, t: F.when(t == 1, F.concat(x, F.lit(" "), y)).otherwise(F.lit("and")), "; ", "]"),
]
#: Traces: nested lists, nested tuples, numbers that don't decode, an odd number in plain words, one number alone.
_TRACES = [
    ("go [[", lambda x, y, t: F.concat(x, F.lit(", "), y), "], [", "]] end"), ("go ((", lambda x, y, t: F.concat(x, F.lit(", "), y), "), (", ")) end"), ("go [[", lambda x, y, t: F.concat(x, F.lit(".5, "), y), "], [", "]] end"),
    ("from 7 ", lambda x, y, t: F.concat(x, F.lit(" to "), y), " then ", "!"), ("only ", lambda x, y, t: F.when(t == 1, x).otherwise(F.lit("none")), " and ", "!"),
]

QUERIES = {
    "planning_l2_by_step": (lambda s, d: planning.l2_by_step(view(s, d, "gt"), view(s, d, "pred")), with_views(_ALIGNED + " SELECT t, n, missing, round(v, 6) AS l2 FROM l", "gt", "pred")),
    "planning_report_endpoint": (lambda s, d: _report(s, d, False), with_views(_ALIGNED + """, p AS (SELECT max(v) FILTER (t = 2) AS at_2, max(v) FILTER (t = 4) AS at_4, max(v) FILTER (t = 6) AS at_6 FROM l)
SELECT round(at_2, 6) AS at_2, round(at_4, 6) AS at_4, round(at_6, 6) AS at_6, round((at_2 + at_4 + at_6) / 3, 6) AS mean FROM p""", "gt", "pred")),
    "planning_report_cumulative": (lambda s, d: _report(s, d, True), with_views(_ALIGNED + """, p AS (SELECT avg(v) FILTER (t <= 2) AS at_2, avg(v) FILTER (t <= 4) AS at_4, avg(v) AS at_6 FROM l)
SELECT round(at_2, 6) AS at_2, round(at_4, 6) AS at_4, round(at_6, 6) AS at_6, round((at_2 + at_4 + at_6) / 3, 6) AS mean FROM p""", "gt", "pred")),
    "planning_collision_by_step": (lambda s, d: planning.collision_by_step(_hits(s, d)), with_views(_HITS + """ SELECT t, count(*) AS n, sum(gt_hit::INT) AS gt_hits, sum(point_hit::INT) AS point_hits, sum(box_hit::INT) AS box_hits,
  round(avg(point_hit::INT), 6) AS point_rate, round(avg(box_hit::INT), 6) AS box_rate FROM h GROUP BY t""", "gt", "pred", "cells")),
    "point_collision": (lambda s, d: _hits(s, d).where("point_hit").select("token", "t"), with_views(_HITS + " SELECT token, t FROM h WHERE point_hit", "gt", "pred", "cells")),
    "box_collision": (lambda s, d: _hits(s, d).where("box_hit").select("token", "t"), with_views(_HITS + " SELECT token, t FROM h WHERE box_hit", "gt", "pred", "cells")),
    "gt_first_collision": (lambda s, d: planning.first_collision(_hits(s, d), "gt_hit"), with_views(_HITS + " SELECT token, min(t) AS t FROM h WHERE gt_hit GROUP BY token", "gt", "pred", "cells")),
    "mean_trajectory": (lambda s, d: planning.mean_trajectory(view(s, d, "gt")), with_views("SELECT t, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM gt GROUP BY t", "gt")),
    "path_length": (lambda s, d: planning.path_length(view(s, d, "gt")), with_views(""", a AS (SELECT token, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM gt WINDOW w AS (PARTITION BY token ORDER BY t))
SELECT token, count(*) AS steps, round(sum(coalesce(sqrt(dx * dx + dy * dy), 0)), 6) AS length FROM a GROUP BY token""", "gt")),
    "padded_trajectories": (lambda s, d: planning.padded(view(s, d, "pred"), view(s, d, "gt")), with_views("SELECT gt.token, gt.t, coalesce(pred.x, 0) AS x, coalesce(pred.y, 0) AS y FROM gt LEFT JOIN pred ON pred.token = gt.token AND pred.t = gt.t", "gt", "pred")),
    "generated_texts": (lambda s, d: view(s, d, "generations"), with_views("SELECT * FROM generations", "generations")),
    "parse_robust_formats": (lambda s, d: _read(_written(s, d, _ROBUST), text.parse_robust), with_views("SELECT token, t, x, y FROM pred WHERE token % 7 IN (0, 3, 5) OR (token % 7 IN (1, 2) AND t = 1)", "pred")),
    "parse_trace_formats": (lambda s, d: _read(_written(s, d, _TRACES), text.parse_trace), with_views(""", n AS (SELECT token, 2 * t AS k, x AS v FROM pred UNION ALL SELECT token, 2 * t + 1, y FROM pred UNION ALL SELECT DISTINCT token, 1, 7 FROM pred)
SELECT token, t, x, y FROM pred WHERE token % 5 IN (0, 1) UNION ALL SELECT a.token, ((a.k + 1) // 2)::INT AS t, a.v AS x, b.v AS y FROM n a JOIN n b ON b.token = a.token AND b.k = a.k + 1 WHERE a.token % 5 = 3 AND a.k % 2 = 1""", "pred")),
    "parse_trajectory_text": (lambda s, d: _points(s, d, text.parse_trajectory), with_views(rf""", a AS (SELECT token, trim(split_part(generated_text, 'Planned Trajectory:', 2), ' ' || chr(10)) AS s FROM generations WHERE contains(generated_text, 'Planned Trajectory:')),
b AS (SELECT token, regexp_extract_all(regexp_extract(s, '(\[[\s\S]*?\])', 1), '{_NUM}') AS q, regexp_extract_all(regexp_extract(s, '(\([\s\S]*?\))', 1), '{_NUM}') AS r FROM a),
c AS (SELECT token, CASE WHEN len(q) >= 2 AND len(q) % 2 = 0 THEN q WHEN len(r) >= 2 AND len(r) % 2 = 0 THEN r END AS v FROM b),
d AS (SELECT token, v, unnest(generate_series(1, len(v) // 2)) AS t FROM c)
SELECT token, t::INT AS t, v[2 * t - 1]::DOUBLE AS x, v[2 * t]::DOUBLE AS y FROM d""", "generations")),
    "parse_trajectory_robust": (lambda s, d: _points(s, d, text.parse_robust), with_views(rf""", a AS (SELECT token, trim(split_part(generated_text, 'Planned Trajectory:', 2), ' ' || chr(10)) AS s FROM generations WHERE contains(generated_text, 'Planned Trajectory:')),
b AS (SELECT token, unnest([regexp_replace(regexp_extract(s, '(\[[\s\S]*?\])', 1), '(\d+)\.\s+\.(\d+)', '\1.\2', 'g'), regexp_replace(regexp_extract(s, '(\([\s\S]*?\))', 1), '(\d+)\.\s+\.(\d+)', '\1.\2', 'g')]) AS s, unnest([1, 2]) AS o FROM a),
c AS (SELECT token, o, CASE WHEN len(regexp_extract_all(s, '\(\s*({_NUM})\s*,\s*({_NUM})\s*\)')) > 0 THEN regexp_extract_all(s, '\(\s*({_NUM})\s*,\s*({_NUM})\s*\)')
  WHEN len(regexp_extract_all(s, '\[\s*({_NUM})\s*,\s*({_NUM})\s*\]')) > 0 THEN regexp_extract_all(s, '\[\s*({_NUM})\s*,\s*({_NUM})\s*\]') END AS v FROM b),
e AS (SELECT token, arg_min(v, o) AS v FROM c WHERE v IS NOT NULL GROUP BY token),
d AS (SELECT token, v, unnest(generate_series(1, len(v))) AS t FROM e)
SELECT token, t::INT AS t, regexp_extract_all(v[t], '{_NUM}')[1]::DOUBLE AS x, regexp_extract_all(v[t], '{_NUM}')[2]::DOUBLE AS y FROM d""", "generations")),
    "parse_trajectory_strict": (lambda s, d: _points(s, d, text.parse_strict), with_views(rf""", a AS (SELECT token, regexp_extract_all(regexp_extract(generated_text, '\[(.*?)\]', 1), '\(\s*{_NUM}\s*,\s*{_NUM}\s*\)') AS v FROM generations),
d AS (SELECT token, v, unnest(generate_series(1, 6)) AS t FROM a WHERE len(v) = 6)
SELECT token, t::INT AS t, regexp_extract_all(v[t], '{_NUM}')[1]::DOUBLE AS x, regexp_extract_all(v[t], '{_NUM}')[2]::DOUBLE AS y FROM d""", "generations")),
    "parse_trace": (lambda s, d: _points(s, d, text.parse_trace), with_views(rf""", a AS (SELECT token, generated_text AS s, regexp_extract(generated_text, '(\[\s*\[[\d\s,.-]+\]\s*(?:,\s*\[[\d\s,.-]+\]\s*)*\])', 1) AS q FROM generations),
b AS (SELECT token, regexp_extract_all(CASE WHEN q <> '' THEN q ELSE s END, '{_NUM}') AS v FROM a), d AS (SELECT token, v, unnest(generate_series(1, len(v) // 2)) AS t FROM b)
SELECT token, t::INT AS t, v[2 * t - 1]::DOUBLE AS x, v[2 * t]::DOUBLE AS y FROM d""", "generations")),
    "invalid_predictions": (lambda s, d: view(s, d, "generations").where(text.parse_trajectory(F.col("generated_text")).isNull()).select("token", "variant"), with_views(rf""", a AS (SELECT token, variant, trim(split_part(generated_text, 'Planned Trajectory:', 2), ' ' || chr(10)) AS s, contains(generated_text, 'Planned Trajectory:') AS m FROM generations),
b AS (SELECT token, variant, m, len(regexp_extract_all(regexp_extract(s, '(\[[\s\S]*?\])', 1), '{_NUM}')) AS q, len(regexp_extract_all(regexp_extract(s, '(\([\s\S]*?\))', 1), '{_NUM}')) AS r FROM a)
SELECT token, variant FROM b WHERE NOT m OR NOT ((q >= 2 AND q % 2 = 0) OR (r >= 2 AND r % 2 = 0))""", "generations")),
    "action_suffix": (lambda s, d: view(s, d, "generations").select("token", text.action_suffix(F.col("generated_text")).alias("action"), text.first_list(F.col("generated_text")).alias("plan"), text.action_suffix(F.col("generated_text"), compat=True).alias("compat")), with_views("""SELECT token,
  CASE WHEN strpos(generated_text, 'Planned Trajectory:') > 0 THEN substr(generated_text, strpos(generated_text, 'Planned Trajectory:')) END AS action,
  CASE WHEN strpos(generated_text, '[') > 0 AND strpos(generated_text, ']') > strpos(generated_text, '[') THEN substr(generated_text, strpos(generated_text, '['), strpos(generated_text, ']') - strpos(generated_text, '[') + 1) END AS plan,
  CASE WHEN strpos(generated_text, 'Planned Trajectory:') > 0 THEN substr(generated_text, strpos(generated_text, 'Planned Trajectory:')) ELSE right(generated_text, 1) END AS compat FROM generations""", "generations")),
    "planning_target_text": (lambda s, d: view(s, d, "gt").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("p")).select("token", text.planning_target(F.col("p")).alias("target")), with_views("""SELECT token,
  'Planned Trajectory:' || chr(10) || '[' || string_agg('(' || printf('%.2f', x) || ',' || printf('%.2f', y) || ')', ', ' ORDER BY t) || ']' AS target FROM gt GROUP BY token""", "gt")),
    "last_write_wins": (_last, with_views(rf""", rec AS (SELECT token, 0 AS line, generated_text AS g FROM generations UNION ALL SELECT token, 1, CASE WHEN token % 3 = 0 THEN 'broken' ELSE replace(generated_text, '(', '(1') END FROM generations),
a AS (SELECT token, line, regexp_extract_all(regexp_extract(g, '\[(.*?)\]', 1), '\(\s*{_NUM}\s*,\s*{_NUM}\s*\)') AS v FROM rec),
d AS (SELECT token, arg_max(v, line) AS v FROM a WHERE len(v) = 6 GROUP BY token), e AS (SELECT token, v, unnest(generate_series(1, 6)) AS t FROM d)
SELECT token, t::INT AS t, regexp_extract_all(v[t], '{_NUM}')[1]::DOUBLE AS x, regexp_extract_all(v[t], '{_NUM}')[2]::DOUBLE AS y FROM e""", "generations")),
}
