"""Planning-shaped views over the star-schema test tables, written once for Spark and DuckDB.

@h(s): the first 32 bits of md5(s) as a number; @div(a, b): whole division; @series(a, b): a row for each number; @joined(x, k): x joined by ', ' in order of k.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "gt": (("events",), """
SELECT token, t, ((event_id * 7) % 33 - 16) / cast(8 as double) AS x, cast(t as double) * 2 + ((event_id * 13) % 17) / cast(8 as double) AS y,
  CASE WHEN @h('m|' || event_id) % 10 = 0 THEN 0 ELSE 1 END AS mask, event_id
FROM (SELECT event_id, token, t, count(*) OVER (PARTITION BY token) AS k
  FROM (SELECT event_id, user_id * 100000 + @div(n - 1, 6) AS token, cast((n - 1) % 6 + 1 AS int) AS t
    FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) a) b) c WHERE k = 6"""),
    "pred": (("gt",), """
SELECT token, t, x + (@h('x|' || event_id) % 9 - 4) / cast(8 as double) AS x, y + (@h('y|' || event_id) % 9 - 4) / cast(8 as double) AS y FROM gt
WHERE @h('d|' || token) % 20 <> 0 AND NOT (t > 4 AND @h('s|' || token) % 15 = 0)"""),
    "generations": (("pred",), """
SELECT token, variant, CASE WHEN variant = 0 THEN 'no plan: [' || pairs || ']'
  WHEN variant = 1 THEN 'Thoughts: go.' || chr(10) || 'Planned Trajectory:' || chr(10) || '[' || pairs || ', (3.5]'
  WHEN variant = 2 THEN 'Planned Trajectory:' || chr(10) || '[' || replace(pairs, '.', '.  .') || ']'
  WHEN variant = 3 THEN 'Planned Trajectory:' || chr(10) || '[' || replace(replace(pairs, '(', '['), ')', ']') || ']'
  WHEN variant = 4 THEN 'Planned Trajectory:' || chr(10) || pairs
  ELSE 'Thoughts: keep the lane.' || chr(10) || 'Planned Trajectory:' || chr(10) || '[' || pairs || ']' || chr(10) || 'Done [1, 2]' END AS generated_text
FROM (SELECT token, @h('f|' || token) % 12 AS variant, @joined('(' || cast(x AS string) || ',' || cast(y AS string) || ')', t) AS pairs FROM pred GROUP BY token) a"""),
    "objects": (("lineitem",), """
SELECT token, ord, name, x, y, dx, dy, rot_z, vx FROM (SELECT l_orderkey AS token,
  cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS int) AS ord,
  CASE l_returnflag WHEN 'A' THEN 'car' WHEN 'N' THEN 'pedestrian' ELSE 'truck' END AS name,
  ((l_partkey * 3) % 201 - 100) / cast(4 as double) AS x, ((l_suppkey * 11 + l_linenumber * 17) % 201 - 100) / cast(4 as double) AS y,
  cast(1.5 as double) + (l_linenumber % 3) / cast(4 as double) AS dx, cast(4 as double) + (l_linenumber % 2) / cast(4 as double) AS dy,
  (l_partkey % 8) / cast(4 as double) AS rot_z, ((l_linenumber % 3) - 1) / cast(4 as double) AS vx FROM lineitem) o"""),
    "cells": (("gt",), """
SELECT DISTINCT token, cast(i % 6 + 1 AS int) AS t, cast(95 + @h('r|' || token || '|' || i) % 41 AS int) AS r, cast(92 + @h('c|' || token || '|' || i) % 17 AS int) AS c
FROM (SELECT token, @series(0, 41) AS i FROM (SELECT DISTINCT token FROM gt) a) b"""),
    "occ": (("gt",), """
SELECT token, t, r, c, max(p) AS p FROM (SELECT token, cast(i % 5 AS int) AS t, cast(95 + @h('r|' || token || '|' || i) % 41 AS int) AS r,
  cast(92 + @h('c|' || token || '|' || i) % 17 AS int) AS c, (@h('o|' || token || '|' || i) % 11) / cast(10 as double) AS p
  FROM (SELECT token, @series(0, 41) AS i FROM (SELECT DISTINCT token FROM gt) a) b) d GROUP BY token, t, r, c"""),
    "map_cells": (("gt",), """
SELECT DISTINCT token, cast(i % 4 AS int) AS layer, cast(@h('mr|' || token || '|' || i) % 200 AS int) AS r, cast(@h('mc|' || token || '|' || i) % 200 AS int) AS c
FROM (SELECT token, @series(0, 199) AS i FROM (SELECT DISTINCT token FROM gt) a) b"""),
    "lane_cells": (("map_cells",), """
SELECT token, layer, r, c, (@h('lp|' || token || '|' || layer || '|' || r || '|' || c) % 201) / cast(200 as double) AS p FROM map_cells WHERE layer < 3"""),
    "samples": (("conversations", "orders", "customer", "nation", "region"), """
SELECT u.conv_id, u.turn, u.text AS user_text, CASE u.conv_id % 3 WHEN 0 THEN 'RIGHT' WHEN 1 THEN 'LEFT' ELSE 'FORWARD' END AS goal, r.r_name AS location,
  CASE WHEN @h(u.conv_id || '|' || u.turn || '|0') % 2 = 1 THEN '<What is the mission goal?>' ELSE '' END || CASE WHEN @h(u.conv_id || '|' || u.turn || '|1') % 2 = 1 THEN '<What do you perceive in the scene?>' ELSE '' END ||
  CASE WHEN @h(u.conv_id || '|' || u.turn || '|2') % 2 = 1 THEN '<What is a similar past experience?>' ELSE '' END || CASE WHEN @h(u.conv_id || '|' || u.turn || '|3') % 2 = 1 THEN '<What are the collidable objects?>' ELSE '' END ||
  CASE WHEN @h(u.conv_id || '|' || u.turn || '|4') % 2 = 1 THEN '<What is the driving plan?>' ELSE '' END || CASE WHEN @h(u.conv_id || '|' || u.turn || '|5') % 2 = 1 THEN '<What are the notable objects?><What are the notable objects?>' ELSE '' END || a.text AS answer
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' AND u.role = 'user'
JOIN orders o ON o.o_orderkey = u.conv_id + 1 JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"""),
    "planner": (("samples",), """
SELECT conv_id * 1000 + turn AS id, 'Ego: ' || user_text || chr(10) || 'Mission Goal: ' || goal || chr(10) AS ego, '*****Perception Results:*****' || CASE WHEN conv_id % 4 = 0 THEN '' ELSE chr(10) || location END AS perception,
  chr(10) || '*****Traffic Rules:*****' AS commonsense, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE '*****Past Driving Experience for Reference:*****' || chr(10) || 'went ' || goal END AS experiences,
  'x' || chr(10) || 'Thoughts:' || CASE WHEN turn % 3 = 0 THEN ' ' ELSE ' objects near' END || chr(10) || 'Driving Plan:' || ' drive ' || goal AS chain_of_thoughts,
  'y' || chr(10) || 'Thoughts:' || ' saw ' || location || chr(10) || 'Driving Plan:' || ' go' AS reasoning, 'Planned Trajectory:' || chr(10) || '[(1.00,2.00)]' AS planning_target FROM samples"""),
    "media_rows": (("conversations",), """
SELECT conv_id, turn, role, repeat('<image>', cast(@h('i|' || conv_id || '|' || turn) % 3 AS int)) || ' ' || text || CASE WHEN @h('w|' || conv_id || '|' || turn) % 5 = 0 THEN ' <video> ' ELSE '' END AS text,
  cast(@h('n|' || conv_id || '|' || turn) % 3 AS int) AS n_images, cast(CASE WHEN @h('w|' || conv_id || '|' || turn) % 5 = 0 THEN 1 ELSE 0 END AS int) AS n_videos FROM conversations"""),
    "sizes": (("part",), """
SELECT p_partkey AS id, cast(p_size * 37 + p_partkey % 500 + 3 AS int) AS height, cast(p_size * 19 + (p_partkey * 7) % 1300 + 5 AS int) AS width, cast(p_partkey % 900 + 1 AS int) AS frames, cast(10 + p_partkey % 5 * 5 AS double) AS fps FROM part"""),
    "latents": (("documents",), """
SELECT doc_id, k, lp_post, lp_post + (@h('p|' || doc_id || '|' || k) % 81 - 40) / cast(8 as double) AS lp_prior
FROM (SELECT doc_id, k, -(@h('q|' || doc_id || '|' || k) % 4000) / cast(8 as double) AS lp_post FROM (SELECT doc_id, @series(0, 7) AS k FROM documents) a) b"""),
    "mcq": (("documents", "labels"), """
SELECT d.doc_id, d.lang AS split, 'red ' || d.lang AS a, 'green ' || d.lang AS b, 'blue ' || d.lang AS c, 'grey ' || d.lang AS d,
  CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'A' WHEN l.quality = 1 THEN 'B' WHEN l.toxic = 1 THEN 'C' ELSE 'D' END AS answer,
  CASE @h('v|' || d.doc_id) % 7 WHEN 0 THEN 'B' WHEN 1 THEN 'The answer is (B).' WHEN 2 THEN 'I think it is Green ' || d.lang WHEN 3 THEN 'Cannot determine the answer'
    WHEN 4 THEN 'A or B' WHEN 5 THEN 'A red thing on the road' ELSE '' END AS prediction
FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""),
}


def dialect(text: str, duckdb: bool) -> str:
    text = re.sub(r"@h\(([^)]*)\)", r"('0x' || substr(md5(\1), 1, 8))::BIGINT" if duckdb else r"cast(conv(substr(md5(\1), 1, 8), 16, 10) AS bigint)", text)
    text = re.sub(r"@div\(([^,]+), ([^)]+)\)", r"((\1) // (\2))" if duckdb else r"((\1) div (\2))", text)
    text = re.sub(r"@series\((\d+), (\d+)\)", r"unnest(generate_series(\1, \2))" if duckdb else r"explode(sequence(\1, \2))", text)
    text = re.sub(r"@joined\((.*), (\w+)\)", r"string_agg(\1, ', ' ORDER BY \2)" if duckdb else r"listagg(\1, ', ') WITHIN GROUP (ORDER BY \2)", text)
    return text.replace("AS string)", "AS varchar)") if duckdb else text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, text = VIEWS[name]
    frames = {n: view(spark, sf_dir, n) for n in needs}
    text = dialect(text, False)
    for n in needs:
        text = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
    return spark.sql(text, **frames)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the views it names as common table expressions; further ``WITH`` parts follow by a leading comma."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in VIEWS and n not in order:
            for m in VIEWS[n][0]:
                add(m)
            order.append(n)

    for n in names:
        add(n)
    sql = dialect(sql, True)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({dialect(VIEWS[n][1], True)})" for n in order) + ("" if sql.lstrip().startswith(",") else "\n") + sql
