"""Queries on records in text, sequences for training, samples of data sets, and tools."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corridor.functions import formats, keyed, trajectory_text
from corridor.operators import choices, conversations, driving, links, packing, spatial, text_records, tools
from corridor.sources import files
from corridor.sources.fixtures import view, with_views

_NO_VIEWS = "WITH RECURSIVE \n"
_IDS = """WITH n AS (SELECT doc_id, doc_id % 9 + 3 AS n FROM documents), p AS (SELECT doc_id, n, i, i // (n + 2) AS part, i % (n + 2) AS j FROM n, generate_series(0, 40) g(i) WHERE i < 3 * n + 4),
x AS (SELECT doc_id, n, i, CASE WHEN part < 2 AND j = n THEN CASE part WHEN 0 THEN 77091 ELSE 151645 END WHEN part < 2 AND j = n + 1 THEN 198 ELSE (doc_id * 31 + (j + 1) * 7 + part + 1) % 1000 END AS id FROM p),
l AS (SELECT *, CASE WHEN i >= n + 2 AND i < 2 * n + 4 THEN id ELSE -100 END AS label FROM x)"""


def _prompts(s, d):
    return spatial.prompt(spatial.surrounding(view(s, d, "objects")), *formats.OBJECTS["surrounding"]).withColumn("prompt", F.concat("prompt", F.lit("\nObject detected, object type: car, object id: 99, position: (1.00, 1.00), size: (1.00, 1.00)")))


def _ids(s, d):
    """Token ids made of documents: a start token, a kind, some words, an end token, and so on."""
    n = F.pmod(F.col("doc_id"), F.lit(9)) + 3
    body = lambda k: F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.pmod(F.col("doc_id") * 31 + i * 7 + k, F.lit(1000)))
    return view(s, d, "documents").select("doc_id", F.concat(body(1), F.array(F.lit(77091), F.lit(198)).cast("array<long>"), body(2), F.array(F.lit(151645), F.lit(198)).cast("array<long>"), body(3)).alias("ids"))


def _kinds(s, d):
    n = F.pmod(F.col("doc_id"), F.lit(4)).cast("int") + 1
    kinds = F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), 6), F.array_repeat(F.lit(0), 2))
    return view(s, d, "documents").select("doc_id", kinds.alias("kinds"), F.array(F.array(F.lit(1), F.lit(4), F.lit(6))).alias("grids"))


def _fenced(s, d):
    k = F.col("p_partkey")
    json = F.concat(F.lit('[{"bbox_3d": ['), (k % 50).cast("string"), F.lit(', 1, 2, 3, 4, 5, 6, 7, 8], "label": "part '), k.cast("string"), F.lit('"}, {"bbox_3d": [1, 1, 1, 1, 1, 1, 1, 1, 1], "label": "b"}]'))
    return view(s, d, "part").select("p_partkey", F.when(k % 3 == 0, F.concat(F.lit("see\n```json\n"), json, F.lit("\n```"))).when(k % 3 == 1, F.concat(F.lit("boxes: "), json, F.lit(" end"))).otherwise("nothing [ here").alias("text"))


def _mix(s, d):
    known = {n: {"annotation_path": f"{d}/{n}.parquet", "data_path": f"/data/{n}"} for n in ("documents", "conversations")}
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("text", T.StringType())])
    return files.registry(s, "documents%30,conversations", known, schema, "text").select("data_path", F.md5("text").alias("text"))


def _links(s, d):
    own = view(s, d, "events")
    return own.select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))


_STATES = (("vx", 5, 0.5), ("vy", 9, 0.5), ("v_yaw", 3, 1), ("ax", 4, 1), ("ay", 7, 1), ("cx", 6, 1), ("cy", 8, 1), ("v_head", 11, 0.5), ("steering", 13, 1))


def _ego_prompts(s, d):
    k = F.col("o_orderkey")
    states = {n: (k % m - 2) / F.lit(4.0) for n, m, _ in _STATES}
    history = [(F.lit(-i / 4), F.lit(i * -0.5)) for i in range(5)]
    return view(s, d, "orders").select(k.alias("token"), driving.ego_prompt(states, history, driving.goal((k % 3 == 0).cast("int"), (k % 3 == 1).cast("int"))).alias("prompt"))


def _spread(s, d):
    """Two frames of 2 x 3 tokens, 1.5 seconds apart, between texts."""
    n = F.pmod(F.col("doc_id"), F.lit(4)).cast("int") + 1
    kinds = F.concat(F.array_repeat(F.lit(0), n), F.array_repeat(F.lit(1), 12), F.array_repeat(F.lit(0), 2))
    return view(s, d, "documents").select("doc_id", kinds.alias("kinds"), F.array(F.array(F.lit(2), F.lit(4), F.lit(6))).alias("grids"), F.array(F.lit(1.5)).alias("seconds"))


def _positions(time, after):
    """SQL of two frames' positions: the time of frame f, and how far what follows lies behind."""
    return f"WITH k AS (SELECT doc_id AS key, doc_id % 4 + 1 AS n FROM documents), p AS (SELECT key, n, i, (i - n) // 6 AS f, (i - n) % 6 AS j FROM k, generate_series(0, 18) g(i) WHERE i < n + 14) SELECT key, i::INT AS place, CASE WHEN i < n THEN i WHEN i < n + 12 THEN n + {time} ELSE i - 12 + {after} END AS t, CASE WHEN i < n THEN i WHEN i < n + 12 THEN n + j // 3 ELSE i - 12 + {after} END AS h, CASE WHEN i < n THEN i WHEN i < n + 12 THEN n + j % 3 ELSE i - 12 + {after} END AS w FROM p"


def _texts_with_futures(s, d):
    """Prompts of objects, then of some objects' futures, then lines of another section."""
    header, lead, span = formats.TRAJECTORIES["ids"]
    full, first = formats.OBJECTS["all"]
    found = spatial.listed(view(s, d, "objects"), prompt=(full, spatial.object_lines(first), None), futures=(header, spatial.moving_lines(lead, span), F.col("ord").isin(0, 2, 5)))
    text = F.concat("prompt", F.lit("\n"), F.coalesce("futures", F.lit("")), F.lit("<next>\nobject id: 9, future waypoint coordinates in 3s: [(1.00, 1.00)]"))
    return found.select("token", text.alias("text"))


def _sensor(s, d):
    """Rows of lineitem as samples: their calibrated sensor (supplier) and its sensor (nation), and the pose (part) beside."""
    rows = view(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    found = spatial.chain(rows, (view(s, d, "supplier"), "l_suppkey", "s_suppkey"), (view(s, d, "nation"), "s_nationkey", "n_nationkey"), (view(s, d, "part"), "l_partkey", "p_partkey"))
    return found.select("l_orderkey", "l_linenumber", "n_name", "p_name")


def _frames(s, d):
    return {"scenes": view(s, d, "objects").select("token"), "objects": view(s, d, "objects"), "waypoints": spatial.waypoints(view(s, d, "objects"))}


_CALLS = [("get_leading_object_detection", {}), ("get_no_such_thing", {}), ("get_object_detections_in_range", {"x_start": -20, "x_end": 20, "y_start": 0, "y_end": 10}), ("get_object_detections_in_range", {"x_start": -200, "x_end": 20, "y_start": 0, "y_end": 10})]
_BINS = """WITH RECURSIVE i AS (SELECT doc_id AS key, n_chars // 4 AS size, doc_id // 256 AS batch_id, row_number() OVER (PARTITION BY doc_id // 256 ORDER BY n_chars // 4 DESC, doc_id) AS k FROM documents),
s AS (SELECT batch_id, 0::BIGINT AS k, []::BIGINT[] AS room, NULL::BIGINT AS bin FROM (SELECT DISTINCT batch_id FROM i) UNION ALL
  SELECT batch_id, k, CASE WHEN b IS NULL THEN list_append(room, 4096 - size) ELSE list_concat(room[:b - 1], list_concat([room[b] - size], room[b + 1:])) END, coalesce(b, len(room) + 1) - 1
  FROM (SELECT s.batch_id, i.k, s.room, i.size, list_position(s.room, list_min(list_filter(s.room, lambda r: r >= i.size))) AS b FROM s JOIN i ON i.batch_id = s.batch_id AND i.k = s.k + 1) x)
SELECT i.key, i.size, i.batch_id, s.bin FROM i JOIN s ON s.batch_id = i.batch_id AND s.k = i.k"""


QUERIES = {
    "future_waypoint_records": ((lambda s, d: text_records.future_waypoints(_texts_with_futures(s, d), "text", "token").select("token", "ord", F.size("waypoints").alias("n"), F.get("waypoints", 0)["x"].alias("x"), F.element_at("waypoints", -1)["y"].alias("y"))), with_views("SELECT token, ord, 6 AS n, printf('%.2f', (x + vx)::DOUBLE)::DOUBLE AS x, printf('%.2f', (y + 3)::DOUBLE)::DOUBLE AS y FROM objects WHERE ord IN (0, 2, 5)", "objects")),
    "first_code": ((lambda s, d: view(s, d, "part").select("p_partkey", trajectory_text.first_code(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("so `"), F.col("p_brand"), F.lit("` and\n```json\n[1]\n```"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("see\n```json\n"), F.col("p_name"), F.lit("\n```\n`x`"))).otherwise("none")).alias("code"))), "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_name || chr(10) END AS code FROM part"),
    "sensor_chain": (_sensor, "SELECT l_orderkey, l_linenumber, n_name, p_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey"),
    "ordered_documents": ((lambda s, d: view(s, d, "documents").select("doc_id", "lang").orderBy("doc_id")), "SELECT doc_id, lang FROM documents ORDER BY doc_id"),
    "first_documents": ((lambda s, d: view(s, d, "documents").select("doc_id", "lang").orderBy("doc_id").limit(100)), "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100"),
    "rope_index_seconds": ((lambda s, d: packing.rope_index(_spread(s, d), "doc_id", seconds="seconds")), _positions("3 * f", 4)),
    "rope_index_frames": ((lambda s, d: packing.rope_index(_spread(s, d), "doc_id", split_frames=True)), _positions("0", 3)),
    "tool_texts": ((lambda s, d: tools.rerun(_CALLS, _frames(s, d))), with_views("SELECT token, " + " || ".join(f"CASE WHEN bool_or({c}) THEN '{formats.OBJECTS_IN_RANGE[0].format(-20, 20, 0, 10).strip() if k else formats.OBJECTS['leading'][0].strip()}' || chr(10) || string_agg('{lead}, object type: ' || name || ', object id: ' || ord || ', position: (' || printf('%.2f', x) || ', ' || printf('%.2f', y) || '), size: (' || printf('%.2f', dx) || ', ' || printf('%.2f', dy) || ')' || chr(10), '' ORDER BY ord) FILTER ({c}) ELSE '' END" for k, (c, lead) in enumerate((("abs(x) < 3 AND y >= 0 AND y < 10", "Leading object detected"), ("x BETWEEN -20 AND 20 AND y BETWEEN 0 AND 10", "Object detected")))) + " AS text FROM objects GROUP BY token", "objects")),
    "scene_link_walk": ((lambda s, d: links.walk(_links(s, d), "event_id", "next")), "SELECT event_id, first_value(event_id) OVER w AS start, row_number() OVER w AS place FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "ego_prompts": (_ego_prompts, "WITH v AS (SELECT o_orderkey AS k, " + ", ".join(f"printf('%.2f', (o_orderkey % {m} - 2) / 4 * {f}::DOUBLE) AS {n}" for n, m, f in _STATES) + """ FROM orders)
SELECT k AS token, '*****Ego States:*****' || chr(10) || 'Current State:' || chr(10) || ' - Velocity (vx,vy): (' || vx || ',' || vy || ')' || chr(10) || ' - Heading Angular Velocity (v_yaw): (' || v_yaw || ')' || chr(10) || ' - Acceleration (ax,ay): (' || ax || ',' || ay || ')' || chr(10) || ' - Can Bus: (' || cx || ',' || cy || ')' || chr(10)
  || ' - Heading Speed: (' || v_head || ')' || chr(10) || ' - Steering: (' || steering || ')' || chr(10) || 'Historical Trajectory (last 2 seconds): [' || list_aggregate(list_transform([0, 1, 2, 3], lambda i: '(' || printf('%.2f', -i / 4.0::DOUBLE) || ',' || printf('%.2f', i * -0.5::DOUBLE) || ')'), 'string_agg', ', ') || ']' || chr(10) || 'Mission Goal: ' || CASE k % 3 WHEN 0 THEN 'RIGHT' WHEN 1 THEN 'LEFT' ELSE 'FORWARD' END || chr(10) AS prompt FROM v"""),
    "accelerations": ((lambda s, d: driving.accelerations(view(s, d, "gt"))), with_views(", a AS (SELECT token, t, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM gt WINDOW w AS (PARTITION BY token ORDER BY t)), b AS (SELECT token, t, dx - lag(dx) OVER w AS ax, dy - lag(dy) OVER w AS ay FROM a WINDOW w AS (PARTITION BY token ORDER BY t)) SELECT token, ax, ay FROM b WHERE t = 6", "gt")),
    "vision_elements": ((lambda s, d: view(s, d, "media_rows").select("conv_id", "turn", F.size(conversations.vision_elements(F.array(F.struct(F.lit("text").alias("type"), F.when(F.col("n_images") > 0, "i").alias("image"), F.lit(None).cast("string").alias("video")), F.struct(F.when(F.col("n_videos") > 0, "video").otherwise("text").alias("type"), F.lit(None).cast("string").alias("image"), F.lit(None).cast("string").alias("video"))))).alias("n"))), with_views("SELECT conv_id, turn, ((n_images > 0)::INT + (n_videos > 0)::INT)::INT AS n FROM media_rows", "media_rows")),
    "packed_estimates": ((lambda s, d: view(s, d, "media_rows").select("conv_id", "turn", conversations.packed_estimate(F.col("text"), F.lit(2), F.col("n_images") * 64).alias("tokens"))), with_views("SELECT conv_id, turn, (31 + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) + n_images * 64)::INT AS tokens FROM media_rows", "media_rows")),
    "plain_names": ((lambda s, d: conversations.plain_names(view(s, d, "part").select(F.col("p_partkey").alias("Index"), F.col("p_name").alias("A"), F.col("p_brand").alias("Answer")))), "SELECT p_partkey AS index, p_name AS A, p_brand AS answer FROM part"),
    "front_object_records": ((lambda s, d: text_records.front_objects(_prompts(s, d), "prompt", "token")), with_views("SELECT token, ord, name, printf('%.2f', x::DOUBLE)::DOUBLE AS x, printf('%.2f', y::DOUBLE)::DOUBLE AS y, printf('%.2f', dx::DOUBLE)::DOUBLE AS dx, printf('%.2f', dy::DOUBLE)::DOUBLE AS dy FROM objects WHERE abs(x) < 20 AND abs(y) < 20", "objects")),
    "objects_with_waypoints": ((lambda s, d: text_records.with_waypoints(spatial.front(view(s, d, "objects")).select("token", "ord"), spatial.waypoints(view(s, d, "objects")).where("t = 6 AND y > 0").select("token", "ord", "x", "y"), "token")), with_views(", w AS (SELECT token, ord, x + 6 * vx AS x, y + 3 AS y FROM objects) SELECT o.token, o.ord, w.x, w.y FROM objects o LEFT JOIN w ON w.token = o.token AND w.ord = o.ord AND w.y > 0 WHERE abs(o.x) < 5 AND o.y >= 0 AND o.y < 20", "objects")),
    "boxes_from_text": ((lambda s, d: text_records.boxes_3d(_fenced(s, d), "text", "p_partkey").select("p_partkey", "place", "label", F.get("box", 0).alias("x"), F.size("box").alias("n"))), "SELECT p_partkey, k::INT AS place, CASE k WHEN 0 THEN 'part ' || p_partkey ELSE 'b' END AS label, CASE k WHEN 0 THEN p_partkey % 50 ELSE 1 END::DOUBLE AS x, 9 AS n FROM part, generate_series(0, 1) g(k) WHERE p_partkey % 3 <> 2"),
    "boxed_answers": ((lambda s, d: view(s, d, "part").select("p_partkey", trajectory_text.boxed_answer(F.concat(F.lit("so \\boxed{1} or \\boxed{a_{"), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "}} done").otherwise("} open"))).alias("answer"))), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a_{' || p_size || '}' END AS answer FROM part"),
    "code_blocks": ((lambda s, d: view(s, d, "part").select("p_partkey", trajectory_text.last_code_block(F.concat(F.lit("```python\nx = 1\n```\ntext\n```html\n<p>"), F.col("p_name"), F.lit("</p>\n```"))).alias("code"))), "SELECT p_partkey, '<p>' || p_name || '</p>' AS code FROM part"),
    "labelled_points": ((lambda s, d: view(s, d, "part").select("p_partkey", F.posexplode(trajectory_text.labelled_points(F.concat(F.lit('```json\n[{"point_2d": ['), F.col("p_size").cast("string"), F.lit(', 2]}, {"point_2d": [3, 4], "label": "end"}]\n```')))).alias("k", "p")).select("p_partkey", "k", F.get("p.point", 0).alias("x"), F.col("p.label").alias("label"))), "SELECT p_partkey, k::INT AS k, CASE k WHEN 0 THEN p_size ELSE 3 END::DOUBLE AS x, CASE k WHEN 0 THEN 'point_1' ELSE 'end' END AS label FROM part, generate_series(0, 1) g(k)"),
    "result_times": ((lambda s, d: text_records.matched_times(view(s, d, "events").select("user_id", (F.col("event_id") % 10).alias("time"), F.col("event_type").alias("result"), F.col("event_id").alias("place")), view(s, d, "events").select("user_id", F.concat(F.lit("at "), (F.col("event_id") / 50 % 10).cast("int").cast("string")).alias("content")).distinct(), "user_id")), "WITH c AS (SELECT DISTINCT user_id, 'at ' || (event_id // 50 % 10) AS content FROM events) SELECT c.user_id, c.content, arg_max(e.event_type, e.event_id) AS result FROM c JOIN events e ON e.user_id = c.user_id AND contains(c.content, (e.event_id % 10)::VARCHAR) GROUP BY c.user_id, c.content"),
    "per_embodiment": ((lambda s, d: text_records.per_embodiment(view(s, d, "part").select("p_partkey", F.split("p_type", " ").alias("embodiment")), "embodiment")), "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS embodiment FROM part"),
    "stripped_marks": ((lambda s, d: view(s, d, "part").select("p_partkey", conversations.without_marks(F.concat(F.lit("<ref>"), F.col("p_name"), F.lit("</ref><box>(1,2)</box> ok"))).alias("text"))), "SELECT p_partkey, p_name || ' ok' AS text FROM part"),
    "list_fields": ((lambda s, d: view(s, d, "part").select("p_partkey", F.explode(choices.as_list(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('["'), F.col("p_brand"), F.lit('", "x"]'))).otherwise(F.col("p_brand")))).alias("item"))), "SELECT p_partkey, p_brand AS item FROM part UNION ALL SELECT p_partkey, 'x' FROM part WHERE p_partkey % 2 = 0"),
    "interleaved_media": ((lambda s, d: view(s, d, "part").select("p_partkey", F.posexplode(choices.interleaved(F.concat(F.lit("see <image 1> and <image 2> of "), F.col("p_name")))).alias("k", "p")).select("p_partkey", "k", "p.kind", "p.value")), "SELECT p_partkey, k::INT AS k, CASE k % 2 WHEN 0 THEN 'text' ELSE 'image' END AS kind, CASE k WHEN 0 THEN 'see ' WHEN 1 THEN '1' WHEN 2 THEN ' and ' WHEN 3 THEN '2' ELSE ' of ' || p_name END AS value FROM part, generate_series(0, 4) g(k)"),
    "code_prompts": ((lambda s, d: view(s, d, "part").select("p_partkey", choices.code_prompt(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "def f():").otherwise(""), F.col("p_partkey") % 3 == 0).alias("prompt"))), "SELECT p_partkey, chr(10) || 'QUESTION:' || chr(10) || p_name || chr(10) || CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN 'Please write your code using Call-Based format.' ELSE 'Please write your code using Standard IO, i.e. input() and print().' END || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'The starter code is provided as below. Please finish the code.' || chr(10) || 'def f():' || chr(10) ELSE '' END || chr(10) || 'ANSWER:' || chr(10) AS prompt FROM part"),
    "dataset_mix_sampled": (_mix, with_views("SELECT '/data/documents' AS data_path, md5(text) AS text FROM (SELECT text FROM documents QUALIFY row_number() OVER (ORDER BY @h('42|' || text), text) <= floor(0.3 * count(*) OVER ())) UNION ALL SELECT '/data/conversations', md5(text) FROM conversations").replace("WITH RECURSIVE \n", "")),
    "back_references": ((lambda s, d: files.resolved_images(view(s, d, "part").select(F.col("p_partkey").cast("string").alias("index"), F.when(F.col("p_partkey") % 4 == 0, F.repeat("p_name", 20)).otherwise((F.col("p_partkey") - F.col("p_partkey") % 4).cast("string")).alias("image"))).select("index", F.length("image").alias("n"))), "WITH p AS (SELECT p_partkey::VARCHAR AS index, CASE WHEN p_partkey % 4 = 0 THEN repeat(p_name, 20) ELSE (p_partkey - p_partkey % 4)::VARCHAR END AS image FROM part) SELECT a.index, length(CASE WHEN length(a.image) <= 64 THEN b.image ELSE a.image END)::INT AS n FROM p a LEFT JOIN p b ON length(a.image) <= 64 AND b.index = a.image"),
    "tool_calls": ((lambda s, d: tools.call("get_object_detections_in_range", {"objects": view(s, d, "objects")}, x_start=-20, x_end=20, y_start=0, y_end=10).groupBy("name").agg(F.count("*").alias("n"))), with_views("SELECT name, count(*) AS n FROM objects WHERE x BETWEEN -20 AND 20 AND y BETWEEN 0 AND 10 GROUP BY name", "objects")),
    "split_valid_problem": ((lambda s, d: conversations.media_check(view(s, d, "media_rows")).groupBy(F.col("problem").isNull().alias("valid")).agg(F.count("*").alias("n"))), with_views(""", ck AS (SELECT *, (length(text) - length(replace(text, '<image>', ''))) // 7 AS images, (length(text) - length(replace(text, '<video>', ''))) // 7 AS videos FROM media_rows)
SELECT NOT ((role IN ('gpt', 'assistant') AND (images > 0 OR videos > 0)) OR images <> n_images OR videos <> n_videos) AS valid, count(*) AS n FROM ck GROUP BY 1""", "media_rows")),
    "pack_bins": ((lambda s, d: packing.pack_bins(view(s, d, "documents").select("doc_id", (F.col("n_chars") / 4).cast("long").alias("n")), "doc_id", "n")), _BINS),
    "label_mask": ((lambda s, d: packing.label_masks(_ids(s, d), "ids", "doc_id").select("doc_id", F.posexplode(F.arrays_zip("ids", "labels")).alias("place", "x")).select("doc_id", "place", F.col("x.ids").alias("id"), F.col("x.labels").alias("label"))), _IDS + " SELECT doc_id, i::INT AS place, id, label FROM l"),
    "rope_index": ((lambda s, d: packing.rope_index(_kinds(s, d), "doc_id")), "WITH k AS (SELECT doc_id AS key, doc_id % 4 + 1 AS n FROM documents), p AS (SELECT key, n, i FROM k, generate_series(0, 12) g(i) WHERE i < n + 8) SELECT key, i::INT AS place, CASE WHEN i < n THEN i WHEN i < n + 6 THEN n ELSE i - 3 END AS t, CASE WHEN i < n THEN i WHEN i < n + 6 THEN n + (i - n) // 3 ELSE i - 3 END AS h, CASE WHEN i < n THEN i WHEN i < n + 6 THEN n + (i - n) % 3 ELSE i - 3 END AS w FROM p"),
    "collated_batch": ((lambda s, d: packing.collate(packing.label_masks(_ids(s, d), "ids", "doc_id").withColumn("b", F.floor(F.col("doc_id") / 8)), "b", "doc_id", 24).select("doc_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("input_ids", "labels", "attention")])), _IDS + ", f AS (SELECT doc_id, i, id, label FROM l WHERE i < 24 UNION ALL SELECT n.doc_id, g.i, NULL, NULL FROM n, generate_series(0, 23) g(i) WHERE g.i >= 3 * n + 4) SELECT doc_id, string_agg(coalesce(id, 0), ',' ORDER BY i) AS input_ids, string_agg(coalesce(label, -100), ',' ORDER BY i) AS labels, string_agg((id IS NOT NULL)::INT, ',' ORDER BY i) AS attention FROM f GROUP BY doc_id"),
    "flattened_pack": ((lambda s, d: packing.flattened(_ids(s, d).withColumn("b", F.floor(F.col("doc_id") / 8)), "b", "doc_id").select("b", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("ids", "ends")])), _IDS + ", e AS (SELECT doc_id // 8 AS b, doc_id, sum(3 * n + 4) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id)::INT AS e FROM n), j AS (SELECT b, '0,' || string_agg(e, ',' ORDER BY doc_id) AS ends FROM e GROUP BY b) SELECT b, string_agg(id, ',' ORDER BY doc_id, i) AS ids, any_value(j.ends) AS ends FROM l JOIN j ON j.b = l.doc_id // 8 GROUP BY b"),
    "collision_refine": ((lambda s, d: packing.refine_paths(view(s, d, "pred"), view(s, d, "occ")).select("token", "t", "cells", (F.col("slope") < 1e-6).alias("at_rest"))), with_views(", o AS (SELECT token, t, r, c FROM occ WHERE p > 0.1 AND t > 0), q AS (SELECT p.token, p.t, o.r FROM pred p JOIN o ON o.token = p.token AND o.t = least(p.t, 4) AND (p.x + 50 - (o.c + 0.5) * 0.5::DOUBLE) ** 2 + (p.y + 50 - (o.r + 0.5) * 0.5::DOUBLE) ** 2 < 25), k AS (SELECT token, t, count(*) AS n FROM q GROUP BY token, t) SELECT p.token, p.t, coalesce(k.n, 0)::INT AS cells, true AS at_rest FROM pred p LEFT JOIN k ON k.token = p.token AND k.t = p.t", "pred", "occ")),
}
