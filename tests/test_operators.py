"""Hand-computed results, properties, and what each operator does with empty and odd input."""

import json
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corridor.functions import keyed, media, trajectory_text
from corridor.operators import choices, conversations, driving, experience, links, map_text, packing, planning, reasoning, refine, spatial, text_records, tools
from corridor.sources import files
from corridor.streaming import generations


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(x, y, dx, dy, angle=0.0):
    return spatial.corners(*[F.lit(float(v)) for v in (x, y, dx, dy, angle)])


def test_boxes(spark):
    a, apart, over = box(2.5, 2.5, 5, 5), box(7, 7, 2, 2), box(5, 5, 2, 2)
    zero = F.lit(0.0)
    assert not value(spark, spatial.overlap(a, apart, zero, zero))
    assert value(spark, spatial.overlap(a, over, zero, zero))
    assert not value(spark, spatial.overlap(a, box(6, 2.5, 2, 2), zero, zero))  # touching
    assert value(spark, spatial.box_distance(a, apart)) == pytest.approx(math.sqrt(2))
    assert value(spark, spatial.segment_distance(*[F.lit(float(v)) for v in (3, 4, 0, 0, 0, 0)])) == 5


def test_raster(spark):
    rows = spatial.quantised(spark.createDataFrame([(10.0, 10.0), (-50.6, 0.0), (51.0, 0.0)], "x double, y double")).collect()
    assert [(r.px, r.py, r.valid) for r in rows] == [(120, 120, True), (0, 100, True), (202, 100, False)]
    assert len(planning.footprint()) == 32


def test_collision_by_plain_loops(spark):
    rng = np.random.default_rng(1)
    pts = [(1, t, float(x), float(y)) for t, (x, y) in enumerate(rng.uniform(-3, 10, (6, 2)), 1)]
    cells = [(1, int(t), int(r), int(c)) for t, r, c in zip(rng.integers(1, 7, 60), rng.integers(90, 125, 60), rng.integers(90, 125, 60), strict=True)]
    got = {r.t: r.hit for r in planning.hits(spark.createDataFrame(pts, "token int, t int, x double, y double"), "x", "y", spark.createDataFrame(cells, "token int, t int, r int, c int"), "hit").collect()}
    taken = {(t, r, c) for _, t, r, c in cells}
    for _, t, x, y in pts:
        assert got[t] == any((t, int(y / 0.5 + r), int(x / 0.5 + c)) in taken for r in range(97, 105) for c in range(98, 102))


def test_sizes(spark):
    got = [value(spark, media.box_per_mille(F.lit(float(x)), F.lit(side))) for x, side in ((146, 640), (137, 428), (615, 640), (415, 428))]
    assert got == [228, 320, 961, 970]
    assert value(spark, media.smart_resize(F.lit(1), F.lit(500))) is None
    assert value(spark, media.frame_range(F.lit(10), F.lit(5.0), F.lit(3.0), F.lit(1.0))) is None


@pytest.mark.parametrize(
    ("text", "plain", "robust"),
    [
        ("Planned Trajectory:\n[(1,2), (3.5,-4)]", [(1, 2), (3.5, -4)], [(1, 2), (3.5, -4)]),
        ("Planned Trajectory: [[1,2],[3,4]]", [(1, 2)], [(1, 2)]),
        ("Planned Trajectory: [(11.  .6, 1)]", None, [(11.6, 1)]),
        ("no plan [(1,2)]", None, None),
        ("Planned Trajectory: nothing", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_parsers(spark, text, plain, robust):
    row = spark.createDataFrame([(text,)], "t string").select(trajectory_text.parse_trajectory(F.col("t")).alias("a"), trajectory_text.parse_robust(F.col("t")).alias("b")).first()
    tuples = lambda v: None if v is None else [(p.x, p.y) for p in v]
    assert tuples(row.b) == robust
    assert plain is None or tuples(row.a) == plain


def test_trace_and_boxed(spark):
    assert [tuple(p) for p in value(spark, trajectory_text.parse_trace(F.lit("go 1 2 3")))] == [(1.0, 2.0)]
    assert [tuple(p) for p in value(spark, trajectory_text.parse_trace(F.lit("x [[1, 2], [3, 4]]")))] == [(1.0, 2.0), (3.0, 4.0)]
    assert value(spark, trajectory_text.boxed_answer(F.lit("\\boxed{a}{b} \\boxed{x^{2}} end"))) == "x^{2}"
    assert value(spark, trajectory_text.boxed_answer(F.lit("none"))) is None


def test_choices(spark):
    opts = F.create_map(*[F.lit(x) for x in ("A", "red", "B", "green", "C", "blue")])
    cases = {"B": "B", "The answer is (C).": "C", "A dog on the road": None, "it is GREEN": "B", "A B": None, "Cannot determine the answer": "Z", "": None, "Z": "Z"}
    for text, want in cases.items():
        assert value(spark, choices.infer(F.lit(text), opts)) == want, text
    assert value(spark, choices.same_output(F.lit("1.0000001 2"), F.lit("1 2")))
    assert not value(spark, choices.same_output(F.lit("1 3"), F.lit("1 2")))


def test_softmax_and_resample(spark):
    rows = spark.createDataFrame([(d, k, -float(k), float(d * k % 5)) for d in range(20) for k in range(8)], "d int, k int, lp_post double, lp_prior double")
    weighted = refine.weights(rows, "d")
    assert all(abs(r.s - 1) < 1e-12 for r in weighted.groupBy("d").agg(F.sum("weight").alias("s")).collect())
    once, again = (sorted(map(tuple, refine.resample(weighted, "d", 3, "1").collect())) for _ in range(2))
    assert once == again and len(once) == 60


def test_matrix_is_symmetric(spark):
    rows = spark.createDataFrame([("".join(m for k, m in enumerate(reasoning.MARKERS) if i >> k & 1),) for i in range(64)], "text string")
    cells = {(r.a, r.b): r.n for r in reasoning.matrix(reasoning.pairs(rows, "text")).collect()}
    assert len(cells) == 36 and all(cells[a, b] == cells[b, a] == (0 if a == b else 16) for a, b in cells)
    assert reasoning.pairs(rows.limit(0), "text").agg(F.sum("n")).first()[0] == 0


def test_nearest_experience_excludes_itself(spark):
    own = spark.createDataFrame([(k, [float(k)] * 9, [0.0] * 3, [0.0] * 8) for k in range(6)], "ord long, k1 array<double>, k2 array<double>, k3 array<double>")
    got = experience.nearest_experiences(own, own.where("ord = 2")).orderBy("place").collect()
    assert [r.ord for r in got] == [1, 3, 0] and got[0].confidence == pytest.approx(math.exp(-9))


def experiences(n, seed, clusters):
    rng = np.random.default_rng(seed)
    middle = rng.uniform(-3, 3, (clusters, 20))
    return [(k, *(v.tolist() for v in np.split(middle[k % clusters] + rng.normal(scale=0.2, size=20), [9, 12]))) for k in range(n)]


def plain_experiences(rows, queries, k=3):
    keys = np.array([np.concatenate(r[1:]) for r in rows])
    factor = np.r_[np.ones(9), np.full(3, 10.0), np.ones(8)]
    for q in queries:
        confidence = np.exp(-(factor * (keys - keys[q]) ** 2).sum(1))
        confidence[q] = 0
        for place, m in enumerate(np.argsort(-confidence, kind="stable")[:k], 1):
            yield q, int(m), place, round(float(confidence[m]), 9)


@pytest.mark.parametrize(("clusters", "part"), [(40, 0.5), (1, 1.01)])
def test_experiences_in_blocks(spark, monkeypatch, clusters, part):
    monkeypatch.setattr(experience, "BLOCK", 32)
    rows = experiences(1500, 1, clusters)
    for k in range(600, 700):
        rows[k] = (k, *rows[7][1:])  # copies: ties, and a crowded block
    rows[9] = (9, [90.0] * 9, [90.0] * 3, [90.0] * 8)  # so far off that every confidence is zero
    own = spark.createDataFrame(rows, "ord long, k1 array<double>, k2 array<double>, k3 array<double>")
    asked = [0, 7, 9, 600, 1234]
    found, blocks = experience.searched(own, own.where(F.col("ord").isin(asked)))
    assert sorted((r.query, r.ord, r.place, round(r.confidence, 9)) for r in found.collect()) == sorted(plain_experiences(rows, asked))
    visits = {r.query: r.visited / r.blocks for r in blocks.collect()}
    assert set(visits) == set(asked) and all(visits[q] < part for q in asked if q != 9)


def test_experiences_of_odd_rows(spark):
    rows = [(k, [0.0] * 9, [0.0] * 3, [0.0] * 8) for k in range(2)] + [(5, None, [0.0] * 3, [0.0] * 8), (6, [float("nan")] * 9, [0.0] * 3, [0.0] * 8), (None, [0.0] * 9, [0.0] * 3, [0.0] * 8), (7, [0.0], [], [])]
    own = spark.createDataFrame(rows, "ord long, k1 array<double>, k2 array<double>, k3 array<double>").withColumns({"n": F.lit(1), "_p": F.lit("clash")})
    got = [(r.query, r.ord, r.confidence, r.place) for r in experience.nearest_experiences(own, own).collect()]
    assert {(0, 1, 1.0, 1), (0, 0, 0.0, 2), (1, 0, 1.0, 1), (1, 1, 0.0, 2)} <= set(got) and {q for q, *_ in got} <= {0, 1}
    assert experience.nearest_experiences(own.limit(0), own).count() == 0 and experience.nearest_experiences(own, own.limit(0)).count() == 0


def test_speed_words(spark):
    words = {(0.1, 0.2): "STOP", (3.0, 0.1): "A DECELERATION TO ZERO", (3.0, 3.2): "A CONSTANT SPEED", (9.0, 3.0): "A QUICK DECELERATION", (4.0, 3.0): "A DECELERATION", (1.0, 3.0): "A QUICK ACCELERATION", (2.0, 3.0): "AN ACCELERATION"}
    for (now, then), want in words.items():
        assert value(spark, driving.speed_action(F.lit(now), F.lit(then))) == want


def test_sampling(spark):
    rows = spark.range(1000)
    got = keyed.sample(rows, 0.137, "s", "id")
    assert got.count() == 137 and sorted(r.place for r in keyed.ranked(rows, "s", "id").collect()) == list(range(1, 1001))
    assert keyed.sample(rows.limit(0), 0.5, "s", "id").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=60))
def test_bins_hold_their_volume(sizes):
    bins = packing.greedy_bins(np.array(sizes, np.int64), 4096)
    for b in set(bins.tolist()):
        own = [s for s, x in zip(sizes, bins, strict=True) if x == b]
        assert sum(own) <= 4096 or len(own) == 1


def masked(ids, start=1, end=2):
    """The rule by definition: from each start that no answer holds, two on, through the next end and one more."""
    out, free = [-100] * len(ids), 0
    for k, x in enumerate(ids):
        stops = [j for j in range(k + 2, len(ids)) if ids[j] == end]
        if x == start and k >= free and stops:
            out[k + 2 : stops[0] + 2], free = ids[k + 2 : stops[0] + 2], stops[0] + 1
    return out


def test_label_masks_by_definition(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.choice([0, 1, 2, 3, 4], rng.integers(0, 30), p=[0.3, 0.2, 0.2, 0.2, 0.1]).tolist()) for k in range(300)]
    got = {r.k: r.labels for r in packing.label_masks(spark.createDataFrame([*rows, (999, None)], "k int, ids array<long>"), "ids", "k", start=1, end=2).collect()}
    assert got == {k: masked(ids) for k, ids in rows} | {999: []}
    fixed = spark.createDataFrame([([5, 77091, 198, 7, 8, 151645, 198, 9, 77091, 198, 1],)], "ids array<long>")
    assert packing.label_masks(fixed, "ids").first().labels == [-100, -100, -100, 7, 8, 151645, 198, -100, -100, -100, -100]


def positions(kinds, grids, merge=2, seconds=None, split=False):
    """Position ids token by token."""
    out, base, place, before = [], 0, 0, None
    for kind in kinds:
        if kind != before:
            base, place = (max(map(max, out)) + 1 if out else 0), 0
        if kind == 0:
            out.append((base + place,) * 3)
        else:
            _, h, w = grids[kind - 1]
            f, rest = divmod(place, (h // merge) * (w // merge))
            out.append((base + (0 if split else int(f * seconds[kind - 1] * 2) if seconds else f), base + rest // (w // merge), base + rest % (w // merge)))
        before, place = kind, place + 1
    return out


def test_positions_by_definition(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(40):
        grids = [(int(rng.integers(1, 4)), 2 * int(rng.integers(1, 4)), 2 * int(rng.integers(1, 4))) for _ in range(2)]
        kinds = [0] * int(rng.integers(0, 4))
        for n, (t, h, w) in enumerate(grids, 1):
            kinds += [n] * (t * h * w // 4) + [0] * int(rng.integers(0, 3))
        rows.append((k, kinds, grids, [float(rng.integers(1, 5)) / 2, 1.0]))
    frame = spark.createDataFrame([*rows, (99, [], [], [])], "key long, kinds array<int>, grids array<array<int>>, seconds array<double>")
    for options, want in (({}, {}), ({"split_frames": True}, {"split": True}), ({"seconds": "seconds"}, {"seconds": True})):
        got = {}
        for r in packing.rope_index(frame, "key", **options).orderBy("key", "place").collect():
            got.setdefault(r.key, []).append((r.t, r.h, r.w))
        assert got == {k: positions(kinds, grids, **(want | ({"seconds": s} if "seconds" in want else {}))) for k, kinds, grids, s in rows if kinds}


def test_later_steps_meet_the_last_forecast(spark):
    points = spark.createDataFrame([(1, t, 0.3, 0.0) for t in range(1, 7)], "token long, t int, x double, y double")
    occ = spark.createDataFrame([(1, 4, 99, 99, 1.0), (1, 0, 99, 99, 1.0)], "token long, t int, r int, c int, p double")
    got = {r.t: r for r in packing.refine_paths(points, occ).collect()}
    assert all((got[t].x, got[t].cells) == (0.3, 0) for t in (1, 2, 3)) and all(got[t].cells == 1 and got[t].slope < 1e-6 for t in (4, 5, 6))
    assert got[4].x == got[5].x == got[6].x > 0.6


def test_paths_leave_obstacles():
    moved, slope = packing.pushed_away(np.array([[0.2, 0.0], [5.0, 5.0]]), np.array([[0.0, 0.0]]), np.array([0]), 5.0, 1.0)
    p = moved[0, 0]  # where 2 (p - 0.2) = c p exp(-p^2 / 2)
    assert abs(2 * (p - 0.2) - 5 / 2.507 * p * math.exp(-p * p / 2)) < 1e-6 and p > 0.7 and moved[1].tolist() == [5.0, 5.0] and slope[1] == 0


@pytest.mark.parametrize("alpha", [0.5, 5.0, 50.0])
def test_every_waypoint_comes_to_rest(alpha):
    """On a minimum: no gradient is left, no direction leads down; also between two cells, on one and in a crowd of them."""
    rng = np.random.default_rng(int(alpha))
    start = rng.uniform(-3, 3, (400, 2))
    start[:3] = [[0, 0], [0.25, 0], [1.0, 1.0]]
    sets = [np.array([[-0.25, 0.0], [0.25, 0.0]]), np.array([[0.25, 0.0]]), np.stack(np.meshgrid(np.arange(-4, 5) / 2, np.arange(-4, 5) / 2), -1).reshape(-1, 2)] + [np.round(rng.uniform(-3, 3, (rng.integers(0, 60), 2)) * 2) / 2 for _ in range(397)]
    row = np.repeat(np.arange(400), [len(o) for o in sets])
    end, slope = packing.pushed_away(start, np.concatenate(sets), row, alpha, 1.0)
    assert slope.max() < 1e-7
    cost = lambda p: packing.terms(p, start, np.concatenate(sets), row, alpha, 1.0)[0]
    assert (cost(end) <= cost(start + 1e-6) + 1e-12).all()
    for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
        for s in (1e-3, -1e-3):
            assert (cost(end + [[s * dx, s * dy]]) >= cost(end) - 1e-12).all()
    alone = [packing.pushed_away(start[k : k + 1], sets[k], np.zeros(len(sets[k]), int), alpha, 1.0)[0][0] for k in range(40)]
    assert np.allclose(alone, end[:40], atol=1e-7)  # the batch makes no difference


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_every_given_waypoint_comes_to_rest(spark):
    from corridor.sources.fixtures import view

    d = "/root/testdata/sf0.01"
    found = packing.refine_paths(view(spark, d, "pred"), view(spark, d, "occ"))
    assert found.agg(F.max("slope")).first()[0] < 1e-6


def test_media_parts(spark):
    rows = spark.createDataFrame([(1, "a <image> b<video><image>", "human", 2, 1), (2, "<image>", "gpt", 0, 0), (3, None, "human", 0, 0), (4, "x", "human", 1, 0)], "k int, text string, role string, n_images int, n_videos int")
    got = [(r.k, r.kind, r.value, r.media) for r in conversations.parts(rows, "text", "k").orderBy("k", "place").collect()]
    assert got[:5] == [(1, "text", "a", None), (1, "image", "<image>", 0), (1, "text", "b", None), (1, "video", "<video>", 0), (1, "image", "<image>", 1)]
    assert {r.k: r.problem for r in conversations.media_check(rows).collect()} == {1: None, 2: "placeholder in an answer", 3: None, 4: "surplus media"}


def test_files(spark, tmp_path):
    rows = [{"token": "a", "image": "x.png", "conversations": [{"from": "human", "value": "hi"}]}, {"token": "b", "image": '["y.png", "z.png"]'}]
    (tmp_path / "a.jsonl").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    lines = files.read_annotations(spark, str(tmp_path / "a.jsonl"), files.CONVERSATION)
    assert [r.n for r in lines.where("token IS NOT NULL").select(F.size(files.media_list(F.col("image"))).alias("n")).collect()] == [1, 2]
    assert lines.cache().where("_corrupt_record IS NOT NULL").count() == 1
    assert files.read_annotations(spark, str(tmp_path / "a.json"), files.CONVERSATION).count() == 2
    with pytest.raises(ValueError):
        files.read_annotations(spark, "a.xml", files.CONVERSATION)
    files.write_split(lines.drop("_corrupt_record"), F.col("token") == "a", str(tmp_path / "split"))
    assert (spark.read.text(str(tmp_path / "split/valid=true")).count(), spark.read.text(str(tmp_path / "split/valid=false")).count()) == (1, 2)
    made = []
    for _ in range(2):
        files.staged(spark, str(tmp_path / "stage"), lambda: made.append(1) or spark.range(3))
    assert made == [1]
    (tmp_path / "t.tsv").write_text("index\timage\n1\t" + "p" * 70 + "\n2\t1\n")
    table = files.read_table(spark, str(tmp_path / "t.tsv"), "index string, image string")
    assert {r.image for r in files.resolved_images(table).collect()} == {"p" * 70}


def test_tools(spark):
    objects = spark.createDataFrame([(1, 0, "car", 1.0, 5.0, 2.0, 4.0), (1, 1, "bus", 30.0, 5.0, 2.0, 4.0), (2, 0, "car", 40.0, 40.0, 2.0, 4.0)], "token int, ord int, name string, x double, y double, dx double, dy double")
    cells = spark.createDataFrame([(1, spatial.BOUNDARY, 100, 90), (1, spatial.DIVIDER, 99, 104), (2, spatial.CROSSING, 110, 100)], "token int, layer int, r int, c int")
    waypoints = objects.select("token", "ord", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("t"), "x", "y")
    occ = spark.createDataFrame([(1, 1, 100, 100, 0.5)], "token int, t int, r int, c int, p double")
    frames = {"objects": objects, "scenes": objects.select("token"), "map_cells": cells, "waypoints": waypoints, "occ": occ, "lane_cells": cells.withColumn("p", F.lit(0.5))}
    box = {"x_start": 0, "x_end": 50, "y_start": 0, "y_end": 10}
    assert tools.call("get_leading_object_detection", frames).count() == 1
    assert tools.call("get_object_detections_in_range", frames, **box).count() == 2
    bad = [("nothing", {}), ("get_object_detections_in_range", box | {"x_start": -99}), ("get_object_detections_in_range", {}), ("get_current_shoulder", {"x": 1}), ("get_drivable_at_locations", {"locations": [(1,)]}), ("check_drivable_of_planned_trajectory", {"trajectory": [(0, 0)]}), ("get_future_trajectories_for_specific_objects", {"object_ids": [True]}), ("get_lane_category_at_locations", {"locations": [(0, 0)], "return_score": 1})]
    for name, args in bad:
        with pytest.raises(ValueError):
            tools.call(name, frames, **args)
    assert len(tools.described()) == 18 and len(tools.described(hidden=True)) == 20
    places, path = {"locations": [(0, 0), (5, -5.5)]}, {"trajectory": [(0, 0)] * 6}
    arguments = {"get_object_detections_in_range": box, "get_future_trajectories_in_range": box, "get_future_trajectories_for_specific_objects": {"object_ids": [0]}, "get_future_waypoint_of_specific_objects_at_timestep": {"object_ids": [0], "timestep": 2},
                 "get_occupancy_at_locations_for_timestep": places | {"timestep": 1}, "check_occupancy_for_planned_trajectory": path, "check_drivable_of_planned_trajectory": path, "get_lane_category_at_locations": places | {"return_score": True}}
    for name, tool in tools.TOOLS.items():
        args = arguments.get(name, places if "locations" in tool.arguments else {})
        assert tools.say(name, frames, **args).columns == ["token", "prompt"] and tools.say(name, frames, **args).count() > 0 and tools.call(name, frames, **args).count() > 0, name
    text = {r.token: r.text for r in tools.rerun([("get_current_shoulder", {}), ("nothing", {}), ("get_nearest_pedestrian_crossing", {})], frames).collect()}
    assert text[1] == "Distance to both sides of road shoulders of current ego-vehicle location:\nCurrent ego-vehicle's distance to left shoulder is 5.0m and distance to right shoulder is uncertain\n"
    assert text[2].endswith("shoulders are uncertain\nGet the nearest pedestrian crossing location:\nThe nearest pedestrian crossing is at (0.25, 5.25)\n")


def test_two_decimals_are_those_of_printf(spark):
    rng = np.random.default_rng(8)
    values = [0.125, 2.675, 1.005, -0.001, 1.115, -0.0, 1e14 / 3, 99.995, *rng.uniform(-100, 100, 500).round(3).tolist(), *(rng.integers(-900, 900, 500) / 8).tolist()]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", trajectory_text.two_decimals(F.col("v")).alias("s")).collect()
    assert all(r.s == f"{r.v:.2f}" for r in got)


def test_surroundings(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, -50.2, 0.0)], "token int, t int, x double, y double")
    cells = spark.createDataFrame([(1, spatial.DRIVABLE, 101, 99), (1, spatial.DRIVABLE, 99, 101), (1, spatial.DRIVABLE, 100, 1)], "token int, layer int, r int, c int")
    got = {r.t: (r.drivable, [(p.x, p.y) for p in r.free]) for r in spatial.drivable_around(points, cells).collect()}
    assert got == {1: (False, [(-0.25, 0.75), (0.75, -0.25)]), 2: (False, [(-49.25, 0.25)])}
    assert {r.t: len(r.free) for r in spatial.drivable_around(points, cells, compat=True).collect()} == {1: 2, 2: 0}
    occ = spark.createDataFrame([(1, 1, 100, 100, 0.9), (1, 1, 101, 101, 1.0), (1, 1, 99, 99, 0.05)], "token int, t int, r int, c int, p double")
    free = {compat: next([(p.x, p.y) for p in r.free] for r in spatial.occupied_around(points, occ, compat=compat).collect() if r.t == 1) for compat in (False, True)}
    assert len(free[False]) == 7 and free[True] == [(-0.25, -0.25), (0.25, 0.25), (0.75, 0.75)]


def test_pickles_of_data_alone(spark):
    import pickle

    rows = spark.createDataFrame([(pickle.dumps({"a": np.array([[1.0, 2.0], [3.0, 4.0]])}),), (b"cos\nsystem\n(S'true'\ntR.",), (b"junk",), (pickle.dumps({"b": [[5, 6]]}),)], "content binary")
    assert sorted(map(tuple, files.unpickled(rows, "content").collect())) == [("a", 1, 1.0, 2.0), ("a", 2, 3.0, 4.0), ("b", 1, 5.0, 6.0)]


def test_checksums_and_versions(spark, tmp_path):
    path = str(tmp_path / "t.tsv")
    files.write_table(spark.range(5), path, "\t")
    assert files.read_checked(spark, path, "id long", files.checksums(spark, path)).count() == 5
    with pytest.raises(ValueError):
        files.read_checked(spark, path, "id long", {"0" * 32})
    before = files.version(spark, path)
    files.write_table(spark.range(6), path, "\t")
    assert files.version(spark, path) != before


def test_stream_equals_batch(spark, tmp_path):
    gt = spark.createDataFrame([(str(k), t, float(t), 1.0, 1) for k in range(4) for t in range(1, 7)], "token string, t int, x double, y double, mask int")
    text = "Planned Trajectory: [" + ", ".join(f"({t},{t})" for t in range(1, 7)) + "]"
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.json").write_text(json.dumps({"token": str(k), "generated_text": text}) + "\n" + json.dumps({"token": "9", "generated_text": "?"}))
    generations.run(spark, str(source), gt, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.t: (r.n, r.l2) for r in generations.merged(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {t: (3, float(t - 1)) for t in range(1, 7)}


def test_links(spark):
    chain = spark.createDataFrame([(1, 7), (7, 3), (3, None), (9, None), (4, 9)], "k long, n long")
    assert {r.k: (r.start, r.place) for r in links.walk(chain, "k", "n").collect()} == {1: (1, 1), 7: (1, 2), 3: (1, 3), 4: (4, 1), 9: (4, 2)}
    assert links.walk(chain.limit(0), "k", "n").count() == 0
    ring = chain.union(spark.createDataFrame([(20, 21), (21, 22), (22, 20)], "k long, n long"))
    assert {r.k: (r.start, r.place) for r in links.walk(ring, "k", "n").where("k >= 20").collect()} == {20: (None, None), 21: (None, None), 22: (None, None)}


def test_map_texts(spark):
    points = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 99.0, 0.0), (2, 1, 0.0, 0.0)], "token int, t int, x double, y double")
    cells = spark.createDataFrame([(1, spatial.DRIVABLE, 120, 120)], "token int, layer int, r int, c int")
    got = {r.token: r.prompt for r in map_text.drivable(points, cells).collect()}
    assert got == {1: "Drivability of selected locations:\nLocation (10.00, 10.00) is drivable\n", 2: "Drivability of selected locations:\nLocation (0.00, 0.00) is not drivable\n"}
    path = {r.token: r.prompt.split("\n")[1] for r in map_text.drivable_path(points, cells).collect()}
    assert path == {1: "All waypoints of the planned trajectory are in drivable regions", 2: "Waypoint (0.00, 0.00) is not drivable at time step 1"}
    assert map_text.shoulders(points.limit(0), cells).count() == 0


def test_names_and_models(spark):
    assert conversations.plain_names(spark.createDataFrame([(1, 2)], "Index int, A int")).columns == ["index", "A"]
    with pytest.raises(ValueError):
        conversations.plain_names(spark.createDataFrame([(1, 2)], "Index int, INDEX int").toDF("Index", "INDEX"))
    assert [r.v for r in text_records.scored(spark.range(3), lambda b: b.assign(v=b["id"] * 2), "id long, v long").orderBy("id").collect()] == [0, 2, 4]


def test_point_read(spark, tmp_path):
    spark.range(10).withColumn("token", F.col("id") % 3).write.partitionBy("token").parquet(str(tmp_path / "t"))
    rows = files.point_read(spark, str(tmp_path / "t"), "token", 1)
    assert rows.count() == 3 and "PartitionFilters: [isnotnull(token" in rows._jdf.queryExecution().toString()
