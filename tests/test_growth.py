"""What went wrong on larger tables: rare rows, and work that grew faster than the input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corridor.functions import formats, trajectory_text
from corridor.operators import boxes, distance, driving, experience, packing, spatial, text_records
from corridor.plans import catalogue


def test_paths_in_shallow_valleys_come_to_rest():
    """A place whose cost hardly bends in one direction, and 200,000 drawn ones: all end where the gradient is none."""
    cells = [(115, 104), (106, 107), (115, 108)]
    at = lambda k: -50 + (k + 0.5) * 0.5
    obstacles = np.array([(at(c), at(r)) for r, c in cells])
    assert packing.pushed_away(np.array([[2.375, 7.75]]), obstacles, np.zeros(3, int), 5.0, 1.0)[1] < 1e-9
    rng = np.random.default_rng(7)
    start = np.stack([rng.integers(-20, 21, 200_000) / 8, rng.integers(12, 100, 200_000) / 8], 1)
    near = np.stack([at(rng.integers(92, 109, (200_000, 7))), at(rng.integers(95, 136, (200_000, 7)))], 2)
    row, k = np.nonzero(((near - start[:, None]) ** 2).sum(2) < 25)
    assert packing.pushed_away(start, near[row, k], row, 5.0, 1.0)[1].max() < 1e-8


def scenes(spark, n, scenes, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(0, scenes)), k, *(float(v) for v in (*rng.uniform(-60, 60, 2), rng.choice([0.1, 1.5, 12.0]), rng.choice([0.2, 4.0, 30.0]), rng.uniform(0, 6.3), 0.25))) for k in range(n)]
    return spark.createDataFrame([*rows, (1, n, 0.0, 0.0, 1.0, 1.0, None, 0.0), (None, n, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "token long, ord int, x double, y double, dx double, dy double, rot_z double, vx double")


def test_objects_moved_where_paths_meet_them(spark):
    """The same pairs as by the grid, from one join by scene: no row of a step is shuffled."""
    objects = scenes(spark, 400, 3)
    rng = np.random.default_rng(1)
    ego = spark.createDataFrame([(k, t, float(rng.uniform(-9, 9)), 2.0 * t) for k in range(3) for t in range(1, 7)], "token long, t int, x double, y double")
    paths = spatial.paths_of(ego.withColumn("risk", F.col("t") % 2 == 0), "risk")
    plain = spatial.object_collisions(ego, spatial.waypoints(objects), objects)
    found = spatial.moving_collisions(paths, objects)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.where("collides").count() > 10
    both = {(r.token, r.t): r.collides for r in spatial.moving_combined(paths, objects).collect()}
    hit = {(r.token, r.t) for r in plain.where("collides").collect()}
    assert both == {(k, t): t % 2 == 0 and (k, t) in hit for k in range(3) for t in range(1, 7)} and any(both.values())
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning(token") <= 2  # objects once, paths once


def test_runs_against_every_cell():
    """Rows of convex boxes are runs: held against the condition on every cell, thin and degenerate boxes and those beyond the map too."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(-6, 12, (4, 120)), rng.integers(-6, 12, (4, 120))
    turned = boxes.corners(*(rng.uniform(a, b, 240) for a, b in ((-3, 9), (-3, 9), (0, 9), (0, 9))), *((f := rng.uniform(0, 6.3, 240)) * 0 + np.cos(f), np.sin(f)))
    x, y = np.c_[np.stack([x[0], x[1], x[1], x[0]]), np.trunc(turned[0])], np.c_[np.stack([y[0], y[0], y[1], y[1]]), np.trunc(turned[1])]
    box, r, c0, c1 = boxes.covered(x.astype(float), y.astype(float))
    got = {(b, row, c) for b, row, lo, hi in zip(box, r, c0, c1, strict=True) for c in range(lo, hi + 1)}
    want = set()
    for b in range(x.shape[1]):
        p = list(zip(x[:, b], y[:, b], strict=True))
        for c in range(0, 22):
            for row in range(0, 22):
                turns, edge = [], False
                for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
                    u, v, du, dv = bx - ax, by - ay, c - ax, row - ay
                    turns.append(u * dv - v * du)
                    edge = edge or bool(0 <= du * u + dv * v <= u * u + v * v and 2 * abs(turns[-1]) <= max(abs(u), abs(v)) and (u or v or (du == dv == 0)))
                inside = (min(turns) >= 0 or max(turns) <= 0) and min(x[:, b]) <= c <= max(x[:, b]) and min(y[:, b]) <= row <= max(y[:, b])
                if inside or edge:
                    want.add((b, row, c))
    assert got == want


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_runs_of_crowded_scenes_in_small_batches(spark, batch):
    """A scene in many batches gives each cell once, and what cells give; boxes with nulls cover nothing."""
    objects = scenes(spark, 300, 2).withColumn("token", F.concat(F.lit("s"), "token"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = spatial.moving(objects, 2)
        got = [(r.token, r.t, r.r, c) for r in spatial.runs_of_boxes(rows).collect() for c in range(r.c0, r.c1 + 1)]
        cells = spatial.cells_of_boxes(spatial.waypoints(objects, 2), objects)
        assert {f.name: f.dataType.simpleString() for f in cells.schema} == {"token": "string", "t": "int", "r": "int", "c": "int"}
        assert len(set(got)) == len(got) > 1000 and sorted(got) == sorted(map(tuple, cells.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    alone = [spatial.cells_of_boxes(spatial.waypoints(o, 2), o) for k in range(5) for o in [objects.where(F.col("ord") == k)]]
    assert {tuple(r) for a in alone for r in a.collect()} <= set(got)


@pytest.mark.parametrize("ahead", [True, False])
def test_few_cells_are_compared_without_a_transform(monkeypatch, ahead):
    """Both ways agree, ties too, and rasters of either kind may share a batch; small ones never build an envelope."""
    rng = np.random.default_rng(4)
    cells = [rng.choice(40_000, n, replace=False) if n % 2 else rng.choice(900, n % 800, replace=False) for n in (0, 1, 2, 50, 51, 400, 7001, 9, 30_001)]
    places = [rng.choice(40_000, m) for m in (3, 6, 6, 6, 0, 6, 40, 1, 5)]
    monkeypatch.setattr(distance, "PAIRS", 500)
    slow = distance.by_transform(cells, places, ahead)
    for way in (distance.by_pairs, distance.looked_up):
        assert all((a == b).all() for a, b in zip(slow, way(cells, places, ahead), strict=True))
    monkeypatch.setattr(distance, "envelope", None)
    assert distance.looked_up(cells[:6], places[:6], ahead)[0].tolist() == slow[0][:27].tolist()


def test_safe_zones_without_rows_of_steps(spark):
    """Hits and their texts as by rows of steps, from one join by scene."""
    objects = scenes(spark, 300, 3).withColumn("name", F.lit("car"))
    ego = spark.createDataFrame([(k, 0.25 * k, 2.0 + k, 0.0, 0.125) for k in range(3)], "token long, vx double, vy double, ax double, ay double")
    path, steps = driving.roll_out(ego), spatial.waypoints(objects, first=0)
    plain, found = driving.first_hits(path, steps, objects), driving.moving_first_hits(path, objects)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, found.select("token", "ord", "t").collect())) and found.count() > 3
    actions = driving.meta_actions(ego, path)
    assert sorted(driving.reasoning_text(ego, plain, actions, steps, objects).collect()) == sorted(driving.moving_reasoning_text(ego, found, actions).collect())
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning(token") <= 2


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_scores_pass_by_cells_that_no_place_asks_for(spark):
    """Cells meet the places that ask for them before they are gathered, and are never sorted."""
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 5.0, 5.0), (1, 3, 900.0, 0.0), (2, 1, 0.0, 0.0)], "token long, t int, x double, y double")
    cells = spark.createDataFrame([(1, k % 4, r, 100, r / 200) for k, r in enumerate([100, 100, 101, 100, 100, 7])] + [(3, 0, 100, 100, 0.5)], "token long, layer int, r int, c int, p double")
    found = spatial.lane_scores(points, cells)
    got = {(r.token, r.t): (r.valid, r.found and sorted((f.layer, f.p) for f in r.found)) for r in found.collect()}
    assert got == {(1, 1): (True, [(0, 0.5), (0, 0.5), (1, 0.5)]), (1, 2): (True, []), (1, 3): (False, None), (2, 1): (True, [])}
    assert "ShuffledHashJoin" in plan_of(found) and "array_contains(places" in plan_of(found)


def test_a_payload_is_one_frame(spark, monkeypatch):
    """Paths of a payload come out together, those without points too."""
    import pickle

    import pandas as pd

    from corridor.sources import files

    data = pickle.dumps({f"k{k}": np.full((k % 4, 2), k / 2) for k in range(3000)})
    made, frame = [], pd.DataFrame
    monkeypatch.setattr(files.pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))

    class Rows:
        def mapInPandas(self, run, schema):  # noqa: N802
            return list(run(iter([frame({"content": [data, b"broken", pickle.dumps({})]})])))

        def select(self, *_):
            return self

    from corridor.functions import workers

    monkeypatch.setattr(workers, "shipped", lambda rows: rows)
    out = files.unpickled(Rows(), "content")
    assert len(made) == 1 and len(out[0]) == sum(k % 4 for k in range(3000))
    assert out[0].iloc[1].tolist() == ["k2", 1, 1.0, 1.0] and out[0].iloc[2].tolist() == ["k2", 2, 1.0, 1.0]


def test_experiences_of_a_block_meet_as_a_matrix(spark, monkeypatch):
    """Many equal distances of different vectors, copies, far ones of the least confidences, queries in several deals and rows of other sizes: as by plain sorting, without a row for each pair."""
    for name, n in (("BLOCK", 64), ("QUERIES", 16), ("TILE", 1000)):
        monkeypatch.setattr(experience, name, n)
    rng = np.random.default_rng(4)
    keys = rng.integers(0, 2, (900, 20)) / 2.0
    keys[300:340] = keys[3]
    keys[899] = 0.25 + np.sqrt(743.5 / 48)  # confidences of a few of the least doubles
    cut = lambda v: [x.tolist() for x in np.split(v, [9, 12])]
    other = [(1000 + k, [0.0], [0.0], [0.0]) for k in range(60)]
    own = spark.createDataFrame([*((k, *cut(v)) for k, v in enumerate(keys)), *other], "ord long, k1 array<double>, k2 array<double>, k3 array<double>")
    asked = [*range(0, 900, 7), 899]
    found = experience.nearest_experiences(own, own.where(F.col("ord").isin(asked)))
    got = {(r.query, r.place): (r.ord, r.confidence) for r in found.collect()}
    factor, want = np.r_[np.ones(9), np.full(3, 10.0), np.ones(8)], {}
    for q in asked:
        confidence = np.exp(-(factor * (keys - keys[q]) ** 2).sum(1))
        confidence[q] = 0
        best = np.argsort(-confidence.round(12) if q != 899 else -confidence, kind="stable")[:3]
        want |= {(q, place): (int(m), pytest.approx(confidence[m], rel=1e-9, abs=1e-320)) for place, m in enumerate(best, 1)}
    assert got == want
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "FlatMapCoGroupsInArrow" in plan and "Join [_p" not in plan
    i, j, _ = experience.nearest(np.arange(600), keys[:600] + rng.normal(size=(600, 20)), np.full(600, np.nan), np.arange(900), keys, 3, (9, 3, 8), (1.0, 10.0, 1.0))
    assert len(i) <= 4 * 600  # of 540,000 pairs


def test_trajectories_said_by_batch(spark, monkeypatch):
    """As from rows of steps, with nulls, odd numbers and many small batches; objects are gathered once, neither steps nor texts are rows that are shuffled."""
    monkeypatch.setattr(spatial, "BATCH", 7)
    odd = [0.125, 2.675, -0.001, -0.0, 1.005, 1e12, float("nan"), None, 33.335]
    rows = [(k % 5, 40 - k, "car" if k % 4 else None, odd[k % 9], k / 8, 1.5, odd[-1 - k % 9], 0.0, odd[(k + 3) % 9] if k % 2 else 0.25) for k in range(40)] + [(None, 1, "car", *[0.0] * 6), (1, None, "car", *[0.0] * 6), (9, 1, None, *[0.0] * 6)]
    objects = spark.createDataFrame(rows, "token long, ord int, name string, x double, y double, dx double, dy double, rot_z double, vx double").repartition(1)
    for short in (False, True):
        how = ("Header:\n", "Object type", "3s", short)
        plain = spatial.trajectory_prompt(spatial.waypoints(objects), objects, *how)
        assert sorted(map(str, spatial.moving_prompt(objects, *how).collect())) == sorted(map(str, plain.collect()))
    numbers = [v for v in odd if v is not None] + [0.005, 1e-9, -123456.785]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in numbers], "v double").select(trajectory_text.two_decimals(F.col("v"))).collect()]
    assert trajectory_text.hundredths(pa.array(numbers), pa.array([1.0]))[0].to_pylist() == want
    said = {r.token: r.prompt for r in spatial.prompt(objects, *formats.OBJECTS["all"]).collect()}
    assert set(said) == {0, 1, 2, 3, 4, 9, None} and said[9] == formats.OBJECTS["all"][0] and said[2].count("\n") == 1 + sum(r[0] == 2 and None not in r[1:7] for r in rows)
    plan = catalogue.queries()["all_trajectory_prompts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") <= 2


def test_futures_read_where_texts_lie(spark):
    """Sections, ends, repeats and odd numbers as the lines say; no line is a row, and no text is shuffled after its objects were gathered."""
    head, line = "Future trajectories for specific objects:", "Object type: car, object id: {}, future waypoint coordinates in 3s: [{}]"
    texts = {
        1: "\n".join([line.format(9, "(9.00, 9.00)"), "x " + head, line.format(1, "(1.00, -2.00), (3.00,4.00)"), line.format(2, "(1.00, 1.00)"), line.format(1, "(5.00, 6.00)"), "  ", line.format(3, "(1.00, 1.00)"), head, line.format(4, "(7.00, 8.00)"), "<b>", line.format(5, "(1.00, 1.00)")]),
        2: "\n".join(["<" + head, line.format(1, "(1.00, 1.00)")]),
        3: "\n".join([head + " " + line.format(6, "(0.50, 1.5.0)"), line.format(7, ""), "object id: 8\rfuture waypoint coordinates: [(1.00, 1.00)]", line.format(99999999999, "(1.00, 2.00)")]),
        4: "no header\n" + line.format(1, "(1.00, 1.00)"),
        5: None,
    }
    rows = spark.createDataFrame(list(texts.items()), "token long, text string")
    got = {(r.token, r.ord): [tuple(p) for p in r.waypoints] for r in text_records.future_waypoints(rows, "text", "token").collect()}
    assert got == {(1, 1): [(5.0, 6.0)], (1, 2): [(1.0, 1.0)], (1, 4): [(7.0, 8.0)], (3, 6): [(0.5, None)], (3, None): [(1.0, 2.0)]}
    plan = catalogue.queries()["future_waypoint_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange") <= 2


def test_pairs_of_boxes_by_batch(spark):
    """Distances and overlaps of pairs come from batches, as pair by pair, and a pair's cells are few: most objects go into one or two."""
    for name in ("box_min_distance", "box_overlap"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "array_min" not in plan
    rng = np.random.default_rng(6)
    rows = [(k, *(float(v) for p in range(2) for v in (*rng.uniform(-4, 4, 2), *rng.choice([0.0, 1.5, 4.0], 2), rng.uniform(0, 6.3)))) for k in range(200)]
    names = [p + c for p in "ab" for c in ("x", "y", "dx", "dy", "rot_z")]
    pairs = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names))
    sides = [[F.col(p + c) for c in ("x", "y", "dx", "dy", "rot_z")] for p in "ab"]
    got = {r.k: r for r in boxes.compared(pairs.select("k", *boxes.shape("a", *sides[0]), *boxes.shape("b", *sides[1])), "k").collect()}
    a, b = (spatial.corners(*s) for s in sides)
    for r in pairs.select("k", spatial.overlap(a, b, sides[0][-1], sides[1][-1]).alias("o"), spatial.box_distance(a, b).alias("d")).collect():
        assert got[r.k].overlaps == r.o and got[r.k].distance == pytest.approx(r.d, abs=1e-9)
