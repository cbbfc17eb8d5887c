"""Distance transform and grid joins against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.operators import distance, grid, spatial


def plain_nearest(cells, row, column, ahead):
    r, c = np.array([n // 200 for n in cells]), np.array([n % 200 for n in cells])
    if ahead:
        r, c = r[r >= row], c[r >= row]
    if not len(r):
        return -1, -1
    best = np.lexsort((r, c, (r - row) ** 2 + (c - column) ** 2))[0]
    return r[best], c[best]


@pytest.mark.parametrize("ahead", [True, False])
@pytest.mark.parametrize("n", [0, 1, 4, 60, 3000, 40_000])
def test_transform(n, ahead, monkeypatch):
    monkeypatch.setattr(distance, "RASTERS", 2)
    monkeypatch.setattr(distance, "ROWS", 7)
    rng = np.random.default_rng(n)
    cells = [rng.choice(40_000, n, replace=False) for _ in range(3)]
    places = [rng.choice(40_000, 25), np.arange(0), np.r_[rng.choice(40_000, 25), 0, 199, 39_800, 39_999]]
    r, c = distance.looked_up(cells, places, ahead)
    assert list(zip(r, c, strict=True)) == [plain_nearest(cs, p // 200, p % 200, ahead) for cs, ps in zip(cells, places, strict=True) for p in ps]


def test_equal_distances_go_to_the_smaller_column_then_row():
    ring = [98 * 200 + 100, 102 * 200 + 100, 100 * 200 + 98, 100 * 200 + 102]
    place = [np.array([100 * 200 + 100])]
    assert [v[0] for v in distance.looked_up([np.array(ring)], place, False)] == [100, 98]
    assert [v[0] for v in distance.looked_up([np.array(ring[:2])], place, False)] == [98, 100]
    assert [v[0] for v in distance.looked_up([np.array(ring[:2])], place, True)] == [102, 100]


def test_nearest_in_frames(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 0.0), (1, 3, 400.0, 0.0), (2, 1, -3.0, 7.0), (3, 1, 0.0, 0.0)], "token long, t int, x double, y double")
    cells = spark.createDataFrame([(1, 1, 150, 100), (1, 1, 90, 100), (1, 0, 90, 90), (2, 0, 1, 1), (1, 1, 500, 3), (None, 1, 1, 1)], "token long, layer int, r int, c int")
    assert sorted(tuple(r) for r in distance.nearest(points, cells).collect()) == [(1, 1, 150, 100), (1, 2, 150, 100)]
    found = {(r.token, r.t, r.layer): (r.r, r.c, r.distance) for r in distance.nearest_of_layers(points, cells, 0, 1).collect()}
    assert set(found) == {(1, 1, 0), (1, 1, 1), (1, 2, 0), (1, 2, 1), (2, 1, 0)} and found[1, 1, 1] == (90, 100, 5.0)
    named = points.withColumn("token", F.concat(F.lit("t"), "token")), cells.withColumn("token", F.concat(F.lit("t"), "token"))
    assert {r.token for r in distance.nearest(*named).collect()} == {"t1"}
    assert distance.nearest(points.limit(0), cells).count() == 0


def boxes(n, seed, keys, spread, sizes):
    rng = np.random.default_rng(seed)
    return [(k, int(rng.integers(0, keys)), *(float(v) for v in (x, y, x + w, y + h))) for k, (x, y, w, h) in enumerate(zip(rng.uniform(-spread, spread, n), rng.uniform(-spread, spread, n), rng.choice(sizes, n), rng.choice(sizes, n), strict=True))]


def frames(spark, a, b):
    make = lambda rows, p: spark.createDataFrame(rows, f"{p} long, token long, {p}x double, {p}y double, {p}u double, {p}v double")
    return make(a, "a"), make(b, "b"), *(tuple(F.col(p + c) for c in "xyuv") for p in "ab")


@pytest.mark.parametrize("sizes", [[0.0, 3.0], [0.0, 0.5, 5.0, 40.0, 300.0]])
def test_pairs_that_meet(spark, sizes):
    a, b = boxes(300, 1, 3, 60, sizes), boxes(300, 2, 3, 60, sizes)
    a += [(900, 0, 0.0, 0.0, -1.0, 1.0), (901, 0, float("nan"), 0.0, 1.0, 1.0), (902, 0, None, 0.0, 1.0, 1.0), (903, 0, 0.0, 0.0, float("inf"), 1.0), (904, None, 0.0, 0.0, 1.0, 1.0), (905, 0, 16.0, 16.0, 32.0, 32.0)]
    b += [(905, 0, 32.0, 32.0, 32.0, 32.0)]
    left, right, own, other = frames(spark, a, b)
    got = sorted((r.a, r.b) for r in grid.meeting(left, right, ["token"], own, other).collect())
    ok = lambda k: k < 900 or k == 905
    want = sorted((p[0], q[0]) for p in a for q in b if ok(p[0]) and p[1] == q[1] and max(p[2], q[2]) <= min(p[4], q[4]) and max(p[3], q[3]) <= min(p[5], q[5]))
    assert got == want and (905, 905) in got  # each pair once, touching corners too


def test_pairs_tested_grow_with_the_rows(spark):
    """One crowded key: what the join makes before the last condition stays near-linear when the rows and their area double."""
    tried = []
    for n, spread in ((500, 100), (2000, 200)):
        left, right, own, other = frames(spark, boxes(n, 3, 1, spread, [1.0]), boxes(n, 4, 1, spread, [1.0]))
        a, b = (grid.celled(grid.boxed(rows, box, p, 8.0), p, [], 8.0) for rows, box, p in ((left, own, "_a"), (right, other, "_b")))
        joined = a.join(b, ["token", "_level", "_x", "_y"])
        tried.append(joined.count() / n)
        assert joined.groupBy("_x", "_y").count().agg(F.max("count")).collect()[0][0] < n  # the key's rows are dealt out by place
    assert tried[1] < 2 * tried[0] and tried[1] < 20


def test_collisions_of_long_objects_and_crowds(spark):
    ego = spark.createDataFrame([(1, t, 0.0, 2.0 * t) for t in range(1, 7)], "token long, t int, x double, y double")
    rng = np.random.default_rng(5)
    rows = [(1, k, float(rng.uniform(-80, 80)), float(rng.uniform(-80, 80)), float(rng.choice([1.5, 18.0])), 4.0, float(rng.uniform(0, 3)), 0.25) for k in range(200)]
    objects = spark.createDataFrame(rows, "token long, ord int, x double, y double, dx double, dy double, rot_z double, vx double")
    steps = spatial.waypoints(objects)
    got = {(r.t, r.ord) for r in spatial.object_collisions(ego, steps, objects).collect()}
    reach = {r[1]: max(10.0, (np.hypot(4.084, 1.85) + np.hypot(r[4], r[5])) / 2 + 1) for r in rows}
    want = {(r.t, r.ord) for r in steps.collect() if abs(r.x) < reach[r.ord] and abs(r.y - 2.0 * r.t) < reach[r.ord]}
    assert got == want and len(got) > 20
