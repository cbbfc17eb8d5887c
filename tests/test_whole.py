"""Queries and operators that must do the whole job, against definitions written out here."""

import math
import os

import pytest
from pyspark.sql import functions as F

from corridor.operators import spatial
from corridor.plans import catalogue
from corridor.sources.fixtures import view

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@tables
def test_every_scene_has_an_ego_path_of_its_own(spark):
    from corridor.plans import spatial as plans

    paths = lambda rows: {r.token: tuple(map(tuple, r.p)) for r in rows.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("t", "x", "y"))).alias("p")).collect()}
    ego, real = paths(plans._ego(spark, DATA)[0]), paths(view(spark, DATA, "gt"))
    scenes = {r.token for r in view(spark, DATA, "objects").select("token").distinct().collect()}
    assert set(ego) == scenes and set(ego.values()) <= set(real.values())
    found = catalogue.queries()["combined_collision"](spark, DATA).collect()
    assert sorted((r.token, r.t) for r in found) == sorted((k, t) for k in scenes for t in range(1, 7))


def scene(spark, *boxes):
    """An ego vehicle at the origin, and boxes (x, y, dx, dy, angle) at step 1."""
    objects = spark.createDataFrame([(1, k, *map(float, b)) for k, b in enumerate(boxes)], "token long, ord int, x double, y double, dx double, dy double, rot_z double")
    return spark.createDataFrame([(1, 1, 0.0, 0.0)], "token long, t int, x double, y double"), objects.select("token", "ord", F.lit(1).alias("t"), "x", "y"), objects


def test_long_objects_collide_from_afar(spark):
    # half lengths 9 and 2.042: overlaps; 0.258 m apart; 1.96 m apart; a small box near by; turned by a quarter, 0.275 m apart; too far
    boxes = [(0, 10.5, 2.5, 18, 0), (0, 11.3, 2.5, 18, 0), (0, 13, 2.5, 18, 0), (8, 0, 2, 4, 0), (10.2, 0, 2.5, 18, 1.5707963267948966), (30, 30, 2.5, 18, 0)]
    found = {r.ord: r for r in spatial.object_collisions(*scene(spark, *boxes), margin=0.5).collect()}
    assert {k for k, r in found.items() if r.overlaps} == {0} and {k for k, r in found.items() if r.collides} == {0, 1, 4}
    assert found[1].distance == pytest.approx(0.258) and 3 in found and 5 not in found


def test_one_margin_of_a_metre_for_both_detectors(spark):
    ego, steps, objects = scene(spark, (0, 5.742, 2, 6, 0))  # 0.7 m ahead
    occ = spark.createDataFrame([(1, 1, 104, 100, 1.0)], "token long, t int, r int, c int, p double")
    hits = lambda rows: [r.collides for r in rows.collect()]
    assert hits(spatial.object_collisions(ego, steps, objects)) == [True] and hits(spatial.object_collisions(ego, steps, objects, 0.5)) == [False]
    assert hits(spatial.combined_collision(ego, occ, steps, objects)) == [True] and hits(spatial.combined_collision(ego, occ, steps, objects, 0.5)) == [False]


def filled(x, y, dx, dy, angle):
    """Cells of a box: the polygon of its quantised corners with its border, and the cells nearest to its edges, found step by step along each."""
    turned = [(x + a * dx * math.cos(angle) + b * dy * math.sin(angle), y - a * dx * math.sin(angle) + b * dy * math.cos(angle)) for a, b in ((0.5, 0.5), (0.5, -0.5), (-0.5, -0.5), (-0.5, 0.5))]
    p = [(int(200 * (u + 50.25) / 100), int(200 * (v + 50.25) / 100)) for u, v in turned]
    out = set()
    for (a, b), (c, d) in zip(p, p[1:] + p[:1], strict=True):
        n = max(abs(c - a), abs(d - b))
        for k in range(n + 1):
            for half in (-1e-9, 1e-9):  # of two cells that are equally near, both
                u, v = (a + (c - a) * k / n, b + (d - b) * k / n) if n else (a, b)
                out.add((math.floor(u + 0.5 + half), math.floor(v + 0.5 + half)))
    for c in range(min(q[0] for q in p), max(q[0] for q in p) + 1):
        for r in range(min(q[1] for q in p), max(q[1] for q in p) + 1):
            turns = [(e[0] - s[0]) * (r - s[1]) - (e[1] - s[1]) * (c - s[0]) for s, e in zip(p, p[1:] + p[:1], strict=True)]
            if min(turns) >= 0 or max(turns) <= 0:
                out.add((c, r))
    return {(r, c) for c, r in out if 0 <= c < 200 and 0 <= r < 200}


@tables
def test_detections_fill_all_six_steps(spark):
    want = {}
    for o in view(spark, DATA, "objects").limit(1500).collect():
        for t in range(1, 7):
            for k in (0, 1) if t == 1 else (t,):
                want.setdefault((o.token, k), set()).update(filled(o.x + t * o.vx, o.y + t * 0.5, o.dx, o.dy, o.rot_z))
    some = view(spark, DATA, "objects").limit(1500)
    got = {}
    for r in spatial.cells_of_boxes(spatial.waypoints(some), some).collect():
        assert (r.r, r.c) not in got.setdefault((r.token, r.t), set())
        got[r.token, r.t].add((r.r, r.c))
    assert {t for _, t in got} == set(range(7)) and got == {k: v for k, v in want.items() if v}


@tables
def test_contents_of_all_events_get_results(spark):
    events = view(spark, DATA, "events").select("user_id", "event_id", "event_type").collect()
    last, want = {}, {}
    for e in sorted(events, key=lambda e: e.event_id):
        last[e.user_id, e.event_id % 10] = (e.event_id, e.event_type)
    for e in events:
        if found := last.get((e.user_id, k := e.event_id // 50 % 10)):
            want[e.user_id, f"at {k}"] = found[1]
    got = {(r.user_id, r.content): r.result for r in catalogue.queries()["result_times"](spark, DATA).collect()}
    assert got == want and {u for u, _ in got} > {e.user_id for e in events if e.event_id % 50 == 0 and (e.user_id, e.event_id // 50 % 10) in last}


@tables
def test_documents_keep_their_sizes_in_bins(spark, tmp_path):
    docs = view(spark, DATA, "documents").withColumn("n_chars", F.when(F.col("doc_id") % 10 == 0, F.col("n_chars") + 20000).otherwise(F.col("n_chars")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sizes, want = {r.doc_id: r.n_chars // 4 for r in docs.collect()}, {}
    for batch in {k // 256 for k in sizes}:
        room = []
        for k in sorted((k for k in sizes if k // 256 == batch), key=lambda k: (-sizes[k], k)):
            fits = [(r, b) for b, r in enumerate(room) if r >= sizes[k]]
            b = min(fits)[1] if fits else len(room)
            room += [] if fits else [4096]
            room[b] -= sizes[k]
            want[k] = (sizes[k], batch, b)
    got = {r.key: (r.size, r.batch_id, r.bin) for r in catalogue.queries()["pack_bins"](spark, str(tmp_path)).collect()}
    assert got == want and max(sizes.values()) > 4096
