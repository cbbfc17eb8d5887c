"""Operators on vectors and urls against brute force; and odd input."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.llm import components, order_minhash, quantised_dedup, topk_search, url_filter
from corridor.llm.queries import RULES

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[20:60] = x[20] + rng.normal(scale=0.05, size=(40, dim))
    x[100:110] = x[100]
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(900, None, 1), (901, [], 1), (902, [nan] * 24, 1), (903, [inf] + [0.0] * 23, 1), (904, [0.0] * 24, 1), (905, [1.0, None], 1), (906, [1.0] * 24, None), (None, [1.0] * 24, 1), (907, [0.5, 0.5], 1), (908, [0.5, 0.5], 1)]


def frame(spark, x, label=lambda k: k % 3 == 0):
    rows = [(k, [float(v) for v in r], int(label(k))) for k, r in enumerate(x)]
    return spark.createDataFrame(rows + odd_rows(), SCHEMA).withColumn("rank", F.lit("clash"))


def test_top_k(spark):
    x = vectors()
    got = {}
    for r in topk_search.top_k(frame(spark, x), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = np.floor(64 * x.astype(np.float64)).astype(np.int64)
    ids = np.array([*range(300), 904, 906])
    ints = np.vstack([ints, np.zeros((1, 24), np.int64), np.full((1, 24), 64)])
    for q in range(0, 300, 20):
        score = ints @ ints[q]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        assert sorted(got[q]) == [(n, ids[k], score[k]) for n, k in enumerate(order, 1)]
    assert 900 not in got
    assert topk_search.top_k(frame(spark, x).limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_bounds_spare_scores_on_the_given_vectors(spark):
    """With bars from a sample, the levels discard pairs before any exact score, and what is left holds the best."""
    own = topk_search.integers(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), 64).orderBy("vec_id").toPandas()
    ids, x = own["vec_id"].to_numpy(), np.stack(own["v"].to_numpy()).astype(np.int64)
    asked = ids % 20 == 0
    scores = x[asked] @ x.T
    bars = np.sort(scores[:, :: topk_search.SHARE], 1)[:, -21].astype(float)
    seen = {}
    rows, pos, _ = topk_search.best(x[asked], ids[asked], bars, x, ids, 20, seen)
    before, after = seen[32]
    assert before == scores.size and after < 0.85 * before
    scores[ids[asked][:, None] == ids] = scores.min() - 1
    for q in range(asked.sum()):
        assert pos[rows == q].tolist() == np.lexsort((ids, -scores[q]))[:20].tolist()


def test_top_k_of_few_and_repeated_rows(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1)], SCHEMA)
    assert [(r["rank"], r.vec_id) for r in topk_search.top_k(rows, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 1), (2, 1), (3, 2)]


def test_bounds_lose_nothing(monkeypatch):
    monkeypatch.setattr(topk_search, "TILE", 256)
    rng = np.random.default_rng(5)
    for scale in (64, 2**28):  # whole numbers that products of doubles hold exactly, and others
        q, c = rng.integers(-scale, scale + 1, (30, 40)), rng.integers(-scale, scale + 1, (3000, 40))
        c[:200] = q[0] + rng.integers(-3, 4, (200, 40))
        c[500:560] = c[400]  # ties
        true = [np.lexsort((np.arange(3000), -(c @ q[k])))[:20] for k in range(30)]
        kth = np.array([(c @ q[k])[t[-1]] for k, t in enumerate(true)], float)
        for bars in (np.full(30, -np.inf), kth, kth - 5):
            rows, pos, score = topk_search.best(q, np.arange(30) + 10**6, bars, c, np.arange(3000), 20)
            assert all(pos[rows == k].tolist() == true[k].tolist() and score[rows == k].tolist() == (c @ q[k])[true[k]].tolist() for k in range(30))


def test_smooth_vectors_are_pruned(monkeypatch):
    monkeypatch.setattr(topk_search, "TILE", 256)
    rng = np.random.default_rng(6)
    c = np.rint(np.cumsum(rng.normal(size=(4000, 64)), 1) * 8).astype(np.int64)
    q, seen = c[::100], {}
    bars = np.array([np.sort(c @ v)[-20] for v in q], float)
    rows, pos, _ = topk_search.best(q, np.arange(len(q)) + 10**6, bars, c, np.arange(4000), 20, seen)
    assert all(pos[rows == k].tolist() == np.lexsort((np.arange(4000), -(c @ v)))[:20].tolist() for k, v in enumerate(q))
    assert seen[4][1] < 0.3 * seen[4][0] and min(n for _, n in seen.values()) < 0.1 * len(q) * len(c)


def test_top_k_in_blocks_and_with_bars(spark, monkeypatch):
    for name, value in (("QUERIES", 7), ("CANDIDATES", 90), ("SAMPLE", 60), ("TILE", 32)):
        monkeypatch.setattr(topk_search, name, value)
    test_top_k(spark)


def brute(x, labels, threshold=0.98):
    v = x.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    link = (v @ v.T >= threshold) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(link, root, 10**9).min(1))
        if (new == root).all():
            return link.sum(1), root
        root = new


def test_near_duplicate_vectors(spark):
    x = vectors()
    got = {r.vec_id: r for r in quantised_dedup.near_duplicates(frame(spark, x)).collect()}
    n, root = brute(x, np.array([k % 3 == 0 for k in range(300)]))
    assert n.max() > 5 and all((got[k].n_links, got[k].component_id, got[k].kept) == (n[k], root[k], root[k] == k) for k in range(300))
    assert all((got[k].n_links, got[k].component_id) == (0, k) for k in (900, 901, 902, 903, 904, 905, 906))
    assert (got[907].n_links, got[908].component_id, got[None].kept) == (1, 907, False)
    assert quantised_dedup.near_duplicates(frame(spark, x).limit(0)).count() == 0


def test_tiles_of_two_blocks(spark, monkeypatch):
    monkeypatch.setattr(quantised_dedup, "BLOCK", 40)
    x = vectors(seed=2)
    got = {r.vec_id: r for r in quantised_dedup.near_duplicates(frame(spark, x, lambda k: True)).collect()}
    n, root = brute(x, np.ones(300))
    assert all((got[k].n_links, got[k].component_id) == (n[k], root[k]) for k in range(300))


def test_error_bounds_hold():
    x = vectors(200, 64, 9).astype(np.float64)
    a = quantised_dedup.Quantised(x)
    exact = (a.x @ a.x.T) / np.outer(a.norm, a.norm)
    near = (a.q.astype(float) @ a.q.T.astype(float)) * np.outer(a.scale, a.scale)
    assert (np.abs(exact - near) <= a.error[:, None] + (1 + a.error[:, None]) * a.error + 1e-9).all()


def test_components(spark):
    rng = random.Random(2)
    path = list(range(500))
    rng.shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((1000, k) for k in range(1001, 1200)), (5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(500)}, **{k: 1000 for k in range(1000, 1200)}, 2000: 2000, 2001: 2000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared_counts():
    rng = np.random.default_rng(3)
    sides = [[np.unique(rng.integers(0, 500, rng.integers(0, 80))).astype(np.uint32) for _ in range(20)] for _ in range(2)]
    assert order_minhash.shared(tuple(sides)).tolist() == [[len(np.intersect1d(a, b)) for b in sides[1]] for a in sides[0]]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org", "http://example.org/es/1", "https://a.example.org/es/", "http://badexample.org/es/", "ftp://x.example.org/en/12?q", "http://example.org/en/2", "http://a.com/fr/", "http://com/de/#x", "http://é.de.com/de/x", "a://b://c.org/", "http://org/\nx", "http://u@h.com:80/de/"]
    rows = spark.createDataFrame([(k, u, "x") for k, u in enumerate([*urls, *urls[:5]])] + [(None, "http://a.org/", "y")], "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(rows, RULES).collect()), key=str)
    import re

    want = []
    for k, u, _ in rows.collect():
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1], m[2]) if m else ("", "")
        host = host.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        fits = [(len(r), r, v) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=(0, None, "allow"))
        want.append((k, host, path, best[1], best[2]))
    assert got == sorted(want, key=str)
    assert url_filter.judge(rows.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(rows, []).collect()} == {"allow"}


def test_urls_in_parts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MOST", 1)
    test_urls(spark)


def test_rules_of_a_table_and_long_urls(spark):
    rows = spark.createDataFrame([(1, "http://a.org/" + "x/" * 50_000), (2, "http://" + "s." * 200 + "a.org/y"), (3, "http://b.org/")], "page_id long, url string")
    rules = spark.createDataFrame([("block", "a.org/x/"), ("allow", "a.org/"), ("block", None), ("block", "a.org/")], "verdict string, rule string")
    assert [(r.rule, r.verdict) for r in url_filter.judge(rows, rules, "other").orderBy("page_id").collect()] == [("a.org/x/", "block"), ("a.org/", "allow"), (None, "other")]


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where(F.pmod(F.xxhash64("key"), F.lit(11)) == 0)
    own = url_filter.cascade(listed, universe)
    assert len(own.levels) > 1
    wrong = universe.where(own.lists(F.col("key")) != (F.pmod(F.xxhash64("key"), F.lit(11)) == 0))
    assert wrong.count() == 0
    assert url_filter.cascade(listed.limit(0), universe).levels == []


def test_hosts_of_many_labels_have_few_keys(spark):
    """As many keys as rules have shapes, whatever the host: no parent domains that no rule could name."""
    hosts = ["a.b.c", "c", "", "x." * 100_000 + "b.c", "." * 50, "b.c"]
    rows = spark.createDataFrame([(k, f"http://{h}/en/1") for k, h in enumerate(hosts)], "page_id long, url string")
    rules = [("block", "b.c/en/"), ("allow", "c/"), ("block", "z.b.c/en/1")]
    host, path = url_filter.host_and_path(F.col("url"))
    own = rows.select("page_id", url_filter.keys(host, path, [(1, 1), (2, 4), (3, 5)]).alias("k")).collect()
    assert {r.page_id: list(r.k) for r in own} == {
        0: ["c/", "b.c/en/", "a.b.c/en/1"], 1: ["c/"], 2: ["/"], 3: ["c/", "b.c/en/", "x.b.c/en/1"], 4: ["/", "./en/", "../en/1"], 5: ["c/", "b.c/en/"],
    }
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(rows, rules, "none").collect()} == {0: ("b.c/en/", "block"), 1: ("c/", "allow"), 2: (None, "none"), 3: ("b.c/en/", "block"), 4: (None, "none"), 5: ("b.c/en/", "block")}
