"""Vector codes and whitened vectors against plain forms, and odd input."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.llm import lloyd_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(k), [float(v) for v in r], None if k % 5 == 0 else int(k % 3)) for k, r in zip(ids, x, strict=True)]
    odd = [(900, None, 1), (901, [], 1), (902, [NAN] * x.shape[1], 1), (903, [INF] + [0.0] * (x.shape[1] - 1), 1), (904, [None] + [1.0] * (x.shape[1] - 1), 1), (905, [1.0, 2.0], 1)]
    return spark.createDataFrame(rows + odd, SCHEMA).withColumns({c: F.lit("clash") for c in ("code", "error", "entry", "x", "key", "n")})


def plain_codes(x, labels, parts=8, entries=16, rounds=6):
    v = np.floor(4096 * x.astype(np.float64)).astype(np.int64).reshape(len(x), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()
    near = lambda p: ((v[:, p, None, :] - books[p][None]) ** 2).sum(2).argmin(1)
    for _ in range(rounds):
        for p in range(parts):
            a = near(p)
            for e in range(len(books[p])):
                if (a == e).any():
                    books[p][e] = v[a == e, p].sum(0) // (a == e).sum()
    code = np.stack([near(p) for p in range(parts)], 1)
    error = sum(((v[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
    by = {lab: int(sum(e for e, m in zip(error, labels, strict=True) if m == lab)) for lab in set(labels)}
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    return [(k, "".join(f"{e:02x}" for e in code[k]), int(error[k]), by[labels[k]], digest) for k in range(len(x))]


@pytest.mark.parametrize("n", [200, 9])
def test_codes(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 24)).astype(np.float32)
    x[n // 2 :] = x[: n - n // 2] + rng.choice([0, 0.01], size=(n - n // 2, 1)).astype(np.float32)  # repeated vectors, and ties
    got = sorted(tuple(r) for r in lloyd_codes.codes(table(spark, x)).collect())
    assert got == plain_codes(x, [None if k % 5 == 0 else k % 3 for k in range(n)])


def test_codes_by_joined_labels_and_empty(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(60, 16)).astype(np.float32)
    monkeypatch.setattr(lloyd_codes, "FEW_LABELS", 1)
    assert sorted(tuple(r) for r in lloyd_codes.codes(table(spark, x)).collect()) == plain_codes(x, [None if k % 5 == 0 else k % 3 for k in range(60)])
    assert lloyd_codes.codes(table(spark, x).limit(0)).count() == 0
    assert lloyd_codes.codes(table(spark, x).where("embedding IS NULL")).count() == 0


def test_bounds_skip_scans_and_keep_ties():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (4000, 4)) + 400 * rng.integers(0, 12, (4000, 1))
    books = x[:12].copy()
    near, upper, lower = lloyd_codes.scanned(x, books)
    shares = []
    for _ in range(8):
        now = np.array([x[near == e].sum(0) // max(1, (near == e).sum()) if (near == e).any() else books[e] for e in range(12)])
        near, upper, lower, hit = lloyd_codes.assigned(x, near, upper, lower, books, now)
        d = ((x[:, None] - now[None]) ** 2).sum(2)
        assert (near == d.argmin(1)).all()
        true = np.sort(np.sqrt(d), 1)
        assert (upper >= true[:, 0]).all() and (lower <= true[:, 1]).all()
        shares.append(hit.mean())
        books = now
    assert shares[-1] < 0.5


def test_equal_distances_go_to_the_lower_index():
    books = np.array([[10], [-10], [10]])
    near, upper, lower, _ = lloyd_codes.assigned(np.array([[0], [10]]), np.array([1, 2]), np.array([10.0, 0.0]), np.array([10.0, 0.0]), books, books)
    assert near.tolist() == [0, 0]


def test_distances_beyond_doubles():
    x, e = np.array([[2**28 + 1, -5]]), np.array([[-(2**28), 7], [2**28, -4]])
    assert lloyd_codes.distances(x, e).tolist() == [[(2**29 + 1) ** 2 + 144, 2]]


def test_pairs_of_doubles_are_exact():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=500) * 10.0 ** rng.integers(-8, 8, 500), rng.normal(size=500)
    for (s, e), want in ((whitening.two_sum(a, b), [Fraction(x) + Fraction(y) for x, y in zip(a, b, strict=True)]), (whitening.two_product(a, b), [Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True)])):
        assert [Fraction(x) + Fraction(y) for x, y in zip(s, e, strict=True)] == want
    high, low = whitening.total(a, np.zeros(500))
    assert abs(Fraction(float(high)) + Fraction(float(low)) - sum(map(Fraction, a))) <= Fraction(1, 10**26) * sum(abs(Fraction(v)) for v in a)


def plain_whitened(x):
    v = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    fit = np.unique(v, axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    c = [[Fraction(int(a)) - Fraction(s, n) for a, s in zip(r, sums, strict=True)] for r in fit]
    cov = np.array([[float(sum(r[i] * r[j] for r in c) / n) for j in range(x.shape[1])] for i in range(x.shape[1])])
    return v, n, sums, cov


def test_whitened(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(80, 6)) * [3, 2, 1.5, 1, 0.5, 0.2] + 40).astype(np.float32)
    x[50:] = x[7]  # copies count once
    v, n, sums, cov = plain_whitened(x)
    values, vectors = np.linalg.eigh(cov)
    rows = whitening.whitened(table(spark, x)).toPandas().sort_values(["vec_id", "component"])
    assert len(rows) == 4 * 80 and set(rows["n"]) == {n} and rows["identity_error"].nunique() == 1 and rows["identity_error"].max() < 1e-12
    assert rows[rows["component"] == 1]["deviation"].tolist() == [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in v]
    for k in range(1, 5):
        own, e = rows[rows["component"] == k], values[-k]
        want = np.array([[float(Fraction(int(a)) - Fraction(s, n)) for a, s in zip(r, sums, strict=True)] for r in v]) @ vectors[:, -k] / np.sqrt(e)
        got = own["whitened"].to_numpy()
        assert np.allclose(got * np.sign(got @ want), want, rtol=0, atol=1e-10)
        assert np.allclose(own["explained"], e / values.sum(), rtol=1e-12)


def test_covariance_keeps_what_doubles_lose():
    """Far from the origin the sum of squares cancels; centred pairs don't."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (300, 5)) + 2**40
    sums, at = [int(s) for s in x.sum(0)], np.triu_indices(5)
    high, low = np.zeros(15), np.zeros(15)
    for k in range(0, 300, 70):
        high, low = whitening.added(high, low, *whitening.outer(*whitening.centred(x[k : k + 70], sums, 300), at))
    for i, j, h, e in zip(*at, high, low, strict=True):
        true = sum((Fraction(int(r[i])) - Fraction(sums[i], 300)) * (Fraction(int(r[j])) - Fraction(sums[j], 300)) for r in x)
        assert abs(Fraction(float(h)) + Fraction(float(e)) - true) <= Fraction(1, 10**24)


def test_whitening_of_little(spark):
    few = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]], np.float32)
    rows = whitening.whitened(table(spark, few).where("vec_id < 900")).collect()
    assert {r.component for r in rows} == {1} and len(rows) == 3  # one direction alone has a spread
    assert whitening.whitened(table(spark, few).limit(0)).count() == 0
    assert whitening.whitened(table(spark, few[:1]).where("vec_id = 0")).count() == 0
    assert whitening.deviations(np.array([[2**40]]), [0], 2**10) == [None]
    assert whitening.deviations(np.array([[2**31]]), [0], 1) == [2**62]
