"""Image headers, histories, call ledgers, manifests and substring joins, each against a plain form or by hand."""

import base64
import hashlib
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corridor.functions import images
from corridor.operators import calls, history, text_records
from corridor.sources import manifest


def png(w, h, kind):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * 10)) + chunk(b"IEND", b"")


def jpeg(w, h, n, frame=0xC0, before=b""):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + before + bytes([0xFF, frame]) + struct.pack(">HBHHB", 8 + 3 * n, 8, h, w, n) + b"\0" * (3 * n)


CASES = [
    (png(640, 480, 2), ("png", 640, 480, 3)), (png(1, 70_000, 6), ("png", 1, 70_000, 4)), (png(3, 4, 0), ("png", 3, 4, 1)), (png(3, 4, 3), ("png", 3, 4, 1)), (png(3, 4, 4), ("png", 3, 4, 2)), (png(0, 4, 2), None), (png(3, 4, 5), None),
    (jpeg(1920, 1080, 3), ("jpeg", 1920, 1080, 3)), (jpeg(5, 6, 1, 0xC2), ("jpeg", 5, 6, 1)), (jpeg(5, 6, 4, 0xC1, b"\xff\xff\xe1\x00\x04\xff\xc0\xff\xd0\xff\xc4\x00\x03\x00"), ("jpeg", 5, 6, 4)),
    (jpeg(5, 6, 3)[:24], None), (b"\xff\xd8\xff\xda\x00\x02", None), (b"\xff\xd8\xff\xe0\x00\x00", None), (b"\xff\xd8\x00", None), (b"\xff\xd8\xff\xe1\xff\xff" + b"x" * 9, None),
    (b"GIF89a" + struct.pack("<HH", 320, 200), ("gif", 320, 200, 1)), (b"GIF87a" + struct.pack("<HH", 1, 2) + b"junk", ("gif", 1, 2, 1)), (b"GIF89a\1", None),
    (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 800 | 0x4000, 600), ("webp", 800, 600, 3)), (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 99 | 49 << 14 | 1 << 28), ("webp", 100, 50, 4)),
    (b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\0\0\0\0" + (4095).to_bytes(3, "little") + (2047).to_bytes(3, "little"), ("webp", 4096, 2048, 3)), (b"RIFF\0\0\0\0WEBPnone", None), (b"", None), (None, None), (b"plain text", None), (b"\x89PNG\r\n\x1a\n", None),
]


def test_headers(spark, tmp_path):
    rows = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(CASES)], "k int, content binary").withColumn("format", F.lit("clash"))
    got = {r.k: tuple(r.image) if r.image else None for r in images.with_headers(rows, "content").collect()}
    assert got == {k: want for k, (_, want) in enumerate(CASES)}
    for k, (b, _) in enumerate(CASES):
        if b:
            (tmp_path / f"{k}.img").write_bytes(b)
    files = images.with_headers(spark.read.format("binaryFile").load(str(tmp_path)), "content")
    assert {int(os.path.basename(r.path)[:-4]): tuple(r.image) if r.image else None for r in files.select("path", "image").collect()} == {k: w for k, (b, w) in enumerate(CASES) if b}
    assert images.with_headers(rows.limit(0), "content").count() == 0


def test_data_uris(spark):
    good = base64.b64encode(png(2, 3, 2)).decode()
    rows = spark.createDataFrame([(1, f"data:image/png;base64,{good}"), (2, "data:image/png;base64,***"), (3, "https://a/b.png"), (4, None), (5, f"data:image/png;x=y;base64,{good}"), (6, "data:image/png,plain")], "k int, v string")
    found = images.with_headers(rows.select("k", images.image_bytes(F.col("v")).alias("content")), "content")
    assert {r.k: r.image.width if r.image else None for r in found.collect()} == {1: 2, 2: None, 3: None, 4: None, 5: 2, 6: None}


def plain_history(turns, budget):
    """Drop the first turn, then those up to the next of the user's, until the rest fits."""
    left = sorted(turns)
    while left and sum(n for _, _, n in left) > budget:
        left = left[1:]
        while left and left[0][1] != "user":
            left = left[1:]
    return left


@pytest.mark.parametrize("stretch", [1024, 3])
def test_histories(spark, stretch, monkeypatch):
    monkeypatch.setattr(history, "STRETCH", stretch)
    rng = np.random.default_rng(1)
    talks = {c: [(t, str(rng.choice(["user", "assistant", "system"])), int(rng.integers(0, 30))) for t in range(rng.integers(1, 25))] for c in range(60)}
    talks[100] = [(0, "user", 500)]
    talks[101] = [(0, "assistant", 60)]
    talks[102] = [(-5, "user", 90), (7, "assistant", 0), (9, "user", 60)]
    rows = [(c, t, r, n) for c, own in talks.items() for t, r, n in own] + [(None, 1, "user", 1), (103, None, "user", 1), (104, 1, "user", None), (104, 2, None, 60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, tokens long").withColumns({"_first": F.lit("clash"), "text": F.lit("kept")})
    got = {}
    for r in history.within_budget(turns, 60).collect():
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.tokens))
    assert {c: sorted(v) for c, v in got.items() if c < 103} == {c: v for c, own in talks.items() if (v := plain_history(own, 60))}
    assert sorted(got[104], key=str) == [(1, "user", 0), (2, None, 60)] and not {None, 103} & set(got)
    assert history.within_budget(turns.limit(0), 60).count() == 0


def test_equal_turns_stay_together(spark):
    rows = [(1, 0, "user", 10), (1, 1, "user", 30), (1, 1, "user", 30), (1, 2, "assistant", 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, tokens long")
    assert sorted((r.turn, r.tokens) for r in history.within_budget(turns, 65).collect()) == [(1, 30), (1, 30), (2, 5)]
    assert history.within_budget(turns, 64).count() == 0  # the later of the two alone would fit


def outcome(key, attempt):
    return int(hashlib.md5(f"{key}|{attempt}".encode()).hexdigest()[:8], 16) % 3 != 0


def fake(log):
    def answered(key, attempt):  # as outcome, for workers that don't know this module
        import hashlib

        return int(hashlib.md5(f"{key}|{attempt}".encode()).hexdigest()[:8], 16) % 3 != 0

    def model(b):
        with open(log, "a") as f:
            f.writelines(f"{k} {n}\n" for k, n in zip(b["key"], b["attempt"], strict=True))
        if "bad" in set(b["key"]):
            raise RuntimeError("no answer")
        return [f"{p}!" if answered(k, n) else None for k, n, p in zip(b["key"], b["attempt"], b["prompt"], strict=True)]

    return model


def test_ledger(spark, tmp_path):
    path, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    rows = spark.createDataFrame([(str(k), f"p{k}") for k in range(60)] + [("7", "p7"), (None, "x"), ("bad", "b")], "key string, prompt string").withColumn("status_", F.lit("clash"))
    done, due = set(), {0: 0.0, 1: 2.0, 2: 6.0}
    for n, now in due.items():
        assert calls.call_due(rows, path, fake(log), now, wait=2.0, slices=3, batch=1, clock=lambda: 0.0) == 3
        assert calls.call_due(rows, path, fake(log), now + 1, wait=2.0, slices=3, batch=1, clock=lambda: 0.0) == 0  # none is due
        done |= {str(k) for k in range(60) if outcome(k, n + 1)}
        assert {r.key for r in calls.states(rows, calls.ledger(spark, path)).where("status = 'answered'").collect()} == done
    asked = [line.split() for line in open(log)]
    assert len(asked) == len({tuple(a) for a in asked})  # nothing twice, the repeated key neither
    assert calls.call_due(rows, path, fake(log), 1e9, wait=2.0, slices=3) == 0  # answered or given up
    got = calls.answers(rows, calls.ledger(spark, path), F.concat(F.lit("none for "), "prompt")).collect()
    assert len(got) == 63
    assert {(r.key, r.answer) for r in got} == {(str(k), f"p{k}!" if str(k) in done else f"none for p{k}") for k in range(60)} | {("bad", "none for b"), (None, None)}


def test_killed_job_repeats_no_answer(spark, tmp_path):
    """A job that dies between slices leaves those that are committed; one that dies within a slice leaves files without a mark, which are not read."""
    path, log = str(tmp_path / "ledger"), str(tmp_path / "log")
    rows = spark.createDataFrame([(str(k), "p") for k in range(40)], "key string, prompt string")
    calls.call_due(rows.where(F.pmod(F.xxhash64("key"), F.lit(4)) < 2), path, fake(log), 0.0, slices=4, clock=lambda: 0.0)
    before = {r.key for r in calls.ledger(spark, path).where("status = 'answered'").collect()}
    calls.ledger(spark, path).withColumn("key", F.lit("ghost")).write.parquet(f"{path}/slice-broken")
    os.remove(f"{path}/slice-broken/_SUCCESS")
    open(log, "w").close()
    calls.call_due(rows, path, fake(log), 0.0, slices=4, clock=lambda: 0.0)
    asked = {line.split()[0] for line in open(log)}
    assert before and not before & asked and "ghost" not in {r.key for r in calls.ledger(spark, path).collect()}
    assert {r.key for r in calls.ledger(spark, path).collect()} == {str(k) for k in range(40)}


def test_late_answers_do_not_count(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p")], "key string, prompt string")

    def clock(ticks=iter(range(0, 10**6, 100))):
        return float(next(ticks))

    calls.call_due(rows, str(tmp_path), lambda b: ["x"], 5.0, deadline=60.0, wait=1.0, slices=1, clock=clock)
    row = calls.ledger(spark, str(tmp_path)).first()
    assert (row.status, row.answer, row.seconds) == ("late", None, 100.0)
    assert calls.states(rows, calls.ledger(spark, str(tmp_path))).first().due == 106.0
    assert calls.ledger(spark, str(tmp_path / "none")).count() == 0


def test_manifest(spark, tmp_path):
    path, cache = str(tmp_path / "a table"), str(tmp_path / "cache")
    add = lambda rows: spark.createDataFrame(rows, "k string, n long").coalesce(1).write.mode("append").parquet(path)
    schema = spark.createDataFrame([], "k string, n long").schema
    sums = lambda: {r.k: (r.n, r.rows) for r in manifest.file_sums(spark, path, schema, cache, ["k"], {"n": F.col("n"), "rows": F.lit(1).cast("long")}).collect()}
    counted = lambda: sorted(spark.read.parquet(*manifest.generations(spark, cache)).groupBy("path").count().select("count").toPandas()["count"])
    add([("a", 1), ("b", 2), (None, 7)])
    add([])
    assert sums() == {"a": (1, 1), "b": (2, 1), None: (7, 1)} and len(counted()) == 2  # a file without rows is counted, too
    add([("a", 10)])
    assert sums() == {"a": (11, 2), "b": (2, 1), None: (7, 1)} and counted() == [1, 1, 1]  # the new file alone
    assert sums()["a"] == (11, 2) and len(manifest.generations(spark, cache)) == 2
    first = next(f for f in os.listdir(path) if f.endswith(".parquet") and spark.read.parquet(f"{path}/{f}").where("k = 'b'").count())
    os.remove(f"{path}/{first}")
    assert sums() == {"a": (10, 1)}
    os.rename(manifest.generations(spark, cache)[0].removeprefix("file:"), f"{cache}/generation-x")
    os.remove(f"{cache}/generation-x/_SUCCESS")  # as if a job had been killed
    assert sums() == {"a": (10, 1)}


def test_manifest_written_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "MANY", 2)
    path, cache = str(tmp_path / "t"), str(tmp_path / "c")
    for k in range(5):
        spark.createDataFrame([("a", k)], "k string, n long").coalesce(1).write.mode("append").parquet(path)
        found = manifest.file_sums(spark, path, spark.read.parquet(path).schema, cache, ["k"], {"n": F.col("n")}).collect()
        assert [r.n for r in found] == [sum(range(k + 1))] and len(manifest.generations(spark, cache)) <= 2


def plain_times(results, contents):
    out = {}
    for key, content in contents:
        if content is not None:
            own = [(p, r) for k, t, r, p in results if k == key and t is not None and p is not None and t in content]
            if own:
                out[key, content] = max(own)[1]
    return out


def test_times_in_contents(spark):
    rng = np.random.default_rng(2)
    results = [(int(rng.integers(0, 3)), str(rng.choice(["1.5", "5", "15", "é2", "<3 seconds>", "0"])), f"r{k}", int(rng.integers(0, 50)) * 100 + k) for k in range(60)] + [(0, None, "x", 1), (0, "", "empty", -1), (1, "5", "y", None)]
    contents = [(int(rng.integers(0, 4)), f"at {rng.integers(0, 30) / 2} é2"[: rng.integers(0, 12)]) for _ in range(50)] + [(0, None), (0, ""), (2, "<3 seconds>"), (2, "<3 seconds>")]
    r = spark.createDataFrame(results, "k int, time string, result string, place long")
    c = spark.createDataFrame(contents, "k int, content string")
    assert {(x.k, x.content): x.result for x in text_records.matched_times(r, c, "k").collect()} == plain_times(results, contents)
    assert text_records.matched_times(r.limit(0), c, "k").count() == 0 and text_records.matched_times(r, c.limit(0), "k").count() == 0


def test_hot_key_of_times_is_linear(spark):
    """20,000 results and 20,000 contents of one key: all pairs would be 400 million rows."""
    r = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") % 9000 + 1000).cast("string").alias("time"), F.col("id").cast("string").alias("result"), F.col("id").alias("place"))
    c = spark.range(20_000).select(F.lit(1).alias("k"), F.concat(F.lit("at "), F.col("id").cast("string"), F.lit(" s")).alias("content"))
    got = text_records.matched_times(r, c, "k")
    assert got.count() == 20_000 - 1000  # ids from 1000 on hold a time of four digits
    assert got.where("content = 'at 1500 s'").first().result == "18500" and got.where("content = 'at 19999 s'").first().result == "18999"
