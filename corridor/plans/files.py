"""Queries that write tables into the shared folder and read them back: sources and sinks."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corridor.functions.workers import shipped
from corridor.operators import calls, reasoning, text_records
from corridor.plans.reasoning import _MATRIX
from corridor.sources import files, manifest
from corridor.sources.fixtures import view, with_views

_TURNS = "conv_id long, turn int, role string, text string"


def _place(s, name):
    return f"{files.shared_folder(s).rstrip('/')}/corridor-files-{uuid.uuid4().hex}/{name}"


def _turns(s, d):
    return view(s, d, "conversations").selectExpr("cast(conv_id as bigint) AS conv_id", "cast(turn as int) AS turn", "role", "text")


def _schema(s, text):
    return s.createDataFrame([], text).schema


def _arrays(s, d):
    files.write_arrays(_turns(s, d), path := _place(s, "turns.json"))
    return files.read_annotations(s, path, _schema(s, _TURNS)).select("conv_id", "turn", "role", "text")


def _lines(s, d):
    files.write_lines(_turns(s, d), path := _place(s, "turns.jsonl"))
    return files.read_annotations(s, path, _schema(s, _TURNS)).where("_corrupt_record IS NULL").select("conv_id", "turn", "role", "text")


def _payloads(s, d):
    """Compressed lines with payloads in base64, every fifth of them broken."""
    rows = view(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "*broken*").otherwise(F.base64(F.col("p_name").cast("binary"))).alias("payload"))
    rows.write.option("compression", "gzip").json(path := _place(s, "parts.jsonl"))
    read = files.read_annotations(s, path, _schema(s, "p_partkey long, payload string"))
    return files.decoded(read, "payload").select("p_partkey", F.col("bytes").cast("string").alias("name"))


def _table(s, d):
    files.write_table(view(s, d, "part").selectExpr("p_partkey", "p_name", "p_brand"), path := _place(s, "parts.tsv"), "\t")
    return files.read_checked(s, path, _schema(s, "p_partkey long, p_name string, p_brand string"), files.checksums(s, path))


def _stamped(s, d):
    path = files.write_stamped(view(s, d, "nation").selectExpr("n_nationkey", "n_name"), _place(s, "runs"), "nations", "20260101_000000")
    return files.read_annotations(s, path, _schema(s, "n_nationkey int, n_name string"))


def _result(s, d):
    rows = view(s, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).alias("hit"))
    files.write_result(rows, rows.groupBy("lang").agg(F.avg(F.col("hit").cast("int")).alias("accuracy")), path := _place(s, "result"))
    summary = s.read.schema("lang string, accuracy double").json(f"{path}/summary")
    return files.read_table(s, f"{path}/rows", _schema(s, "doc_id long, lang string, hit boolean"), ",").join(summary, "lang").select("doc_id", "lang", "hit", F.round("accuracy", 6).alias("accuracy"))


def _point(s, d):
    view(s, d, "documents").select("doc_id", "n_chars", "source").write.partitionBy("source").parquet(path := _place(s, "documents"))
    return files.point_read(s, path, "source", "src3").select("doc_id", "n_chars")


def _split(s, d):
    files.write_split(_turns(s, d), F.col("role") == "user", path := _place(s, "split"))
    return s.read.schema(f"{_TURNS}, valid boolean").json(path).groupBy("valid", "role").agg(F.count("*").alias("n"))


def _cached(s, d):
    """Counts of a folder that grows: the second call reads the new files alone, the third, after nothing has changed, none."""
    own = view(s, d, "documents").select("doc_id", "lang", "text")
    path, cache = _place(s, "documents"), _place(s, "counts")
    for part in (F.col("doc_id") % 3 == 0, F.col("doc_id") % 3 != 0, F.lit(False)):
        own.where(part).drop("doc_id").write.mode("append").parquet(path)
        out = manifest.file_sums(s, path, own.drop("doc_id").schema, cache, ["lang"], {"words": F.size(F.split("text", " ")).cast("long")})
    return out


def _pickles(s, d):
    def dump(batches):
        import pickle

        for b in batches:
            b = b.sort_values(["token", "t"])
            first = np.flatnonzero(np.diff(b["token"].to_numpy(), prepend=np.nan))
            paths = [dict(zip(b["token"].iloc[first].astype(str), np.split(b[["x", "y"]].to_numpy(), first[1:]), strict=True))]
            yield pd.DataFrame({"content": [pickle.dumps(p) for p in paths] + [b"cos\nsystem\n(S'true'\ntR."]})

    gt = view(s, d, "gt").select("token", "t", "x", "y")
    return files.unpickled(shipped(gt).repartition("token").mapInPandas(_whole(dump), "content binary"), "content")


def _whole(fn):
    """A partition as one batch, so that no token's rows are in two."""
    return lambda batches: fn([b] if len(b := pd.concat(list(batches) or [pd.DataFrame({"token": [], "t": [], "x": [], "y": []})])) else [])


def _calls(s, d):
    """Three rounds of calls with a model that fails by the hash of request and attempt; the clock stands still."""
    def model(b):
        import hashlib

        fails = [int(hashlib.md5(f"{k}|{n}".encode()).hexdigest()[:8], 16) % 2 == 0 for k, n in zip(b["key"], b["attempt"], strict=True)]
        return [None if f else f"{p or 'none'}:{n}" for f, p, n in zip(fails, b["prompt"], b["attempt"], strict=True)]

    requests = view(s, d, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("lang").alias("prompt"))
    path = _place(s, "calls")
    for now in (0.0, 0.5, 1.0, 3.0, 100.0):  # attempts are due at 0, 1 and 3
        calls.call_due(requests, path, model, now, slices=2, clock=lambda: 0.0)
    found = calls.answers(requests, calls.ledger(s, path), F.concat(F.lit("no answer: "), F.coalesce("prompt", F.lit("none"))))
    return found.select("key", "status", "answer")


def _scores(s, d):
    """A fixed function in a model's place."""
    def model(b):
        return pd.DataFrame({"doc_id": b["doc_id"], "score": [len((t or "").split(" ")) % 7 / 8 for t in b["text"]]})

    return text_records.scored(view(s, d, "documents").select("doc_id", "text"), model, "doc_id long, score double")


def _matrix(s, d):
    """The matrix of kinds as a CSV with a header, read back into cells."""
    files.write_table(reasoning.wide(reasoning.matrix(reasoning.pairs(view(s, d, "samples"), "answer"))), path := _place(s, "matrix.csv"))
    kinds = [*reasoning.MARKERS]
    read = files.read_table(s, path, _schema(s, ", ".join(["a string", *(f"c{k} long" for k in range(len(kinds)))])), ",")
    return read.select("a", F.explode(F.arrays_zip(F.array(*map(F.lit, kinds)).alias("b"), F.array(*[F.col(f"c{k}") for k in range(len(kinds))]).alias("n"))).alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.n").alias("n"))


_ROWS = "SELECT conv_id, turn::INT AS turn, role, text FROM conversations"
QUERIES = {
    "json_arrays": (_arrays, _ROWS),
    "json_lines": (_lines, _ROWS),
    "gzip_payloads": (_payloads, "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name FROM part"),
    "checked_table": (_table, "SELECT p_partkey, p_name, p_brand FROM part"),
    "stamped_table": (_stamped, "SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation"),
    "result_files": (_result, "SELECT doc_id, lang, n_chars > 1000 AS hit, round(avg((n_chars > 1000)::INT) OVER (PARTITION BY lang), 6) AS accuracy FROM documents WHERE lang IS NOT NULL"),
    "point_lookup": (_point, "SELECT doc_id, n_chars FROM documents WHERE source = 'src3'"),
    "split_files": (_split, "SELECT role = 'user' AS valid, role, count(*) AS n FROM conversations GROUP BY ALL"),
    "matrix_file": (_matrix, with_views(_MATRIX + " SELECT a, b, sum(n)::BIGINT AS n FROM x GROUP BY a, b", "samples")),
    "call_ledger": (_calls, with_views(""", r AS (SELECT doc_id, coalesce(lang, 'none') AS prompt, list_filter([1, 2, 3], lambda n: ('0x' || substr(md5(doc_id || '|' || n), 1, 8))::BIGINT % 2 <> 0) AS good FROM documents)
SELECT doc_id::VARCHAR AS key, CASE WHEN len(good) > 0 THEN 'answered' ELSE 'given up' END AS status, CASE WHEN len(good) > 0 THEN prompt || ':' || good[1] ELSE 'no answer: ' || prompt END AS answer FROM r""").replace("WITH RECURSIVE ,", "WITH").replace("WITH RECURSIVE \n,", "WITH")),
    "model_scores": (_scores, "SELECT doc_id, (len(string_split(coalesce(text, ''), ' ')) % 7) / 8.0::DOUBLE AS score FROM documents"),
    "cached_counts": (_cached, "SELECT lang, sum(len(string_split(text, ' ')))::BIGINT AS words FROM documents GROUP BY lang"),
    "pickled_paths": (_pickles, with_views("SELECT token::VARCHAR AS token, t, x, y FROM gt", "gt")),
}
