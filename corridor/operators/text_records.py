"""Records inside text: front objects and their waypoints, boxes, matches of results to contents."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corridor.functions.formats import TRAJECTORIES
from corridor.functions.trajectory_text import fenced_json
from corridor.functions.workers import shipped

#: The forms of an object's line and of a waypoint list.
OBJECT = r"object type: (\w+), object id: (\d+), position: \((-?[\d.]+), (-?[\d.]+)\), size: \((-?[\d.]+), (-?[\d.]+)\)"
PLACE = r"\((-?[\d.]+),\s*(-?[\d.]+)\)"
FUTURE = r"object id:\s*(\d+)[^\n\r\x85\u2028\u2029]*?future waypoint coordinates[^\n\r\x85\u2028\u2029]*?:\s*(\[[^\n\r\x85\u2028\u2029]*?\])"  # no point of Java's meets an end of line
FUTURE_OF, PLACE_OF = re.compile(FUTURE, re.ASCII), re.compile(PLACE, re.ASCII)


def lines(rows: DataFrame, text: str, *key: str) -> DataFrame:
    return rows.select(*key, F.posexplode(F.split(text, "\n")).alias("line", "value"))


def front_objects(rows: DataFrame, text: str, *key: str) -> DataFrame:
    """key, ord, name, x, y, dx, dy: the object lines of a prompt's first section, up to a blank line or one that begins with <."""
    every = lines(rows, text, *key)
    stop = (F.trim("value") == "") | F.startswith(F.col("value"), F.lit("<"))
    closed = F.max(stop.cast("int")).over(Window.partitionBy(*key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    found = every.withColumn("_closed", closed).where((F.col("_closed") == 0) & F.col("value").rlike(OBJECT))
    part = lambda k: F.regexp_extract("value", OBJECT, k)
    return found.select(*key, part(2).cast("int").alias("ord"), part(1).alias("name"), *[part(k).cast("double").alias(c) for k, c in ((3, "x"), (4, "y"), (5, "dx"), (6, "dy"))])


def futures_in(text: str) -> dict[int, list[tuple[float | None, float | None]]]:
    """Of one text the last list of each object's futures, as ``future_waypoints`` reads them."""
    header, found, within = TRAJECTORIES["ids"][0].strip(), {}, False
    at = text.find(header)
    for line in text[text.rfind("\n", 0, at) + 1 :].split("\n") if at >= 0 else []:
        within = (within or header in line) and bool(line.strip(" ")) and not line.startswith("<")
        if within and (m := FUTURE_OF.search(line)) and (pairs := PLACE_OF.findall(m[2])):
            found[int(m[1])] = [(number(x), number(y)) for x, y in pairs]
    return found


def number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def future_waypoints(rows: DataFrame, text: str, *key: str) -> DataFrame:
    """key, ord, waypoints (array<struct<x, y>>): the futures listed under the header of specific objects, up to a blank line or one that begins with <; of several lists for an object the last.

    A text is read where it lies, by itself; lines are no rows. Ids beyond an int are null, as are numbers that aren't any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, ord_, ends, xs, ys = [], [], [0], [], []
            for k, own in enumerate(b["_text"].to_pylist()):
                for o, points in futures_in(own).items():
                    at.append(k)
                    ord_.append(o if o < 2**31 else None)
                    xs.extend(x for x, _ in points)
                    ys.extend(y for _, y in points)
                    ends.append(len(xs))
            points = pa.StructArray.from_arrays([pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], ["x", "y"])
            keys = [b[k].take(pa.array(at, pa.int64())) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(ord_, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), points)], [*key, "ord", "waypoints"])

    having = rows.where(F.contains(F.col(text), F.lit(TRAJECTORIES["ids"][0].strip()))).select(*key, F.col(text).alias("_text"))
    kinds = [f"`{k}` {having.schema[k].dataType.simpleString()}" for k in key]
    return shipped(having).mapInArrow(run, ", ".join([*kinds, "ord int, waypoints array<struct<x: double, y: double>>"]))


def with_waypoints(objects: DataFrame, waypoints: DataFrame, *key: str) -> DataFrame:
    """Objects and, where their id has any, the text of their future waypoints."""
    return objects.join(waypoints, [*key, "ord"], "left")


def boxes_3d(rows: DataFrame, text: str, *key: str) -> DataFrame:
    """key, place, label, and the nine numbers of each box in fenced JSON, a list of objects or one object; what isn't JSON yields none."""
    body = fenced_json(F.col(text))
    body = F.when(F.startswith(F.trim(body), F.lit("{")), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    found = F.from_json(body, "array<struct<bbox_3d:array<double>,label:string>>")
    return rows.select(*key, F.posexplode(found).alias("place", "b")).select(*key, "place", F.col("b.label").alias("label"), F.col("b.bbox_3d").alias("box"))


def matched_times(results: DataFrame, contents: DataFrame, *key: str) -> DataFrame:
    """key, content, result: each content (repeats count once) with the last result, by place, whose time it mentions (results of the same key); contents that mention none have no row.

    Of each key and time only the last result is kept. Contents are cut once into all their pieces of the lengths that times have, and pieces meet times by equality: the
    work grows with the length of the contents, not with how many results a key has, and a key with many rows is dealt out over its pieces. Null times, places and contents
    match nothing; of results of one place the greatest counts.
    """
    time = F.col("time").cast("string")
    last = results.withColumn("_piece", time).where("_piece IS NOT NULL AND place IS NOT NULL").groupBy(*key, "_piece").agg(F.max(F.struct("place", "result")).alias("_last"))
    lengths = sorted(r[0] for r in last.select(F.length("_piece").alias("n")).distinct().collect())  # as many as times have different lengths
    own = contents.select(*key, "content").where("content IS NOT NULL").distinct()

    def pieces(n: int) -> Column:
        starts = F.when(F.length("content") >= n, F.sequence(F.lit(1), F.length("content") - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda k: F.substring("content", k, F.lit(n)))

    cut = own.withColumn("_piece", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *[pieces(n) for n in lengths]))))
    found = cut.join(last, [*key, "_piece"]).groupBy(*key, "content").agg(F.max("_last").alias("_last"))
    return found.select(*key, "content", F.col("_last.result").alias("result"))


def per_embodiment(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.explode(column))


def scored(rows: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows through a model that callers bring: batch in, batch out, in the given schema. The engine has no model of its own."""

    def run(batches):
        for b in batches:
            yield model(b)

    return shipped(rows).mapInPandas(run, schema)
