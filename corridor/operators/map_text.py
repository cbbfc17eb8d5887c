"""What raster lookups say in words: a header and a line for each place, in the order of its step. Places are rows of token, t, x, y. Fixed texts are in formats.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corridor.functions import formats
from corridor.functions.trajectory_text import two_decimals
from corridor.operators import distance, spatial


def at(x: str = "x", y: str = "y") -> Column:
    return F.concat(F.lit("("), two_decimals(F.col(x)), F.lit(", "), two_decimals(F.col(y)), F.lit(")"))


def told(rows: DataFrame, header: str, line: Column, otherwise: str = "") -> DataFrame:
    """token, prompt: the header and the lines that are not null, or ``otherwise`` if all are."""
    lines = F.array_sort(F.collect_list(F.struct(F.col("t"), line.alias("l"))))  # a token has a fixed number of places
    said = F.filter("s", lambda x: x["l"].isNotNull())
    return rows.groupBy("token").agg(lines.alias("s")).select("token", F.concat(F.lit(header), F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda x: x["l"]), "")).otherwise(otherwise)).alias("prompt"))


def listed(places: Column) -> Column:
    """[(x, y), ...] of an array of places, in full."""
    return F.concat(F.lit("["), F.array_join(F.transform(places, lambda p: F.concat(F.lit("("), p["x"].cast("string"), F.lit(", "), p["y"].cast("string"), F.lit(")"))), ", "), F.lit("]"))


def drivable(points: DataFrame, cells: DataFrame) -> DataFrame:
    rows = spatial.quantised(points).select("token", "t", "x", "y", "valid").join(spatial.drivable(points, cells), ["token", "t"])
    line = F.concat(F.lit("Location "), at(), F.when(F.col("drivable"), " is drivable\n").otherwise(" is not drivable\n"))
    return told(rows, formats.DRIVABLE, F.when(F.col("valid"), line))


def drivable_path(points: DataFrame, cells: DataFrame, surrounding: bool = False, compat: bool = False) -> DataFrame:
    """surrounding: also where around a waypoint that is not drivable it is."""
    rows = points.select("token", "t", "x", "y").join(spatial.drivable_around(points, cells, compat=compat), ["token", "t"], "left")
    line = F.concat(F.lit("Waypoint "), at(), F.lit(" is not drivable at time step "), F.col("t").cast("string"), F.lit("\n"))
    if surrounding:
        line = F.concat(line, F.when(F.size("free") > 0, F.concat(F.lit(formats.AROUND_DRIVABLE), listed(F.col("free")), F.lit("\n"))).otherwise(""))
    return told(rows, formats.DRIVABLE_PATH, F.when(~F.col("drivable"), line), formats.ALL_DRIVABLE)


def lanes(points: DataFrame, cells: DataFrame, scores: bool = False) -> DataFrame:
    """scores: with the probabilities of the cells, which are then a column p of theirs."""
    names = F.array(*[F.lit(n) for n in formats.LANES])
    if scores:
        rows = points.select("token", "t", "x", "y").join(spatial.lane_scores(points, cells), ["token", "t"])
        found, empty, known = F.transform("found", lambda f: f["layer"]), F.size("found") == 0, F.col("valid")
        tail = F.concat(F.lit(" with probability score "), F.array_join(F.transform("found", lambda f: two_decimals(f["p"])), ", "))
    else:
        rows = points.select("token", "t", "x", "y").join(spatial.lane_categories(points, cells), ["token", "t"])
        found, empty, known, tail = F.transform(F.split("layers", ","), lambda k: k.try_cast("int")), F.col("layers") == "", F.col("layers").isNotNull(), F.lit("")
    said = F.concat(F.lit(" has lane category "), F.array_join(F.transform(found, lambda k: F.get(names, k)), ", "), tail, F.lit("\n"))
    line = F.concat(F.lit("Location "), at(), F.when(empty, " has no lane category\n").otherwise(said))
    return told(rows, formats.LANE_HEADER, F.when(known, line))


def here(tokens: DataFrame) -> DataFrame:
    """token, t, x, y: the vehicle's own place, the origin, for each token."""
    return tokens.select("token").distinct().select("token", F.lit(0).alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))


def sides(points: DataFrame, cells: DataFrame, kind: str, current: bool = False) -> DataFrame:
    """How far a kind of border (see formats.SIDES) is on either side of places, or, if current, of the vehicle's own place in the tokens of points."""
    chosen, own, name, uncertain, uncertain_here = formats.SIDES[kind]
    points = here(points) if current else points
    layer = {"shoulder": spatial.BOUNDARY, "divider": spatial.DIVIDER}[kind]
    rows = points.select("token", "t", "x", "y").join(spatial.distance_to(points, cells, layer), ["token", "t"])
    subject = F.lit("Current ego-vehicle's") if current else F.concat(F.lit("Location "), at())
    metres = lambda c: F.concat(F.col(c).cast("string"), F.lit("m"))
    none = F.lit(f" distance to {uncertain_here if current else uncertain} are uncertain")
    left = F.coalesce(metres("left"), F.lit("uncertain"))
    right = F.coalesce(F.concat(F.when(F.col("left").isNull(), "distance to ").otherwise(""), F.lit(f"right {name} is "), metres("right")), F.lit(f"distance to right {name} is uncertain"))
    said = F.when(F.col("left").isNull() & F.col("right").isNull(), none).otherwise(F.concat(F.lit(f" distance to left {name} is "), left, F.lit(" and "), right))
    return told(rows, own if current else chosen, F.concat(subject, said, F.lit("\n")))


def shoulders(points: DataFrame, cells: DataFrame) -> DataFrame:
    return sides(points, cells, "shoulder")


def crossing(points: DataFrame, cells: DataFrame) -> DataFrame:
    rows = spatial.located(distance.nearest(points, cells).select("token", "t", F.col("c").alias("px"), F.col("r").alias("py")))
    return told(rows, formats.CROSSING_HEADER, F.concat(F.lit("The nearest pedestrian crossing is at "), at(), F.lit("\n")))


def occupancy(points: DataFrame, occ: DataFrame, t: int, above: float = 0.1) -> DataFrame:
    """Whether a token's places are taken at step t; null if any of them is off the map or t outside the forecast."""
    taken = occ.where((F.col("p") > above) & (F.col("t") == t)).select("token", F.col("r").alias("py"), F.col("c").alias("px"), F.lit(True).alias("taken"))
    rows = spatial.quantised(points).join(taken, ["token", "py", "px"], "left")
    line = F.concat(F.lit("Location "), at(), F.when(F.col("taken"), " is occupied").otherwise(" is not occupied"), F.lit(f" at timestep {t}\n"))
    all_on = rows.groupBy("token").agg(F.bool_and("valid").alias("ok"))
    out = told(rows, formats.OCCUPANCY, line).join(all_on, "token")
    return out.select("token", F.when(F.col("ok") & F.lit(0 <= t < 5), F.col("prompt")).alias("prompt"))


def collision_check(points: DataFrame, occ: DataFrame, surrounding: bool = False, compat: bool = False) -> DataFrame:
    """surrounding: also which cells around a waypoint that collides are free; with compat those that are not, where one of them is taken for certain."""
    rows = points.select("token", "t", "x", "y").join(spatial.occupied_around(points, occ, compat=compat) if surrounding else spatial.occupied(points, occ), ["token", "t"], "left")
    line = F.concat(F.lit("Waypoint "), at(), F.lit(" collides at timestep "), F.col("t").cast("string"), F.lit("\n"))
    if surrounding:
        line = F.concat(line, F.when(F.size("free") > 0, F.concat(F.lit(formats.AROUND_FREE), listed(F.col("free")), F.lit("\n"))).otherwise(""))
    return told(rows, formats.COLLISION, F.when(F.col("occupied"), line), formats.NO_COLLISION)
