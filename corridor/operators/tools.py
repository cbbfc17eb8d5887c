"""The tools by name: rows or a text for every scene, from frames that hold all scenes. Names come from this list alone; arguments are checked before planning.

Frames: scenes (token), objects, waypoints (token, ord, t, x, y), occ (token, t, r, c, p), map_cells (token, layer, r, c), lane_cells (those with p).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.functions import formats
from corridor.operators import distance, map_text, spatial

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Argument:
    """kind: number, integer, integers, boolean, places (pairs of numbers) or path (six or seven of them)."""

    kind: str
    text: str
    least: float | None = None
    greatest: float | None = None

    def accepts(self, value) -> bool:
        whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
        number = lambda v: whole(v) or (isinstance(v, float) and v == v)
        inside = lambda v: (self.least is None or v >= self.least) and (self.greatest is None or v <= self.greatest)
        if self.kind == "boolean":
            return isinstance(value, bool)
        if self.kind in ("number", "integer"):
            return (number if self.kind == "number" else whole)(value) and inside(value)
        if not isinstance(value, list | tuple) or not value:
            return False
        if self.kind == "integers":
            return all(whole(v) and inside(v) for v in value)
        pairs = all(isinstance(v, list | tuple) and len(v) == 2 and all(map(number, v)) for v in value)
        return pairs and (self.kind == "places" or 6 <= len(value) <= 7)

    def schema(self) -> dict:
        bounds = {k: v for k, v in (("minimum", self.least), ("maximum", self.greatest)) if v is not None}
        pair = {"type": "array", "items": {"type": "number"}, "minItems": 2, "maxItems": 2}
        own = {"integers": {"type": "array", "items": {"type": "integer"} | bounds}, "places": {"type": "array", "items": pair}, "path": {"type": "array", "items": pair, "minItems": 6, "maxItems": 7}}
        return own.get(self.kind, {"type": self.kind} | bounds) | {"description": self.text}


@dataclass(frozen=True)
class Tool:
    #: Rows of all scenes, and what they say: token, prompt; scenes with nothing to say have no row.
    rows: Callable[..., DataFrame]
    says: Callable[..., DataFrame]
    text: str
    arguments: dict[str, Argument] = field(default_factory=dict)
    #: Whether models are told of it.
    exposed: bool = True


def placed(scenes: DataFrame, places) -> DataFrame:
    """token, t (from 1), x, y: the same places in every scene."""
    each = F.posexplode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in places])).alias("k", "p")
    return scenes.select("token").distinct().select("token", each).select("token", (F.col("k") + 1).alias("t"), "p.x", "p.y")


def _objects(pick, kind: str, text: str) -> Tool:
    return Tool(lambda f: pick(f["objects"]), lambda f: spatial.prompt(pick(f["objects"]), *formats.OBJECTS[kind]), text)


def _futures(pick, kind: str, text: str, **arguments: Argument) -> Tool:
    def rows(f: Frames, **a) -> DataFrame:
        return f["waypoints"].join(pick(f["objects"], **a).select("token", "ord"), ["token", "ord"], "left_semi")

    def says(f: Frames, short: bool = False, **a) -> DataFrame:
        header, lead, span = formats.TRAJECTORIES[kind]
        return spatial.trajectory_prompt(rows(f, **a), f["objects"], header.format(*a.values()) if kind == "range" else header, lead, span, short)

    return Tool(rows, says, text, arguments)


def _box(objects: DataFrame, x_start: float, x_end: float, y_start: float, y_end: float) -> DataFrame:
    return spatial.in_range(objects, x_start, x_end, y_start, y_end)


def _borders(kind: str, current: bool, text: str) -> Tool:
    layer = {"shoulder": spatial.BOUNDARY, "divider": spatial.DIVIDER}[kind]
    at = lambda f, locations=None: map_text.here(f["scenes"]) if current else placed(f["scenes"], locations)
    return Tool(lambda f, **a: spatial.distance_to(at(f, **a), f["map_cells"], layer), lambda f, **a: map_text.sides(at(f, **a), f["map_cells"], kind, current), text, {} if current else _PLACES)


_BOX = {k: Argument("number", f"the box's {k.replace('_', ' ')} in metres", -50, 50) for k in ("x_start", "x_end", "y_start", "y_end")}
_PLACES, _PATH = {"locations": Argument("places", "places to look at")}, {"trajectory": Argument("path", "the planned path")}
_IDS = {"object_ids": Argument("integers", "ids of objects", 0)}
#: The names and arguments by which recorded calls know the tools.
TOOLS: dict[str, Tool] = {
    "get_leading_object_detection": _objects(spatial.leading, "leading", "the object ahead in the lane"),
    "get_object_detections_in_range": Tool(
        lambda f, **a: _box(f["objects"], **a),
        lambda f, **a: spatial.prompt(_box(f["objects"], **a), formats.OBJECTS_IN_RANGE[0].format(a["x_start"], a["x_end"], a["y_start"], a["y_end"]), formats.OBJECTS_IN_RANGE[1]), "objects in a box", _BOX,
    ),
    "get_surrounding_object_detections": _objects(spatial.surrounding, "surrounding", "objects within 20 m"),
    "get_front_object_detections": _objects(spatial.front, "front", "objects ahead within 20 m"),
    "get_all_object_detections": _objects(spatial.all_objects, "all", "all objects"),
    "get_leading_object_future_trajectory": _futures(spatial.leading, "leading", "the future of the object ahead"),
    "get_future_trajectories_for_specific_objects": _futures(lambda o, object_ids: spatial.for_ids(o, list(object_ids)), "ids", "futures by id", **_IDS),
    "get_future_trajectories_in_range": _futures(_box, "range", "futures of the objects in a box", **_BOX),
    "get_future_waypoint_of_specific_objects_at_timestep": Tool(
        lambda f, object_ids, timestep: spatial.for_ids(f["waypoints"], list(object_ids)).where(F.col("t") == timestep + 1),
        lambda f, object_ids, timestep: spatial.waypoint_prompt(f["waypoints"], f["objects"], list(object_ids), timestep).where("prompt IS NOT NULL"),
        "places of objects at a waypoint", _IDS | {"timestep": Argument("integer", "the waypoint, counted from 0", 1, 6)},
    ),
    "get_all_future_trajectories": _futures(spatial.all_objects, "all", "all futures"),
    "get_occupancy_at_locations_for_timestep": Tool(
        lambda f, locations, timestep: spatial.occupied_strict(placed(f["scenes"], locations), f["occ"], timestep),
        lambda f, locations, timestep: map_text.occupancy(placed(f["scenes"], locations), f["occ"], timestep).where("prompt IS NOT NULL"),
        "whether places are taken", _PLACES | {"timestep": Argument("integer", "step of the forecast", 0, 4)},
    ),
    "check_occupancy_for_planned_trajectory": Tool(lambda f, trajectory: spatial.occupied(placed(f["scenes"], trajectory), f["occ"]), lambda f, trajectory: map_text.collision_check(placed(f["scenes"], trajectory), f["occ"]), "whether a path collides", _PATH, False),
    "get_drivable_at_locations": Tool(lambda f, locations: spatial.drivable(placed(f["scenes"], locations), f["map_cells"]), lambda f, locations: map_text.drivable(placed(f["scenes"], locations), f["map_cells"]), "whether places are drivable", _PLACES),
    "check_drivable_of_planned_trajectory": Tool(lambda f, trajectory: spatial.drivable(placed(f["scenes"], trajectory), f["map_cells"]), lambda f, trajectory: map_text.drivable_path(placed(f["scenes"], trajectory), f["map_cells"]), "whether a path is drivable", _PATH, False),
    "get_lane_category_at_locations": Tool(
        lambda f, locations, return_score: spatial.lane_scores(placed(f["scenes"], locations), f["lane_cells"]) if return_score else spatial.lane_categories(placed(f["scenes"], locations), f["map_cells"]),
        lambda f, locations, return_score: map_text.lanes(placed(f["scenes"], locations), f["lane_cells" if return_score else "map_cells"], return_score),
        "what lies at places", _PLACES | {"return_score": Argument("boolean", "with probabilities")},
    ),
    "get_distance_to_shoulder_at_locations": _borders("shoulder", False, "metres from places to the shoulders"),
    "get_current_shoulder": _borders("shoulder", True, "metres to the shoulders"),
    "get_distance_to_lane_divider_at_locations": _borders("divider", False, "metres from places to the dividers"),
    "get_current_lane_divider": _borders("divider", True, "metres to the dividers"),
    "get_nearest_pedestrian_crossing": Tool(lambda f: distance.nearest(map_text.here(f["scenes"]), f["map_cells"]), lambda f: map_text.crossing(map_text.here(f["scenes"]), f["map_cells"]), "the next crossing ahead"),
}


def checked(name: str, arguments: dict) -> Tool:
    """The tool, if there is one of that name that takes these arguments, neither fewer nor more; else ValueError."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool: {name}")
    tool = TOOLS[name]
    if odd := set(arguments) ^ set(tool.arguments):
        raise ValueError(f"{name}: missing or unknown arguments: {', '.join(sorted(odd))}")
    for key, kind in tool.arguments.items():
        if not kind.accepts(arguments[key]):
            raise ValueError(f"{name}: {key} must be {kind.schema()}")
    return tool


def call(name: str, frames: Frames, **arguments) -> DataFrame:
    """The rows that a tool finds in all scenes."""
    return checked(name, arguments).rows(frames, **arguments)


def say(name: str, frames: Frames, **arguments) -> DataFrame:
    """token, prompt: what a tool says of each scene; scenes of which it says nothing have no row."""
    return checked(name, arguments).says(frames, **arguments)


def rerun(calls: list[tuple[str, dict]], frames: Frames) -> DataFrame:
    """token, text: what recorded calls say of every scene, one after the other. A call that is refused says nothing, nor does one without an answer."""
    out, said = frames["scenes"].select("token").distinct(), []
    for k, (name, arguments) in enumerate(calls):
        try:
            own = say(name, frames, **arguments)
        except ValueError:
            continue
        said.append(f"_{k}")
        out = out.join(own.select("token", F.col("prompt").alias(said[-1])), "token", "left")
    return out.select("token", F.concat_ws("", *said).alias("text"))


def described(hidden: bool = False) -> list[dict]:
    """Name, text and arguments of every tool that models are told of, or of all."""
    of = lambda t: {"type": "object", "properties": {k: a.schema() for k, a in t.arguments.items()}, "required": [*t.arguments]}
    return [{"name": n, "description": t.text, "parameters": of(t)} for n, t in TOOLS.items() if t.exposed or hidden]
