"""Sizes of images and videos, frame choices, boxes and cameras, as column expressions. What the rules refuse is null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the sizing rules.
MAX_RATIO, FRAME_FACTOR, FPS, MIN_FRAMES, MAX_FRAMES = 200, 2, 2.0, 4, 768
SUFFIXES = (("jpg", "image/jpeg"), ("jpeg", "image/jpeg"), ("png", "image/png"), ("gif", "image/gif"), ("webp", "image/webp"), ("mp4", "video/mp4"), ("avi", "video/x-msvideo"), ("txt", "text/plain"), ("json", "application/json"))


def by_factor(value: Column, factor: int, how: str) -> Column:
    """The multiple of factor that is nearest (ties to even), above or below."""
    q = value / F.lit(float(factor))
    return ({"round": lambda x: F.bround(x, 0), "ceil": F.ceil, "floor": F.floor}[how](q) * factor).cast("long")


def smart_resize(height: Column, width: Column, factor: int = 32, min_tokens: int = 4, max_tokens: int = 16384) -> Column:
    """struct(height, width): multiples of factor within the pixel bounds, near the aspect ratio; null beyond a ratio of 200."""
    least, most = min_tokens * factor**2, max_tokens * factor**2
    h, w = (F.greatest(F.lit(factor).cast("long"), by_factor(x, factor, "round")) for x in (height, width))
    area = (height * width).cast("double")
    down, up = F.sqrt(area / most), F.sqrt(F.lit(float(least)) / area)
    fit = lambda x, own: F.when(h * w > most, by_factor(x / down, factor, "floor")).when(h * w < least, by_factor(x * up, factor, "ceil")).otherwise(own)
    ok = (F.greatest(height, width) / F.least(height, width).cast("double")) <= MAX_RATIO
    return F.when(ok & (F.least(height, width) > 0), F.struct(fit(height, h).alias("height"), fit(width, w).alias("width")))


def strict_resize(height: Column, width: Column, factor: int, least: int, most: int) -> Column:
    """The same between pixel bounds, but null for sides below the factor."""
    return F.when((height >= factor) & (width >= factor), smart_resize(height, width, factor, least // factor**2, most // factor**2))


def smart_nframes(total: Column, video_fps: Column, fps: float = FPS, min_frames: int = MIN_FRAMES, max_frames: int = MAX_FRAMES) -> Column:
    """How many frames to take at fps within bounds, an even number; null if that leaves the interval [2, total]."""
    lo = math.ceil(min_frames / FRAME_FACTOR) * FRAME_FACTOR
    hi = by_factor(F.least(F.lit(max_frames), total), FRAME_FACTOR, "floor")
    n = F.least(F.least(F.greatest(total / video_fps * fps, F.lit(float(lo))), hi.cast("double")), total.cast("double"))
    n = by_factor(n, FRAME_FACTOR, "floor")
    return F.when((n >= FRAME_FACTOR) & (n <= total), n)


def fixed_nframes(wanted: Column, total: Column) -> Column:
    n = by_factor(wanted, FRAME_FACTOR, "round")
    return F.when((n >= FRAME_FACTOR) & (n <= total), n)


def frame_range(total: Column, fps: Column, start: Column, end: Column) -> Column:
    """struct(first, last, frames) of the frames between two times (either may be null); null if none or one is left or the input is not positive."""
    longest = total / fps
    clamp = lambda t: F.greatest(F.lit(0.0), F.least(t, longest))
    a = F.when(start.isNull(), F.lit(0).cast("long")).otherwise(F.ceil(clamp(start) * fps))
    b = F.when(end.isNull(), (total - 1).cast("long")).otherwise(F.least(F.floor(clamp(end) * fps), (total - 1).cast("long")))
    whole = start.isNull() & end.isNull()
    return F.when((fps > 0) & (total > 0) & (whole | (a < b)), F.struct(a.alias("first"), b.alias("last"), (b - a + 1).alias("frames")))


def frame_ids(first: Column, last: Column, n: Column) -> Column:
    """n frame numbers evenly from first to last, ties to even."""
    step = F.when(n > 1, (last - first) / (n - 1).cast("double")).otherwise(0.0)
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.bround(first + k * step, 0).cast("long"))


def pixel_budget(frames: Column, factor: int = 32, total_tokens: int = 24576, max_tokens: int = 768, min_tokens: int = 128) -> Column:
    """The most pixels a frame may have."""
    square = factor**2
    return F.greatest(F.least(F.lit(float(max_tokens * square)), F.lit(float(total_tokens * square)) / frames * FRAME_FACTOR), F.lit(float(int(min_tokens * square * 1.05))))


def media_tokens(t: Column, h: Column, w: Column, merge: int = 2) -> Column:
    return F.floor(t * h * w / F.lit(float(merge**2)))


def box_per_mille(x: Column, side: Column) -> Column:
    """A coordinate in thousandths of its side, within 0 and 1000."""
    return F.greatest(F.lit(0), F.least(F.lit(1000), F.bround(x / side * F.lit(1000.0), 0).cast("int")))


def box_resized(x: Column, side: Column, resized: Column) -> Column:
    """A coordinate of a resized image, on its pixels."""
    return F.greatest(F.lit(0).cast("long"), F.least(resized - 1, F.bround(x / side * resized, 0).cast("long")))


def rescaled(x: Column, side: Column) -> Column:
    """From thousandths (0 to 999) to pixels."""
    return F.bround(x / F.lit(999.0) * side, 0).cast("int")


def unnormalised(x: Column, side: Column) -> Column:
    return (x * side).cast("int")


def camera(width: Column, height: Column, fov: float = 60.0) -> Column:
    """struct(fx, fy, cx, cy) of a camera of that field of view."""
    half = 2 * math.tan(math.radians(fov) / 2)
    return F.struct(F.round(width / F.lit(half), 2).alias("fx"), F.round(height / F.lit(half), 2).alias("fy"), F.round(width / F.lit(2.0), 2).alias("cx"), F.round(height / F.lit(2.0), 2).alias("cy"))


def projected_box(centre: tuple[Column, ...], size: tuple[Column, ...], angles: tuple[Column, ...], cam: Column) -> Column:
    """The image points of the eight corners of a box turned by pitch, yaw and roll (degrees); corners behind the camera are left out."""
    (p, y, r), (x0, y0, z0) = [F.radians(a) for a in angles], centre
    out = []
    for sx in (1, -1):
        for sy in (1, -1):
            for sz in (1, -1):
                u, v, w = (s * d / 2 for s, d in zip((sx, sy, sz), size, strict=True))
                v, w = v * F.cos(p) - w * F.sin(p), v * F.sin(p) + w * F.cos(p)
                u, w = u * F.cos(y) + w * F.sin(y), w * F.cos(y) - u * F.sin(y)
                u, v = u * F.cos(r) - v * F.sin(r), u * F.sin(r) + v * F.cos(r)
                depth = w + z0
                out.append(F.when(depth > 0, F.struct((cam["fx"] * (u + x0) / depth + cam["cx"]).alias("x"), (cam["fy"] * (v + y0) / depth + cam["cy"]).alias("y"))))
    return F.filter(F.array(*out), lambda c: c.isNotNull())


def media_type(value: Column) -> Column:
    """The mime type of a path, a data URI or a URL; ``text`` for anything else."""
    suffix = F.lower(F.regexp_extract(F.regexp_replace(value, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(F.startswith(value, F.lit("data:")), F.regexp_extract(value, r"^data:([^;,]+)", 1))
    for s, mime in SUFFIXES:
        out = out.when(suffix == s, mime)
    return out.when(value.rlike("^https?://"), "url").otherwise("text")


def scheme(value: Column) -> Column:
    """How an image is to be fetched."""
    return F.when(value.rlike("^https?://"), "http").when(F.startswith(value, F.lit("file://")), "file").when(F.startswith(value, F.lit("data:image")), "base64").otherwise("path")
