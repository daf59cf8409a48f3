"""Column expressions: status words, name parsing, rounding, scale and plane geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratafold.constants import (
    CANDIDATES_PER_MEGAPIXEL, CANVAS, COUNTED, MAX_WEIGHT_SWING_DEG, MINUTES_EACH, NEEDS_DORSAL, NEEDS_REGIONS, NO_DORSAL,
    NO_REGIONS, READY_TO_COUNT, REFERENCE_PIXEL_SIZE_UM, REGION_NAMES,
)


def status(has_regions: Column, has_dorsal: Column, has_counts: Column) -> Column:
    """The first unmet need names the status."""
    return F.when(~has_regions, NEEDS_REGIONS).when(~has_dorsal, NEEDS_DORSAL).when(~has_counts, READY_TO_COUNT).otherwise(COUNTED)


def reason_to_skip(has_regions: Column, has_dorsal: Column) -> Column:
    """Structural reason first; null when the section can be counted."""
    return F.when(~has_regions, NO_REGIONS).when(~has_dorsal, NO_DORSAL)


def first_reason(*pairs: tuple[Column, str]) -> Column:
    """The message of the first condition that holds, else null."""
    return F.coalesce(*[F.when(condition, message) for condition, message in pairs])


def estimate(count: Column, minutes_each: int = MINUTES_EACH) -> Column:
    """How long a batch takes, in words: a range in minutes, whole hours above 90 minutes, one number when both ends agree."""
    low, high = count * (minutes_each - 5), count * (minutes_each + 5)
    low_h, high_h = F.bround(low / 60).cast("long"), F.bround(high / 60).cast("long")
    return (F.when(count <= 0, "no time at all")
            .when(high <= 90, F.concat(F.lit("about "), low.cast("string"), F.lit("-"), high.cast("string"), F.lit(" minutes")))
            .when(low_h == high_h, F.concat(F.lit("about "), low_h.cast("string"), F.lit(" hours")))
            .otherwise(F.concat(F.lit("about "), low_h.cast("string"), F.lit("-"), high_h.cast("string"), F.lit(" hours"))))


def elapsed_text(seconds: Column) -> Column:
    """Seconds as ``[[dd-]hh:]mm:ss``."""
    s = F.greatest(F.lit(0), seconds)
    days, hours = F.floor(s / 86400), F.floor(s % 86400 / 3600)
    tail = F.format_string("%02d:%02d", F.floor(s % 3600 / 60), s % 60)
    return (F.when(days > 0, F.concat(days.cast("string"), F.lit("-"), F.format_string("%02d", hours), F.lit(":"), tail))
            .when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), tail)).otherwise(tail))


def minutes_running(text: Column) -> Column:
    """``[[dd-]hh:]mm:ss`` as whole minutes, -1 if it cannot be read."""
    shape = r"^(?:(\d+)-)?(?:(\d+):)?(\d+):(\d+)$"
    clean = F.trim(text)
    part = [F.coalesce(F.regexp_extract(clean, shape, i).try_cast("long"), F.lit(0)) for i in (1, 2, 3)]
    return F.when(clean.rlike(shape), part[0] * 1440 + part[1] * 60 + part[2]).otherwise(F.lit(-1).cast("long"))


def is_left_hemisphere(name: Column) -> Column:
    """True for an LH token, false for an RH token, an error when neither is there."""
    return (F.when(name.rlike(r"[_\-]LH([_\-]|$)"), True).when(name.rlike(r"[_\-]RH([_\-]|$)"), False)
            .otherwise(F.raise_error(F.concat(name, F.lit(" says neither LH nor RH"))).cast("boolean")))


def bird_of(stem: Column) -> Column:
    """The stem up to its first underscore."""
    return F.split_part(stem, F.lit("_"), F.lit(1))


def newer(a: Column, b: Column) -> Column:
    """Is time ``a`` after time ``b``; false when either is missing."""
    return F.coalesce(a > b, F.lit(False))


def pixel_of(value: Column) -> Column:
    """Whole-pixel coordinate; ties go to the even pixel."""
    return F.rint(value).cast("long")


def clipped_pixel(value: Column, size: int = CANVAS) -> Column:
    return F.least(F.greatest(F.rint(value).cast("long"), F.lit(0)), F.lit(size - 1))


def has_full_patch(y: Column, x: Column, height: int, width: int, half: int) -> Column:
    return (y >= half) & (y < height - half) & (x >= half) & (x < width - half)


def candidates_wanted(pixels: Column, pixel_size_um: Column | float = REFERENCE_PIXEL_SIZE_UM) -> Column:
    """Candidate budget, constant per unit of real tissue."""
    per_mm2 = CANDIDATES_PER_MEGAPIXEL / (REFERENCE_PIXEL_SIZE_UM / 1000.0) ** 2 / 1e6
    size = pixel_size_um if isinstance(pixel_size_um, Column) else F.lit(pixel_size_um)
    return F.rint(F.lit(per_mm2) * (pixels * F.pow(size / 1000.0, F.lit(2.0)))).cast("long")


def area_mm2(pixels: Column, scale_um: Column) -> Column:
    """Pixels to mm2, null without a scale."""
    return F.bround(pixels * F.pow(F.nullif(scale_um, F.lit(0.0)) / 1000.0, F.lit(2.0)), 4)


def density(count: Column, area: Column, digits: int = 1) -> Column:
    """Cells per mm2, null when the area is null or zero."""
    return F.bround(count / F.nullif(area, F.lit(0.0)), digits)


def region_rank(region: Column) -> Column:
    """Position in anatomical order; unknown regions come last."""
    rank = F.lit(len(REGION_NAMES))
    for position, name in reversed(list(enumerate(REGION_NAMES))):
        rank = F.when(region == name, position).otherwise(rank)
    return rank


def scale_from_metadata(description: Column, numerator: Column, denominator: Column, unit: Column) -> Column:
    """Microns per pixel from ``PhysicalSizeX="..."``, else from the resolution tags (unit 2 is inches), else null."""
    told = F.regexp_extract(description, 'PhysicalSizeX="([^"]+)"', 1)
    per_unit = F.nullif(numerator, F.lit(0)) / F.nullif(denominator, F.lit(0))
    from_tags = F.when(F.coalesce(unit, F.lit(2)) == 2, 25400.0).otherwise(10000.0) / per_unit
    return F.when(description.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(told.try_cast("double"), from_tags))


def across_line(y, x, cy, cx, dy, dx) -> Column:
    """Signed distance from the line through (cy, cx) with unit direction (dy, dx)."""
    return dy * (x - cx) - dx * (y - cy)


def along_line(y, x, cy, cx, dy, dx) -> Column:
    """Signed distance along that line."""
    return dy * (y - cy) + dx * (x - cx)


def refine_angle(prior: Column, candidate: Column) -> Column:
    """Take the candidate angle when it swings at most 45 degrees (modulo 180), else keep the prior."""
    swing = F.pmod(candidate - prior + 90.0, F.lit(180.0)) - 90.0
    return F.when(F.abs(swing) <= MAX_WEIGHT_SWING_DEG, candidate).otherwise(prior)


def distance_to_segment(y, x, y1, x1, y2, x2) -> Column:
    """Distance from a point to a segment; the nearest point is clamped to its ends."""
    ay, ax = y2 - y1, x2 - x1
    size = ay * ay + ax * ax
    share = F.least(F.greatest(((y - y1) * ay + (x - x1) * ax) / F.nullif(size, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    share = F.coalesce(share, F.lit(0.0))
    return F.hypot(y - y1 - share * ay, x - x1 - share * ax)


def inside_box(y, x, cy, cx, half_along, half_across, sin2t, cos2t) -> Column:
    """Inside a rotated box whose angle is kept as the sine and cosine of its double."""
    angle = F.atan2(sin2t, cos2t) * 0.5
    dy, dx = F.sin(angle), F.cos(angle)
    return (F.abs(along_line(y, x, cy, cx, dy, dx)) <= half_along) & (F.abs(across_line(y, x, cy, cx, dy, dx)) <= half_across)


def fan(directions: int = 16) -> list[tuple[int, float, float]]:
    """Unit vectors fanned evenly around the compass."""
    return [(k, math.cos(2.0 * math.pi * k / directions), math.sin(2.0 * math.pi * k / directions)) for k in range(directions)]
