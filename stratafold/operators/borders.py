"""Borders: one stop per ray of a section, ``(image, ray, stop, width)``. Windows span the few hundred rays of one section."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratafold.constants import ACROSS_BIN_UM, ALONG_BIN_UM
from stratafold.functions.sequential import hull_corners, path_through

def section():
    return Window.partitionBy("image")


def line():
    return section().orderBy("ray")


def before_ray():
    return line().rowsBetween(Window.unboundedPreceding, 0)


def after_ray():
    return line().rowsBetween(0, Window.unboundedFollowing)


def stop() -> Column:
    return F.col("stop")


def ray() -> Column:
    return F.col("ray")


def clamp(border: DataFrame, limit: int) -> DataFrame:
    """Never farther out than a neighbour's stop plus ``limit`` per ray: the lower envelope of cones, in closed form."""
    left = F.min(stop() - limit * ray()).over(before_ray()) + limit * ray()
    right = F.min(stop() + limit * ray()).over(after_ray()) - limit * ray()
    return border.withColumn("stop", F.least(left, right))


def lift(border: DataFrame, limit: int) -> DataFrame:
    """The mirror of ``clamp``: notches are lifted to the upper envelope. A ray that ran off gives nothing to the rays beyond it."""
    off = (stop() >= F.col("width")).cast("int")
    parts = border.withColumn("_a", F.coalesce(F.sum(off).over(line().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "_b", F.coalesce(F.sum(off).over(line().rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    before = Window.partitionBy("image", "_a").orderBy("ray").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("image", "_b").orderBy("ray").rowsBetween(0, Window.unboundedFollowing)
    left = F.max(stop() + limit * ray()).over(before) - limit * ray()
    right = F.max(stop() - limit * ray()).over(after) + limit * ray()
    return parts.withColumn("_l", left).withColumn("_r", right).withColumn("stop", F.least(F.greatest("_l", "_r"), F.col("width"))).drop("_a", "_b", "_l", "_r")


def between_known(border: DataFrame, known: Column, name: str) -> DataFrame:
    """Linear interpolation over ``ray`` between the rays where ``known`` holds, flat beyond the first and last of them."""
    here = F.when(known, F.struct("ray", "stop"))
    prev, nxt = F.last(here, True).over(before_ray()), F.first(here, True).over(after_ray())
    marked = border.withColumn("_p", prev).withColumn("_n", nxt)
    share = (ray() - F.col("_p.ray")) / F.nullif((F.col("_n.ray") - F.col("_p.ray")).cast("double"), F.lit(0.0))
    mixed = F.col("_p.stop") + F.coalesce(share, F.lit(0.0)) * (F.col("_n.stop") - F.col("_p.stop"))
    return marked.withColumn(name, F.coalesce(mixed, F.col("_p.stop"), F.col("_n.stop")).cast("double")).drop("_p", "_n")


def bridge(border: DataFrame) -> DataFrame:
    """Rays that found nothing continue the curve between the rays that did; unchanged when none did."""
    made = between_known(border, stop() < F.col("width"), "_line")
    return made.withColumn("stop", F.coalesce(F.rint("_line").cast("long"), stop())).drop("_line")


def running_median(border: DataFrame, size: int) -> DataFrame:
    """Median over an odd window that shrinks at the ends, rounded half-even."""
    half = (size + 1 - size % 2) // 2
    return border.withColumn("stop", F.rint(F.percentile(stop(), 0.5).over(line().rowsBetween(-half, half))).cast("long"))


def wall_median(border: DataFrame, half: int) -> DataFrame:
    """Adds ``wall``: median of the found stops within ``half`` rays; infinity with fewer than three of them."""
    near = line().rowsBetween(-half, half)
    known = F.when(F.col("found"), stop())
    return border.withColumn("wall", F.when(F.count(known).over(near) >= 3, F.percentile(known, 0.5).over(near)).otherwise(F.lit(float("inf"))))


def hull_vertices(border: DataFrame, value: str = "stop") -> DataFrame:
    """Corners of the upper hull of the points ``(ray, value)``. A group is one border of at most a few hundred rays."""
    points = border.select("image", "ray", F.col(value).cast("double").alias("v"))
    return points.groupBy("image").applyInPandas(hull_corners, "image long, ray long, corner boolean")


def dome(border: DataFrame, cap: int = 0, balance: bool = False) -> DataFrame:
    """Least concave majorant of the found stops: never inwards, at most ``cap`` outwards, optionally pulled back by its mean lift."""
    enough = F.count_if(stop() < F.col("width")).over(section()) >= 3
    corners = hull_vertices(border.filter(stop() < F.col("width")))
    marked = border.withColumn("_enough", enough).join(corners, ["image", "ray"], "left").withColumn("corner", F.coalesce("corner", F.lit(False)))
    lifted = between_known(marked, F.col("corner"), "_line")
    target = F.rint("_line").cast("long")
    if cap:
        target = F.least(target, stop() + cap)
    made = lifted.withColumn("_t", F.greatest(stop(), target))
    if balance:
        span = (ray() >= F.min(F.when(F.col("corner"), ray())).over(section())) & (ray() <= F.max(F.when(F.col("corner"), ray())).over(section()))
        made = made.withColumn("_span", span).withColumn("_t", F.col("_t") - F.rint(F.avg(F.when(F.col("_span"), F.col("_t") - stop())).over(section())).cast("long")).drop("_span")
    bounded = F.least(F.greatest("_t", F.lit(0)), F.col("width"))
    return made.withColumn("stop", F.when(F.col("_enough"), bounded).otherwise(stop())).drop("_enough", "_line", "_t", "corner")


def fill_dips(border: DataFrame, limit: int, table: DataFrame, share: float) -> DataFrame:
    """Dips between hull corners, at most ``limit`` rays wide, are bridged by the chord when enough of the walked steps are black.

    ``border`` carries ``found``; a dip is bridged as a whole or not at all. Rays without a wall walk nothing.
    """
    corners = hull_vertices(border)
    marked = border.join(corners, ["image", "ray"], "left").withColumn("corner", F.coalesce("corner", F.lit(False)))
    chords = between_known(marked, F.col("corner"), "chord").withColumn("_dip", F.last(F.when(F.col("corner"), ray()), True).over(before_ray())).withColumn(
        "_end", F.first(F.when(F.col("corner"), ray()), True).over(after_ray()))
    open_rays = chords.filter(~F.col("corner") & (F.col("_end") - F.col("_dip") - 1 <= limit))
    low, high = F.least(F.greatest(F.rint(stop()), F.lit(0)), F.col("width") - 1), F.least(F.greatest(F.rint("chord"), F.lit(0)), F.col("width") - 1)
    walked = open_rays.filter("found").withColumn("_lo", low).withColumn("_hi", high).filter("_hi > _lo").join(
        table.select("image", "ray", "step", "black"), ["image", "ray"]).filter((F.col("step") >= F.col("_lo")) & (F.col("step") <= F.col("_hi")))
    dark = walked.groupBy("image", "_dip").agg(F.avg(F.col("black").cast("int")).alias("_black"))
    judged = open_rays.select("image", "ray", "_dip").join(dark, ["image", "_dip"], "left").filter(F.coalesce("_black", F.lit(1.0)) >= share)
    return chords.join(judged.select("image", "ray", F.lit(True).alias("_ok")), ["image", "ray"], "left").withColumn(
        "stop", F.when(F.col("_ok"), F.col("chord")).otherwise(stop().cast("double"))).drop("corner", "chord", "_dip", "_end", "_ok")


def _corner(here: Column, back: Column, ahead: Column, rays: int) -> Column:
    """Angle in degrees at a ray between its two baseline neighbours."""
    run = rays * ALONG_BIN_UM
    a, b = (back - here) * ACROSS_BIN_UM, (ahead - here) * ACROSS_BIN_UM
    cosine = (a * b - run * run) / (F.sqrt(a * a + run * run) * F.sqrt(b * b + run * run))
    return F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))


def cut_tips(border: DataFrame, floor: float, rays: int = 2, rounds: int = 10) -> DataFrame:
    """Cut back tips sharper than ``floor`` degrees to the chord of their neighbours; past the ends the depth is zero.

    The rounds are windows over the same partitioning, so they add no shuffle.
    """
    out = border.withColumn("stop", stop().cast("double"))
    for _ in range(rounds):
        back, ahead = F.coalesce(F.lag(stop(), rays).over(line()), F.lit(0.0)), F.coalesce(F.lead(stop(), rays).over(line()), F.lit(0.0))
        out = out.withColumn("_b", back).withColumn("_a", ahead)
        sharp = (stop() > F.col("_b")) & (stop() > F.col("_a")) & (_corner(stop(), F.col("_b"), F.col("_a"), rays) < floor)
        out = out.withColumn("stop", F.when(sharp, F.least(stop(), (F.col("_b") + F.col("_a")) / 2)).otherwise(stop())).drop("_b", "_a")
    return out.withColumn("stop", F.rint(stop()).cast("long"))


def round_bends(border: DataFrame, floor: float, rays: int = 2, rounds: int = 20) -> DataFrame:
    """Average rays whose bend is sharper than ``floor`` degrees with their neighbours; a found ray never moves past its ``wall``.

    The ends keep their own first and last ``rays`` values as neighbours.
    """
    out = border.withColumn("stop", stop().cast("double"))
    for _ in range(rounds):
        out = out.withColumn("_b", F.coalesce(F.lag(stop(), rays).over(line()), stop())).withColumn("_a", F.coalesce(F.lead(stop(), rays).over(line()), stop()))
        bent = F.when(_corner(stop(), F.col("_b"), F.col("_a"), rays) < floor, (F.col("_b") + stop() + F.col("_a")) / 3).otherwise(stop())
        out = out.withColumn("stop", F.when(F.col("found"), F.least(bent, F.col("wall"))).otherwise(bent)).drop("_b", "_a")
    return out.withColumn("stop", F.rint(stop()).cast("long"))


def strip_ends(border: DataFrame, min_rays: int, order: int) -> DataFrame:
    """``image, ends``: the two ends of every strip of ``min_rays`` rays or more, in order, each with the curve that continues it there.

    A strip is a run of neighbouring rays on a strip. Its curve is the least-squares line through its stops, or with ``order`` 2 the
    parabola, at an end where that flattens ahead. Rays of a run are consecutive, so about their middle the odd sums vanish and the
    coefficients are quotients of sums.
    """
    rays = F.col("ray").cast("double")
    run = F.col("ray") - F.row_number().over(Window.partitionBy("image", "on_strip").orderBy("ray"))
    sums = border.withColumn("_run", run).filter("on_strip").groupBy("image", "_run").agg(
        F.count("*").cast("double").alias("n"), F.min("ray").cast("double").alias("first"), F.max("ray").cast("double").alias("last"), F.sum(stop()).cast("double").alias("s0"),
        F.sum(rays * stop()).alias("s1"), F.sum(rays * rays * stop()).alias("s2")).filter(F.col("n") >= min_rays)
    n, m = F.col("n"), F.col("m")
    sums = sums.withColumn("m", (F.col("first") + F.col("last")) / 2).withColumn("uu", n * (n * n - 1) / 12).withColumn("uuuu", n * (n * n - 1) * (3 * n * n - 7) / 240)
    slope = F.when(n > 1, (F.col("s1") - m * F.col("s0")) / F.col("uu")).otherwise(0.0)
    bend = F.when((n > 2) & F.lit(order > 1), (n * (F.col("s2") - 2 * m * F.col("s1") + m * m * F.col("s0")) - F.col("uu") * F.col("s0")) / (n * F.col("uuuu") - F.col("uu") * F.col("uu"))).otherwise(0.0)
    sums = sums.withColumn("slope", slope).withColumn("bend", bend)

    def end(way: int, at: Column) -> Column:
        flattens = way * (F.col("slope") + 2 * F.col("bend") * (at - m)) * F.col("bend") < 0
        c2 = F.when(flattens, F.col("bend")).otherwise(0.0)
        return F.struct(F.col("first").alias("order"), F.lit(way).alias("way"), at.cast("int").alias("at"), m.alias("m"), ((F.col("s0") - c2 * F.col("uu")) / n).alias("c0"),
                        F.col("slope").alias("c1"), c2.alias("c2"))

    ends = sums.select("image", F.explode(F.array(end(-1, F.col("first")), end(1, F.col("last")))).alias("e"))
    return ends.groupBy("image").agg(F.array_sort(F.collect_list("e")).alias("ends"))


def extend_strips(border: DataFrame, min_rays: int = 3, order: int = 1) -> DataFrame:
    """Continue the strips of a border (rays with ``on_strip``) along their curves, over rays that are not on one.

    A continuation covers the rays ahead of its strip's end up to the first one where it turns back, leaves the image or reaches the border
    that is there. Strips go in order, the low end first, and each meets the border with the continuations before it: a fold over the
    ends of one section, on arrays of its rays 0, 1, ...
    """
    if order not in (1, 2):
        raise ValueError("a strip is continued along a line (1) or a parabola (2)")
    columns = ["image", "ray", "stop", "width", "on_strip"]
    listed = border.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ray", stop().cast("long").alias("stop"), "width", "on_strip"))).alias("rays"))
    whole = listed.join(strip_ends(border, min_rays, order), "image", "left")
    free = F.transform("rays", lambda r: ~r["on_strip"])

    def continued(out: Column, e: Column) -> Column:
        def curve(i):
            return e["c0"] + e["c1"] * (i - e["m"]) + e["c2"] * (i - e["m"]) * (i - e["m"])

        way, at = e["way"], e["at"]
        room = F.when(way < 0, at).otherwise(F.size(out) - 1 - at)
        heads = F.signum(curve(at + way) - curve(at))

        def over(d):
            i = at + way * d
            return (heads * (curve(i) - curve(i - way)) <= 0) | (curve(i) < 0) | (curve(i) >= F.element_at(out, i + 1))

        reach = F.coalesce(F.array_min(F.filter(F.when(room > 0, F.sequence(F.lit(1), room)).otherwise(F.array().cast("array<int>")), over)), room + 1)
        return F.transform(out, lambda v, i: F.when((way * (i - at)).between(1, reach - 1) & F.element_at(free, i + 1), F.rint(curve(i)).cast("long")).otherwise(v))

    stops = F.transform("rays", lambda r: r["stop"])
    done = whole.withColumn("_stops", F.when(F.col("ends").isNull(), stops).otherwise(F.aggregate("ends", stops, continued)))
    each = done.select("image", F.posexplode("rays").alias("i", "r"), "_stops")
    kind = border.schema["stop"].dataType
    return each.select("image", "r.ray", F.element_at("_stops", F.col("i") + 1).cast(kind).alias("stop"), "r.width", "r.on_strip").select(*columns)


def straighten(border: DataFrame, segments: int, inward: float = 0.0, slide_rays: int = 0, rays: int | None = None) -> DataFrame:
    """Each block of rays becomes a straight line through its found stops (three at least), optionally slid inwards.

    Blocks are shares of the canvas' ``rays``, or of the rays that are there.
    """
    n = F.count("*").over(section()) if rays is None else F.lit(rays)
    block = F.floor(ray() * segments / n)
    usable = F.col("found") & (stop() < F.col("width"))
    piece = Window.partitionBy("image", "_block")
    y, x = F.when(F.col("_use"), stop().cast("double")), F.when(F.col("_use"), ray().cast("double"))
    fitted = border.withColumn("_block", block).withColumn("_use", usable).withColumn("_slope", F.regr_slope(y, x).over(piece)).withColumn(
        "_icept", F.regr_intercept(y, x).over(piece)).withColumn("_n", F.count(x).over(piece)).withColumn("_line", F.col("_slope") * ray() + F.col("_icept"))
    if inward:
        gap = F.when(F.col("_use"), stop() - F.col("_line"))
        fitted = fitted.withColumn("_line", F.col("_line") + F.percentile(gap, inward / 100.0).over(piece))
    if slide_rays:
        from stratafold.operators.rays import run_members

        runs = run_members(fitted, ["image", "_block"], "ray", F.col("_use") & (stop() < F.col("_line")), slide_rays, "_member")
        fitted = runs.withColumn("_line", F.col("_line") + F.coalesce(F.percentile(F.when(F.col("_member"), stop() - F.col("_line")), 0.5).over(piece), F.lit(0.0))).drop("_member")
    fitted_line = F.when(F.col("_n") >= 3, F.col("_line")).otherwise(stop().cast("double"))
    return fitted.withColumn("stop", F.least(F.greatest(fitted_line, F.lit(0.0)), F.col("width").cast("double"))).drop("_block", "_use", "_slope", "_icept", "_n", "_line")


def clip_runs(border: DataFrame, needed: int) -> DataFrame:
    """Clip a straight border to its own ``wall`` only along runs of at least ``needed`` agreeing rays."""
    from stratafold.operators.rays import run_members

    runs = run_members(border, ["image"], "ray", F.col("found") & (F.col("wall") < stop()), needed, "_run")
    return runs.withColumn("stop", F.when(F.col("_run"), F.least(stop().cast("double"), F.col("wall").cast("double"))).otherwise(stop().cast("double"))).drop("_run")


def wall_middle(border: DataFrame, table: DataFrame, share: float, wide: int = 0) -> DataFrame:
    """Move each found wall ``share`` of the way through its own black run, if that run is at least ``wide`` steps."""
    from stratafold.functions.ordered import islands

    runs = islands(table, ["image", "ray"], "step", F.col("black")).select(
        "image", "ray", F.col("step").alias("_at"), F.when(F.col("flag"), F.col("start") + F.col("length") - F.col("step")).otherwise(0).alias("_run"))
    met = border.withColumn("_at", F.least(F.floor(stop()), F.col("width") - 1)).join(runs, ["image", "ray", "_at"], "left")
    run = F.coalesce("_run", F.lit(0))
    return met.withColumn("stop", F.when(F.col("found") & (run >= wide), stop() + share * run).otherwise(stop().cast("double"))).drop("_at", "_run")


def wall_is_interior(border: DataFrame, table: DataFrame, reach: int, share: float) -> DataFrame:
    """Adds ``interior``: at least ``share`` of the ``reach`` cells from the wall on are not black."""
    start = F.least(F.floor(F.greatest(stop().cast("double"), F.lit(0.0))), F.col("width"))
    cells = border.filter("found").withColumn("_s", start).join(table.select("image", "ray", "step", "black"), ["image", "ray"]).filter(
        (F.col("step") >= F.col("_s")) & (F.col("step") < F.col("_s") + reach))
    beyond = cells.groupBy("image", "ray").agg((F.avg((~F.col("black")).cast("int")) >= share).alias("interior"))
    return border.join(beyond, ["image", "ray"], "left").withColumn("interior", F.coalesce("interior", F.lit(False)))


def _taper_side(border: DataFrame, outward: bool, least: int, most: int, margin: int, rays: int | None) -> DataFrame:
    """Close one end: a flap of edge-walled rays becomes the tangent from zero at the end of the fan."""
    n = F.count("*").over(section()) if rays is None else F.lit(rays)
    counted = F.row_number().over(section().orderBy(ray() if outward else ray().desc())) - 1
    index = counted if rays is None else ray() if outward else rays - 1 - ray()
    marked = border.withColumn("_n", n).withColumn("_i", index)
    scan = section().orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("_open", F.bool_and("past").over(scan)).withColumn("_flap", F.count_if("_open").over(section()))
    marked = marked.withColumn("_fires", (F.col("_flap") >= least) & (F.col("_flap") <= F.least(F.lit(most), F.floor(F.col("_n") / 2))))
    limit = F.greatest(F.least(F.col("_flap") + margin, F.col("_n") - 1), F.lit(1))
    slope = F.when((F.col("_i") >= 1) & (F.col("_i") <= limit) & (stop() > 0), stop() / F.nullif(F.col("_i").cast("double"), F.lit(0.0)))
    marked = marked.withColumn("_k", slope).withColumn("_t", F.min(F.when(F.col("_k").isNotNull(), F.struct("_k", "_i"))).over(section()))
    ramp = F.coalesce(F.col("_t._k"), F.lit(0.0)) * F.col("_i")
    closed = F.when(F.col("_fires") & (F.col("_i") < F.coalesce(F.col("_t._i"), F.lit(0))), ramp).otherwise(stop())
    return marked.withColumn("stop", closed).drop("_n", "_i", "_open", "_flap", "_fires", "_k", "_t")


def taper_ends(border: DataFrame, least: int, most: int, margin: int, rays: int | None = None) -> DataFrame:
    """Ramp both ends to zero past the end of the separation; ``past`` marks rays whose wall is the section's outside.

    The ends are those of the canvas' ``rays``, or of the rays that are there.
    """
    out = border.withColumn("stop", stop().cast("double"))
    for outward in (True, False):
        out = _taper_side(out, outward, least, most, margin, rays)
    return out.withColumn("stop", F.greatest(stop(), F.lit(0.0)))


def chop_ends(border: DataFrame, crossing: DataFrame) -> DataFrame:
    """Drop end rays that cross a black run, from each end inwards up to the first clean one."""
    marked = border.join(crossing, ["image", "ray"]).withColumn("_l", F.bool_and("crosses").over(before_ray())).withColumn("_r", F.bool_and("crosses").over(after_ray()))
    return marked.withColumn("stop", F.when(F.col("_l") | F.col("_r"), 0.0).otherwise(stop().cast("double"))).drop("crosses", "_l", "_r")


def smooth_mean(border: DataFrame, size: int, rays: int | None = None) -> DataFrame:
    """Running mean with the end values repeated.

    The ends are those of the canvas' ``rays``, where a ray that is not there adds nothing, or of the rays that are there.
    """
    from stratafold.operators.rays import box_mean

    n = border.withColumn("_n", F.count("*").over(section()) if rays is None else F.lit(rays))
    made = box_mean(n, ["image"], "ray", F.col("_n"), size, "nearest", rays is not None, _m=stop().cast("double"))
    return made.withColumn("stop", F.col("_m")).drop("_m", "_n")


def dome_arc(border: DataFrame) -> DataFrame:
    """A parabola through the found stops; the straight line where the parabola opens outwards. Normal equations of sums."""
    known = F.when(F.col("found"), 1.0)
    mid = F.avg("ray").over(section())
    b = border.withColumn("_x", ray() - mid).withColumn("_y", stop().cast("double"))
    b = b.withColumn("_w", known)
    any_found = F.coalesce(F.max("_w").over(section()), F.lit(0.0)) > 0
    b = b.withColumn("_w", F.when(any_found, F.coalesce("_w", F.lit(0.0))).otherwise(1.0))
    x, y, w = F.col("_x"), F.col("_y"), F.col("_w")
    sums = {"_s0": w, "_s1": w * x, "_s2": w * x * x, "_s3": w * x * x * x, "_s4": w * x * x * x * x, "_t0": w * y, "_t1": w * x * y, "_t2": w * x * x * y}
    b = b.select("*", *[F.sum(e).over(section()).alias(n) for n, e in sums.items()])
    s0, s1, s2, s3, s4, t0, t1, t2 = (F.col(n) for n in sums)
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    a0 = (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / F.nullif(det, F.lit(0.0))
    a1 = (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / F.nullif(det, F.lit(0.0))
    a2 = (s0 * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / F.nullif(det, F.lit(0.0))
    flat = s0 * s2 - s1 * s1
    slope = (s0 * t1 - s1 * t0) / F.nullif(flat, F.lit(0.0))
    straight = (t0 - slope * s1) / s0 + slope * x
    arc = F.when(F.coalesce(a2, F.lit(1.0)) > 0, straight).otherwise(a0 + a1 * x + a2 * x * x)
    return b.withColumn("stop", arc).drop("_x", "_y", "_w", *sums)


def best_path(scored: DataFrame, slope: int) -> DataFrame:
    """Best continuous path per section over cells ``(image, ray, step, score, usable)``.

    Dynamic programming from ray to ray; a group is one section's ray grid, bounded by its canvas. Sections run in parallel.
    """
    table = scored.select("image", "ray", "step", "score", "usable")
    return table.groupBy("image").applyInPandas(lambda pdf: path_through(pdf, slope), "image long, ray long, step long, total double")


def outermost_floor(scored: DataFrame, share: float, slack: int) -> DataFrame:
    """Restrict ``usable`` to the outermost eligible place of each ray, less some slack; rays with nothing eligible keep all."""
    one_ray = Window.partitionBy("image", "ray")
    best = F.max(F.when(F.col("usable"), F.col("score"))).over(one_ray)
    last = F.max(F.when(F.col("usable") & (F.col("score") >= share * F.col("_best")), F.col("step"))).over(one_ray)
    marked = scored.withColumn("_best", best).withColumn("_last", last)
    limited = F.col("usable") & ((F.col("step") >= F.col("_last") - slack) | F.col("_last").isNull())
    marked = marked.withColumn("_lim", limited).withColumn("_any", F.bool_or("_lim").over(one_ray))
    return marked.withColumn("usable", F.when(F.col("_any"), F.col("_lim")).otherwise(F.col("usable"))).drop("_best", "_last", "_lim", "_any")


def pull_in(border: DataFrame, path: DataFrame) -> DataFrame:
    """A path may only pull a border in, and only where the ray has no ``interior`` wall of its own."""
    joined = border.join(path.select("image", "ray", F.col("step").alias("_p")), ["image", "ray"], "left")
    return joined.withColumn("stop", F.when(F.col("interior"), stop().cast("double")).otherwise(F.least(stop().cast("double"), F.col("_p").cast("double")))).drop("_p")


def step_changes(border: DataFrame) -> DataFrame:
    """Regularity per section: 99th percentile and maximum of the change between neighbouring rays that both stopped."""
    found = stop() < F.col("width")
    moved = border.withColumn("_d", F.when(found & F.lag(found).over(line()), F.abs(stop() - F.lag(stop()).over(line())) * ACROSS_BIN_UM))
    return moved.groupBy("image").agg(F.percentile("_d", 0.99).alias("p99"), F.max("_d").alias("most"), F.count("_d").alias("pairs"))


def worst_run(border: DataFrame, bad: Column) -> DataFrame:
    """The longest run of consecutive bad rays per section, the first on ties, with its mean error; null-free sections only."""
    from stratafold.functions.ordered import islands

    runs = islands(border, ["image"], "ray", bad).filter("flag").groupBy("image", "start").agg(
        F.max("length").alias("length"), F.avg(F.abs("error")).alias("mean_error"))
    best = F.max_by(F.struct("start", "length", "mean_error"), F.struct(F.col("length"), -F.col("start")))
    return runs.groupBy("image").agg(best.alias("b")).select("image", F.col("b.start").alias("first"), (F.col("b.start") + F.col("b.length") - 1).alias("last"), "b.mean_error")
