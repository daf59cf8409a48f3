"""Region rules: compositions of frames, neighbourhoods, pieces and borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafold.constants import CANVAS_UM
from stratafold.operators import components as cc
from stratafold.operators import raster as ra
from stratafold.plans.filling import painted
from stratafold.session import cut_lineage

PIXEL = ["image", "y", "x"]


def black_barrier(pixels: DataFrame, cues: dict[str, float], reach: int, height: int, width: int, tile: int = 512) -> DataFrame:
    """Wide gaps and long thin strips of every dark cue; ``cues`` maps a boolean column to the least strip length in pixels."""
    found = None
    for cue, least in cues.items():
        wide = ra.wide_gaps(pixels, cue, reach, height, width, "_gap").filter("_gap").select(*PIXEL)
        both = wide.unionByName(ra.long_strips(pixels, cue, reach, max(least, 1.0), height, width, tile=tile))
        found = both if found is None else found.unionByName(both)
    return found.distinct()


def flagged(pixels: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    """A boolean column telling which pixels are in a mask."""
    return pixels.join(marked.select(*PIXEL).distinct().withColumn(name, F.lit(True)), PIXEL, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def facing_boundary(framed: DataFrame, region: Column, other: Column, height: int, width: int, share: float = 0.35) -> DataFrame:
    """The part of a region's boundary that looks towards another region: the nearest share of it."""
    distance = ra.edge_distance(framed, ~other)
    edge = ra.boundary(framed, region, height, width).join(distance, PIXEL).filter("d2 IS NOT NULL").withColumn("distance", F.sqrt("d2"))
    cut = edge.groupBy("image").agg(F.percentile("distance", share).alias("cut"))
    return edge.join(cut, "image").filter(F.col("distance") <= F.col("cut")).drop("cut", "d2")


def editable_outline(mask: DataFrame, pixels: DataFrame, scale: float, height: int, width: int) -> DataFrame:
    """Boundary pixels of a mask's largest piece in full-resolution coordinates."""
    whole = flagged(pixels.select(*PIXEL), cc.largest_piece(mask), "_in")
    edge = ra.boundary(whole, F.col("_in"), height, width)
    return edge.select("image", (F.col("y") * F.lit(scale)).alias("y"), (F.col("x") * F.lit(scale)).alias("x"))


def solid_tissue(pixels: DataFrame, reach: int, height: int, width: int) -> DataFrame:
    """The section as one solid piece: its largest piece, cracks closed, holes filled."""
    whole = flagged(pixels, cc.largest_piece(pixels.filter("tissue")), "_big")
    shut = ra.closed(whole, "_big", reach, height, width, "_closed").filter("_closed")
    return cc.fill_holes(shut, pixels, height, width)


def finished(mask: DataFrame, pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Holes filled, then the largest piece."""
    return cc.largest_piece(cc.fill_holes(mask, pixels, height, width))


def resolved_regions(named: DataFrame, axis: DataFrame) -> DataFrame:
    """Drawn outlines to countable regions: NCM becomes its two halves, CMM and any other outline pass through.

    An image with NCM but no marker row fails the job where its pixels are read.
    """
    from stratafold.operators.polygons import projection

    joined = named.join(axis, "image", "left")
    half = F.when(F.col("cy").isNull(), F.raise_error(F.concat(F.lit("no dorsal marker for image "), F.col("image").cast("string"))).cast("string")).when(
        projection() >= F.col("midpoint"), "dNCM").otherwise("vNCM")
    return joined.select("image", "y", "x", F.when(F.col("name") == "NCM", half).otherwise(F.col("name")).alias("region"))


def find_band(pixels: DataFrame, markers: DataFrame, height: int, width: int, blur: float, share: float, least: int, width_um: float,
              texture: tuple[float, float] | None = None) -> DataFrame:
    """One band per image from its bright patch: axis, orientation by the marker, near border, span. Images without a patch are absent.

    The axis comes from the patch's shape, refined by its brightness and, with ``texture``, by brightness times granularity;
    each refinement may turn it by at most 45 degrees. Borders always come from the brightness patch.
    """
    from stratafold.functions.scalars import refine_angle
    from stratafold.operators.frames import signed_distance
    from stratafold.operators.moments import EDGE_SHARES, extent, orient, weighted_axis

    smooth = ra.gaussian(pixels, F.col("green"), blur, height, width, "smooth")
    patch = ra.bright_patch(smooth, F.col("smooth"), share, least)
    shape = weighted_axis(patch, F.lit(1.0), "image").withColumnRenamed("degrees", "_a")
    bright = weighted_axis(patch, F.col("weight"), "image").withColumnRenamed("degrees", "_b")
    angles = shape.join(bright, "image").withColumn("_d", refine_angle(F.col("_a"), F.col("_b")))
    if texture:
        rough = ra.texture(smooth, *texture, height, width)
        both = weighted_axis(ra.bright_patch(rough, F.col("smooth") * F.col("texture"), share, least), F.col("weight"), "image").withColumnRenamed("degrees", "_c")
        angles = angles.join(both, "image", "left").withColumn("_d", refine_angle(F.col("_d"), F.coalesce("_c", "_b")))
    turn = F.radians("_d")
    normals = angles.select("image", (-F.cos(turn)).alias("normal_y"), F.sin(turn).alias("normal_x")).join(markers, "image")
    bands = orient(patch, normals, height, width).select("image", "normal_y", "normal_x")
    ny, nx = F.col("normal_y"), F.col("normal_x")
    reach = patch.select("image", "y", "x").join(bands, "image").groupBy("image").agg(
        F.percentile(signed_distance(ny, nx, height, width), EDGE_SHARES[1]).alias("ncm_offset"), extent(signed_distance(-nx, ny, height, width), *EDGE_SHARES).alias("_s"))
    return bands.join(reach, "image").select(
        "image", "normal_y", "normal_x", "ncm_offset", (F.col("ncm_offset") - width_um / CANVAS_UM).alias("cmm_offset"),
        F.col("_s")[0].alias("span_low"), F.col("_s")[1].alias("span_high"))


def standard_boxes(framed: DataFrame, bands: DataFrame, depth_um: float, length_um: float, share: float, length_share: float,
                   blend: float, height: int, width: int) -> DataFrame:
    """Two boxes of standard size behind the band's borders, ``(image, region, y, x)``, each filled and reduced to its largest piece.

    The first has constant sizes centred on the band; the second takes shares of the tissue behind its border and a centre
    between the band's and the tissue's.
    """
    band = bands.select("image", ((F.col("ncm_offset") - F.col("cmm_offset")) * CANVAS_UM).alias("_w"))
    rows = framed.filter("tissue").join(band, "image")
    near, far = F.col("across") > 0, F.col("across") < -F.col("_w")
    facts = rows.filter(far).groupBy("image").agg(
        F.max(-F.col("_w") - F.col("across")).alias("_reach"), (F.max("along") - F.min("along")).alias("_span"), F.avg("along").alias("_mid"))
    first = rows.filter(near & (F.col("across") < depth_um) & (F.abs("along") <= length_um / 2)).select("image", F.lit(0).alias("part"), "y", "x")
    centre = (1 - blend) * F.col("_mid")
    second = rows.filter(far).join(facts, "image").filter(
        (-F.col("_w") - F.col("across") < share * F.col("_reach")) & (F.abs(F.col("along") - centre) <= length_share * F.col("_span") / 2)).select(
        "image", F.lit(1).alias("part"), "y", "x")
    return finished_parts(first.unionByName(second), framed, 2, height, width)


def finished_parts(parts: DataFrame, framed: DataFrame, count: int, height: int, width: int) -> DataFrame:
    """``finished`` for several masks of the same images in one run: part and image share one key."""
    packed = parts.select((F.col("image") * count + F.col("part")).alias("image"), "y", "x")
    frame = framed.select("image", "y", "x").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select(
        (F.col("image") * count + F.col("part")).alias("image"), "y", "x")
    done = finished(packed, frame, height, width)
    return done.select(F.floor(F.col("image") / count).alias("image"), (F.col("image") % count).cast("int").alias("part"), "y", "x")


def ladder(framed: DataFrame, region: Column, other: Column, height: int, width: int) -> DataFrame:
    """A region rebuilt four ways from its own lines: the line, plus its far end, both ends, the outer cut; ``part`` 0 to 3.

    All rungs are boolean tests on one pass over the pixels.
    """
    from stratafold.functions.scalars import across_line, along_line
    from stratafold.operators.moments import extent, line_fit

    lines = line_fit(facing_boundary(framed, region, other, height, width), "image")
    args = (F.col("y"), F.col("x"), F.col("cy"), F.col("cx"), F.col("dy"), F.col("dx"))
    deep = ra.edge_distance(framed, region).groupBy("image").agg(F.max_by(F.struct("y", "x"), F.struct(F.col("d2"), -F.col("y"), -F.col("x"))).alias("_p"))
    inner = across_line(F.col("_p.y"), F.col("_p.x"), F.col("cy"), F.col("cx"), F.col("dy"), F.col("dx"))
    lines = lines.join(deep, "image").withColumn("_side", F.when(inner > 0, 1.0).otherwise(-1.0))
    rows = framed.join(lines, "image").withColumn("_t", along_line(*args)).withColumn("_c", across_line(*args))
    facts = rows.filter(region).groupBy("image").agg(extent(F.col("_t")).alias("_e"), F.percentile("_c", 0.5).alias("_m"),
                                                    F.percentile("_c", 0.995).alias("_hi"), F.percentile("_c", 0.005).alias("_lo"))
    rows = rows.join(facts, "image").filter("tissue")
    turned = F.when(F.col("_m") < 0, -F.col("_c")).otherwise(F.col("_c"))
    outer = F.when(F.col("_m") < 0, -F.col("_lo")).otherwise(F.col("_hi"))
    line = F.col("_c") * F.col("_side") > 0
    far, low = F.col("_t") <= F.col("_e")[1], F.col("_t") >= F.col("_e")[0]
    rungs = [line, line & far, line & far & low, line & far & low & (turned <= outer)]
    part = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(rungs)])))
    return finished_parts(rows.select("image", "y", "x", part.alias("part")), framed, len(rungs), height, width)


def ends_from(net: DataFrame, floor_um: float, ceiling_um: float) -> DataFrame:
    """End cuts from a mask's extent: its centre, with a span held between two limits."""
    e = net.groupBy("image").agg(F.min("along").alias("_lo"), F.max("along").alias("_hi"))
    span = F.least(F.greatest(F.col("_hi") - F.col("_lo"), F.lit(floor_um)), F.lit(ceiling_um))
    middle = (F.col("_lo") + F.col("_hi")) / 2
    return e.select("image", (middle - span / 2).alias("low"), (middle + span / 2).alias("high"))


def by_the_rule(framed: DataFrame, ends: DataFrame, close: int, height: int, width: int, cap_um: float | None = None) -> DataFrame:
    """Solid tissue in front of the line between two end cuts, filled and reduced to its largest piece."""
    solid = framed.join(solid_tissue(framed, close, height, width), PIXEL, "left_semi")
    kept = solid.join(ends, "image").filter((F.col("across") >= 0) & F.col("along").between(F.col("low"), F.col("high")))
    return finished(kept if cap_um is None else kept.filter(F.col("across") <= cap_um), framed, height, width)


def stopped_at_first_gap(framed: DataFrame, window: Column, gap: Column, share: float, height: int, width: int) -> DataFrame:
    """Window pixels with no gap pixel nearer to the line on the same ray; largest piece, small holes filled."""
    from stratafold.operators.rays import before_barrier, ray_cells

    cells = ray_cells(framed.filter(window), -3000.0, None)
    blocked = before_barrier(cells.groupBy("image", "ray", "step").agg(F.bool_or(gap).alias("_gap")), F.col("_gap")).filter("kept")
    kept = cells.join(blocked.select("image", "ray", "step"), ["image", "ray", "step"], "left_semi")
    return cc.fill_holes(cc.largest_piece(kept), framed, height, width, share)


def stopped_at_black(framed: DataFrame, window: Column, share: float, height: int, width: int) -> DataFrame:
    """Tissue of the window joined to the pixel nearest the line, small holes filled."""
    raw = framed.filter(window & F.col("tissue"))
    score = raw.select(*PIXEL, (F.col("across") + 0.001 * F.abs("along")).alias("_score"))
    seed = score.groupBy("image").agg(F.min_by(F.struct("y", "x"), F.struct("_score", "y", "x")).alias("p")).select("image", "p.y", "p.x")
    return cc.fill_holes(cc.pieces_touching(raw, seed), framed, height, width, share)


def pinned_to_line(framed: DataFrame, mask: Column, slice_um: float, height: int, width: int) -> DataFrame:
    """A mask refilled from the line to its own depth, slice by slice along the band."""
    slices = framed.withColumn("_s", F.floor(F.col("along") / slice_um))
    depth = slices.filter(mask & (F.col("across") >= 0)).groupBy("image", "_s").agg(F.max("across").alias("_d"))
    filled = slices.filter(F.col("tissue") & (F.col("across") >= 0)).join(depth, ["image", "_s"]).filter(F.col("across") <= F.col("_d"))
    return finished(filled, framed, height, width)


def trapezoid(framed: DataFrame, constants: DataFrame, sign: int, clip: bool = True) -> DataFrame:
    """Pixels between a straight line and a depth, and between two slanted ends; ``constants(image, near, depth, low, high, slope_low, slope_high)``."""
    joined = framed.join(constants, "image")
    past = F.col("across") - F.col("near")
    inside = (sign * past >= 0) & (sign * past <= F.col("depth")) & (F.col("along") >= F.col("low") + F.col("slope_low") * past) & (
        F.col("along") <= F.col("high") + F.col("slope_high") * past)
    return joined.filter(inside & F.col("tissue") if clip else inside)


def shifted_to(framed: DataFrame, constants: DataFrame, sign: int, target: DataFrame) -> DataFrame:
    """Constants whose two ends are slid along the band so that the unclipped shape's centroid lands on ``target(image, along)``."""
    here = trapezoid(framed, constants, sign, False).groupBy("image").agg(F.avg("along").alias("_here"))
    moved = constants.join(here, "image", "left").join(target.select("image", F.col("along").alias("_want")), "image", "left")
    by = F.coalesce(F.col("_want") - F.col("_here"), F.lit(0.0))
    return moved.withColumn("low", F.col("low") + by).withColumn("high", F.col("high") + by).drop("_here", "_want")


def solid_offsets(centre: DataFrame, reach: DataFrame, prior: DataFrame, net: DataFrame, leash_um: float, floor_um: float) -> DataFrame:
    """Half-plane offsets per (image, k): prior radius from the tissue's reach, leashed to a second mask, never under a minimum.

    ``centre(image, k, centre)``, ``reach(image, k, bird, reach)``, ``prior(bird, k, slope, intercept)``, ``net(image, k, radius)``.
    """
    from stratafold.plans.fits import leash

    rows = centre.join(reach, ["image", "k"]).join(prior, ["bird", "k"]).join(net, ["image", "k"], "left")
    radius = F.col("slope") * (F.col("reach") - F.col("centre")) + F.col("intercept")
    leashed = F.when(F.col("radius").isNotNull(), leash(radius, F.col("radius"), leash_um)).otherwise(radius)  # least() passes over nulls
    return rows.select("image", "k", (F.col("centre") + F.greatest(leashed, F.lit(floor_um))).alias("offset"))


def fill_between(framed: DataFrame, bright: Column, low_um: float, high_um: float, reach: int, height: int, width: int,
                 strips: dict[str, float] | None = None, grow: bool = False, median: int = 0, faithful: bool = False, extend: int = 0,
                 extend_order: int = 1, tips: float = 0.0, clamp: int = 0, lift: int = 0, dome: bool = False, bends: float = 0.0,
                 bridge: bool = True, pair: bool = False, ridge: bool = False, joined: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fill outwards from the line to the first wide gap of every ray: ``(region pixels, border)``.

    Every option adds one stage to the border. ``strips`` maps boolean dark columns to the least length of a thin strip
    that also stops a ray; ``grow`` lets a wide gap stop rays through all black connected to it; ``joined`` keeps what is
    reachable from the line. The border has ``stop``, ``width``, ``wall`` (the ray's own stop) and ``found``.
    """
    from stratafold.operators import borders as bo
    from stratafold.operators import rays

    table0 = framed.withColumn("_dark", ~bright)
    barrier = ra.wide_gaps(table0, "_dark", reach, height, width, "_gap").filter("_gap").select(*PIXEL)
    if grow:
        barrier = cc.pieces_touching(table0.filter("_dark"), barrier, fall_back=False)
    thin = None
    for cue, least in (strips or {}).items():
        found = ra.long_strips(table0, cue, reach, least, height, width)
        thin = found if thin is None else thin.unionByName(found)
    marked = flagged(table0, barrier if thin is None else barrier.unionByName(thin), "_barrier")
    if thin is not None:
        marked = flagged(marked, thin, "_strip")
    kept = ["image", "y", "x", "green", "along", "across", "_dark", "_barrier", *(["_strip"] if thin is not None else [])]
    cells = cut_lineage(rays.ray_cells(marked.select(*kept), low_um, high_um))
    table = rays.ray_table(cells, ~F.col("_dark"), F.col("green"), F.col("_barrier"))
    border = rays.first_wide_gap(table, 1).withColumn("wall", F.col("stop"))
    blind = ~F.col("found")
    size = table.groupBy("image").agg((F.max("ray") + 1).alias("_rays"), (F.max("step") + 1).alias("_width"))
    for wanted, score in ((pair, rays.pair_score), (ridge, None)):
        if wanted:
            sized = table.join(size, "image")
            scored = score(sized, F.col("_rays"), F.col("_width")) if score else rays.ridge_score(sized, F.col("_width"))
            guess = rays.strongest(scored, F.col("seen"), border.select("image", "ray", "width")).select("image", "ray", F.col("stop").alias("_g"))
            border = border.join(guess, ["image", "ray"], "left").withColumn(
                "stop", F.when(blind & (F.col("_g") < F.col("width")), F.col("_g")).otherwise(F.col("stop"))).drop("_g")
    if bridge:
        border = bo.bridge(border)
    if median:
        border = bo.running_median(border, median)
    if faithful:
        border = border.withColumn("stop", F.when(F.col("found"), F.least("stop", "wall")).otherwise(F.col("stop")))
    if extend and thin is not None:
        lines = rays.ray_table(cells, ~F.col("_dark"), F.col("green"), F.col("_strip")).select("image", "ray", F.col("step").alias("wall"), F.col("black").alias("on_strip"))
        met = border.join(lines, ["image", "ray", "wall"], "left").withColumn("on_strip", F.coalesce("on_strip", F.lit(False)))
        longer = bo.extend_strips(met.withColumn("stop", F.col("stop").cast("long")), extend, extend_order).select("image", "ray", "stop")
        border = border.drop("stop").join(longer, ["image", "ray"])
    if tips:
        border = bo.cut_tips(border, tips)
    if clamp:
        border = bo.clamp(border, clamp)
    if lift:
        border = bo.lift(border, lift)
    if dome:
        border = bo.dome(border)
    if bends:
        border = bo.round_bends(border, bends)
    border = cut_lineage(border)
    region = painted(cells, border).select(*PIXEL)
    if joined:
        region = cc.reachable(region, table0.filter("_dark"), cells.filter("step = 0"), height, width)
    return region, border


def end_window(framed: DataFrame, region: DataFrame, reach: int, min_span: float, half_um: float, depth_um: float, min_depth: float | None = None) -> DataFrame:
    """Along window read off a filled region: the profile of its brightness, the joint ends of its dips, else a constant half length."""
    from stratafold.operators import profiles as pr

    inside = framed.join(region.select(*PIXEL), PIXEL, "left_semi").filter(F.col("across").between(0, depth_um))
    ends = pr.pair_of_ends(pr.candidates(pr.along_profile(inside, F.col("green")), reach), min_span, min_depth)
    low, high = F.coalesce("low", F.lit(-half_um)), F.coalesce("high", F.lit(half_um))
    every = framed.select("image").distinct().join(ends, "image", "left").withColumn("_l", low).withColumn("_h", high)
    fine = F.col("_l") < F.col("_h")
    return every.select("image", F.when(fine, F.col("_l")).otherwise(-half_um).alias("low"), F.when(fine, F.col("_h")).otherwise(half_um).alias("high"))


def first_region_rule(framed: DataFrame, height: int, width: int, dark_level: float, reach: int, half_um: float) -> tuple[DataFrame, DataFrame]:
    """The shipped rule of the first region: end window from the profile, then the fill with every stage it uses."""
    plain, _ = fill_between(framed, F.col("green") >= dark_level, -half_um, half_um, reach, height, width, bridge=False)
    window = end_window(framed, plain, 10, half_um, half_um, half_um)
    inside = cut_lineage(framed.join(window, "image").filter(F.col("along").between(F.col("low"), F.col("high"))).drop("low", "high"))
    return fill_between(
        inside.withColumn("_cue", F.col("green") < dark_level + 0.02), F.col("green") >= dark_level, -half_um, half_um, reach, height, width, strips={"_cue": 4.0},
        grow=True, median=5, faithful=True, extend=3, extend_order=2, tips=83.0, lift=10, joined=True)


def second_region_rule(framed: DataFrame, height: int, width: int, dark_level: float, reach: int, half_um: float) -> tuple[DataFrame, DataFrame]:
    """The shipped rule of the second region: a fan from the line on the other side, straightened, clipped, tapered, pulled in
    along the outermost dark path, dips filled, and reduced to one reachable piece."""
    from stratafold.operators import borders as bo
    from stratafold.operators import rays

    turned = framed.withColumn("across", -F.col("across"))
    region, border = fill_between(
        turned.withColumn("_cue", F.col("green") < dark_level + 0.02), F.col("green") >= dark_level, -half_um, half_um, reach, height, width,
        strips={"_cue": 4.0}, grow=True, median=5, faithful=True, tips=83.0, lift=10)
    cells = rays.ray_cells(turned, -half_um, half_um)
    table = cut_lineage(rays.ray_table(cells, F.col("green") >= dark_level, F.col("green")))
    walls = border.select("image", "ray", "stop", "width", "found").withColumn("wall", F.col("stop"))
    line = bo.straighten(walls, 1)
    line = line.withColumn("stop", F.when(F.col("found"), F.least("stop", F.col("wall").cast("double"))).otherwise(F.col("stop")))
    inner = bo.wall_is_interior(walls, table, 12, 0.4).select("image", "ray", (F.col("found") & ~F.col("interior")).alias("past"))
    line = cut_lineage(bo.taper_ends(line.join(inner, ["image", "ray"]), 2, 12, 4))
    scored = table.withColumn("score", -F.col("mean")).withColumn("usable", F.col("seen") & (F.col("step") >= 2))
    path = bo.best_path(bo.outermost_floor(scored, 0.9, 12), 2)
    line = bo.pull_in(bo.wall_is_interior(line, table, 12, 0.4), path)
    line = cut_lineage(bo.fill_dips(line, 12, table, 0.5))
    filled = painted(cells, line).select(*PIXEL)
    joined = cc.reachable(filled, turned.filter(F.col("green") < dark_level), cells.filter("step = 0"), height, width)
    return cc.largest_piece(joined), line


def work_set(framed: DataFrame, bands: DataFrame, cells: DataFrame) -> DataFrame:
    """Every section with its pixels, tissue, labels and cells, or the reason it cannot be used."""
    facts = framed.groupBy("image").agg(F.count("*").alias("pixels"), F.count_if("tissue").alias("tissue_px"), F.count_if(F.col("lab") > 0).alias("labelled"))
    points = cells.groupBy("image").agg(F.count("*").alias("cells"))
    joined = facts.join(bands.select("image", F.lit(True).alias("_band")), "image", "left").join(points, "image", "left")
    return joined.select("image", "pixels", "tissue_px", "labelled", F.coalesce("cells", F.lit(0)).alias("cells"),
                         F.when(F.col("_band").isNull(), "the band could not be placed").alias("reason"))
