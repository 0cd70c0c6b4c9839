"""Terrain cells: sampling, smoothing, blending, volumes. One row per cell: (source_id, r, c, z); null z = no data.

``grid`` is a small table keyed by source_id: x0, y0 (upper-left corner), px, width, height.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom, rasters
from sitewright.operators.chunks import haloed, own_rows
from sitewright.operators.spatial import BOX, first_cover, salted_join

CHUNK = 4096


def grid_of(cells: DataFrame, x0: float, y0: float, px: float) -> DataFrame:
    """Grid header per source, sized by the cells present."""
    return cells.groupBy("source_id").agg(
        F.lit(float(x0)).alias("x0"), F.lit(float(y0)).alias("y0"), F.lit(float(px)).alias("px"),
        (F.max("c") + 1).cast("bigint").alias("width"), (F.max("r") + 1).cast("bigint").alias("height"),
    )


def with_header(rows: DataFrame, head: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with the columns of their source's header: one row per source, so it is the side sent to every task.

    Without the hint a constant source_id leaves a join without keys, and Spark may send the rows instead.
    """
    return rows.join(F.broadcast(head), "source_id", how)


def full_grid(cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Every cell of each source's grid; those without a row get a null height."""
    g = grid.select("source_id", "width", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height") - 1)).alias("r"))
    g = g.select("source_id", F.col("r").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1)).alias("c"))
    return g.join(cells, ["source_id", "r", "c"], "left")


def cell_centre(r: Column, c: Column) -> tuple[Column, Column]:
    """Needs the grid columns on the row."""
    return F.col("x0") + (c + 0.5) * F.col("px"), F.col("y0") - (r + 0.5) * F.col("px")


def sample(points: DataFrame, cells: DataFrame, grid: DataFrame, key: Sequence[str], x: str = "x", y: str = "y",
           out: str = "z") -> DataFrame:
    """Bilinear height at each point (cell centres carry the values).

    Outside the hull of cell centres, or with any missing neighbour, the height is null. The four
    neighbours are an equi-join on (row, col); points stay the exploded side, never the raster.
    """
    rest = [c for c in points.columns if c not in key and c != "source_id"]
    g = {n: F.col(f"_g_{n}") for n in ("x0", "y0", "px", "width", "height")}
    head = grid.select("source_id", *[F.col(n).alias(f"_g_{n}") for n in g])
    p = with_header(points, head, "left")
    p = p.withColumns({"_cf": (F.col(x) - g["x0"]) / g["px"] - 0.5, "_rf": (g["y0"] - F.col(y)) / g["px"] - 0.5})
    inside = (F.col("_cf") >= 0) & (F.col("_rf") >= 0) & (F.col("_cf") <= g["width"] - 1) & (F.col("_rf") <= g["height"] - 1)
    # points off the grid get spread-out negative rows: they match nothing and do not pile up in one partition
    spread = -1 - F.pmod(F.xxhash64(*key), F.lit(1 << 20))
    c0, r0 = F.floor("_cf").cast("bigint"), F.floor("_rf").cast("bigint")
    corner = lambda k, r, c: F.struct(F.lit(k).alias("k"), r.alias("r"), c.alias("c"))
    last_r, last_c = g["height"] - 1, g["width"] - 1
    four = F.array(
        corner(0, r0, c0), corner(1, r0, F.least(c0 + 1, last_c)),
        corner(2, F.least(r0 + 1, last_r), c0), corner(3, F.least(r0 + 1, last_r), F.least(c0 + 1, last_c)),
    )
    none = F.array(corner(0, spread, F.lit(-1).cast("bigint")))
    p = p.withColumns({"_fc": F.col("_cf") - F.floor("_cf"), "_fr": F.col("_rf") - F.floor("_rf")})
    p = p.withColumn("_k", F.explode(F.when(F.coalesce(inside, F.lit(False)), four).otherwise(none)))
    p = p.select("source_id", *key, *rest, "_fc", "_fr", F.col("_k.k").alias("_k"), F.col("_k.r").alias("_r"), F.col("_k.c").alias("_c"))
    z = cells.select("source_id", F.col("r").cast("bigint").alias("_r"), F.col("c").cast("bigint").alias("_c"), F.col("z").alias("_z"))
    joined = p.join(z, ["source_id", "_r", "_c"], "left")  # hot cells: adaptive execution splits the point side
    keep = F.any_value(F.struct("source_id", "_fc", "_fr", *rest)).alias("_p")
    corners = [F.max(F.when(F.col("_k") == k, F.col("_z"))).alias(f"_z{k}") for k in range(4)]
    out_rows = joined.groupBy(*key).agg(keep, *corners)
    fc, fr = F.col("_p._fc"), F.col("_p._fr")
    top = F.col("_z0") * (1.0 - fc) + F.col("_z1") * fc
    bottom = F.col("_z2") * (1.0 - fc) + F.col("_z3") * fc
    carried = [F.col(f"_p.{c}").alias(c) for c in ["source_id", *rest]]
    return out_rows.select(*key, *carried, (top * (1.0 - fr) + bottom * fr).alias(out))


def ring_minimum_by(rings: DataFrame, elevation: Callable[[DataFrame], DataFrame], key: str, ring: str = "ring") -> DataFrame:
    """Lowest height over the ring's vertices; 0 when no vertex is covered.

    ``elevation`` adds z to rows with (key, _i, source_id, x, y): the raster sample or anything else.
    """
    v = rings.select(key, "source_id", F.posexplode(ring).alias("_i", "_p")).select(
        key, "source_id", "_i", F.col("_p.x").alias("x"), F.col("_p.y").alias("y")
    )
    return elevation(v).groupBy(key).agg(F.coalesce(F.min("z"), F.lit(0.0)).alias("base_z"))


def ring_minimum(rings: DataFrame, cells: DataFrame, grid: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    return ring_minimum_by(rings, lambda v: sample(v, cells, grid, [key, "_i"]), key, ring)


def covered_cells(areas: DataFrame, grid: DataFrame, key: Sequence[str], ring: str = "ring") -> DataFrame:
    """Cells whose centre lies inside a ring: row and column ranges from its box, then the exact test."""
    a = with_header(geom.with_bbox(areas, ring, "_"), grid)
    px = F.col("px")
    lo = lambda v: F.greatest(F.ceil(v).cast("bigint"), F.lit(0).cast("bigint"))
    r0, r1 = lo((F.col("y0") - F.col("_maxy")) / px - 0.5), F.least(F.floor((F.col("y0") - F.col("_miny")) / px - 0.5), F.col("height") - 1)
    c0, c1 = lo((F.col("_minx") - F.col("x0")) / px - 0.5), F.least(F.floor((F.col("_maxx") - F.col("x0")) / px - 0.5), F.col("width") - 1)
    span = lambda a_, b_: F.when(a_ <= b_, F.sequence(a_, b_)).otherwise(F.array().cast("array<bigint>"))
    a = a.withColumn("r", F.explode(span(r0, r1))).withColumn("c", F.explode(span(c0, c1)))
    cx, cy = cell_centre(F.col("r"), F.col("c"))
    return a.where(geom.covers(cx, cy, F.col(ring))).drop("_minx", "_miny", "_maxx", "_maxy", "x0", "y0", "width", "height")


def cut_fill(areas: DataFrame, cells: DataFrame, grid: DataFrame, key: str, design: str = "design_z") -> DataFrame:
    """Cut and fill volume under a footprint for its design height; cells without data add nothing."""
    inside = covered_cells(areas, grid, [key])
    z = cells.select("source_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "z")
    diff = F.col(design) - F.col("z")
    px2 = F.col("px") * F.col("px")
    sums = inside.join(z, ["source_id", "r", "c"]).groupBy(key).agg(
        F.sum(F.greatest(-diff, F.lit(0.0)) * px2).alias("cut_m3"), F.sum(F.greatest(diff, F.lit(0.0)) * px2).alias("fill_m3")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return areas.select(key).join(sums, key, "left").select(key, zero("cut_m3"), zero("fill_m3"))


def design_elevation(entrances: DataFrame, cells: DataFrame, grid: DataFrame, key: str, point_id: str) -> DataFrame:
    """Mean height at the entrances of a building; any entrance off the relief rejects it."""
    z = sample(entrances, cells, grid, [key, point_id])
    g = z.groupBy(key).agg(F.avg("z").alias("_m"), F.count("z").alias("_k"), F.count(F.lit(1)).alias("n_entrances"))
    full = F.col("_k") == F.col("n_entrances")
    return g.select(
        key, "n_entrances", F.when(full, F.col("_m")).alias("design_z"),
        F.when(~full, "entrance outside relief coverage").alias("reject_reason"),
    )


def perimeter_samples(areas: DataFrame, key: str, ring: str, n: int = 16) -> DataFrame:
    """n points at equal spacing along the outline, starting at the first vertex."""
    a = areas.withColumn("_len", geom.path_length(F.col(ring))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    p = geom.interpolate(F.col(ring), F.col("_len") * (F.col("i") / float(n)))
    return a.withColumn("_p", p).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p", "_len")


def retaining_wall(areas: DataFrame, cells: DataFrame, grid: DataFrame, key: str, ring: str = "apron_ring",
                   design: str = "design_z", slope: float = rules.SLOPE_RATIO) -> DataFrame:
    """Largest height difference along the apron and whether its slope run needs a wall."""
    pts = perimeter_samples(areas.select(key, "source_id", design, ring), key, ring).drop(ring)
    z = sample(pts, cells, grid, [key, "i"])
    diff = F.abs(F.col(design) - F.col("z"))
    return z.groupBy(key).agg(
        F.coalesce(F.max(diff), F.lit(0.0)).alias("max_diff_m"),
        F.coalesce(F.bool_or(diff * slope > rules.MAX_SLOPE_RUN_M), F.lit(False)).alias("needs_wall"),
    )


def coverage_fraction(cells: DataFrame) -> DataFrame:
    return cells.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("cells"), F.count("z").alias("valid_cells"),
        (F.count("z") / F.count(F.lit(1))).alias("coverage"),
    )


def max_step(cells: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Largest height step between neighbours along rows and along columns; 0 for a single row or column."""

    def along(axis: str, other: str) -> DataFrame:
        w = Window.partitionBy("source_id", other, "_ck").orderBy(axis).rangeBetween(-1, -1)
        s = haloed(cells, axis, chunk, 1).withColumn("_s", F.abs(F.col("z") - F.last("z").over(w)))
        return own_rows(s).groupBy("source_id").agg(F.coalesce(F.max("_s"), F.lit(0.0)).alias("step"))

    both = along("c", "r").unionByName(along("r", "c"))
    return both.groupBy("source_id").agg(F.max("step").alias("max_step_m"))


def _box_pass(df: DataFrame, axis: str, other: str, cols: Sequence[str], half: int, chunk: int) -> DataFrame:
    """Window sums along one axis; beyond the border the nearest cell repeats."""
    h = haloed(df, axis, chunk, half)
    w = Window.partitionBy("source_id", other, "_ck").orderBy(axis).rangeBetween(-half, half)
    before = F.lit(half) - (F.col(axis) - F.first(axis).over(w))
    after = F.lit(half) - (F.last(axis).over(w) - F.col(axis))
    new = {
        "_" + c: F.sum(c).over(w) + before * F.first(c).over(w) + after * F.last(c).over(w) for c in cols
    }
    h = own_rows(h.withColumns(new))
    return h.withColumns({c: F.col("_" + c) for c in cols}).drop(*["_" + c for c in cols])


def smooth(cells: DataFrame, window_cells: int, chunk: int = CHUNK) -> DataFrame:
    """Box mean over valid cells, separable; even windows grow by one. Needs a full grid (missing = null z)."""
    if window_cells <= 1:
        return cells.withColumn("z_smooth", F.col("z"))
    half = (window_cells + (1 - window_cells % 2)) // 2
    s = cells.withColumns({
        "_zs": F.coalesce(F.col("z"), F.lit(0.0)), "_vs": F.when(F.col("z").isNotNull(), 1.0).otherwise(0.0),
    })
    s = _box_pass(s, "c", "r", ["_zs", "_vs"], half, chunk)
    s = _box_pass(s, "r", "c", ["_zs", "_vs"], half, chunk)
    return s.withColumn("z_smooth", F.when(F.col("_vs") > 0, F.col("_zs") / F.col("_vs"))).drop("_zs", "_vs")


def transition_alpha(cells: DataFrame, valid: str, px: float, width_m: float, chunk: int = CHUNK) -> DataFrame:
    """Blend weight of an overlay from the signed distance to the nearest cell of the other kind.

    Distances matter only up to half the width, so both passes look at a bounded neighbourhood:
    along the row for the nearest opposite column, then across rows over a frame of 2k+1 rows.
    """
    if width_m <= 0:
        return cells.withColumn("alpha", F.when(F.col(valid), 1.0).otherwise(0.0))
    k = int(width_m / 2.0 / px) + 1
    # pass 1: column distance to the nearest valid and the nearest invalid cell in the same row
    h = haloed(cells, "c", chunk, k)
    w = Window.partitionBy("source_id", "r", "_ck").orderBy("c")
    back, ahead = w.rangeBetween(-k, 0), w.rangeBetween(0, k)
    near = {}
    for name, flag in (("_dv", F.col(valid)), ("_di", ~F.col(valid))):
        at = F.when(flag, F.col("c"))
        near[name] = F.least(
            F.col("c") - F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead) - F.col("c")
        )
    rows = own_rows(h.withColumns(near))
    # pass 2: combine with row offsets
    h = haloed(rows, "r", chunk, k)
    frame = Window.partitionBy("source_id", "c", "_ck").orderBy("r").rangeBetween(-k, k)
    around = F.collect_list(F.struct("r", "_dv", "_di")).over(frame)  # at most 2k+1 entries
    d2 = lambda f: F.array_min(F.transform(
        F.filter(F.col("_around"), lambda s: s[f].isNotNull()),
        lambda s: (s["r"] - F.col("r")) * (s["r"] - F.col("r")) + s[f] * s[f],
    ))
    h = own_rows(h.withColumn("_around", around))
    h = h.withColumn("_d2", F.when(F.col(valid), d2("_di")).otherwise(d2("_dv")))
    far = F.lit(width_m)
    dist = F.coalesce(F.sqrt(F.col("_d2").cast("double")) * px, far)
    signed = F.when(F.col(valid), dist).otherwise(-dist)
    alpha = geom.clamp01((signed + width_m / 2.0) / width_m)
    return h.withColumn("alpha", alpha).drop("_dv", "_di", "_around", "_d2")


def blend(cells: DataFrame, base: str, overlay: str, valid: str, px: float, width_m: float = rules.TRANSITION_WIDTH_M,
          out: str = "z") -> DataFrame:
    """alpha * overlay + (1 - alpha) * base, with alpha from the overlay's validity mask."""
    a = transition_alpha(cells, valid, px, width_m)
    return a.withColumn(out, F.col("alpha") * F.col(overlay) + (1.0 - F.col("alpha")) * F.col(base))


def merge_sources(sources: Sequence[DataFrame], px: float, width_m: float = rules.TRANSITION_WIDTH_M, block: int = 256) -> DataFrame:
    """Fold sources from low to high priority (already ordered, all on one full grid of source_id, r, c, z).

    Cells new in a source are copied, cells known before are blended, the rest stays. A source's weights depend on its own cells only, so all
    sources meet at once: one shuffle into blocks of ``block`` x ``block`` cells, each with the border that its transitions need, and the fold runs
    in the block. The number of exchanges does not grow with the sources; a task holds a block of those that cover it.
    """
    if not sources:
        raise LookupError("no relief coverage")
    halo = int(width_m / 2.0 / px) + 1 if width_m > 0 else 0
    block = max(block, halo, 1)
    rows = None
    for i, s in enumerate(sources):
        s = s.select("source_id", F.lit(i).alias("_s"), F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.col("z").cast("double").alias("z"))
        rows = s if rows is None else rows.unionByName(s)
    at = lambda v, d: F.floor((F.col(v) + d) / float(block)).cast("bigint")
    reach = lambda v: F.explode(F.array_distinct(F.array(at(v, -halo), at(v, 0), at(v, halo))))
    rows = rows.withColumn("_br", reach("r")).withColumn("_bc", reach("c"))
    kind = sources[0].schema
    schema = f"source_id {kind['source_id'].dataType.simpleString()}, r bigint, c bigint, z double"
    out = rows.groupBy("source_id", "_br", "_bc").applyInPandas(rasters.folded(px, width_m, halo, block), schema)
    return out.select("source_id", F.col("r").cast(kind["r"].dataType).alias("r"), F.col("c").cast(kind["c"].dataType).alias("c"), "z")


def plane_corrected(cells: DataFrame, grid: DataFrame, model: DataFrame) -> DataFrame:
    """z + offset + gx (x - x0) + gy (y - y0); ``model`` holds one row per source."""
    c = with_header(with_header(cells, grid), model.select("source_id", "offset", "gx", "gy", "ox", "oy"))
    x, y = cell_centre(F.col("r"), F.col("c"))
    z = F.col("z") + F.col("offset") + F.col("gx") * (x - F.col("ox")) + F.col("gy") * (y - F.col("oy"))
    return c.select("source_id", "r", "c", z.alias("z"))


def fit_height_offset(points: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Offset model per key from control points (x, y, h_source, h_target).

    Fewer than three usable points give the mean offset, otherwise a least-squares plane about the
    first point. Collinear points are rejected with a reason. One pass finds the origin and the
    second sums nine moments, both with map-side partial sums.
    """
    key = list(key)
    p = points.where(F.col("h_source").isNotNull() & F.col("h_target").isNotNull())
    origin = p.groupBy(*key).agg(F.min_by(F.struct("x", "y"), order).alias("_o"))
    p = salted_join(p, origin, key, [order])
    dx, dy, d = F.col("x") - F.col("_o.x"), F.col("y") - F.col("_o.y"), F.col("h_target") - F.col("h_source")
    m = p.groupBy(*key).agg(
        F.any_value("_o").alias("_o"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(dx).alias("sx"), F.sum(dy).alias("sy"),
        F.sum(dx * dx).alias("sxx"), F.sum(dy * dy).alias("syy"), F.sum(dx * dy).alias("sxy"),
        F.sum(dx * d).alias("sxz"), F.sum(dy * d).alias("syz"), F.sum(d).alias("sz"),
    )
    c = F.col
    det3 = lambda a, b, e, f, g, h, i, j, k: a * (g * k - h * j) - b * (f * k - h * i) + e * (f * j - g * i)
    det = det3(c("sxx"), c("sxy"), c("sx"), c("sxy"), c("syy"), c("sy"), c("sx"), c("sy"), c("n"))
    dgx = det3(c("sxz"), c("sxy"), c("sx"), c("syz"), c("syy"), c("sy"), c("sz"), c("sy"), c("n"))
    dgy = det3(c("sxx"), c("sxz"), c("sx"), c("sxy"), c("syz"), c("sy"), c("sx"), c("sz"), c("n"))
    dof = det3(c("sxx"), c("sxy"), c("sxz"), c("sxy"), c("syy"), c("syz"), c("sx"), c("sy"), c("sz"))
    m = m.withColumn("_det", det)
    plane, bad = c("n") >= 3, (c("n") >= 3) & (F.abs(c("_det")) < 1e-9)
    solve = lambda num: F.when(~bad, num / c("_det"))
    return m.select(
        *key, F.col("n").cast("bigint").alias("n_points"), F.col("_o.x").alias("ox"), F.col("_o.y").alias("oy"),
        F.when(plane, solve(dof)).otherwise(c("sz") / c("n")).alias("offset"),
        F.when(plane, solve(dgx)).otherwise(0.0).alias("gx"), F.when(plane, solve(dgy)).otherwise(0.0).alias("gy"),
        F.when(bad, "control points are collinear").alias("reject_reason"),
    )


def other_side(w: DataFrame, key: str, inside: str = "_in") -> DataFrame:
    """Adds _d2, the exact squared distance in cells to the nearest cell of the other kind within the same key's window; null for none.

    ``w``: one row per (key, r, c), a full rectangle of cells for each key. Separable: first along columns, by windows over (key, column), then along rows as a lower envelope of
    parabolas, (key, row) by (key, row). Both passes are linear in the cells, however wide the transition is.
    """
    up = Window.partitionBy(key, "c").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(key, "c").orderBy("r").rowsBetween(0, Window.unboundedFollowing)
    is_in = F.col(inside)

    def along(kind: Column) -> Column:
        at = F.when(kind, F.col("r"))
        return F.least(F.col("r") - F.last(at, ignorenulls=True).over(up), F.first(at, ignorenulls=True).over(down) - F.col("r"))

    rows = w.withColumns({"_to_in": along(is_in), "_to_out": along(~is_in)})
    rows = rows.groupBy(key, "r").agg(F.array_sort(F.collect_list(F.struct("c", F.col(inside).alias("i"), "_to_in", "_to_out"))).alias("x"))
    rows = rows.select(key, "r", F.col("x.c").alias("_c"), rasters.row_distance_udf("x.c", "x.i", "x._to_in", "x._to_out").alias("_d2"))
    d = rows.select(key, "r", F.explode(F.arrays_zip("_c", "_d2")).alias("y")).select(key, "r", F.col("y._c").alias("c"), "y._d2")
    return w.join(d, [key, "r", "c"], "left")


def flatten_pad(cells: DataFrame, grid: DataFrame, pads: DataFrame, walls: DataFrame, key: str, px: float,
                slope: float = rules.SLOPE_RATIO) -> DataFrame:
    """Relief of each site with its pad flattened to the design height.

    The transition width is the slope run at the largest difference (at least 1 m). Cells further
    than half the width from the pad keep their height, so only a window around the pad is
    produced: one row per (pad, cell) inside it. ``pads``: key, source_id, design_z, pad_ring;
    ``walls``: key, max_diff_m.
    """
    p = pads.join(walls.select(key, "max_diff_m"), key)
    p = p.withColumn("width_m", F.greatest(F.col("max_diff_m") * slope, F.lit(1.0)))
    p = with_header(geom.with_bbox(p, "pad_ring", "_"), grid)
    half = F.col("width_m") / 2.0 + px
    at_least = lambda v: F.greatest(F.floor(v).cast("bigint"), F.lit(0).cast("bigint"))
    r0, r1 = at_least((F.col("y0") - F.col("_maxy") - half) / px - 0.5), F.least(F.ceil((F.col("y0") - F.col("_miny") + half) / px - 0.5), F.col("height") - 1)
    c0, c1 = at_least((F.col("_minx") - half - F.col("x0")) / px - 0.5), F.least(F.ceil((F.col("_maxx") + half - F.col("x0")) / px - 0.5), F.col("width") - 1)
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    w = p.withColumn("r", F.explode(span(r0, r1))).withColumn("c", F.explode(span(c0, c1)))
    x, y = cell_centre(F.col("r"), F.col("c"))
    w = w.withColumns({"_in": geom.covers(x, y, F.col("pad_ring"))})
    w = other_side(w, key)
    dist = F.coalesce(F.sqrt(F.col("_d2").cast("double")) * px, F.col("width_m"))
    signed = F.when(F.col("_in"), dist).otherwise(-dist)
    alpha = geom.clamp01((signed + F.col("width_m") / 2.0) / F.col("width_m"))
    z = cells.select("source_id", F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), "z")
    w = w.withColumn("alpha", alpha).join(z, ["source_id", "r", "c"])
    return w.select(
        key, "r", "c", "alpha", (F.col("alpha") * F.col("design_z") + (1.0 - F.col("alpha")) * F.col("z")).alias("z")
    )


def quads(cells: DataFrame) -> DataFrame:
    """Two triangles per grid square whose four corners all have heights; corners as (r, c) of the square."""
    c = cells.where(F.col("z").isNotNull())
    part = lambda dr, dc: F.struct((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(dr * 2 + dc).alias("k"))
    e = c.select("source_id", "z", F.explode(F.array(part(0, 0), part(0, 1), part(1, 0), part(1, 1))).alias("_q"))
    g = e.groupBy("source_id", F.col("_q.r").alias("r"), F.col("_q.c").alias("c")).agg(
        *[F.max(F.when(F.col("_q.k") == k, F.col("z"))).alias(f"z{k}") for k in range(4)], F.count(F.lit(1)).alias("_n")
    ).where("_n = 4").drop("_n")
    tri = lambda half, *ks: F.struct(F.lit(half).alias("half"), *[F.lit(k).alias(f"k{i}") for i, k in enumerate(ks)])
    return g.withColumn("_t", F.explode(F.array(tri(0, 0, 2, 1), tri(1, 1, 2, 3))))


def faces(cells: DataFrame) -> DataFrame:
    """Face table (face half, three corner cells with heights)."""
    q = quads(cells)
    out = [F.col("_t.half").alias("half")]
    zs = F.array("z0", "z1", "z2", "z3")
    for i in range(3):
        k = F.col(f"_t.k{i}")
        out += [
            (F.col("r") + F.floor(k / 2).cast("int")).alias(f"r{i}"), (F.col("c") + k % 2).alias(f"c{i}"),
            F.get(zs, k).alias(f"fz{i}"),
        ]
    return q.select("source_id", "r", "c", *out)


def degenerate_faces(face_table: DataFrame, vertices: DataFrame, eps_m2: float = rules.DEGENERATE_AREA_M2) -> DataFrame:
    """Faces (face_id, v0, v1, v2) whose planar area is at most eps; vertices (v, x, y).

    Corners are exploded to one join with the vertex table instead of three.
    """
    corners = face_table.select("face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "v"))
    hit = corners.join(vertices, "v").groupBy("face_id").agg(
        *[F.max(F.when(F.col("k") == k, F.col(a))).alias(f"{a}{k}") for k in range(3) for a in ("x", "y")]
    )
    c = F.col
    area = F.abs((c("x1") - c("x0")) * (c("y2") - c("y0")) - (c("x2") - c("x0")) * (c("y1") - c("y0"))) / 2.0
    return hit.select("face_id", area.alias("area_m2")).where(F.col("area_m2") <= eps_m2)


def outside_areas(points: DataFrame, areas: DataFrame, point_id: Sequence[str], cell: float = 250.0, ring: str = "ring") -> DataFrame:
    """Points neither inside nor on the edge of any area; equal areas count once. areas: ring, bbox columns."""
    spots = areas.groupBy(ring, *BOX).agg(F.lit(1).alias("_1")).drop("_1")
    hit = first_cover(points, spots, geom.covers, cell=cell, point_id=list(point_id), ring=ring).drop("_best")
    return points.join(hit, list(point_id), "left_anti")


def deduped_points(points: DataFrame, by: Sequence[str] = (), tol: float = 0.01) -> DataFrame:
    """One point per ``tol`` cell: building over water over road over terrain, the earlier one among equals.

    points: x, y, z, source, seq.
    """
    rank = F.lit(0)
    for name, p in rules.POINT_SOURCE_PRIORITY.items():
        rank = F.when(F.col("source") == name, -p).otherwise(rank)
    g = points.groupBy(*by, F.rint(F.col("x") / tol).alias("_kx"), F.rint(F.col("y") / tol).alias("_ky")).agg(
        F.min(F.struct(rank.alias("rank"), "seq", "x", "y", "z", "source")).alias("_b")
    )
    return g.select(*by, "_b.seq", "_b.x", "_b.y", "_b.z", "_b.source")
