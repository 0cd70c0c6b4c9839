"""Work along lines: resampling, profiles, poles and wires, crossings, node graph, ribbons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom
from sitewright.functions.attributes import road_network
from sitewright.functions.numbers import non_empty
from sitewright.functions.tags import is_unpaved
from sitewright.operators.chunks import haloed, own_rows, sequenced
from sitewright.operators.relief import sample, with_header
from sitewright.operators.spatial import along_cells, box_pairs, points_in_boxes, points_near_paths, salted_join, spread
from sitewright.sources.tables import write_and_read


def even_points(lines: DataFrame, spacing: float, path: str = "path") -> DataFrame:
    """max(1, ceil(length / spacing)) equal spans, both ends included. Adds i, n_spans, x, y."""
    length = geom.path_length(F.col(path))
    l = lines.withColumn("_len", length).where(F.col("_len") > 0)
    n = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_len") / spacing).cast("bigint"))
    l = l.withColumn("n_spans", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_spans"))))
    d = F.least(F.col("i") * (F.col("_len") / F.col("n_spans")), F.col("_len"))
    p = geom.interpolate(F.col(path), d)
    return l.withColumn("d", d).withColumn("_p", p).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p", "_len")


def catenary_poles(lines: DataFrame, spacing: float = rules.CATENARY_SPACING_M, offset: float = rules.CATENARY_OFFSET_M,
                   path: str = "path") -> DataFrame:
    """Masts at a fixed spacing, moved sideways off the axis; the tangent looks 0.1 m ahead."""
    l = lines.withColumn("_len", geom.path_length(F.col(path))).where(F.col("_len") > 0)
    l = l.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("_len") / spacing).cast("bigint"))))
    d = F.least(F.col("i") * spacing, F.col("_len"))
    l = l.withColumns({
        "_p": geom.interpolate(F.col(path), d), "_a": geom.interpolate(F.col(path), F.least(d + 0.1, F.col("_len"))),
    })
    dx, dy = F.col("_a.x") - F.col("_p.x"), F.col("_a.y") - F.col("_p.y")
    l = l.withColumn("_n", F.sqrt(dx * dx + dy * dy)).where(F.col("_n") > 0)
    return l.withColumns({
        "x": F.col("_p.x") - dy / F.col("_n") * offset, "y": F.col("_p.y") + dx / F.col("_n") * offset,
    }).drop("_p", "_a", "_n", "_len")


def profile_points(lines: DataFrame, step: float, path: str = "path") -> DataFrame:
    """n + 1 equal samples with n = max(int(length / step), 1). Adds i, n, d, x, y."""
    l = lines.withColumn("_len", geom.path_length(F.col(path))).where(F.col("_len") > 0)
    l = l.withColumn("n", F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("_len") / step).cast("bigint")))
    l = l.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n"))))
    l = l.withColumn("d", F.col("_len") * (F.col("i") / F.col("n")))
    return l.withColumn("_p", geom.interpolate(F.col(path), F.col("d"))).withColumns(
        {"x": F.col("_p.x"), "y": F.col("_p.y")}
    ).drop("_p", "_len")


def smoothed_profile(points: DataFrame, key: str, step: float, window_m: float, chunk: int = 4096) -> DataFrame:
    """Centred moving mean of z over i = 0..n with linearly extrapolated ends.

    Missing heights take the line mean, a line without any height is 0. Long lines are cut into
    chunks with a halo, so one line never has to fit a task.
    """
    half = max(int(window_m / step / 2), 1)
    means = points.groupBy(key).agg(F.avg("z").alias("_mean"))
    p = salted_join(points, means, [key], [key, "i"], how="left")
    p = p.withColumn("_z", F.coalesce("z", "_mean", F.lit(0.0))).drop("_mean")
    h = haloed(p, "i", chunk, half + 1)
    w = Window.partitionBy(key, "_ck").orderBy("i")
    h = h.withColumns({
        "_nx": F.first("_z").over(w.rangeBetween(1, 1)), "_pv": F.last("_z").over(w.rangeBetween(-1, -1)),
    })
    f = w.rangeBetween(-half, half)
    z0, z1 = F.first("_z").over(f), F.first("_nx").over(f)
    zn, zm = F.last("_z").over(f), F.last("_pv").over(f)
    ml = F.greatest(F.lit(half) - F.col("i"), F.lit(0)).cast("double")
    mr = F.greatest(F.col("i") + half - F.col("n"), F.lit(0)).cast("double")
    tri = lambda k: k * (k + 1.0) / 2.0
    total = F.sum("_z").over(f) + ml * z0 - (z1 - z0) * tri(ml) + mr * zn + (zn - zm) * tri(mr)
    return own_rows(h.withColumn("z_smooth", total / float(2 * half + 1))).drop("_z", "_nx", "_pv")


def line_profile(lines: DataFrame, cells: DataFrame, grid: DataFrame, key: str, step: float, window_m: float,
                 path: str = "path") -> DataFrame:
    """Samples along each line with relief heights, smoothed."""
    pts = profile_points(lines.select(key, "source_id", path), step, path).drop(path)
    return smoothed_profile(sample(pts, cells, grid, [key, "i"]), key, step, window_m)


def at_profile(points: DataFrame, profile: DataFrame, key: str, point_id: Sequence[str], step_d: str = "d",
               z: str = "z_smooth") -> DataFrame:
    """Linear interpolation of a line's profile at distance ``pos`` along it, ends clamped.

    Samples are equally spaced, so the bracketing pair is found by index: an equi-join, no as-of scan.
    ``points`` needs key, pos, line_len and n (samples - 1).
    """
    p = points.withColumn("_f", F.when(F.col("line_len") > 0, F.col("pos") / F.col("line_len") * F.col("n")).otherwise(0.0))
    p = p.withColumn("_f", F.greatest(F.lit(0.0), F.least(F.col("_f"), F.col("n").cast("double"))))
    lo = F.least(F.floor("_f").cast("bigint"), F.col("n") - 1)
    p = p.withColumn("_lo", lo).withColumn("i", F.explode(F.array(lo, lo + 1)))
    prof = profile.select(key, "i", F.col(z).alias("_z"))
    j = p.join(prof, [key, "i"], "left")
    rest = [c for c in points.columns if c not in (*point_id, key)]
    g = j.groupBy(*point_id, key).agg(
        F.any_value(F.struct("_f", "_lo", *rest)).alias("_p"),
        F.max(F.when(F.col("i") == F.col("_lo"), F.col("_z"))).alias("_a"),
        F.max(F.when(F.col("i") > F.col("_lo"), F.col("_z"))).alias("_b"),
    )
    t = F.col("_p._f") - F.col("_p._lo")
    return g.select(*point_id, key, *[F.col(f"_p.{c}").alias(c) for c in rest], (F.col("_a") + (F.col("_b") - F.col("_a")) * t).alias("profile_z"))


def edge_points(profile: DataFrame, lines: DataFrame, key: str, width: str = "width_m", path: str = "path") -> DataFrame:
    """Centre, left and right points per profile sample, all at the sample's height."""
    p = salted_join(profile, lines.select(key, path, width), [key], [key, "i"])
    total = geom.path_length(F.col(path))
    p = p.withColumns({
        "_b": geom.interpolate(F.col(path), F.greatest(F.col("d") - 0.5, F.lit(0.0))),
        "_a": geom.interpolate(F.col(path), F.least(F.col("d") + 0.5, total)),
    })
    dx, dy = F.col("_a.x") - F.col("_b.x"), F.col("_a.y") - F.col("_b.y")
    n = F.sqrt(dx * dx + dy * dy)
    p = p.withColumns({"_ux": F.when(n > 0, -dy / n).otherwise(0.0), "_uy": F.when(n > 0, dx / n).otherwise(0.0)})
    p = p.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    return p.withColumns({
        "x": F.col("x") + F.col("side") * F.col("_ux") * F.col(width) / 2.0,
        "y": F.col("y") + F.col("side") * F.col("_uy") * F.col(width) / 2.0,
    }).drop("_b", "_a", "_ux", "_uy", path)


# --- power ------------------------------------------------------------------------------------


def poles_on_lines(lines: DataFrame, poles: DataFrame, line_id: str, pole_id: str, snap_m: float = rules.POLE_SNAP_M,
                   path: str = "path", cell: float = 8.0) -> DataFrame:
    """Poles within the snap distance of a line with their position along it."""
    p = points_near_paths(poles, lines, cell=cell, point_id=[pole_id], path=path, reach=snap_m)
    x, y = F.col("x"), F.col("y")
    p = p.where(geom.dist_to_path(x, y, F.col(path)) <= snap_m)
    return p.withColumn("pos", geom.project_along(x, y, F.col(path)))


def lines_without_poles(lines: DataFrame, poles: DataFrame, line_id: str, snap_m: float = rules.POLE_SNAP_M, path: str = "path") -> DataFrame:
    """Lines that no pole is near; poles at one spot count once."""
    spots = poles.groupBy("x", "y").agg(F.min("pole_id").alias("pole_id"))
    near = poles_on_lines(lines.select(line_id, path), spots, line_id, "pole_id", snap_m, path)
    return lines.join(near.groupBy(line_id).agg(F.lit(1).alias("_n")).select(line_id), line_id, "left_anti")


def spans(on_line: DataFrame, line_id: str, pole_id: str, band_m: float = 5000.0, carry: Sequence[str] = ("x", "y", "height_m")) -> DataFrame:
    """Consecutive pole pairs along each line; lines with fewer than two poles and zero spans drop out."""
    s = sequenced(
        on_line, [line_id], ["pos", pole_id], F.floor(F.col("pos") / band_m), number="pos_no",
        following={"b_" + c: c for c in carry} | {"b_id": pole_id},
    ).where(F.col("b_id").isNotNull())
    dx, dy = F.col("b_x") - F.col("x"), F.col("b_y") - F.col("y")
    return s.withColumn("span_m", F.sqrt(dx * dx + dy * dy)).where(F.col("span_m") > 0)


def strands(span_rows: DataFrame, cables: str = "cables", spacing: float = rules.PHASE_SPACING_M) -> DataFrame:
    """One row per wire of a span with its sideways offset; a span without a number of cables has the default."""
    n = F.coalesce(F.col(cables).cast("bigint"), F.lit(rules.CABLES_DEFAULT).cast("bigint"))
    s = span_rows.withColumn("strand", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return s.withColumn("offset_m", (F.col("strand") - (n - 1) / 2.0) * spacing)


def wire_points(strand_rows: DataFrame, samples: int = rules.WIRE_SAMPLES, sag: float = rules.SAG_RATIO) -> DataFrame:
    """Sagging wire as a parabola: needs x, y, za, b_x, b_y, zb, span_m, offset_m."""
    c = F.col
    ux, uy = -(c("b_y") - c("y")) / c("span_m"), (c("b_x") - c("x")) / c("span_m")
    w = strand_rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples))))
    t = c("k") / float(samples)
    return w.withColumns({
        "wx": c("x") + ux * c("offset_m") + t * (c("b_x") - c("x")),
        "wy": c("y") + uy * c("offset_m") + t * (c("b_y") - c("y")),
        "wz": c("za") + t * (c("zb") - c("za")) - c("span_m") * sag * 4.0 * t * (1.0 - t),
    })


# --- crossings and bridges --------------------------------------------------------------------


def axis_crossings(bridges: DataFrame, axes: DataFrame, bridge_id: str, axis_id: str, cell: float = 200.0, by: Sequence[str] = ()) -> DataFrame:
    """Point intersections of bridge axes with other axes, per segment pair. Both sides: id and path.

    With ``by`` both sides are rows of one segment (bs, os) and a place that it runs through, and meet where ``by`` is equal.
    """
    def seg_rows(df, key, p):
        rows = df.withColumn(p + "s", F.explode(geom.segments(F.col("path")))).drop("path")
        s = F.col(p + "s")
        return rows.withColumns({
            p + "x0": F.least(s.x0, s.x1), p + "x1": F.greatest(s.x0, s.x1),
            p + "y0": F.least(s.y0, s.y1), p + "y1": F.greatest(s.y0, s.y1),
        })

    if by:
        pairs = salted_join(bridges, axes, by, [bridge_id], small=False)
    else:
        a, b = seg_rows(bridges, bridge_id, "b"), seg_rows(axes, axis_id, "o")
        pairs = box_pairs(
            a, b, cell=cell, left_id=[bridge_id], lbox=("bx0", "by0", "bx1", "by1"), rbox=("ox0", "oy0", "ox1", "oy1"),
        )
    for step in geom.segment_crossing_steps(F.col("bs"), F.col("os")):
        pairs = geom.fenced(pairs, **step)
        if "_u" in step:
            pairs = pairs.where((F.col("_s") >= 0) & (F.col("_s") <= 1) & (F.col("_u") >= 0) & (F.col("_u") <= 1))
    return pairs.drop("_det", "_s", "_u", "bs", "os", *[f"{p}{q}" for p in "bo" for q in ("x0", "x1", "y0", "y1")])


def _on_raster(segs: DataFrame, grid: DataFrame, seg: str) -> DataFrame:
    """A row for each square of four raster cell centres that a segment runs through: _cx, _cy, their first column and row."""
    head = {n: F.col(n).alias("_g_" + n) for n in ("x0", "y0", "px", "width", "height")}
    s = with_header(segs.where(F.col(seg).isNotNull()), grid.select("source_id", *head.values()))
    c, r = (lambda x: (x - F.col("_g_x0")) / F.col("_g_px") - 0.5), (lambda y: (F.col("_g_y0") - y) / F.col("_g_px") - 0.5)
    s = s.withColumns({"_c0": c(F.col(f"{seg}.x0")), "_r0": r(F.col(f"{seg}.y0")), "_c1": c(F.col(f"{seg}.x1")), "_r1": r(F.col(f"{seg}.y1"))})
    none = F.lit(0).cast("bigint")
    return along_cells(spread(s), F.lit(1.0), ("_c0", "_r0", "_c1", "_r1"), [none, F.col("_g_width") - 1, none, F.col("_g_height") - 1])


def _square_heights(squares: DataFrame, cells: DataFrame) -> DataFrame:
    """The four heights _h0 to _h3 of each square of ``_on_raster``; those with a missing height drop out."""
    key = ["source_id", "_cx", "_cy"]
    one = squares.groupBy(*key).agg(F.max("_g_width").alias("_w"), F.max("_g_height").alias("_h"))
    one = one.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    at = {"_c": F.least(F.col("_cx") + F.col("_k") % 2, F.col("_w") - 1), "_r": F.least(F.col("_cy") + F.floor(F.col("_k") / 2), F.col("_h") - 1)}
    z = cells.select("source_id", F.col("r").cast("bigint").alias("_r"), F.col("c").cast("bigint").alias("_c"), F.col("z").alias("_z"))
    four = one.withColumns(at).join(z, ["source_id", "_r", "_c"]).groupBy(*key).agg(*[F.max(F.when(F.col("_k") == k, F.col("_z"))).alias(f"_h{k}") for k in range(4)])
    return four.dropna()


def _square_height(fc: Column, fr: Column) -> Column:
    top = F.col("_h0") * (1.0 - fc) + F.col("_h1") * fc
    bottom = F.col("_h2") * (1.0 - fc) + F.col("_h3") * fc
    return top * (1.0 - fr) + bottom * fr


def _with_least_clearance(stretches: DataFrame) -> DataFrame:
    """Adds _low, a bound below every clearance of the bridge segment in its square: over a straight deck it is a quadratic of the place along the segment."""
    c = F.col
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for a, b, k in (("_c0", "_c1", "_cx"), ("_r0", "_r1", "_cy")):
        d = F.when(c(a) != c(b), c(b) - c(a))
        u, v = (c(k) - c(a)) / d, (c(k) + 1 - c(a)) / d
        enter.append(F.coalesce(F.least(u, v), F.lit(0.0)))
        leave.append(F.coalesce(F.greatest(u, v), F.lit(1.0)))
    s = geom.fenced(stretches, _u0=F.least(F.greatest(*enter), F.lit(1.0)), _u1=F.least(*leave))
    s = s.withColumn("_u1", F.greatest("_u0", "_u1"))

    def clearance(u):
        z = _square_height(c("_c0") + u * (c("_c1") - c("_c0")) - c("_cx"), c("_r0") + u * (c("_r1") - c("_r0")) - c("_cy"))
        return c("z0") + (c("z1") - c("z0")) * u - z

    s = geom.fenced(s, _f0=clearance(c("_u0")), _fm=clearance((c("_u0") + c("_u1")) / 2), _f1=clearance(c("_u1")))
    first, last, own = F.get("path", F.lit(0)), F.get("path", F.lit(1)), c("bs")
    whole = (F.size("path") == 2) & (first.x == own.x0) & (first.y == own.y0) & (last.x == own.x1) & (last.y == own.y1)
    heights = [c(f"_h{k}") for k in range(4)]
    straight = F.least("_f0", "_fm", "_f1") - F.abs(c("_f0") - 2 * c("_fm") + c("_f1")) / 8
    low = F.when(whole, straight).otherwise(F.least("z0", "z1") - F.greatest(*heights))
    slack = 2e-6 * (1 + F.abs(c("z0")) + F.abs(c("z1")) + F.greatest(*[F.abs(h) for h in heights]))
    return s.withColumn("_low", low - slack).drop("_u0", "_u1", "_f0", "_fm", "_f1")


FEW = 16


def bridge_clearance(bridges: DataFrame, axes: DataFrame, cells: DataFrame, grid: DataFrame, bridge_id: str, axis_id: str) -> DataFrame:
    """Deck clearance over roads and rails; a deficit lifts the deck and marks it calculated.

    The deck runs straight between the ground heights at both ends. bridges: id, source_id, path; axes: id, source_id, kind, path.

    Bridges and axes meet in the squares of the raster that they run through, so a crossing has its ground heights at hand and is
    not shuffled. Crossings with one in ``FEW`` axes bound a bridge's least clearance from above; the squares where the whole
    stretch of the bridge is higher cannot hold the least one and meet no other axes. The bound only leaves work out: the result is
    the least over all crossings.
    """
    p = F.col("path")
    ends = bridges.select(bridge_id, "source_id", F.explode(F.array(
        F.struct(F.lit(0).alias("e"), F.get(p, F.lit(0)).alias("v")), F.struct(F.lit(1).alias("e"), F.element_at(p, F.lit(-1)).alias("v")),
    )).alias("_e")).select(bridge_id, "source_id", "_e.e", F.col("_e.v.x").alias("x"), F.col("_e.v.y").alias("y"))
    ez = sample(ends, cells, grid, [bridge_id, "e"]).groupBy(bridge_id).agg(
        F.coalesce(F.max(F.when(F.col("e") == 0, F.col("z"))), F.lit(0.0)).alias("z0"),
        F.coalesce(F.max(F.when(F.col("e") == 1, F.col("z"))), F.lit(0.0)).alias("z1"),
    )
    deck = bridges.select(bridge_id, "path").join(ez, bridge_id).withColumn("_len", geom.path_length(p))
    square = ["source_id", "_cx", "_cy"]
    stretches = _on_raster(bridges.select(bridge_id, "source_id", F.explode(geom.segments(p)).alias("bs")), grid, "bs")
    heights = _square_heights(stretches, cells)
    stretches = salted_join(stretches, heights, square, [bridge_id], small=False)
    stretches = salted_join(stretches, deck.where(F.col("_len") > 0), [bridge_id], [bridge_id], small=False)
    stretches = _with_least_clearance(stretches).drop("_c0", "_r0", "_c1", "_r1")
    stretches = write_and_read(stretches.withColumn("kind", F.explode(F.array(F.lit("road"), F.lit("rail")))), "stretches")
    across = _on_raster(axes.select(axis_id, "source_id", "kind", F.explode(geom.segments(p)).alias("os")), grid, "os").select(axis_id, "kind", "os", *square)

    def least(stretches: DataFrame, across: DataFrame) -> DataFrame:
        x = axis_crossings(stretches, across, bridge_id, axis_id, by=[*square, "kind"])
        cf, rf = (F.col("x") - F.col("_g_x0")) / F.col("_g_px") - 0.5, (F.col("_g_y0") - F.col("y")) / F.col("_g_px") - 0.5
        x = x.withColumns({"_cf": cf, "_rf": rf}).where((F.floor("_cf") == F.col("_cx")) & (F.floor("_rf") == F.col("_cy")))
        x = x.where((F.col("_cf") <= F.col("_g_width") - 1) & (F.col("_rf") <= F.col("_g_height") - 1))
        t = geom.project_along(F.col("x"), F.col("y"), p) / F.col("_len")
        ground = _square_height(F.col("_cf") - F.floor("_cf"), F.col("_rf") - F.floor("_rf"))
        return x.groupBy(bridge_id, "kind").agg(F.min(F.col("z0") + (F.col("z1") - F.col("z0")) * t - ground).alias("_c"))

    known = least(stretches, across.where(F.pmod(F.xxhash64(axis_id), F.lit(FEW)) == 0)).withColumnRenamed("_c", "_known")
    low = salted_join(stretches, known, [bridge_id, "kind"], [bridge_id], "left", small=False).where("_known IS NULL OR _low <= _known").drop("_known")
    c = least(low, across)
    m = c.groupBy(bridge_id).agg(
        F.min(F.when(F.col("kind") == "road", F.col("_c"))).alias("road"), F.min(F.when(F.col("kind") == "rail", F.col("_c"))).alias("rail")
    )
    out = bridges.select(bridge_id).join(m, bridge_id, "left")
    zero = F.lit(0.0)
    lift = F.greatest(
        F.coalesce(rules.BRIDGE_CLEARANCE_ROAD_M - F.col("road"), zero), F.coalesce(rules.BRIDGE_CLEARANCE_RAIL_M - F.col("rail"), zero), zero
    )
    return out.select(
        bridge_id, (F.least("road", "rail") + lift).alias("clearance_m"), lift.alias("lift_m"),
        F.when(lift > 0, rules.STATUS_CALCULATED).otherwise(rules.STATUS_OFFICIAL).alias("status"),
    )


# --- road graph and lanes ---------------------------------------------------------------------


def node_graph(ways: DataFrame, way_id: str = "way_id") -> tuple[DataFrame, DataFrame]:
    """Nodes (first coordinate, number of ways) and directed edges of ways given as nodes[] and path[].

    Ways whose node and vertex counts differ, or with fewer than two, are skipped.
    """
    ok = ways.where((F.size("nodes") == F.size("path")) & (F.size("nodes") >= 2))
    v = ok.select(way_id, F.posexplode(F.arrays_zip("nodes", "path")).alias("seq", "_v"))
    v = v.select(way_id, "seq", F.col("_v.nodes").alias("node"), F.col("_v.path.x").alias("x"), F.col("_v.path.y").alias("y"))
    per_way = v.groupBy("node", way_id).agg(F.min(F.struct(way_id, "seq", "x", "y")).alias("_f"))
    nodes = per_way.groupBy("node").agg(F.count(F.lit(1)).alias("n_ways"), F.min("_f").alias("_f")).select(
        "node", F.col("_f.x").alias("x"), F.col("_f.y").alias("y"), "n_ways", (F.col("n_ways") > 1).alias("junction")
    )
    pair = F.zip_with(
        F.slice("nodes", F.lit(1), F.size("nodes") - 1), F.slice("nodes", F.lit(2), F.size("nodes") - 1),
        lambda a, b: F.struct(a.alias("node_from"), b.alias("node_to")),
    )
    edges = ok.select(way_id, F.posexplode(pair).alias("seq", "_e")).select(way_id, "seq", "_e.node_from", "_e.node_to")
    return nodes, edges


def lane_attributes(lanes: DataFrame, ways: DataFrame, lane_id: str = "lane_id") -> DataFrame:
    """Surface and network of a lane from the first of its ways that carries the tag; verges are grass."""
    l = lanes.select(lane_id, "lane_type", F.posexplode("way_ids").alias("pos", "way_id"))
    j = l.join(ways.select("way_id", "surface", "highway"), "way_id", "left")
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    g = j.groupBy(lane_id).agg(
        F.any_value("lane_type").alias("lane_type"),
        F.min_by("surface", F.when(full("surface"), F.col("pos"))).alias("_s"),
        F.min_by("highway", F.when(full("highway"), F.col("pos"))).alias("_h"),
    )
    return g.select(
        lane_id, F.when(F.col("lane_type") == rules.GRASS_VERGE_LANE, "grass").otherwise(non_empty(F.col("_s"))).alias("surface"),
        road_network(F.trim("_h")).alias("network"),
    )


def network_by_touch(areas: DataFrame, lanes: DataFrame, area_id: str, cell: float = 100.0) -> DataFrame:
    """An area touching any backbone lane is backbone. lanes: ring, network; areas: id, ring."""
    backbone = lanes.where(F.col("network") == rules.NETWORK_BACKBONE).groupBy(F.col("ring").alias("lring")).agg(F.lit(1).alias("_1"))
    b = geom.with_bbox(backbone.drop("_1"), "lring", "l")
    # one lane corner a small cell settles most areas without pairs; the rest meets every lane near it
    corner = backbone.select(F.get("lring", F.lit(0)).x.alias("x"), F.get("lring", F.lit(0)).y.alias("y"))
    near = lambda v: F.floor(F.col(v) / (cell / 2.0))
    corner = corner.groupBy(near("x"), near("y")).agg(F.min(F.struct("x", "y")).alias("_c")).select("_c.x", "_c.y")
    over = points_in_boxes(corner, geom.with_bbox(areas.select(area_id, "ring"), "ring"), cell=cell, point_id=["x", "y"])
    over = over.where(geom.covers(F.col("x"), F.col("y"), F.col("ring"))).select(area_id)
    a = geom.with_bbox(areas.select(area_id, "ring").join(over.distinct(), area_id, "left_anti"), "ring", "a")
    pairs = box_pairs(
        b, a, cell=cell, left_id=["lminx", "lminy", "lmaxx", "lmaxy"], lbox=("lminx", "lminy", "lmaxx", "lmaxy"),
        rbox=("aminx", "aminy", "amaxx", "amaxy"),
    )
    met = pairs.where(geom.areas_meet_in_boxes(F.col("ring"), F.col("lring"))).select(area_id)
    hit = over.unionByName(met).groupBy(area_id).agg(F.lit(True).alias("_hit"))
    out = areas.join(hit, area_id, "left")
    return out.withColumn("network", F.when(F.col("_hit"), rules.NETWORK_BACKBONE).otherwise(rules.NETWORK_INTERNAL)).drop("_hit")


def curbs(lanes: DataFrame, ways: DataFrame) -> DataFrame:
    """Common edges of driving and sidewalk lanes of one way set; unpaved way sets have none.

    lanes: way_ids, lane_type, ring. Edges meet by their normalised end points.
    """
    l = lanes.where(F.col("lane_type").isin("Driving", "Sidewalk")).withColumn("ways_key", F.array_join(F.transform("way_ids", lambda w: w.cast("string")), ","))
    # lanes are dealt evenly before each becomes many edges, so that no task counts the edges of a large file alone
    e = spread(l.select("ways_key", "lane_type", "ring"), "ways_key", "ring").select("ways_key", "lane_type", F.explode(geom.segments(F.col("ring"))).alias("s"))
    a, b = F.struct(F.col("s.x0").alias("x"), F.col("s.y0").alias("y")), F.struct(F.col("s.x1").alias("x"), F.col("s.y1").alias("y"))
    e = e.withColumns({"lo": F.least(a, b), "hi": F.greatest(a, b)})
    # edges inside one lane type (between two lanes of the union) are not on its outline: they appear twice
    per_type = e.groupBy("ways_key", "lo", "hi").agg(
        F.count_if(F.col("lane_type") == "Driving").alias("nd"), F.count_if(F.col("lane_type") == "Sidewalk").alias("ns"),
    )
    shared = per_type.where((F.col("nd") == 1) & (F.col("ns") == 1)).drop("nd", "ns")
    bad = ways.where(is_unpaved(F.col("surface"))).select("way_id").distinct()
    dirty = l.select("ways_key", F.explode(F.array_distinct("way_ids")).alias("way_id")).join(bad, "way_id", "left_semi").select("ways_key").distinct()
    out = shared.join(dirty, "ways_key", "left_anti")
    length = geom.length_between(F.col("lo.x"), F.col("lo.y"), F.col("hi.x"), F.col("hi.y"))
    return out.select(
        "ways_key", F.col("lo.x").alias("x0"), F.col("lo.y").alias("y0"), F.col("hi.x").alias("x1"), F.col("hi.y").alias("y1"),
        length.alias("length_m"), (length * rules.CURB_WIDTH_M).alias("area_m2"),
    )


# --- ribbons ----------------------------------------------------------------------------------


def ribbon_area(path: Column, width: Column) -> Column:
    """Area of a flat-ended ribbon, length times width per segment."""
    return geom.path_length(path) * width


def in_ribbon(x: Column, y: Column, path: Column, half_width: Column) -> Column:
    """Flat-ended corridor: foot of the perpendicular inside a segment and close enough."""
    def hit(s):
        dx, dy = s.x1 - s.x0, s.y1 - s.y0
        len2 = dx * dx + dy * dy
        dot = (x - s.x0) * dx + (y - s.y0) * dy
        cross = (x - s.x0) * dy - (y - s.y0) * dx
        return (len2 > 0) & (dot >= 0) & (dot <= len2) & (cross * cross <= half_width * half_width * len2)

    # one segment, which many axes are, is told without a pass over an array
    a, b = F.get(path, F.lit(0)), F.get(path, F.lit(1))
    one = geom.Ends(a.x, a.y, b.x, b.y)
    return F.when(F.size(path) == 2, hit(one)).otherwise(F.exists(geom.segments(path), hit))


def ribbon_members(points: DataFrame, ribbons: DataFrame, point_id: str, half_width: str = "half_width", cell: float = 8.0) -> DataFrame:
    """Points inside corridors given as (axis path, half width)."""
    p = points_near_paths(points, ribbons, cell=cell, point_id=[point_id], reach=F.col(half_width))
    return p.where(in_ribbon(F.col("x"), F.col("y"), F.col("path"), F.col(half_width)))


def alignment_segments(axes: DataFrame, key: str, path: str = "path") -> DataFrame:
    """Start and end of every segment of usable axes, with the axis length."""
    a = axes.withColumn("axis_length", geom.path_length(F.col(path))).where((F.size(path) >= 2) & (F.col("axis_length") > 0))
    s = a.select(key, "axis_length", F.posexplode(geom.segments(F.col(path))).alias("seq", "s"))
    return s.select(key, "seq", "axis_length", "s.x0", "s.y0", "s.x1", "s.y1")


def rebuilt_axes(roads: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """New axes for internal roads only; each refusal carries its reason.

    roads: key, network, n_parts, width_m; edits: key, new_path.
    """
    j = edits.join(roads, key)
    length = geom.path_length(F.col("new_path"))
    reason = (
        F.when(F.col("network") != rules.NETWORK_INTERNAL, "backbone road is not editable")
        .when(F.col("n_parts") != 1, "road has no single axis").when(length <= 0, "new axis has no length")
    )
    return j.withColumns({
        "reject_reason": reason, "new_length_m": F.when(reason.isNull(), length),
        "new_area_m2": F.when(reason.isNull(), ribbon_area(F.col("new_path"), F.col("width_m"))),
    })


def max_deviation(lines: DataFrame, cells: DataFrame, grid: DataFrame, key: str, target: Column, step: float = 2.0) -> DataFrame:
    """Largest difference between relief and a target height along each line; samples without either are skipped.

    ``target`` is a Column over the sample's x, y and the line's columns.
    """
    pts = profile_points(lines, step).withColumn("_target", target).select(key, "source_id", "i", "x", "y", "_target")
    z = sample(pts, cells, grid, [key, "i"])
    return z.groupBy(key).agg(F.coalesce(F.max(F.abs(F.col("z") - F.col("_target"))), F.lit(0.0)).alias("max_deviation_m"))
