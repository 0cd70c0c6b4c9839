"""Checks of a planned building: placement, envelope, zones, networks, access road, sight lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom, kernels
from sitewright.operators.lines import profile_points
from sitewright.operators.spatial import BOX, box_pairs, first_cover, first_met, nearest_path, points_in_boxes, segments_near_boxes, spread
from sitewright.sources.tables import write_and_read

LBOX = ("lminx", "lminy", "lmaxx", "lmaxy")


def area_pairs(left: DataFrame, right: DataFrame, left_id: str, lring: str, rring: str, cell: float = 100.0,
               reach: float = 0.0) -> DataFrame:
    """Left and right areas whose boxes come within ``reach``."""
    l, r = geom.with_bbox(left, lring, "l"), geom.with_bbox(right, rring)
    return box_pairs(l, r, cell=cell, left_id=[left_id], lbox=LBOX, rbox=BOX, reach=reach).drop(*LBOX, *BOX)


def with_common_area(rows: DataFrame, p: str, q: str, name: str) -> DataFrame:
    """Adds the common area of two rings. Pairs of axis-aligned rectangles stay in Columns: the kernel gets nulls for them."""
    out = rows.withColumn("_rects", geom.is_rect(F.col(p)) & geom.is_rect(F.col(q)))
    other = lambda ring: F.when(~F.col("_rects"), F.col(ring))
    area = kernels.overlap_area_udf(other(p), other(q))
    return out.withColumn(name, F.when(F.col("_rects"), geom.rect_overlap_area(F.col(p), F.col(q))).otherwise(area)).drop("_rects")


def zone_overlaps(buildings: DataFrame, zones: DataFrame, building_id: str, ring: str = "ring", zring: str = "zring") -> DataFrame:
    """Buildings meeting zones with the common area; touching counts with area 0.

    Pairs of axis-aligned rectangles are settled by their boxes, so only pairs with another outline carry rings to the kernel.
    """
    l = geom.with_bbox(buildings, ring, "l").withColumn("_lr", geom.is_rect(F.col(ring)))
    r = geom.with_bbox(zones, zring).withColumn("_rr", geom.is_rect(F.col(zring)))
    flags = ["_lr", "_rr", *LBOX, *BOX]
    common = lambda v: F.greatest(F.least("lmax" + v, "max" + v) - F.greatest("lmin" + v, "min" + v), F.lit(0.0))
    plain = box_pairs(l.where("_lr"), r.where("_rr"), cell=250.0, left_id=[building_id], lbox=LBOX, rbox=BOX)
    plain = plain.withColumn("overlap_m2", common("x") * common("y")).drop(*flags)
    # 0: any building with an outline that is no rectangle, 1: other buildings than rectangles with rectangles
    l = l.withColumn("_k", F.explode(F.when(F.col("_lr"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    other = box_pairs(l, r.withColumn("_k", F.col("_rr").cast("int")), cell=250.0, left_id=[building_id], by=["_k"], lbox=LBOX, rbox=BOX).drop("_k", *flags)
    other = other.where(geom.areas_meet_in_boxes(F.col(ring), F.col(zring)))
    return plain.unionByName(other.withColumn("overlap_m2", kernels.overlap_area_udf(ring, zring)))


def network_clearances(buildings: DataFrame, segments: DataFrame, building_id: str, *, min_m: float = rules.NETWORK_CLEARANCE_M,
                       ring: str = "ring", path: str = "path") -> DataFrame:
    """Networks closer than the minimum (strictly).

    Rectangles and paths of one segment, which most are, meet in the cells along the segment and are told by their numbers; pairs with
    another outline or path carry both to the general test.
    """
    b = geom.with_bbox(buildings, ring, "l").withColumn("_lr", geom.is_rect(F.col(ring)))
    first, second = F.get(F.col(path), F.lit(0)), F.get(F.col(path), F.lit(1))
    ends = {"_x0": first.x, "_y0": first.y, "_x1": second.x, "_y1": second.y}
    n = segments.withColumn("_rr", F.coalesce(F.size(path) == 2, F.lit(False)))
    columns = [*buildings.columns, *segments.columns, "distance_m"]
    plain = segments_near_boxes(
        geom.fenced(n.where("_rr"), **ends), b.where("_lr"), cell=32.0, seg_id=[c for c in segments.columns if c != path], reach=min_m, xy=list(ends), box=LBOX,
    )
    for step in geom.segment_box_dist2(geom.Ends(*[F.col(c) for c in ends]), *[F.col(c) for c in LBOX]):
        plain = geom.fenced(plain, **step)
    plain = plain.withColumn("distance_m", F.sqrt("_d2")).where(F.col("distance_m") < min_m).select(*columns)
    # 0: any building with an outline that is no rectangle, 1: other paths with rectangles
    n = n.withColumn("_k", F.explode(F.when(F.col("_rr"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    n = geom.with_bbox(n, path)
    # the outline lies within half its box diagonal of the box centre: one cheap distance drops most pairs
    b = b.withColumn("_k", F.col("_lr").cast("int")).withColumns({
        "_mx": (F.col("lminx") + F.col("lmaxx")) / 2, "_my": (F.col("lminy") + F.col("lmaxy")) / 2,
        "_half": geom.length_between(F.col("lminx"), F.col("lminy"), F.col("lmaxx"), F.col("lmaxy")) / 2,
    })
    p = box_pairs(b, n, cell=100.0, left_id=[building_id], by=["_k"], lbox=LBOX, rbox=BOX, reach=min_m)
    p = p.where(geom.dist_to_path(F.col("_mx"), F.col("_my"), F.col(path)) < F.col("_half") + min_m)
    other = geom.fenced(p, distance_m=geom.path_area_dist(F.col(path), F.col(ring))).where(F.col("distance_m") < min_m)
    return plain.unionByName(other.select(*columns))


def envelope_violations(buildings: DataFrame, building_id: str, ring: str = "ring", envelope: str = "envelope") -> DataFrame:
    """Buildings not wholly inside their envelope with the area outside. Of two rectangles their boxes tell."""
    p, q = geom.bbox(F.col(ring)), geom.bbox(F.col(envelope))
    in_box = (p["minx"] >= q["minx"]) & (p["miny"] >= q["miny"]) & (p["maxx"] <= q["maxx"]) & (p["maxy"] <= q["maxy"])
    rects = geom.is_rect(F.col(ring)) & geom.is_rect(F.col(envelope))
    outside = spread(buildings).where(~F.when(rects, in_box).otherwise(geom.ring_within(F.col(ring), F.col(envelope))))
    outside = with_common_area(outside, ring, envelope, "_common")
    return outside.withColumn("outside_m2", geom.area(F.col(ring)) - F.col("_common")).drop("_common")


def placement(buildings: DataFrame, ring: str = "local_ring", boundary: str = "boundary") -> DataFrame:
    """Rotate, move and test against the site boundary: inside flag and overlap ratio (0 for an empty area).

    buildings: origin_x, origin_y, rotation_deg.
    """
    placed = geom.rotate_translate(F.col(ring), F.col("rotation_deg"), F.col("origin_x"), F.col("origin_y"))
    b = buildings.withColumn("placed", placed)
    b = with_common_area(b, "placed", boundary, "_over")
    a = geom.area(F.col("placed"))
    return b.withColumns({
        "is_within_site": geom.ring_within(F.col("placed"), F.col(boundary)),
        "overlap_ratio": F.when(a > 0, F.col("_over") / a).otherwise(0.0),
    }).drop("_over")


def footprints(vertices: DataFrame, building: str = "building", salts: int = 16) -> DataFrame:
    """Convex footprint per building. Hulls are taken per Arrow batch, per salt, then per building, so a
    building with very many vertices never sits in one group."""
    pts = vertices.select(building, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    schema = f"{building} {dict(pts.dtypes)[building]}, x double, y double"
    small = pts.mapInPandas(kernels.hull_rows(building), schema)
    spot = F.struct("x", "y")
    salted = small.withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.lit(salts)))
    parts = salted.groupBy(building, "_s").agg(F.collect_set(spot).alias("p")).withColumn("p", kernels.hull_udf("p"))
    return parts.groupBy(building).agg(F.flatten(F.collect_list("p")).alias("p")).select(building, kernels.hull_udf("p").alias("ring"))


def match_entrances(buildings: DataFrame, entrances: DataFrame, building_id: str, entrance_id: str,
                    snap_m: float = rules.ENTRANCE_SNAP_M, ring: str = "ring") -> DataFrame:
    """Entrances inside or within the snap distance of a footprint; one may match several buildings."""
    b = geom.with_bbox(buildings, ring)
    p = points_in_boxes(entrances, b, cell=100.0, point_id=[entrance_id], reach=snap_m)
    return p.where(geom.dist_to_area(F.col("x"), F.col("y"), F.col(ring)) <= snap_m).drop(*BOX)


def uncovered_outlines(outlines: DataFrame, parts: DataFrame, outline_id: str, ring: str = "ring") -> DataFrame:
    """Outlines that no building part meets, even by touching; equal parts count once."""
    distinct = parts.groupBy(F.col(ring).alias("pring")).agg(F.lit(1).alias("_1")).select("pring")
    p = area_pairs(outlines.select(outline_id, ring), distinct, outline_id, ring, "pring")
    hit = p.where(geom.areas_meet_in_boxes(F.col(ring), F.col("pring"))).groupBy(outline_id).agg(F.lit(1).alias("_1")).select(outline_id)
    return outlines.join(hit, outline_id, "left_anti")


def clear_site(features: DataFrame, footprints_: DataFrame, feature_id: str, ring: str = "fring") -> DataFrame:
    """Features flagged removed when they meet any footprint, kept otherwise. footprints_: ring."""
    spots = footprints_.groupBy("ring").agg(F.lit(1).alias("_1")).select("ring")
    # a first corner inside a footprint settles most features without pairs; the rest meets every footprint near it
    corner = features.select(feature_id, F.get(F.col(ring), F.lit(0)).x.alias("x"), F.get(F.col(ring), F.lit(0)).y.alias("y"))
    under = first_cover(corner, geom.with_bbox(spots, "ring"), geom.covers, cell=100.0, point_id=[feature_id]).select(feature_id)
    rest = features.select(feature_id, ring).join(under, feature_id, "left_anti")
    p = area_pairs(rest, spots, feature_id, ring, "ring")
    met = p.where(geom.areas_meet_in_boxes(F.col(ring), F.col("ring"))).select(feature_id)
    hit = under.unionByName(met).groupBy(feature_id).agg(F.lit("removed").alias("part"))
    return features.join(hit, feature_id, "left").withColumn("part", F.coalesce("part", F.lit("kept")))


def access_roads(sites: DataFrame, roads: DataFrame, obstacles: DataFrame, site_id: str, road_id: str, *, by: Sequence[str],
                 ring: str = "ring", path: str = "path") -> DataFrame:
    """Straight connection to the nearest road: end points, confirmation flag, obstacle flag.

    Every site has a row; where its group has no road, the road's columns are null and the flags
    false. Equal distances go to the lowest road id. An obstacle counts when the connection runs
    through its inside, not when it only touches. obstacles: oring.
    """
    ids = list(dict.fromkeys([site_id, *by]))
    r = roads.select(*by, road_id, path, "network")
    # where roads lie dense most sites meet many: the least of them is told without all pairs, the other sites look for the nearest
    met = write_and_read(first_met(sites, r, area_id=[site_id], by=by, ring=ring, path=path, order=F.col(road_id), cell=100.0), "met")
    near = nearest_path(
        sites.join(met, ids, "left_anti"), r, query_id=[site_id], by=by, query_path=ring, path=path,
        path_order=F.col(road_id), carry=[path, "network"], distance=lambda q, s: geom.path_area_dist(s, q),
    ).select(site_id, F.col("nearest.dist").alias("distance_m"), F.col("nearest.hit").alias("_hit"))
    # ids may repeat on either side: of the roads with the least id one that meets a site of that id
    best = r.select(*by, F.struct(F.col(road_id).alias("ord")).alias("_first"), F.struct(F.col(road_id).alias("ord"), path, "network").alias("_hit"))
    touch = met.join(sites.select(*ids, F.col(ring).alias("_ring")), ids).join(best.hint("merge"), [*by, "_first"])
    meets = lambda s: geom.path_area_dist(F.array(geom.point(s.x0, s.y0), geom.point(s.x1, s.y1)), F.col("_ring")) <= 0
    touch = touch.where(F.exists(geom.segments(F.col(f"_hit.{path}")), meets)).groupBy(*ids).agg(F.min("_hit").alias("_hit"))
    near = near.unionByName(touch.select(site_id, F.lit(0.0).alias("distance_m"), "_hit")).select(
        site_id, "distance_m", F.col("_hit.ord").alias(road_id), F.col(f"_hit.{path}").alias("_path"), F.col("_hit.network").alias("network"))
    j = near.join(sites.select(site_id, F.col(ring).alias("_ring")), site_id)
    j = j.withColumn("_np", geom.nearest_pair(F.col("_ring"), F.col("_path")))
    j = j.withColumn("_line", F.array(geom.point(F.col("_np.ax"), F.col("_np.ay")), geom.point(F.col("_np.bx"), F.col("_np.by"))))
    spots = obstacles.groupBy("oring").agg(F.lit(1).alias("_1")).select("oring")
    # a connection without length runs through nothing
    lines = j.where((F.col("_np.ax") != F.col("_np.bx")) | (F.col("_np.ay") != F.col("_np.by")))
    p = area_pairs(lines.select(site_id, "_line"), spots, site_id, "_line", "oring")
    hit = p.where(_pieces(F.col("_line"), F.col("oring"))["inside"])
    blocked = hit.groupBy(site_id).agg(F.lit(True).alias("crosses_obstacle"))
    found = j.join(blocked, site_id, "left").select(site_id, road_id, "network", "distance_m", "crosses_obstacle")
    return sites.select(site_id).join(found, site_id, "left").select(
        site_id, road_id, "network", "distance_m", F.coalesce(F.col("network") == rules.NETWORK_BACKBONE, F.lit(False)).alias("needs_confirmation"),
        F.coalesce("crosses_obstacle", F.lit(False)).alias("crosses_obstacle"),
    )


def sight_blocked(ring: Column, x0, y0, x1, y1) -> Column:
    """A segment with pieces both inside and outside the area; the outline may be concave."""
    seg = F.array(geom.point(x0, y0), geom.point(x1, y1))
    return geom.paths_touch(seg, ring) & geom.let(_pieces(seg, ring), lambda p: p["inside"] & p["outside"])


def _pieces(seg: Column, ring: Column) -> Column:
    """Whether some piece between boundary hits lies inside, and some outside: midpoints of sorted hit parameters."""
    s = F.get(geom.segments(seg), F.lit(0))
    dx, dy = s.x1 - s.x0, s.y1 - s.y0
    len2 = dx * dx + dy * dy
    hits = F.transform(geom.segments(ring), lambda e: geom.segment_crossing(s, e))
    ts = F.transform(F.filter(hits, lambda p: p.isNotNull()), lambda p: ((p.x - s.x0) * dx + (p.y - s.y0) * dy) / len2)
    ts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), ts)))
    n = F.size(ts) - 1
    mids = F.zip_with(F.slice(ts, F.lit(1), n), F.slice(ts, F.lit(2), n), lambda p, q: (p + q) / 2.0)
    at = lambda t: (s.x0 + t * dx, s.y0 + t * dy)
    inside = F.exists(mids, lambda t: geom.contains(*at(t), ring))
    outside = F.exists(mids, lambda t: ~geom.covers(*at(t), ring))
    return F.struct(((len2 > 0) & inside).alias("inside"), ((len2 > 0) & outside).alias("outside"))


def _through_box(x0: Column, y0: Column, x1: Column, y1: Column, slack: float = 1e-6) -> Column:
    """``sight_blocked`` of the rectangle that the BOX columns are; null where the line runs along a side or too near to one to tell."""
    minx, miny, maxx, maxy = (F.col(b) for b in BOX)
    dx, dy = x1 - x0, y1 - y0

    def stretch(grow: float) -> tuple[Column, Column]:
        ax, bx = (minx - grow - x0) / dx, (maxx + grow - x0) / dx
        ay, by = (miny - grow - y0) / dy, (maxy + grow - y0) / dy
        return F.greatest(F.least(ax, bx), F.least(ay, by), F.lit(0.0)), F.least(F.greatest(ax, bx), F.greatest(ay, by), F.lit(1.0))

    (i0, i1), (o0, o1) = stretch(-slack), stretch(slack)
    wide = (maxx - minx > 4 * slack) & (maxy - miny > 4 * slack)
    told = F.when(o0 > o1, F.lit(False)).when(wide & (i1 - i0 > slack) & ((o0 > slack) | (o1 < 1 - slack)), F.lit(True))
    return F.when((F.abs(dx) > 1e-3) & (F.abs(dy) > 1e-3), told)


def _common_box(points: DataFrame, obstacles: DataFrame, px: str, py: str, slack: float) -> DataFrame:
    """Per spot inside obstacles (by more than ``slack``) the common box of all of these, a little wider: px, py, _minx to _maxy."""
    spots = points.groupBy(px, py).agg(F.lit(1).alias("_1")).drop("_1")
    around = points_in_boxes(spots, obstacles, cell=100.0, point_id=[px, py], x=px, y=py)
    x, y, ring = F.col(px), F.col(py), F.col("oring")
    deep = (x > F.col("minx") + slack) & (x < F.col("maxx") - slack) & (y > F.col("miny") + slack) & (y < F.col("maxy") - slack)
    around = around.where(deep & (F.col("_rect") | (geom.contains(x, y, ring) & (geom.dist_to_path(x, y, ring) > slack))))
    return around.groupBy(px, py).agg(*[(F.max(b) - slack if b.startswith("min") else F.min(b) + slack).alias("_" + b) for b in BOX])


def view_points(targets: DataFrame, walks: DataFrame, obstacles: DataFrame, target_id: str, walk_id: str, *,
                step_m: float = 10.0, max_m: float = 150.0, slack: float = 1e-6) -> DataFrame:
    """Sidewalk samples within reach of a target whose sight line crosses no obstacle.

    A target inside an obstacle is seen from nowhere beyond that obstacle's box, so only samples in the common box of
    all obstacles around a target are paired with it: the more obstacles lie on a spot, the fewer pairs there are.
    Pairs are told apart by their ids; a blocked one takes all pairs of the same ids with it that were not dropped before.
    targets: id, tx, ty; walks: id, path; obstacles: oring (deduplicated here).
    """
    s = profile_points(walks.select(walk_id, "path"), step_m).select(walk_id, "i", "x", "y")
    o = geom.with_bbox(obstacles.groupBy("oring").agg(F.lit(1).alias("_1")).select("oring"), "oring").withColumn("_rect", geom.is_rect(F.col("oring")))
    tx, ty = F.col("tx"), F.col("ty")
    seen = _common_box(targets, o, "tx", "ty", slack)
    t = targets.join(seen, ["tx", "ty"], "left").withColumns({
        "minx": F.greatest(tx - max_m, "_minx"), "maxx": F.least(tx + max_m, "_maxx"), "miny": F.greatest(ty - max_m, "_miny"), "maxy": F.least(ty + max_m, "_maxy"),
    }).drop(*["_" + b for b in BOX])
    # boxes are at most 2 max_m wide, sight lines max_m long: fixed numbers of levels spare more passes over them
    near = points_in_boxes(s, t, cell=max_m / 32, point_id=[walk_id, "i"], levels=7).drop(*BOX)
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    near = near.where(dx * dx + dy * dy <= max_m * max_m)
    near = near.withColumns({
        "lminx": F.least("x", "tx"), "lmaxx": F.greatest("x", "tx"), "lminy": F.least("y", "ty"), "lmaxy": F.greatest("y", "ty"),
    })
    p = box_pairs(near, o, cell=max_m / 4, left_id=[walk_id, "i"], lbox=LBOX, rbox=BOX, levels=3)
    ends = F.col("x"), F.col("y"), F.col("tx"), F.col("ty")
    p = geom.fenced(p, _told=F.when(F.col("_rect"), _through_box(*ends)))
    hit = p.where(F.coalesce("_told", sight_blocked(F.col("oring"), *ends)))
    hit = hit.groupBy(target_id, walk_id, "i").agg(F.lit(1).alias("_1")).drop("_1")
    return near.drop(*LBOX).join(hit, [target_id, walk_id, "i"], "left_anti")


def label_segments(segments: DataFrame, texts: DataFrame, segment_id: str, snap_m: float = rules.LABEL_SNAP_M) -> DataFrame:
    """Nearest text within the snap distance of each segment's vertex mean; equal distance takes the later text.

    texts: seq, x, y, txt. Texts at one spot collapse to the latest before the join.
    """
    n = F.size("path").cast("double")
    m = segments.select(
        segment_id, (F.aggregate("path", F.lit(0.0), lambda a, p: a + p.x) / n).alias("mx"),
        (F.aggregate("path", F.lit(0.0), lambda a, p: a + p.y) / n).alias("my"),
    )
    t = texts.groupBy("x", "y").agg(F.max(F.struct("seq", "txt")).alias("_t"))
    # a text within a small radius is nearer than any beyond it: wider circles are drawn only where the small ones are empty
    best = None
    for radius in (snap_m / 16.0, snap_m / 4.0, snap_m):
        left = m if best is None else m.join(best.select(segment_id), segment_id, "left_anti")
        boxes = left.withColumns({"minx": F.col("mx"), "maxx": F.col("mx"), "miny": F.col("my"), "maxy": F.col("my")})
        p = points_in_boxes(t, boxes, cell=radius * 1.25, point_id=["x", "y"], reach=radius, levels=1)
        d2 = (F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))
        p = p.withColumn("_d2", d2).where(F.col("_d2") <= radius * radius)
        found = p.groupBy(segment_id).agg(F.min(F.struct("_d2", -F.col("_t.seq"), F.col("_t.txt").alias("txt"))).alias("_b"))
        best = found if best is None else best.unionByName(found)
    return segments.join(best.select(segment_id, F.col("_b.txt").alias("label")), segment_id, "left")

