"""Radius selection, clipping to the site circle, shift to the site origin."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import crs, geom, slabs
from sitewright.operators.spatial import BOX, box_pairs, points_in_boxes

EARTH_M = 6371008.8
DEG_M = EARTH_M * 3.141592653589793 / 180.0


def _site_boxes(sites: DataFrame, margin_m: float) -> DataFrame:
    """Lon/lat box that surely holds the circle of radius + margin (1 % slack)."""
    dlat = (F.col("radius_m") + margin_m) / DEG_M * 1.01
    dlon = dlat / F.cos(F.radians("center_lat"))
    return sites.withColumns({
        "minx": F.col("center_lon") - dlon, "maxx": F.col("center_lon") + dlon,
        "miny": F.col("center_lat") - dlat, "maxy": F.col("center_lat") + dlat,
    })


def points_in_radius(features: DataFrame, sites: DataFrame, feature_id: str, margin_m: float = rules.SELECTION_MARGIN_M,
                     cell_deg: float = 0.005, by: Sequence[str] = ()) -> DataFrame:
    """Point features (lon, lat) within radius + margin of each site, by great-circle distance.

    ``by`` names columns that must agree, such as the zone a feature is projected in.

    The box test comes first: it is an equi-join on cells as large as the circles, whatever their radius
    (``cell_deg`` is the smallest).
    """
    boxes = _site_boxes(sites, margin_m)
    p = points_in_boxes(features, boxes, cell=cell_deg, point_id=[feature_id], by=by, x="lon", y="lat", small=True)
    d = crs.haversine_m(F.col("center_lon"), F.col("center_lat"), F.col("lon"), F.col("lat"))
    return p.drop(*BOX).withColumn("distance_m", d).where(F.col("distance_m") <= F.col("radius_m") + margin_m)


def local_path(path: Column, lon: Column, lat: Column) -> Column:
    """Lon/lat path in metres about a centre (equirectangular, good to a few millimetres per kilometre)."""
    k = F.cos(F.radians(lat)) * DEG_M
    return F.transform(path, lambda p: geom.point((p.x - lon) * k, (p.y - lat) * DEG_M))


def shapes_in_radius(features: DataFrame, sites: DataFrame, feature_id: str, margin_m: float = rules.SELECTION_MARGIN_M,
                     cell_deg: float = 0.005, path: str = "path") -> DataFrame:
    """Line and area features (lon/lat path) by distance of the geometry itself; ``geometry`` tells the kind."""
    f = geom.with_bbox(features, path, "f")
    boxes = _site_boxes(sites, margin_m)
    p = box_pairs(f, boxes, cell=cell_deg, left_id=[feature_id], lbox=("fminx", "fminy", "fmaxx", "fmaxy"), rbox=BOX, small=True)
    p = p.withColumn("_lp", local_path(F.col(path), F.col("center_lon"), F.col("center_lat")))
    zero = F.lit(0.0)
    d = F.when(F.col("geometry") == "area", geom.dist_to_area(zero, zero, F.col("_lp"))).otherwise(geom.dist_to_path(zero, zero, F.col("_lp")))
    p = p.withColumn("distance_m", d).where(F.col("distance_m") <= F.col("radius_m") + margin_m)
    return p.drop("_lp", *BOX, "fminx", "fminy", "fmaxx", "fmaxy")


def with_site_frame(sites: DataFrame) -> DataFrame:
    """Zone and projected centre per site."""
    s = sites.withColumn("zone", crs.pick_zone(F.col("center_lon")))
    return crs.lonlat_to_msk(s, "center_lon", "center_lat", "zone", ("cx", "cy"))


def clip_points(rows: DataFrame, x: str = "px", y: str = "py") -> DataFrame:
    """Points inside the exact radius, moved so that the site centre is (0, 0). Needs cx, cy, radius_m."""
    dx, dy = F.col(x) - F.col("cx"), F.col(y) - F.col("cy")
    inside = dx * dx + dy * dy <= F.col("radius_m") * F.col("radius_m")
    return rows.where(inside).withColumns({"x": dx, "y": dy})


def clip_lines(rows: DataFrame, path: str = "path") -> DataFrame:
    """One row per segment piece inside the circle, in local coordinates, with its order on the line."""
    s = rows.withColumn("_s", F.explode(F.transform(geom.segments(F.col(path)), lambda s, i: F.struct(i.alias("seq"), s.alias("s")))))
    g = F.col("_s.s")
    piece = geom.clip_segment_to_circle(g.x0, g.y0, g.x1, g.y1, F.col("cx"), F.col("cy"), F.col("radius_m"))
    s = s.withColumn("_c", piece).where(F.col("_c").isNotNull())
    return s.withColumns({
        "seq": F.col("_s.seq"), "x0": F.col("_c.x0") - F.col("cx"), "y0": F.col("_c.y0") - F.col("cy"),
        "x1": F.col("_c.x1") - F.col("cx"), "y1": F.col("_c.y1") - F.col("cy"),
    }).drop("_s", "_c", path)


def clip_areas(rows: DataFrame, ring: str = "ring") -> DataFrame:
    """Rings clipped to a 64-corner circle, one row per part that is left; rings wholly inside skip the kernel."""
    far = F.aggregate(ring, F.lit(0.0), lambda acc, p: F.greatest(acc, geom.length_between(p.x, p.y, F.col("cx"), F.col("cy"))))
    inner = far <= F.col("radius_m") * 0.9987  # inradius of the 64-gon
    whole = rows.where(inner)
    cut = rows.where(~inner).withColumn(ring, F.explode(slabs.circle_parts_udf(F.col(ring), F.col("cx"), F.col("cy"), F.col("radius_m"))))
    return whole.unionByName(cut).withColumn(ring, geom.translate(F.col(ring), -F.col("cx"), -F.col("cy")))


def circle_box(sites: DataFrame) -> DataFrame:
    """Lon/lat box of each site's radius: four projected corners taken back. Needs zone, cx, cy, radius_m."""
    r = F.col("radius_m")
    corner = lambda sx, sy: geom.point(F.col("cx") + sx * r, F.col("cy") + sy * r)
    c = sites.select("site_id", "zone", F.explode(F.array(corner(-1, -1), corner(-1, 1), corner(1, -1), corner(1, 1))).alias("p"))
    c = crs.msk_to_lonlat(c.select("site_id", "zone", F.col("p.x").alias("x"), F.col("p.y").alias("y")))
    return c.groupBy("site_id").agg(
        F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat")
    )


def circle_ring(sites: DataFrame, corners: int = 64) -> DataFrame:
    """Lon/lat vertices of the site circle as a polygon."""
    s = sites.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(corners - 1))))
    a = F.col("k") * (2.0 * math.pi / corners)
    s = s.withColumns({"x": F.col("cx") + F.col("radius_m") * F.cos(a), "y": F.col("cy") + F.col("radius_m") * F.sin(a)})
    return crs.msk_to_lonlat(s).select("site_id", "k", "lon", "lat")


def parcels_near(parcels: DataFrame, points: DataFrame, half_deg: float = 0.01) -> DataFrame:
    """Every numbered parcel in a fixed box around each point; a page of them is the caller's business."""
    p = parcels.where(F.col("number").isNotNull())
    b = points.withColumns({
        "minx": F.col("center_lon") - half_deg, "maxx": F.col("center_lon") + half_deg,
        "miny": F.col("center_lat") - half_deg, "maxy": F.col("center_lat") + half_deg,
    })
    hit = points_in_boxes(p, b, cell=2 * half_deg, point_id=["id"], x="lon", y="lat", small=True)
    near = (F.abs(F.col("lon") - F.col("center_lon")) <= half_deg) & (F.abs(F.col("lat") - F.col("center_lat")) <= half_deg)
    return hit.where(near).drop(*BOX)


def control_errors(points: DataFrame, x: str, y: str, target_x: str, target_y: str) -> DataFrame:
    """Planimetric differences of projected points against their targets."""
    dx, dy = F.col(x) - F.col(target_x), F.col(y) - F.col(target_y)
    return points.withColumns({"dx": dx, "dy": dy, "error_m": F.sqrt(dx * dx + dy * dy)})
