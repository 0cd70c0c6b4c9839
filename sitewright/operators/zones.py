"""Legal zones: versions, bbox and attribute search, point lookups, owners, envelope of permitted building."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom, slabs
from sitewright.operators.chunks import sequenced
from sitewright.operators.spatial import BOX, box_pairs, first_cover, points_by_cells


def versions(zones: DataFrame, number: str = "registry_number", seq: str = "load_seq", chunk_size: int = 1_000_000) -> DataFrame:
    """Slowly changing rows: per registry number versions 1, 2, ... in load order; a row is superseded
    by the next one. Rows without a number never version."""
    numbered = sequenced(
        zones.where(F.col(number).isNotNull()), [number], [seq], F.floor(F.col(seq) / float(chunk_size)),
        number="version", following={"superseded_by": seq},
    )
    alone = zones.where(F.col(number).isNull()).withColumns(
        {"version": F.lit(1).cast("bigint"), "superseded_by": F.lit(None).cast(zones.schema[seq].dataType)}
    )
    return numbered.unionByName(alone)


def current(zones: DataFrame) -> DataFrame:
    return zones.where(F.col("superseded_by").isNull())


def latest(zones: DataFrame, number: str = "registry_number", seq: str = "load_seq") -> DataFrame:
    """The rows that ``current(versions(...))`` keeps, without numbering: one aggregate that combines before the shuffle."""
    best = zones.where(F.col(number).isNotNull()).groupBy(number).agg(F.max_by(F.struct(*[c for c in zones.columns if c != number]), F.col(seq)).alias("_z"))
    return zones.where(F.col(number).isNull()).unionByName(best.select(number, "_z.*"))


def history(versioned: DataFrame, number: str = "registry_number", seq: str = "load_seq",
            watch: str = "zone_type", chunk_size: int = 1_000_000) -> DataFrame:
    """All versions newest first with a flag where the watched column changed against the version before."""
    h = sequenced(
        versioned.where(F.col(number).isNotNull()), [number], [seq], F.floor(F.col(seq) / float(chunk_size)),
        preceding={"previous": watch},
    )
    return h.withColumn("changed", F.col("previous").isNotNull() & (F.col("previous") != F.col(watch)))


def meets_box(minx, miny, maxx, maxy, box: tuple[str, str, str, str] = BOX) -> Column:
    """Closed box overlap; on stored bbox columns this reaches the Parquet scan."""
    a, b, c, d = (F.col(n) for n in box)
    return (a <= maxx) & (c >= minx) & (b <= maxy) & (d >= miny)


def find_in_box(zones: DataFrame, minx: float, miny: float, maxx: float, maxy: float, include_superseded: bool = False,
                ring: str | None = None) -> DataFrame:
    out = zones.where(meets_box(F.lit(minx), F.lit(miny), F.lit(maxx), F.lit(maxy)))
    if ring is not None:
        out = out.where(geom.areas_intersect(F.col(ring), geom.rect_ring(minx, miny, maxx, maxy)))
    return out if include_superseded else current(out)


def coverage_in_box(coverage: DataFrame, minx, miny, maxx, maxy) -> DataFrame:
    """Terrain sources over a box, highest priority first."""
    hit = coverage.where(meets_box(F.lit(minx), F.lit(miny), F.lit(maxx), F.lit(maxy)))
    return hit.orderBy(F.col("priority").desc(), F.col("id"))


def search(zones: DataFrame, zone_type: str | None = None, status: str | None = None, number_contains: str | None = None) -> DataFrame:
    """Optional conjuncts; ``%`` and ``_`` in the needle act as wildcards."""
    out = current(zones)
    if zone_type is not None:
        out = out.where(F.col("zone_type") == zone_type)
    if status is not None:
        out = out.where(F.col("status") == status)
    if number_contains is not None:
        out = out.where(F.col("registry_number").ilike(f"%{number_contains}%"))
    return out


def needing_calculation(requests: DataFrame, zones: DataFrame, cell: float = 500.0) -> DataFrame:
    """(site, zone_type) requests with no current official zone of that type meeting the site's box.

    requests: site_id, zone_type, sminx, sminy, smaxx, smaxy.
    """
    official = current(zones).where(F.col("status") == rules.OFFICIAL_ZONE).groupBy("zone_type", *BOX).agg(F.lit(1).alias("_one"))
    hit = box_pairs(
        official, requests, cell=cell, left_id=[*BOX], by=["zone_type"], lbox=BOX, rbox=("sminx", "sminy", "smaxx", "smaxy"),
    ).groupBy("site_id", "zone_type").agg(F.lit(True).alias("_hit"))
    out = requests.join(hit, ["site_id", "zone_type"], "left")
    return out.withColumn("needs_calculation", F.col("_hit").isNull()).drop("_hit")


def containing_zone(points: DataFrame, areas: DataFrame, *, point_id: str, area_id: str, carry: list[str],
                    by: list[str] | None = None, cell: float = 250.0, ring: str = "ring") -> DataFrame:
    """One area per point (interior test); of several the lowest id. Points outside keep nulls.

    The match is a small aggregate per point, joined back once.
    """
    by = by or []
    lowest = F.struct(F.col(area_id), *[F.col(c) for c in carry if c != area_id])
    best = first_cover(points, areas, geom.contains, cell=cell, point_id=[point_id], by=by, order=lowest, ring=ring)
    return points.join(best.select(point_id, "_best.*"), point_id, "left")


def network_owner(points: DataFrame, directory: DataFrame, *, point_id: str, cell: float = 250.0) -> DataFrame:
    """Owner cascade: operator tag, then the provider directory by type and service area, else unclear."""
    found = containing_zone(
        points, directory, point_id=point_id, area_id="rso_id", carry=["organization_name", "application_channel"],
        by=["network_type"], cell=cell,
    )
    operator = F.nullif(F.col("operator"), F.lit(""))
    from_dir = operator.isNull() & F.col("rso_id").isNotNull()
    return found.select(
        point_id, "network_type", F.coalesce(operator, F.col("organization_name")).alias("owner_name"),
        F.when(operator.isNotNull(), rules.OPERATOR_SOURCE).when(from_dir, rules.DIRECTORY_SOURCE)
        .otherwise(rules.NEEDS_CLARIFICATION).alias("source"),
        F.when(from_dir, F.col("application_channel")).alias("application_channel"),
    )


def near_points(points: DataFrame, zones: DataFrame, *, point_id: str, max_distance_m: float = 500.0, cell: float = 125.0,
                ring: str = "ring") -> DataFrame:
    """Zones within a distance of each point; inside counts as 0."""
    pairs, _ = points_by_cells(points, _told_by_box(zones, ring), cell=cell, point_id=point_id, reach=max_distance_m)
    return _within(pairs, max_distance_m).select(*points.columns, *zones.columns, "distance_m")


def _told_by_box(zones: DataFrame, ring: str) -> DataFrame:
    """Adds _rect, and _ring where the outline is no rectangle: the box tells the distance to the others."""
    z = geom.fenced(zones, _rect=geom.is_rect(F.col(ring)))
    return z.withColumn("_ring", F.when(~F.col("_rect"), F.col(ring)))


def _within(pairs: DataFrame, max_distance_m: float) -> DataFrame:
    """Adds distance_m and keeps the pairs up to the limit. Distances to boxes come first: they are compiled with the join, array functions are not."""
    x, y, a, b, c, d = (F.col(v) for v in ("x", "y", *BOX))
    out = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0.0))
    pairs = geom.fenced(pairs, _dx=out(x, a, c), _dy=out(y, b, d))
    pairs = geom.fenced(pairs, _d=F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))).where(F.col("_d") <= max_distance_m + 1e-6)
    far = F.when(F.col("_rect"), F.col("_d")).otherwise(geom.dist_to_area(x, y, F.col("_ring")))
    return pairs.withColumn("distance_m", far).where(F.col("distance_m") <= max_distance_m).drop("_dx", "_dy", "_d", "_rect", "_ring")


def ranked_near_points(points: DataFrame, zones: DataFrame, *, point_id: str, zone_id: str, carry: Sequence[str] = (), max_distance_m: float = 500.0,
                       cell: float = 125.0, ring: str = "ring") -> DataFrame:
    """``rank_by_distance`` of ``near_points``: point_id, zone_id, carry ..., distance_m, pos, rank.

    All zones near a point meet it in one group of a cell (``points_by_cells``), so pairs, of which there are far more than rows, are ranked where
    they are made and are not shuffled. Points of an id that occurs several times may lie apart; only these are ranked by shuffled pairs.
    """
    p = points.select(point_id, "x", "y")
    z = zones.select(zone_id, *carry, ring, *BOX)
    again = p.groupBy(F.col(point_id).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_id")
    repeated = F.col(point_id).eqNullSafe(F.col("_id"))
    out = [point_id, zone_id, *carry, "distance_m", "pos", "rank"]
    pairs, group = points_by_cells(p.join(again, repeated, "left_anti"), _told_by_box(z, ring), cell=cell, point_id=point_id, reach=max_distance_m)
    near = _within(pairs, max_distance_m).select(point_id, zone_id, *carry, "distance_m", *group)
    whole = Window.partitionBy(point_id, *group)
    near = near.withColumns({
        "pos": F.row_number().over(whole.orderBy("distance_m", zone_id)).cast("bigint"), "rank": F.rank().over(whole.orderBy("distance_m")).cast("bigint"),
    })
    rest = near_points(p.join(again, repeated, "left_semi"), z, point_id=point_id, max_distance_m=max_distance_m, ring=ring)
    rest = rank_by_distance(rest.select(point_id, zone_id, *carry, "distance_m"), point_id=point_id, zone_id=zone_id)
    return near.select(*out).unionByName(rest.select(*out))


def rank_by_distance(near: DataFrame, *, point_id: str, zone_id: str, band_m: float = 25.0) -> DataFrame:
    """Position per point by distance then id, and competition rank by distance alone.

    Distance bands are the chunks, so a point with very many zones is ranked in pieces.
    """
    return sequenced(
        near, [point_id], ["distance_m", zone_id], F.floor(F.col("distance_m") / band_m), number="pos", rank=("rank", ["distance_m"])
    )


def envelope(sites: DataFrame, regulations: DataFrame, obstacles: DataFrame, *, site_id: str, cell: float = 250.0) -> DataFrame:
    """Permitted footprint area (outline minus setback minus zones) and the lowest height limit.

    The area is exact for outlines of any form and direction, rounded inner corners included; a site is one row whatever its size, with the
    distinct rings that meet it. A site without a regulation has no footprint. sites: id, ring, zone_code; regulations: zone_code, setback_m,
    max_height_m; obstacles: zone_id, ring, bbox, label, limit_m (nullable).
    """
    s = geom.with_bbox(sites.join(regulations, "zone_code", "left"), "ring", "s")
    o = obstacles.select("zone_id", F.col("ring").alias("zring"), "label", "limit_m", *BOX)
    # zones at one spot with one limit collapse before the join
    o = o.groupBy("zring", *BOX, "limit_m").agg(F.min(F.struct("zone_id", "label")).alias("_o"))
    pairs = box_pairs(s, o, cell=cell, left_id=[site_id], lbox=("sminx", "sminy", "smaxx", "smaxy"), rbox=BOX)
    hits = pairs.where(geom.areas_meet_in_boxes(F.col("ring"), F.col("zring")))
    limited = F.when(F.col("limit_m").isNotNull(), F.struct(F.col("limit_m"), F.col("_o.zone_id").alias("zid"), F.col("_o.label").alias("label")))
    # a rectangle over the whole site leaves nothing free: such a site needs no rings and no kernel
    whole = geom.is_rect(F.col("zring")) & (F.col("minx") <= F.col("sminx")) & (F.col("maxx") >= F.col("smaxx")) & (F.col("miny") <= F.col("sminy")) & (F.col("maxy") >= F.col("smaxy"))
    met = hits.groupBy(site_id).agg(F.min(limited).alias("_z"), F.collect_set(F.when(~whole, F.col("zring"))).alias("_rings"), F.bool_or(whole).alias("_gone"))
    out = s.select(site_id, "zone_code", "ring", "setback_m", "max_height_m").join(met, site_id, "left")
    left = F.when(~F.coalesce("_gone", F.lit(False)), F.col("ring"))
    rule_first = F.col("_z.limit_m").isNull() | (F.col("max_height_m") <= F.col("_z.limit_m"))
    limit = F.least("max_height_m", F.col("_z.limit_m"))
    return out.select(
        site_id, "zone_code", "setback_m", F.coalesce(slabs.free_area_udf(left, "setback_m", "_rings"), F.lit(0.0)).alias("footprint_area_m2"),
        limit.alias("max_height_m"),
        F.when(F.col("max_height_m").isNotNull() & rule_first, F.concat(F.lit("ПЗЗ "), F.col("zone_code")))
        .otherwise(F.col("_z.label")).alias("height_limit_source"),
    )
