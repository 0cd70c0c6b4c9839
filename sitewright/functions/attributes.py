"""Derived attributes and norm lookups as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions.numbers import lower_tag, non_empty, positive_float, positive_int, to_float
from sitewright.functions.tags import lookup


def step_lookup(value: Column, table, cap: bool = True) -> Column:
    """First row whose inclusive upper bound holds the value; above the table the last row applies."""
    out = None
    for upper, result in table:
        hit = value <= F.lit(upper)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    last = F.lit(table[-1][1]) if cap else F.lit(None)
    return F.when(value.isNotNull(), out.otherwise(last))


def building_height(height_tag: Column, levels: Column, levels_confidence: Column, building_type: Column,
                    external_m: Column | None = None) -> Column:
    """Waterfall: height tag, levels, external source, type table. struct(height_m, confidence, source)."""
    tagged = positive_float(height_tag)
    by_levels = F.when(
        (levels_confidence == rules.FACT) & (levels > 0),
        levels.cast("double") * rules.LEVEL_HEIGHT_M + rules.ROOF_ALLOWANCE_M,
    )
    external = F.lit(None).cast("double") if external_m is None else F.when(external_m > 0, external_m)
    by_type = lookup(building_type, rules.HEIGHT_BY_TYPE_M, rules.HEIGHT_FALLBACK_M)
    osm = F.coalesce(tagged, by_levels)
    return F.struct(
        F.coalesce(osm, external, by_type).alias("height_m"),
        F.when(F.coalesce(osm, external).isNotNull(), rules.FACT).otherwise(rules.DEFAULT).alias("confidence"),
        F.when(osm.isNotNull(), rules.SOURCE_OSM).when(external.isNotNull(), rules.SOURCE_EXTERNAL)
        .otherwise(rules.SOURCE_BY_TYPE).alias("source"),
    )


def road_width(width_tag: Column, highway_class: Column) -> Column:
    tagged = positive_float(width_tag)
    return F.struct(
        F.coalesce(tagged, lookup(highway_class, rules.ROAD_WIDTH_BY_CLASS_M, rules.ROAD_WIDTH_DEFAULT_M)).alias("width_m"),
        F.when(tagged.isNotNull(), rules.FACT).otherwise(rules.DEFAULT).alias("confidence"),
    )


def road_network(highway_class: Column) -> Column:
    backbone = F.coalesce(highway_class.isin(*rules.BACKBONE_CLASSES), F.lit(False))
    return F.when(backbone, rules.NETWORK_BACKBONE).otherwise(rules.NETWORK_INTERNAL)


def ballast(gauge_tag: Column, tracks_tag: Column) -> Column:
    gauge = positive_float(gauge_tag) / 1000.0
    tracks = positive_int(tracks_tag)
    g, t = F.coalesce(gauge, F.lit(rules.GAUGE_DEFAULT_M)), F.coalesce(tracks, F.lit(1))
    return F.struct(
        (g + 2 * rules.BALLAST_SHOULDER_M + (t - 1) * rules.TRACK_SPACING_M).alias("width_m"),
        t.cast("bigint").alias("tracks"),
        g.alias("gauge_m"),
        F.when(F.coalesce(gauge, tracks.cast("double")).isNotNull(), rules.FACT).otherwise(rules.DEFAULT).alias("confidence"),
    )


def pole_shape(kind: Column, height_tag: Column, material_tag: Column) -> Column:
    """Height, radii and material of a pole or tower."""
    tower = kind == "tower"
    height = positive_float(height_tag)
    given = non_empty(material_tag)
    pole_material = F.lower(F.coalesce(given, F.lit(rules.POLE_MATERIAL_DEFAULT)))
    pole_radius = lookup(
        pole_material, rules.POLE_RADIUS_BY_MATERIAL_M, rules.POLE_RADIUS_BY_MATERIAL_M[rules.POLE_MATERIAL_DEFAULT]
    )
    return F.struct(
        F.coalesce(height, F.when(tower, rules.TOWER_HEIGHT_M).otherwise(rules.POLE_HEIGHT_M)).alias("height_m"),
        F.when(height.isNotNull(), rules.FACT).otherwise(rules.DEFAULT).alias("height_confidence"),
        F.when(tower, rules.TOWER_RADIUS_BASE_M).otherwise(pole_radius).alias("radius_base_m"),
        F.when(tower, rules.TOWER_RADIUS_TOP_M).otherwise(pole_radius).alias("radius_top_m"),
        F.when(tower, F.coalesce(given, F.lit(rules.TOWER_MATERIAL_DEFAULT))).otherwise(pole_material).alias("material"),
    )


def bearing_vector(deg: Column) -> tuple[Column, Column]:
    """Compass bearing (0 north, clockwise) to a unit vector."""
    return F.sin(F.radians(deg)), F.cos(F.radians(deg))


def roof(tags: Column, obb: Column, height_m: Column) -> Column:
    """Roof parameters from ``roof:*`` tags and the oriented box; a roof as high as the building becomes flat.

    ``obb`` is struct(length, width, ax, ay): long side, short side and unit vector of the long side.
    """
    raw = lower_tag(tags["roof:shape"])
    pitched = raw.isin(*rules.ROOF_SHAPES)
    skillion, gabled = raw == "skillion", raw == "gabled"
    tag_h, angle = to_float(tags["roof:height"]), to_float(tags["roof:angle"])
    has_h = F.coalesce(tag_h > 0, F.lit(False))
    slope = F.when((angle > 0) & (angle < 90), angle).otherwise(rules.DEFAULT_ROOF_ANGLE_DEG)
    run = F.when(skillion, obb["width"]).otherwise(obb["width"] / 2.0)
    pitched_h = F.when(has_h, tag_h).otherwise(run * F.tan(F.radians(slope)))
    too_high = pitched & (pitched_h >= height_m)
    keep = pitched & ~too_high
    direction = to_float(tags["roof:direction"])
    dx, dy = bearing_vector(direction)
    long_dot = F.abs(dy * obb["ax"] - dx * obb["ay"])
    short_dot = F.abs(-dy * obb["ay"] - dx * obb["ax"])
    orientation = F.coalesce(non_empty(tags["roof:orientation"]), F.lit("along"))
    along = F.when(gabled & direction.isNotNull(), long_dot >= short_dot).when(
        gabled, F.lower(orientation) != "across"
    ).otherwise(True)
    return F.struct(
        F.when(keep, raw).otherwise("flat").alias("shape"),
        F.when(keep | (~pitched & raw.isin("", "flat")), rules.FACT).otherwise(rules.DEFAULT).alias("shape_confidence"),
        F.when(keep, pitched_h).otherwise(0.0).alias("height_m"),
        F.when(keep & ~has_h & angle.isNull(), rules.DEFAULT).otherwise(rules.FACT).alias("height_confidence"),
        F.when(keep, along).otherwise(True).alias("ridge_along"),
        F.when(keep & skillion, F.coalesce(dx, -obb["ay"])).alias("dir_x"),
        F.when(keep & skillion, F.coalesce(dy, obb["ax"])).alias("dir_y"),
    )


# --- zone widths ------------------------------------------------------------------------------


def cemetery_zone_m(area_ha: Column) -> Column:
    return step_lookup(area_ha, rules.CEMETERY_M_BY_HA)


def water_protection_m(length_km: Column) -> Column:
    return step_lookup(length_km, rules.WATER_PROTECTION_M_BY_KM)


def coastal_strip_m(slope_deg: Column) -> Column:
    return F.when(slope_deg.isNull() | (slope_deg <= 0), 30.0).when(slope_deg < 3, 40.0).otherwise(50.0)


def power_corridor_m(voltage_kv: Column) -> Column:
    return step_lookup(voltage_kv, rules.POWER_CORRIDOR_M_BY_KV)


def network_zone_m(network_type: Column, diameter_mm: Column) -> Column:
    """Null for an unknown type: the caller turns that into a reject."""
    out = F.lit(None).cast("double")
    for kind, table in rules.NETWORK_ZONE_M.items():
        out = F.when(network_type == kind, step_lookup(diameter_mm, table)).otherwise(out)
    return out


def fire_break_m(a: Column, b: Column) -> Column:
    """Symmetric lookup; unknown degrees give null."""
    rank = {d: i for i, d in enumerate(rules.FIRE_DEGREES)}
    ra, rb = lookup(a, rank), lookup(b, rank)
    table = {f"{rank[x]}|{rank[y]}": m for (x, y), m in rules.FIRE_BREAK_M.items()}
    pair = F.concat_ws("|", F.least(ra, rb), F.greatest(ra, rb))
    return F.when(ra.isNotNull() & rb.isNotNull(), lookup(pair, table))


def forest_density(leaf_type: Column) -> Column:
    return lookup(lower_tag(leaf_type), rules.FOREST_DENSITY_PER_HA, rules.FOREST_DENSITY_DEFAULT_PER_HA)


def planting_count(area_m2: Column, density_per_ha: Column) -> Column:
    return F.rint(area_m2 / 10000.0 * density_per_ha).cast("bigint")
