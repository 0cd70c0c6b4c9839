"""Objects composed from lines and areas: poles, barriers, platforms, waterways, power corridors, shrubs.

Ribbons are an axis with a half width and flat ends, as everywhere here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import attributes, geom
from sitewright.operators.audit import scatter
from sitewright.operators.lines import even_points, line_profile, lines_without_poles, ribbon_area


def calculated_poles(lines: DataFrame, poles: DataFrame, line_id: str, spacing_m: float = rules.CALCULATED_POLE_SPACING_M,
                     snap_m: float = rules.POLE_SNAP_M) -> DataFrame:
    """Evenly spread poles on lines that no real pole is near: line_id, i, x, y. poles: pole_id, x, y."""
    bare = lines_without_poles(lines, poles, line_id, snap_m)
    return even_points(bare, spacing_m).select(line_id, "i", "x", "y")


def all_poles(lines: DataFrame, poles: DataFrame, line_id: str, pole_id: str, **how) -> DataFrame:
    """Real poles as facts and calculated ones as defaults, with the default height where none is known."""
    made = calculated_poles(lines, poles.withColumnRenamed(pole_id, "pole_id"), line_id, **how)
    return poles.select(pole_id, F.lit(None).cast(lines.schema[line_id].dataType).alias(line_id), F.lit(None).cast("bigint").alias("i"), "x", "y", F.lit(rules.FACT).alias("source")).unionByName(
        made.select(F.lit(None).cast(poles.schema[pole_id].dataType).alias(pole_id), line_id, "i", "x", "y", F.lit(rules.DEFAULT).alias("source"))
    )


def barriers(lines: DataFrame, barrier_id: str, kind: str = "kind", path: str = "path") -> DataFrame:
    """Walls and fences: ribbon width, height, ribbon area. kind: 'wall' or 'fence'; other kinds and lines without length drop out."""
    wall = F.col(kind) == "wall"
    b = lines.where(F.col(kind).isin("wall", "fence") & (geom.path_length(F.col(path)) > 0))
    b = b.withColumns({
        "width_m": F.when(wall, rules.WALL_THICKNESS_M).otherwise(rules.FENCE_RAIL_WIDTH_M),
        "height_m": F.when(wall, rules.WALL_HEIGHT_M).otherwise(rules.FENCE_HEIGHT_M),
    })
    return b.select(barrier_id, kind, path, "width_m", "height_m", ribbon_area(F.col(path), F.col("width_m")).alias("area_m2"))


def fence_posts(lines: DataFrame, barrier_id: str, kind: str = "kind") -> DataFrame:
    """Posts of fences at equal spans, both ends included; walls have none."""
    return even_points(lines.where(F.col(kind) == "fence"), rules.FENCE_POST_SPACING_M).select(barrier_id, "i", "x", "y")


def platforms(shapes: DataFrame, platform_id: str, path: str = "path", geometry: str = "geometry") -> DataFrame:
    """Platforms from areas as they are and from lines as ribbons of a fixed width: width_m (null for areas), area_m2, height_m."""
    area = F.col(geometry) == "area"
    p = shapes.withColumn("width_m", F.when(~area, rules.PLATFORM_LINE_WIDTH_M))
    size = F.when(area, geom.area(F.col(path))).otherwise(ribbon_area(F.col(path), F.col("width_m")))
    return p.select(platform_id, path, "width_m", size.alias("area_m2"), F.lit(rules.PLATFORM_HEIGHT_M).alias("height_m")).where("area_m2 > 0")


def waterway_ribbons(lines: DataFrame, cells: DataFrame, grid: DataFrame, line_id: str, step: float, window_m: float,
                     width_m: float = rules.WATERWAY_WIDTH_M) -> tuple[DataFrame, DataFrame]:
    """Corner-cut axes with their ribbon area, and the smoothed level profile along them."""
    axes = lines.withColumn("path", geom.chaikin(F.col("path"), closed=False)).where(geom.path_length(F.col("path")) > 0)
    ribbons = axes.withColumns({"width_m": F.lit(width_m), "area_m2": ribbon_area(F.col("path"), F.lit(width_m))})
    return ribbons, line_profile(axes, cells, grid, line_id, step, window_m)


def power_corridors(lines: DataFrame, line_id: str, voltage_kv: Column, path: str = "path") -> DataFrame:
    """Protection corridor by voltage class; lines without a known voltage have none."""
    p = lines.withColumns({"voltage_kv": voltage_kv, "half_width_m": attributes.power_corridor_m(voltage_kv)})
    p = p.where(F.col("half_width_m").isNotNull() & (geom.path_length(F.col(path)) > 0))
    return p.select(line_id, path, "voltage_kv", "half_width_m", ribbon_area(F.col(path), 2.0 * F.col("half_width_m")).alias("area_m2"))


def shrubs(areas: DataFrame, area_id: str, seed: int = 0, ring: str = "ring", density_per_ha: float = rules.SHRUB_DENSITY_PER_HA) -> DataFrame:
    """Shrubs scattered in scrub areas, lower and denser than trees: area_id, i, x, y, height_m."""
    want = attributes.planting_count(geom.area(F.col(ring)), F.lit(density_per_ha))
    made = scatter(areas.select(area_id, ring, want.alias("_want")), area_id, "_want", seed=seed, ring=ring)
    return made.select(area_id, "i", "x", "y", F.lit(rules.SHRUB_HEIGHT_M).alias("height_m"))
