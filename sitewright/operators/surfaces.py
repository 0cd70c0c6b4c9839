"""Heights of water bodies and pavements: level of an area, or a smoothed profile along its long axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom, kernels
from sitewright.operators.lines import at_profile, line_profile
from sitewright.operators.relief import ring_minimum, sample


def with_long_axis(areas: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds obb and the axis through the middles of the short sides."""
    a = geom.fenced(areas, obb=kernels.oriented_box_udf(F.col(ring)))
    half = F.col("obb.length") / 2.0
    end = lambda s: geom.point(F.col("obb.cx") + s * half * F.col("obb.ax"), F.col("obb.cy") + s * half * F.col("obb.ay"))
    return a.withColumn("axis", F.array(end(-1.0), end(1.0)))


def elongated(ratio: float):
    """Axis is trustworthy: long enough against the short side."""
    o = F.col("obb")
    return F.coalesce((o["width"] > 0) & (o["length"] >= ratio * o["width"]), F.lit(False))


def axis_heights(areas: DataFrame, points: DataFrame, cells: DataFrame, grid: DataFrame, key: str, point_id: str,
                 step: float, window_m: float) -> DataFrame:
    """Profile height at each point of an area, read at its foot on the area's axis, with the distance to the axis.

    points: key, point_id, x, y. Only keys present in ``areas`` come back.
    """
    axes = areas.select(key, "source_id", F.col("axis").alias("path"))
    profile = line_profile(axes, cells, grid, key, step, window_m)
    p = points.join(axes.select(key, "path"), key)
    x, y = F.col("x"), F.col("y")
    p = p.withColumns({
        "pos": geom.project_along(x, y, F.col("path")), "axis_dist": geom.dist_to_path(x, y, F.col("path")), "line_len": geom.path_length(F.col("path")),
    })
    p = p.withColumn("n", F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("line_len") / step).cast("bigint"))).drop("path")
    return at_profile(p, profile, key, [point_id])


def water_levels(areas: DataFrame, cells: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Level of each water area: flat minimum for compact ones, lowest profile height for long ones.

    Outlines are corner-cut first, as they are drawn. areas: key, source_id, ring.
    """
    a = geom.fenced(areas, ring=geom.chaikin(F.col("ring"), closed=True))
    a = with_long_axis(a)
    long_ones, compact = a.where(elongated(rules.WATER_ELONGATION_RATIO)), a.where(~elongated(rules.WATER_ELONGATION_RATIO))
    flat = ring_minimum(compact.select(key, "source_id", "ring"), cells, grid, key).select(
        key, F.col("base_z").alias("level_z"), F.lit("compact").alias("shape")
    )
    v = long_ones.select(key, F.posexplode("ring").alias("pid", "p")).select(key, "pid", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    v = v.withColumn("vid", F.concat_ws("/", F.col(key).cast("string"), F.col("pid").cast("string")))
    z = axis_heights(long_ones, v, cells, grid, key, "vid", rules.WATER_PROFILE_STEP_M, rules.WATER_PROFILE_WINDOW_M)
    sloped = z.groupBy(key).agg(F.min("profile_z").alias("level_z"), F.lit("elongated").alias("shape"))
    return flat.unionByName(sloped)


def pavement_heights(lanes: DataFrame, points: DataFrame, cells: DataFrame, grid: DataFrame, key: str, point_id: str) -> DataFrame:
    """Pavement and marking height at points of lanes.

    Long lanes follow their axis profile minus the cross slope; short ones lie on the terrain. Both
    are lifted by the pavement thickness, markings a little more. point_id must be unique overall.
    """
    a = with_long_axis(lanes)
    long_ones = a.where(elongated(rules.LANE_ELONGATION_RATIO))
    short = a.where(~elongated(rules.LANE_ELONGATION_RATIO)).select(key, "source_id")
    z = axis_heights(long_ones, points, cells, grid, key, point_id, rules.LANE_PROFILE_STEP_M, rules.LANE_PROFILE_WINDOW_M)
    sloped = z.select(key, point_id, (F.col("profile_z") - rules.LANE_CROSS_SLOPE * F.col("axis_dist") + rules.PAVEMENT_CLEARANCE_M).alias("pavement_z"))
    flat = sample(points.join(short, key), cells, grid, [key, point_id]).select(key, point_id, (F.col("z") + rules.PAVEMENT_CLEARANCE_M).alias("pavement_z"))
    return sloped.unionByName(flat).withColumn("marking_z", F.col("pavement_z") + rules.MARKING_CLEARANCE_M)
