"""Tile arithmetic: local 250 m tiles, web-map tiles, LOD rings, terrain-RGB."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright import rules

HALF_EARTH_M = rules.EARTH_CIRCUMFERENCE_M / 2.0


def tile_of(v: Column, size: float = rules.TILE_SIZE_M) -> Column:
    return F.floor(v / size).cast("bigint")


def tile_bounds(tx: Column, ty: Column, size: float = rules.TILE_SIZE_M) -> dict[str, Column]:
    return {
        "minx": tx * size, "miny": ty * size, "maxx": tx * size + size, "maxy": ty * size + size,
    }


def tile_key(zone, tx, ty, layer, data_version, generator_version, size: float = rules.TILE_SIZE_M) -> Column:
    text = f"{size:g}"
    return F.format_string(
        f"msk59-%d/{text}/%d_%d/%s/%s/%s", zone, tx, ty, layer, data_version, generator_version
    )


def lod_ring(distance_m: Column) -> Column:
    """Inner ring owns its border; negative or beyond the last ring gives null."""
    out = F.when(distance_m < 0, None)
    for name, limit in rules.LOD_LIMITS_M:
        out = out.when(distance_m <= limit, name)
    return out


def lod_step(lod: Column) -> Column:
    out = None
    for name, step in rules.LOD_STEP_M.items():
        out = F.when(lod == name, step) if out is None else out.when(lod == name, step)
    return out


def lonlat_to_web_tile(lon: Column, lat: Column, z: Column) -> tuple[Column, Column]:
    n = F.pow(F.lit(2.0), z.cast("double"))
    rad = F.radians(lat)
    x = (lon + 180.0) / 360.0 * n
    y = (1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / math.pi) / 2.0 * n
    return x.cast("bigint"), y.cast("bigint")


def web_tile_bounds(z: Column, x: Column, y: Column) -> dict[str, Column]:
    size = rules.EARTH_CIRCUMFERENCE_M / F.pow(F.lit(2.0), z.cast("double"))
    return {
        "minx": x * size - HALF_EARTH_M, "miny": HALF_EARTH_M - (y + 1) * size,
        "maxx": (x + 1) * size - HALF_EARTH_M, "maxy": HALF_EARTH_M - y * size,
    }


def web_to_lonlat(mx: Column, my: Column) -> tuple[Column, Column]:
    r = HALF_EARTH_M / math.pi
    return F.degrees(mx / r), F.degrees(2.0 * F.atan(F.exp(my / r)) - math.pi / 2.0)


def terrain_rgb(z: Column) -> Column:
    """0.1 m steps above -10 km as one struct of three bytes; out-of-range heights are clipped."""
    top = rules.TERRAIN_RGB_BASE_M + (256**3 - 1) * 0.1
    clipped = F.greatest(F.lit(rules.TERRAIN_RGB_BASE_M), F.least(F.lit(top), z))
    v = F.rint((clipped - rules.TERRAIN_RGB_BASE_M) / rules.TERRAIN_RGB_STEP_M).cast("bigint")
    return F.struct(
        (F.shiftright(v, 16) % 256).cast("int").alias("r"),
        (F.shiftright(v, 8) % 256).cast("int").alias("g"),
        (v % 256).cast("int").alias("b"),
    )


def terrain_height(r: Column, g: Column, b: Column) -> Column:
    code = r.cast("double") * 65536.0 + g.cast("double") * 256.0 + b.cast("double")
    return rules.TERRAIN_RGB_BASE_M + code * rules.TERRAIN_RGB_STEP_M
