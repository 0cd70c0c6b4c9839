"""Tiles: covering sets, seams, interior grids, content, index rows, web-map pyramid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom, tilemath
from sitewright.operators.relief import sample, smooth
from sitewright.operators.spatial import salted_join

SIZE = rules.TILE_SIZE_M


def _span(a: Column, b: Column) -> Column:
    return F.sequence(a, b)


def covering_circle(sites: DataFrame, size: float = SIZE) -> DataFrame:
    """Tiles whose nearest point is within the radius. sites: site_id, cx, cy, radius_m; radius <= 0 is an error."""
    s = sites.withColumn("_r", F.when(F.col("radius_m") > 0, F.col("radius_m")).otherwise(
        F.raise_error(F.lit("radius must be positive")).cast("double")
    ))
    k = lambda v: tilemath.tile_of(v, size)
    s = s.withColumn("tx", F.explode(_span(k(F.col("cx") - F.col("_r")), k(F.col("cx") + F.col("_r")))))
    s = s.withColumn("ty", F.explode(_span(k(F.col("cy") - F.col("_r")), k(F.col("cy") + F.col("_r")))))
    b = tilemath.tile_bounds(F.col("tx"), F.col("ty"), size)
    dx = F.col("cx") - F.least(F.greatest(F.col("cx"), b["minx"]), b["maxx"])
    dy = F.col("cy") - F.least(F.greatest(F.col("cy"), b["miny"]), b["maxy"])
    return s.where(dx * dx + dy * dy <= F.col("_r") * F.col("_r")).drop("_r")


def with_lod(tiles: DataFrame, size: float = SIZE) -> DataFrame:
    """Ring of a tile by the distance of its centre; tiles whose centre is beyond the last ring drop out."""
    b = tilemath.tile_bounds(F.col("tx"), F.col("ty"), size)
    dx, dy = (b["minx"] + b["maxx"]) / 2.0 - F.col("cx"), (b["miny"] + b["maxy"]) / 2.0 - F.col("cy")
    t = tiles.withColumn("lod", tilemath.lod_ring(F.sqrt(dx * dx + dy * dy)))
    return t.where(F.col("lod").isNotNull())


def lod_counts(tiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Tile count per LOD in one row set, for each ``by`` group where given; zero where a ring is empty."""
    rings = [n for n, _ in rules.LOD_LIMITS_M]
    g = tiles.groupBy(*by).agg(*[F.count_if(F.col("lod") == n).alias(n) for n in rings])
    return g.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, rings)), F.array(*map(F.col, rings)))).alias("lod", "n_tiles"))


def boundary_points(tiles: DataFrame, step: float, size: float = SIZE) -> DataFrame:
    """Points on the four edges at a world-aligned step, corners once; the step must divide the tile."""
    if size % step != 0:
        raise ValueError(f"step {step} does not divide tile size {size}")
    n = int(round(size / step))
    b = tilemath.tile_bounds(F.col("tx"), F.col("ty"), size)
    k = F.sequence(F.lit(0), F.lit(n))
    inner = F.sequence(F.lit(1), F.lit(n - 1)) if n > 1 else F.array().cast("array<int>")
    at = lambda lo, i: lo + i * step
    flat = F.flatten(F.array(
        F.transform(k, lambda i: geom.point(at(b["minx"], i), b["miny"])),
        F.transform(k, lambda i: geom.point(at(b["minx"], i), b["maxy"])),
        F.transform(inner, lambda i: geom.point(b["minx"], at(b["miny"], i))),
        F.transform(inner, lambda i: geom.point(b["maxx"], at(b["miny"], i))),
    ))
    return tiles.withColumn("_p", F.explode(flat)).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y")}).drop("_p")


def tile_terrain(tiles: DataFrame, cells: DataFrame, grid: DataFrame, *, step: float, seam_step: float, window_m: float,
                 size: float = SIZE, tile_key: tuple[str, str] = ("tx", "ty")) -> DataFrame:
    """Points of each tile: exact seam, smoothed interior; the seam wins at equal coordinates.

    Interior points lie on one world grid, so smoothing windows are keyed by world row and column and
    neighbouring tiles share the same true neighbours. Tiles: source_id, tx, ty.
    """
    half = max(int(round(window_m / step)), 1)
    half = (half + (1 - half % 2)) // 2
    per = int(round(size / step))
    base = tiles.select("source_id", *tile_key).distinct()
    # world grid of all tiles plus a halo, each node once
    i = F.sequence(F.col("tx") * per - half, F.col("tx") * per + per + half)
    j = F.sequence(F.col("ty") * per - half, F.col("ty") * per + per + half)
    nodes = base.withColumn("c", F.explode(i)).withColumn("r", F.explode(j)).select("source_id", "c", "r").distinct()
    nodes = nodes.withColumns({"x": F.col("c") * float(step), "y": F.col("r") * float(step)})
    z = sample(nodes.withColumn("sid", F.col("source_id")), cells, grid, ["sid", "c", "r"])
    sm = smooth(z.drop("sid"), 2 * half + 1)
    inside = base.withColumn("c", F.explode(F.sequence(F.col("tx") * per + 1, F.col("tx") * per + per - 1))).withColumn(
        "r", F.explode(F.sequence(F.col("ty") * per + 1, F.col("ty") * per + per - 1))
    )
    inner = inside.join(sm.select("source_id", "c", "r", F.col("z_smooth").alias("z")), ["source_id", "c", "r"]).select(
        "source_id", *tile_key, (F.col("c") * float(step)).alias("x"), (F.col("r") * float(step)).alias("y"), "z", F.lit(1).alias("rank")
    )
    seam = boundary_points(base, seam_step, size).dropDuplicates(["source_id", *tile_key, "x", "y"])
    seam = sample(seam, cells, grid, [*tile_key, "x", "y"]).select("source_id", *tile_key, "x", "y", "z", F.lit(0).alias("rank"))
    return first_by_rank(seam.unionByName(inner).where(F.col("z").isNotNull()), ["source_id", *tile_key])


def first_by_rank(rows: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """One row per rounded coordinate, lowest rank first."""
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys, F.round("x", digits).alias("_kx"), F.round("y", digits).alias("_ky")).agg(
        F.min(F.struct("rank", *[c for c in rest if c != "rank"])).alias("_b")
    )
    return g.select(*keys, "_b.*")


def tile_content(terrain: DataFrame, buildings: DataFrame, tiles: DataFrame) -> DataFrame:
    """Height range and building count per tile over terrain and buildings; empty tiles drop out.

    terrain: tx, ty, z; buildings: tx, ty, base_z, height_m, roof_shape; tiles: tx, ty, lod and any
    group such as a site, in which a tile may have another lod. Far tiles show footprints without
    height, middle ones and flat roofs blocks. What a tile holds is summed once per lod.
    """
    lods = tiles.select("tx", "ty", "lod").distinct()
    b = salted_join(buildings, lods, ["tx", "ty"], ["building_id"])
    form = F.when(F.col("lod") == "LOD0", "footprint").when(
        (F.col("lod") == "LOD1") | (F.col("roof_shape") == "flat"), "block"
    ).otherwise("roof")
    b = b.withColumn("form", form)
    top = F.when(F.col("form") == "footprint", F.col("base_z")).otherwise(F.col("base_z") + F.col("height_m"))
    b = b.select(
        "tx", "ty", "lod", F.col("base_z").alias("lo"), top.alias("hi"),
        *[(F.col("form") == f).cast("int").alias("n_" + f) for f in ("footprint", "block", "roof")],
    )
    t = terrain.where(F.col("z").isNotNull()).select(
        "tx", "ty", F.col("z").alias("lo"), F.col("z").alias("hi"), *[F.lit(0).alias("n_" + f) for f in ("footprint", "block", "roof")]
    )
    t = t.groupBy("tx", "ty").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *[F.max("n_" + f).alias("n_" + f) for f in ("footprint", "block", "roof")]).join(lods, ["tx", "ty"])
    g = t.unionByName(b).groupBy("tx", "ty", "lod").agg(
        F.min("lo").alias("z_min"), F.max("hi").alias("z_max"), *[F.sum("n_" + f).alias("n_" + f) for f in ("footprint", "block", "roof")]
    )
    return tiles.join(g, ["tx", "ty", "lod"])


def index_rows(content: DataFrame, by: Sequence[str] = (), size: float = SIZE) -> DataFrame:
    """Leaf boxes (centre, half axes, at least 0.5 high) with geometric error, plus a root row per ``by`` group.

    Without ``by`` there is one root, and an empty set gives zeros. content: tx, ty, lod, cx, cy, z_min, z_max.
    """
    b = tilemath.tile_bounds(F.col("tx"), F.col("ty"), size)
    leaf = content.select(
        *by, "tx", "ty", "lod", (b["minx"] - F.col("cx")).alias("minx"), (b["miny"] - F.col("cy")).alias("miny"),
        (b["maxx"] - F.col("cx")).alias("maxx"), (b["maxy"] - F.col("cy")).alias("maxy"), "z_min", "z_max",
        tilemath.lod_step(F.col("lod")).alias("geometric_error"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    top = max(rules.LOD_STEP_M.values())
    root = leaf.groupBy(*by).agg(
        *[zero(F.min(n)).alias(n) for n in ("minx", "miny")], *[zero(F.max(n)).alias(n) for n in ("maxx", "maxy")],
        zero(F.min("z_min")).alias("z_min"), zero(F.max("z_max")).alias("z_max"),
        F.when(F.count(F.lit(1)) > 0, top).otherwise(0.0).alias("geometric_error"),
    ).withColumns({"tx": F.lit(None).cast("bigint"), "ty": F.lit(None).cast("bigint"), "lod": F.lit("root")})
    c = F.col
    return leaf.unionByName(root).select(
        *by, "tx", "ty", "lod", "geometric_error", ((c("minx") + c("maxx")) / 2).alias("bx"), ((c("miny") + c("maxy")) / 2).alias("by"),
        ((c("z_min") + c("z_max")) / 2).alias("bz"), ((c("maxx") - c("minx")) / 2).alias("hx"), ((c("maxy") - c("miny")) / 2).alias("hy"),
        F.greatest((c("z_max") - c("z_min")) / 2, F.lit(0.5)).alias("hz"),
    )


def covering_bbox(boxes: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Web-map tiles over a lon/lat box at each zoom, clamped to the map. boxes: box_id, min_lon, min_lat, max_lon, max_lat."""
    b = boxes.withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    top = F.pow(F.lit(2.0), F.col("z").cast("double")).cast("bigint") - 1
    x0, y0 = tilemath.lonlat_to_web_tile(F.col("min_lon"), F.col("max_lat"), F.col("z"))
    x1, y1 = tilemath.lonlat_to_web_tile(F.col("max_lon"), F.col("min_lat"), F.col("z"))
    lo, hi = lambda v: F.greatest(v, F.lit(0).cast("bigint")), lambda v: F.least(v, top)
    b = b.withColumns({"_x0": lo(x0), "_x1": hi(x1), "_y0": lo(y0), "_y1": hi(y1)})
    span = lambda a, c: F.when(F.col(a) <= F.col(c), F.sequence(F.col(a), F.col(c))).otherwise(F.array().cast("array<bigint>"))
    b = b.withColumn("x", F.explode(span("_x0", "_x1"))).withColumn("y", F.explode(span("_y0", "_y1")))
    return b.drop("_x0", "_x1", "_y0", "_y1")


def tile_pixels(tiles: DataFrame, pixels: int) -> DataFrame:
    """Pixel centres of web tiles in lon/lat, row 0 on top."""
    b = tilemath.web_tile_bounds(F.col("z"), F.col("x"), F.col("y"))
    t = tiles.withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1)))).withColumn(
        "px_", F.explode(F.sequence(F.lit(0), F.lit(pixels - 1)))
    )
    step = (b["maxx"] - b["minx"]) / float(pixels)
    lon, lat = tilemath.web_to_lonlat(b["minx"] + (F.col("px_") + 0.5) * step, b["maxy"] - (F.col("py") + 0.5) * step)
    return t.withColumns({"lon": lon, "lat": lat}).withColumnRenamed("px_", "px")


def packed_tiles(pixels: DataFrame) -> DataFrame:
    """One row per tile with its encoded pixels in order; a tile's pixel count is fixed by the format."""
    code = F.struct("py", "px", F.col("rgb.r").alias("r"), F.col("rgb.g").alias("g"), F.col("rgb.b").alias("b"))
    g = pixels.groupBy("z", "x", "y").agg(F.array_sort(F.collect_list(code)).alias("v"))
    return g.select("z", "x", "y", F.transform("v", lambda s: s["r"] * 65536 + s["g"] * 256 + s["b"]).alias("codes"))


def background_grid(sites: DataFrame, step: float, pad_cells: int = 0) -> DataFrame:
    """Regular grid over each site's circle box, widened by a halo for smoothing; ``keep`` marks the circle."""
    n = F.ceil(F.col("radius_m") / step).cast("bigint") + pad_cells
    s = sites.withColumn("c", F.explode(F.sequence(-n, n))).withColumn("r", F.explode(F.sequence(-n, n)))
    x, y = F.col("c") * float(step), F.col("r") * float(step)
    return s.withColumns({"x": x, "y": y, "keep": x * x + y * y <= F.col("radius_m") * F.col("radius_m")})


def flat_fill(areas: DataFrame, step: float, ring: str = "ring") -> DataFrame:
    """Points at cell centres inside each area (boundary excluded), counted from its lower-left corner."""
    a = geom.with_bbox(areas, ring, "_")
    n = lambda lo, hi: F.greatest(F.ceil((F.col(hi) - (F.col(lo) + step / 2.0)) / step).cast("bigint"), F.lit(0).cast("bigint"))
    span = lambda k: F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    a = a.withColumn("i", F.explode(span(n("_minx", "_maxx")))).withColumn("j", F.explode(span(n("_miny", "_maxy"))))
    x, y = F.col("_minx") + step / 2.0 + F.col("i") * step, F.col("_miny") + step / 2.0 + F.col("j") * step
    a = a.withColumns({"x": x, "y": y})
    return a.where(geom.contains(F.col("x"), F.col("y"), F.col(ring))).drop("_minx", "_miny", "_maxx", "_maxy")

