"""Terrain cells: sampling, volumes, smoothing, blending, tiles of terrain."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver.q_tables import FACES, SITE_TILES, site_tiles
from driver.registry import query
from driver.views import CELL_M, V, r6
from sitewright.functions import geom, tilemath
from sitewright.operators import lines, relief, tiles



def one_source():
    return F.lit(0).cast("bigint").alias("source_id")



def sampled(src: str, cols: str, x: str = "x", y: str = "y") -> str:
    """SQL of a bilinear sample: rows of ``src`` with ``cols`` and z."""
    return f"""(SELECT {cols}, CASE WHEN ok THEN (a.z * (1 - fc) + b.z * fc) * (1 - fr) + (e.z * (1 - fc) + f.z * fc) * fr END AS z FROM
 (SELECT *, cf - floor(cf) AS fc, rf - floor(rf) AS fr, CAST(floor(cf) AS INT) AS c0, CAST(floor(rf) AS INT) AS r0, cf >= 0 AND rf >= 0 AND cf <= gw - 1 AND rf <= gh - 1 AS ok
  FROM (SELECT p.*, ({x} + 1500) / 25.0::DOUBLE - 0.5 AS cf, (1500 - ({y})) / 25.0::DOUBLE - 0.5 AS rf, g.w AS gw, g.h AS gh FROM {src} p, v_grid g)) p
 LEFT JOIN v_cells a ON a.r = r0 AND a.c = c0 LEFT JOIN v_cells b ON b.r = r0 AND b.c = least(c0 + 1, gw - 1)
 LEFT JOIN v_cells e ON e.r = least(r0 + 1, gh - 1) AND e.c = c0 LEFT JOIN v_cells f ON f.r = least(r0 + 1, gh - 1) AND f.c = least(c0 + 1, gw - 1))"""


@query("j18_bilinear_sample", f"SELECT osm_id, round(z, 6) AS z FROM {sampled('v_features', 'osm_id')}")
def j18(spark, d):
    v = V(spark, d)
    p = v.features().select(one_source(), "osm_id", "x", "y")
    return relief.sample(p, v.cells(), v.grid(), ["osm_id"]).select("osm_id", r6("z", "z"))


@query("a06_coverage_fraction", "SELECT count(*) AS cells, count(z) AS valid_cells, round(count(z) / count(*), 6) AS coverage FROM v_cells")
def a06(spark, d):
    return relief.coverage_fraction(V(spark, d).cells()).select("cells", "valid_cells", r6("coverage", "coverage"))


RECT = "SELECT osm_id, cx - hx AS minx, cy - hy AS miny, cx + hx AS maxx, cy + hy AS maxy, hx, hy, 110 + osm_id % 20 AS dz FROM v_buildings"


@query("a07_cut_fill", f"""WITH b AS ({RECT}), k AS (SELECT -1500 + (c + 0.5) * 25.0 AS x, 1500 - (r + 0.5) * 25.0 AS y, z FROM v_cells)
SELECT osm_id, coalesce(sum(greatest(z - dz, 0)), 0) * 625.0::DOUBLE AS cut_m3, coalesce(sum(greatest(dz - z, 0)), 0) * 625.0::DOUBLE AS fill_m3 FROM b LEFT JOIN k ON x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy GROUP BY osm_id""")
def a07(spark, d):
    v = V(spark, d)
    b = v.buildings().select(one_source(), "osm_id", "ring", (110 + F.col("osm_id") % 20).cast("double").alias("design_z"))
    return relief.cut_fill(b, v.cells(), v.grid(), "osm_id")


@query("a08_ring_minimum", f"""WITH b AS ({RECT}), p AS (SELECT osm_id, minx AS x, miny AS y FROM b UNION ALL SELECT osm_id, maxx, miny FROM b UNION ALL SELECT osm_id, maxx, maxy FROM b UNION ALL SELECT osm_id, minx, maxy FROM b)
SELECT osm_id, round(coalesce(min(z), 0), 6) AS base_z FROM {sampled('p', 'osm_id')} GROUP BY osm_id""")
def a08(spark, d):
    v = V(spark, d)
    z = relief.ring_minimum(v.buildings().select(one_source(), "osm_id", "ring"), v.cells(), v.grid(), "osm_id")
    return z.select("osm_id", r6("base_z", "base_z"))


@query("a09_design_elevation", f"""WITH p AS (SELECT osm_id % 1000 AS building_id, osm_id, x, y FROM v_features WHERE layer = 'osm_entrances')
SELECT building_id, count(*) AS n_entrances, CASE WHEN count(z) = count(*) THEN round(avg(z), 5) END AS design_z, CASE WHEN count(z) < count(*) THEN 'entrance outside relief coverage' END AS reject_reason FROM {sampled('p', 'building_id, osm_id')} GROUP BY building_id""")
def a09(spark, d):
    v = V(spark, d)
    e = v.features().where("layer = 'osm_entrances'").select(one_source(), (F.col("osm_id") % 1000).alias("building_id"), "osm_id", "x", "y")
    z = relief.design_elevation(e, v.cells(), v.grid(), "building_id", "osm_id")
    return z.select("building_id", "n_entrances", F.round("design_z", 5).alias("design_z"), "reject_reason")


WALL = f"""ap AS (SELECT osm_id, minx - 1 AS minx, miny - 1 AS miny, maxx + 1 AS maxx, maxy + 1 AS maxy, dz, 2 * hx + 2 AS w, 2 * hy + 2 AS h FROM ({RECT})),
ps AS (SELECT *, i / 16.0::DOUBLE * (2 * w + 2 * h) AS d FROM ap, range(0, 16) t(i)),
pp AS (SELECT osm_id, dz, i, CASE WHEN d <= w THEN minx + d WHEN d <= w + h THEN maxx WHEN d <= 2 * w + h THEN maxx - (d - w - h) ELSE minx END AS x,
 CASE WHEN d <= w THEN miny WHEN d <= w + h THEN miny + (d - w) WHEN d <= 2 * w + h THEN maxy ELSE maxy - (d - 2 * w - h) END AS y FROM ps),
wl AS (SELECT osm_id, coalesce(max(abs(dz - z)), 0) AS diff FROM {sampled('pp', 'osm_id, dz, i')} GROUP BY osm_id)"""


def aprons(v: V):
    c = F.col
    ring = geom.rect_ring(c("cx") - c("hx") - 1, c("cy") - c("hy") - 1, c("cx") + c("hx") + 1, c("cy") + c("hy") + 1)
    return v.buildings().select(one_source(), "osm_id", ring.alias("apron_ring"), (110 + c("osm_id") % 20).cast("double").alias("design_z"))


@query("a10_retaining_wall", f"WITH {WALL} SELECT osm_id, round(diff, 6) AS max_diff_m, diff * 1.5 > 5 AS needs_wall FROM wl")
def a10(spark, d):
    v = V(spark, d)
    w = relief.retaining_wall(aprons(v), v.cells(), v.grid(), "osm_id")
    return w.select("osm_id", r6("max_diff_m", "max_diff_m"), "needs_wall")


@query("a15_max_step", """SELECT greatest(coalesce((SELECT max(abs(a.z - b.z)) FROM v_cells a JOIN v_cells b ON b.r = a.r AND b.c = a.c + 1), 0), coalesce((SELECT max(abs(a.z - b.z)) FROM v_cells a JOIN v_cells b ON b.c = a.c AND b.r = a.r + 1), 0)) AS max_step_m""")
def a15(spark, d):
    return relief.max_step(V(spark, d).cells(), chunk=32).select("max_step_m")


def samples_sql(step: float, where: str) -> str:
    return f"""ln AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM v_lines WHERE {where}),
ln2 AS (SELECT *, greatest(1, CAST(floor(len / {step}) AS BIGINT)) AS n FROM ln WHERE len > 0),
sp AS (SELECT osm_id, n, len, i, len * (i / n) AS d, x0 + ((len * (i / n)) / len) * (x1 - x0) AS x, y0 + ((len * (i / n)) / len) * (y1 - y0) AS y FROM ln2, LATERAL (SELECT unnest(range(0, n + 1)) AS i))"""


@query("a16_max_deviation", f"""WITH {samples_sql(10.0, "layer = 'osm_roads'")} SELECT osm_id, round(coalesce(max(abs(z - CASE WHEN osm_id % 7 > 0 THEN 110 + 0.01::DOUBLE * x END)), 0), 6) AS max_deviation_m FROM {sampled('sp', 'osm_id, i, x')} GROUP BY osm_id""")
def a16(spark, d):
    v = V(spark, d)
    l = v.lines().where("layer = 'osm_roads'").select(one_source(), "osm_id", "path")
    target = F.when(F.col("osm_id") % 7 > 0, 110 + 0.01 * F.col("x"))
    return lines.max_deviation(l, v.cells(), v.grid(), "osm_id", target, step=10.0).select("osm_id", r6("max_deviation_m", "max_deviation_m"))


PROFILE = f"""{samples_sql(5.0, "layer = 'osm_roads'")}, zz AS {sampled('sp', 'osm_id, n, len, i, d, x, y')},
zf AS (SELECT osm_id, n, len, i, d, x, y, coalesce(z, avg(z) OVER (PARTITION BY osm_id), 0) AS z FROM zz),
ed AS (SELECT osm_id, max(z) FILTER (i = 0) AS z0, max(z) FILTER (i = 1) AS z1, max(z) FILTER (i = n) AS zn, max(z) FILTER (i = n - 1) AS zm FROM zf GROUP BY osm_id),
pr AS (SELECT c.osm_id, c.n, c.len, c.i, c.d, c.x, c.y, sum(CASE WHEN k < 0 THEN z0 + (z1 - z0) * k WHEN k > c.n THEN zn + (zn - zm) * (k - c.n) ELSE o.z END) / 11 AS zs
 FROM (SELECT zf.*, i + j AS k FROM zf, range(-5, 6) t(j)) c JOIN ed ON ed.osm_id = c.osm_id LEFT JOIN zf o ON o.osm_id = c.osm_id AND o.i = k GROUP BY ALL)"""


def road_profile(v: V):
    l = v.lines().where("layer = 'osm_roads'").select(one_source(), "osm_id", "path")
    return lines.line_profile(l, v.cells(), v.grid(), "osm_id", 5.0, 50.0)


@query("w04_longitudinal_smoothing", f"WITH {PROFILE} SELECT osm_id, i, round(d, 6) AS d, round(zs, 5) AS z_smooth FROM pr")
def w04(spark, d):
    return road_profile(V(spark, d)).select("osm_id", "i", r6("d", "d"), F.round("z_smooth", 5).alias("z_smooth"))


@query("w05_box_smoothing", """SELECT a.r, a.c, round(sum(b.z) / count(b.z), 6) AS z_smooth FROM (SELECT CAST(y.r AS INT) AS r, CAST(x.c AS INT) AS c FROM v_grid, LATERAL (SELECT unnest(range(0, h)) AS r) y, LATERAL (SELECT unnest(range(0, w)) AS c) x) a, v_grid g, range(-2, 3) dr(i), range(-2, 3) dc(j), v_cells b
 WHERE b.r = least(greatest(a.r + i, 0), g.h - 1) AND b.c = least(greatest(a.c + j, 0), g.w - 1) GROUP BY a.r, a.c""")
def w05(spark, d):
    v = V(spark, d)
    return relief.smooth(relief.full_grid(v.cells(), v.grid()), 4, chunk=16).select("r", "c", r6("z_smooth", "z_smooth"))


@query("w06_point_dedup", """WITH p AS (SELECT osm_id AS seq, (osm_id % 40) * 0.003::DOUBLE AS x, (osm_id % 37) * 0.003::DOUBLE AS y, CASE osm_id % 4 WHEN 0 THEN 'terrain' WHEN 1 THEN 'road' WHEN 2 THEN 'water' ELSE 'building' END AS source FROM v_features)
SELECT seq, source FROM (SELECT *, row_number() OVER (PARTITION BY round_even(x / 0.01::DOUBLE, 0), round_even(y / 0.01::DOUBLE, 0) ORDER BY CASE source WHEN 'building' THEN 0 WHEN 'water' THEN 1 WHEN 'road' THEN 2 ELSE 3 END, seq) AS rn FROM p) WHERE rn = 1""")
def w06(spark, d):
    k = F.col("osm_id")
    p = V(spark, d).features().select(
        k.alias("seq"), ((k % 40) * 0.003).alias("x"), ((k % 37) * 0.003).alias("y"), F.lit(0.0).alias("z"),
        V._pick(k % 4, ["terrain", "road", "water"], "building").alias("source"),
    )
    return relief.deduped_points(p).select("seq", "source")


@query("w10_seam_over_background", """WITH p AS (SELECT osm_id, osm_id % 3 AS rank, CAST(osm_id % 60 AS DOUBLE) AS x, CAST((osm_id * 7) % 61 AS DOUBLE) AS y FROM v_features)
SELECT x, y, rank, osm_id FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY rank, osm_id) AS rn FROM p) WHERE rn = 1""")
def w10(spark, d):
    k = F.col("osm_id")
    p = V(spark, d).features().select((k % 3).alias("rank"), k.alias("osm_id"), (k % 60).cast("double").alias("x"), ((k * 7) % 61).cast("double").alias("y"))
    return tiles.first_by_rank(p, []).select("x", "y", "rank", "osm_id")


@query("u02_outside_exclusion", "SELECT osm_id FROM v_features f WHERE NOT EXISTS (SELECT 1 FROM v_zones z WHERE x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy)")
def u02(spark, d):
    v = V(spark, d)
    return relief.outside_areas(v.features().select("osm_id", "x", "y"), v.zones().select("ring", "minx", "miny", "maxx", "maxy"), ["osm_id"]).select("osm_id")


CONTROL = """cp AS (SELECT c_custkey % 600 AS site_id, c_custkey AS ord, CAST((c_custkey * 7919) % 6001 - 3000 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 6007 - 3003 AS DOUBLE) AS y, CAST(c_custkey % 50 AS DOUBLE) AS hs,
 CASE WHEN c_custkey % 17 > 0 THEN c_custkey % 50 + 1.5::DOUBLE + 0.001::DOUBLE * ((c_custkey * 7919) % 6001 - 3000) - 0.002::DOUBLE * ((c_custkey * 104729) % 6007 - 3003) + (c_custkey % 3) * 0.25::DOUBLE END AS ht FROM customer),
cu AS (SELECT *, ht - hs AS d FROM cp WHERE ht IS NOT NULL), og AS (SELECT site_id, arg_min(x, ord) AS ox, arg_min(y, ord) AS oy FROM cu GROUP BY site_id),
mo AS (SELECT site_id, ox, oy, count(*)::DOUBLE AS n, sum(x - ox) AS sx, sum(y - oy) AS sy, sum((x - ox) * (x - ox)) AS sxx, sum((y - oy) * (y - oy)) AS syy, sum((x - ox) * (y - oy)) AS sxy, sum((x - ox) * d) AS sxz, sum((y - oy) * d) AS syz, sum(d) AS sz FROM cu JOIN og USING (site_id) GROUP BY ALL),
de AS (SELECT *, sxx * (syy * n - sy * sy) - sxy * (sxy * n - sy * sx) + sx * (sxy * sy - syy * sx) AS det FROM mo),
fit AS (SELECT site_id, n, ox, oy, CASE WHEN n < 3 THEN sz / n WHEN abs(det) >= 1e-9 THEN (sxx * (syy * sz - syz * sy) - sxy * (sxy * sz - syz * sx) + sxz * (sxy * sy - syy * sx)) / det END AS off,
 CASE WHEN n < 3 THEN 0 WHEN abs(det) >= 1e-9 THEN (sxz * (syy * n - sy * sy) - sxy * (syz * n - sy * sz) + sx * (syz * sy - syy * sz)) / det END AS gx,
 CASE WHEN n < 3 THEN 0 WHEN abs(det) >= 1e-9 THEN (sxx * (syz * n - sy * sz) - sxz * (sxy * n - sy * sx) + sx * (sxy * sz - syz * sx)) / det END AS gy,
 CASE WHEN n >= 3 AND abs(det) < 1e-9 THEN 'control points are collinear' END AS reject_reason FROM de)"""


def control_points(v: V):
    k = F.col("c_custkey")
    x, y = ((k * 7919) % 6001 - 3000).cast("double"), ((k * 104729) % 6007 - 3003).cast("double")
    hs = (k % 50).cast("double")
    return v.table("customer").select(
        (k % 600).alias("site_id"), k.alias("ord"), x.alias("x"), y.alias("y"), hs.alias("h_source"),
        F.when(k % 17 > 0, hs + 1.5 + 0.001 * x - 0.002 * y + (k % 3) * 0.25).alias("h_target"),
    )


@query("a13_height_calibration", f"WITH {CONTROL} SELECT site_id, n::BIGINT AS n_points, round(off, 4) AS offset_m, round(gx, 5)::DOUBLE + 0.0 AS gx, round(gy, 5)::DOUBLE + 0.0 AS gy, reject_reason FROM fit")
def a13(spark, d):
    m = relief.fit_height_offset(control_points(V(spark, d)), ["site_id"], "ord")
    return m.select("site_id", "n_points", F.round("offset", 4).alias("offset_m"), (F.round("gx", 5) + 0.0).alias("gx"), (F.round("gy", 5) + 0.0).alias("gy"), "reject_reason")


@query("c14_height_plane", f"""WITH {CONTROL.replace('c_custkey % 600 AS site_id', '0 AS site_id')} SELECT r, c, round(z + off + gx * (-1500 + (c + 0.5) * 25.0 - ox) + gy * (1500 - (r + 0.5) * 25.0 - oy), 4) AS z FROM v_cells, fit""")
def c14(spark, d):
    v = V(spark, d)
    m = relief.fit_height_offset(control_points(v).withColumn("source_id", one_source()), ["source_id"], "ord")
    return relief.plane_corrected(v.cells(), v.grid(), m).select("r", "c", F.round("z", 4).alias("z"))


MASK = "z IS NOT NULL AND (r // 13 + c // 17) % 2 = 0"
ALPHA = f"""mk AS (SELECT r, c, z, {MASK} AS ok FROM v_cells), dd AS (SELECT a.r, a.c, min(pow(a.r - b.r, 2) + pow(a.c - b.c, 2)) AS d2 FROM mk a, range(-5, 6) x(i), range(-5, 6) y(j), mk b WHERE b.r = a.r + i AND b.c = a.c + j AND a.ok <> b.ok GROUP BY ALL),
al AS (SELECT mk.*, greatest(0, least(1, (CASE WHEN ok THEN 1 ELSE -1 END * coalesce(sqrt(d2) * 25, 200) + 100) / 200.0::DOUBLE)) AS alpha FROM mk LEFT JOIN dd ON dd.r = mk.r AND dd.c = mk.c)"""


def masked(v: V):
    ok = F.col("z").isNotNull() & ((F.floor(F.col("r") / 13) + F.floor(F.col("c") / 17)) % 2 == 0)
    return v.cells().withColumn("ok", ok)


@query("c29_overlay_blend", f"WITH {ALPHA} SELECT r, c, round(alpha, 6) AS alpha, round(alpha * (z + 10) + (1 - alpha) * coalesce(z, 90), 6) AS z FROM al")
def c29(spark, d):
    k = masked(V(spark, d)).withColumns({"over": F.col("z") + 10, "base": F.coalesce("z", F.lit(90.0))})
    return relief.blend(k, "base", "over", "ok", CELL_M, 200.0, out="zz").select("r", "c", r6("alpha", "alpha"), r6("zz", "z"))


def fold_sql(base: str, over: str, out: str) -> str:
    return f"""{out}m AS (SELECT b.r, b.c, b.z AS bz, o.z AS oz, o.z IS NOT NULL AS ok FROM {base} b JOIN {over} o ON o.r = b.r AND o.c = b.c),
{out}d AS (SELECT a.r, a.c, min(pow(a.r - b.r, 2) + pow(a.c - b.c, 2)) AS d2 FROM {out}m a, range(-5, 6) x(i), range(-5, 6) y(j), {out}m b WHERE b.r = a.r + i AND b.c = a.c + j AND a.ok <> b.ok GROUP BY ALL),
{out} AS (SELECT m.r, m.c, CASE WHEN ok AND bz IS NOT NULL THEN al * oz + (1 - al) * bz ELSE coalesce(bz, oz) END AS z FROM (SELECT m.*, greatest(0, least(1, (CASE WHEN ok THEN 1 ELSE -1 END * coalesce(sqrt(d2) * 25, 200) + 100) / 200.0::DOUBLE)) AS al FROM {out}m m LEFT JOIN {out}d d ON d.r = m.r AND d.c = m.c) m)"""


@query("c30_source_merge", f"""WITH s1 AS (SELECT r, c, CASE WHEN c < 90 THEN z END AS z FROM v_cells), s2 AS (SELECT r, c, CASE WHEN c BETWEEN 30 AND 100 AND r > 20 THEN z + 4 END AS z FROM v_cells), s3 AS (SELECT r, c, CASE WHEN r < 50 AND c > 60 THEN z - 3 END AS z FROM v_cells),
{fold_sql('s1', 's2', 't1')}, {fold_sql('t1', 's3', 't2')} SELECT r, c, round(z, 6) AS z FROM t2""")
def c30(spark, d):
    k = V(spark, d).cells()
    r, c, z = F.col("r"), F.col("c"), F.col("z")
    src = lambda cond, dz: k.withColumn("z", F.when(cond, z + dz))
    m = relief.merge_sources([src(c < 90, 0.0), src(c.between(30, 100) & (r > 20), 4.0), src((r < 50) & (c > 60), -3.0)], CELL_M, 200.0)
    return m.select("r", "c", r6("z", "z"))


@query("c31_site_relief_update", f"""WITH {WALL}, pw AS (SELECT ap.*, greatest(diff * 1.5, 1) AS wd FROM ap JOIN wl ON wl.osm_id = ap.osm_id),
ce AS (SELECT r, c, z, -1500 + (c + 0.5) * 25.0 AS x, 1500 - (r + 0.5) * 25.0 AS y FROM v_cells),
nr AS (SELECT p.osm_id, p.dz, p.wd, ce.*, x BETWEEN minx AND maxx AND y BETWEEN miny AND maxy AS ins FROM pw p JOIN ce ON x BETWEEN minx - 2 * wd - 100 AND maxx + 2 * wd + 100 AND y BETWEEN miny - 2 * wd - 100 AND maxy + 2 * wd + 100),
has AS (SELECT DISTINCT osm_id FROM nr WHERE ins), n2 AS (SELECT nr.* FROM nr JOIN has USING (osm_id)),
d2 AS (SELECT a.osm_id, a.r, a.c, min(pow(a.r - b.r, 2) + pow(a.c - b.c, 2)) AS d2 FROM n2 a JOIN n2 b ON b.osm_id = a.osm_id AND a.ins <> b.ins AND (a.ins OR b.ins) GROUP BY ALL),
al AS (SELECT n2.*, greatest(0, least(1, (CASE WHEN ins THEN 1 ELSE -1 END * sqrt(d2) * 25 + wd / 2) / wd)) AS alpha FROM n2 JOIN d2 USING (osm_id, r, c))
SELECT osm_id, r::BIGINT AS r, c::BIGINT AS c, round(alpha, 6) AS alpha, round(alpha * dz + (1 - alpha) * z, 5) AS z FROM al WHERE alpha > 0""")
def c31(spark, d):
    v = V(spark, d)
    a = aprons(v)
    walls = relief.retaining_wall(a, v.cells(), v.grid(), "osm_id")
    f = relief.flatten_pad(v.cells(), v.grid(), a.withColumnRenamed("apron_ring", "pad_ring"), walls, "osm_id", CELL_M)
    return f.where("alpha > 0").select("osm_id", "r", "c", r6("alpha", "alpha"), F.round("z", 5).alias("z"))


@query("g01_tiles_covering_circle", f"WITH {SITE_TILES} SELECT site_id, tx, ty, lod FROM lod")
def g01(spark, d):
    return site_tiles(V(spark, d)).select("site_id", "tx", "ty", "lod")


@query("g05_background_grid", """SELECT site_id, c, r, CAST(c * 50 AS DOUBLE) AS x, CAST(r * 50 AS DOUBLE) AS y, pow(c * 50, 2) + pow(r * 50, 2) <= radius_m * radius_m AS keep FROM v_sites, range(-70, 71) a(c), range(-70, 71) b(r) WHERE abs(c) <= ceil(radius_m / 50) + 2 AND abs(r) <= ceil(radius_m / 50) + 2""")
def g05(spark, d):
    return tiles.background_grid(V(spark, d).sites().select("site_id", "radius_m"), 50.0, pad_cells=2).select("site_id", "c", "r", "x", "y", "keep")


@query("g06_flat_fill", f"""WITH b AS ({RECT}) SELECT osm_id, minx + 2.5::DOUBLE + i * 5 AS x, miny + 2.5::DOUBLE + j * 5 AS y, CAST(dz AS DOUBLE) AS z FROM b, range(0, 9) a(i), range(0, 7) e(j) WHERE minx + 2.5 + i * 5 < maxx AND miny + 2.5 + j * 5 < maxy""")
def g06(spark, d):
    b = V(spark, d).buildings().select("osm_id", "ring", (110 + F.col("osm_id") % 20).cast("double").alias("z"))
    return tiles.flat_fill(b, 5.0).select("osm_id", "x", "y", "z")


def feature_tiles(v: V):
    f = v.features().select(one_source(), tilemath.tile_of(F.col("x")).alias("tx"), tilemath.tile_of(F.col("y")).alias("ty"))
    return f.groupBy("source_id", "tx", "ty").agg(F.lit(1).alias("_1")).drop("_1")


FT = "ft AS (SELECT DISTINCT CAST(floor(x / 250) AS BIGINT) AS tx, CAST(floor(y / 250) AS BIGINT) AS ty FROM v_features)"


@query("g07_tile_boundary", f"""WITH {FT} SELECT tx, ty, CAST(tx * 250 + i * 25 AS DOUBLE) AS x, CAST(ty * 250 + j * 25 AS DOUBLE) AS y FROM ft, range(0, 11) a(i), range(0, 11) b(j) WHERE i IN (0, 10) OR j IN (0, 10)""")
def g07(spark, d):
    return tiles.boundary_points(feature_tiles(V(spark, d)), 25.0).select("tx", "ty", "x", "y")


@query("g10_tile_terrain", f"""WITH {FT}, nd AS (SELECT DISTINCT tx * 10 + i AS c, ty * 10 + j AS r FROM ft, range(-1, 12) a(i), range(-1, 12) b(j)), nx AS (SELECT c, r, CAST(c * 25 AS DOUBLE) AS x, CAST(r * 25 AS DOUBLE) AS y FROM nd),
nz AS {sampled('nx', 'p.c AS c, p.r AS r, x, y')}, sm AS (SELECT a.c, a.r, sum(b.z) / count(b.z) AS z FROM nz a JOIN nz b ON abs(b.c - a.c) <= 1 AND abs(b.r - a.r) <= 1 GROUP BY a.c, a.r)
SELECT tx, ty, p.x, p.y, round(p.z, 6) AS z, CAST(0 AS INT) AS rank FROM ft JOIN nz p ON p.c BETWEEN tx * 10 AND tx * 10 + 10 AND p.r BETWEEN ty * 10 AND ty * 10 + 10 AND (p.c IN (tx * 10, tx * 10 + 10) OR p.r IN (ty * 10, ty * 10 + 10)) WHERE p.z IS NOT NULL
UNION ALL SELECT tx, ty, CAST(s.c * 25 AS DOUBLE), CAST(s.r * 25 AS DOUBLE), round(s.z, 6), 1 FROM ft JOIN sm s ON s.c BETWEEN tx * 10 + 1 AND tx * 10 + 9 AND s.r BETWEEN ty * 10 + 1 AND ty * 10 + 9 WHERE s.z IS NOT NULL""")
def g10(spark, d):
    v = V(spark, d)
    t = tiles.tile_terrain(feature_tiles(v), v.cells(), v.grid(), step=25.0, seam_step=25.0, window_m=75.0)
    return t.select("tx", "ty", "x", "y", r6("z", "z"), "rank")


@query("g11_grid_faces", f"""WITH {FACES} SELECT r, c, CAST(0 AS INT) AS half, z0 AS fz0, z2 AS fz1, z1 AS fz2 FROM q UNION ALL SELECT r, c, 1, z1, z2, z3 FROM q""")
def g11(spark, d):
    return relief.faces(V(spark, d).cells()).select("r", "c", "half", "fz0", "fz1", "fz2")
