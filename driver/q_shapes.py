"""Lines, areas, buildings, siting checks, projection, tiles and the extension surface."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from driver import msk_sql
from driver.q_joins import CLEAR, CROSS, OVERLAP, POLES, crossed, overlap_inputs, power_inputs
from driver.q_relief import RECT, one_source, road_profile, sampled
from driver.q_scalars import WIDTH_SQL, pos_float_sql, pos_int_sql
from driver.q_tables import GEO, HAV, SITE_TILES, geo_features, site_tiles, versioned
from driver.registry import query
from driver.views import LAT0, LON0, DEG_X, DEG_Y, V, lonlat, r6
from sitewright import rules
from sitewright.functions import attributes as at
from sitewright.functions import crs, geom, kernels, numbers, tilemath
from sitewright.functions import tags as tg
from sitewright.operators import audit, builders, exports, lines, objects, relief, selection, siting, surfaces, tiles, zones
from sitewright.plans import site_selection
from sitewright.sources import tables



def off_tie(c: str, name: str):
    """Four decimals; heights in eighths and hundredths often sit exactly on a rounding tie, so both sides shift first."""
    return F.round(F.col(c) + 3.7e-7, 4).alias(name)


# --- envelope, bridges, siting ----------------------------------------------------------------

ENV = """bs AS (SELECT osm_id, cx - hx AS minx, cy - hy AS miny, cx + hx AS maxx, cy + hy AS maxy, osm_id % 3 AS pr FROM v_buildings),
rg AS (SELECT osm_id, minx + sb AS ax, miny + sb AS ay, maxx - sb AS bx, maxy - sb AS b_y, sb, pr, CASE WHEN pr < 2 THEN 12.0 + pr END AS mh, minx, miny, maxx, maxy FROM (SELECT *, 1 + pr AS sb FROM bs)),
zz AS (SELECT id, zone_type, minx, miny, maxx, maxy, CASE WHEN id % 3 = 0 THEN CAST(9 + id % 7 AS DOUBLE) END AS lim FROM v_current)"""


@query("a11_building_envelope", f"""WITH {ENV}, cell AS (SELECT osm_id, minx + i + 0.5 AS x, miny + j + 0.5 AS y, ax, ay, bx, b_y FROM rg, range(0, 40) p(i), range(0, 28) q(j) WHERE minx + i + 0.5 < maxx AND miny + j + 0.5 < maxy),
ar AS (SELECT osm_id, CAST(count(*) AS DOUBLE) AS area FROM cell WHERE x >= ax AND x <= bx AND y >= ay AND y <= b_y AND NOT EXISTS (SELECT 1 FROM zz WHERE cell.x BETWEEN zz.minx AND zz.maxx AND cell.y BETWEEN zz.miny AND zz.maxy) GROUP BY osm_id),
li AS (SELECT rg.osm_id, zz.lim, zz.zone_type, row_number() OVER (PARTITION BY rg.osm_id ORDER BY zz.lim, zz.id) AS rn FROM rg JOIN zz ON rg.minx <= zz.maxx AND rg.maxx >= zz.minx AND rg.miny <= zz.maxy AND rg.maxy >= zz.miny WHERE lim IS NOT NULL)
SELECT rg.osm_id, 'Ж-' || (pr + 1) AS zone_code, coalesce(ar.area, 0) AS footprint_area_m2, CAST(least(mh, li.lim) AS DOUBLE) AS max_height_m,
 CASE WHEN mh IS NOT NULL AND (li.lim IS NULL OR mh <= li.lim) THEN 'ПЗЗ Ж-' || (pr + 1) ELSE li.zone_type END AS height_limit_source FROM rg LEFT JOIN ar ON ar.osm_id = rg.osm_id LEFT JOIN li ON li.osm_id = rg.osm_id AND li.rn = 1""")
def a11(spark, d):
    v = V(spark, d)
    code = lambda p: F.concat(F.lit("Ж-"), (p + 1).cast("string")).alias("zone_code")
    s = v.buildings().select("osm_id", "ring", code(F.col("osm_id") % 3))
    p = F.col("id")
    regs = spark.range(3).select(code(p), (1 + p).cast("double").alias("setback_m"), F.when(p < 2, 12.0 + p).alias("max_height_m"))
    z = zones.latest(v.zones()).select(
        F.col("id").alias("zone_id"), "ring", "minx", "miny", "maxx", "maxy", F.col("zone_type").alias("label"),
        F.when(F.col("id") % 3 == 0, (9 + F.col("id") % 7).cast("double")).alias("limit_m"),
    )
    return zones.envelope(s, regs, z, site_id="osm_id").select("osm_id", "zone_code", r6("footprint_area_m2", "footprint_area_m2"), "max_height_m", "height_limit_source")


@query("a12_bridge_clearance", f"""WITH {CROSS}, en AS (SELECT osm_id, 0 AS e, x0 AS x, y0 AS y FROM br UNION ALL SELECT osm_id, 1, x1, y1 FROM br), ez AS (SELECT osm_id, coalesce(max(z) FILTER (e = 0), 0) AS z0, coalesce(max(z) FILTER (e = 1), 0) AS z1 FROM {sampled('en', 'osm_id, e')} GROUP BY osm_id),
gr AS (SELECT bridge_id, kind, z0 + (z1 - z0) * s - z AS c FROM {sampled('cr', 'bridge_id, kind, s')} g JOIN ez ON ez.osm_id = bridge_id), m AS (SELECT bridge_id, min(c) FILTER (kind = 'road') AS road, min(c) FILTER (kind = 'rail') AS rail FROM gr GROUP BY bridge_id),
l AS (SELECT br.osm_id, least(road, rail) AS c, greatest(coalesce(5 - road, 0), coalesce(6 - rail, 0), 0) AS lift FROM br LEFT JOIN m ON m.bridge_id = br.osm_id)
SELECT osm_id AS bridge_id, round(c + lift, 4) + 0.0 AS clearance_m, round(lift::DOUBLE, 4) AS lift_m, CASE WHEN lift > 0 THEN 'расчётный' ELSE 'официальный' END AS status FROM l""")
def a12(spark, d):
    v = V(spark, d)
    b, axes = crossed(v)
    out = lines.bridge_clearance(b.withColumn("source_id", one_source()), axes.withColumn("source_id", one_source()), v.cells(), v.grid(), "bridge_id", "cross_id")
    return out.select("bridge_id", (F.round("clearance_m", 4) + 0.0).alias("clearance_m"), F.round("lift_m", 4).alias("lift_m"), "status")


@query("a17_convex_footprints", """SELECT osm_id, CAST(4 AS INT) AS corners, 4 * hx * hy AS area_m2, cx - hx AS minx, cy + hy AS maxy FROM v_buildings""")
def a17(spark, d):
    """Corners, edge points and inner points of each building go in; the hull has the four corners."""
    c = F.col
    b = V(spark, d).buildings()
    pts = F.array(*[geom.point(c("cx") + i * c("hx") / 2, c("cy") + j * c("hy") / 2) for i in (-2, -1, 0, 2) for j in (-2, 0, 1, 2)])
    h = siting.footprints(b.select("osm_id", F.explode(pts).alias("p")).select("osm_id", "p.x", "p.y"), "osm_id")
    h = geom.with_bbox(h.withColumn("area_m2", geom.area(c("ring"))), "ring")
    return h.select("osm_id", (F.size("ring") - 1).alias("corners"), r6("area_m2", "area_m2"), "minx", "maxy")


@query("a18_placement_check", """WITH p AS (SELECT osm_id, CASE WHEN osm_id % 2 = 0 THEN hx ELSE hy END AS px, CASE WHEN osm_id % 2 = 0 THEN hy ELSE hx END AS py, CAST(osm_id % 40 AS DOUBLE) AS ox, CAST(osm_id % 23 AS DOUBLE) AS oy FROM v_buildings),
o AS (SELECT *, greatest(0, least(ox + px, 30) - greatest(ox - px, -30)) * greatest(0, least(oy + py, 25) - greatest(oy - py, -25)) AS ov FROM p)
SELECT osm_id, ox - px >= -30 AND ox + px <= 30 AND oy - py >= -25 AND oy + py <= 25 AS is_within_site, round(ov / (4 * px * py) + 3.7e-9, 6) AS overlap_ratio FROM o""")
def a18(spark, d):
    k = F.col("osm_id")
    b = V(spark, d).buildings().select(
        "osm_id", geom.rect_ring(-F.col("hx"), -F.col("hy"), F.col("hx"), F.col("hy")).alias("local_ring"), F.when(k % 2 == 0, 180.0).otherwise(90.0).alias("rotation_deg"),
        (k % 40).cast("double").alias("origin_x"), (k % 23).cast("double").alias("origin_y"), geom.rect_ring(-30, -25, 30, 25).alias("boundary"),
    )
    # a hair of slack keeps exact touching of the boundary inside after rotation
    b = b.withColumn("local_ring", F.transform("local_ring", lambda p: geom.point(p.x * (1 - 1e-12), p.y * (1 - 1e-12))))
    return siting.placement(b).select("osm_id", "is_within_site", F.round(F.col("overlap_ratio") + 3.7e-9, 6).alias("overlap_ratio"))


ENVL = """vi AS (SELECT osm_id, 4 * hx * hy - greatest(0, least(cx + hx, ex1) - greatest(cx - hx, ex0)) * greatest(0, least(cy + hy, ey1) - greatest(cy - hy, ey0)) AS outside
 FROM (SELECT *, cx - hx - 2 + osm_id % 5 AS ex0, cx + hx - 2 + osm_id % 5 AS ex1, cy - hy - 1 AS ey0, cy + hy + 1 AS ey1 FROM v_buildings))"""


def envelopes(v: V):
    c = F.col
    shift = c("osm_id") % 5 - 2
    return v.buildings().select("osm_id", "ring", geom.rect_ring(c("cx") - c("hx") + shift, c("cy") - c("hy") - 1, c("cx") + c("hx") + shift, c("cy") + c("hy") + 1).alias("envelope"))


@query("a19_envelope_violation", f"WITH {ENVL} SELECT osm_id, round(outside, 6) AS outside_m2 FROM vi WHERE outside > 0")
def a19(spark, d):
    return siting.envelope_violations(envelopes(V(spark, d)), "osm_id").select("osm_id", r6("outside_m2", "outside_m2"))


@query("a20_all_checks", f"""WITH {ENVL}, {OVERLAP}, {CLEAR}, al AS (SELECT 'огибающая застройки' AS check_type, osm_id, CAST(NULL AS VARCHAR) AS zone_type, outside AS measure FROM vi WHERE outside > 0
 UNION ALL SELECT 'зона ограничения', osm_id, zone_type, w * h FROM ov UNION ALL SELECT 'сети (горизонтальное расстояние)', osm_id, layer, dist FROM pr WHERE dist < 2)
SELECT check_type, zone_type, CAST(GROUPING(check_type) * 2 + GROUPING(zone_type) AS BIGINT) AS level, count(*) AS n, count(DISTINCT osm_id) AS n_buildings, round(sum(measure), 3) AS total FROM al GROUP BY CUBE (check_type, zone_type)""")
def a20(spark, d):
    v = V(spark, d)
    b, z = overlap_inputs(v)
    l = v.lines().select(F.col("osm_id").alias("line_id"), "layer", "path")
    found = lambda df, zone, measure: df.select(F.col("osm_id").alias("building_id"), zone.alias("zone_type"), F.col(measure).alias("measure"))
    total = exports.check_summary([
        (rules.CHECK_ENVELOPE, found(siting.envelope_violations(envelopes(v), "osm_id"), F.lit(None).cast("string"), "outside_m2")),
        (rules.CHECK_ZONE, found(siting.zone_overlaps(b, z, "osm_id"), F.col("zone_type"), "overlap_m2")),
        (rules.CHECK_NETWORK, found(siting.network_clearances(b, l, "osm_id"), F.col("layer"), "distance_m")),
    ])
    return total.withColumn("total", F.round("total", 3))


@query("a24_planting_counts", """WITH a AS (SELECT id, (maxx - minx) * (maxy - miny) AS m2, CASE id % 4 WHEN 0 THEN 500 WHEN 1 THEN 400 WHEN 2 THEN 350 ELSE 400 END AS dens FROM v_zones)
SELECT id, CAST(round_even(m2 / 10000.0 * dens, 0) AS BIGINT) AS trees, CAST(round_even(m2 / 10000.0 * 1500, 0) AS BIGINT) AS shrubs FROM a""")
def a24(spark, d):
    z = V(spark, d).zones()
    leaf = V._pick(F.col("id") % 4, ["needleleaved", "Mixed", "broadleaved"], None)
    a = geom.area(F.col("ring"))
    return z.select("id", at.planting_count(a, at.forest_density(leaf)).alias("trees"), at.planting_count(a, F.lit(rules.SHRUB_DENSITY_PER_HA)).alias("shrubs"))


@query("a25_tile_content", f"""WITH {SITE_TILES}, t7 AS (SELECT site_id, tx, ty, lod FROM lod), te AS (SELECT CAST(floor((-1500 + (c + 0.5) * 25) / 250) AS BIGINT) AS tx, CAST(floor((1500 - (r + 0.5) * 25) / 250) AS BIGINT) AS ty, z FROM v_cells WHERE z IS NOT NULL),
bu AS (SELECT t.site_id, t.tx, t.ty, 100.0 + osm_id % 9 AS lo, CASE WHEN lod = 'LOD0' THEN 'footprint' WHEN lod = 'LOD1' OR osm_id % 3 = 0 THEN 'block' ELSE 'roof' END AS form, hx FROM v_buildings b JOIN t7 t ON t.tx = floor(cx / 250) AND t.ty = floor(cy / 250)),
al AS (SELECT site_id, t7.tx, t7.ty, z AS lo, z AS hi, 0 AS f, 0 AS k, 0 AS o FROM te JOIN t7 ON t7.tx = te.tx AND t7.ty = te.ty UNION ALL SELECT site_id, tx, ty, lo, lo + CASE WHEN form = 'footprint' THEN 0 ELSE hx END, (form = 'footprint')::INT, (form = 'block')::INT, (form = 'roof')::INT FROM bu)
SELECT t.site_id, t.tx, t.ty, lod, min(lo)::DOUBLE AS z_min, max(hi)::DOUBLE AS z_max, sum(f)::BIGINT AS n_footprint, sum(k)::BIGINT AS n_block, sum(o)::BIGINT AS n_roof FROM t7 t JOIN al ON al.tx = t.tx AND al.ty = t.ty AND al.site_id = t.site_id GROUP BY ALL""")
def a25(spark, d):
    v = V(spark, d)
    k = F.col("osm_id")
    b = v.buildings().select(
        k.alias("building_id"), tilemath.tile_of(F.col("cx")).alias("tx"), tilemath.tile_of(F.col("cy")).alias("ty"), (100.0 + k % 9).alias("base_z"), F.col("hx").alias("height_m"),
        F.when(k % 3 == 0, "flat").otherwise("gabled").alias("roof_shape"),
    )
    t = v.cells().select(tilemath.tile_of(-1500 + (F.col("c") + 0.5) * 25).alias("tx"), tilemath.tile_of(1500 - (F.col("r") + 0.5) * 25).alias("ty"), "z")
    return tiles.tile_content(t, b, site_tiles(v).select("site_id", "tx", "ty", "lod"))


# --- lines ------------------------------------------------------------------------------------


@query("g02_even_points", """WITH l AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM v_lines WHERE layer = 'osm_waterways'), n AS (SELECT *, greatest(1, CAST(ceil(len / 2.5) AS BIGINT)) AS k FROM l WHERE len > 0)
SELECT osm_id, k AS n_spans, i, round(x0 + (least(i * (len / k), len) / len) * (x1 - x0), 6) AS x, round(y0 + (least(i * (len / k), len) / len) * (y1 - y0), 6) AS y FROM n, LATERAL (SELECT unnest(range(0, k + 1)) AS i)""")
def g02(spark, d):
    l = V(spark, d).lines().where("layer = 'osm_waterways'").select("osm_id", "path")
    return lines.even_points(l, rules.FENCE_POST_SPACING_M).select("osm_id", "n_spans", "i", r6("x", "x"), r6("y", "y"))


@query("g03_catenary_masts", """WITH l AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM v_lines WHERE layer = 'osm_railways' AND osm_id % 3 > 0),
p AS (SELECT *, i * 50.0::DOUBLE AS d FROM l, LATERAL (SELECT unnest(range(0, CAST(floor(len / 50) AS BIGINT) + 1)) AS i) WHERE len > 0)
SELECT osm_id, i, round(x0 + d / len * (x1 - x0) - (y1 - y0) / len * 3.1::DOUBLE, 5) AS x, round(y0 + d / len * (y1 - y0) + (x1 - x0) / len * 3.1::DOUBLE, 5) AS y FROM p WHERE d < len""")
def g03(spark, d):
    l = V(spark, d).lines().where("layer = 'osm_railways'")
    l = l.where(tg.is_set(F.when(F.col("osm_id") % 3 > 0, "contact_line"))).select("osm_id", "path")
    return lines.catenary_poles(l).select("osm_id", "i", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


SPANS = f"""{POLES}, sp AS (SELECT line_id, pole_id, x, y, height_m, lead(pole_id) OVER w AS b_id, lead(x) OVER w AS bx, lead(y) OVER w AS b_y, lead(height_m) OVER w AS bh FROM onl WINDOW w AS (PARTITION BY line_id ORDER BY pos, pole_id)),
s2 AS (SELECT *, sqrt((bx - x) * (bx - x) + (b_y - y) * (b_y - y)) AS span, 1 + line_id % 4 AS cables FROM sp WHERE b_id IS NOT NULL),
st AS (SELECT *, (k - (cables - 1) / 2.0::DOUBLE) * 1.5::DOUBLE AS off FROM s2, LATERAL (SELECT unnest(range(0, cables)) AS k) WHERE span > 0)"""


def span_rows(v: V, more=()):
    """``more``: frames of pole_id and one other column that travels with the pole."""
    l, p = power_inputs(v)
    carry = ["x", "y", "height_m"]
    for df in more:
        p = p.join(df, "pole_id", "left")
        carry += [c for c in df.columns if c != "pole_id"]
    on = lines.poles_on_lines(l, p, "line_id", "pole_id").select("line_id", "pole_id", *carry, "pos")
    return lines.spans(on, "line_id", "pole_id", carry=carry).withColumn("cables", 1 + F.col("line_id") % 4)


@query("w03_wire_spans", f"WITH {SPANS} SELECT line_id, pole_id, b_id, k AS strand, round(span, 6) AS span_m, round(span * 0.03::DOUBLE, 6) AS sag_m, off AS offset_m FROM st")
def w03(spark, d):
    s = lines.strands(span_rows(V(spark, d)))
    return s.select("line_id", "pole_id", "b_id", "strand", r6("span_m", "span_m"), F.round(F.col("span_m") * rules.SAG_RATIO, 6).alias("sag_m"), "offset_m")


@query("g08_wire_points", f"""WITH {SPANS}, pz AS (SELECT pole_id, coalesce(z, 0) AS z FROM {sampled('pl', 'pole_id')})
SELECT line_id, pole_id, b_id, k AS strand, CAST(i AS INT) AS i, round(x - (b_y - y) / span * off + i / 8.0::DOUBLE * (bx - x), 4) + 0.0 AS wx, round(y + (bx - x) / span * off + i / 8.0::DOUBLE * (b_y - y), 4) + 0.0 AS wy,
 round(a.z + height_m * 0.9::DOUBLE + i / 8.0::DOUBLE * (b.z + bh * 0.9::DOUBLE - a.z - height_m * 0.9::DOUBLE) - span * 0.03::DOUBLE * 4 * (i / 8.0::DOUBLE) * (1 - i / 8.0::DOUBLE) + 3.7e-7, 4) AS wz
FROM st JOIN pz a USING (pole_id) JOIN pz b ON b.pole_id = st.b_id, range(0, 9) t(i)""")
def g08(spark, d):
    v = V(spark, d)
    _, p = power_inputs(v)
    # ground heights go with the poles, of which there are fewer than spans; spans without an id at either end have no wire
    z = relief.sample(p.where("pole_id IS NOT NULL").select("pole_id", one_source(), "x", "y"), v.cells(), v.grid(), ["pole_id"])
    s = span_rows(v, [z.select("pole_id", F.coalesce("z", F.lit(0.0)).alias("g"))]).where("pole_id IS NOT NULL").withColumnRenamed("b_g", "bg")
    ratio = rules.WIRE_ATTACHMENT_RATIO
    s = s.withColumns({"za": F.col("g") + F.col("height_m") * ratio, "zb": F.col("bg") + F.col("b_height_m") * ratio})
    w = lines.wire_points(lines.strands(s))
    r4 = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return w.select("line_id", "pole_id", "b_id", "strand", F.col("k").alias("i"), r4("wx"), r4("wy"), off_tie("wz", "wz"))


def profile_sql(step: float, half: int, src: str) -> str:
    """CTEs ending in ``pr`` (osm_id, n, len, i, d, x, y, zs) for two-point lines of ``src``."""
    return f"""ln AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM {src}), ln2 AS (SELECT *, greatest(1, CAST(floor(len / {step}) AS BIGINT)) AS n FROM ln WHERE len > 0),
sp AS (SELECT osm_id, n, len, i, len * (i / n) AS d, x0 + ((len * (i / n)) / len) * (x1 - x0) AS x, y0 + ((len * (i / n)) / len) * (y1 - y0) AS y FROM ln2, LATERAL (SELECT unnest(range(0, n + 1)) AS i)),
zz AS {sampled('sp', 'osm_id, n, len, i, d, x, y')}, zf AS (SELECT osm_id, n, len, i, d, x, y, coalesce(z, avg(z) OVER (PARTITION BY osm_id), 0) AS z FROM zz),
ed AS (SELECT osm_id, max(z) FILTER (i = 0) AS z0, max(z) FILTER (i = 1) AS z1, max(z) FILTER (i = n) AS zn, max(z) FILTER (i = n - 1) AS zm FROM zf GROUP BY osm_id),
pr AS (SELECT c.osm_id, c.n, c.len, c.i, c.d, c.x, c.y, sum(CASE WHEN k < 0 THEN z0 + (z1 - z0) * k WHEN k > c.n THEN zn + (zn - zm) * (k - c.n) ELSE o.z END) / {2 * half + 1} AS zs
 FROM (SELECT zf.*, i + j AS k FROM zf, range({-half}, {half + 1}) t(j)) c JOIN ed ON ed.osm_id = c.osm_id LEFT JOIN zf o ON o.osm_id = c.osm_id AND o.i = k GROUP BY ALL)"""


ROADS = "(SELECT * FROM v_lines WHERE layer = 'osm_roads')"


@query("g13_road_edge_points", f"""WITH {profile_sql(5.0, 3, ROADS)} SELECT pr.osm_id, pr.i, CAST(s AS INT) AS side, round(pr.x - s * (y1 - y0) / pr.len * w / 2, 4) + 0.0 AS x, round(pr.y + s * (x1 - x0) / pr.len * w / 2, 4) + 0.0 AS y, round(zs + 3.7e-7, 4) AS z
FROM pr JOIN (SELECT *, CASE WHEN osm_id % 3 > 0 THEN (osm_id % 3) * 3.0 ELSE 6.0 END AS w FROM v_lines) l ON l.osm_id = pr.osm_id, range(-1, 2) t(s)""")
def g13(spark, d):
    v = V(spark, d)
    l = v.lines().where("layer = 'osm_roads'").select(one_source(), "osm_id", "path", F.when(F.col("osm_id") % 3 > 0, (F.col("osm_id") % 3) * rules.LANE_WIDTH_M).otherwise(rules.ROAD_CORRIDOR_DEFAULT_M).alias("width_m"))
    prof = lines.line_profile(l, v.cells(), v.grid(), "osm_id", 5.0, 30.0)
    e = lines.edge_points(prof, l, "osm_id")
    r4 = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return e.select("osm_id", "i", "side", r4("x"), r4("y"), off_tie("z_smooth", "z"))


@query("c18_ribbons", f"""WITH l AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, CAST({WIDTH_SQL} AS DOUBLE) AS w FROM v_lines WHERE layer = 'osm_roads'),
m AS (SELECT l.osm_id, count(f.osm_id) AS n FROM l JOIN v_features f ON (f.x - x0) * (x1 - x0) + (f.y - y0) * (y1 - y0) BETWEEN 0 AND len * len AND abs((f.x - x0) * (y1 - y0) - (f.y - y0) * (x1 - x0)) <= 4 * w * len AND len > 0 GROUP BY l.osm_id)
SELECT l.osm_id, w AS width_m, round(len * w, 6) AS area_m2, coalesce(n, 0)::BIGINT AS n_members FROM l LEFT JOIN m ON m.osm_id = l.osm_id""")
def c18(spark, d):
    """Areas by the road's own width; members in a corridor of four widths to each side."""
    v = V(spark, d)
    l = v.lines().where("layer = 'osm_roads'").withColumn("w", at.road_width(F.lit(None).cast("string"), F.col("highway"))["width_m"])
    ribbons = l.select("osm_id", "path", (F.col("w") * 4.0).alias("half_width"))
    pts = v.features().select(F.col("osm_id").alias("fid"), "x", "y")
    m = lines.ribbon_members(pts, ribbons, "fid").groupBy("osm_id").agg(F.count(F.lit(1)).alias("n"))
    out = l.join(m, "osm_id", "left")
    return out.select("osm_id", F.col("w").alias("width_m"), r6(lines.ribbon_area(F.col("path"), F.col("w")), "area_m2"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_members"))


def cut_sql(src: str, out: str, n: int, closed: bool) -> str:
    """One corner-cutting round over (kind, osm_id, pos, x, y) with n vertices (closed: n distinct ones)."""
    nxt = f"(a.pos + 1) % {n}" if closed else "a.pos + 1"
    shift = 0 if closed else 1
    core = f"""SELECT a.osm_id, a.pos * 2 + {shift} AS pos, 0.75 * a.x + 0.25 * b.x AS x, 0.75 * a.y + 0.25 * b.y AS y FROM {src} a JOIN {src} b ON b.osm_id = a.osm_id AND b.pos = {nxt}
 UNION ALL SELECT a.osm_id, a.pos * 2 + {shift + 1}, 0.25 * a.x + 0.75 * b.x, 0.25 * a.y + 0.75 * b.y FROM {src} a JOIN {src} b ON b.osm_id = a.osm_id AND b.pos = {nxt}"""
    ends = "" if closed else f" UNION ALL SELECT osm_id, 0, x, y FROM {src} WHERE pos = 0 UNION ALL SELECT osm_id, {2 * n - 1}, x, y FROM {src} WHERE pos = {n - 1}"
    return f"{out} AS ({core}{ends})"


RING0 = f"(SELECT osm_id, 0 AS pos, minx AS x, miny AS y FROM ({RECT}) UNION ALL SELECT osm_id, 1, maxx, miny FROM ({RECT}) UNION ALL SELECT osm_id, 2, maxx, maxy FROM ({RECT}) UNION ALL SELECT osm_id, 3, minx, maxy FROM ({RECT}))"


@query("c19_corner_cutting", f"""WITH q0 AS {RING0}, {cut_sql('q0', 'q1', 4, True)}, {cut_sql('q1', 'q2', 8, True)},
o0 AS (SELECT osm_id, 0 AS pos, x0 AS x, y0 AS y FROM v_lines UNION ALL SELECT osm_id, 1, x1, y1 FROM v_lines UNION ALL SELECT osm_id, 2, x1 + 48, y1 - 32 FROM v_lines), {cut_sql('o0', 'o1', 3, False)}, {cut_sql('o1', 'o2', 6, False)}
SELECT 'ring' AS kind, osm_id, CAST(pos AS INT) AS pos, x, y FROM q2 UNION ALL SELECT 'ring', osm_id, 16, x, y FROM q2 WHERE pos = 0 UNION ALL SELECT 'line', osm_id, CAST(pos AS INT), x, y FROM o2""")
def c19(spark, d):
    v = V(spark, d)
    c = F.col
    ring = v.buildings().select(F.lit("ring").alias("kind"), "osm_id", geom.chaikin(c("ring"), closed=True).alias("p"))
    open_path = F.concat(c("path"), F.array(geom.point(c("x1") + 48, c("y1") - 32)))
    line = v.lines().select(F.lit("line").alias("kind"), "osm_id", geom.chaikin(open_path, closed=False).alias("p"))
    return ring.unionByName(line).select("kind", "osm_id", F.posexplode("p").alias("pos", "v")).select("kind", "osm_id", "pos", "v.x", "v.y")


AXIS = """ar AS (SELECT id AS osm_id, minx, miny, maxx, maxy, greatest(maxx - minx, maxy - miny) AS lo, least(maxx - minx, maxy - miny) AS sh FROM v_zones),
axl AS (SELECT osm_id, CASE WHEN maxx - minx >= maxy - miny THEN minx ELSE (minx + maxx) / 2 END AS x0, CASE WHEN maxx - minx >= maxy - miny THEN (miny + maxy) / 2 ELSE miny END AS y0,
 CASE WHEN maxx - minx >= maxy - miny THEN maxx ELSE (minx + maxx) / 2 END AS x1, CASE WHEN maxx - minx >= maxy - miny THEN (miny + maxy) / 2 ELSE maxy END AS y1 FROM ar WHERE lo >= 3 * sh)"""


@query("c20_water_level", f"""WITH {AXIS}, q0 AS (SELECT osm_id, 0 AS pos, minx AS x, miny AS y FROM ar UNION ALL SELECT osm_id, 1, maxx, miny FROM ar UNION ALL SELECT osm_id, 2, maxx, maxy FROM ar UNION ALL SELECT osm_id, 3, minx, maxy FROM ar), {cut_sql('q0', 'q1', 4, True)}, {cut_sql('q1', 'q2', 8, True)},
fl AS (SELECT osm_id, coalesce(min(z), 0) AS level FROM {sampled('q2', 'osm_id, pos')} GROUP BY osm_id), {profile_sql(5.0, 5, 'axl')},
vp AS (SELECT q2.osm_id, q2.pos, greatest(0, least(l.len, ((q2.x - x0) * (x1 - x0) + (q2.y - y0) * (y1 - y0)) / l.len)) / l.len * l.n AS f, l.n FROM q2 JOIN ln2 l ON l.osm_id = q2.osm_id),
lv AS (SELECT v.osm_id, min(a.zs + (b.zs - a.zs) * (f - a.i)) AS level FROM vp v JOIN pr a ON a.osm_id = v.osm_id AND a.i = least(floor(f), v.n - 1) JOIN pr b ON b.osm_id = v.osm_id AND b.i = a.i + 1 GROUP BY v.osm_id)
SELECT osm_id, CASE WHEN lo >= 3 * sh THEN 'elongated' ELSE 'compact' END AS shape, round(CASE WHEN lo >= 3 * sh THEN lv.level ELSE fl.level END + 3.7e-7, 4) AS level_z FROM ar LEFT JOIN fl USING (osm_id) LEFT JOIN lv USING (osm_id)""")
def c20(spark, d):
    v = V(spark, d)
    a = v.zones().select(F.col("id").alias("osm_id"), one_source(), "ring")
    return surfaces.water_levels(a, v.cells(), v.grid(), "osm_id").select("osm_id", "shape", off_tie("level_z", "level_z"))


LANE_AXIS = """lx AS (SELECT osm_id, CASE WHEN hx >= hy THEN cx - hx ELSE cx END AS x0, CASE WHEN hx >= hy THEN cy ELSE cy - hy END AS y0, CASE WHEN hx >= hy THEN cx + hx ELSE cx END AS x1, CASE WHEN hx >= hy THEN cy ELSE cy + hy END AS y1
 FROM v_buildings WHERE greatest(hx, hy) >= 1.5 * least(hx, hy))"""


@query("c21_pavement_height", f"""WITH {LANE_AXIS}, pt AS (SELECT osm_id, cx + hx / 2 AS x, cy + hy / 4 AS y, hx, hy, greatest(hx, hy) >= 1.5 * least(hx, hy) AS long_lane FROM v_buildings), {profile_sql(1.0, 7, 'lx')},
vp AS (SELECT p.osm_id, greatest(0, least(l.len, ((p.x - x0) * (x1 - x0) + (p.y - y0) * (y1 - y0)) / l.len)) / l.len * l.n AS f, l.n, CASE WHEN hx >= hy THEN hy / 4 ELSE hx / 2 END AS off FROM pt p JOIN ln2 l ON l.osm_id = p.osm_id),
lv AS (SELECT v.osm_id, a.zs + (b.zs - a.zs) * (f - a.i) - 0.02::DOUBLE * off + 0.03::DOUBLE AS z FROM vp v JOIN pr a ON a.osm_id = v.osm_id AND a.i = least(floor(f), v.n - 1) JOIN pr b ON b.osm_id = v.osm_id AND b.i = a.i + 1),
fl AS (SELECT osm_id, z + 0.03::DOUBLE AS z FROM {sampled('(SELECT * FROM pt WHERE NOT long_lane)', 'osm_id')}), al AS (SELECT * FROM lv UNION ALL SELECT * FROM fl)
SELECT osm_id, round(z + 3.7e-7, 4) AS pavement_z, round(z + 0.005::DOUBLE + 3.7e-7, 4) AS marking_z FROM al""")
def c21(spark, d):
    v = V(spark, d)
    c = F.col
    b = v.buildings()
    lanes = b.select("osm_id", one_source(), "ring")
    pts = b.select("osm_id", c("osm_id").alias("pid"), (c("cx") + c("hx") / 2).alias("x"), (c("cy") + c("hy") / 4).alias("y"))
    h = surfaces.pavement_heights(lanes, pts, v.cells(), v.grid(), "osm_id", "pid")
    return h.select("osm_id", off_tie("pavement_z", "pavement_z"), off_tie("marking_z", "marking_z"))


@query("c22_profile_lookup", f"""WITH {profile_sql(5.0, 5, ROADS)}, pt AS (SELECT osm_id, k, x0 + (k * 0.57::DOUBLE - 0.2::DOUBLE) * (x1 - x0) - 0.05::DOUBLE * (y1 - y0) AS x, y0 + (k * 0.57::DOUBLE - 0.2::DOUBLE) * (y1 - y0) + 0.05::DOUBLE * (x1 - x0) AS y, x0, y0, x1, y1, len, n FROM ln2, range(0, 3) t(k)),
vp AS (SELECT osm_id, k, n, greatest(0, least(len, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / len)) / len * n AS f FROM pt)
SELECT v.osm_id, CAST(k AS INT) AS k, round(a.zs + (b.zs - a.zs) * (f - a.i) + 3.7e-7, 4) AS z FROM vp v JOIN pr a ON a.osm_id = v.osm_id AND a.i = least(floor(f), v.n - 1) JOIN pr b ON b.osm_id = v.osm_id AND b.i = a.i + 1""")
def c22(spark, d):
    v = V(spark, d)
    prof = road_profile(v)
    l = v.lines().where("layer = 'osm_roads'").withColumn("line_len", geom.path_length(F.col("path"))).where("line_len > 0")
    l = l.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    t = F.col("k") * 0.57 - 0.2
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pos = geom.project_along(F.col("x0") + t * dx - 0.05 * dy, F.col("y0") + t * dy + 0.05 * dx, F.col("path"))
    n = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("line_len") / 5.0).cast("bigint"))
    p = l.select("osm_id", "k", pos.alias("pos"), "line_len", n.alias("n"))
    return lines.at_profile(p, prof, "osm_id", ["k"]).select("osm_id", "k", off_tie("profile_z", "z"))


@query("c32_road_rebuild", f"""WITH e AS (SELECT *, CASE WHEN highway IN ('primary', 'tertiary_link') THEN 'backbone road is not editable' WHEN osm_id % 3 = 0 THEN 'road has no single axis' WHEN osm_id % 5 = 0 THEN 'new axis has no length' END AS reject_reason,
 sqrt(pow(x1 + 10 - x0, 2) + pow(y1 - y0, 2)) AS len, {WIDTH_SQL}::DOUBLE AS w FROM v_lines WHERE layer = 'osm_roads')
SELECT osm_id, reject_reason, CASE WHEN reject_reason IS NULL THEN round(len, 6) END AS new_length_m, CASE WHEN reject_reason IS NULL THEN round(len * w, 6) END AS new_area_m2 FROM e""")
def c32(spark, d):
    l = V(spark, d).lines().where("layer = 'osm_roads'")
    c = F.col
    roads = l.select("osm_id", at.road_network(c("highway")).alias("network"), F.when(c("osm_id") % 3 == 0, 2).otherwise(1).alias("n_parts"), at.road_width(F.lit(None).cast("string"), c("highway"))["width_m"].alias("width_m"))
    moved = F.array(geom.point(c("x0"), c("y0")), geom.point(c("x1") + 10, c("y1")))
    still = F.array(geom.point(c("x0"), c("y0")), geom.point(c("x0"), c("y0")))
    edits = l.select("osm_id", F.when(c("osm_id") % 5 == 0, still).otherwise(moved).alias("new_path"))
    return lines.rebuilt_axes(roads, edits, "osm_id").select("osm_id", "reject_reason", r6("new_length_m", "new_length_m"), r6("new_area_m2", "new_area_m2"))


# --- rings, boxes, clipping -------------------------------------------------------------------


@query("c15_oriented_box", "SELECT osm_id, cx, cy, 2 * greatest(hx, hy) AS length, 2 * least(hx, hy) AS width, CAST(CASE WHEN hx > hy THEN 1 WHEN hx < hy THEN 0 END AS DOUBLE) AS ax FROM v_buildings")
def c15(spark, d):
    b = V(spark, d).buildings().withColumn("o", kernels.oriented_box_udf(F.col("ring")))
    square = F.abs(F.col("o.length") - F.col("o.width")) < 1e-9
    return b.select("osm_id", r6("o.cx", "cx"), r6("o.cy", "cy"), r6("o.length", "length"), r6("o.width", "width"), F.when(~square, F.round(F.abs("o.ax"), 6)).alias("ax"))


@query("c16_ring_repair", """SELECT osm_id, osm_id % 6 > 1 AS kept, CASE WHEN osm_id % 6 > 1 THEN CAST(5 AS INT) END AS n_points, CASE WHEN osm_id % 6 > 1 THEN 4 * hx * hy END AS area_m2, osm_id % 6 = 5 AS crossing FROM v_buildings WHERE osm_id % 6 < 5
UNION ALL SELECT osm_id, TRUE, 4, round(hx * hy, 6), TRUE FROM v_buildings WHERE osm_id % 6 = 5""")
def c16(spark, d):
    """Good, clockwise, stuttering, collapsed, tiny and bow-tie rings; of a bow-tie the larger loop stays."""
    b = V(spark, d).buildings()
    k, c, r = F.col("osm_id") % 6, F.col, F.col("ring")
    flat = F.array(r[0], r[1], r[0])
    tiny = geom.rect_ring(c("cx"), c("cy"), c("cx") + 0.5, c("cy") + 0.5)
    bow = F.array(r[0], r[2], r[1], r[3], r[0])
    stutter = F.flatten(F.transform(r, lambda p: F.array(p, p)))
    ring = F.when(k == 0, flat).when(k == 1, tiny).when(k == 2, F.reverse(r)).when(k == 3, stutter).when(k == 5, bow).otherwise(r)
    b = b.withColumn("in_ring", ring).withColumn("crossing", geom.self_crossing(F.col("in_ring")))
    whole = b.where(~F.col("crossing")).withColumn("fixed", geom.repair_ring(F.col("in_ring")))
    cut = b.where("crossing").withColumn("loop", kernels.untangled_udf(F.col("in_ring"))).withColumn("fixed", geom.repair_ring(F.col("loop"))).drop("loop")
    b = whole.unionByName(cut)
    ok = F.col("fixed").isNotNull()
    return b.select("osm_id", ok.alias("kept"), F.when(ok, F.size("fixed")).alias("n_points"), F.when(ok, r6(geom.signed_area(F.col("fixed")), "a")).alias("area_m2"), "crossing")


CLIP = """cl AS (SELECT s.site_id, l.osm_id, x0 - sx AS ax, y0 - sy AS ay, x1 - x0 AS dx, y1 - y0 AS dy, radius_m FROM v_sites s, v_lines l),
cq AS (SELECT *, dx * dx + dy * dy AS a, 2 * (ax * dx + ay * dy) AS b, ax * ax + ay * ay - radius_m * radius_m AS c FROM cl),
ct AS (SELECT *, greatest(0, (-b - sqrt(b * b - 4 * a * c)) / (2 * a)) AS t0, least(1, (-b + sqrt(b * b - 4 * a * c)) / (2 * a)) AS t1 FROM cq WHERE a > 0 AND b * b - 4 * a * c >= 0)"""


@query("c17_circle_clip", f"""WITH {CLIP} SELECT 'line' AS kind, site_id, osm_id, round(ax + t0 * dx, 4) + 0.0 AS x0, round(ay + t0 * dy, 4) + 0.0 AS y0, round(ax + t1 * dx, 4) + 0.0 AS x1, round(ay + t1 * dy, 4) + 0.0 AS y1 FROM ct WHERE t0 < t1
UNION ALL SELECT 'point', site_id, osm_id, x - sx, y - sy, NULL, NULL FROM v_features, v_sites WHERE (x - sx) * (x - sx) + (y - sy) * (y - sy) <= radius_m * radius_m""")
def c17(spark, d):
    from sitewright.operators.spatial import box_pairs, points_in_boxes

    v = V(spark, d)
    c = F.col
    s = v.sites().select("site_id", c("sx").alias("cx"), c("sy").alias("cy"), "radius_m")
    s = s.withColumns({"minx": c("cx") - c("radius_m"), "maxx": c("cx") + c("radius_m"), "miny": c("cy") - c("radius_m"), "maxy": c("cy") + c("radius_m")})
    p = points_in_boxes(v.features().select("osm_id", "x", "y"), s, cell=1000.0, point_id=["osm_id"])
    p = selection.clip_points(p.withColumnsRenamed({"x": "px", "y": "py"}))
    l = geom.with_bbox(v.lines().select("osm_id", "path"), "path", "l")
    pairs = box_pairs(l, s, cell=500.0, left_id=["osm_id"], lbox=("lminx", "lminy", "lmaxx", "lmaxy"), rbox=("minx", "miny", "maxx", "maxy"), levels=4)
    cut = selection.clip_lines(pairs)
    r4 = lambda n: (F.round(n, 4) + 0.0).alias(n)
    null = F.lit(None).cast("double")
    return cut.select(F.lit("line").alias("kind"), "site_id", "osm_id", r4("x0"), r4("y0"), r4("x1"), r4("y1")).unionByName(
        p.select(F.lit("point").alias("kind"), "site_id", "osm_id", c("x").alias("x0"), c("y").alias("y0"), null.alias("x1"), null.alias("y1"))
    )


@query("c17_area_clip_shares", """WITH p AS (SELECT site_id, osm_id, cx - sx AS x, cy - sy AS y, hx, hy, radius_m AS r FROM v_sites JOIN v_buildings ON abs(cx - sx) <= radius_m + hx AND abs(cy - sy) <= radius_m + hy),
k AS (SELECT *, sqrt((abs(x) + hx) * (abs(x) + hx) + (abs(y) + hy) * (abs(y) + hy)) <= r * cos(pi() / 64) AS whole FROM p),
e AS (SELECT k.*, r * cos(pi() * i / 32) AS ax, r * sin(pi() * i / 32) AS ay, r * cos(pi() * (i + 1) / 32) AS bx, r * sin(pi() * (i + 1) / 32) AS b_y FROM k, range(0, 64) t(i) WHERE NOT whole),
c AS (SELECT k.*, x + u * hx AS vx, y + w * hy AS vy FROM k, (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) q(u, w) WHERE NOT whole),
v AS (SELECT site_id, osm_id, ax AS vx, ay AS vy FROM e WHERE abs(ax - x) <= hx AND abs(ay - y) <= hy
 UNION ALL SELECT site_id, osm_id, vx, vy FROM c WHERE sqrt(vx * vx + vy * vy) * cos(fmod(atan2(vy, vx) + 2 * pi(), pi() / 32) - pi() / 64) <= r * cos(pi() / 64)
 UNION ALL SELECT site_id, osm_id, vx, vy FROM (SELECT *, x + u * hx AS vx, ay + (x + u * hx - ax) / (bx - ax) * (b_y - ay) AS vy FROM e, (VALUES (-1), (1)) q(u) WHERE bx <> ax) WHERE vx BETWEEN least(ax, bx) AND greatest(ax, bx) AND abs(vy - y) <= hy
 UNION ALL SELECT site_id, osm_id, vx, vy FROM (SELECT *, y + u * hy AS vy, ax + (y + u * hy - ay) / (b_y - ay) * (bx - ax) AS vx FROM e, (VALUES (-1), (1)) q(u) WHERE b_y <> ay) WHERE vy BETWEEN least(ay, b_y) AND greatest(ay, b_y) AND abs(vx - x) <= hx),
o AS (SELECT v.*, atan2(vy - avg(vy) OVER g, vx - avg(vx) OVER g) AS a FROM v WINDOW g AS (PARTITION BY site_id, osm_id)),
n AS (SELECT *, coalesce(lead(vx) OVER g, first_value(vx) OVER g) AS nx, coalesce(lead(vy) OVER g, first_value(vy) OVER g) AS ny FROM o WINDOW g AS (PARTITION BY site_id, osm_id ORDER BY a)),
s AS (SELECT site_id, osm_id, abs(sum(vx * ny - nx * vy)) / 2 AS m2 FROM n GROUP BY ALL)
SELECT k.site_id, k.osm_id, round(CASE WHEN whole THEN 1 ELSE m2 / (4 * hx * hy) END, 6) AS share FROM k LEFT JOIN s ON s.site_id = k.site_id AND s.osm_id = k.osm_id WHERE whole OR m2 > 1e-6""")
def c17_area(spark, d):
    """Share of every building inside the circles of all sites."""
    from sitewright.operators.spatial import box_pairs

    v, c = V(spark, d), F.col
    s = v.sites().select("site_id", c("sx").alias("cx"), c("sy").alias("cy"), "radius_m")
    s = s.withColumns({"minx": c("cx") - c("radius_m"), "maxx": c("cx") + c("radius_m"), "miny": c("cy") - c("radius_m"), "maxy": c("cy") + c("radius_m")})
    b = geom.with_bbox(v.buildings().select("osm_id", "ring", geom.area(c("ring")).alias("full_m2")), "ring", "l")
    pairs = box_pairs(b, s, cell=500.0, left_id=["osm_id"], lbox=("lminx", "lminy", "lmaxx", "lmaxy"), rbox=("minx", "miny", "maxx", "maxy"), levels=4)
    parts = selection.clip_areas(pairs).groupBy("site_id", "osm_id").agg((F.sum(geom.area(c("ring"))) / F.max("full_m2")).alias("share"), F.sum(geom.area(c("ring"))).alias("m2"))
    return parts.where("m2 > 1e-6").select("site_id", "osm_id", F.round("share", 6).alias("share"))


# --- projection -------------------------------------------------------------------------------

LL = f"ll AS (SELECT osm_id, lon, lat, {msk_sql.zone_of('lon')} AS zone FROM (SELECT osm_id, 52.0::DOUBLE + (osm_id * 37 % 900) * 0.01::DOUBLE AS lon, 56.0::DOUBLE + (osm_id * 53 % 500) * 0.01::DOUBLE AS lat FROM v_features))"


def spread_lonlat(v: V):
    k = F.col("osm_id")
    f = v.features().select("osm_id", (52.0 + (k * 37 % 900) * 0.01).alias("lon"), (56.0 + (k * 53 % 500) * 0.01).alias("lat"))
    return f.withColumn("zone", crs.pick_zone(F.col("lon")))


@query("c13_projection", f"""WITH {LL}, {msk_sql.forward('ll', 'fw')} SELECT osm_id, zone, round(mx, 3) AS x, round(my, 3) AS y, round(lon, 8) AS back_lon, round(lat, 8) AS back_lat, CASE WHEN zone IS NULL THEN 'outside supported region' END AS reject_reason FROM fw WHERE zone IS NOT NULL
UNION ALL SELECT osm_id, NULL, NULL, NULL, NULL, NULL, 'outside supported region' FROM ll WHERE zone IS NULL""")
def c13(spark, d):
    f = crs.lonlat_to_msk(spread_lonlat(V(spark, d)))
    f = crs.msk_to_lonlat(f, out=("back_lon", "back_lat"))
    return f.select(
        "osm_id", "zone", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("back_lon", 8).alias("back_lon"), F.round("back_lat", 8).alias("back_lat"),
        F.when(F.col("zone").isNull(), "outside supported region").alias("reject_reason"),
    )


@query("a14_control_errors", f"""WITH {LL}, {msk_sql.forward('(SELECT * FROM ll WHERE zone IS NOT NULL)', 'fw')}, e AS (SELECT osm_id, (osm_id % 7) * 0.03::DOUBLE AS dx, (osm_id % 5) * -0.02::DOUBLE AS dy, (osm_id % 4) * 0.02::DOUBLE AS dh FROM fw)
SELECT osm_id, round(dx, 4) AS dx, round(dy, 4) + 0.0 AS dy, round(sqrt(dx * dx + dy * dy), 4) AS error_m, round(dh, 4) AS height_error_m FROM e""")
def a14(spark, d):
    """Targets are the projected points moved by known offsets, which the check has to find again."""
    k = F.col("osm_id")
    f = crs.lonlat_to_msk(spread_lonlat(V(spark, d)).where("zone is not null"))
    f = f.withColumns({"tx": F.col("x") - (k % 7) * 0.03, "ty": F.col("y") + (k % 5) * 0.02, "pred": 100.0 + (k % 4) * 0.02, "target": F.lit(100.0)})
    c = selection.control_errors(f, "x", "y", "tx", "ty")
    return c.select("osm_id", F.round("dx", 4).alias("dx"), (F.round("dy", 4) + 0.0).alias("dy"), F.round("error_m", 4).alias("error_m"), F.round(F.abs(F.col("pred") - F.col("target")), 4).alias("height_error_m"))


SITE_LL = f"sl AS (SELECT site_id, radius_m, lon, lat, {msk_sql.zone_of('lon')} AS zone FROM (SELECT site_id, radius_m, 56.25::DOUBLE + sx * 0.0000169::DOUBLE AS lon, 58.0::DOUBLE + sy * 0.000009::DOUBLE AS lat FROM v_sites))"


@query("g12_circle_box_and_ring", f"""WITH {SITE_LL}, {msk_sql.forward('sl', 'fw')}, pt AS (SELECT site_id, zone, 'box' AS part, CAST(-1 AS INT) AS k, mx + a * radius_m AS px, my + b * radius_m AS py FROM fw, (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)) t(a, b)
 UNION ALL SELECT site_id, zone, 'ring', CAST(k AS INT), mx + radius_m * cos(k * (2 * pi() / 64)), my + radius_m * sin(k * (2 * pi() / 64)) FROM fw, range(0, 64) t(k)), {msk_sql.inverse('pt', 'iv', 'px', 'py')}
SELECT site_id, part, k, round(min(olon), 7) AS lon, round(min(olat), 7) AS lat, round(max(olon), 7) AS lon2, round(max(olat), 7) AS lat2 FROM iv GROUP BY site_id, part, k""")
def g12(spark, d):
    s = selection.with_site_frame(V(spark, d).sites().select("site_id", "center_lon", "center_lat", "radius_m"))
    r7 = lambda c, n: F.round(c, 7).alias(n)
    box = selection.circle_box(s).select("site_id", F.lit("box").alias("part"), F.lit(-1).alias("k"), r7("min_lon", "lon"), r7("min_lat", "lat"), r7("max_lon", "lon2"), r7("max_lat", "lat2"))
    ring = selection.circle_ring(s).select("site_id", F.lit("ring").alias("part"), "k", r7("lon", "lon"), r7("lat", "lat"), r7("lon", "lon2"), r7("lat", "lat2"))
    return box.unionByName(ring)


# --- web tiles --------------------------------------------------------------------------------

@query("g09_web_tiles_of_box", """WITH b AS (SELECT site_id, 56.25 + sx * 0.0000169::DOUBLE - radius_m / 50000 AS lon0, 58.0 + sy * 0.000009::DOUBLE - radius_m / 100000 AS lat0, 56.25 + sx * 0.0000169::DOUBLE + radius_m / 50000 AS lon1, 58.0 + sy * 0.000009::DOUBLE + radius_m / 100000 AS lat1 FROM v_sites),
t AS (SELECT site_id, z, CAST(trunc((lon0 + 180) / 360 * pow(2, z)) AS BIGINT) AS x0, CAST(trunc((lon1 + 180) / 360 * pow(2, z)) AS BIGINT) AS x1,
 CAST(trunc((1 - ln(tan(radians(lat1)) + 1 / cos(radians(lat1))) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y0, CAST(trunc((1 - ln(tan(radians(lat0)) + 1 / cos(radians(lat0))) / pi()) / 2 * pow(2, z)) AS BIGINT) AS y1 FROM b, range(8, 15) r(z))
SELECT site_id, CAST(z AS INT) AS z, x, y FROM t, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x), LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y)""")
def g09(spark, d):
    s = V(spark, d).sites()
    c = F.col
    b = s.select("site_id", (c("center_lon") - c("radius_m") / 50000).alias("min_lon"), (c("center_lat") - c("radius_m") / 100000).alias("min_lat"), (c("center_lon") + c("radius_m") / 50000).alias("max_lon"), (c("center_lat") + c("radius_m") / 100000).alias("max_lat"))
    return tiles.covering_bbox(b, 8, 14).select("site_id", "z", "x", "y")


PIX = f"""tl AS (SELECT DISTINCT CAST(14 AS INT) AS z, CAST(trunc((lon + 180) / 360 * 16384) AS BIGINT) AS tx, CAST(trunc((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS BIGINT) AS ty FROM (SELECT {LON0} + x * {DEG_X}::DOUBLE AS lon, {LAT0}::DOUBLE + y * {DEG_Y}::DOUBLE AS lat FROM v_features)),
px AS (SELECT z, tx, ty, py, px, tx * s - h + (px + 0.5) * (s / 16) AS mx, h - ty * s - (py + 0.5) * (s / 16) AS my FROM (SELECT *, 40075016.6855785::DOUBLE / 16384 AS s, 40075016.6855785::DOUBLE / 2 AS h FROM tl), range(0, 16) a(px), range(0, 16) b(py)),
pl AS (SELECT z AS zoom, tx, ty, py, px, (degrees(mx / r) - {LON0}) / {DEG_X}::DOUBLE AS x, (degrees(2 * atan(exp(my / r)) - pi() / 2) - {LAT0}) / {DEG_Y}::DOUBLE AS y FROM (SELECT *, 40075016.6855785::DOUBLE / 2 / pi() AS r FROM px)),
pe AS (SELECT zoom, tx, ty, py, px, CAST(round_even((coalesce(z, 0) + 10000) / 0.1::DOUBLE, 0) AS BIGINT) AS code FROM {sampled('pl', 'zoom, tx, ty, py, px')})"""


def encoded_pixels(v: V):
    """16 x 16 pixels of every zoom-14 tile holding a feature, over the sampled relief."""
    f = geo_features(v)
    tx, ty = tilemath.lonlat_to_web_tile(F.col("lon"), F.col("lat"), F.lit(14))
    t = f.groupBy(tx.alias("x"), ty.alias("y")).agg(F.lit(14).alias("z"))
    p = tiles.tile_pixels(t, 16).withColumnsRenamed({"x": "tx", "y": "ty", "z": "zoom"})
    p = p.select(one_source(), "zoom", "tx", "ty", "py", "px", ((F.col("lon") - LON0) / DEG_X).alias("x"), ((F.col("lat") - LAT0) / DEG_Y).alias("y"))
    p = relief.sample(p, v.cells(), v.grid(), ["zoom", "tx", "ty", "py", "px"])
    return p.withColumn("rgb", tilemath.terrain_rgb(F.coalesce("z", F.lit(0.0))))


@query("c27_tile_resample", f"WITH {PIX} SELECT zoom, tx, ty, CAST(py AS INT) AS py, CAST(px AS INT) AS px, CAST(code // 65536 % 256 AS INT) AS r, CAST(code // 256 % 256 AS INT) AS g, CAST(code % 256 AS INT) AS b FROM pe")
def c27(spark, d):
    return encoded_pixels(V(spark, d)).select("zoom", "tx", "ty", "py", "px", "rgb.r", "rgb.g", "rgb.b")


@query("s16_tile_pyramid", f"WITH {PIX} SELECT zoom AS z, tx AS x, ty AS y, count(*)::INT AS n_pixels, sum(code)::BIGINT AS code_sum FROM pe GROUP BY ALL")
def s16(spark, d):
    """One row per tile, written in z/x folders and read back."""
    p = encoded_pixels(V(spark, d)).select(F.col("zoom").alias("z"), F.col("tx").alias("x"), F.col("ty").alias("y"), "py", "px", "rgb")
    back = tables.write_and_read(tiles.packed_tiles(p), "pyramid", ["z", "x"])
    return back.select("z", "x", "y", F.size("codes").alias("n_pixels"), F.aggregate("codes", F.lit(0).cast("bigint"), lambda a, c: a + c).alias("code_sum"))


# --- objects ----------------------------------------------------------------------------------


@query("g04_scatter_in_area", """SELECT id, CAST(round_even((maxx - minx) * (maxy - miny) / 10000.0 * 40, 0) AS BIGINT) AS n_points, TRUE AS all_inside FROM v_zones""")
def g04(spark, d):
    z = V(spark, d).zones().select("id", "ring", "minx", "miny", "maxx", "maxy")
    want = at.planting_count(geom.area(F.col("ring")), F.lit(40.0))
    p = audit.scatter(z.select("id", "ring", want.alias("want")), "id", "want", seed=7)
    j = p.join(z.drop("ring"), "id")
    inside = (F.col("x") > F.col("minx")) & (F.col("x") < F.col("maxx")) & (F.col("y") > F.col("miny")) & (F.col("y") < F.col("maxy"))
    return j.groupBy("id").agg(F.count(F.lit(1)).alias("n_points"), F.bool_and(inside).alias("all_inside"))


@query("c33_vegetation", f"""SELECT osm_id, CASE osm_id % 3 WHEN 0 THEN 'tree' WHEN 1 THEN CASE WHEN osm_id % 2 = 0 THEN 'lawn' ELSE 'shrub' END ELSE 'forest' END AS branch,
 CASE WHEN osm_id % 3 = 0 THEN coalesce(surface_tag, 'лиственное (умолчание)') END AS species, CASE WHEN osm_id % 3 = 0 THEN CASE WHEN surface_tag IS NULL THEN 'умолчание' ELSE 'факт' END END AS species_confidence,
 CASE WHEN osm_id % 3 = 0 THEN coalesce({pos_float_sql('levels_tag')}, 12.0)::DOUBLE END AS height_m FROM v_features WHERE layer = 'osm_vegetation'""")
def c33(spark, d):
    k = F.col("osm_id")
    f = V(spark, d).features().where("layer = 'osm_vegetation'")
    tags = F.create_map(
        F.lit("species"), F.col("surface_tag"), F.lit("height"), F.col("levels_tag"),
        F.lit("landuse"), F.when((k % 3 == 1) & (k % 2 == 0), " Grass"), F.lit("natural"), F.when(k % 3 == 1, "scrub").when(k % 3 == 0, "tree"),
    )
    f = f.withColumn("tags", tags)
    f = f.withColumns(tg.normalize_vegetation(F.col("tags")))
    trees = objects.single_trees(f.where(k % 3 == 0)).select("osm_id", F.lit("tree").alias("branch"), "species", "species_confidence", "height_m")
    areas = f.where(k % 3 > 0).select("osm_id", objects.vegetation_branch(F.col("tags")).alias("branch"))
    return trees.unionByName(areas, allowMissingColumns=True)


@query("c34_street_furniture", f"""WITH s AS ({RECT}), p AS (SELECT osm_id, minx AS x, miny AS y FROM s UNION ALL SELECT osm_id, maxx, miny FROM s UNION ALL SELECT osm_id, maxx, maxy FROM s UNION ALL SELECT osm_id, minx, maxy FROM s)
SELECT osm_id, 'substation' AS kind, round(coalesce(min(z), 0), 6) AS base_z, 4.0::DOUBLE AS height_m FROM {sampled('p', 'osm_id')} WHERE osm_id % 2 = 0 GROUP BY osm_id
UNION ALL SELECT osm_id, CASE osm_id % 3 WHEN 0 THEN 'lamp' ELSE 'bench' END, NULL, CASE osm_id % 3 WHEN 0 THEN 6.0 ELSE 0.45 END::DOUBLE FROM v_features WHERE layer = 'osm_landscaping' AND osm_id % 3 < 2""")
def c34(spark, d):
    v = V(spark, d)
    k = F.col("osm_id")
    b = v.buildings().select("osm_id", one_source(), "ring", F.create_map(F.lit("power"), F.when(k % 2 == 0, " Substation ").otherwise("tower")).alias("tags"))
    s = objects.substations(b, v.cells(), v.grid()).select("osm_id", "kind", r6("base_z", "base_z"), "height_m")
    f = v.features().withColumn("tags", F.create_map(F.lit("highway"), F.when(k % 3 == 0, "street_lamp"), F.lit("amenity"), F.when(k % 3 == 1, "Bench")))
    o = objects.street_furniture(f)
    o = o.select("osm_id", "kind", F.lit(None).cast("double").alias("base_z"), F.coalesce("pole_height_m", "seat_height_m").alias("height_m"))
    return s.unionByName(o)


@query("w11_distance_rank", f"""WITH nr AS (SELECT b.osm_id, z.id AS zone_id, sqrt(pow(greatest(z.minx - cx, cx - z.maxx, 0), 2) + pow(greatest(z.miny - cy, cy - z.maxy, 0), 2)) AS dist FROM v_buildings b JOIN v_current z ON sqrt(pow(greatest(z.minx - cx, cx - z.maxx, 0), 2) + pow(greatest(z.miny - cy, cy - z.maxy, 0), 2)) <= 500)
SELECT osm_id, zone_id, row_number() OVER (PARTITION BY osm_id ORDER BY dist, zone_id) AS pos, rank() OVER (PARTITION BY osm_id ORDER BY dist) AS rank FROM nr""")
def w11(spark, d):
    v = V(spark, d)
    pts = v.buildings().select("osm_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    z = zones.latest(v.zones()).select(F.col("id").alias("zone_id"), "ring", "minx", "miny", "maxx", "maxy")
    return zones.ranked_near_points(pts, z, point_id="osm_id", zone_id="zone_id").select("osm_id", "zone_id", "pos", "rank")


# --- the composed selection -------------------------------------------------------------------

LEVELS = pos_int_sql("levels_tag")
SEL = f"""{GEO.replace('SELECT osm_id, layer,', 'SELECT osm_id, layer, type_tag, levels_tag, surface_tag,')}, sz AS (SELECT *, {msk_sql.zone_of('clon')} AS zone, clon AS lon, clat AS lat FROM s), {msk_sql.forward('sz', 'sf')},
hz AS (SELECT sf.site_id, sf.radius_m, sf.zone, sf.mx AS cx, sf.my AS cy, g.*, {HAV.format(lat='g.lat', lon='g.lon').replace('clat', 'sf.clat').replace('clon', 'sf.clon')} AS m FROM sf, g),
hf AS (SELECT * FROM hz WHERE m <= radius_m + 50), {msk_sql.forward('hf', 'ff')}, lo AS (SELECT *, mx - cx AS x, my - cy AS y FROM ff WHERE (mx - cx) * (mx - cx) + (my - cy) * (my - cy) <= radius_m * radius_m)"""


def tagged_features(v: V):
    c = F.col
    tags = F.create_map(
        F.lit("building"), c("type_tag"), F.lit("building:levels"), c("levels_tag"), F.lit("highway"), c("type_tag"), F.lit("surface"), c("surface_tag"),
        F.lit("lanes"), c("levels_tag"), F.lit("entrance"), c("type_tag"), F.lit("voltage"), c("levels_tag"), F.lit("species"), c("surface_tag"),
    )
    return geo_features(v).select("osm_id", "layer", "lon", "lat", tags.alias("tags"))


@query("c35_site_selection", f"""WITH {SEL} SELECT site_id, CAST(zone AS INT) AS zone, layer, osm_id, round(x, 2) + 0.0 AS x, round(y, 2) + 0.0 AS y,
 CASE WHEN layer IN ('osm_buildings', 'osm_entrances') THEN coalesce(nullif(trim(type_tag), ''), 'yes') END AS type, CASE WHEN layer = 'osm_buildings' THEN coalesce({LEVELS}, 1) END AS levels,
 CASE WHEN layer = 'osm_buildings' THEN CASE WHEN {LEVELS} IS NULL THEN 'умолчание' ELSE 'факт' END END AS levels_confidence, CASE WHEN layer = 'osm_roads' THEN surface_tag END AS surface,
 CASE WHEN layer = 'osm_power' THEN round_even({pos_float_sql('levels_tag')} / 1000.0, 3) END AS voltage_kv FROM lo""")
def c35(spark, d):
    v = V(spark, d)
    s = site_selection.select_points(tagged_features(v), v.sites())
    return s.select(
        "site_id", "zone", "layer", "osm_id", (F.round("x", 2) + 0.0).alias("x"), (F.round("y", 2) + 0.0).alias("y"), F.col("type.value").alias("type"), F.col("levels.value").alias("levels"),
        F.col("levels.confidence").alias("levels_confidence"), F.col("surface.value").alias("surface"), F.col("voltage_kv.value").alias("voltage_kv"),
    )


def flagship(spark, d):
    v = V(spark, d)
    return site_selection.layer_counts(site_selection.select_points(tagged_features(v), v.sites()))


# --- extension surface ------------------------------------------------------------------------


@query("x01_custom_elevation", """SELECT osm_id, least(0.5::DOUBLE * (cx - hx), 0.5::DOUBLE * (cx + hx)) + 100 AS base_z FROM v_buildings""")
def x01(spark, d):
    """Any DataFrame -> DataFrame function can stand in for the raster: here a sloped plane."""
    plane = lambda points: points.withColumn("z", 100.0 + 0.5 * F.col("x"))
    b = V(spark, d).buildings().select(one_source(), "osm_id", "ring")
    return relief.ring_minimum_by(b, plane, "osm_id")


@query("x02_external_heights", """SELECT b.osm_id, CASE WHEN b.osm_id % 4 = 0 THEN CAST(height_tag AS DOUBLE) WHEN b.osm_id % 4 = 1 THEN CAST(levels_tag AS DOUBLE) * 3 + 1 WHEN o.o_totalprice IS NOT NULL THEN round(o.o_totalprice / 10000, 6) ELSE 9 END AS height_m,
 CASE WHEN b.osm_id % 4 < 2 THEN 'OSM' WHEN o.o_totalprice IS NOT NULL THEN 'Overture' ELSE 'тип (умолчание)' END AS source FROM v_buildings b LEFT JOIN orders o ON o.o_orderkey = b.osm_id * 5 AND o.o_orderstatus = 'O'""")
def x02(spark, d):
    v = V(spark, d)
    ext = v.table("orders").where("o_orderstatus = 'O' and o_orderkey % 5 = 0").select((F.col("o_orderkey") / 5).cast("bigint").alias("osm_id"), (F.col("o_totalprice") / 10000).alias("ext_m"))
    lv = tg.noted(numbers.positive_int(F.col("levels_tag")), 1)
    b = v.buildings().join(ext, "osm_id", "left")
    b = b.withColumn("h", at.building_height(F.col("height_tag"), lv["value"], lv["confidence"], F.col("building_type"), F.col("ext_m")))
    return b.select("osm_id", r6("h.height_m", "height_m"), "h.source")


@query("x03_custom_normaliser", """SELECT osm_id, layer, CASE layer WHEN 'osm_waterways' THEN coalesce(length(trim(type_tag)), 0)::BIGINT END AS name_length, CASE layer WHEN 'osm_buildings' THEN coalesce(nullif(trim(type_tag), ''), 'yes') END AS type
FROM v_features WHERE layer IN ('osm_waterways', 'osm_buildings')""")
def x03(spark, d):
    """A registry entry of one's own, backed by a vectorised function."""
    def text_length(s: pd.Series) -> pd.Series:
        return s.fillna("").str.strip().str.len()

    length = F.pandas_udf(text_length, "bigint")
    registry = {"osm_buildings": tg.normalize_building, "osm_waterways": lambda t: {"name_length": tg.noted(length(t["building"]), 0)}}
    f = V(spark, d).features().where(F.col("layer").isin("osm_waterways", "osm_buildings"))
    f = f.withColumn("tags", F.create_map(F.lit("building"), F.col("type_tag")))
    f = f.withColumns(tg.normalized_attributes(F.col("layer"), F.col("tags"), registry, {"name_length": "bigint"}))
    return f.select("osm_id", "layer", F.col("name_length.value").alias("name_length"), F.col("type.value").alias("type"))


# --- composed builders ------------------------------------------------------------------------


@query("u01_real_and_calculated", f"""WITH {POLES}, real AS (SELECT osm_id AS pole_id, x, y FROM v_features WHERE layer = 'osm_power'),
bare AS (SELECT *, greatest(1, CAST(ceil(len / 60) AS BIGINT)) AS k FROM ln WHERE len > 0 AND osm_id NOT IN (SELECT line_id FROM onl WHERE pole_id IN (SELECT pole_id FROM real)))
SELECT pole_id, NULL::BIGINT AS line_id, NULL::BIGINT AS i, round(x, 6) AS x, round(y, 6) AS y, 'факт' AS source FROM real
UNION ALL SELECT NULL, osm_id, i, round(x0 + (least(i * (len / k), len) / len) * (x1 - x0), 6), round(y0 + (least(i * (len / k), len) / len) * (y1 - y0), 6), 'умолчание' FROM bare, LATERAL (SELECT unnest(range(0, k + 1)) AS i)""")
def u01(spark, d):
    """Real poles, and calculated ones where a line has none."""
    v = V(spark, d)
    l = v.lines().where("layer = 'osm_power'").select(F.col("osm_id").alias("line_id"), "path")
    p = v.features().where("layer = 'osm_power'").select(F.col("osm_id").alias("pole_id"), "x", "y")
    return builders.all_poles(l, p, "line_id", "pole_id").select("pole_id", "line_id", "i", r6("x", "x"), r6("y", "y"), "source")


def barrier_lines(v: V):
    kind = V._pick(F.col("osm_id") % 3, ["wall", "fence"], "hedge")
    return v.lines().select("osm_id", "path", kind.alias("kind"))


@query("c18_barriers", """WITH l AS (SELECT osm_id, CASE osm_id % 3 WHEN 0 THEN 'wall' WHEN 1 THEN 'fence' END AS kind, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM v_lines)
SELECT osm_id, kind, CASE kind WHEN 'wall' THEN 2.0 ELSE 1.5 END::DOUBLE AS height_m, round(len * CASE kind WHEN 'wall' THEN 0.2 ELSE 0.05 END::DOUBLE, 6) AS area_m2,
 CASE WHEN kind = 'fence' THEN greatest(1, CAST(ceil(len / 2.5) AS BIGINT)) + 1 ELSE 0 END::BIGINT AS n_posts FROM l WHERE kind IS NOT NULL AND len > 0""")
def c18_barriers(spark, d):
    l = barrier_lines(V(spark, d))
    posts = builders.fence_posts(l, "osm_id").groupBy("osm_id").agg(F.count(F.lit(1)).alias("n"))
    return builders.barriers(l, "osm_id").join(posts, "osm_id", "left").select("osm_id", "kind", "height_m", r6("area_m2", "area_m2"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_posts"))


@query("c18_platforms", """SELECT osm_id, 3.0::DOUBLE AS width_m, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * 3, 6) AS area_m2, 0.3::DOUBLE AS height_m FROM v_lines WHERE layer = 'osm_railways' AND (x1 <> x0 OR y1 <> y0)
UNION ALL SELECT -osm_id, NULL, 4 * hx * hy, 0.3 FROM v_buildings WHERE is_part""")
def c18_platforms(spark, d):
    v = V(spark, d)
    l = v.lines().where("layer = 'osm_railways'").select("osm_id", "path", F.lit("line").alias("geometry"))
    a = v.buildings().where("is_part").select((-F.col("osm_id")).alias("osm_id"), F.col("ring").alias("path"), F.lit("area").alias("geometry"))
    return builders.platforms(l.unionByName(a), "osm_id").select("osm_id", "width_m", r6("area_m2", "area_m2"), "height_m")


@query("c18_power_corridors", """SELECT osm_id, kv AS voltage_kv, w AS half_width_m, round(len * 2 * w, 6) AS area_m2 FROM (SELECT *, CASE voltage_tag WHEN '10000' THEN 10 ELSE 20 END::DOUBLE AS w, CAST(voltage_tag AS DOUBLE) / 1000 AS kv, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len
 FROM v_lines WHERE layer = 'osm_power' AND voltage_tag IS NOT NULL) WHERE len > 0""")
def c18_power_corridors(spark, d):
    l = V(spark, d).lines().where("layer = 'osm_power'")
    return builders.power_corridors(l, "osm_id", F.col("voltage_tag").try_cast("double") / 1000).select("osm_id", "voltage_kv", "half_width_m", r6("area_m2", "area_m2"))


@query("c18_waterway_ribbons", """SELECT osm_id, 3.0::DOUBLE AS width_m, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * 3, 6) AS area_m2 FROM v_lines WHERE layer = 'osm_waterways' AND (x1 <> x0 OR y1 <> y0)""")
def c18_waterway_ribbons(spark, d):
    """Two-point axes keep their length under corner cutting; levels along them are C20's."""
    v = V(spark, d)
    l = v.lines().where("layer = 'osm_waterways'").select(one_source(), "osm_id", "path")
    ribbons, _ = builders.waterway_ribbons(l, v.cells(), v.grid(), "osm_id", rules.WATER_PROFILE_STEP_M, 50.0)
    return ribbons.select("osm_id", "width_m", r6("area_m2", "area_m2"))


@query("g04_shrubs", """SELECT id, CAST(round_even((maxx - minx) * (maxy - miny) / 10000.0 * 1500, 0) AS BIGINT) AS n_shrubs, 1.2::DOUBLE AS height_m FROM v_zones""")
def g04_shrubs(spark, d):
    s = builders.shrubs(V(spark, d).zones().select("id", "ring"), "id", seed=3)
    return s.groupBy("id", "height_m").agg(F.count(F.lit(1)).alias("n_shrubs"))


@query("x04_resumable_steps", "SELECT layer, count(*) AS n, CAST(2 AS INT) AS ran_first, CAST(0 AS INT) AS ran_again FROM v_features GROUP BY layer")
def x04(spark, d):
    """The selected table is written and read by the step that follows; written again it is the same table, with no row twice."""
    v = V(spark, d)
    path = tables.fresh_path(spark, "steps") + "/select"
    selected = v.features().select("osm_id", "layer")
    for _ in range(2):
        selected.write.mode("overwrite").parquet(path)
    per_layer = lambda df, name: df.groupBy("layer").agg(F.count(F.lit(1)).alias(name))
    out = per_layer(spark.read.schema(selected.schema).parquet(path), "n").join(per_layer(selected, "want"), "layer")
    return out.select("layer", "n", F.lit(2).alias("ran_first"), F.when(F.col("n") == F.col("want"), 0).otherwise(1).alias("ran_again"))


@query("x05_geometry_kernels", f"WITH {OVERLAP} SELECT osm_id, zone_id, round(w * h, 6) AS overlap_m2, CAST(1 AS DOUBLE) AS box_fill FROM ov WHERE w > 0 AND h > 0")
def x05(spark, d):
    """Arrow kernels beside Columns: overlap area and how much of its oriented box a footprint fills."""
    b, z = overlap_inputs(V(spark, d))
    o = siting.zone_overlaps(b, z, "osm_id").where("overlap_m2 > 0")
    o = o.withColumn("o", kernels.oriented_box_udf(F.col("ring")))
    fill = geom.area(F.col("ring")) / (F.col("o.length") * F.col("o.width"))
    return o.select("osm_id", "zone_id", r6("overlap_m2", "overlap_m2"), r6(fill, "box_fill"))

