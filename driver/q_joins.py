"""Spatial, interval and graph joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver.q_tables import versioned
from driver.registry import query
from driver.views import V, r6
from sitewright import rules
from sitewright.functions import attributes as at
from sitewright.functions import geom, tilemath
from sitewright.functions import tags as tg
from sitewright.operators import jobs, lines, siting, spatial, zones
from sitewright.plans import point_card

LINE_LEN2 = "((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"


def seg_t(px: str, py: str, p: str = "") -> str:
    x0, y0, x1, y1 = (f"{p}{c}" for c in ("x0", "y0", "x1", "y1"))
    l2 = f"(({x1} - {x0}) * ({x1} - {x0}) + ({y1} - {y0}) * ({y1} - {y0}))"
    return f"(CASE WHEN {l2} > 0 THEN greatest(0.0, least(1.0, (({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / {l2})) ELSE 0.0 END)"


def seg_dist(px: str, py: str, p: str = "") -> str:
    t = seg_t(px, py, p)
    return f"sqrt(pow({p}x0 + {t} * ({p}x1 - {p}x0) - {px}, 2) + pow({p}y0 + {t} * ({p}y1 - {p}y0) - {py}, 2))"


def box_dist(px: str, py: str, p: str = "") -> str:
    return f"sqrt(pow(greatest({p}minx - {px}, {px} - {p}maxx, 0), 2) + pow(greatest({p}miny - {py}, {py} - {p}maxy, 0), 2))"


PZZ = "pzz AS (SELECT id, 'Ж-' || CAST(priority + 1 AS VARCHAR) AS zone_code, minx, miny, maxx, maxy FROM v_zones)"


def regulations(v: V):
    z = v.zones()
    return z.select("id", F.concat(F.lit("Ж-"), (F.col("priority") + 1).cast("string")).alias("zone_code"), "ring", "minx", "miny", "maxx", "maxy")


@query("j01_regulation_at_point", f"""WITH {PZZ}, h AS (SELECT f.osm_id, min(p.id) AS id FROM v_features f JOIN pzz p ON x > minx AND x < maxx AND y > miny AND y < maxy GROUP BY f.osm_id)
SELECT f.osm_id, h.id AS zone_id, p.zone_code FROM v_features f LEFT JOIN h ON h.osm_id = f.osm_id LEFT JOIN pzz p ON p.id = h.id""")
def j01(spark, d):
    v = V(spark, d)
    hit = zones.containing_zone(v.features().select("osm_id", "x", "y"), regulations(v), point_id="osm_id", area_id="id", carry=["zone_code"])
    return hit.select("osm_id", F.col("id").alias("zone_id"), "zone_code")


NET = "CASE {k} % 3 WHEN 0 THEN 'В' WHEN 1 THEN 'К' ELSE 'Г' END"
DIR_SQL = f"""rso AS (SELECT id AS rso_id, {NET.format(k='id')} AS network_type, 'org ' || id AS organization_name, CASE id % 2 WHEN 0 THEN 'письмо' ELSE 'МФЦ' END AS application_channel, minx, miny, maxx, maxy FROM v_zones),
pts AS (SELECT osm_id, {NET.format(k='osm_id')} AS network_type, x, y, CASE osm_id % 5 WHEN 0 THEN 'city water' WHEN 1 THEN '' END AS operator FROM v_features),
hit AS (SELECT p.osm_id, min(r.rso_id) AS rso_id FROM pts p JOIN rso r ON r.network_type = p.network_type AND x > minx AND x < maxx AND y > miny AND y < maxy GROUP BY p.osm_id)"""


def provider_inputs(v: V):
    nt = lambda k: V._pick(k % 3, ["В", "К"], "Г").alias("network_type")
    k = F.col("osm_id")
    pts = v.features().select("osm_id", nt(k), "x", "y", V._pick(k % 5, ["city water", ""], None).alias("operator"))
    i = F.col("id")
    rso = v.zones().select(
        i.alias("rso_id"), nt(i), F.concat(F.lit("org "), i.cast("string")).alias("organization_name"),
        F.when(i % 2 == 0, "письмо").otherwise("МФЦ").alias("application_channel"), "ring", "minx", "miny", "maxx", "maxy",
    )
    return pts, rso


@query("j02_provider_at_point", f"WITH {DIR_SQL} SELECT p.osm_id, p.network_type, h.rso_id, r.organization_name FROM pts p LEFT JOIN hit h ON h.osm_id = p.osm_id LEFT JOIN rso r ON r.rso_id = h.rso_id")
def j02(spark, d):
    pts, rso = provider_inputs(V(spark, d))
    hit = zones.containing_zone(pts, rso, point_id="osm_id", area_id="rso_id", carry=["organization_name"], by=["network_type"])
    return hit.select("osm_id", "network_type", "rso_id", "organization_name")


@query("j03_network_owner", f"""WITH {DIR_SQL} SELECT p.osm_id, p.network_type, coalesce(nullif(operator, ''), r.organization_name) AS owner_name,
 CASE WHEN nullif(operator, '') IS NOT NULL THEN 'OSM operator' WHEN r.rso_id IS NOT NULL THEN 'справочник РСО' ELSE 'требует уточнения' END AS source,
 CASE WHEN nullif(operator, '') IS NULL THEN r.application_channel END AS application_channel FROM pts p LEFT JOIN hit h ON h.osm_id = p.osm_id LEFT JOIN rso r ON r.rso_id = h.rso_id""")
def j03(spark, d):
    pts, rso = provider_inputs(V(spark, d))
    return zones.network_owner(pts, rso, point_id="osm_id")


NEAR = f"near AS (SELECT b.osm_id, z.id AS zone_id, zone_type, status, registry_number, source_name, {box_dist('b.cx', 'b.cy', 'z.')} AS dist FROM v_buildings b JOIN v_current z ON {box_dist('b.cx', 'b.cy', 'z.')} <= 500)"


def near_zones(v: V):
    pts = v.buildings().select("osm_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    z = zones.latest(v.zones()).select(F.col("id").alias("zone_id"), "zone_type", "status", "registry_number", "source_name", "ring", "minx", "miny", "maxx", "maxy")
    return pts, z


@query("j04_zones_near_point", f"WITH {NEAR} SELECT osm_id, zone_id, zone_type, round(dist, 6) AS distance_m FROM near")
def j04(spark, d):
    pts, z = near_zones(V(spark, d))
    near = zones.near_points(pts, z, point_id="osm_id")
    return near.select("osm_id", "zone_id", "zone_type", r6("distance_m", "distance_m"))


@query("j05_point_card", f"""WITH {NEAR}, {PZZ}, r AS (SELECT *, row_number() OVER (PARTITION BY osm_id ORDER BY dist, zone_id) AS pos, CASE WHEN zone_id % 2 = 0 THEN 'doc ' || zone_id END AS doc FROM near),
m AS (SELECT b.osm_id, min(p.id) AS id FROM v_buildings b JOIN pzz p ON cx > minx AND cx < maxx AND cy > miny AND cy < maxy GROUP BY b.osm_id)
SELECT b.osm_id, 'основное' AS section, CAST(0 AS BIGINT) AS pos, p.zone_code AS kind, CAST(NULL AS VARCHAR) AS detail, CAST(NULL AS DOUBLE) AS distance_m FROM v_buildings b LEFT JOIN m ON m.osm_id = b.osm_id LEFT JOIN pzz p ON p.id = m.id
UNION ALL SELECT osm_id, 'ограничения', pos, zone_type, registry_number, round_even(dist, 1) FROM r UNION ALL SELECT osm_id, 'источник', pos, zone_type, source_name, NULL FROM r
UNION ALL SELECT osm_id, 'ссылки', pos, zone_type, doc, NULL FROM r WHERE doc IS NOT NULL""")
def j05(spark, d):
    v = V(spark, d)
    pts, z = near_zones(v)
    z = z.withColumn("document_basis", F.when(F.col("zone_id") % 2 == 0, F.concat(F.lit("doc "), F.col("zone_id").cast("string"))))
    return point_card.cards(pts, z, regulations(v), point_id="osm_id")


@query("j06_entrance_match", """WITH e AS (SELECT osm_id AS entrance_id, x, y FROM v_features WHERE layer = 'osm_entrances')
SELECT b.osm_id, entrance_id FROM e JOIN v_buildings b ON sqrt(pow(greatest(abs(x - cx) - hx, 0), 2) + pow(greatest(abs(y - cy) - hy, 0), 2)) <= 1""")
def j06(spark, d):
    v = V(spark, d)
    e = v.features().where("layer = 'osm_entrances'").select(F.col("osm_id").alias("entrance_id"), "x", "y")
    return siting.match_entrances(v.buildings().select("osm_id", "ring"), e, "osm_id", "entrance_id").select("osm_id", "entrance_id")


@query("j07_outlines_without_parts", """SELECT a.osm_id FROM v_buildings a WHERE NOT a.is_part AND NOT EXISTS (SELECT 1 FROM v_buildings p WHERE p.is_part AND abs(a.cx - p.cx) <= a.hx + p.hx AND abs(a.cy - p.cy) <= a.hy + p.hy)""")
def j07(spark, d):
    b = V(spark, d).buildings().select("osm_id", "ring", "is_part")
    return siting.uncovered_outlines(b.where("not is_part"), b.where("is_part"), "osm_id").select("osm_id")


POLES = f"""pl AS (SELECT osm_id AS pole_id, x, y, CASE WHEN osm_id % 4 = 0 THEN 12.5 ELSE 9 END::DOUBLE AS height_m FROM v_features),
ln AS (SELECT *, sqrt{LINE_LEN2} AS len FROM v_lines WHERE layer = 'osm_power'),
onl AS (SELECT l.osm_id AS line_id, p.pole_id, p.x, p.y, p.height_m, {seg_t('p.x', 'p.y', 'l.')} * l.len AS pos FROM ln l JOIN pl p ON {seg_dist('p.x', 'p.y', 'l.')} <= 3)"""


def power_inputs(v: V):
    l = v.lines().where("layer = 'osm_power'").select(F.col("osm_id").alias("line_id"), "path")
    p = v.features().select(F.col("osm_id").alias("pole_id"), "x", "y", F.when(F.col("osm_id") % 4 == 0, 12.5).otherwise(9.0).alias("height_m"))
    return l, p


@query("j08_lines_without_poles", f"WITH {POLES} SELECT osm_id AS line_id FROM ln WHERE osm_id NOT IN (SELECT line_id FROM onl WHERE pole_id IN (SELECT osm_id FROM v_features WHERE layer = 'osm_power'))")
def j08(spark, d):
    """Poles are the point elements of the power layer."""
    v = V(spark, d)
    l, p = power_inputs(v)
    p = p.join(v.features().where("layer = 'osm_power'").select(F.col("osm_id").alias("pole_id")), "pole_id", "left_semi")
    return lines.lines_without_poles(l, p, "line_id").select("line_id")


@query("j09_poles_on_line", f"""WITH {POLES}, n AS (SELECT line_id, pole_id, pos, row_number() OVER (PARTITION BY line_id ORDER BY pos, pole_id) AS pos_no, count(*) OVER (PARTITION BY line_id) AS c FROM onl)
SELECT line_id, pole_id, round(pos, 6) AS pos_m, pos_no FROM n WHERE c >= 2""")
def j09(spark, d):
    from sitewright.operators.chunks import sequenced

    l, p = power_inputs(V(spark, d))
    on = lines.poles_on_lines(l, p, "line_id", "pole_id").select("line_id", "pole_id", "pos")
    counts = on.groupBy("line_id").agg(F.count(F.lit(1)).alias("c")).where("c >= 2").select("line_id")
    num = sequenced(on, ["line_id"], ["pos", "pole_id"], F.floor(F.col("pos") / 5000.0), number="pos_no")
    return num.join(counts, "line_id").select("line_id", "pole_id", r6("pos", "pos_m"), "pos_no")


RAIL_W = "(CASE WHEN osm_id % 5 = 1 THEN 8.5 ELSE 4.0 END)"


@query("j10_nearest_rail", f"""WITH c AS (SELECT osm_id AS crossing_id, x, y FROM v_features WHERE layer = 'osm_landscaping'), r AS (SELECT *, {RAIL_W}::DOUBLE AS width_m FROM v_lines WHERE layer = 'osm_railways'),
d AS (SELECT crossing_id, r.osm_id AS rail_id, width_m, {seg_dist('c.x', 'c.y', 'r.')} AS dist FROM c, r)
SELECT crossing_id, rail_id, width_m, round(dist, 6) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY crossing_id ORDER BY dist, rail_id) AS rn FROM d) WHERE rn = 1""")
def j10(spark, d):
    v = V(spark, d)
    site = F.lit(0).alias("site_id")
    c = v.features().where("layer = 'osm_landscaping'").select(site, F.col("osm_id").alias("crossing_id"), F.array(geom.point(F.col("x"), F.col("y"))).alias("qpath"))
    k = F.col("osm_id")
    tracks = F.when(k % 5 == 1, "2")
    r = v.lines().where("layer = 'osm_railways'").select(site, k.alias("rail_id"), "path", at.ballast(F.lit(None).cast("string"), tracks)["width_m"].alias("width_m"))
    n = spatial.nearest_path(
        c, r, query_id=["crossing_id"], by=["site_id"], query_path="qpath", path="path", path_order=F.col("rail_id"), carry=["width_m"],
        distance=lambda q, s: geom.dist_to_path(q[0].x, q[0].y, s), pieces=32,
    )
    out = c.select("crossing_id").join(n.select("crossing_id", "nearest"), "crossing_id", "left")
    return out.select(
        "crossing_id", F.col("nearest.hit.ord").alias("rail_id"), F.coalesce("nearest.hit.width_m", F.lit(rules.BALLAST_DEFAULT_M)).alias("width_m"),
        r6("nearest.dist", "distance_m"),
    )


CROSS = """br AS (SELECT osm_id, x0, y0, x1, y1 FROM v_lines WHERE layer = 'osm_roads' AND bridge_tag = 'yes'),
ax AS (SELECT osm_id, CASE layer WHEN 'osm_roads' THEN 'road' ELSE 'rail' END AS kind, x0, y0, x1, y1 FROM v_lines WHERE layer IN ('osm_roads', 'osm_railways') AND coalesce(bridge_tag, 'no') <> 'yes'),
dt AS (SELECT b.osm_id AS bridge_id, a.osm_id AS cross_id, kind, b.x0, b.y0, b.x1 - b.x0 AS bx, b.y1 - b.y0 AS b_y, a.x0 - b.x0 AS ox, a.y0 - b.y0 AS oy, a.x1 - a.x0 AS ax, a.y1 - a.y0 AS ay FROM br b, ax a),
su AS (SELECT *, (ox * ay - oy * ax) / (bx * ay - b_y * ax) AS s, (ox * b_y - oy * bx) / (bx * ay - b_y * ax) AS u FROM dt WHERE bx * ay - b_y * ax <> 0),
cr AS (SELECT bridge_id, cross_id, kind, s, x0 + s * bx AS x, y0 + s * b_y AS y FROM su WHERE s BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


def crossed(v: V):
    l = v.lines()
    bridges = l.where("layer = 'osm_roads'").where(tg.is_set(F.col("bridge_tag"))).select(F.col("osm_id").alias("bridge_id"), "path")
    axes = l.where(F.col("layer").isin("osm_roads", "osm_railways") & ~tg.is_set(F.col("bridge_tag"))).select(
        F.col("osm_id").alias("cross_id"), F.when(F.col("layer") == "osm_roads", "road").otherwise("rail").alias("kind"), "path"
    )
    return bridges, axes


def crossings(v: V):
    bridges, axes = crossed(v)
    return bridges, lines.axis_crossings(bridges, axes, "bridge_id", "cross_id")


@query("j11_bridge_crossings", f"WITH {CROSS} SELECT bridge_id, cross_id, kind, round(x, 6) AS x, round(y, 6) AS y FROM cr")
def j11(spark, d):
    return crossings(V(spark, d))[1].select("bridge_id", "cross_id", "kind", r6("x", "x"), r6("y", "y"))


OVERLAP = """ov AS (SELECT b.osm_id, z.id AS zone_id, zone_type, least(cx + hx, maxx) - greatest(cx - hx, minx) AS w, least(cy + hy, maxy) - greatest(cy - hy, miny) AS h FROM v_buildings b, v_current z
 WHERE cx - hx <= maxx AND cx + hx >= minx AND cy - hy <= maxy AND cy + hy >= miny)"""


def overlap_inputs(v: V):
    z = zones.latest(v.zones()).select(F.col("id").alias("zone_id"), "zone_type", F.col("ring").alias("zring"))
    return v.buildings().select("osm_id", "ring"), z


@query("j12_zone_overlaps", f"WITH {OVERLAP} SELECT osm_id, zone_id, zone_type, round(w * h, 6) AS overlap_m2 FROM ov")
def j12(spark, d):
    b, z = overlap_inputs(V(spark, d))
    return siting.zone_overlaps(b, z, "osm_id").select("osm_id", "zone_id", "zone_type", r6("overlap_m2", "overlap_m2"))


# distance of a line to a rectangle: 0 when they meet, else the least corner-line or end-rectangle distance
def line_rect_sql(line: str, rect: str) -> str:
    corners = [(f"{rect}cx {a} {rect}hx", f"{rect}cy {b} {rect}hy") for a in "+-" for b in "+-"]
    ends = [(f"{line}x0", f"{line}y0"), (f"{line}x1", f"{line}y1")]
    c = ", ".join(seg_dist(f"({x})", f"({y})", line) for x, y in corners)
    e = ", ".join(f"sqrt(pow(greatest(abs({x} - {rect}cx) - {rect}hx, 0), 2) + pow(greatest(abs({y} - {rect}cy) - {rect}hy, 0), 2))" for x, y in ends)
    return f"least({c}, {e})"


def line_meets_rect_sql(line: str, rect: str) -> str:
    """Separating axes: both boxes overlap and the corners are not all on one side of the line."""
    side = lambda x, y: f"sign(({line}x1 - {line}x0) * (({y}) - {line}y0) - ({line}y1 - {line}y0) * (({x}) - {line}x0))"
    s = ", ".join(side(f"{rect}cx {a} {rect}hx", f"{rect}cy {b} {rect}hy") for a in "+-" for b in "+-")
    return (
        f"(least({line}x0, {line}x1) <= {rect}cx + {rect}hx AND greatest({line}x0, {line}x1) >= {rect}cx - {rect}hx"
        f" AND least({line}y0, {line}y1) <= {rect}cy + {rect}hy AND greatest({line}y0, {line}y1) >= {rect}cy - {rect}hy AND least({s}) <= 0 AND greatest({s}) >= 0)"
    )


CLEAR = f"""pr AS (SELECT l.osm_id AS line_id, b.osm_id, l.layer, CASE WHEN {line_meets_rect_sql('l.', 'b.')} THEN 0 ELSE {line_rect_sql('l.', 'b.')} END AS dist FROM v_lines l JOIN v_buildings b
 ON least(l.x0, l.x1) - 2 <= b.cx + b.hx AND greatest(l.x0, l.x1) + 2 >= b.cx - b.hx AND least(l.y0, l.y1) - 2 <= b.cy + b.hy AND greatest(l.y0, l.y1) + 2 >= b.cy - b.hy)"""


@query("j13_network_clearance", f"WITH {CLEAR} SELECT osm_id, line_id, layer, round(dist, 6) AS distance_m FROM pr WHERE dist < 2")
def j13(spark, d):
    v = V(spark, d)
    l = v.lines().select(F.col("osm_id").alias("line_id"), "layer", "path")
    return siting.network_clearances(v.buildings().select("osm_id", "ring"), l, "osm_id").select("osm_id", "line_id", "layer", r6("distance_m", "distance_m"))


@query("j14_site_clearing", """SELECT b.osm_id, CASE WHEN EXISTS (SELECT 1 FROM v_zones z WHERE b.cx - b.hx <= z.maxx AND b.cx + b.hx >= z.minx AND b.cy - b.hy <= z.maxy AND b.cy + b.hy >= z.miny) THEN 'removed' ELSE 'kept' END AS part FROM v_buildings b""")
def j14(spark, d):
    v = V(spark, d)
    f = v.buildings().select("osm_id", F.col("ring").alias("fring"))
    return siting.clear_site(f, v.zones().select("ring"), "osm_id").select("osm_id", "part")


@query("j15_access_road", f"""WITH r AS (SELECT * FROM v_lines WHERE layer = 'osm_roads'), s AS (SELECT id AS site_id, (minx + maxx) / 2 AS cx, (miny + maxy) / 2 AS cy, (maxx - minx) / 2 AS hx, (maxy - miny) / 2 AS hy FROM v_zones),
d AS (SELECT site_id, r.osm_id AS road_id, highway, CASE WHEN {line_meets_rect_sql('r.', 's.')} THEN 0 ELSE {line_rect_sql('r.', 's.')} END AS dist FROM s, r WHERE r.osm_id // 4 % 2 = site_id % 3),
n AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY dist, road_id) AS rn FROM d)
SELECT s.site_id, road_id, CASE WHEN road_id IS NOT NULL THEN CASE WHEN highway IN ('primary', 'tertiary_link') THEN 'каркасная' ELSE 'внутриквартальная' END END AS network, round(dist, 6) AS distance_m, coalesce(highway IN ('primary', 'tertiary_link'), FALSE) AS needs_confirmation
FROM s LEFT JOIN n ON n.site_id = s.site_id AND rn = 1""")
def j15(spark, d):
    v = V(spark, d)
    # three towns, the last without a road
    s = v.zones().select((F.col("id") % 3).alias("town"), F.col("id").alias("site_id"), "ring")
    r = v.lines().where("layer = 'osm_roads'").select((F.floor(F.col("osm_id") / 4) % 2).alias("town"), F.col("osm_id").alias("road_id"), "path", at.road_network(F.col("highway")).alias("network"))
    o = v.buildings().select(F.col("ring").alias("oring"))
    return siting.access_roads(s, r, o, "site_id", "road_id", by=["town"]).select("site_id", "road_id", "network", r6("distance_m", "distance_m"), "needs_confirmation")


@query("j16_line_of_sight", f"""WITH wk AS (SELECT *, sqrt{LINE_LEN2} AS len FROM v_lines WHERE layer = 'osm_roads'), sm AS (SELECT osm_id AS walk_id, i, x0 + (x1 - x0) * (i / n) AS x, y0 + (y1 - y0) * (i / n) AS y
 FROM (SELECT *, greatest(1, CAST(floor(len / 10) AS BIGINT)) AS n FROM wk WHERE len > 0), LATERAL (SELECT unnest(range(0, n + 1)) AS i)),
nr AS (SELECT z.id AS target_id, walk_id, i, x, y, (minx + maxx) / 2 AS tx, (miny + maxy) / 2 AS ty FROM sm JOIN v_zones z ON pow(x - (minx + maxx) / 2, 2) + pow(y - (miny + maxy) / 2, 2) <= 22500),
bl AS (SELECT DISTINCT target_id, walk_id, i FROM (SELECT nr.*, b.cx, b.cy, b.hx, b.hy, x AS x0, y AS y0, tx AS x1, ty AS y1 FROM nr JOIN v_buildings b ON least(x, tx) <= b.cx + b.hx AND greatest(x, tx) >= b.cx - b.hx AND least(y, ty) <= b.cy + b.hy AND greatest(y, ty) >= b.cy - b.hy)
 WHERE greatest(CASE WHEN x1 = x0 THEN 0 ELSE least((cx - hx - x0) / (x1 - x0), (cx + hx - x0) / (x1 - x0)) END, CASE WHEN y1 = y0 THEN 0 ELSE least((cy - hy - y0) / (y1 - y0), (cy + hy - y0) / (y1 - y0)) END, 0)
  < least(CASE WHEN x1 = x0 THEN 1 ELSE greatest((cx - hx - x0) / (x1 - x0), (cx + hx - x0) / (x1 - x0)) END, CASE WHEN y1 = y0 THEN 1 ELSE greatest((cy - hy - y0) / (y1 - y0), (cy + hy - y0) / (y1 - y0)) END, 1)
  AND (x1 <> x0 OR (x0 > cx - hx AND x0 < cx + hx)) AND (y1 <> y0 OR (y0 > cy - hy AND y0 < cy + hy))
  AND NOT (abs(x0 - cx) < hx AND abs(y0 - cy) < hy AND abs(x1 - cx) < hx AND abs(y1 - cy) < hy))
SELECT nr.target_id, nr.walk_id, nr.i, round(nr.x, 6) AS x, round(nr.y, 6) AS y FROM nr LEFT JOIN bl ON bl.target_id = nr.target_id AND bl.walk_id = nr.walk_id AND bl.i = nr.i WHERE bl.i IS NULL""")
def j16(spark, d):
    v = V(spark, d)
    t = v.zones().select(F.col("id").alias("target_id"), ((F.col("minx") + F.col("maxx")) / 2).alias("tx"), ((F.col("miny") + F.col("maxy")) / 2).alias("ty"))
    w = v.lines().where("layer = 'osm_roads'").select(F.col("osm_id").alias("walk_id"), "path")
    o = v.buildings().select(F.col("ring").alias("oring"))
    return siting.view_points(t, w, o, "target_id", "walk_id").select("target_id", "walk_id", "i", r6("x", "x"), r6("y", "y"))


@query("j17_label_to_segment", """WITH m AS (SELECT osm_id, (x0 + x1) / 2 AS mx, (y0 + y1) / 2 AS my FROM v_lines),
h AS (SELECT m.osm_id, t.seq, t.txt, (t.x - mx) * (t.x - mx) + (t.y - my) * (t.y - my) AS d2 FROM m JOIN v_texts t ON abs(t.x - mx) <= 40 AND abs(t.y - my) <= 40)
SELECT m.osm_id, b.txt AS label FROM m LEFT JOIN (SELECT osm_id, txt, row_number() OVER (PARTITION BY osm_id ORDER BY d2, seq DESC) AS rn FROM h WHERE d2 <= 1600) b ON b.osm_id = m.osm_id AND b.rn = 1""")
def j17(spark, d):
    """Snap distance 40 m: the synthetic drawing is sparse."""
    v = V(spark, d)
    return siting.label_segments(v.lines().select("osm_id", "path"), v.texts().select("seq", "x", "y", "txt"), "osm_id", snap_m=40.0).select("osm_id", "label")


@query("j19_object_tiles", """SELECT CAST(floor(cx / 250) AS BIGINT) AS tx, CAST(floor(cy / 250) AS BIGINT) AS ty, count(*) AS n_buildings, max(osm_id) AS last_id FROM v_buildings GROUP BY ALL""")
def j19(spark, d):
    b = V(spark, d).buildings().withColumn("c", geom.centroid(F.col("ring")))
    return b.groupBy(tilemath.tile_of(F.round("c.x", 6)).alias("tx"), tilemath.tile_of(F.round("c.y", 6)).alias("ty")).agg(F.count(F.lit(1)).alias("n_buildings"), F.max("osm_id").alias("last_id"))


@query("j20_lane_attributes", """WITH w AS (SELECT osm_id AS way_id, CASE WHEN osm_id % 3 = 0 THEN 'asphalt' WHEN osm_id % 3 = 1 THEN '' END AS surface, CASE WHEN osm_id % 2 = 0 THEN highway END AS highway FROM v_lines),
l AS (SELECT osm_id AS lane_id, CASE WHEN osm_id % 6 = 5 THEN 'Buffer(Verge)' ELSE 'Driving' END AS lane_type, [osm_id, osm_id + 1, osm_id + 2] AS ids FROM v_lines),
x AS (SELECT lane_id, lane_type, w.*, list_position(ids, way_id) AS pos FROM l, w WHERE list_contains(ids, way_id)),
g AS (SELECT lane_id, max(lane_type) AS lane_type, arg_min(surface, pos) FILTER (coalesce(surface, '') <> '') AS s, arg_min(highway, pos) FILTER (coalesce(highway, '') <> '') AS h FROM x GROUP BY lane_id)
SELECT lane_id, CASE WHEN lane_type = 'Buffer(Verge)' THEN 'grass' ELSE s END AS surface, CASE WHEN h IN ('primary', 'tertiary_link') THEN 'каркасная' ELSE 'внутриквартальная' END AS network FROM g""")
def j20(spark, d):
    l = V(spark, d).lines()
    k = F.col("osm_id")
    ways = l.select(k.alias("way_id"), F.when(k % 3 == 0, "asphalt").when(k % 3 == 1, "").alias("surface"), F.when(k % 2 == 0, F.col("highway")).alias("highway"))
    lanes = l.select(k.alias("lane_id"), F.when(k % 6 == 5, "Buffer(Verge)").otherwise("Driving").alias("lane_type"), F.array(k, k + 1, k + 2).alias("way_ids"))
    return lines.lane_attributes(lanes, ways)


@query("j21_network_by_touch", """SELECT z.id, CASE WHEN EXISTS (SELECT 1 FROM v_buildings b WHERE b.osm_id % 5 = 0 AND b.cx - b.hx <= z.maxx AND b.cx + b.hx >= z.minx AND b.cy - b.hy <= z.maxy AND b.cy + b.hy >= z.miny) THEN 'каркасная' ELSE 'внутриквартальная' END AS network FROM v_zones z""")
def j21(spark, d):
    v = V(spark, d)
    lanes = v.buildings().select("ring", F.when(F.col("osm_id") % 5 == 0, rules.NETWORK_BACKBONE).otherwise(rules.NETWORK_INTERNAL).alias("network"))
    return lines.network_by_touch(v.zones().select("id", "ring"), lanes, "id").select("id", "network")


@query("j22_peak_per_step", """SELECT s.job_id, s.step_id, max(m.rss_kb) AS peak_rss_kb, count(m.rss_kb) > 0 AS has_samples FROM (SELECT *, coalesce(finished_at, TIMESTAMP '2024-01-31 00:00:00') AS e FROM v_steps WHERE status <> 'pending') s LEFT JOIN v_samples m ON m.job_id = s.job_id AND m.ts BETWEEN s.started_at AND s.e GROUP BY s.job_id, s.step_id
UNION ALL SELECT job_id, step_id, NULL, FALSE FROM v_steps WHERE status = 'pending'""")
def j22(spark, d):
    v = V(spark, d)
    s = v.steps()
    run = F.col("status") != "pending"
    s = s.select("job_id", "step_id", F.when(run, F.col("started_at")).alias("started_at"),
                 F.when(run, F.coalesce("finished_at", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))).alias("ended_at"))
    p = jobs.peak_in_steps(v.samples(), s)
    return p.select("job_id", "step_id", "peak_rss_kb", F.col("peak_rss_kb").isNotNull().alias("has_samples"))


GRAPH = """wy AS (SELECT osm_id AS way_id, osm_id % 400 AS n0, (osm_id * 7) % 400 AS n1, (osm_id * 13 + 5) % 400 AS n2, osm_id % 9 = 8 AS bad FROM v_lines),
vx AS (SELECT way_id, 0 AS seq, n0 AS node FROM wy WHERE NOT bad UNION ALL SELECT way_id, 1, n1 FROM wy WHERE NOT bad UNION ALL SELECT way_id, 2, n2 FROM wy WHERE NOT bad)"""


@query("j23_node_graph", f"""WITH {GRAPH} SELECT 'node' AS part, node AS a, CAST(NULL AS BIGINT) AS b, arg_min(CAST(way_id * 10 + seq AS DOUBLE), way_id * 10 + seq) AS x, count(DISTINCT way_id) > 1 AS junction FROM vx GROUP BY node
UNION ALL SELECT 'edge', p.node, q.node, CAST(p.way_id AS DOUBLE), NULL FROM vx p JOIN vx q ON q.way_id = p.way_id AND q.seq = p.seq + 1""")
def j23(spark, d):
    k = F.col("osm_id")
    nodes = F.array(k % 400, (k * 7) % 400, (k * 13 + 5) % 400)
    w = V(spark, d).lines().select(
        k.alias("way_id"), F.when(k % 9 == 8, F.slice(nodes, 1, 2)).otherwise(nodes).alias("nodes"),
        F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: geom.point(k * 10 + i, F.lit(0))).alias("path"),
    )
    n, e = lines.node_graph(w)
    null_b = F.lit(None).cast("boolean")
    return n.select(F.lit("node").alias("part"), F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "x", "junction").unionByName(
        e.select(F.lit("edge").alias("part"), F.col("node_from").alias("a"), F.col("node_to").alias("b"), F.col("way_id").cast("double").alias("x"), null_b.alias("junction"))
    )


@query("j24_curbs", """WITH b AS (SELECT osm_id, cx, cy, hx, hy FROM v_buildings WHERE osm_id % 4 > 0)
SELECT CAST(osm_id AS VARCHAR) AS ways_key, cx + hx AS x0, cy - hy AS y0, cx + hx AS x1, cy + hy AS y1, 2 * hy AS length_m, round(2 * hy * 0.15::DOUBLE, 6) AS area_m2 FROM b""")
def j24(spark, d):
    """Per way: a driving lane and a sidewalk sharing its right side; every fourth way is gravel."""
    b = V(spark, d).buildings()
    c = F.col
    way = F.array("osm_id")
    drive = b.select(way.alias("way_ids"), F.lit("Driving").alias("lane_type"), "ring")
    x0 = c("cx") + c("hx")
    walk = b.select(way.alias("way_ids"), F.lit("Sidewalk").alias("lane_type"), geom.rect_ring(x0, c("cy") - c("hy"), x0 + 2, c("cy") + c("hy")).alias("ring"))
    ways = b.select(c("osm_id").alias("way_id"), F.when(c("osm_id") % 4 == 0, "Gravel").otherwise("asphalt").alias("surface"))
    return lines.curbs(drive.unionByName(walk), ways).withColumn("area_m2", F.round("area_m2", 6))


