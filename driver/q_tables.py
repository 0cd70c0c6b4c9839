"""Sources, sinks, upserts, filters, windows, listings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver.registry import query
from driver.views import V, lonlat, r6
from sitewright import rules
from sitewright.functions import geom, tilemath
from sitewright.functions import tags as tg
from sitewright.operators import audit, exports, jobs, lines, relief, selection, tiles, zones
from sitewright.sources import osm, raster, tables

# --- elements with tags: every order is one map element ---------------------------------------

TAG_RULES = [  # (remainder of osm_id % 16, tags)
    {"entrance": "main"}, {"building": "yes", "building:levels": "5"}, {"building:part": "yes"}, {"highway": "residential", "surface": "asphalt", "lanes": "2"},
    {"railway": "rail"}, {"railway": "platform"}, {"waterway": "stream"}, {"natural": "water"}, {"natural": "tree", "leaf_type": "broadleaved"},
    {"natural": "wood"}, {"power": "line"}, {"power": "pole"}, {"amenity": "bench"}, {"barrier": "fence"}, {"highway": "service", "service": "alley"},
    {"type": "multipolygon", "building": "yes"},
]
ELEMENT_SQL = """e AS (SELECT o_orderkey AS id, CAST(o_orderkey % 16 AS INT) AS k, CASE WHEN o_orderkey % 7 = 6 THEN 'relation' WHEN o_orderkey % 7 >= 3 THEN 'way' ELSE 'node' END AS kind,
 o_orderkey % 5 < 3 AS closed FROM orders)"""


def elements(v: V):
    k = F.col("o_orderkey")
    tag_maps = F.array(*[F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) for t in TAG_RULES])
    return v.table("orders").select(
        k.alias("id"), (k % 16).cast("int").alias("k"), F.when(k % 7 == 6, "relation").when(k % 7 >= 3, "way").otherwise("node").alias("kind"),
        (k % 5 < 3).alias("closed"), F.get(tag_maps, (k % 16).cast("int")).alias("tags"),
    )


ROUTE_SQL = f"""WITH {ELEMENT_SQL},
r AS (SELECT *, CASE kind WHEN 'node' THEN CASE k WHEN 0 THEN 'osm_entrances' WHEN 8 THEN 'osm_vegetation' WHEN 11 THEN 'osm_power' WHEN 12 THEN 'osm_landscaping' WHEN 13 THEN 'osm_landscaping' END
 WHEN 'way' THEN CASE k WHEN 1 THEN CASE WHEN closed THEN 'osm_buildings' END WHEN 2 THEN CASE WHEN closed THEN 'osm_building_parts' END WHEN 3 THEN 'osm_roads' WHEN 4 THEN 'osm_railways'
  WHEN 5 THEN 'osm_railway_platforms' WHEN 6 THEN 'osm_waterways' WHEN 7 THEN CASE WHEN closed THEN 'osm_water_areas' END WHEN 9 THEN CASE WHEN closed THEN 'osm_vegetation' END
  WHEN 10 THEN 'osm_power' WHEN 13 THEN 'osm_landscaping' WHEN 14 THEN 'osm_roads' WHEN 15 THEN CASE WHEN closed THEN 'osm_buildings' END END
 WHEN 'relation' THEN CASE k WHEN 15 THEN 'osm_buildings' END END AS layer FROM e)"""


@query("s01_layer_router", f"""{ROUTE_SQL} SELECT id, kind, layer, CASE WHEN layer IS NULL THEN NULL WHEN kind = 'node' THEN 'point' WHEN kind = 'relation' THEN 'area'
 WHEN k IN (3, 4, 6, 10, 13, 14) THEN 'line' WHEN closed THEN 'area' ELSE 'line' END AS geometry FROM r""")
def s01(spark, d):
    return osm.route(elements(V(spark, d))).select("id", "kind", "layer", "geometry")


@query("s02_layer_scan", "SELECT layer, osm_id, levels_tag FROM v_features WHERE layer IN ('osm_buildings', 'osm_roads')")
def s02(spark, d):
    """Written as one folder per layer, then only two folders are read."""
    f = V(spark, d).features().select("osm_id", "levels_tag", "layer")
    path = tables.fresh_path(spark, "layers")
    osm.write_layers(f, path)
    return osm.read_layers(spark, path, ["osm_buildings", "osm_roads"]).select("layer", "osm_id", "levels_tag")


@query("s03_zone_ingest", """SELECT id, CAST(k AS INT) AS part_no, CASE WHEN t IS NULL OR (st = 'официально' AND registry_number IS NULL) OR id % 7 = 6 THEN 'rejected' ELSE 'valid' END AS part, st AS status,
 CASE WHEN t IS NULL THEN 'no zone_type' WHEN st = 'официально' AND registry_number IS NULL THEN 'official zone without registry number' WHEN id % 7 = 6 THEN 'no polygon geometry' END AS reject_reason,
 CASE WHEN id % 7 < 6 THEN maxx - minx END AS width, CASE WHEN id % 7 < 6 THEN (maxx - minx) * (maxy - miny) * CASE WHEN id % 3 = 1 THEN 0.75 ELSE 1 END END AS area_m2
FROM (SELECT *, CASE WHEN id % 9 > 0 THEN zone_type END AS t, CASE WHEN id % 4 = 1 THEN 'официально' WHEN status = 'официально' THEN 'официально' ELSE status END AS st FROM v_zones), range(1, 3) x(k)
WHERE k = 1 OR (id % 3 = 2 AND id % 7 < 6)""")
def s03(spark, d):
    """Zones go out as GeoJSON collections and come back through the loader: plain, with a hole of a
    quarter of the area, in two parts, and as lines, which are no zones."""
    z = V(spark, d).zones()
    k = F.col("id")
    corners = lambda r: F.transform(r, lambda p: F.array(p.x, p.y))
    w4, h4 = (F.col("maxx") - F.col("minx")) / 4, (F.col("maxy") - F.col("miny")) / 4
    hole = geom.rect_ring(F.col("minx") + w4, F.col("miny") + h4, F.col("maxx") - w4, F.col("maxy") - h4)
    plain, pierced = F.array(corners("ring")), F.array(corners("ring"), corners(hole))
    twice = F.array(plain, F.array(corners(geom.translate(F.col("ring"), F.lit(1000.0), F.lit(0.0)))))
    kind = F.when(k % 7 == 6, "LineString").when(k % 3 == 2, "MultiPolygon").otherwise("Polygon")
    coords = F.when(k % 7 == 6, F.to_json(corners("ring"))).when(k % 3 == 2, F.to_json(twice)).when(k % 3 == 1, F.to_json(pierced)).otherwise(F.to_json(plain))
    props = F.struct(
        F.when(k % 9 > 0, F.col("zone_type")).alias("zone_type"), F.when(k % 4 != 1, F.col("status")).alias("status"),
        F.col("id").cast("string").alias("regime"), "registry_number",
    )
    one = z.select(F.concat(
        F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coords,
        F.lit('},"properties":'), F.to_json(props), F.lit("}]}"),
    ).alias("value"))
    path = tables.fresh_path(spark, "zones")
    one.write.text(path)
    back = tables.zones_from_geojson(spark, path, multi_line=False)
    w = F.array_max(F.transform("ring", lambda p: p.x)) - F.array_min(F.transform("ring", lambda p: p.x))
    return back.select(F.col("regime").cast("bigint").alias("id"), "part_no", "part", "status", "reject_reason", w.alias("width"), geom.area(F.col("ring")).alias("area_m2"))


@query("s04_regulation_load", """SELECT id, 'Ж-' || CAST(priority + 1 AS VARCHAR) AS zone_code, CAST(2 + id % 3 AS INT) AS n_uses, CAST(1 AS INT) AS n_polygons, CAST(3 + id % 4 AS DOUBLE) AS setback_m,
 CASE WHEN id % 4 > 0 THEN CAST(9 + id % 30 AS DOUBLE) END AS max_height_m FROM v_zones""")
def s04(spark, d):
    z = V(spark, d).zones()
    k = F.col("id")
    uses = F.slice(F.array(*map(F.lit, ["2.1", "2.5", "3.1", "4.4"])), F.lit(1), (2 + k % 3).cast("int"))
    z = z.select(
        "id", F.concat(F.lit("Ж-"), (F.col("priority") + 1).cast("string")).alias("zone_code"), uses.alias("vri"),
        F.array("ring").alias("polygons"), (3 + k % 4).cast("double").alias("setback_m"), F.when(k % 4 > 0, (9 + k % 30).cast("double")).alias("max_height_m"),
    )
    back = tables.write_and_read(z, "regulations")
    return back.select("id", "zone_code", F.size("vri").alias("n_uses"), F.size("polygons").alias("n_polygons"), "setback_m", "max_height_m")


@query("s05_provider_directory", """SELECT id, ch AS application_channel, CASE WHEN ch = 'факс' OR ch IS NULL THEN 'rejected' ELSE 'valid' END AS part,
 CASE WHEN ch = 'факс' OR ch IS NULL THEN 'unknown application channel' END AS reject_reason
FROM (SELECT id, CASE id % 6 WHEN 0 THEN 'письмо' WHEN 1 THEN 'личный кабинет' WHEN 2 THEN 'Госуслуги' WHEN 3 THEN 'МФЦ' WHEN 4 THEN 'факс' END AS ch FROM v_zones)""")
def s05(spark, d):
    z = V(spark, d).zones().select("id", V._pick(F.col("id") % 6, [*rules.APPLICATION_CHANNELS, "факс"], None).alias("application_channel"))
    return tables.checked_directory(z).select("id", "application_channel", "part", "reject_reason")


@query("s06_import_log_append", "SELECT source_name, count(*) AS n, epoch_us(max(data_timestamp)) AS newest_us, TRUE AS load_time_set FROM v_imports GROUP BY source_name")
def s06(spark, d):
    log = tables.write_and_read(tables.import_log_rows(V(spark, d).imports()), "import-log")
    return log.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("data_timestamp").cast("timestamp")).alias("newest_us"),
        F.bool_and(F.col("imported_at").isNotNull()).alias("load_time_set"),
    )


@query("s07_register_coverage", "SELECT id, source_name, priority, minx, miny, maxx, maxy, CAST(5 AS INT) AS corners FROM v_zones WHERE minx <= 500 AND maxx >= -500")
def s07(spark, d):
    z = V(spark, d).zones().select("id", "source_name", "priority", "ring")
    stored = tables.write_and_read(geom.with_bbox(z, "ring"), "coverage")
    return stored.where("minx <= 500 and maxx >= -500").select("id", "source_name", "priority", "minx", "miny", "maxx", "maxy", F.size("ring").alias("corners"))


@query("s08_text_raster", "SELECT r, c, z FROM v_cells")
def s08(spark, d):
    path = tables.fresh_path(spark, "raster")
    raster.grid_lines(V(spark, d).cells(), block=50).write.text(path)
    return raster.read_grid_lines(spark, path).select("r", "c", "z")


@query("s09_site_dataset_sink", """SELECT layer, osm_id, CASE layer WHEN 'osm_buildings' THEN coalesce(nullif(trim(type_tag), ''), 'yes') WHEN 'osm_entrances' THEN 'yes' END AS type,
 CASE layer WHEN 'osm_buildings' THEN CASE WHEN nullif(trim(type_tag), '') IS NULL THEN 'умолчание' ELSE 'факт' END WHEN 'osm_entrances' THEN 'умолчание' END AS type_confidence,
 CASE layer WHEN 'osm_roads' THEN surface_tag END AS surface, CASE layer WHEN 'osm_roads' THEN CASE WHEN surface_tag IS NULL THEN 'умолчание' ELSE 'факт' END END AS surface_confidence FROM v_features""")
def s09(spark, d):
    f = V(spark, d).features().withColumn("tags", F.create_map(F.lit("building"), F.col("type_tag"), F.lit("surface"), F.col("surface_tag")))
    f = f.withColumns(tg.normalized_attributes(F.col("layer"), F.col("tags"))).select("osm_id", "type", "surface", "layer")
    flat = tables.flatten_attributes(f, ["type", "surface"])
    return tables.write_and_read(flat, "dataset", ["layer"]).select("layer", "osm_id", "type", "type_confidence", "surface", "surface_confidence")


@query("s10_zone_export", """SELECT id, zone_type AS kind, status, coalesce(registry_number, '') AS registry_number, '' AS regime, CASE WHEN id % 2 = 0 THEN 'doc ' || id ELSE '' END AS document_basis,
 source_name, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(id * 3600), '%Y-%m-%dT%H:%M:%S') AS data_date FROM v_zones""")
def s10(spark, d):
    z = V(spark, d).zones().withColumns({
        "regime": F.lit(None).cast("string"), "document_basis": F.when(F.col("id") % 2 == 0, F.concat(F.lit("doc "), F.col("id").cast("string"))),
        "data_timestamp": F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600),
    })
    return tables.write_and_read(tables.zone_export(z), "zone-export", fmt="csv", header="true", nullValue="\\N")


@query("s11_parcel_upsert", """WITH t AS (SELECT p_partkey % 50 AS job_id, '59:' || CAST(p_partkey AS VARCHAR) AS number, p_name AS address, 1 AS touched FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT p_partkey % 50 AS job_id, '59:' || CAST(p_partkey AS VARCHAR) AS number, 'new ' || p_name AS address FROM part WHERE p_partkey % 3 = 0)
SELECT CAST(coalesce(t.job_id, b.job_id) AS BIGINT) AS job_id, coalesce(t.number, b.number) AS number, coalesce(t.address, b.address) AS address, CAST(CASE WHEN b.number IS NULL THEN 1 ELSE 2 END AS INT) AS updated_at,
 '{"type":"Feature","number":"' || coalesce(t.number, b.number) || '"}' AS feature FROM t FULL JOIN b ON t.job_id = b.job_id AND t.number = b.number""")
def s11(spark, d):
    p = V(spark, d).table("part").select(
        F.col("p_partkey").alias("k"), (F.col("p_partkey") % 50).alias("job_id"), F.concat(F.lit("59:"), F.col("p_partkey").cast("string")).alias("number"), F.col("p_name").alias("address")
    )
    old = p.where("k % 2 = 0").withColumn("updated_at", F.lit(1))
    batch = p.where("k % 3 = 0").withColumns({"address": F.concat(F.lit("new "), F.col("address")), "updated_at": F.lit(2)})
    u = tables.upsert_touch(old, batch, ["job_id", "number"], "updated_at", "k")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("number").alias("number")))
    return u.select("job_id", "number", "address", "updated_at", feature.alias("feature"))


REGISTRY = """reg AS (SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS model_id, event_type AS layer, user_id AS osm_id, arg_max('gid-' || CAST(event_id AS VARCHAR), event_id) AS global_id, max(event_id) AS seq
 FROM events GROUP BY ALL)"""


def _registry(v: V):
    e = v.table("events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model_id"), F.col("event_type").alias("layer"), F.col("user_id").alias("osm_id"),
        F.col("event_id").alias("seq"), F.concat(F.lit("gid-"), F.col("event_id").cast("string")).alias("global_id"),
    )
    return tables.upsert_last(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"), ["model_id", "layer", "osm_id"], "seq")


@query("s12_id_registry_upsert", f"WITH {REGISTRY} SELECT model_id, layer, osm_id, global_id FROM reg")
def s12(spark, d):
    return _registry(V(spark, d)).select("model_id", "layer", "osm_id", "global_id")


@query("s13_id_registry_lookup", f"""WITH {REGISTRY}, q AS (SELECT event_id, user_id + event_id % 2 * 100 AS osm_id, event_type AS layer, 'gid-' || CAST(event_id AS VARCHAR) AS gid FROM events)
SELECT q.event_id, a.global_id, b.osm_id AS found_osm_id FROM q LEFT JOIN reg a ON a.model_id = 'm1' AND a.layer = q.layer AND a.osm_id = q.osm_id LEFT JOIN reg b ON b.global_id = q.gid""")
def s13(spark, d):
    v = V(spark, d)
    reg = _registry(v)
    q = v.table("events").select(
        "event_id", F.lit("m1").alias("model_id"), F.col("event_type").alias("layer"), (F.col("user_id") + F.col("event_id") % 2 * 100).alias("osm_id"),
        F.concat(F.lit("gid-"), F.col("event_id").cast("string")).alias("gid"),
    )
    by_key = q.join(reg.select("model_id", "layer", "osm_id", "global_id"), ["model_id", "layer", "osm_id"], "left")
    by_gid = reg.select(F.col("global_id").alias("gid"), F.col("osm_id").alias("found_osm_id"))
    return by_key.join(by_gid, "gid", "left").select("event_id", "global_id", "found_osm_id")


TILE_SQL = """t AS (SELECT DISTINCT CAST(floor(x / 250) AS BIGINT) AS tx, CAST(floor(y / 250) AS BIGINT) AS ty, layer FROM v_features),
cache AS (SELECT CAST(floor(x / 250) AS BIGINT) AS tx, CAST(floor(y / 250) AS BIGINT) AS ty, layer, max(osm_id) AS seq FROM v_features WHERE osm_id % 3 > 0 GROUP BY ALL)"""


def _tile_requests(v: V):
    f = v.features().withColumns({"tx": tilemath.tile_of(F.col("x")), "ty": tilemath.tile_of(F.col("y"))})
    key = tilemath.tile_key(F.lit(2), F.col("tx"), F.col("ty"), F.col("layer"), F.lit("v2"), F.lit("g1"))
    f = f.withColumn("tile_key", key)
    wanted = f.groupBy("tx", "ty", "layer", "tile_key").agg(F.lit(1).alias("_1")).drop("_1")
    old_key = tilemath.tile_key(F.lit(2), F.col("tx"), F.col("ty"), F.col("layer"), F.lit("v1"), F.lit("g1"))
    cached = tables.upsert_last(None, f.where("osm_id % 3 > 0").select("tile_key", F.col("osm_id").alias("seq"), "tx"), ["tile_key"], "seq")
    stale = f.select(old_key.alias("tile_key"), F.col("osm_id").alias("seq"), "tx")  # an older data version never hits
    return wanted, tables.upsert_last(cached, stale, ["tile_key"], "seq")


@query("s14_tile_cache_work_list", f"WITH {TILE_SQL} SELECT t.tx, t.ty, t.layer FROM t LEFT JOIN cache c ON c.tx = t.tx AND c.ty = t.ty AND c.layer = t.layer WHERE c.seq IS NULL")
def s14(spark, d):
    wanted, cache = _tile_requests(V(spark, d))
    return tables.missing_keys(wanted, cache, ["tile_key"]).select("tx", "ty", "layer")


@query("s15_package_manifest", """WITH f AS (SELECT user_id AS job_id, event_id, event_type AS layer, CAST(floor(value * 1000) AS BIGINT) AS size_bytes FROM events),
s AS (SELECT event_type AS source_name, max(ts) AS ts FROM events GROUP BY 1)
SELECT job_id, 'file' AS part, CAST(event_id AS VARCHAR) || '.bin' AS name, layer AS detail, size_bytes AS n FROM f
UNION ALL SELECT job_id, 'layer', layer, 'расчётно', count(*) FROM f GROUP BY job_id, layer
UNION ALL SELECT j.job_id, 'source', s.source_name, strftime(s.ts, '%Y-%m-%d'), CAST(1 AS BIGINT) FROM (SELECT DISTINCT job_id, layer FROM f) j JOIN s ON s.source_name = j.layer
UNION ALL SELECT job_id, 'total', 'size_bytes', CAST(count(*) AS VARCHAR), sum(size_bytes)::BIGINT FROM f GROUP BY job_id""")
def s15(spark, d):
    """Manifest rows per job; a file's layer is its source here."""
    v = V(spark, d)
    f = v.table("events").select(
        F.col("user_id").alias("job_id"), F.concat(F.col("event_id").cast("string"), F.lit(".bin")).alias("name"), F.col("event_type").alias("layer"),
        F.col("event_type").alias("source_name"), F.floor(F.col("value") * 1000).cast("bigint").alias("size_bytes"),
    )
    return exports.manifest(f, v.imports().groupBy("source_name").agg(F.max("data_timestamp").alias("ts")))


@query("s17_alignment_export", """SELECT osm_id, CAST(0 AS INT) AS seq, round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 3) AS axis_length, x0, y0, x1, y1
 FROM v_lines WHERE layer IN ('osm_roads', 'osm_railways') AND (x1 <> x0 OR y1 <> y0)""")
def s17(spark, d):
    l = V(spark, d).lines().where(F.col("layer").isin("osm_roads", "osm_railways")).select("osm_id", "path")
    return lines.alignment_segments(l, "osm_id").withColumn("axis_length", F.round("axis_length", 3))


FACES = """q AS (SELECT a.r, a.c, a.z AS z0, b.z AS z1, e.z AS z2, f.z AS z3 FROM v_cells a JOIN v_cells b ON b.r = a.r AND b.c = a.c + 1
 JOIN v_cells e ON e.r = a.r + 1 AND e.c = a.c JOIN v_cells f ON f.r = a.r + 1 AND f.c = a.c + 1 WHERE a.z + b.z + e.z + f.z IS NOT NULL)"""


@query("s18_surface_export", f"""WITH {FACES}, v AS (SELECT r, c, z, row_number() OVER (ORDER BY r, c) AS id FROM v_cells WHERE z IS NOT NULL),
t AS (SELECT r, c, 0 AS half, r AS r0, c AS c0, r + 1 AS r1, c AS c1, r AS r2, c + 1 AS c2 FROM q UNION ALL SELECT r, c, 1, r, c + 1, r + 1, c, r + 1, c + 1 FROM q)
SELECT 'P' AS part, id AS a, round((-1500 + (c + 0.5) * 25.0)::DOUBLE, 3) AS x, round(z, 3) AS z, CAST(NULL AS BIGINT) AS b, CAST(NULL AS BIGINT) AS d FROM v
UNION ALL SELECT 'F', v0.id, NULL, NULL, v1.id, v2.id FROM t JOIN v v0 ON v0.r = r0 AND v0.c = c0 JOIN v v1 ON v1.r = r1 AND v1.c = c1 JOIN v v2 ON v2.r = r2 AND v2.c = c2""")
def s18(spark, d):
    """1-based vertex numbers over the whole surface, numbered row by row, then faces by number."""
    points, faces = exports.numbered_surface(V(spark, d).cells())
    none, null = F.lit(None).cast("bigint"), F.lit(None).cast("double")
    pts = points.select(F.lit("P").alias("part"), F.col("id").alias("a"), F.round(-1500 + (F.col("c") + 0.5) * 25.0, 3).alias("x"), F.round("z", 3).alias("z"), none.alias("b"), none.alias("d"))
    return pts.unionByName(faces.select(F.lit("F").alias("part"), "a", null.alias("x"), null.alias("z"), "b", "d"))


@query("s19_outline_export", """WITH o AS (SELECT 'Здания' AS drawing_layer, osm_id, cx - hx AS minx, cy - hy AS miny, cx + hx AS maxx, cy + hy AS maxy FROM v_buildings UNION ALL SELECT 'Вода', id, minx, miny, maxx, maxy FROM v_zones),
g AS (SELECT *, 0 AS ring_no, 0.0 AS cut FROM o UNION ALL SELECT *, 1, 1.0 FROM o WHERE osm_id % 3 = 0 UNION ALL SELECT *, 2, 1.5 FROM o WHERE osm_id % 6 = 0),
k AS (SELECT * FROM (VALUES (0), (1), (2), (3)) t(pos))
SELECT drawing_layer, osm_id, CAST(ring_no AS INT) AS ring_no, CAST(pos AS INT) AS pos, CAST(CASE WHEN pos IN (1, 2) THEN maxx - cut ELSE minx + cut END AS DOUBLE) AS x, CAST(CASE WHEN pos >= 2 THEN maxy - cut ELSE miny + cut END AS DOUBLE) AS y FROM g, k""")
def s19(spark, d):
    """Every third outline has an inner ring, every sixth two."""
    v = V(spark, d)
    b = v.buildings().select(F.lit("Здания").alias("drawing_layer"), "osm_id", "ring")
    o = b.unionByName(v.zones().select(F.lit("Вода").alias("drawing_layer"), F.col("id").alias("osm_id"), "ring"))
    low, high = F.col("ring")[0], F.col("ring")[2]
    inner = lambda cut: geom.rect_ring(low.x + cut, low.y + cut, high.x - cut, high.y - cut)
    rings = F.when(F.col("osm_id") % 6 == 0, F.array("ring", inner(1.0), inner(1.5))).when(F.col("osm_id") % 3 == 0, F.array("ring", inner(1.0))).otherwise(F.array("ring"))
    return exports.outline_rows(o.select("drawing_layer", "osm_id", rings.alias("rings")), ["drawing_layer", "osm_id"])


@query("s20_city_objects", """SELECT CAST(osm_id AS BIGINT) AS osm_id, 'building-' || osm_id AS object_id, building_type, CAST(coalesce(TRY_CAST(height_tag AS DOUBLE), 9) AS DOUBLE) AS height_m, cx - hx AS minx, cy - hy AS miny, cx + hx AS maxx, cy + hy AS maxy FROM v_buildings
UNION ALL SELECT NULL, 'extent', NULL, max(coalesce(TRY_CAST(height_tag AS DOUBLE), 9)), min(cx - hx), min(cy - hy), max(cx + hx), max(cy + hy) FROM v_buildings""")
def s20(spark, d):
    """One object per building written as JSON lines and read back, plus the extent of the whole set."""
    b = V(spark, d).buildings()
    h = F.coalesce(F.col("height_tag").try_cast("double"), F.lit(9.0))
    obj = geom.with_bbox(b, "ring").select(
        "osm_id", F.concat(F.lit("building-"), F.col("osm_id").cast("string")).alias("object_id"), "building_type", h.alias("height_m"), "minx", "miny", "maxx", "maxy"
    )
    back = tables.write_and_read(obj, "city-objects", fmt="json")
    return exports.with_extent(back, "object_id", ["height_m"])


SITE_TILES = """tl AS (SELECT site_id, sx AS cx, sy AS cy, radius_m, tx, ty FROM v_sites, (SELECT CAST(i AS BIGINT) AS tx FROM range(-30, 30) t(i)), (SELECT CAST(i AS BIGINT) AS ty FROM range(-30, 30) t(i))
 WHERE (sx - least(greatest(sx, tx * 250), tx * 250 + 250)) ** 2 + (sy - least(greatest(sy, ty * 250), ty * 250 + 250)) ** 2 <= radius_m * radius_m AND tx >= floor((sx - radius_m) / 250) AND ty >= floor((sy - radius_m) / 250)),
ld AS (SELECT *, sqrt((tx * 250 + 125 - cx) ** 2 + (ty * 250 + 125 - cy) ** 2) AS dist FROM tl),
lod AS (SELECT *, CASE WHEN dist <= 500 THEN 'LOD2' WHEN dist <= 1500 THEN 'LOD1' ELSE 'LOD0' END AS lod FROM ld WHERE dist <= 3000)"""


def site_tiles(v: V):
    s = v.sites().select("site_id", F.col("sx").alias("cx"), F.col("sy").alias("cy"), "radius_m")
    return tiles.with_lod(tiles.covering_circle(s))


@query("s21_tileset_index", f"""WITH {SITE_TILES}, z AS (SELECT l.*, b.z_min, b.z_max FROM lod l JOIN (SELECT CAST(floor(cx / 250) AS BIGINT) AS tx, CAST(floor(cy / 250) AS BIGINT) AS ty, min(hx) AS z_min, max(hx + hy) AS z_max FROM v_buildings GROUP BY ALL) b ON b.tx = l.tx AND b.ty = l.ty)
SELECT site_id, tx, ty, lod, CAST(CASE lod WHEN 'LOD2' THEN 1 WHEN 'LOD1' THEN 5 ELSE 15 END AS DOUBLE) AS geometric_error, tx * 250 + 125 - cx AS bx, ty * 250 + 125 - cy AS by, (z_min + z_max) / 2 AS bz, 125::DOUBLE AS hx, 125::DOUBLE AS hy, greatest((z_max - z_min) / 2, 0.5) AS hz FROM z
UNION ALL SELECT site_id, NULL, NULL, 'root', CAST(CASE WHEN count(*) > 0 THEN 15 ELSE 0 END AS DOUBLE), (min(tx * 250 - cx) + max(tx * 250 + 250 - cx)) / 2, (min(ty * 250 - cy) + max(ty * 250 + 250 - cy)) / 2, (min(z_min) + max(z_max)) / 2, (max(tx * 250 + 250 - cx) - min(tx * 250 - cx)) / 2, (max(ty * 250 + 250 - cy) - min(ty * 250 - cy)) / 2, greatest((max(z_max) - min(z_min)) / 2, 0.5) FROM z GROUP BY site_id""")
def s21(spark, d):
    v = V(spark, d)
    b = v.buildings().groupBy(tilemath.tile_of(F.col("cx")).alias("tx"), tilemath.tile_of(F.col("cy")).alias("ty")).agg(F.min("hx").alias("z_min"), F.max(F.col("hx") + F.col("hy")).alias("z_max"))
    return tiles.index_rows(site_tiles(v).join(b, ["tx", "ty"]), ["site_id"])


@query("s22_exchange_export", """WITH w AS (SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 3 = 0), i AS (SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_linenumber = 2)
SELECT w.key, CASE WHEN i.key IS NULL THEN 'missing' ELSE 'exported' END AS part FROM w LEFT JOIN i ON i.key = w.key""")
def s22(spark, d):
    v = V(spark, d)
    wanted = v.table("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("key"))
    have = v.table("lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").alias("key"))
    return tables.exchange_parts(wanted, have, "key")


# --- filters ----------------------------------------------------------------------------------

HAV = "2 * 6371008.8::DOUBLE * asin(sqrt(pow(sin(radians({lat} - clat) / 2), 2) + cos(radians(clat)) * cos(radians({lat})) * pow(sin(radians({lon} - clon) / 2), 2)))"
GEO = """s AS (SELECT site_id, radius_m, 56.25 + sx * 0.0000169::DOUBLE AS clon, 58.0 + sy * 0.000009::DOUBLE AS clat FROM v_sites),
g AS (SELECT osm_id, layer, 56.25 + x * 0.0000169::DOUBLE AS lon, 58.0 + y * 0.000009::DOUBLE AS lat FROM v_features)"""


def geo_features(v: V):
    lon, lat = lonlat(F.col("x"), F.col("y"))
    return v.features().withColumns({"lon": lon, "lat": lat})


@query("f01_radius_selection", f"WITH {GEO}, d AS (SELECT site_id, osm_id, layer, radius_m, {HAV.format(lat='lat', lon='lon')} AS m FROM s, g) SELECT site_id, osm_id, layer, round(m, 3) AS distance_m FROM d WHERE m <= radius_m + 50")
def f01(spark, d):
    v = V(spark, d)
    sites = v.sites().select("site_id", "center_lon", "center_lat", "radius_m")
    hit = selection.points_in_radius(geo_features(v).select("osm_id", "layer", "lon", "lat"), sites, "osm_id")
    return hit.select("site_id", "osm_id", "layer", F.round("distance_m", 3).alias("distance_m"))


@query("f02_raw_road_selection", """WITH s AS (SELECT site_id, sx, sy, radius_m, 56.25 + sx * 0.0000169::DOUBLE AS clon, 58.0 + sy * 0.000009::DOUBLE AS clat FROM v_sites),
l AS (SELECT osm_id, 56.25 + x0 * 0.0000169::DOUBLE AS lon0, 58.0 + y0 * 0.000009::DOUBLE AS lat0, 56.25 + x1 * 0.0000169::DOUBLE AS lon1, 58.0 + y1 * 0.000009::DOUBLE AS lat1 FROM v_lines WHERE layer = 'osm_roads'),
m AS (SELECT site_id, osm_id, radius_m, (lon0 - clon) * k AS ax, (lat0 - clat) * dm AS ay, (lon1 - clon) * k AS bx, (lat1 - clat) * dm AS b_y
 FROM (SELECT *, 6371008.8::DOUBLE * pi() / 180 AS dm, cos(radians(clat)) * (6371008.8::DOUBLE * pi() / 180) AS k FROM s, l)),
t AS (SELECT *, (bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay) AS l2 FROM m),
u AS (SELECT *, CASE WHEN l2 > 0 THEN greatest(0, least(1, (-ax * (bx - ax) - ay * (b_y - ay)) / l2)) ELSE 0 END AS p FROM t),
w AS (SELECT *, sqrt(pow(ax + p * (bx - ax), 2) + pow(ay + p * (b_y - ay), 2)) AS dist FROM u)
SELECT site_id, osm_id, round(dist, 3) AS distance_m, osm_id * 10 AS first_node, CAST(2 AS INT) AS n_nodes FROM w WHERE dist <= radius_m + 50""")
def f02(spark, d):
    v = V(spark, d)
    lon0, lat0 = lonlat(F.col("x0"), F.col("y0"))
    lon1, lat1 = lonlat(F.col("x1"), F.col("y1"))
    roads = v.lines().where("layer = 'osm_roads'").select(
        "osm_id", F.array(geom.point(lon0, lat0), geom.point(lon1, lat1)).alias("path"), F.lit("line").alias("geometry"),
        F.array(F.col("osm_id") * 10, F.col("osm_id") * 10 + 1).alias("nodes"),
    )
    sites = v.sites().select("site_id", "center_lon", "center_lat", "radius_m")
    hit = selection.shapes_in_radius(roads, sites, "osm_id")
    return hit.select("site_id", "osm_id", F.round("distance_m", 3).alias("distance_m"), F.get("nodes", F.lit(0)).alias("first_node"), F.size("nodes").alias("n_nodes"))


def versioned(v: V):
    return zones.versions(v.zones())


@query("f03_zones_in_box", "SELECT id, zone_type, status FROM v_current WHERE minx <= 800 AND maxx >= -900 AND miny <= 700 AND maxy >= -600")
def f03(spark, d):
    return zones.find_in_box(versioned(V(spark, d)), -900.0, -600.0, 800.0, 700.0, ring="ring").select("id", "zone_type", "status")


@query("f04_coverage_lookup", "SELECT id, source_name, priority FROM v_zones WHERE minx <= 400 AND maxx >= -400 AND miny <= 400 AND maxy >= -400")
def f04(spark, d):
    return zones.coverage_in_box(V(spark, d).zones(), -400.0, -400.0, 400.0, 400.0).select("id", "source_name", "priority")


@query("f05_zone_search", "SELECT id, zone_type, status, registry_number FROM v_current WHERE status = 'официально' AND registry_number ILIKE '%-1%'")
def f05(spark, d):
    z = zones.search(versioned(V(spark, d)), status=rules.OFFICIAL_ZONE, number_contains="-1")
    return z.select("id", "zone_type", "status", "registry_number")


@query("f06_boundary_filter", "SELECT osm_id FROM v_features WHERE osm_id % 13 > 0 AND x BETWEEN -1200 AND 1500 AND y BETWEEN -800 AND 900")
def f06(spark, d):
    f = V(spark, d).features().withColumns({"x": F.when(F.col("osm_id") % 13 > 0, F.col("x"))})
    return audit.within_boundary(f, geom.rect_ring(-1200, -800, 1500, 900)).select("osm_id")


@query("f07_element_classes", f"""WITH {ELEMENT_SQL} SELECT id, k IN (1, 15) AS building, k IN (3, 14) AS highway, k = 14 AS driveway, k = 11 AS power_pole, k = 8 AS tree FROM e""")
def f07(spark, d):
    t = F.col("tags")
    return elements(V(spark, d)).select(
        "id", tg.is_building(t).alias("building"), tg.is_highway(t).alias("highway"), tg.is_courtyard_driveway(t).alias("driveway"),
        tg.is_power_pole(t).alias("power_pole"), tg.is_tree(t).alias("tree"),
    )


@query("f08_bridges", "SELECT osm_id, layer FROM v_lines WHERE bridge_tag = 'yes'")
def f08(spark, d):
    return V(spark, d).lines().where(tg.is_set(F.col("bridge_tag"))).select("osm_id", "layer")


@query("f09_electrified", "SELECT osm_id FROM v_lines WHERE layer = 'osm_railways' AND osm_id % 5 IN (0, 1)")
def f09(spark, d):
    k = F.col("osm_id") % 5
    l = V(spark, d).lines().where("layer = 'osm_railways'")
    return l.where(tg.is_set(V._pick(k, ["contact_line", " Rail", "NO ", "  "], None))).select("osm_id")


@query("f10_unpaved", "SELECT osm_id FROM v_features WHERE surface_tag = 'gravel'")
def f10(spark, d):
    return V(spark, d).features().where(tg.is_unpaved(F.concat(F.lit(" "), F.upper("surface_tag")))).select("osm_id")


@query("f11_need_calculation", """WITH q AS (SELECT site_id, t.zone_type, sx - radius_m / 4 AS a, sy - radius_m / 4 AS b, sx + radius_m / 4 AS c, sy + radius_m / 4 AS e FROM v_sites, (SELECT DISTINCT zone_type FROM v_zones) t)
SELECT site_id, zone_type, NOT EXISTS (SELECT 1 FROM v_current z WHERE z.zone_type = q.zone_type AND z.status = 'официально' AND z.minx <= q.c AND z.maxx >= q.a AND z.miny <= q.e AND z.maxy >= q.b) AS needs_calculation FROM q""")
def f11(spark, d):
    v = V(spark, d)
    quarter = F.col("radius_m") / 4
    types = F.explode(F.array(*map(F.lit, ["red line", "water protection", "power corridor", "heritage"])))
    req = v.sites().select(
        "site_id", types.alias("zone_type"), (F.col("sx") - quarter).alias("sminx"), (F.col("sy") - quarter).alias("sminy"),
        (F.col("sx") + quarter).alias("smaxx"), (F.col("sy") + quarter).alias("smaxy"),
    )
    return zones.needing_calculation(req, versioned(v)).select("site_id", "zone_type", "needs_calculation")


@query("f12_degenerate_faces", """WITH f AS (SELECT osm_id AS face_id, osm_id AS a, osm_id + 1 AS b, osm_id + 2 AS c FROM v_features),
t AS (SELECT face_id, abs((p1.x - p0.x) * (p2.y - p0.y) - (p2.x - p0.x) * (p1.y - p0.y)) / 2 AS area_m2 FROM f JOIN v_features p0 ON p0.osm_id = f.a JOIN v_features p1 ON p1.osm_id = f.b JOIN v_features p2 ON p2.osm_id = f.c)
SELECT face_id, area_m2 FROM t WHERE area_m2 <= 20000""")
def f12(spark, d):
    f = V(spark, d).features()
    k = F.col("osm_id")
    n = f.agg((F.max("osm_id") - 2).alias("_m")).withColumn("_k", F.lit(1))
    face = f.select(k.alias("face_id"), k.alias("v0"), (k + 1).alias("v1"), (k + 2).alias("v2"), F.lit(1).alias("_k"))
    face = face.join(F.broadcast(n), "_k").where(F.col("face_id") <= F.col("_m")).drop("_k", "_m")
    return relief.degenerate_faces(face, f.select(k.alias("v"), "x", "y"), eps_m2=20000.0)


@query("f13_parcel_search", """WITH q AS (SELECT site_id, 56.25 + sx * 0.0000169::DOUBLE AS lon, 58.0 + sy * 0.000009::DOUBLE AS lat FROM v_sites),
p AS (SELECT osm_id AS id, 56.25 + cx * 0.0000169::DOUBLE AS lon, 58.0 + cy * 0.000009::DOUBLE AS lat, coalesce(CASE WHEN osm_id % 4 = 0 THEN 'A' || osm_id END, CASE WHEN osm_id % 3 = 0 THEN 'B' || osm_id END) AS number FROM v_buildings),
h AS (SELECT q.site_id, p.id, p.number FROM q JOIN p ON abs(p.lon - q.lon) <= 0.01 AND abs(p.lat - q.lat) <= 0.01 WHERE p.number IS NOT NULL)
SELECT site_id, id, number FROM h""")
def f13(spark, d):
    """Box around each point, all rows with a number."""
    v = V(spark, d)
    lon, lat = lonlat(F.col("cx"), F.col("cy"))
    k = F.col("osm_id")
    p = v.buildings().select(
        k.alias("id"), lon.alias("lon"), lat.alias("lat"),
        F.coalesce(F.when(k % 4 == 0, F.concat(F.lit("A"), k.cast("string"))), F.when(k % 3 == 0, F.concat(F.lit("B"), k.cast("string")))).alias("number"),
    )
    return selection.parcels_near(p, v.sites().select("site_id", "center_lon", "center_lat")).select("site_id", "id", "number")


# --- windows, listings, sets ------------------------------------------------------------------


@query("w01_latest_per_source", """SELECT source_name, id, epoch_us(data_timestamp) AS newest_us, notes FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY data_timestamp DESC, id DESC) AS rn FROM v_imports) WHERE rn = 1""")
def w01(spark, d):
    best = exports.latest_per(V(spark, d).imports(), ["source_name"], ["data_timestamp", "id"], ["id", "data_timestamp", "notes"])
    return best.select("source_name", "id", F.unix_micros(F.col("data_timestamp").cast("timestamp")).alias("newest_us"), "notes")


@query("w02_zone_versions", """SELECT id, registry_number, CASE WHEN registry_number IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY registry_number ORDER BY load_seq) END::BIGINT AS version,
 CASE WHEN registry_number IS NOT NULL THEN lead(load_seq) OVER (PARTITION BY registry_number ORDER BY load_seq) END AS superseded_by FROM v_zones""")
def w02(spark, d):
    return versioned(V(spark, d)).select("id", "registry_number", "version", "superseded_by")


@query("w07_first_source_by_priority", """SELECT source_name, id FROM (SELECT source_name, id, row_number() OVER (PARTITION BY source_name ORDER BY priority DESC, id) AS rn FROM v_zones) WHERE rn = 1""")
def w07(spark, d):
    return exports.first_per(V(spark, d).zones(), ["source_name"], [-F.col("priority"), F.col("id")], ["id"])


@query("w08_zone_history", """WITH h AS (SELECT id, registry_number, zone_type, row_number() OVER w AS version, lag(zone_type) OVER w AS prev FROM v_zones WHERE registry_number IS NOT NULL WINDOW w AS (PARTITION BY registry_number ORDER BY load_seq))
SELECT registry_number, version::BIGINT AS version, id, prev IS NOT NULL AND prev <> zone_type AS changed FROM h""")
def w08(spark, d):
    h = zones.history(versioned(V(spark, d)))
    return h.select("registry_number", "version", "id", "changed").orderBy("registry_number", F.col("version").desc())


@query("w09_next_step", """SELECT job_id, CASE WHEN min(CASE WHEN status = 'failed' THEN step_order END) IS NULL THEN min(CASE WHEN status <> 'done' THEN step_order END) END AS next_order,
 min(CASE WHEN status = 'failed' THEN step_order END) AS retry_order FROM v_steps GROUP BY job_id""")
def w09(spark, d):
    return jobs.next_step(V(spark, d).steps())


@query("l01_priority_order", "SELECT id, source_name, priority, row_number() OVER (ORDER BY priority, id) AS pos FROM v_zones")
def l01(spark, d):
    z = exports.priority_order(V(spark, d).zones(), "priority", "id")
    return z.select("id", "source_name", "priority", "pos").orderBy("priority", "id")


@query("l02_job_listing", """WITH j AS (SELECT job_id, min(started_at) AS created_at FROM v_steps GROUP BY job_id) SELECT s.job_id, epoch_us(created_at) AS created_us, step_order, status FROM v_steps s JOIN j ON j.job_id = s.job_id""")
def l02(spark, d):
    s = V(spark, d).steps()
    j = s.groupBy("job_id").agg(F.min("started_at").alias("created_at"))
    out = jobs.listing(j, s.select("job_id", "step_order", "status"))
    return out.select("job_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_us"), "step_order", "status")


@query("l03_largest_part", """WITH p AS (SELECT o_orderkey % 500 AS shape_id, o_orderkey AS pos, CAST(1 + (o_orderkey * 37) % 97 AS DOUBLE) AS w, CAST(1 + (o_orderkey * 53) % 89 AS DOUBLE) AS h FROM orders)
SELECT shape_id, pos, w * h AS area_m2 FROM (SELECT *, row_number() OVER (PARTITION BY shape_id ORDER BY w * h DESC, pos) AS rn FROM p) WHERE rn = 1""")
def l03(spark, d):
    k = F.col("o_orderkey")
    p = V(spark, d).table("orders").select(
        (k % 500).alias("shape_id"), k.alias("pos"), geom.rect_ring(F.lit(0.0), F.lit(0.0), 1 + (k * 37) % 97, 1 + (k * 53) % 89).alias("ring")
    )
    return exports.largest_part(p, ["shape_id"], "pos")


@query("l04_latest_import", "SELECT id, source_name, epoch_us(data_timestamp) AS newest_us FROM v_imports WHERE source_name = 'view' ORDER BY data_timestamp DESC, id DESC LIMIT 1")
def l04(spark, d):
    top = V(spark, d).imports().where("source_name = 'view'").orderBy(F.col("data_timestamp").desc(), F.col("id").desc()).limit(1)
    return top.select("id", "source_name", F.unix_micros(F.col("data_timestamp").cast("timestamp")).alias("newest_us"))


@query("u03_missing_tiles", f"WITH {TILE_SQL} SELECT tx, ty, layer FROM t EXCEPT SELECT tx, ty, layer FROM cache")
def u03(spark, d):
    f = V(spark, d).features().withColumns({"tx": tilemath.tile_of(F.col("x")), "ty": tilemath.tile_of(F.col("y"))})
    return f.select("tx", "ty", "layer").distinct().exceptAll(f.where("osm_id % 3 > 0").select("tx", "ty", "layer").distinct())


@query("u04_known_labels", "SELECT DISTINCT lower(p_type) AS label FROM part INTERSECT SELECT DISTINCT CASE WHEN event_type = 'view' THEN 'economy' WHEN event_type = 'click' THEN 'small' ELSE event_type END FROM events")
def u04(spark, d):
    v = V(spark, d)
    e = F.col("event_type")
    known = v.table("part").select(F.lower("p_type").alias("label"))
    return known.intersect(v.table("events").select(F.when(e == "view", "economy").when(e == "click", "small").otherwise(e).alias("label")))


# --- jobs and audit ---------------------------------------------------------------------------


@query("a01_counts_in_radius", f"""WITH {GEO}, d AS (SELECT site_id, layer, osm_id, radius_m, {HAV.format(lat='lat', lon='lon')} AS m FROM s, g),
n AS (SELECT site_id, layer, count(*) AS n FROM d WHERE m <= radius_m + 50 GROUP BY site_id, layer)
SELECT v_sites.site_id, l.layer, coalesce(n.n, 0)::BIGINT AS n FROM v_sites, (SELECT unnest({list(rules.LAYERS)}) AS layer) l LEFT JOIN n ON n.layer = l.layer AND n.site_id = v_sites.site_id""")
def a01(spark, d):
    v = V(spark, d)
    sites = v.sites().select("site_id", "center_lon", "center_lat", "radius_m")
    hit = selection.points_in_radius(geo_features(v).select("osm_id", "layer", "lon", "lat"), sites, "osm_id")
    counts = hit.groupBy("site_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    return audit.zero_filled(counts, rules.LAYERS, groups=sites.select("site_id"))


REPORT = f"""{ELEMENT_SQL}, rep AS (SELECT 'buildings_with_levels' AS label, count(*) FILTER (k IN (1, 15)) AS total, count(*) FILTER (k = 1) AS complete FROM e
UNION ALL SELECT 'roads_with_surface', count(*) FILTER (k IN (3, 14)), count(*) FILTER (k = 3) FROM e UNION ALL SELECT 'roads_with_lanes', count(*) FILTER (k IN (3, 14)), count(*) FILTER (k = 3) FROM e
UNION ALL SELECT 'courtyard_driveways', count(*) FILTER (k = 14), count(*) FILTER (k = 14) FROM e UNION ALL SELECT 'power_poles', count(*) FILTER (k = 11), count(*) FILTER (k = 11) FROM e
UNION ALL SELECT 'trees', count(*) FILTER (k = 8), count(*) FILTER (k = 8) FROM e), rr AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE complete / total END AS ratio FROM rep)"""


@query("a02_tag_completeness", f"WITH {REPORT} SELECT label, total, complete, round(ratio::DOUBLE, 6) AS ratio FROM rr")
def a02(spark, d):
    return audit.completeness(elements(V(spark, d))).select("label", "total", "complete", r6("ratio", "ratio"))


@query("a03_decisions", f"""WITH {REPORT} SELECT label, CASE WHEN ratio >= 0.8 THEN 'достаточно' WHEN ratio >= 0.4 THEN 'дополнить вручную' ELSE 'нужен другой источник' END AS decision FROM rr
 WHERE label IN ('buildings_with_levels', 'roads_with_surface', 'roads_with_lanes')""")
def a03(spark, d):
    return audit.decisions(audit.completeness(elements(V(spark, d)))).select("label", "decision")


@query("a04_against_reference", f"""WITH {REPORT}, ref AS (SELECT label, (total * CASE label WHEN 'trees' THEN 0 ELSE 2 END)::BIGINT AS reference FROM rr WHERE label <> 'power_poles' UNION ALL SELECT 'unknown label', 5)
SELECT rr.label, complete AS found, reference, greatest(reference - complete, 0)::BIGINT AS missing, round(CASE WHEN reference = 0 THEN 1 ELSE complete / reference END::DOUBLE, 6) AS coverage FROM rr JOIN ref ON ref.label = rr.label""")
def a04(spark, d):
    rep = audit.completeness(elements(V(spark, d)))
    ref = rep.where("label <> 'power_poles'").select("label", F.when(F.col("label") == "trees", 0).otherwise(F.col("total") * 2).cast("bigint").alias("reference"))
    ref = ref.unionByName(spark.range(1).select(F.lit("unknown label").alias("label"), F.lit(5).cast("bigint").alias("reference")))
    return audit.against_reference(rep, ref).select("label", "found", "reference", F.col("missing").cast("bigint").alias("missing"), r6("coverage", "coverage"))


@query("a05_layer_summary", "SELECT layer, count(*) AS n FROM v_features GROUP BY ROLLUP (layer)")
def a05(spark, d):
    return audit.layer_summary(V(spark, d).features())


@query("a21_unmatched_layers", """SELECT drawing_layer AS name, 'layer' AS part, count(*) AS n FROM v_texts WHERE drawing_layer = 'СТЕНЫ' GROUP BY 1
UNION ALL SELECT txt, 'manhole', count(*) FROM v_texts WHERE seq % 5 = 4 GROUP BY 1""")
def a21(spark, d):
    from sitewright.functions import labels

    t = V(spark, d).texts()
    return exports.unmatched_labels(t, "drawing_layer", labels.network_type(F.col("drawing_layer")).isNotNull(), t.where("seq % 5 = 4"), "txt")


@query("a22_job_status", """SELECT job_id, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'done') THEN 'done' WHEN bool_or(status <> 'pending') THEN 'running' ELSE 'pending' END AS job_status,
 arg_min(error_message, step_order) FILTER (status = 'failed') AS first_error, count(*) AS n_steps FROM v_steps GROUP BY job_id""")
def a22(spark, d):
    return jobs.job_status(V(spark, d).steps())


@query("a23_tiles_by_lod", f"WITH {SITE_TILES} SELECT s.site_id, l AS lod, count(tx) AS n_tiles FROM (SELECT DISTINCT site_id FROM lod) s, (VALUES ('LOD2'), ('LOD1'), ('LOD0')) v(l) LEFT JOIN lod t ON t.lod = l AND t.site_id = s.site_id GROUP BY ALL")
def a23(spark, d):
    return tiles.lod_counts(site_tiles(V(spark, d)), ["site_id"])


@query("g14_job_plan", """WITH j AS (SELECT o_orderkey AS job_id, CAST(400 + (o_orderkey * 17) % 2800 AS DOUBLE) AS radius_m, 50.0 + (o_orderkey * 7) % 12 AS lon FROM orders),
k AS (SELECT *, CASE WHEN radius_m < 500 OR radius_m > 3000 THEN 'radius out of range' WHEN least(abs(lon - 53.55), abs(lon - 56.55), abs(lon - 59.55)) > 2 THEN 'outside supported region' END AS reject_reason FROM j),
s AS (SELECT * FROM (VALUES (0, 'select_osm'), (1, 'fetch_cadastre'), (2, 'prepare_relief'), (3, 'select_and_normalize'), (4, 'assemble_ifc'), (5, 'convert_to_glb'), (6, 'generate_tileset'), (7, 'package_outputs')) t(o, n))
SELECT job_id, reject_reason, CAST(o AS INT) AS step_order, n AS step_name, CASE WHEN o IS NOT NULL THEN 'pending' END AS status FROM k LEFT JOIN s ON k.reject_reason IS NULL""")
def g14(spark, d):
    k = F.col("o_orderkey")
    j = V(spark, d).table("orders").select(k.alias("job_id"), (400 + (k * 17) % 2800).cast("double").alias("radius_m"), (50.0 + (k * 7) % 12).alias("lon"))
    return jobs.expand_jobs(j)
