"""Scalar functions: tags, attributes, norms, labels, tiles, sun, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver.registry import query
from driver.views import V, r6
from sitewright import rules
from sitewright.functions import attributes as at
from sitewright.functions import geom, labels, numbers, sun, tilemath
from sitewright.functions import tags as tg
from sitewright.operators import jobs

I64 = lambda c, n: c.cast("bigint").alias(n)

NUM = "CASE WHEN regexp_full_match(trim({t}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({t}) AS DOUBLE) END"


def num_sql(t: str) -> str:
    return NUM.format(t=t)


def pos_int_sql(t: str) -> str:
    n = f"CAST(trunc({num_sql(t)}) AS BIGINT)"
    return f"CASE WHEN {n} > 0 THEN {n} END"


def pos_float_sql(t: str) -> str:
    return f"CASE WHEN {num_sql(t)} > 0 THEN {num_sql(t)} END"


@query("c01_tolerant_numbers", f"""SELECT osm_id, {pos_int_sql('levels_tag')} AS n_int, {pos_float_sql('levels_tag')} AS n_float,
 nullif(trim(type_tag), '') AS txt FROM v_features""")
def c01(spark, d):
    return V(spark, d).features().select(
        "osm_id", numbers.positive_int(F.col("levels_tag")).alias("n_int"), numbers.positive_float(F.col("levels_tag")).alias("n_float"),
        numbers.non_empty(F.col("type_tag")).alias("txt"),
    )


def _pair(struct, name):
    return [struct["value"].alias(name), struct["confidence"].alias(name + "_confidence")]


@query("c02_normalize_buildings", f"""WITH t AS (SELECT osm_id, layer, nullif(trim(type_tag), '') AS ty, {pos_int_sql('levels_tag')} AS lv
 FROM v_features WHERE layer IN ('osm_buildings', 'osm_entrances'))
SELECT osm_id, coalesce(ty, 'yes') AS type, CASE WHEN ty IS NULL THEN 'умолчание' ELSE 'факт' END AS type_confidence,
 coalesce(lv, 1) AS levels, CASE WHEN lv IS NULL THEN 'умолчание' ELSE 'факт' END AS levels_confidence FROM t""")
def c02(spark, d):
    f = V(spark, d).features().where(F.col("layer").isin("osm_buildings", "osm_entrances"))
    part = F.col("layer") == "osm_entrances"  # the second layer stands for building parts
    tags = F.when(part, F.create_map(F.lit("building:part"), F.col("type_tag"), F.lit("building:levels"), F.col("levels_tag"))).otherwise(
        F.create_map(F.lit("building"), F.col("type_tag"), F.lit("building:levels"), F.col("levels_tag"))
    )
    f = f.withColumn("tags", tags)
    whole, parts = tg.normalize_building(F.col("tags")), tg.normalize_building_part(F.col("tags"))
    pick = lambda k: F.when(part, parts[k]).otherwise(whole[k])
    return f.select("osm_id", *_pair(pick("type"), "type"), *_pair(pick("levels"), "levels"))


@query("c03_normalize_other_layers", f"""WITH t AS (SELECT osm_id, layer, nullif(trim(type_tag), '') AS ty, {pos_int_sql('levels_tag')} AS lv,
 nullif(trim(surface_tag), '') AS sf, CASE WHEN layer = 'osm_power' THEN {pos_float_sql('levels_tag')} * 1234.5678 END AS volt,
 CASE osm_id % 4 WHEN 0 THEN 'Needleleaved' WHEN 1 THEN 'mixed' WHEN 2 THEN 'unknown' END AS leaf FROM v_features)
SELECT osm_id, layer,
 CASE layer WHEN 'osm_entrances' THEN coalesce(ty, 'yes') WHEN 'osm_roads' THEN coalesce(ty, 'unclassified')
  WHEN 'osm_vegetation' THEN coalesce(sf, CASE lower(leaf) WHEN 'needleleaved' THEN 'хвойное' WHEN 'mixed' THEN 'смешанное' WHEN 'broadleaved' THEN 'лиственное' END) END AS main_value,
 CASE WHEN layer IN ('osm_entrances', 'osm_roads') THEN CASE WHEN ty IS NULL THEN 'умолчание' ELSE 'факт' END
  WHEN layer = 'osm_vegetation' THEN CASE WHEN sf IS NULL AND (leaf IS NULL OR leaf = 'unknown') THEN 'умолчание' ELSE 'факт' END END AS main_confidence,
 CASE layer WHEN 'osm_roads' THEN sf END AS surface, CASE layer WHEN 'osm_roads' THEN lv END AS lanes,
 CASE WHEN layer = 'osm_power' THEN round_even(volt / 1000.0, 3) END AS voltage_kv
FROM t WHERE layer IN ('osm_entrances', 'osm_roads', 'osm_vegetation', 'osm_power')""")
def c03(spark, d):
    f = V(spark, d).features().where(F.col("layer").isin("osm_entrances", "osm_roads", "osm_vegetation", "osm_power"))
    k = F.col("osm_id") % 4
    volts = (numbers.positive_float(F.col("levels_tag")) * 1234.5678).cast("string")
    tags = F.create_map(
        F.lit("entrance"), F.col("type_tag"), F.lit("highway"), F.col("type_tag"), F.lit("surface"), F.col("surface_tag"),
        F.lit("lanes"), F.col("levels_tag"), F.lit("voltage"), volts, F.lit("species"), F.col("surface_tag"),
        F.lit("leaf_type"), F.when(k == 0, "Needleleaved").when(k == 1, "mixed").when(k == 2, "unknown"),
    )
    f = f.withColumn("tags", tags).withColumns(tg.normalized_attributes(F.col("layer"), F.col("tags")))
    main = F.coalesce("type", "highway_class", "species")
    return f.select(
        "osm_id", "layer", main["value"].alias("main_value"), main["confidence"].alias("main_confidence"),
        F.col("surface.value").alias("surface"), F.col("lanes.value").alias("lanes"), F.col("voltage_kv.value").alias("voltage_kv"),
    )


@query("c04_building_height", f"""WITH t AS (SELECT b.osm_id, building_type, {pos_float_sql('height_tag')} AS h, {pos_int_sql('levels_tag')} AS lv,
 CASE WHEN s.s_suppkey IS NOT NULL AND s.s_acctbal > 0 THEN s.s_acctbal / 1000.0 END AS ext FROM v_buildings b LEFT JOIN supplier s ON s.s_suppkey * 3 = b.osm_id)
SELECT osm_id, round(coalesce(h, lv * 3.0 + 1.0, ext, CASE building_type WHEN 'house' THEN 8.0 WHEN 'retail' THEN 6.0 WHEN 'commercial' THEN 9.0 ELSE 9.0 END), 6)::DOUBLE AS height_m,
 CASE WHEN coalesce(h, lv * 3.0 + 1.0, ext) IS NULL THEN 'умолчание' ELSE 'факт' END AS confidence,
 CASE WHEN coalesce(h, lv * 3.0 + 1.0) IS NOT NULL THEN 'OSM' WHEN ext IS NOT NULL THEN 'Overture' ELSE 'тип (умолчание)' END AS source FROM t""")
def c04(spark, d):
    v = V(spark, d)
    ext = v.table("supplier").select((F.col("s_suppkey") * 3).alias("osm_id"), (F.col("s_acctbal") / 1000.0).alias("ext_m"))
    b = v.buildings().join(ext, "osm_id", "left")
    lv = tg.noted(numbers.positive_int(F.col("levels_tag")), 1)
    b = b.withColumn("h", at.building_height(F.col("height_tag"), lv["value"], lv["confidence"], F.col("building_type"), F.col("ext_m")))
    return b.select("osm_id", r6("h.height_m", "height_m"), "h.confidence", "h.source")


WIDTH_SQL = "CASE highway WHEN 'primary' THEN 10.0 WHEN 'residential' THEN 6.0 WHEN 'service' THEN 4.0 WHEN 'track' THEN 3.0 ELSE 5.0 END"


@query("c05_road_width", f"""SELECT osm_id, CAST(CASE WHEN osm_id % 7 = 0 THEN 7.5 ELSE {WIDTH_SQL} END AS DOUBLE) AS width_m,
 CASE WHEN osm_id % 7 = 0 THEN 'факт' ELSE 'умолчание' END AS confidence FROM v_lines WHERE layer = 'osm_roads'""")
def c05(spark, d):
    l = V(spark, d).lines().where("layer = 'osm_roads'")
    tag = F.when(F.col("osm_id") % 7 == 0, " 7.5 ").when(F.col("osm_id") % 7 == 1, "-2")
    return l.withColumn("w", at.road_width(tag, F.col("highway"))).select("osm_id", "w.width_m", "w.confidence")


@query("c06_road_network_class", """SELECT osm_id, highway, CASE WHEN highway IN ('primary', 'tertiary_link') THEN 'каркасная' ELSE 'внутриквартальная' END AS network
 FROM v_lines WHERE layer = 'osm_roads'""")
def c06(spark, d):
    return V(spark, d).lines().where("layer = 'osm_roads'").select("osm_id", "highway", at.road_network(F.col("highway")).alias("network"))


@query("c07_ballast_width", """WITH t AS (SELECT osm_id, CASE WHEN osm_id % 3 = 0 THEN 1.067 ELSE 1.52 END::DOUBLE AS g, CASE WHEN osm_id % 5 = 1 THEN 2 ELSE 1 END::BIGINT AS n,
 osm_id % 3 = 0 OR osm_id % 5 = 1 AS fact FROM v_lines WHERE layer = 'osm_railways')
SELECT osm_id, round(g + 2 * 1.24::DOUBLE + (n - 1) * 4.5::DOUBLE, 6) AS width_m, n AS tracks, round(g, 6) AS gauge_m, CASE WHEN fact THEN 'факт' ELSE 'умолчание' END AS confidence FROM t""")
def c07(spark, d):
    k = F.col("osm_id")
    l = V(spark, d).lines().where("layer = 'osm_railways'")
    b = at.ballast(F.when(k % 3 == 0, "1067").when(k % 3 == 1, "bad"), F.when(k % 5 == 1, "2.0").when(k % 5 == 2, "0"))
    return l.withColumn("b", b).select("osm_id", r6("b.width_m", "width_m"), "b.tracks", r6("b.gauge_m", "gauge_m"), "b.confidence")


@query("c08_pole_shape", """WITH t AS (SELECT osm_id, osm_id % 3 = 0 AS tower, CASE osm_id % 5 WHEN 0 THEN 'Concrete' WHEN 1 THEN 'steel' WHEN 2 THEN 'plastic' END AS m,
 CASE WHEN osm_id % 4 = 0 THEN 12.5 END AS h FROM v_features WHERE layer = 'osm_power')
SELECT osm_id, CAST(coalesce(h, CASE WHEN tower THEN 20 ELSE 9 END) AS DOUBLE) AS height_m, CASE WHEN h IS NULL THEN 'умолчание' ELSE 'факт' END AS height_confidence,
 CAST(CASE WHEN tower THEN 1.5 WHEN lower(m) = 'concrete' THEN 0.15 WHEN m = 'steel' THEN 0.10 ELSE 0.12 END AS DOUBLE) AS radius_base_m,
 CAST(CASE WHEN tower THEN 0.3 WHEN lower(m) = 'concrete' THEN 0.15 WHEN m = 'steel' THEN 0.10 ELSE 0.12 END AS DOUBLE) AS radius_top_m,
 CASE WHEN tower THEN coalesce(m, 'steel') ELSE lower(coalesce(m, 'wood')) END AS material FROM t""")
def c08(spark, d):
    k = F.col("osm_id")
    f = V(spark, d).features().where("layer = 'osm_power'")
    s = at.pole_shape(
        F.when(k % 3 == 0, "tower").otherwise("pole"), F.when(k % 4 == 0, "12.5").when(k % 4 == 1, "-1"),
        F.when(k % 5 == 0, "Concrete").when(k % 5 == 1, "steel").when(k % 5 == 2, "plastic"),
    )
    return f.withColumn("s", s).select("osm_id", "s.*")


@query("c09_roof_parameters", """WITH t AS (SELECT osm_id, greatest(hx, hy) * 2 AS len, least(hx, hy) * 2 AS wid, hx >= hy AS ew,
 CASE osm_id % 7 WHEN 0 THEN 'gabled' WHEN 1 THEN 'hipped' WHEN 2 THEN 'skillion' WHEN 3 THEN 'pyramidal' WHEN 4 THEN 'dome' WHEN 5 THEN 'flat' ELSE '' END AS s,
 CASE WHEN osm_id % 3 = 0 THEN 2.5 END AS rh, CASE WHEN osm_id % 4 = 0 THEN 40.0 END AS ang, CASE WHEN osm_id % 5 = 0 THEN 90.0 END AS dir,
 CAST(3 + osm_id % 8 AS DOUBLE) AS bh, osm_id % 2 = 0 AS across FROM v_buildings),
u AS (SELECT *, s IN ('gabled', 'hipped', 'skillion', 'pyramidal') AS pitched,
 coalesce(rh, (CASE WHEN s = 'skillion' THEN wid ELSE wid / 2 END) * tan(radians(coalesce(ang, 30.0)))) AS ph FROM t),
w AS (SELECT *, pitched AND ph < bh AS keep FROM u)
SELECT osm_id, CASE WHEN keep THEN s ELSE 'flat' END AS shape,
 CASE WHEN keep OR (NOT pitched AND s IN ('flat', '')) THEN 'факт' ELSE 'умолчание' END AS shape_confidence,
 round(CAST(CASE WHEN keep THEN ph ELSE 0 END AS DOUBLE), 6) AS height_m,
 CASE WHEN keep AND rh IS NULL AND ang IS NULL THEN 'умолчание' ELSE 'факт' END AS height_confidence,
 CASE WHEN keep AND s = 'gabled' AND dir IS NOT NULL THEN NOT ew WHEN keep AND s = 'gabled' THEN NOT across ELSE TRUE END AS ridge_along,
 CAST(CASE WHEN keep AND s = 'skillion' THEN CASE WHEN dir IS NOT NULL THEN 1 WHEN ew THEN 0 ELSE 1 END END AS DOUBLE) AS dir_x,
 CAST(CASE WHEN keep AND s = 'skillion' THEN CASE WHEN dir IS NOT NULL THEN 0 WHEN ew THEN 1 ELSE 0 END END AS DOUBLE) AS dir_y FROM w""")
def c09(spark, d):
    k = F.col("osm_id")
    b = V(spark, d).buildings()
    shapes = ["gabled", " Hipped ", "skillion", "pyramidal", "dome", "flat"]
    tags = F.create_map(
        F.lit("roof:shape"), V._pick(k % 7, shapes, ""), F.lit("roof:height"), F.when(k % 3 == 0, "2.5"),
        F.lit("roof:angle"), F.when(k % 4 == 0, "40"), F.lit("roof:direction"), F.when(k % 5 == 0, "90"),
        F.lit("roof:orientation"), F.when(k % 2 == 0, "across"),
    )
    from sitewright.functions.kernels import oriented_box_udf

    b = b.withColumn("obb", oriented_box_udf(F.col("ring")))
    b = b.withColumn("r", at.roof(tags, F.col("obb"), (3 + k % 8).cast("double")))
    # an axis has no sign: report the slope direction of untagged skillions by its absolute value
    tagged = k % 5 == 0
    size = lambda c: F.round(F.when(tagged, F.abs(c)).otherwise(F.abs(c)), 6)
    return b.select(
        "osm_id", "r.shape", "r.shape_confidence", r6("r.height_m", "height_m"), "r.height_confidence", "r.ridge_along",
        size(F.col("r.dir_x")).alias("dir_x"), size(F.col("r.dir_y")).alias("dir_y"),
    )


@query("c10_norm_widths", """WITH t AS (SELECT osm_id, CAST((osm_id * 13) % 60 AS DOUBLE) AS v, CAST((osm_id * 7) % 9 - 2 AS DOUBLE) AS slope,
 CASE WHEN osm_id % 11 > 0 THEN CAST((osm_id * 29) % 1300 AS DOUBLE) END AS kv, CAST((osm_id * 31) % 700 AS DOUBLE) AS dia,
 CASE osm_id % 6 WHEN 0 THEN 'В' WHEN 1 THEN 'К' WHEN 2 THEN 'Т' WHEN 3 THEN 'Г' WHEN 4 THEN 'Кл' ELSE 'X' END AS nt FROM v_features)
SELECT osm_id, CAST(CASE WHEN v <= 10 THEN 50 WHEN v <= 20 THEN 100 ELSE 300 END AS DOUBLE) AS cemetery_m,
 CAST(CASE WHEN v <= 10 THEN 50 WHEN v <= 50 THEN 100 ELSE 200 END AS DOUBLE) AS water_m,
 CAST(CASE WHEN osm_id % 10 = 0 OR slope <= 0 THEN 30 WHEN slope < 3 THEN 40 ELSE 50 END AS DOUBLE) AS coastal_m,
 CAST(CASE WHEN kv <= 1 THEN 2 WHEN kv <= 20 THEN 10 WHEN kv <= 35 THEN 15 WHEN kv <= 110 THEN 20 WHEN kv <= 220 THEN 25 WHEN kv <= 500 THEN 30
  WHEN kv <= 750 THEN 40 WHEN kv IS NOT NULL THEN 55 END AS DOUBLE) AS corridor_m,
 CAST(CASE nt WHEN 'В' THEN CASE WHEN dia <= 300 THEN 5 ELSE 10 END WHEN 'К' THEN CASE WHEN dia <= 300 THEN 5 ELSE 10 END WHEN 'Т' THEN 3
  WHEN 'Г' THEN CASE WHEN dia <= 300 THEN 2 ELSE 7 END WHEN 'Кл' THEN 1 END AS DOUBLE) AS network_m,
 CASE WHEN nt = 'X' THEN 'unknown network type' END AS reject_reason FROM t""")
def c10(spark, d):
    k = F.col("osm_id")
    f = V(spark, d).features().select(
        "osm_id", ((k * 13) % 60).cast("double").alias("v"), ((k * 7) % 9 - 2).cast("double").alias("slope"),
        F.when(k % 11 > 0, ((k * 29) % 1300).cast("double")).alias("kv"), ((k * 31) % 700).cast("double").alias("dia"),
        V._pick(k % 6, ["В", "К", "Т", "Г", "Кл"], "X").alias("nt"),
    )
    c = F.col
    net = at.network_zone_m(c("nt"), c("dia"))
    return f.select(
        "osm_id", at.cemetery_zone_m(c("v")).alias("cemetery_m"), at.water_protection_m(c("v")).alias("water_m"),
        at.coastal_strip_m(F.when(k % 10 != 0, c("slope"))).alias("coastal_m"), at.power_corridor_m(c("kv")).alias("corridor_m"),
        net.alias("network_m"), F.when(net.isNull(), "unknown network type").alias("reject_reason"),
    )


@query("c11_fire_break", """WITH t AS (SELECT osm_id, osm_id % 4 AS a, (osm_id * 7 + 1) % 4 AS b FROM v_buildings),
n AS (SELECT osm_id, CASE a WHEN 0 THEN 'I-II' WHEN 1 THEN 'III' WHEN 2 THEN 'IV-V' ELSE 'VI' END AS degree_a,
 CASE b WHEN 0 THEN 'I-II' WHEN 1 THEN 'III' WHEN 2 THEN 'IV-V' ELSE 'VI' END AS degree_b,
 CASE WHEN a = 3 OR b = 3 THEN NULL WHEN least(a, b) = 0 AND greatest(a, b) = 0 THEN 6 WHEN greatest(a, b) = 1 THEN 8
  WHEN least(a, b) = 2 THEN 15 ELSE 10 END AS m FROM t)
SELECT osm_id, degree_a, degree_b, CAST(m AS DOUBLE) AS min_m, CASE WHEN m IS NULL THEN 'unknown fire resistance' END AS reject_reason FROM n""")
def c11(spark, d):
    k = F.col("osm_id")
    names = [*rules.FIRE_DEGREES]
    b = V(spark, d).buildings().select("osm_id", V._pick(k % 4, names, "VI").alias("degree_a"), V._pick((k * 7 + 1) % 4, names, "VI").alias("degree_b"))
    m = at.fire_break_m(F.col("degree_a"), F.col("degree_b"))
    return b.select("*", m.alias("min_m"), F.when(m.isNull(), "unknown fire resistance").alias("reject_reason"))


@query("c12_drawing_labels", """SELECT seq, CASE drawing_layer WHEN 'К1' THEN 'К' WHEN 'кл3' THEN 'Кл' WHEN 'Водопроводная сеть' THEN 'В' WHEN 'Т1' THEN 'Т' WHEN 'Газопровод' THEN 'Г' END AS network_type,
 TRY_CAST(nullif(coalesce(nullif(regexp_extract(txt, '[øØ⌀]\\s*(\\d+)', 1), ''), nullif(regexp_extract(txt, '[dDдД]\\s*=\\s*(\\d+)', 1), '')), '') AS DOUBLE) AS diameter_mm,
 CASE WHEN contains(lower(txt), 'чугун') THEN 'чугун' WHEN contains(lower(txt), 'пнд') THEN 'пнд' END AS material,
 CASE WHEN txt = 'отм 12,30' THEN 12.3::DOUBLE WHEN txt = 'z=-2.5' THEN -2.5::DOUBLE END AS label_m,
 CASE WHEN txt = 'отм 12,30' THEN 12.3::DOUBLE WHEN txt = 'z=-2.5' THEN -2.5::DOUBLE
  ELSE CASE drawing_layer WHEN 'К1' THEN -1.5::DOUBLE WHEN 'кл3' THEN -0.7::DOUBLE WHEN 'Водопроводная сеть' THEN -1.8::DOUBLE WHEN 'Т1' THEN -0.7::DOUBLE WHEN 'Газопровод' THEN -0.8::DOUBLE END END AS elevation_m,
 CASE WHEN txt IN ('отм 12,30', 'z=-2.5') THEN 'факт' ELSE 'нормативная' END AS elevation_source FROM v_texts""")
def c12(spark, d):
    t = V(spark, d).texts().withColumn("nt", labels.network_type(F.col("drawing_layer")))
    t = t.withColumn("e", labels.segment_elevation(F.col("txt"), F.col("nt")))
    return t.select(
        "seq", F.col("nt").alias("network_type"), labels.diameter_mm(F.col("txt")).alias("diameter_mm"), labels.material(F.col("txt")).alias("material"),
        labels.elevation_m(F.col("txt")).alias("label_m"), "e.elevation_m", F.col("e.source").alias("elevation_source"),
    )


DIST = "sqrt(x * x + y * y)"
LOD_SQL = "CASE WHEN {d} <= 500 THEN 'LOD2' WHEN {d} <= 1500 THEN 'LOD1' WHEN {d} <= 3000 THEN 'LOD0' END"


@query("c23_lod_rings", f"""SELECT osm_id, round({DIST}, 6) AS distance_m, {LOD_SQL.format(d=DIST)} AS lod,
 CASE WHEN {DIST} > 3000 THEN 'outside all rings' END AS reject_reason FROM v_features""")
def c23(spark, d):
    dist = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    lod = tilemath.lod_ring(dist)
    return V(spark, d).features().select("osm_id", r6(dist, "distance_m"), lod.alias("lod"), F.when(lod.isNull(), "outside all rings").alias("reject_reason"))


@query("c24_tile_key_bounds", """WITH t AS (SELECT osm_id, layer, CAST(floor(x / 250) AS BIGINT) AS tx, CAST(floor(y / 250) AS BIGINT) AS ty FROM v_features)
SELECT osm_id, tx, ty, 'msk59-2/250/' || tx || '_' || ty || '/' || layer || '/2024-01/g1' AS tile_key,
 CAST(tx * 250 AS DOUBLE) AS minx, CAST(ty * 250 AS DOUBLE) AS miny, CAST(tx * 250 + 250 AS DOUBLE) AS maxx, CAST(ty * 250 + 250 AS DOUBLE) AS maxy FROM t""")
def c24(spark, d):
    f = V(spark, d).features().withColumns({"tx": tilemath.tile_of(F.col("x")), "ty": tilemath.tile_of(F.col("y"))})
    key = tilemath.tile_key(F.lit(2), F.col("tx"), F.col("ty"), F.col("layer"), F.lit("2024-01"), F.lit("g1"))
    return f.select("osm_id", "tx", "ty", key.alias("tile_key"), *[c.alias(n) for n, c in tilemath.tile_bounds(F.col("tx"), F.col("ty")).items()])


WEB = """lon_lat AS (SELECT osm_id, 56.25 + x * 0.0000169::DOUBLE AS lon, 58.0 + y * 0.000009::DOUBLE AS lat, CAST(8 + osm_id % 10 AS INT) AS z FROM v_features),
tiles AS (SELECT *, CAST(trunc((lon + 180.0) / 360.0 * pow(2.0, z)) AS BIGINT) AS tx,
 CAST(trunc((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * pow(2.0, z)) AS BIGINT) AS ty FROM lon_lat)"""


@query("c25_web_tiles", f"""WITH {WEB}
SELECT osm_id, z, tx, ty, round(tx * (40075016.6855785::DOUBLE / pow(2.0, z)) - 40075016.6855785::DOUBLE / 2, 3) AS minx,
 round(40075016.6855785::DOUBLE / 2 - ty * (40075016.6855785::DOUBLE / pow(2.0, z)), 3) AS maxy FROM tiles""")
def c25(spark, d):
    from driver.views import lonlat

    f = V(spark, d).features()
    lon, lat = lonlat(F.col("x"), F.col("y"))
    f = f.withColumns({"lon": lon, "lat": lat, "z": (8 + F.col("osm_id") % 10).cast("int")})
    tx, ty = tilemath.lonlat_to_web_tile(F.col("lon"), F.col("lat"), F.col("z"))
    f = f.withColumns({"tx": tx, "ty": ty})
    b = tilemath.web_tile_bounds(F.col("z"), F.col("tx"), F.col("ty"))
    return f.select("osm_id", "z", "tx", "ty", F.round(b["minx"], 3).alias("minx"), F.round(b["maxy"], 3).alias("maxy"))


@query("c26_terrain_rgb", """WITH v AS (SELECT r, c, z, CAST(round_even((least(greatest(z * 7.3::DOUBLE, -10000.0), -10000.0 + 16777215 * 0.1::DOUBLE) + 10000.0) / 0.1::DOUBLE, 0) AS BIGINT) AS code
 FROM v_cells WHERE z IS NOT NULL)
SELECT r, c, CAST((code // 65536) % 256 AS INT) AS red, CAST((code // 256) % 256 AS INT) AS green, CAST(code % 256 AS INT) AS blue, round(-10000.0 + code * 0.1::DOUBLE, 4) AS decoded FROM v""")
def c26(spark, d):
    c = V(spark, d).cells().where(F.col("z").isNotNull()).withColumn("rgb", tilemath.terrain_rgb(F.col("z") * 7.3))
    h = tilemath.terrain_height(F.col("rgb.r"), F.col("rgb.g"), F.col("rgb.b"))
    return c.select("r", "c", F.col("rgb.r").alias("red"), F.col("rgb.g").alias("green"), F.col("rgb.b").alias("blue"), F.round(h, 4).alias("decoded"))


@query("c28_sun_position", """WITH t AS (SELECT event_id, date_trunc('second', ts) AS ts, 50.0 + user_id % 15 AS lat, 30.0 + user_id % 60 AS lon FROM events),
a AS (SELECT *, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 3600.0::DOUBLE AS h,
 date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) + (hour(ts) * 3600 + minute(ts) * 60 + second(ts) - 43200) / 86400.0::DOUBLE AS n FROM t),
b AS (SELECT *, radians((280.460::DOUBLE + 0.9856474::DOUBLE * n) % 360) AS ml, radians((357.528::DOUBLE + 0.9856003::DOUBLE * n) % 360) AS ma, radians(23.439::DOUBLE - 0.0000004::DOUBLE * n) AS ob FROM a),
e AS (SELECT *, ml + radians(1.915::DOUBLE) * sin(ma) + radians(0.020::DOUBLE) * sin(2 * ma) AS el FROM b),
f AS (SELECT *, atan2(cos(ob) * sin(el), cos(el)) AS ra, asin(sin(ob) * sin(el)) AS de, (6.697374558::DOUBLE + 0.06570982441908::DOUBLE * n + 1.00273790935::DOUBLE * h) % 24 AS gm FROM e),
g AS (SELECT *, radians(((gm + lon / 15.0::DOUBLE) % 24) * 15 - degrees(ra)) AS ha, radians(lat) AS la FROM f),
k AS (SELECT event_id, asin(sin(la) * sin(de) + cos(la) * cos(de) * cos(ha)) AS ev, (degrees(atan2(sin(ha), cos(ha) * sin(la) - tan(de) * cos(la))) + 180) % 360 AS az, de FROM g)
SELECT event_id, round(degrees(ev), 5) AS elevation_deg, round(az, 5) AS azimuth_deg, round(degrees(de), 5) AS declination_deg,
 round(cos(ev) * sin(radians(az)), 5) + 0.0 AS dir_x, round(cos(ev) * cos(radians(az)), 5) + 0.0 AS dir_y, round(sin(ev), 5) + 0.0 AS dir_z FROM k""")
def c28(spark, d):
    e = V(spark, d).table("events").select(
        "event_id", "ts", (50.0 + F.col("user_id") % 15).alias("lat"), (30.0 + F.col("user_id") % 60).alias("lon")
    )
    s = sun.with_sun_position(e, "ts", "lat", "lon")
    return s.select("event_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("elevation_deg", "azimuth_deg", "declination_deg", "dir_x", "dir_y", "dir_z")])


@query("c36_request_deadlines", """WITH r AS (SELECT id, CAST(MAX(user_id) AS BIGINT) AS n, MAX(ts) AS at FROM (SELECT event_id * 7 % 15000 AS id, user_id, ts FROM events WHERE event_type = 'signup') GROUP BY id),
t AS (SELECT q.id, sent_at, CAST(sent_at + INTERVAL 30 DAY AS DATE) AS deadline, CASE WHEN r.id IS NOT NULL THEN 'получен' ELSE status END AS st, r.id IS NOT NULL AS answered FROM v_requests q LEFT JOIN r ON r.id = q.id)
SELECT id, strftime(sent_at, '%Y-%m-%d') AS sent_at, strftime(deadline, '%Y-%m-%d') AS deadline,
 CASE WHEN st = 'отправлен' AND deadline < DATE '1998-06-15' THEN 'просрочен' ELSE st END AS status, answered FROM t""")
def c36(spark, d):
    v = V(spark, d)
    resp = v.table("events").where("event_type = 'signup'").select(
        (F.col("event_id") * 7 % 15000).alias("id"), F.col("ts").alias("received_at"), F.col("user_id").alias("incoming_number")
    )
    q = jobs.with_responses(jobs.with_deadline(v.requests()), resp)
    q = jobs.overdue(q, F.lit("1998-06-15").cast("date"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return q.select("id", day("sent_at"), day("deadline"), "status", F.col("received_at").isNotNull().alias("answered"))
