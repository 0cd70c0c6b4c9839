"""Inputs of the registered queries: the driver's tables seen as map features, zones, cells, jobs.

``V`` builds them as DataFrames; ``VIEW_SQL`` states the same views for the SQL side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom

VIEW_SQL = {
    "v_features": """SELECT o_orderkey AS osm_id,
  CASE o_orderkey % 8 WHEN 0 THEN 'osm_buildings' WHEN 1 THEN 'osm_roads' WHEN 2 THEN 'osm_power'
    WHEN 3 THEN 'osm_vegetation' WHEN 4 THEN 'osm_entrances' WHEN 5 THEN 'osm_landscaping'
    WHEN 6 THEN 'osm_railways' ELSE 'osm_waterways' END AS layer,
  CAST((o_orderkey * 7919) % 6001 - 3000 AS DOUBLE) AS x, CAST((o_orderkey * 104729) % 6007 - 3003 AS DOUBLE) AS y,
  CASE o_orderkey % 9 WHEN 0 THEN '5' WHEN 1 THEN '3.7' WHEN 2 THEN ' 7 ' WHEN 3 THEN '-2' WHEN 4 THEN '0'
    WHEN 5 THEN 'abc' WHEN 6 THEN '' WHEN 7 THEN NULL ELSE '12' END AS levels_tag,
  CASE o_orderkey % 5 WHEN 0 THEN 'apartments' WHEN 1 THEN 'house' WHEN 2 THEN '  ' WHEN 3 THEN NULL ELSE 'retail' END AS type_tag,
  CASE WHEN o_orderkey % 3 = 0 THEN 'asphalt' WHEN o_orderkey % 7 = 0 THEN 'gravel' END AS surface_tag,
  o_orderdate AS data_timestamp FROM orders""",
    "v_buildings": """SELECT p_partkey AS osm_id,
  CAST((p_partkey * 7919) % 5801 - 2900 AS DOUBLE) AS cx, CAST((p_partkey * 104729) % 5807 - 2903 AS DOUBLE) AS cy,
  CAST(4 + p_size % 17 AS DOUBLE) AS hx, CAST(4 + p_size % 11 AS DOUBLE) AS hy, lower(p_type) AS building_type,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(3 + p_size % 20 AS VARCHAR(10)) END AS height_tag,
  CASE WHEN p_partkey % 4 = 1 THEN CAST(1 + p_size % 9 AS VARCHAR(10)) WHEN p_partkey % 4 = 2 THEN 'x' END AS levels_tag,
  p_partkey % 10 = 0 AS is_part FROM part""",
    "v_lines": """SELECT c_custkey AS osm_id,
  CASE c_custkey % 4 WHEN 0 THEN 'osm_roads' WHEN 1 THEN 'osm_railways' WHEN 2 THEN 'osm_power' ELSE 'osm_waterways' END AS layer,
  CAST((c_custkey * 7919) % 6001 - 3000 AS DOUBLE) AS x0, CAST((c_custkey * 104729) % 6007 - 3003 AS DOUBLE) AS y0,
  CAST((c_custkey * 7919) % 6001 - 3000 + (c_custkey * 31) % 401 - 200 AS DOUBLE) AS x1,
  CAST((c_custkey * 104729) % 6007 - 3003 + (c_custkey * 37) % 397 - 198 AS DOUBLE) AS y1,
  CASE c_nationkey % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'residential' WHEN 2 THEN 'service' WHEN 3 THEN 'track' ELSE 'tertiary_link' END AS highway,
  CASE WHEN c_custkey % 6 = 0 THEN 'yes' WHEN c_custkey % 6 = 1 THEN 'no' END AS bridge_tag,
  CASE c_custkey % 3 WHEN 0 THEN '10000' WHEN 1 THEN '110000' END AS voltage_tag FROM customer""",
    "v_zones": """SELECT s_suppkey AS id,
  CASE s_suppkey % 4 WHEN 0 THEN 'red line' WHEN 1 THEN 'water protection' WHEN 2 THEN 'power corridor' ELSE 'heritage' END AS zone_type,
  CASE WHEN s_suppkey % 5 = 0 THEN 'расчётно' ELSE 'официально' END AS status,
  CASE WHEN s_suppkey % 5 <> 0 THEN '59:00-' || CAST(s_suppkey % 30 AS VARCHAR(10)) END AS registry_number,
  CAST((s_suppkey * 7919) % 5001 - 2500 AS DOUBLE) AS minx, CAST((s_suppkey * 104729) % 5003 - 2501 AS DOUBLE) AS miny,
  CAST((s_suppkey * 7919) % 5001 - 2500 + 50 + (s_suppkey * 13) % 300 AS DOUBLE) AS maxx,
  CAST((s_suppkey * 104729) % 5003 - 2501 + 50 + (s_suppkey * 17) % 300 AS DOUBLE) AS maxy,
  s_suppkey AS load_seq, s_suppkey % 3 AS priority, 'source ' || CAST(s_suppkey % 7 AS VARCHAR(10)) AS source_name FROM supplier""",
    "v_current": """SELECT * FROM (SELECT *, CASE WHEN registry_number IS NOT NULL THEN
    lead(load_seq) OVER (PARTITION BY registry_number ORDER BY load_seq) END AS superseded_by FROM v_zones) WHERE superseded_by IS NULL""",
    "v_cells": """SELECT CAST(floor(o_orderkey / 120.0) AS INT) AS r, CAST(o_orderkey % 120 AS INT) AS c,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL
    ELSE CAST(100 + 0.25 * (o_orderkey % 120) + 0.5 * floor(o_orderkey / 120.0) + ((o_orderkey * 31) % 7) * 0.125 AS DOUBLE) END AS z
  FROM orders""",
    "v_grid": "SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM v_cells",
    "v_texts": """SELECT p_partkey AS seq,
  CAST((p_partkey * 7919) % 6001 - 3000 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 6007 - 3003 AS DOUBLE) AS y,
  CASE p_partkey % 5 WHEN 0 THEN 'Ø' || CAST(p_size * 10 AS VARCHAR(10)) || ' чугун'
    WHEN 1 THEN 'd=' || CAST(p_size AS VARCHAR(10)) || ' ПНД' WHEN 2 THEN 'отм 12,30' WHEN 3 THEN 'z=-2.5' ELSE p_name END AS txt,
  CASE p_partkey % 6 WHEN 0 THEN 'К1' WHEN 1 THEN 'кл3' WHEN 2 THEN 'Водопроводная сеть' WHEN 3 THEN 'Т1'
    WHEN 4 THEN 'СТЕНЫ' ELSE 'Газопровод' END AS drawing_layer FROM part""",
    "v_steps": """SELECT user_id AS job_id, event_id AS step_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step_order,
  ts AS started_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS finished_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' ELSE 'done' END AS status,
  CASE WHEN event_type = 'error' THEN props END AS error_message FROM events""",
    "v_samples": """SELECT event_id, user_id AS job_id, ts, CAST(floor(value * 1024) AS BIGINT) AS rss_kb, event_type <> 'error' AS up FROM events""",
    "v_imports": "SELECT event_id AS id, event_type AS source_name, ts AS data_timestamp, props AS notes FROM events",
    "v_requests": """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS sent_at,
  CASE o_orderstatus WHEN 'F' THEN 'получен' ELSE 'отправлен' END AS status FROM orders""",
    "v_sites": """SELECT CAST(n_nationkey AS BIGINT) AS site_id, CAST((n_nationkey * 617) % 4001 - 2000 AS DOUBLE) AS sx,
  CAST((n_nationkey * 911) % 4001 - 2000 AS DOUBLE) AS sy, CAST(500 + (n_nationkey * 373) % 2501 AS DOUBLE) AS radius_m FROM nation""",
}

CELL_M, GRID_X0, GRID_Y0 = 25.0, -1500.0, 1500.0
LON0, LAT0, DEG_X, DEG_Y = 56.25, 58.0, 0.0000169, 0.000009


def lonlat(x, y):
    """Pseudo geographic position of a local point."""
    return F.lit(LON0) + x * DEG_X, F.lit(LAT0) + y * DEG_Y


class V:
    """Fixture views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @staticmethod
    def _pick(key, values, default):
        """CASE key WHEN 0 THEN values[0] ... ELSE default"""
        out = None
        for i, v in enumerate(values):
            out = F.when(key == i, v) if out is None else out.when(key == i, v)
        return out.otherwise(default)

    def features(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").select(
            k.alias("osm_id"),
            self._pick(k % 8, ["osm_buildings", "osm_roads", "osm_power", "osm_vegetation", "osm_entrances", "osm_landscaping", "osm_railways"], "osm_waterways").alias("layer"),
            ((k * 7919) % 6001 - 3000).cast("double").alias("x"), ((k * 104729) % 6007 - 3003).cast("double").alias("y"),
            self._pick(k % 9, ["5", "3.7", " 7 ", "-2", "0", "abc", "", None], "12").alias("levels_tag"),
            self._pick(k % 5, ["apartments", "house", "  ", None], "retail").alias("type_tag"),
            F.when(k % 3 == 0, "asphalt").when(k % 7 == 0, "gravel").alias("surface_tag"),
            F.col("o_orderdate").alias("data_timestamp"),
        )

    def buildings(self) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("p_size")
        b = self.table("part").select(
            k.alias("osm_id"), ((k * 7919) % 5801 - 2900).cast("double").alias("cx"), ((k * 104729) % 5807 - 2903).cast("double").alias("cy"),
            (4 + s % 17).cast("double").alias("hx"), (4 + s % 11).cast("double").alias("hy"), F.lower("p_type").alias("building_type"),
            F.when(k % 4 == 0, (3 + s % 20).cast("string")).alias("height_tag"),
            F.when(k % 4 == 1, (1 + s % 9).cast("string")).when(k % 4 == 2, "x").alias("levels_tag"),
            (k % 10 == 0).alias("is_part"),
        )
        c = F.col
        return b.withColumn("ring", geom.rect_ring(c("cx") - c("hx"), c("cy") - c("hy"), c("cx") + c("hx"), c("cy") + c("hy")))

    def lines(self) -> DataFrame:
        k = F.col("c_custkey")
        x0, y0 = (k * 7919) % 6001 - 3000, (k * 104729) % 6007 - 3003
        l = self.table("customer").select(
            k.alias("osm_id"), self._pick(k % 4, ["osm_roads", "osm_railways", "osm_power"], "osm_waterways").alias("layer"),
            x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
            (x0 + (k * 31) % 401 - 200).cast("double").alias("x1"), (y0 + (k * 37) % 397 - 198).cast("double").alias("y1"),
            self._pick(F.col("c_nationkey") % 5, ["primary", "residential", "service", "track"], "tertiary_link").alias("highway"),
            F.when(k % 6 == 0, "yes").when(k % 6 == 1, "no").alias("bridge_tag"),
            F.when(k % 3 == 0, "10000").when(k % 3 == 1, "110000").alias("voltage_tag"),
        )
        return l.withColumn("path", F.array(geom.point(F.col("x0"), F.col("y0")), geom.point(F.col("x1"), F.col("y1"))))

    def zones(self) -> DataFrame:
        k = F.col("s_suppkey")
        x, y = (k * 7919) % 5001 - 2500, (k * 104729) % 5003 - 2501
        z = self.table("supplier").select(
            k.alias("id"), self._pick(k % 4, ["red line", "water protection", "power corridor"], "heritage").alias("zone_type"),
            F.when(k % 5 == 0, "расчётно").otherwise("официально").alias("status"),
            F.when(k % 5 != 0, F.concat(F.lit("59:00-"), (k % 30).cast("string"))).alias("registry_number"),
            x.cast("double").alias("minx"), y.cast("double").alias("miny"), (x + 50 + (k * 13) % 300).cast("double").alias("maxx"),
            (y + 50 + (k * 17) % 300).cast("double").alias("maxy"), k.alias("load_seq"), (k % 3).alias("priority"),
            F.concat(F.lit("source "), (k % 7).cast("string")).alias("source_name"),
        )
        return z.withColumn("ring", geom.rect_ring(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")))

    def cells(self) -> DataFrame:
        k = F.col("o_orderkey")
        r, c = F.floor(k / 120.0), k % 120
        z = 100 + 0.25 * c + 0.5 * r + ((k * 31) % 7) * 0.125
        return self.table("orders").select(
            F.lit(0).cast("bigint").alias("source_id"), r.cast("int").alias("r"), c.cast("int").alias("c"),
            F.when(k % 97 != 0, z.cast("double")).alias("z"),
        )

    def grid(self) -> DataFrame:
        from sitewright.operators.relief import grid_of

        return grid_of(self.cells(), GRID_X0, GRID_Y0, CELL_M)

    def texts(self) -> DataFrame:
        k, s = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            k.alias("seq"), ((k * 7919) % 6001 - 3000).cast("double").alias("x"), ((k * 104729) % 6007 - 3003).cast("double").alias("y"),
            self._pick(k % 5, [
                F.concat(F.lit("Ø"), (s * 10).cast("string"), F.lit(" чугун")), F.concat(F.lit("d="), s.cast("string"), F.lit(" ПНД")),
                F.lit("отм 12,30"), F.lit("z=-2.5"),
            ], F.col("p_name")).alias("txt"),
            self._pick(k % 6, ["К1", "кл3", "Водопроводная сеть", "Т1", "СТЕНЫ"], "Газопровод").alias("drawing_layer"),
        )

    def steps(self) -> DataFrame:
        from sitewright.operators.jobs import ordered_steps

        e = ordered_steps(self.table("events"), "user_id", "ts", "event_id")
        t = F.col("event_type")
        return e.select(
            F.col("user_id").alias("job_id"), F.col("event_id").alias("step_id"), (F.col("step_order") - 1).alias("step_order"),
            F.col("ts").alias("started_at"), "finished_at",
            F.when(t == "error", "failed").when(t == "view", "pending").when(t == "click", "running").otherwise("done").alias("status"),
            F.when(t == "error", F.col("props")).alias("error_message"),
        )

    def samples(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("user_id").alias("job_id"), "ts", F.floor(F.col("value") * 1024).cast("bigint").alias("rss_kb"),
            (F.col("event_type") != "error").alias("up"),
        )

    def imports(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("event_type").alias("source_name"), F.col("ts").alias("data_timestamp"), F.col("props").alias("notes")
        )

    def requests(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("sent_at"),
            F.when(F.col("o_orderstatus") == "F", rules.TU_RECEIVED).otherwise(rules.TU_SENT).alias("status"),
        )

    def sites(self) -> DataFrame:
        k = F.col("n_nationkey")
        s = self.table("nation").select(
            k.cast("bigint").alias("site_id"), ((k * 617) % 4001 - 2000).cast("double").alias("sx"), ((k * 911) % 4001 - 2000).cast("double").alias("sy"),
            (500 + (k * 373) % 2501).cast("double").alias("radius_m"),
        )
        lon, lat = lonlat(F.col("sx"), F.col("sy"))
        return s.withColumns({"center_lon": lon, "center_lat": lat})


def r6(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)
