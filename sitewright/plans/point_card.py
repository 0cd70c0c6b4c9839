"""Card of a point: what applies here and nearby, as rows per section."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.operators import zones

# fixed values: section names
MAIN, RESTRICTIONS, SOURCE, LINKS = "основное", "ограничения", "источник", "ссылки"


def cards(points: DataFrame, zone_rows: DataFrame, regulations: DataFrame, *, point_id: str, max_distance_m: float = 500.0) -> DataFrame:
    """Four sections per point, nearest zone first. One row per entry, so a crowded point is no large array.

    zone_rows: current zones with zone_id, zone_type, registry_number, source_name, document_basis, ring, bbox.
    """
    ranked = zones.ranked_near_points(
        points, zone_rows, point_id=point_id, zone_id="zone_id", carry=["zone_type", "registry_number", "source_name", "document_basis"], max_distance_m=max_distance_m,
    )
    here = zones.containing_zone(points, regulations, point_id=point_id, area_id="id", carry=["zone_code"])
    none, no_dist = F.lit(None).cast("string"), F.lit(None).cast("double")
    main = here.select(
        point_id, F.lit(MAIN).alias("section"), F.lit(0).cast("bigint").alias("pos"), F.col("zone_code").alias("kind"), none.alias("detail"), no_dist.alias("distance_m")
    )
    entry = F.explode(F.array(
        F.struct(F.lit(RESTRICTIONS).alias("section"), F.col("registry_number").alias("detail"), F.bround("distance_m", 1).alias("m"), F.lit(True).alias("keep")),
        F.struct(F.lit(SOURCE).alias("section"), F.col("source_name").alias("detail"), no_dist.alias("m"), F.lit(True).alias("keep")),
        F.struct(F.lit(LINKS).alias("section"), F.col("document_basis").alias("detail"), no_dist.alias("m"), F.col("document_basis").isNotNull().alias("keep")),
    ))
    rest = ranked.select(point_id, "pos", "zone_type", entry.alias("e")).where("e.keep").select(
        point_id, "e.section", "pos", F.col("zone_type").alias("kind"), "e.detail", F.col("e.m").alias("distance_m")
    )
    return main.unionByName(rest)
