"""Map elements: first-match routing into layer tables, partitioned write, whitelisted scan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright import rules


def layer_of(kind: Column, tags: Column, closed: Column) -> Column:
    """Layer of an element, or null when no rule wants it. Rules are tried in order, per element kind."""
    t = lambda k: F.coalesce(tags[k], F.lit(""))
    has = lambda k: tags[k].isNotNull()
    node = (
        F.when(has("entrance"), "osm_entrances")
        .when(t("natural") == "tree", "osm_vegetation")
        .when(t("power").isin("tower", "pole", "substation"), "osm_power")
        .when(t("railway").isin("level_crossing", "crossing"), "osm_railway_crossings")
        .when(
            t("amenity").isin("bench", "waste_basket") | (t("leisure") == "playground")
            | (t("highway") == "street_lamp") | has("barrier"),
            "osm_landscaping",
        )
    )
    area_only = lambda name: F.when(closed, name)
    way = (
        F.when(has("building:part"), area_only("osm_building_parts"))
        .when(has("building"), area_only("osm_buildings"))
        .when(has("highway"), "osm_roads")
        .when(t("railway") == "platform", "osm_railway_platforms")
        .when(has("railway"), "osm_railways")
        .when(has("waterway"), "osm_waterways")
        .when((t("natural") == "water") | (t("landuse") == "reservoir"), area_only("osm_water_areas"))
        .when(t("natural").isin("wood", "scrub") | t("landuse").isin("forest", "grass"), area_only("osm_vegetation"))
        .when(t("power").isin("line", "minor_line"), "osm_power")
        .when(t("power").isin("substation", "plant"), area_only("osm_power"))
        .when(
            t("leisure").isin("park", "playground") | t("barrier").isin("fence", "wall"),
            F.when(has("barrier"), F.lit("osm_landscaping")).otherwise(area_only("osm_landscaping")),
        )
    )
    relation = F.when(
        t("type") == "multipolygon",
        F.when(has("building"), "osm_buildings")
        .when((t("natural") == "water") | (t("landuse") == "reservoir"), "osm_water_areas")
        .when(t("natural").isin("wood", "scrub") | (t("landuse") == "forest"), "osm_vegetation"),
    )
    return F.when(kind == "node", node).when(kind == "way", way).when(kind == "relation", relation)


def geometry_of(kind: Column, layer: Column, tags: Column, closed: Column) -> Column:
    """point, line or area, by the same rules."""
    line_layers = layer.isin("osm_roads", "osm_railways", "osm_waterways")
    power_line = (layer == "osm_power") & F.coalesce(tags["power"], F.lit("")).isin("line", "minor_line")
    barrier = (layer == "osm_landscaping") & tags["barrier"].isNotNull()
    return (
        F.when(layer.isNull(), None).when(kind == "node", "point").when(kind == "relation", "area")
        .when(line_layers | power_line | barrier, "line")
        .when(closed, "area").otherwise("line")
    )


def route(elements: DataFrame, kind: str = "kind", tags: str = "tags", closed: str = "closed") -> DataFrame:
    routed = elements.withColumn("layer", layer_of(F.col(kind), F.col(tags), F.col(closed)))
    return routed.withColumn("geometry", geometry_of(F.col(kind), F.col("layer"), F.col(tags), F.col(closed)))


def write_layers(routed: DataFrame, path: str) -> None:
    """One partition folder per layer; rows without a layer are not stored."""
    routed.where(F.col("layer").isNotNull()).write.mode("append").partitionBy("layer").parquet(path)


def check_layers(layers: Iterable[str]) -> list[str]:
    names = list(layers)
    unknown = sorted(set(names) - set(rules.LAYERS))
    if unknown:
        raise ValueError(f"unknown layers: {unknown}; known: {list(rules.LAYERS)}")
    return names


def scan_layers(df: DataFrame, layers: Iterable[str] = rules.LAYERS) -> DataFrame:
    """Rows of the given layers; on a partitioned table this prunes folders."""
    return df.where(F.col("layer").isin(*check_layers(layers)))


def read_layers(spark: SparkSession, path: str, layers: Iterable[str] = rules.LAYERS) -> DataFrame:
    return scan_layers(spark.read.parquet(path), layers)
