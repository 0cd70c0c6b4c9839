"""Simple object tables from selected features: trees, lawns, lamps, benches, substations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions.numbers import lower_tag, positive_float
from sitewright.operators.relief import ring_minimum


def single_trees(points: DataFrame) -> DataFrame:
    """Point features of the vegetation layer: species with its confidence, height or default."""
    t = points.where(F.col("layer") == "osm_vegetation")
    h = positive_float(F.col("tags")["height"])
    return t.select(
        "osm_id", "x", "y", F.coalesce("species.value", F.lit(rules.TREE_SPECIES_DEFAULT)).alias("species"), F.col("species.confidence").alias("species_confidence"),
        F.coalesce(h, F.lit(rules.TREE_HEIGHT_DEFAULT_M)).alias("height_m"), F.when(h.isNotNull(), rules.FACT).otherwise(rules.DEFAULT).alias("height_confidence"),
    )


def vegetation_branch(tags: Column) -> Column:
    """lawn, shrub or forest for an area of the vegetation layer."""
    return F.when(lower_tag(tags["landuse"]) == "grass", "lawn").when(lower_tag(tags["natural"]) == "scrub", "shrub").otherwise("forest")


def street_furniture(points: DataFrame) -> DataFrame:
    """Lamps and benches with their fixed sizes, one row per object and dimension set."""
    p = points.where(F.col("layer") == "osm_landscaping")
    t = F.col("tags")
    lamp, bench = lower_tag(t["highway"]) == "street_lamp", lower_tag(t["amenity"]) == "bench"
    size = lambda cond, table: {k: F.when(cond, v) for k, v in table.items()}
    kind = F.when(lamp, "lamp").when(bench, "bench")
    return p.withColumns({"kind": kind, **size(lamp, rules.LAMP), **size(bench & ~lamp, rules.BENCH)}).where(F.col("kind").isNotNull())


def substations(areas: DataFrame, cells: DataFrame, grid: DataFrame) -> DataFrame:
    """Outlined substations and plants as flat volumes on their lowest corner. areas: osm_id, source_id, ring, tags."""
    a = areas.withColumn("kind", lower_tag(F.col("tags")["power"])).where(F.col("kind").isin("substation", "plant"))
    z = ring_minimum(a.select("osm_id", "source_id", "ring"), cells, grid, "osm_id")
    return a.join(z, "osm_id").select("osm_id", "kind", "base_z", F.lit(rules.SUBSTATION_HEIGHT_M).alias("height_m"))
