"""Site selection: everything a site needs, clipped to its circle, in its own frame, with normalised attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import crs
from sitewright.functions import tags as tg
from sitewright.operators import selection

Registry = dict[str, Callable[[Column], dict[str, Column]]]


def select_points(features: DataFrame, sites: DataFrame, *, feature_id: str = "osm_id", registry: Registry | None = None,
                  types: dict[str, str] | None = None, margin_m: float = rules.SELECTION_MARGIN_M) -> DataFrame:
    """Point features of many sites at once.

    features: feature_id, layer, lon, lat, tags. sites: site_id, center_lon, center_lat, radius_m.
    A feature is normalised once and projected once per zone that a site in reach may use, before it
    meets the sites; behind the join only the distance tests are left.
    """
    framed = selection.with_site_frame(sites.select("site_id", "center_lon", "center_lat", "radius_m"))
    reach = framed.agg(F.max((F.col("radius_m") + margin_m) / selection.DEG_M * 1.01 / F.cos(F.radians("center_lat")))).first()[0]
    attrs = tg.normalized_attributes(F.col("layer"), F.col("tags"), registry, types)
    ready = features.select(feature_id, "layer", "lon", "lat", *(c.alias(n) for n, c in attrs.items()))
    ready = ready.withColumn("zone", F.explode(crs.zones_in_reach(F.col("lon"), reach or 0.0)))
    ready = crs.lonlat_to_msk(ready, "lon", "lat", "zone", ("px", "py"))
    hit = selection.points_in_radius(ready, framed, feature_id, margin_m, by=["zone"])
    return selection.clip_points(hit).select("site_id", "zone", "layer", feature_id, "x", "y", *attrs)


def select_shapes(features: DataFrame, sites: DataFrame, *, feature_id: str = "osm_id", margin_m: float = rules.SELECTION_MARGIN_M) -> DataFrame:
    """Lines and areas of many sites: pieces inside the circle, in local coordinates.

    features: feature_id, layer, geometry ('line' or 'area'), path (lon/lat), tags. A line gives one row
    per segment piece (seq, ring null), an area one row per part that is left of its ring.
    """
    framed = selection.with_site_frame(sites.select("site_id", "center_lon", "center_lat", "radius_m"))
    hit = selection.shapes_in_radius(features, framed, feature_id, margin_m)
    keys = ["site_id", feature_id]
    projected = crs.path_to_msk(hit.select(*keys, "zone", "path"), "path", "zone", keys)
    rows = hit.drop("path").join(projected, keys)
    lines = selection.clip_lines(rows.where("geometry = 'line'"))
    areas = selection.clip_areas(rows.where("geometry = 'area'").withColumnRenamed("path", "ring"))
    return lines.select(*keys, "layer", "geometry", "seq", "x0", "y0", "x1", "y1").unionByName(
        areas.select(*keys, "layer", "geometry", "ring"), allowMissingColumns=True
    )


def layer_counts(selected: DataFrame) -> DataFrame:
    """Objects per site and layer, with how many attributes came from tags."""
    facts = lambda a: F.count_if(F.col(f"{a}.confidence") == rules.FACT)
    named = [c for c in ("type", "levels", "highway_class", "surface", "voltage_kv", "species") if c in selected.columns]
    total = sum((facts(a) for a in named), F.lit(0))
    return selected.groupBy("site_id", "layer").agg(F.count(F.lit(1)).alias("n_objects"), total.cast("bigint").alias("n_facts"))
