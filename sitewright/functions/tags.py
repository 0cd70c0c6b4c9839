"""Tag normalisers: each returns ``{attribute: struct<value, confidence>}`` Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions.numbers import lower_tag, non_empty, positive_float, positive_int


def noted(value: Column, default=None) -> Column:
    """Value with its provenance: a parsed tag is a fact, anything else the default."""
    filled = F.coalesce(value, F.lit(default)) if default is not None else value
    return F.struct(
        filled.alias("value"),
        F.when(value.isNotNull(), rules.FACT).otherwise(rules.DEFAULT).alias("confidence"),
    )


def lookup(key: Column, table: dict, otherwise=None) -> Column:
    """Small fixed table as a literal map."""
    pairs = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    found = F.element_at(pairs, key)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def normalize_building(tags: Column, key: str = "building") -> dict[str, Column]:
    return {
        "type": noted(non_empty(tags[key]), rules.DEFAULT_BUILDING_TYPE),
        "levels": noted(positive_int(tags["building:levels"]), rules.DEFAULT_BUILDING_LEVELS),
    }


def normalize_building_part(tags: Column) -> dict[str, Column]:
    return normalize_building(tags, "building:part")


def normalize_entrance(tags: Column) -> dict[str, Column]:
    return {"type": noted(non_empty(tags["entrance"]), "yes")}


def normalize_road(tags: Column) -> dict[str, Column]:
    return {
        "highway_class": noted(non_empty(tags["highway"]), rules.DEFAULT_HIGHWAY_CLASS),
        "surface": noted(non_empty(tags["surface"])),
        "lanes": noted(positive_int(tags["lanes"])),
    }


def normalize_power(tags: Column) -> dict[str, Column]:
    return {"voltage_kv": noted(kilovolts(tags["voltage"]))}


def kilovolts(voltage: Column) -> Column:
    return F.bround(positive_float(voltage) / 1000.0, 3)


def normalize_vegetation(tags: Column) -> dict[str, Column]:
    species = F.coalesce(non_empty(tags["species"]), non_empty(tags["genus"]))
    return {"species": noted(F.coalesce(species, lookup(lower_tag(tags["leaf_type"]), rules.LEAF_TYPE_LABELS)))}


NORMALIZERS: dict[str, Callable[[Column], dict[str, Column]]] = {
    "osm_buildings": normalize_building,
    "osm_building_parts": normalize_building_part,
    "osm_roads": normalize_road,
    "osm_power": normalize_power,
    "osm_vegetation": normalize_vegetation,
    "osm_entrances": normalize_entrance,
}

ATTRIBUTE_TYPES = {
    "type": "string", "levels": "bigint", "highway_class": "string", "surface": "string",
    "lanes": "bigint", "voltage_kv": "double", "species": "string",
}


def normalized_attributes(layer: Column, tags: Column, registry=None, types=None) -> dict[str, Column]:
    """One typed nullable struct per attribute name over all layers.

    Layers without an entry in the registry keep nulls. A registry entry may return built-in
    Columns or pandas UDF Columns; only its own layer's rows get them.
    """
    registry = NORMALIZERS if registry is None else registry
    types = ATTRIBUTE_TYPES if types is None else types
    per_name: dict[str, Column] = {}
    for name, fn in registry.items():
        for attr, struct in fn(tags).items():
            typed = F.struct(
                struct["value"].cast(types.get(attr, "string")).alias("value"),
                struct["confidence"].alias("confidence"),
            )
            prev = per_name.get(attr)
            per_name[attr] = F.when(layer == name, typed) if prev is None else prev.when(layer == name, typed)
    return per_name


# --- tag predicates ---------------------------------------------------------------------------


def has_tag(tags: Column, key: str) -> Column:
    return F.map_contains_key(tags, key)


def is_building(tags: Column) -> Column:
    return has_tag(tags, "building")


def is_highway(tags: Column) -> Column:
    return has_tag(tags, "highway")


def is_courtyard_driveway(tags: Column) -> Column:
    service = F.coalesce(tags["service"], F.lit(""))
    return (F.coalesce(tags["highway"], F.lit("")) == "service") & service.isin("", "driveway", "alley", "parking_aisle")


def is_power_pole(tags: Column) -> Column:
    return F.coalesce(tags["power"].isin("pole", "tower"), F.lit(False))


def is_tree(tags: Column) -> Column:
    return F.coalesce(tags["natural"] == "tree", F.lit(False))


def is_set(value: Column) -> Column:
    """Tag given and not an explicit 'no' (bridge, electrified)."""
    return ~lower_tag(value).isin("", "no")


def is_unpaved(surface: Column) -> Column:
    return lower_tag(surface).isin(*rules.UNPAVED_SURFACES)
