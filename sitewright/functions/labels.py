"""Drawing labels: network type of a layer name, diameter, material and elevation in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions.numbers import strip
from sitewright.functions.tags import lookup

# fixed values: label patterns
LAYER_CODE = r"(?iu)^(кл|к|в|т|г)\d*$"
DIAMETER = r"(?iu)[øØ⌀]\s*(\d+)|[dд]\s*=\s*(\d+)|\bd(\d+)\b"
ELEVATION = r"отм\.?\s*=?\s*(-?\d+[.,]\d+)|[zZ]\s*=\s*(-?\d+[.,]\d+)"
NOT_LETTERS = r"[^a-zA-Zа-яА-ЯёЁ]+"


def _first_group(text: Column, pattern: str, groups: int) -> Column:
    hits = [F.nullif(F.regexp_extract(text, pattern, i), F.lit("")) for i in range(1, groups + 1)]
    return F.coalesce(*hits)


def network_type(layer_name: Column) -> Column:
    """Standard code first, then whole words; null means a person has to decide."""
    name = strip(layer_name)
    code = F.lower(F.nullif(F.regexp_extract(name, LAYER_CODE, 1), F.lit("")))
    by_code = F.when(code == "кл", "Кл").otherwise(F.upper(code))
    words = F.split(F.lower(name), NOT_LETTERS)
    by_word = F.coalesce(*[
        F.when(F.arrays_overlap(words, F.array(*map(F.lit, ws))), kind) for kind, ws in rules.NETWORK_WORDS.items()
    ])
    return F.coalesce(by_code, by_word)


def network_label(kind: Column) -> Column:
    """Name of a network type."""
    return lookup(kind, rules.NETWORK_LABELS)


def diameter_mm(text: Column) -> Column:
    return _first_group(text, DIAMETER, 3).try_cast("double")


def material(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), m) for m in rules.PIPE_MATERIALS])


def elevation_m(text: Column) -> Column:
    return F.replace(_first_group(text, ELEVATION, 2), F.lit(","), F.lit(".")).try_cast("double")


def segment_elevation(label: Column, kind: Column) -> Column:
    """Elevation from the label, else minus the normative depth of a known network type."""
    found = elevation_m(label)
    depth = F.when(kind.isNotNull(), -lookup(kind, rules.NETWORK_DEPTH_M, 1.0))
    return F.struct(
        F.coalesce(found, depth).alias("elevation_m"),
        F.when(found.isNotNull(), rules.FACT).otherwise(rules.NORMATIVE_SOURCE).alias("source"),
    )
