"""Rows that leave the engine: manifests, numbered surfaces, outlines, object sets; and picks of one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom
from sitewright.operators import relief
from sitewright.operators.chunks import sequenced


def first_per(rows: DataFrame, by: Sequence[str], order: Sequence[Column], carry: Sequence[str]) -> DataFrame:
    """The row of each group that comes first by ``order`` (ascending): by and carry columns. Combined before the shuffle."""
    rank = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    best = rows.groupBy(*by).agg(F.min(F.struct(*rank, F.struct(*carry).alias("_row"))).alias("_b"))
    return best.select(*by, *[F.col(f"_b._row.{c}").alias(c) for c in carry])


def latest_per(rows: DataFrame, by: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """The row of each group with the greatest ``order`` columns."""
    best = rows.groupBy(*by).agg(F.max(F.struct(*order, F.struct(*carry).alias("_row"))).alias("_b"))
    return best.select(*by, *[F.col(f"_b._row.{c}").alias(c) for c in carry])


def largest_part(parts: DataFrame, by: Sequence[str], position: str, ring: str = "ring") -> DataFrame:
    """The part of largest area of each shape, the earlier one of equals: by, position, area_m2."""
    p = parts.withColumn("area_m2", geom.area(F.col(ring)))
    return first_per(p, by, [-F.col("area_m2"), F.col(position)], [position, "area_m2"])


def priority_order(rows: DataFrame, priority: str, row_id: str, number: str = "pos", chunk: int = 1000) -> DataFrame:
    """Number all rows by (priority, id) without one window over all: ranks inside a priority, in chunks
    of ids, plus the rows of lower priorities, of which there are few."""
    ranked = sequenced(rows, [priority], [row_id], F.floor(F.col(row_id) / float(chunk)), number=number)
    sizes = rows.groupBy(priority).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(priority).rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    return ranked.join(before, priority).withColumn(number, F.col(number) + F.coalesce("_before", F.lit(0))).drop("_before")


def manifest(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Manifest rows per job: files, layers, the sources of its layers, totals. Rows, not one array per job.

    files: job_id, name, layer, source_name, size_bytes; sources: source_name, ts (latest date of each).
    """
    one = F.lit(1).cast("bigint")
    rows = files.select("job_id", F.lit("file").alias("part"), "name", F.col("layer").alias("detail"), F.col("size_bytes").alias("n"))
    layers = files.groupBy("job_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.unionByName(layers.select("job_id", F.lit("layer").alias("part"), F.col("layer").alias("name"), F.lit(rules.CALCULATED_ZONE).alias("detail"), "n"))
    used = files.select("job_id", "source_name").distinct().join(sources, "source_name")
    rows = rows.unionByName(used.select("job_id", F.lit("source").alias("part"), F.col("source_name").alias("name"), F.date_format("ts", "yyyy-MM-dd").alias("detail"), one.alias("n")))
    total = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    return rows.unionByName(total.select("job_id", F.lit("total").alias("part"), F.lit("size_bytes").alias("name"), F.col("files").cast("string").alias("detail"), F.col("bytes").alias("n")))


def numbered_surface(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of a surface numbered from 1 row by row (source_id, id, r, c, z), and faces by vertex number (source_id, a, b, d)."""
    full = cells.where(F.col("z").isNotNull())
    num = sequenced(full, ["source_id"], ["r", "c"], F.col("r"), number="id")
    # the numbers take the place of the heights, so a face comes with them: no join of corners
    faces = relief.faces(num.select("source_id", "r", "c", F.col("id").alias("z")))
    return num.select("source_id", "id", "r", "c", "z"), faces.select("source_id", *[F.col(f"fz{i}").alias(n) for i, n in enumerate(("a", "b", "d"))])


def outline_rows(outlines: DataFrame, keys: Sequence[str], rings: str = "rings") -> DataFrame:
    """Vertices of closed outlines without the repeated last one: keys, ring_no (0 outer, then inner rings), pos, x, y."""
    o = outlines.select(*keys, F.posexplode(rings).alias("ring_no", "ring"))
    o = o.select(*keys, "ring_no", F.posexplode(F.slice("ring", F.lit(1), F.size("ring") - 1)).alias("pos", "p"))
    return o.select(*keys, "ring_no", "pos", "p.x", "p.y")


def with_extent(objects: DataFrame, object_id: str, greatest: Sequence[str] = (), label: str = "extent") -> DataFrame:
    """Objects (with minx, miny, maxx, maxy) and a row for the extent of them all; ``greatest`` columns take their maximum."""
    low, high = ("minx", "miny"), ("maxx", "maxy", *greatest)
    e = objects.agg(*[F.min(c).alias(c) for c in low], *[F.max(c).alias(c) for c in high]).withColumn(object_id, F.lit(label))
    return objects.unionByName(e, allowMissingColumns=True)


def check_summary(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Counts and totals of several checks by check type and zone type, with all subtotals (cube).

    Each check: building_id, zone_type (may be null), measure. A building's findings of one kind are added up before the subtotals repeat them.
    """
    rows = None
    for name, found in checks:
        one = found.select(F.lit(name).alias("check_type"), "building_id", F.col("zone_type").cast("string").alias("zone_type"), "measure")
        rows = one if rows is None else rows.unionByName(one)
    each = rows.groupBy("check_type", "zone_type", "building_id").agg(F.count(F.lit(1)).alias("n"), F.sum("measure").alias("total"))
    return each.cube("check_type", "zone_type").agg(
        F.grouping_id().cast("bigint").alias("level"), F.sum("n").alias("n"), F.countDistinct("building_id").alias("n_buildings"), F.sum("total").alias("total")
    )


def unmatched_labels(texts: DataFrame, layer: str, known: Column, blocks: DataFrame, block: str) -> DataFrame:
    """Drawing layers without a known network and free block names, with their counts: name, part, n."""
    count = lambda df, c, part: df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(part))
    return count(texts.where(~F.coalesce(known, F.lit(False))), layer, "layer").unionByName(count(blocks, block, "manhole")).select("name", "part", "n")
