"""Terrain rasters as cell tables: text grids in, cells out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text_grid(spark: SparkSession, path: str, nodata: float = -9999.0) -> DataFrame:
    """Lines of ``source_id row z0 z1 ... zn``: one row of the grid per line, so a large raster
    splits by lines. No-data and unreadable values become null."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    cells = parts.select(
        F.get("p", F.lit(0)).try_cast("bigint").alias("source_id"), F.get("p", F.lit(1)).try_cast("int").alias("r"),
        F.posexplode(F.slice(F.col("p"), F.lit(3), F.greatest(F.size("p") - 2, F.lit(0)))).alias("c", "t"),
    )
    z = F.col("t").try_cast("double")
    return cells.select("source_id", "r", "c", F.when(~F.isnan(z) & (z != nodata), z).alias("z"))


def grid_lines(cells: DataFrame, block: int = 512, nodata: float = -9999.0) -> DataFrame:
    """Text lines of at most ``block`` cells each, for writing: ``source_id row first_col z...``.

    A line is a bounded group, however wide the raster is.
    """
    b = cells.withColumn("_b", F.floor(F.col("c") / float(block)).cast("bigint"))
    z = F.coalesce(F.col("z"), F.lit(nodata)).cast("string")
    g = b.groupBy("source_id", "r", "_b").agg(F.array_sort(F.collect_list(F.struct("c", z.alias("z")))).alias("v"))
    text = F.concat_ws(" ", F.col("source_id").cast("string"), F.col("r").cast("string"), F.get("v", F.lit(0)).c.cast("string"),
                       F.array_join(F.transform("v", lambda s: s.z), " "))
    return g.select(text.alias("value"))


def read_grid_lines(spark: SparkSession, path: str, nodata: float = -9999.0) -> DataFrame:
    parts = spark.read.text(path).select(F.split("value", " ").alias("p"))
    first = F.get("p", F.lit(2)).cast("int")
    cells = parts.select(
        F.get("p", F.lit(0)).cast("bigint").alias("source_id"), F.get("p", F.lit(1)).cast("int").alias("r"), first.alias("c0"),
        F.posexplode(F.slice(F.col("p"), F.lit(4), F.size("p") - 3)).alias("i", "t"),
    )
    z = F.col("t").try_cast("double")
    return cells.select("source_id", "r", (F.col("c0") + F.col("i")).alias("c"), F.when(~F.isnan(z) & (z != nodata), z).alias("z"))
