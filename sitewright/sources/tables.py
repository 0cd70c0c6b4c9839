"""Checked loads, keyed upserts and file sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom
from sitewright.session import shared_dir


def split_valid(df: DataFrame, reasons: Sequence[tuple[Column, str]]) -> DataFrame:
    """Adds ``part`` ('valid' / 'rejected') and ``reject_reason``: the first failed check names it."""
    reason = F.lit(None).cast("string")
    for failed, text in reversed(list(reasons)):
        reason = F.when(F.coalesce(failed, F.lit(False)), text).otherwise(reason)
    df = df.withColumn("reject_reason", reason)
    return df.withColumn("part", F.when(F.col("reject_reason").isNull(), "valid").otherwise("rejected"))


def require_valid(df: DataFrame) -> DataFrame:
    """Strict mode: the job fails on the first rejected row."""
    return df.where(F.coalesce(F.assert_true(F.col("reject_reason").isNull(), F.col("reject_reason")).isNull(), F.lit(True)))


def zones_from_geojson(spark: SparkSession, path: str, default_status: str = rules.OFFICIAL_ZONE, multi_line: bool = True) -> DataFrame:
    """FeatureCollections to zone rows. ``multi_line=False`` reads one collection per line, which
    splits large inputs; a pretty-printed file needs the other form and is one task.

    A Polygon is one row, a MultiPolygon one row per part (``part_no`` from 1). ``ring`` is the outline
    with its holes cut in (``geom.with_holes``), ``n_holes`` counts them. Other geometries, and those
    without a closed outline, are rejected rows without a ring.
    """
    schema = (
        "features array<struct<geometry:struct<type:string,coordinates:string>,"
        "properties:struct<zone_type:string,status:string,regime:string,registry_number:string,document_basis:string>>>"
    )
    return _zone_rows(spark.read.schema(schema).json(path, multiLine=multi_line), default_status)


def _zone_rows(files: DataFrame, default_status: str) -> DataFrame:
    f = files.select(F.explode("features").alias("f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    one = "array<array<array<double>>>"
    parts = F.when(kind == "Polygon", F.array(F.from_json(raw, one))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{one}>"))
    f = f.select("f.properties.*", kind.alias("geometry_type"), F.posexplode_outer(parts).alias("part_no", "_part"))
    points = lambda r: F.transform(r, lambda p: geom.point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    whole = lambda r: (F.size(r) >= 4) & F.forall(r, lambda p: p.x.isNotNull() & p.y.isNotNull())
    f = f.withColumn("_rings", F.transform("_part", points))
    outer, holes = F.get("_rings", F.lit(0)), F.filter(F.slice("_rings", 2, F.greatest(F.size("_rings") - 1, F.lit(0))), whole)
    f = f.withColumns({"ring": F.when(whole(outer), geom.with_holes(outer, holes)), "n_holes": F.size(holes), "part_no": F.coalesce(F.col("part_no") + 1, F.lit(1))})
    return checked_zones(f.drop("_part", "_rings"), default_status)


def checked_zones(rows: DataFrame, default_status: str = rules.OFFICIAL_ZONE) -> DataFrame:
    """Default status; a zone needs a type and an outline, an official zone needs a registry number."""
    rows = rows.withColumn("status", F.coalesce("status", F.lit(default_status)))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    shape = [(F.col("ring").isNull(), "no polygon geometry")] if "ring" in rows.columns else []
    return split_valid(rows, [
        (blank("zone_type"), "no zone_type"),
        ((F.col("status") == rules.OFFICIAL_ZONE) & blank("registry_number"), "official zone without registry number"),
        *shape,
    ])


def checked_directory(rows: DataFrame, channel: str = "application_channel") -> DataFrame:
    return split_valid(rows, [(~F.coalesce(F.col(channel).isin(*rules.APPLICATION_CHANNELS), F.lit(False)), "unknown application channel")])


def import_log_rows(rows: DataFrame) -> DataFrame:
    """Source timestamp as given, load timestamp now."""
    return rows.withColumn("imported_at", F.current_timestamp())


def upsert_last(target: DataFrame | None, batch: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """Keyed upsert, last write wins by ``seq``. max_by combines on the map side, so a hot key stays small."""
    rows = batch if target is None else target.unionByName(batch, allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in key and c != seq]
    best = rows.groupBy(*key).agg(F.max(F.struct(F.col(seq), *[F.col(c) for c in rest])).alias("_b"))
    return best.select(*key, "_b.*")


def upsert_touch(target: DataFrame, batch: DataFrame, key: Sequence[str], touched: str, order: str) -> DataFrame:
    """Insert new keys; a repeated key only takes the batch's ``touched`` time and keeps its values."""
    t = target.withColumns({"_old": F.lit(0)})
    b = batch.withColumns({"_old": F.lit(1)})
    rows = t.unionByName(b)
    rest = [c for c in target.columns if c not in (*key, touched)]
    g = rows.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct("_old", order)).alias("_first"), F.max(touched).alias(touched)
    )
    return g.select(*key, "_first.*", touched)


def missing_keys(wanted: DataFrame, have: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work list: keys asked for that are not there yet."""
    return wanted.join(have.select(*key), list(key), "left_anti")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str, partition_by: Sequence[str] = (), fmt: str = "parquet", **options) -> DataFrame:
    """Write to a fresh folder in the shared location and read it back with the same schema."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return spark.read.format(fmt).options(**options).schema(df.schema).load(path)


def flatten_attributes(df: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """struct<value, confidence> columns to ``attr`` and ``attr_confidence``."""
    rest = [c for c in df.columns if c not in attributes]
    flat = []
    for a in attributes:
        flat += [F.col(f"{a}.value").alias(a), F.col(f"{a}.confidence").alias(f"{a}_confidence")]
    return df.select(*rest, *flat)


def zone_export(zones: DataFrame) -> DataFrame:
    """Fixed column order, nulls as empty text (spreadsheet export)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return zones.select(
        "id", F.col("zone_type").alias("kind"), "status", text("registry_number").alias("registry_number"),
        text("regime").alias("regime"), text("document_basis").alias("document_basis"),
        text("source_name").alias("source_name"), F.date_format("data_timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("data_date"),
    )


def exchange_parts(requested: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Requested keys that can be copied and those that are missing."""
    have = inventory.select(key).distinct()
    found = requested.join(have, key, "left_semi").withColumn("part", F.lit("exported"))
    lost = requested.join(have, key, "left_anti").withColumn("part", F.lit("missing"))
    return found.unionByName(lost)
