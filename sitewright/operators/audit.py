"""Completeness of map data, layer counts, planting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom
from sitewright.functions import tags as tg
from sitewright.operators.chunks import sequenced
from sitewright.operators.spatial import spread


def within_boundary(elements: DataFrame, ring, x: str = "x", y: str = "y") -> DataFrame:
    """Elements meeting the boundary; those without geometry drop out."""
    return elements.where(F.col(x).isNotNull() & geom.covers(F.col(x), F.col(y), ring))


def label_table(spark: SparkSession, labels: Sequence[str], name: str = "layer") -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias(name))


def zero_filled(counts: DataFrame, labels: Sequence[str], name: str = "layer", value: str = "n", groups: DataFrame | None = None) -> DataFrame:
    """Counts for every label of a fixed short list, for each row of ``groups`` (such as sites) where given."""
    every = label_table(counts.sparkSession, labels, name)
    if groups is not None:
        every = groups.withColumn(name, F.explode(F.array(*map(F.lit, labels))))
    return every.join(counts, every.columns, "left").withColumn(value, F.coalesce(value, F.lit(0)).cast("bigint"))


def completeness(elements: DataFrame, key: Sequence[str] = (), tags: str = "tags") -> DataFrame:
    """label, total, complete, ratio: tagged layers and plain counts, all from one pass."""
    t = F.col(tags)
    b, h = tg.is_building(t), tg.is_highway(t)
    has = lambda k: tg.has_tag(t, k)
    n = lambda c: F.count_if(c)
    g = elements.groupBy(*key).agg(
        n(b).alias("nb"), n(b & (has("height") | has("building:levels"))).alias("cb"), n(h).alias("nh"),
        n(h & has("surface")).alias("cs"), n(h & has("lanes")).alias("cl"), n(tg.is_courtyard_driveway(t)).alias("cd"),
        n(tg.is_power_pole(t)).alias("pp"), n(tg.is_tree(t)).alias("tr"),
    )
    row = lambda label, total, done: F.struct(F.lit(label).alias("label"), F.col(total).alias("total"), F.col(done).alias("complete"))
    rows = g.select(*key, F.explode(F.array(
        row("buildings_with_levels", "nb", "cb"), row("roads_with_surface", "nh", "cs"), row("roads_with_lanes", "nh", "cl"),
        row("courtyard_driveways", "cd", "cd"), row("power_poles", "pp", "pp"), row("trees", "tr", "tr"),
    )).alias("_r"))
    rows = rows.select(*key, "_r.*")
    return rows.withColumn("ratio", F.coalesce(F.try_divide(F.col("complete").cast("double"), F.col("total")), F.lit(0.0)))


TAGGED = ("buildings_with_levels", "roads_with_surface", "roads_with_lanes")


def decisions(report: DataFrame, good: float = rules.GOOD_RATIO, poor: float = rules.POOR_RATIO) -> DataFrame:
    good_text, mid_text, bad_text = rules.DECISIONS
    d = F.when(F.col("ratio") >= good, good_text).when(F.col("ratio") >= poor, mid_text).otherwise(bad_text)
    return report.where(F.col("label").isin(*TAGGED)).withColumn("decision", d)


def against_reference(report: DataFrame, reference: DataFrame) -> DataFrame:
    """Found vs reference counts for labels known to both. reference: label, reference."""
    j = report.select("label", F.col("complete").alias("found")).join(reference, "label")
    return j.withColumns({
        "missing": F.greatest(F.col("reference") - F.col("found"), F.lit(0)),
        "coverage": F.when(F.col("reference") == 0, 1.0).otherwise(F.try_divide(F.col("found").cast("double"), F.col("reference"))),
    })


def layer_summary(features: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Features per layer plus the total row (null layer), within each ``by`` group where given."""
    rows = features.select(*by, F.explode(F.array(F.struct(F.col("layer").alias("layer"), F.lit(0).alias("g")), F.struct(F.lit(None).cast("string").alias("layer"), F.lit(1).alias("g")))).alias("r"))
    return rows.groupBy(*by, "r.layer", "r.g").agg(F.count(F.lit(1)).alias("n")).drop("g") if by else features.rollup("layer").agg(F.count(F.lit(1)).alias("n"))


def scatter(areas: DataFrame, area_id: str, count: str, seed: int = 0, ring: str = "ring", block: int = 256) -> DataFrame:
    """``count`` points inside each area that has an inside.

    Candidates in the box come from a hash of (area, index, seed), so the result does not depend on
    how Spark splits the work. Their number follows from the share of the box that the area fills,
    with ten standard deviations to spare, so thin and angular areas get all their points too. An area
    is cut into blocks of indexes; the first ``count`` hits are found from block totals. Points are made
    once for the totals and once for good, so they are not shuffled: only those of a block that holds the
    last hit are numbered.
    """
    a = geom.with_bbox(areas, ring, "_").where(F.col(count) > 0)
    share = geom.area(F.col(ring)) / ((F.col("_maxx") - F.col("_minx")) * (F.col("_maxy") - F.col("_miny")))
    a = spread(a.withColumn("_share", share).where(F.col("_share") > 0), area_id)
    tries = F.ceil((F.col(count) + 10 * F.sqrt(F.col(count)) + 50) / F.least("_share", F.lit(1.0)))
    a = a.withColumns({"_tries": tries.cast("bigint"), "_rect": geom.is_rect(F.col(ring))})
    a = a.withColumn("_nb", F.ceil(F.col("_tries") / float(block)).cast("bigint"))
    a = a.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)))
    unit = lambda salt: F.pmod(F.xxhash64(F.col(area_id), F.col("i"), F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    x, y = F.col("x"), F.col("y")
    in_box = (x > F.col("_minx")) & (x < F.col("_maxx")) & (y > F.col("_miny")) & (y < F.col("_maxy"))

    def hits(blocks: DataFrame) -> DataFrame:
        top = F.least((F.col("_b") + 1) * block, F.col("_tries"))
        h = blocks.withColumn("i", F.explode(F.sequence(F.col("_b") * block, top - 1)))
        h = h.withColumns({
            "x": F.col("_minx") + unit(1) * (F.col("_maxx") - F.col("_minx")), "y": F.col("_miny") + unit(2) * (F.col("_maxy") - F.col("_miny")),
        })
        return h.where(F.when(F.col("_rect"), in_box).otherwise(geom.contains(x, y, F.col(ring))))

    n = hits(a).groupBy(F.col(area_id).alias("_id"), F.col("_b").alias("_blk")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(count).alias("_lo"), F.max(count).alias("_hi")
    )
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_id").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("_prior", before).where(F.col("_prior") < F.col("_hi"))
    n = n.select("_id", "_blk", "_prior", (F.col("_prior") + F.col("_n") <= F.col("_lo")).alias("_whole"))
    a = a.join(n, F.col(area_id).eqNullSafe(F.col("_id")) & (F.col("_b") == F.col("_blk")))
    out = [area_id, "i", "x", "y"]
    cut = sequenced(hits(a.where("NOT _whole")).select(*out, count, "_b", "_prior"), [area_id, "_b"], ["i"], F.lit(0), number="rn")
    return hits(a.where("_whole")).select(*out).unionByName(cut.where(F.col("_prior") + F.col("rn") <= F.col(count)).select(*out))
