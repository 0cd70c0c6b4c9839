"""Ordered work per key that never puts a whole key into one task.

Rows are split by (key, chunk of the order value). Numbering and neighbour lookups finish with a
tiny table of one row per (key, chunk); sliding windows get a halo of rows from the next chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequenced(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, *,
              number: str | None = None, following: dict[str, str] | None = None,
              preceding: dict[str, str] | None = None, rank: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """row_number / rank / lead / lag by key over ``order`` (ascending, unique), chunk by chunk.

    ``chunk`` must not decrease along ``order``; a null comes first, as nulls do in an order. ``following`` and
    ``preceding`` map an output column to the source column of the next or previous row. ``rank`` is a column name
    and leading columns of ``order`` that decide the chunk: rows equal in them share the number of their first.
    Null keys are a key of their own.

    The input is read and shuffled once: the row per (key, chunk) comes from the rows where they lie, and both sides
    of the join that follows read one exchange. For that every column travels: select what is needed before.
    """
    keys, order = list(keys), list(order)
    following, preceding = following or {}, preceding or {}
    lowest = F.lit(-(1 << 63)).cast("bigint")
    at = F.struct(*keys, F.coalesce(chunk.cast("bigint"), lowest).alias("_ck")).alias("_at")  # never null, so neither side is filtered
    w = Window.partitionBy("_at").orderBy(*order)
    pick = lambda names: F.struct(*[F.col(c).alias(o) for o, c in names.items()])
    new, edge = {}, [F.count(F.lit(1)).alias("_n")]
    if number:
        new["_rn"] = F.row_number().over(w)
    if rank:
        new["_rk"] = F.rank().over(Window.partitionBy("_at").orderBy(*rank[1]))
    if following:
        new["_nx"] = F.lead(pick(following)).over(w)
        edge.append(F.min_by(pick(following), F.struct(*order)).alias("_first"))
    if preceding:
        new["_pv"] = F.lag(pick(preceding)).over(w)
        edge.append(F.max_by(pick(preceding), F.struct(*order)).alias("_last"))
    rows = df.select(at, "*").withColumns(new)
    # behind the generator no column is pruned on one side only, so that the exchange is shared
    rows = rows.select("_at", F.inline(F.array(F.struct(*[c for c in rows.columns if c != "_at"]))))
    whole = Window.partitionBy(*[F.col(f"_at.{k}") for k in keys]).orderBy("_at._ck")
    edges = rows.groupBy("_at").agg(*edge)
    last = {"_before": F.coalesce(F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))}
    if following:
        last["_first"] = F.lead("_first").over(whole)
    if preceding:
        last["_last"] = F.lag("_last").over(whole)
    out = rows.join(edges.select("_at", *[c.alias(n) for n, c in last.items()]), "_at", "left")
    final = {}
    if number:
        final[number] = (F.col("_rn") + F.col("_before")).cast("bigint")
    if rank:
        final[rank[0]] = (F.col("_rk") + F.col("_before")).cast("bigint")
    for o in following:
        final[o] = F.when(F.col("_nx").isNotNull(), F.col(f"_nx.{o}")).otherwise(F.col(f"_first.{o}"))
    for o in preceding:
        final[o] = F.when(F.col("_pv").isNotNull(), F.col(f"_pv.{o}")).otherwise(F.col(f"_last.{o}"))
    return out.withColumns(final).drop("_at", "_rn", "_rk", "_nx", "_pv", "_before", "_first", "_last")


def haloed(df: DataFrame, index: str, chunk: int, halo: int) -> DataFrame:
    """Split an integer axis into chunks and copy border rows to their neighbours.

    Window functions partitioned by ``_ck`` see ``halo`` rows to both sides; keep ``_ck = _home`` after.
    """
    chunk = max(chunk, halo, 1)
    home = F.floor(F.col(index) / float(chunk)).cast("bigint")
    reach = F.array_distinct(F.array(
        home,
        F.floor((F.col(index) - halo) / float(chunk)).cast("bigint"),
        F.floor((F.col(index) + halo) / float(chunk)).cast("bigint"),
    ))
    return df.withColumn("_home", home).withColumn("_ck", F.explode(reach))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("_ck") == F.col("_home")).drop("_ck", "_home")
