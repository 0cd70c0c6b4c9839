"""Spatial joins as equi-joins on grid cells.

* Boxes live on the grid level whose cell is at least as large as the box, whatever its size, so each
  covers at most four cells; points carry one cell per level that occurs among the boxes (a scalar
  subquery over the box columns: an array of at most 61 numbers). A pair meets exactly once.
* A hot cell (one cell may hold a third of all rows) is split by adaptive skew handling, which cuts
  the hot partition at run time; nothing is repeated for keys that are not hot.
* Exact predicates run right behind the join, inside the same stage.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions import geom
from sitewright.sources.tables import write_and_read

BOX = ("minx", "miny", "maxx", "maxy")


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salt_by: Sequence[str], how: str = "inner",
                fan: int = 1, small: bool = True) -> DataFrame:
    """Equi-join whose left rows of one key are spread over ``fan`` tasks.

    By default it is a plain join: adaptive execution splits the partitions of a hot key at run time
    (``spark.sql.adaptive.skewJoin``). A larger ``fan`` repeats the right side that many times, so it
    is only for a right side known to be tiny, with few distinct keys, such as the coarse cells of a
    group. ``salt_by`` must identify left rows, so that copies spread as well. With ``small`` unset both
    sides may be large whatever the planner guesses from compressed files, and neither goes through the driver.
    """
    keys = list(keys)
    if fan <= 1:
        return left.join(right if small else right.hint("merge"), keys, how)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(fan)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Even out rows before each of them is exploded into very many: a fixed partition number keeps
    adaptive execution from merging the small input into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def _cell(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("bigint")


TOP = 60


def _level(box: Sequence[str], cell: float, levels: int | None, reach) -> Column:
    """Power of two of the smallest cell that is as large as the box."""
    side = F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1])) + 2.0 * reach
    out = F.greatest(F.ceil(F.log2(F.greatest(side, F.lit(cell)) / cell)).cast("int"), F.lit(0))
    return F.least(out, F.lit(TOP if levels is None else levels - 1))


def _present(df: DataFrame, level: str, levels: int | None) -> Column:
    """Levels that occur in a column, or all of a given number of levels."""
    if levels is not None:
        return F.array(*[F.lit(i) for i in range(levels)])
    return df.agg(F.array_sort(F.collect_set(level))).scalar()


def _size(level: Column, cell: float) -> Column:
    return F.lit(float(cell)) * F.pow(F.lit(2.0), level.cast("double"))


def _explode_cells(df: DataFrame, box: Sequence[str], size: Column, reach) -> DataFrame:
    x0, y0, x1, y1 = (F.col(b) for b in box)
    span = lambda a, b: F.sequence(_cell(a - reach, size), _cell(b + reach, size))
    return df.withColumn("_cx", F.explode(span(x0, x1))).withColumn("_cy", F.explode(span(y0, y1)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, *, cell: float, point_id: Sequence[str],
                    by: Sequence[str] = (), x: str = "x", y: str = "y", box: Sequence[str] = BOX,
                    reach=0.0, levels: int | None = None, fan: int = 1, small: bool = False) -> DataFrame:
    """Every (point, box) pair with the point in the box grown by ``reach``, each pair once.

    Column names of the two sides must differ, except ``by``. ``small`` lets a side that is known to be small be broadcast. ``levels`` fixes the number of levels where
    the boxes are dear to compute and of known sizes; larger ones then cover more cells.
    """
    reach = F.lit(float(reach)) if not isinstance(reach, Column) else reach
    b = boxes.withColumns({"_lv": _level(box, cell, levels, reach), "_reach": reach})
    p = points.withColumn("_lv", F.explode(_present(b, "_lv", levels)))
    size = _size(F.col("_lv"), cell)
    p = p.withColumns({"_cx": _cell(F.col(x), size), "_cy": _cell(F.col(y), size)})
    b = _explode_cells(b, box, size, F.col("_reach"))
    keys = [*by, "_lv", "_cx", "_cy"]
    pairs = salted_join(p, b, keys, point_id, fan=fan, small=small)
    r = F.col("_reach")
    inside = (
        (F.col(x) >= F.col(box[0]) - r) & (F.col(x) <= F.col(box[2]) + r)
        & (F.col(y) >= F.col(box[1]) - r) & (F.col(y) <= F.col(box[3]) + r)
    )
    return pairs.where(inside).drop("_lv", "_cx", "_cy", "_reach")


GROUP = 4096


def points_by_cells(points: DataFrame, boxes: DataFrame, *, cell: float, point_id: str, box: Sequence[str] = BOX, reach: float = 0.0) -> tuple[DataFrame, list[str]]:
    """Candidates for points in a box grown by ``reach``, and the columns of their groups: all pairs of a point lie in one group.

    So what follows per point, such as ranking, needs no shuffle of pairs. Boxes meet the cells that hold points, whatever their size; a group is
    at most about ``GROUP`` points of a cell. Partitions are many and of a fixed number: the sides are small against their pairs.
    """
    x, y, size = F.col("x"), F.col("y"), F.lit(float(cell))
    p = points.withColumns({"_cx": _cell(x, size), "_cy": _cell(y, size)}).where(F.col("_cx").isNotNull() & F.col("_cy").isNotNull())
    cells = p.groupBy("_cx", "_cy").agg(F.ceil(F.count(F.lit(1)) / float(GROUP)).cast("bigint").alias("_parts"))
    corners = {"_ax": F.col("_cx") * size, "_ay": F.col("_cy") * size, "_bx": (F.col("_cx") + 1) * size, "_by": (F.col("_cy") + 1) * size}
    met = box_pairs(
        cells.select("_parts", F.col("_cx").alias("_gx"), F.col("_cy").alias("_gy"), *[v.alias(k) for k, v in corners.items()]), boxes,
        cell=cell, left_id=["_gx", "_gy"], lbox=list(corners), rbox=box, reach=reach + 1e-6,
    )
    met = met.drop(*corners).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    p = p.join(cells.hint("merge"), ["_cx", "_cy"]).withColumn("_part", F.pmod(F.xxhash64(point_id), F.col("_parts"))).drop("_parts")
    group = ["_cx", "_cy", "_part"]
    n = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p, met = p.repartition(n, *group), met.withColumnsRenamed({"_gx": "_cx", "_gy": "_cy"}).repartition(n, *group)
    a, b, c, d = (F.col(v) for v in box)
    inside = (x >= a - reach) & (x <= c + reach) & (y >= b - reach) & (y <= d + reach)
    return p.join(met.hint("merge"), group).where(inside), group


def box_pairs(left: DataFrame, right: DataFrame, *, cell: float, left_id: Sequence[str], by: Sequence[str] = (),
              lbox: Sequence[str], rbox: Sequence[str], reach: float = 0.0, levels: int | None = None,
              fan: int = 1, small: bool = False) -> DataFrame:
    """Every pair of boxes within ``reach`` of each other (box distance per axis), each pair once.

    Pairs meet on the coarser of their two levels, in the cell of the lower-left corner of the
    common box, so no distinct is needed. A box is repeated only on coarser levels of the other side.
    """
    l = left.withColumn("_ll", _level(lbox, cell, levels, reach))
    r = right.withColumn("_rl", _level(rbox, cell, levels, 0.0))
    size = _size(F.col("_lv"), cell)

    ll, rl = F.col("_ll"), F.col("_rl")
    keys = [*by, "_lv", "_cx", "_cy"]

    def native(df, level, box, rch):
        return _explode_cells(df.withColumn("_lv", level), box, size, rch)

    def above(df, other, name, box, rch, wanted):
        up = df.withColumn("_up", _present(other, name, levels)).withColumn("_lv", F.explode(F.filter("_up", wanted))).drop("_up")
        return _explode_cells(up, box, size, rch)

    l_up = above(l, r, "_rl", lbox, reach, lambda v: v >= ll)
    r_native = native(r, rl, rbox, 0.0)
    l_native = native(l, ll, lbox, reach)
    r_above = above(r, l, "_ll", rbox, 0.0, lambda v: v > rl)
    pairs = salted_join(l_up, r_native, keys, left_id, fan=fan, small=small).unionByName(
        salted_join(l_native, r_above, keys, left_id, fan=fan, small=small)
    )
    ax0, ay0, ax1, ay1 = (F.col(c) for c in lbox)
    bx0, by0, bx1, by1 = (F.col(c) for c in rbox)
    meet = (
        (ax0 - reach <= bx1) & (bx0 <= ax1 + reach) & (ay0 - reach <= by1) & (by0 <= ay1 + reach)
    )
    once = (F.col("_cx") == _cell(F.greatest(ax0 - reach, bx0), size)) & (
        F.col("_cy") == _cell(F.greatest(ay0 - reach, by0), size)
    )
    return pairs.where(meet & once).drop("_lv", "_cx", "_cy", "_ll", "_rl")


def points_near_paths(points: DataFrame, paths: DataFrame, *, cell: float, point_id: Sequence[str], path: str = "path", reach=0.0) -> DataFrame:
    """Candidates for points within ``reach`` of a path: every pair with the point in a cell that the grown path runs through, each once.

    Unlike its box, the cells of a slanted path hold little more than what is near it. A path lies on one level, where its box is
    at most 32 cells wide, so it has a bounded number of cells whatever its length; a point carries one cell per level that occurs.
    """
    r = reach if isinstance(reach, Column) else F.lit(float(reach))
    box = ["_minx", "_miny", "_maxx", "_maxy"]
    l = geom.with_bbox(paths.withColumn("_reach", r), path, "_")
    l = l.withColumn("_lv", _level(box, cell * 32.0, None, F.col("_reach"))).drop(*box)
    p = points.withColumn("_lv", F.explode(_present(l, "_lv", None)))
    size = _size(F.col("_lv"), cell)
    p = p.withColumns({"_cx": _cell(F.col("x"), size), "_cy": _cell(F.col("y"), size)})
    l = geom.fenced(spread(l, "_lv", path), _size=size, _grow=F.col("_reach") + 1e-6)
    l = l.withColumn("_c", F.explode(_path_cells(F.col(path), F.col("_size"), F.col("_grow"))))
    l = l.withColumns({"_cx": F.col("_c.cx"), "_cy": F.col("_c.cy")}).drop("_c", "_size", "_grow", "_reach")
    return salted_join(p, l, ["_lv", "_cx", "_cy"], point_id, small=False).drop("_lv", "_cx", "_cy")


def _path_cells(path: Column, size: Column, grow: Column) -> Column:
    """Distinct cells (cx, cy) that may hold a point within ``grow`` of the path: column by column, the rows of the part of each segment near it."""
    first = F.get(path, F.lit(0))
    one = F.array(F.struct(first.x.alias("x0"), first.y.alias("y0"), first.x.alias("x1"), first.y.alias("y1")))

    def of_segment(s):
        dx, dy = s.x1 - s.x0, s.y1 - s.y0
        minx, maxx, miny, maxy = F.least(s.x0, s.x1), F.greatest(s.x0, s.x1), F.least(s.y0, s.y1), F.greatest(s.y0, s.y1)

        def of_column(cx):
            at = lambda x: F.when(dx == 0, s.y0).otherwise(s.y0 + (x - s.x0) * (dy / F.when(dx != 0, dx)))
            ya, yb = at(F.greatest(cx * size - grow, minx)), at(F.least((cx + 1) * size + grow, maxx))
            low = F.when(dx == 0, miny).otherwise(F.greatest(F.least(ya, yb), miny))
            high = F.when(dx == 0, maxy).otherwise(F.least(F.greatest(ya, yb), maxy))
            rows = F.sequence(_cell(low - grow, size), _cell(high + grow, size))
            return F.transform(rows, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))

        known = s.x0.isNotNull() & s.y0.isNotNull() & s.x1.isNotNull() & s.y1.isNotNull()
        columns = F.when(known, F.sequence(_cell(minx - grow, size), _cell(maxx + grow, size)))
        return F.flatten(F.transform(F.coalesce(columns, F.array().cast("array<bigint>")), of_column))

    return F.array_distinct(F.flatten(F.transform(F.when(F.size(path) == 1, one).otherwise(geom.segments(path)), of_segment)))


def segments_near_boxes(segs: DataFrame, boxes: DataFrame, *, cell: float, seg_id: Sequence[str], reach: float, xy: Sequence[str] = ("x0", "y0", "x1", "y1"),
                        box: Sequence[str] = BOX) -> DataFrame:
    """Candidates for segments within ``reach`` of a box: every such pair once, and few others.

    Unlike its box, the cells of a slanted segment hold little more than what is near it. A box lies on the level where it is at most two cells
    wide; a segment has the cells of each level that occurs, column by column the rows near its part there. Rows rise or fall steadily from
    column to column, so the columns that a pair has in common lie side by side: it counts in the first of them, in the lowest common row.
    What the line of the segment leaves further to one side is dropped in the join itself.
    """
    x0, y0, x1, y1 = (F.col(c) for c in xy)
    a, b, c, d = (F.col(v) for v in box)
    r = boxes.dropna(subset=list(box)).withColumn("_lv", _level(box, cell * 2.0, None, 0.0))
    size = _size(F.col("_lv"), cell)
    s = spread(segs.dropna(subset=list(xy))).withColumn("_lv", F.explode(_present(r, "_lv", None)))
    grow = reach + 1e-6
    minx, maxx, miny, maxy = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)
    s = geom.fenced(s, _size=size, _slope=F.when(x1 != x0, (y1 - y0) / (x1 - x0)), _first=_cell(minx - grow, size))
    s = s.withColumn("_cx", F.explode(F.sequence("_first", _cell(maxx + grow, F.col("_size")))))

    def rows(cx):
        at = lambda x: F.coalesce(y0 + (x - x0) * F.col("_slope"), y0)
        ya, yb = at(F.greatest(cx * F.col("_size") - grow, minx)), at(F.least((cx + 1) * F.col("_size") + grow, maxx))
        low = F.when(F.col("_slope").isNull(), miny).otherwise(F.greatest(F.least(ya, yb), miny))
        high = F.when(F.col("_slope").isNull(), maxy).otherwise(F.least(F.greatest(ya, yb), maxy))
        return _cell(low - grow, F.col("_size")), _cell(high + grow, F.col("_size"))

    (low, high), (was_low, was_high) = rows(F.col("_cx")), rows(F.col("_cx") - 1)
    before = F.col("_cx") > F.col("_first")
    none = F.lit(1 << 62)
    s = geom.fenced(s, _low=low, _high=high, _was_low=F.when(before, was_low).otherwise(none), _was_high=F.when(before, was_high).otherwise(-none))
    s = s.withColumn("_cy", F.explode(F.sequence("_low", "_high"))).drop("_size", "_slope", "_first", "_high").dropna(subset=["_low", "_was_low", "_was_high"])
    r = r.withColumns({"_bx0": _cell(a, size), "_by0": _cell(b, size), "_by1": _cell(d, size)})
    r = _explode_cells(r, box, size, F.lit(0.0)).dropna(subset=["_bx0", "_by0", "_by1"])
    pairs = salted_join(s, r, ["_lv", "_cx", "_cy"], seg_id, small=False)
    once = (F.col("_cy") == F.greatest("_low", "_by0")) & ((F.col("_cx") == F.col("_bx0")) | (F.col("_was_low") > F.col("_by1")) | (F.col("_was_high") < F.col("_by0")))
    dx, dy = x1 - x0, y1 - y0
    # twice the distance of the box centre from the line, against the half sides seen along it
    aside = F.abs(dx * (b + d - y0 - y0) - dy * (a + c - x0 - x0)) <= F.abs(dy) * (c - a) + F.abs(dx) * (d - b) + 2.0 * grow * F.sqrt(dx * dx + dy * dy)
    beside = (minx - grow <= c) & (maxx + grow >= a) & (miny - grow <= d) & (maxy + grow >= b)
    return pairs.where(once & beside & aside).drop("_lv", "_cx", "_cy", "_low", "_was_low", "_was_high", "_bx0", "_by0", "_by1")


FINER = 8


def first_cover(points: DataFrame, areas: DataFrame, inside: Callable[[Column, Column, Column], Column], *, cell: float,
                point_id: Sequence[str], by: Sequence[str] = (), order: Column | None = None, ring: str = "ring",
                box: Sequence[str] = BOX) -> DataFrame:
    """Ids of the points that lie inside some area, with the least ``order`` among these areas as _best.

    Each area is cut into cells an eighth as large as those of its level. The least area that covers a cell wholly
    settles the cell's points without a test, so only areas before it, whose outline runs through the cell, are tested
    for each point: however many areas lie on a spot, few are met there. Without ``order`` a covered cell needs no test
    at all. ``points``: by, point_id, x, y; ``inside(x, y, ring)`` is the exact test.
    """
    keys = [*by, "_lv", "_cx", "_cy"]
    value = F.struct(F.lit(True).alias("hit")) if order is None else order
    size = _size(F.col("_lv"), cell / FINER)
    a = areas.where(F.col(ring).isNotNull()).select(*by, value.alias("_best"), F.col(ring).alias("_ring"), *box).withColumn("_lv", _level(box, cell, None, 0.0))
    p = points.select(*by, *point_id, "x", "y").withColumn("_lv", F.explode(_present(a, "_lv", None)))
    p = p.withColumns({"_cx": _cell(F.col("x"), size), "_cy": _cell(F.col("y"), size)})
    a = _area_cells(a, box, size)
    whole = a.where("_full").groupBy(*keys).agg(F.min("_best").alias("_whole"))
    part = a.where("NOT _full").join(whole.hint("merge"), keys, "left")
    part = part.where(F.col("_whole").isNull() if order is None else F.col("_whole").isNull() | (F.col("_best") <= F.col("_whole")))
    tests = part.select(*keys, "_best", "_ring").unionByName(whole.select(*keys, F.col("_whole").alias("_best")), allowMissingColumns=True)
    hits = salted_join(p, tests, keys, point_id, small=False)
    hits = hits.where(F.col("_ring").isNull() | inside(F.col("x"), F.col("y"), F.col("_ring")))
    return hits.groupBy(*point_id).agg(F.min("_best").alias("_best"))


def _area_cells(areas: DataFrame, box: Sequence[str], size: Column) -> DataFrame:
    """The cells of each area's box (_cx, _cy) and whether the area ``_ring`` covers the cell wholly (_full)."""
    x0, y0, x1, y1 = (F.col(b) for b in box)
    a = _explode_cells(spread(areas.withColumn("_rect", geom.is_rect(F.col("_ring")))), box, size, F.lit(0.0))
    # the cell with a margin, so that rounding in its number cannot move a point out of it
    m = size * 1e-6
    cx0, cy0 = F.col("_cx") * size - m, F.col("_cy") * size - m
    cx1, cy1 = (F.col("_cx") + 1) * size + m, (F.col("_cy") + 1) * size + m
    in_box = (x0 < cx0) & (cx1 < x1) & (y0 < cy0) & (cy1 < y1)
    in_ring = ~geom.paths_touch(geom.rect_ring(cx0, cy0, cx1, cy1), F.col("_ring")) & geom.contains(cx0, cy0, F.col("_ring"))
    return a.withColumn("_full", in_box & (F.col("_rect") | in_ring))


def along_cells(segs: DataFrame, size: Column, xy: Sequence[str] = ("x0", "y0", "x1", "y1"), within: Sequence[Column] | None = None) -> DataFrame:
    """A row for each cell that a segment runs through: _cx, _cy, column by column the rows of its part there.

    The segment has a point in each of these cells grown by half a millionth of its size, and every cell that holds
    one of its points is among them. ``within``: first and last column, first and last row to look at.
    """
    x0, y0, x1, y1 = (F.col(c) for c in xy)
    m = size * 0.5e-6
    minx, maxx, miny, maxy = F.least(x0, x1), F.greatest(x0, x1), F.least(y0, y1), F.greatest(y0, y1)

    def cells(low: Column, high: Column, k: int) -> Column:
        first, last = _cell(low - m, size), _cell(high + m, size)
        if within is not None:
            first, last = F.greatest(first, within[k]), F.least(last, within[k + 1])
        return F.explode(F.when((first <= last) & x0.isNotNull() & x1.isNotNull() & y0.isNotNull() & y1.isNotNull(), F.sequence(first, last)))

    out = segs.withColumn("_cx", cells(minx, maxx, 0))
    at = lambda x: y0 + (x - x0) * ((y1 - y0) / F.when(x1 != x0, x1 - x0))
    ya, yb = at(F.greatest(F.col("_cx") * size - m, minx)), at(F.least((F.col("_cx") + 1) * size + m, maxx))
    low = F.when(x1 == x0, miny).otherwise(F.greatest(F.least(ya, yb), miny))
    high = F.when(x1 == x0, maxy).otherwise(F.least(F.greatest(ya, yb), maxy))
    return out.withColumn("_cy", cells(low, high, 1 if within is None else 2))


def _meets_box(box: Sequence[str], slack: float = 1e-6) -> Column:
    """Whether the segment x0, y0, x1, y1 meets the box: null where it is too near to its outline to tell, or has no length."""
    x0, y0, x1, y1, a, b, c, d = (F.col(v) for v in ("x0", "y0", "x1", "y1", *box))
    dx, dy = x1 - x0, y1 - y0
    sides = [dx * (y - y0) - dy * (x - x0) for x in (a, c) for y in (b, d)]
    near = slack * F.sqrt(dx * dx + dy * dy)
    gap = F.greatest(a - F.greatest(x0, x1), F.least(x0, x1) - c, b - F.greatest(y0, y1), F.least(y0, y1) - d)
    apart = (gap > slack) | (F.least(*sides) > near) | (F.greatest(*sides) < -near)
    return F.when(near > slack * slack, F.when(apart, F.lit(False)).when((gap < -slack) & (F.least(*sides) < -near) & (F.greatest(*sides) > near), F.lit(True)))


LONG = 1024


def first_met(areas: DataFrame, paths: DataFrame, *, area_id: Sequence[str], by: Sequence[str], ring: str, path: str, order: Column,
              cell: float) -> DataFrame:
    """Ids of the areas that some path meets, with the least ``order`` among these paths: _first = struct(ord).

    Areas are cut into cells as by ``first_cover``, segments into the cells they run through. A path in a cell that lies wholly
    inside an area meets it, so the least path of these cells bounds the result without a test. Only segments before that
    bound are tested, and only in the cells of the outline: however many paths meet an area, few are tested for it. Segments
    longer than ``LONG`` of the smallest cells are few where areas are small; they meet the areas' boxes.
    """
    ids = list(dict.fromkeys([*area_id, *by]))
    keys = [*by, "_lv", "_cx", "_cy"]
    box = ["_minx", "_miny", "_maxx", "_maxy"]
    size = _size(F.col("_lv"), cell / FINER)
    a = areas.select(*ids, F.col(ring).alias("_ring")).where(F.col("_ring").isNotNull()).dropna(subset=ids)
    boxed = geom.with_bbox(a, "_ring", "_")
    a = boxed.withColumn("_lv", _level(box, cell, None, 0.0))
    cut = _area_cells(a, box, size)

    s = paths.select(*by, F.struct(order.alias("ord")).alias("_o"), F.explode(geom.segments(F.col(path))).alias("_s")).select(*by, "_o", "_s.*")
    side = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    long = side > LONG * cell / FINER
    r = spread(s.where(~long)).withColumn("_lv", F.explode(_present(a, "_lv", None)))
    r = along_cells(r, size)
    least = r.groupBy(*keys).agg(F.min("_o").alias("_least"))
    inner = cut.where("_full").select(*ids, "_lv", "_cx", "_cy").join(least.hint("merge"), keys)
    bound = write_and_read(inner.groupBy(*ids).agg(F.min("_least").alias("_first")), "bounds")

    edge = cut.where("NOT _full").join(bound, ids, "left").select(*ids, "_lv", "_cx", "_cy", "_ring", *box, "_first")
    most = edge.groupBy(*keys).agg(F.max("_first").alias("_most"), F.bool_or(F.col("_first").isNull()).alias("_any"))
    r = r.join(most.hint("merge"), keys).where(F.col("_any") | (F.col("_o") < F.col("_most"))).drop("_any", "_most")
    near = salted_join(edge, r, keys, ids, small=False)
    near = near.where(F.col("_first").isNull() | (F.col("_o") < F.col("_first"))).drop("_lv", "_cx", "_cy", "_first")
    ends = {"lx0": F.least("x0", "x1"), "ly0": F.least("y0", "y1"), "lx1": F.greatest("x0", "x1"), "ly1": F.greatest("y0", "y1")}
    far = box_pairs(boxed, s.where(long).withColumns(ends), cell=cell, left_id=ids, by=by, lbox=box, rbox=list(ends))
    cols = [*ids, "_ring", *box, "_o", "x0", "y0", "x1", "y1"]
    pairs = near.select(*cols).unionByName(far.select(*cols))
    pairs = geom.fenced(pairs, _told=_meets_box(box)).where("_told IS NULL OR _told")
    seg = F.array(geom.point(F.col("x0"), F.col("y0")), geom.point(F.col("x1"), F.col("y1")))
    met = pairs.where((F.col("_told") & geom.is_rect(F.col("_ring"))) | (geom.path_area_dist(seg, F.col("_ring")) <= 0))
    met = met.groupBy(*ids).agg(F.min("_o").alias("_first")).unionByName(bound)
    return met.groupBy(*ids).agg(F.min("_first").alias("_first"))


def nearest_path(queries: DataFrame, paths: DataFrame, *, query_id: Sequence[str], by: Sequence[str],
                 query_path: str, path: str, path_order: Column, carry: Sequence[str],
                 distance=geom.path_path_dist, fine: float = 200.0, levels: int = 14, pieces: int = 1) -> DataFrame:
    """Nearest path per query with no distance limit, exact, without all pairs.

    A pyramid holds one vertex for every cell with a path, from ``fine`` cells up to a single one. A
    query looks at the three by three cells around it on each floor, so at most nine rows a floor: the
    nearest vertex met bounds the distance. The query's box grown by that bound then meets the boxes of
    path segments (``box_pairs``, on the level of its size), and the exact distance decides. Ties go to
    the smallest ``path_order``. Returns query ids with ``nearest`` = struct(dist, order, carry...).

    For queries much smaller than segments, ``pieces`` cuts a segment into up to so many: the ends of pieces are
    vertices of the pyramid, which has finer floors then (``DEEPER``, only the query's own cell is looked at there),
    and their boxes are what a query's small box meets, so that few segments are met where very many lie. The
    bounds go to a table in the shared folder: the pairs read them several times. Distances are to whole segments.
    """
    by, query_id = list(by), list(query_id)
    same = paths.groupBy(*by, path).agg(
        F.min(F.struct(path_order.alias("ord"), *[F.col(c) for c in carry])).alias("_best")
    )
    floors = list(range(0, levels, 2))
    top = len(floors)  # one cell for everything
    size = F.lit(float(fine)) * F.pow(F.lit(4.0), F.col("_lv").cast("double"))
    at = lambda v: F.when(F.col("_lv") == top, F.lit(0).cast("bigint")).otherwise(_cell(v, size))
    deep = DEEPER if pieces > 1 else 0
    least = float(fine) / 4.0**deep
    every = F.explode(F.sequence(F.lit(-deep), F.lit(top)))
    vertices = same.select(*by, F.explode(path).alias("_v")).select(*by, F.col("_v.x").alias("vx"), F.col("_v.y").alias("vy"))
    segs = same.select(*by, "_best", F.explode(geom.segments(F.col(path))).alias("_s"))
    if pieces > 1:
        parts = _pieces(spread(segs, *by, "_s"), pieces, fine)
        joints = parts.where("_joint IS NOT NULL").select(*by, F.col("_joint.x").alias("vx"), F.col("_joint.y").alias("vy"))
        vertices = vertices.unionByName(joints)
        segs = parts.drop("_joint")
    else:
        segs = segs.withColumns({
            "minx": F.least("_s.x0", "_s.x1"), "maxx": F.greatest("_s.x0", "_s.x1"), "miny": F.least("_s.y0", "_s.y1"), "maxy": F.greatest("_s.y0", "_s.y1"),
        })
    cells = vertices.groupBy(*by, _cell(F.col("vx"), F.lit(least)).alias("_kx"), _cell(F.col("vy"), F.lit(least)).alias("_ky")).agg(
        F.min(F.struct("vx", "vy")).alias("_rep")
    )
    pyramid = cells.select(*by, "_rep", every.alias("_lv")).groupBy(*by, "_lv", at(F.col("_rep.vx")).alias("_cx"), at(F.col("_rep.vy")).alias("_cy")).agg(F.min("_rep").alias("_rep"))
    q = queries.select(*query_id, *by, F.col(query_path).alias("_q")).withColumns(
        {"_qx": F.get(F.col("_q"), F.lit(0)).x, "_qy": F.get(F.col("_q"), F.lit(0)).y}
    )
    ids = list(dict.fromkeys([*query_id, *by]))
    alone = (F.col("_lv") == top) | (F.col("_lv") < 0)
    around = lambda c: F.explode(F.when(alone, F.array(c)).otherwise(F.sequence(c - 1, c + 1)))
    look = q.select(*ids, "_qx", "_qy", every.alias("_lv")).withColumns({"_hx": at(F.col("_qx")), "_hy": at(F.col("_qy"))})
    look = look.withColumn("_cx", around(F.col("_hx"))).withColumn("_cy", around(F.col("_hy")))
    rep_d = geom.length_between(F.col("_qx"), F.col("_qy"), F.col("_rep.vx"), F.col("_rep.vy"))
    bound = look.join(pyramid, [*by, "_lv", "_cx", "_cy"]).groupBy(*ids).agg(F.min(rep_d).alias("_u"))
    q = q.join(bound, ids)
    grow = F.col("_u") * (1 + 1e-9) + (1e-9 if pieces <= 1 else 1e-6)  # joints lie on their segment but for rounding
    q = q.withColumns({f"_l{k}": v - grow if k.startswith("min") else v + grow for k, v in geom.bbox(F.col("_q")).items()})
    q = q.select(*ids, "_q", "_u", "_lminx", "_lminy", "_lmaxx", "_lmaxy")
    if pieces > 1:
        q = write_and_read(q, "bounds")
    near = box_pairs(
        q, segs, cell=least, left_id=query_id, by=by,
        lbox=("_lminx", "_lminy", "_lmaxx", "_lmaxy"), rbox=BOX, levels=None if pieces > 1 else levels,
    )
    seg_path = F.array(geom.point(F.col("_s.x0"), F.col("_s.y0")), geom.point(F.col("_s.x1"), F.col("_s.y1")))
    near = geom.fenced(near.select(*ids, "_q", "_u", "_best", "_s"), dist=distance(F.col("_q"), seg_path))
    # what is beyond the bound cannot be the nearest and need not be sorted for the minimum
    near = near.where(F.col("dist") <= grow) if pieces > 1 else near
    return near.groupBy(*ids).agg(F.min(F.struct("dist", F.col("_best").alias("hit"))).alias("nearest"))


DEEPER = 4


def _pieces(segs: DataFrame, most: int, fine: float) -> DataFrame:
    """Boxes of up to ``most`` equal pieces of each segment ``_s``, none shorter than ``fine`` / most, and _joint, the point between a piece and the next."""
    c = F.col
    side = F.greatest(F.abs(c("_s.x1") - c("_s.x0")), F.abs(c("_s.y1") - c("_s.y0")))
    n = F.greatest(F.lit(1.0), F.least(F.lit(float(most)), F.floor(side * most / fine).cast("double")))
    p = segs.withColumn("_n", F.coalesce(n, F.lit(1.0)))
    p = p.withColumn("_i", F.explode(F.sequence(F.lit(0), c("_n").cast("int") - 1)))

    def end(axis: str, k: Column) -> Column:
        a, b = c(f"_s.{axis}0"), c(f"_s.{axis}1")
        return F.when(k == c("_n"), b).otherwise(a + (b - a) * (k / c("_n")))

    ends = {f"{v}{e}": end(v, c("_i") + e) for v in "xy" for e in (0, 1)}
    p = geom.fenced(p.select(*segs.columns, "_i", "_n"), _e=F.struct(*[v.alias(k) for k, v in ends.items()]))
    box = {f"{name}{v}": f(c(f"_e.{v}0"), c(f"_e.{v}1")) for f, name in ((F.least, "min"), (F.greatest, "max")) for v in "xy"}
    p = geom.fenced(p, _joint=F.when(c("_i") + 1 < c("_n"), geom.point(c("_e.x1"), c("_e.y1"))), **box)
    return p.drop("_i", "_n", "_e")
