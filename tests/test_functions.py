"""Hand cases for Column functions."""

import math

import pytest
from pyspark.sql import functions as F

from sitewright.functions import attributes as at
from sitewright.functions import crs, geom, kernels, labels, numbers, tilemath
from sitewright.functions import tags as tg


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("text, n", [("5", 5), ("3.7", 3), ("  7  ", 7), ("-2", None), ("0", None), ("abc", None), ("", None), (None, None),
                                     ("١٢", 12), ("5d", None), ("1_0", None), ("inf", None), ("1e2", 100)])
def test_positive_int(spark, text, n):
    assert one(spark, numbers.positive_int(F.lit(text).cast("string")))[0] == n


def test_levels_carry_confidence(spark):
    r = one(spark, tg.noted(numbers.positive_int(F.lit("x")), 1).alias("a"), tg.noted(numbers.positive_int(F.lit("4.0")), 1).alias("b"))
    assert (r.a.value, r.a.confidence, r.b.value, r.b.confidence) == (1, "умолчание", 4, "факт")


@pytest.mark.parametrize("d, ring", [(0.0, "LOD2"), (500.0, "LOD2"), (500.01, "LOD1"), (1500.0, "LOD1"), (3000.0, "LOD0"), (3000.1, None), (-1.0, None)])
def test_lod_border_belongs_to_inner_ring(spark, d, ring):
    assert one(spark, tilemath.lod_ring(F.lit(d)))[0] == ring


@pytest.mark.parametrize("name, kind", [("К1", "К"), ("кл3", "Кл"), ("Г", "Г"), ("Водопроводная сеть", "В"), ("СТЕНЫ", None), ("кабельная_линия", "Кл")])
def test_network_type_of_layer_name(spark, name, kind):
    assert one(spark, labels.network_type(F.lit(name)))[0] == kind


def test_label_values(spark):
    r = one(spark, labels.diameter_mm(F.lit("Ø300 чугун")), labels.material(F.lit("труба чугунная")), labels.elevation_m(F.lit("отм. 12,30")), labels.diameter_mm(F.lit("d150")))
    assert tuple(r) == (300.0, "чугун", 12.3, 150.0)


def test_fire_break_is_symmetric(spark):
    r = one(spark, at.fire_break_m(F.lit("IV-V"), F.lit("I-II")), at.fire_break_m(F.lit("I-II"), F.lit("IV-V")), at.fire_break_m(F.lit("VI"), F.lit("III")))
    assert tuple(r) == (10.0, 10.0, None)


def test_norm_steps_are_inclusive_and_capped(spark):
    r = one(spark, at.cemetery_zone_m(F.lit(10.0)), at.cemetery_zone_m(F.lit(500.0)), at.water_protection_m(F.lit(50.0)), at.water_protection_m(F.lit(50.1)), at.power_corridor_m(F.lit(None).cast("double")))
    assert tuple(r) == (50.0, 300.0, 100.0, 200.0, None)


def test_terrain_rgb_round_trip(spark):
    c = tilemath.terrain_rgb(F.lit(123.4))
    assert one(spark, tilemath.terrain_height(c["r"], c["g"], c["b"]))[0] == pytest.approx(123.4, abs=0.051)


def test_projection_round_trip_and_central_meridian(spark):
    df = spark.createDataFrame([(56.25, 58.0, 2), (57.9, 59.5, 2), (54.0, 56.1, 1)], "lon double, lat double, zone int")
    back = crs.msk_to_lonlat(crs.lonlat_to_msk(df), out=("lon2", "lat2")).collect()
    for r in back:
        # heights are dropped between the two ellipsoids
        assert abs(r.lon2 - r.lon) * 60_000 < 0.002 and abs(r.lat2 - r.lat) * 111_000 < 0.002
    assert all(1_000_000 < r.x < 3_500_000 for r in back)


def test_points_and_rings(spark):
    ring = geom.rect_ring(0, 0, 4, 2)
    edge = (F.lit(0.0), F.lit(1.0))
    r = one(spark, geom.contains(F.lit(1.0), F.lit(1.0), ring), geom.contains(*edge, ring), geom.covers(*edge, ring), geom.area(ring),
            geom.dist_to_area(F.lit(7.0), F.lit(6.0), ring), geom.path_length(ring))
    assert tuple(r) == (True, False, True, 8.0, 5.0, 12.0)


def test_touching_rings_intersect_and_repair_orients(spark):
    a, b = geom.rect_ring(0, 0, 2, 2), geom.rect_ring(2, 0, 4, 2)
    r = one(spark, geom.areas_intersect(a, b).alias("t"), geom.signed_area(geom.repair_ring(F.reverse(a))).alias("s"), geom.repair_ring(geom.rect_ring(0, 0, 0.5, 0.5)).alias("n"))
    assert (r.t, r.s, r.n) == (True, 4.0, None)


def test_overlap_area_of_concave_polygons():
    ell = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)]
    assert kernels.overlap_area(ell, [(0, 0), (2, 0), (2, 2), (0, 2)]) == pytest.approx(3.0)
    assert kernels.overlap_area(ell, ell) == pytest.approx(7.0)


def test_oriented_box_of_rotated_rectangle():
    c, s = math.cos(0.5), math.sin(0.5)
    pts = [(x * c - y * s + 10, x * s + y * c - 3) for x, y in [(-3, -1), (3, -1), (3, 1), (-3, 1)]]
    cx, cy, length, width, ax, ay = kernels.oriented_box(pts)
    assert (round(cx, 6), round(cy, 6), round(length, 6), round(width, 6)) == (10, -3, 6, 2)
    assert abs(ax * s - ay * c) < 1e-9
