"""Projection between WGS-84 and the local zone grid: 7-parameter shift and Krüger series, all Columns.

Zone parameters are literals picked by the zone number, so a table may mix zones row by row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright import rules
from sitewright.functions import geom

_ARCSEC = math.pi / (180.0 * 3600.0)


class Ellipsoid:
    def __init__(self, a: float, inv_f: float) -> None:
        self.a, f = a, 1.0 / inv_f
        self.e2 = f * (2.0 - f)
        self.e = math.sqrt(self.e2)
        self.b = a * (1.0 - f)
        self.ep2 = self.e2 / (1.0 - self.e2)
        n = f / (2.0 - f)
        self.rect = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.fwd = (
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        )
        self.inv = (
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        )
        self.lat = (
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35,
            4279 * n**4 / 630,
        )


WGS84 = Ellipsoid(*rules.WGS84_ELLIPSOID)
KRASSOVSKY = Ellipsoid(*rules.KRASSOVSKY_ELLIPSOID)


def pick_zone(lon: Column) -> Column:
    """Zone with the nearest central meridian; null beyond the supported offset."""
    dist = F.array_min(F.array(*[
        F.struct(F.abs(lon - lon0).alias("d"), F.lit(z).alias("zone")) for z, lon0, _, _ in rules.MSK_ZONES
    ]))
    return F.when(dist.d <= rules.MSK_MAX_OFFSET_DEG, dist.zone)


def zones_in_reach(lon: Column, reach_deg: float) -> Column:
    """All zones that a site within ``reach_deg`` of this longitude may have."""
    near = [F.when(F.abs(lon - lon0) <= rules.MSK_MAX_OFFSET_DEG + reach_deg, F.lit(z)) for z, lon0, _, _ in rules.MSK_ZONES]
    return F.filter(F.array(*near), lambda z: z.isNotNull())


def _zone_value(zone: Column, index: int) -> Column:
    out = None
    for row in rules.MSK_ZONES:
        out = F.when(zone == row[0], F.lit(row[index])) if out is None else out.when(zone == row[0], F.lit(row[index]))
    return out


def _to_geocentric(lon: Column, lat: Column, ell: Ellipsoid):
    n = ell.a / F.sqrt(1.0 - ell.e2 * F.sin(lat) * F.sin(lat))
    return n * F.cos(lat) * F.cos(lon), n * F.cos(lat) * F.sin(lon), n * (1.0 - ell.e2) * F.sin(lat)


def _to_geodetic(x: Column, y: Column, z: Column, ell: Ellipsoid):
    """Bowring's closed form; heights near the surface only."""
    p = F.sqrt(x * x + y * y)
    th = F.atan2(z * ell.a, p * ell.b)
    s3, c3 = F.pow(F.sin(th), F.lit(3.0)), F.pow(F.cos(th), F.lit(3.0))
    return F.atan2(y, x), F.atan2(z + ell.ep2 * ell.b * s3, p - ell.e2 * ell.a * c3)


def _shift(x, y, z, inverse: bool):
    dx, dy, dz, rx, ry, rz, ppm = rules.MSK_HELMERT
    rx, ry, rz, m = rx * _ARCSEC, ry * _ARCSEC, rz * _ARCSEC, 1.0 + ppm * 1e-6
    if inverse:
        x, y, z = (x - dx) / m, (y - dy) / m, (z - dz) / m
        return x + rz * y - ry * z, -rz * x + y + rx * z, ry * x - rx * y + z
    return (
        dx + m * (x - rz * y + ry * z),
        dy + m * (rz * x + y - rx * z),
        dz + m * (-ry * x + rx * y + z),
    )


def lonlat_to_msk(df: DataFrame, lon: str = "lon", lat: str = "lat", zone: str = "zone",
                  out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Adds projected coordinates. Steps are staged columns so no sub-expression is repeated."""
    ell, t = KRASSOVSKY, "_crs_"
    c = lambda n: F.col(t + n)
    gx, gy, gz = _to_geocentric(F.radians(F.col(lon)), F.radians(F.col(lat)), WGS84)
    df = df.withColumns({t + "X": gx, t + "Y": gy, t + "Z": gz})
    sx, sy, sz = _shift(c("X"), c("Y"), c("Z"), inverse=True)
    df = df.withColumns({t + "sx": sx, t + "sy": sy, t + "sz": sz})
    lam, phi = _to_geodetic(c("sx"), c("sy"), c("sz"), ell)
    df = df.withColumns({t + "lam": lam - F.radians(_zone_value(F.col(zone), 1)), t + "tau": F.tan(phi)})
    root = F.sqrt(1.0 + c("tau") * c("tau"))
    df = df.withColumn(t + "sig", F.sinh(ell.e * F.atanh(ell.e * c("tau") / root)))
    df = df.withColumn(t + "tp", c("tau") * F.sqrt(1.0 + c("sig") * c("sig")) - c("sig") * root)
    df = df.withColumns({
        t + "xi": F.atan2(c("tp"), F.cos(c("lam"))),
        t + "eta": F.asinh(F.sin(c("lam")) / F.sqrt(c("tp") * c("tp") + F.cos(c("lam")) * F.cos(c("lam")))),
    })
    xi, eta = c("xi"), c("eta")
    for j, a in enumerate(ell.fwd, start=1):
        k = 2.0 * j
        xi = xi + a * F.sin(k * c("xi")) * F.cosh(k * c("eta"))
        eta = eta + a * F.cos(k * c("xi")) * F.sinh(k * c("eta"))
    return _fenced(df, t, {
        out[0]: _zone_value(F.col(zone), 2) + ell.rect * eta, out[1]: _zone_value(F.col(zone), 3) + ell.rect * xi,
    })


def _fenced(df: DataFrame, temp: str, result: dict[str, Column]) -> DataFrame:
    return geom.fenced(df, **result).drop(*[c for c in df.columns if c.startswith(temp)])


def msk_to_lonlat(df: DataFrame, x: str = "x", y: str = "y", zone: str = "zone",
                  out: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    ell, t = KRASSOVSKY, "_crs_"
    c = lambda n: F.col(t + n)
    df = df.withColumns({
        t + "xi": (F.col(y) - _zone_value(F.col(zone), 3)) / ell.rect,
        t + "eta": (F.col(x) - _zone_value(F.col(zone), 2)) / ell.rect,
    })
    xi, eta = c("xi"), c("eta")
    for j, b in enumerate(ell.inv, start=1):
        k = 2.0 * j
        xi = xi - b * F.sin(k * c("xi")) * F.cosh(k * c("eta"))
        eta = eta - b * F.cos(k * c("xi")) * F.sinh(k * c("eta"))
    df = df.withColumns({t + "xp": xi, t + "ep": eta})
    df = df.withColumns({
        t + "chi": F.asin(F.sin(c("xp")) / F.cosh(c("ep"))),
        t + "lam": F.atan2(F.sinh(c("ep")), F.cos(c("xp"))) + F.radians(_zone_value(F.col(zone), 1)),
    })
    phi = c("chi")
    for j, d in enumerate(ell.lat, start=1):
        phi = phi + d * F.sin(2.0 * j * c("chi"))
    df = df.withColumn(t + "phi", phi)
    gx, gy, gz = _to_geocentric(c("lam"), c("phi"), ell)
    df = df.withColumns({t + "X": gx, t + "Y": gy, t + "Z": gz})
    sx, sy, sz = _shift(c("X"), c("Y"), c("Z"), inverse=False)
    df = df.withColumns({t + "sx": sx, t + "sy": sy, t + "sz": sz})
    lon, lat = _to_geodetic(c("sx"), c("sy"), c("sz"), WGS84)
    return _fenced(df, t, {out[0]: F.degrees(lon), out[1]: F.degrees(lat)})


def path_to_msk(df: DataFrame, path: str, zone: str, key: list[str]) -> DataFrame:
    """Project every vertex of a lon/lat path: vertices become rows, are projected, and are put back in order.

    A path's vertices are bounded by the source format (one OSM way holds at most 2000 nodes).
    """
    rows = df.select(*key, F.col(zone).alias("_z"), F.posexplode(path).alias("_i", "_p"))
    rows = rows.withColumns({"_lon": F.col("_p.x"), "_lat": F.col("_p.y")})
    rows = lonlat_to_msk(rows, "_lon", "_lat", "_z", ("_px", "_py"))
    return rows.groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_i", F.col("_px").alias("x"), F.col("_py").alias("y")))),
            lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")),
        ).alias(path)
    )


def haversine_m(lon0, lat0, lon1, lat1, radius: float = 6371008.8) -> Column:
    dp, dl = F.radians(lat1 - lat0), F.radians(lon1 - lon0)
    h = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(F.radians(lat0)) * F.cos(F.radians(lat1)) * F.sin(dl / 2) * F.sin(dl / 2)
    return 2.0 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
