"""Sun position for (time, place) rows: the public low-precision almanac series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_sun_position(df: DataFrame, ts: str, lat: str, lon: str) -> DataFrame:
    """Adds elevation_deg, azimuth_deg, declination_deg and the unit vector to the sun."""
    t = "_sun_"
    c = lambda n: F.col(t + n)
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("double")
    days = F.date_diff(F.to_date(F.col(ts)), F.lit("2000-01-01").cast("date")).cast("double")
    df = df.withColumns({t + "h": seconds / 3600.0, t + "n": days + (seconds - 43200.0) / 86400.0})
    mod = lambda v, m: F.pmod(v, F.lit(m))
    df = df.withColumns({
        t + "L": F.radians(mod(280.460 + 0.9856474 * c("n"), 360.0)),
        t + "g": F.radians(mod(357.528 + 0.9856003 * c("n"), 360.0)),
        t + "eps": F.radians(23.439 - 0.0000004 * c("n")),
    })
    df = df.withColumn(
        t + "lam", c("L") + F.radians(F.lit(1.915)) * F.sin(c("g")) + F.radians(F.lit(0.020)) * F.sin(2.0 * c("g"))
    )
    df = df.withColumns({
        t + "ra": F.atan2(F.cos(c("eps")) * F.sin(c("lam")), F.cos(c("lam"))),
        t + "dec": F.asin(F.sin(c("eps")) * F.sin(c("lam"))),
        t + "gmst": mod(6.697374558 + 0.06570982441908 * c("n") + 1.00273790935 * c("h"), 24.0),
        t + "phi": F.radians(F.col(lat)),
    })
    df = df.withColumn(
        t + "ha", F.radians(mod(c("gmst") + F.col(lon) / 15.0, 24.0) * 15.0 - F.degrees(c("ra")))
    )
    elevation = F.asin(
        F.sin(c("phi")) * F.sin(c("dec")) + F.cos(c("phi")) * F.cos(c("dec")) * F.cos(c("ha"))
    )
    azimuth = F.atan2(
        F.sin(c("ha")), F.cos(c("ha")) * F.sin(c("phi")) - F.tan(c("dec")) * F.cos(c("phi"))
    )
    df = df.withColumns({
        "elevation_deg": F.degrees(elevation),
        "azimuth_deg": mod(F.degrees(azimuth) + 180.0, 360.0),
        "declination_deg": F.degrees(c("dec")),
    })
    el, az = F.radians("elevation_deg"), F.radians("azimuth_deg")
    df = df.withColumns({
        "dir_x": F.cos(el) * F.sin(az), "dir_y": F.cos(el) * F.cos(az), "dir_z": F.sin(el),
    })
    return df.drop(*[n for n in df.columns if n.startswith(t)])
