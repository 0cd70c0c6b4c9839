"""The projection stated in SQL, step by step, for comparison with the Column form."""

from sitewright.functions.crs import KRASSOVSKY as K
from sitewright.functions.crs import WGS84 as W
from sitewright.rules import MSK_HELMERT, MSK_ZONES

_S = 3.141592653589793 / (180.0 * 3600.0)


def d(v: float) -> str:
    return f"({v!r}::DOUBLE)"


def zone_case(i: int) -> str:
    return "CASE zone " + " ".join(f"WHEN {r[0]} THEN {d(r[i])}" for r in MSK_ZONES) + " END"


def zone_of(lon: str) -> str:
    dist = [f"abs({lon} - {d(r[1])})" for r in MSK_ZONES]
    return f"CASE WHEN least({', '.join(dist)}) > 2 THEN NULL WHEN {dist[0]} <= least({dist[1]}, {dist[2]}) THEN 1 WHEN {dist[1]} <= {dist[2]} THEN 2 ELSE 3 END"


def geocentric(lon: str, lat: str, e) -> str:
    n = f"({d(e.a)} / sqrt(1 - {d(e.e2)} * sin({lat}) * sin({lat})))"
    return f"{n} * cos({lat}) * cos({lon}) AS gx, {n} * cos({lat}) * sin({lon}) AS gy, {n} * {d(1 - e.e2)} * sin({lat}) AS gz"


def geodetic(e) -> str:
    p = "sqrt(sx * sx + sy * sy)"
    th = f"atan2(sz * {d(e.a)}, {p} * {d(e.b)})"
    return f"atan2(sy, sx) AS glon, atan2(sz + {d(e.ep2 * e.b)} * pow(sin({th}), 3), {p} - {d(e.e2 * e.a)} * pow(cos({th}), 3)) AS glat"


def forward(src: str, out: str, lon: str = "lon", lat: str = "lat") -> str:
    """CTEs ending in ``out`` = src.* plus mx, my. src needs a zone column."""
    dx, dy, dz, rx, ry, rz, ppm = MSK_HELMERT
    rx, ry, rz, m = rx * _S, ry * _S, rz * _S, 1 + ppm * 1e-6
    xi = "xi" + "".join(f" + {d(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(K.fwd, 1))
    eta = "eta" + "".join(f" + {d(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(K.fwd, 1))
    drop = "gx, gy, gz, tx, ty, tz, sx, sy, sz, glon, glat, lam, tau, sg, tp, xi, eta"
    return f"""{out}1 AS (SELECT *, {geocentric(f'radians({lon})', f'radians({lat})', W)} FROM {src}),
{out}2 AS (SELECT *, (gx - {d(dx)}) / {d(m)} AS tx, (gy - {d(dy)}) / {d(m)} AS ty, (gz - {d(dz)}) / {d(m)} AS tz FROM {out}1),
{out}3 AS (SELECT *, tx + {d(rz)} * ty - {d(ry)} * tz AS sx, -{d(rz)} * tx + ty + {d(rx)} * tz AS sy, {d(ry)} * tx - {d(rx)} * ty + tz AS sz FROM {out}2),
{out}4 AS (SELECT *, {geodetic(K)} FROM {out}3), {out}5 AS (SELECT *, glon - radians({zone_case(1)}) AS lam, tan(glat) AS tau FROM {out}4),
{out}6 AS (SELECT *, sinh({d(K.e)} * atanh({d(K.e)} * tau / sqrt(1 + tau * tau))) AS sg FROM {out}5),
{out}7 AS (SELECT *, tau * sqrt(1 + sg * sg) - sg * sqrt(1 + tau * tau) AS tp FROM {out}6),
{out}8 AS (SELECT *, atan2(tp, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tp * tp + cos(lam) * cos(lam))) AS eta FROM {out}7),
{out} AS (SELECT * EXCLUDE ({drop}), {zone_case(2)} + {d(K.rect)} * ({eta}) AS mx, {zone_case(3)} + {d(K.rect)} * ({xi}) AS my FROM {out}8)"""


def inverse(src: str, out: str, x: str = "mx", y: str = "my") -> str:
    """CTEs ending in ``out`` = src.* plus olon, olat in degrees."""
    dx, dy, dz, rx, ry, rz, ppm = MSK_HELMERT
    rx, ry, rz, m = rx * _S, ry * _S, rz * _S, 1 + ppm * 1e-6
    xi = "xi" + "".join(f" - {d(b)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(K.inv, 1))
    eta = "eta" + "".join(f" - {d(b)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(K.inv, 1))
    phi = "chi" + "".join(f" + {d(c)} * sin({2 * j} * chi)" for j, c in enumerate(K.lat, 1))
    drop = "xi, eta, xp, ep, chi, lam, phi, gx, gy, gz, sx, sy, sz, glon, glat"
    return f"""{out}1 AS (SELECT *, ({y} - {zone_case(3)}) / {d(K.rect)} AS xi, ({x} - {zone_case(2)}) / {d(K.rect)} AS eta FROM {src}),
{out}2 AS (SELECT *, {xi} AS xp, {eta} AS ep FROM {out}1), {out}3 AS (SELECT *, asin(sin(xp) / cosh(ep)) AS chi, atan2(sinh(ep), cos(xp)) + radians({zone_case(1)}) AS lam FROM {out}2),
{out}4 AS (SELECT *, {phi} AS phi FROM {out}3), {out}5 AS (SELECT *, {geocentric('lam', 'phi', K)} FROM {out}4),
{out}6 AS (SELECT *, {d(dx)} + {d(m)} * (gx - {d(rz)} * gy + {d(ry)} * gz) AS sx, {d(dy)} + {d(m)} * ({d(rz)} * gx + gy - {d(rx)} * gz) AS sy, {d(dz)} + {d(m)} * (-{d(ry)} * gx + {d(rx)} * gy + gz) AS sz FROM {out}5),
{out}7 AS (SELECT *, {geodetic(W)} FROM {out}6), {out} AS (SELECT * EXCLUDE ({drop}), degrees(glon) AS olon, degrees(glat) AS olat FROM {out}7)"""
