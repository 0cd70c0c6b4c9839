"""Kernels on one raster row or block at a time."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# executors need not have this package installed: its functions travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lower_envelope(cols: list[int], heights: list[int | None]) -> list[int | None]:
    """min over j of (c - c_j)^2 + h_j for every c of ``cols`` (rising), in linear time; None: no parabola there, or none at all.

    The parabolas that are lowest somewhere are kept with the place from which each is; whole numbers, so nothing is rounded.
    """
    c, h, start = [], [], []  # start[i] = (n, d): parabola i is lowest from n / d on, d > 0
    for x, v in zip(cols, heights):
        if v is None:
            continue
        while c:
            # from where on is the new one no higher than the last: ((v + x^2) - (h + c^2)) / (2 (x - c))
            n, d = (v + x * x) - (h[-1] + c[-1] * c[-1]), 2 * (x - c[-1])
            if start[-1] is not None and n * start[-1][1] <= start[-1][0] * d:
                c.pop(), h.pop(), start.pop()
                continue
            start.append((n, d))
            break
        else:
            start.append(None)
        c.append(x)
        h.append(v)
    out: list[int | None] = []
    k = 0
    for x in cols:
        while k + 1 < len(c) and start[k + 1][0] <= x * start[k + 1][1]:
            k += 1
        out.append((x - c[k]) ** 2 + h[k] if c else None)
    return out


@pandas_udf(T.ArrayType(T.LongType()))
def row_distance_udf(cols: pd.Series, inside: pd.Series, to_in: pd.Series, to_out: pd.Series) -> pd.Series:
    """Squared distance in cells from each cell of a row to the nearest cell of the other kind.

    ``to_in`` and ``to_out`` are the distances along the cell's own column to the nearest cell of either kind, null for none.
    """
    def one(c, flags, i, o):
        c = [int(x) for x in c]
        square = lambda v: [None if x is None or x != x else int(x) ** 2 for x in v]
        near_in, near_out = lower_envelope(c, square(i)), lower_envelope(c, square(o))
        return [b if f else a for f, a, b in zip(flags, near_in, near_out)]

    return pd.Series([one(*row) for row in zip(cols, inside, to_in, to_out)])


def _steps_to(flag: np.ndarray, reach: int) -> np.ndarray:
    """Cells along each row to the nearest flagged one; beyond ``reach`` infinity."""
    n = flag.shape[1]
    at = np.arange(n, dtype=np.float64)
    back = np.maximum.accumulate(np.where(flag, at, -np.inf), axis=1)
    ahead = np.minimum.accumulate(np.where(flag, at, np.inf)[:, ::-1], axis=1)[:, ::-1]
    d = np.minimum(at - back, ahead - at)
    return np.where(d <= reach, d, np.inf)


def _nearest(flag: np.ndarray, reach: int) -> np.ndarray:
    """Squared distance to the nearest flagged cell within ``reach`` rows and columns."""
    along = _steps_to(flag, reach) ** 2
    out = along.copy()
    for k in range(1, min(reach, len(flag) - 1) + 1):
        out[k:] = np.minimum(out[k:], along[:-k] + k * k)
        out[:-k] = np.minimum(out[:-k], along[k:] + k * k)
    return out


def weights(valid: np.ndarray, present: np.ndarray, px: float, width_m: float, reach: int) -> np.ndarray:
    """Blend weight from the signed distance to the nearest cell of the other kind: 0 to 1 over ``width_m`` about the border."""
    if width_m <= 0:
        return valid.astype(np.float64)
    d2 = np.where(valid, _nearest(present & ~valid, reach), _nearest(valid, reach))
    d = np.where(np.isinf(d2), width_m, np.sqrt(np.where(np.isinf(d2), 0.0, d2)) * px)
    return np.clip((np.where(valid, d, -d) + width_m / 2.0) / width_m, 0.0, 1.0)


def folded(px: float, width_m: float, halo: int, block: int) -> Callable:
    """applyInPandas function over a block's cells of all sources, border included; returns the block's own cells."""

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        source, br, bc = key
        r0, c0, side = int(br) * block - halo, int(bc) * block - halo, block + 2 * halo
        z, present = np.full((side, side), np.nan), np.zeros((side, side), bool)
        for _, part in rows.groupby("_s", sort=True):
            r, c = part["r"].to_numpy(np.int64) - r0, part["c"].to_numpy(np.int64) - c0
            new = np.full((side, side), np.nan)
            new[r, c] = part["z"].to_numpy(np.float64)
            first = not present.any()
            present[r, c] = True
            if first:
                z = new
                continue
            valid, known = ~np.isnan(new), ~np.isnan(z)
            a = weights(valid, present, px, width_m, halo)
            z = np.where(valid & known, a * new + (1.0 - a) * z, np.where(known, z, new))
        own = np.zeros((side, side), bool)
        own[halo : halo + block, halo : halo + block] = True
        r, c = np.nonzero(present & own)
        found = z[r, c]
        return pd.DataFrame({"source_id": [source] * len(r), "r": r + r0, "c": c + c0, "z": pd.array(np.where(np.isnan(found), None, found), dtype="Float64") if len(r) else pd.array([], dtype="Float64")})

    return fold
