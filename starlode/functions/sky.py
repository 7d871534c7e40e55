"""Sky geometry: separations, tangent projection, proper motion and nested HEALPix pixels."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import col

HPX_LEVEL = 5
HPX_PIXELS = 12 * 4**HPX_LEVEL
#: No point of a level-5 pixel is farther from its centre (degrees).
HPX_MAX_RADIUS = 1.91
REF_EPOCH = 2016.0


def separation_deg(ra0, dec0, ra, dec) -> Column:
    """Great-circle separation in degrees by the haversine formula."""
    ra0, dec0, ra, dec = (F.radians(col(c)) if isinstance(c, (str, Column)) else F.lit(math.radians(c)) for c in (ra0, dec0, ra, dec))
    a = F.pow(F.sin((dec - dec0) / 2), 2) + F.cos(dec0) * F.cos(dec) * F.pow(F.sin((ra - ra0) / 2), 2)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0)))))


def propagate_epoch(ra, dec, pmra, pmdec, epoch: float, ref_epoch: float = REF_EPOCH) -> tuple[Column, Column]:
    """Position at another epoch; unknown proper motions (mas / yr) count as none."""
    dt = float(epoch) - float(ref_epoch)
    new_dec = col(dec) + F.coalesce(col(pmdec).cast("double"), F.lit(0.0)) * dt / 3.6e6
    cos = F.greatest(F.cos(F.radians(col(dec))), F.lit(1e-8))
    return F.pmod(col(ra) + F.coalesce(col(pmra).cast("double"), F.lit(0.0)) * dt / 3.6e6 / cos, F.lit(360.0)), new_dec


def tan_project(ra, dec, crval1, crval2) -> tuple[Column, Column]:
    """Gnomonic plane coordinates in degrees; NULL on the far side of the sky."""
    ra, dec, a0, d0 = (F.radians(col(c)) for c in (ra, dec, crval1, crval2))
    den = F.sin(d0) * F.sin(dec) + F.cos(d0) * F.cos(dec) * F.cos(ra - a0)
    front = F.when(den > 0, den)
    xi = F.degrees(F.cos(dec) * F.sin(ra - a0) / front)
    eta = F.degrees((F.cos(d0) * F.sin(dec) - F.sin(d0) * F.cos(dec) * F.cos(ra - a0)) / front)
    return xi, eta


def world_to_pixel(ra, dec, w: dict) -> tuple[Column, Column]:
    """0-based pixels of a TAN solution; w maps crval1.. cd22 to columns or column names."""
    w = {k: col(v) for k, v in w.items()}
    xi, eta = tan_project(ra, dec, w["crval1"], w["crval2"])
    det = w["cd11"] * w["cd22"] - w["cd12"] * w["cd21"]
    det = F.when(det != 0, det)
    return w["crpix1"] - 1 + (w["cd22"] * xi - w["cd12"] * eta) / det, w["crpix2"] - 1 + (w["cd11"] * eta - w["cd21"] * xi) / det


def pixel_to_world(x, y, w: dict) -> tuple[Column, Column]:
    """ICRS degrees of 0-based pixels."""
    w = {k: col(v) for k, v in w.items()}
    dx, dy = col(x) + 1 - w["crpix1"], col(y) + 1 - w["crpix2"]
    xi, eta = F.radians(w["cd11"] * dx + w["cd12"] * dy), F.radians(w["cd21"] * dx + w["cd22"] * dy)
    a0, d0 = F.radians(w["crval1"]), F.radians(w["crval2"])
    den = F.cos(d0) - eta * F.sin(d0)
    ra = F.degrees(a0 + F.atan2(xi, den))
    dec = F.degrees(F.atan2(F.sin(d0) + eta * F.cos(d0), F.sqrt(xi * xi + den * den)))
    return F.pmod(ra, F.lit(360.0)), dec


def tile_centres(ra0: float, dec0: float, half_size_deg: float, n: int) -> list[tuple[float, float]]:
    """Centres of n x n tiles: true angular offsets around a point, also near the poles."""
    if n == 1:
        return [(ra0, dec0)]
    step = 2 * half_size_deg / n
    offsets = [-half_size_deg + step * (i + 0.5) for i in range(n)]
    a0, d0 = math.radians(ra0), math.radians(dec0)
    out = []
    for v in offsets:
        for u in offsets:
            lon, lat = math.radians(u), math.radians(v)
            x, y, z = math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)
            x, z = x * math.cos(d0) - z * math.sin(d0), x * math.sin(d0) + z * math.cos(d0)
            x, y = x * math.cos(a0) - y * math.sin(a0), x * math.sin(a0) + y * math.cos(a0)
            out.append((math.degrees(math.atan2(y, x)) % 360.0, math.degrees(math.asin(max(-1.0, min(1.0, z))))))
    return out


def separation(ra0: float, dec0: float, ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    """The haversine separation in degrees, on the driver or inside a pixel task."""
    a0, d0, a, d = (np.radians(v) for v in (ra0, dec0, ra, dec))
    h = np.sin((d - d0) / 2) ** 2 + np.cos(d0) * np.cos(d) * np.sin((a - a0) / 2) ** 2
    return np.degrees(2 * np.arcsin(np.sqrt(np.clip(h, 0, 1))))


# ------------------------------------------------------------- HEALPix


def pixel_centres(level: int = HPX_LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """RA and Dec of all nested pixels of a level, from their ring and place in it."""
    return _pixel_centres(level)


@lru_cache(maxsize=4)
def _pixel_centres(level: int) -> tuple[np.ndarray, np.ndarray]:
    side = 1 << level
    pixel = np.arange(12 * side * side)
    face, inside = pixel // side**2, pixel % side**2
    x, y = np.zeros_like(inside), np.zeros_like(inside)
    for bit in range(level):
        x |= ((inside >> (2 * bit)) & 1) << bit
        y |= ((inside >> (2 * bit + 1)) & 1) << bit
    # Row and column of the twelve base faces: 2, 3 or 4 half-sides down, odd or even quarter turns.
    down, turn = 2 + face // 4, np.where(face < 4, 2 * face + 1, np.where(face < 8, 2 * (face - 4), 2 * (face - 8) + 1))
    ring = down * side - x - y - 1
    north, south = ring < side, ring > 3 * side
    per = np.where(north, ring, np.where(south, 4 * side - ring, side))
    z = np.where(north, 1 - per**2 / (3.0 * side**2), np.where(south, per**2 / (3.0 * side**2) - 1, (2 * side - ring) * 2 / (3.0 * side)))
    shift = np.where(north | south, 0, (ring - side) & 1)
    place = (turn * per + x - y + 1 + shift) // 2
    place = np.where(place > 4 * side, place - 4 * side, np.where(place < 1, place + 4 * side, place))
    ra = (place - (shift + 1) * 0.5) * 90.0 / per
    return ra % 360.0, np.degrees(np.arcsin(z))


def with_pixel(df: DataFrame, name: str, ra: str = "ra", dec: str = "dec", level: int = HPX_LEVEL) -> DataFrame:
    """``df`` with the nested pixel of a position as column ``name`` (Gorski et al. 2005): a base face, then the bits of its two coordinates in turn.

    A row without a position has pixel -1. The steps are columns of their own, so that no
    expression is written out many times.
    """
    side = 1 << level
    z, turn = F.col("__z"), F.col("__turn")
    df = df.withColumns({"__z": F.sin(F.radians(F.col(dec))), "__turn": F.pmod(F.col(ra), F.lit(360.0)) / 90.0})
    # Near the equator: falling and rising lines of the grid; near the poles: distances from the quarter's edges.
    quarter, reach = F.least(F.floor(turn), F.lit(3)), side * F.sqrt(3.0 * (1.0 - F.abs(z)))
    df = df.withColumns({"__falls": F.floor(side * (0.5 + turn) - side * z * 0.75), "__rises": F.floor(side * (0.5 + turn) + side * z * 0.75), "__quarter": quarter,
                         "__near": F.least(F.floor((turn - quarter) * reach), F.lit(side - 1)), "__far": F.least(F.floor((1.0 - (turn - quarter)) * reach), F.lit(side - 1))})
    high, a, b = F.abs(z) > 2.0 / 3.0, F.floor(F.col("__falls") / side), F.floor(F.col("__rises") / side)
    face = F.when(high, F.when(z > 0, F.col("__quarter")).otherwise(F.col("__quarter") + 8)).when(a == b, F.pmod(a, F.lit(4)) + 4).when(a < b, a).otherwise(b + 8)
    x = F.when(high, F.when(z > 0, side - 1 - F.col("__far")).otherwise(F.col("__near"))).otherwise(F.pmod("__rises", F.lit(side)))
    y = F.when(high, F.when(z > 0, side - 1 - F.col("__near")).otherwise(F.col("__far"))).otherwise(side - 1 - F.pmod("__falls", F.lit(side)))
    df = df.withColumns({"__face": face.cast("int"), "__x": x.cast("int"), "__y": y.cast("int")})
    out = F.col("__face") * (side * side)
    for bit in range(level):
        out = out + F.shiftleft(F.shiftright("__x", bit).bitwiseAND(1), 2 * bit) + F.shiftleft(F.shiftright("__y", bit).bitwiseAND(1), 2 * bit + 1)
    # Never NULL: else a join's filter for that would be pushed below all steps, written out in full.
    return df.withColumn(name, F.coalesce(out, F.lit(-1))).drop("__z", "__turn", "__falls", "__rises", "__quarter", "__near", "__far", "__face", "__x", "__y")


def parts_in_cone(ra: float, dec: float, radius_deg: float) -> list[int]:
    """All pixels that a cone may touch; their centres lie within the radius and a pixel's reach."""
    centre_ra, centre_dec = pixel_centres()
    return np.flatnonzero(separation(ra, dec, centre_ra, centre_dec) <= radius_deg + HPX_MAX_RADIUS).tolist()


def unit_vector(ra, dec) -> tuple[Column, Column, Column]:
    ra, dec = F.radians(col(ra)), F.radians(col(dec))
    return F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)
