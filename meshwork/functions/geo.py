"""Distances and plane geometry on latitude and longitude columns."""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Miles of the two Earth radii in use, and miles in a degree of latitude.
RADIUS_PAIRS, RADIUS_PLACES = 3958.7613, 3958.8
MILES_PER_DEGREE = 69.09


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_PAIRS) -> Column:
    """Great-circle miles, by the atan2 form."""
    x = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.atan2(F.sqrt(x), F.sqrt(F.lit(1.0) - x))


@F.pandas_udf(T.DoubleType())
def haversine_libm(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """``haversine`` by the C library's functions, to the last bit of engines that use them.  The JVM's own differ there now and then,
    which puts places that lie equally far apart into another order."""
    each = lambda f, *v: np.fromiter(map(f, *(x.tolist() for x in v)), float, len(v[0]))
    half = lambda d: np.fromiter(map(math.pow, map(math.sin, (d * (math.pi / 180) / 2).tolist()), repeat(2.0)), float, len(d))
    a, b, c, d = (v.to_numpy(float) for v in (lat1, lon1, lat2, lon2))
    x = half(c - a) + each(math.cos, a * (math.pi / 180)) * each(math.cos, c * (math.pi / 180)) * half(d - b)
    return pd.Series(2 * RADIUS_PAIRS * each(math.atan2, np.sqrt(x), np.sqrt(1.0 - x)))


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_PLACES) -> Column:
    """Great-circle miles, by the asin form used for places and routes; null if a coordinate is."""
    x = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(x > 1, 1.0).otherwise(x)))


def plane_x(lon: Column, lat0: Column, radius: float = RADIUS_PLACES) -> Column:
    return F.radians(lon) * radius * F.cos(F.radians(lat0))


def plane_y(lat: Column, radius: float = RADIUS_PLACES) -> Column:
    return F.radians(lat) * radius


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point to a segment of the plane; a segment of length 0 is a point."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(size, F.lit(0.0)))))
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_cross(p, q, r, s) -> Column:
    """Whether segments p-q and r-s cross properly; points are pairs of columns."""
    d1, d2 = _turn(*r, *s, *p), _turn(*r, *s, *q)
    d3, d4 = _turn(*p, *q, *r), _turn(*p, *q, *s)
    none_zero = (d1 != 0) & (d2 != 0) & (d3 != 0) & (d4 != 0)
    return ((d1 > 0) != (d2 > 0)) & ((d3 > 0) != (d4 > 0)) & none_zero


def edge_crossed(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray from the point to the east crosses an edge; half open in y."""
    at = (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    return F.coalesce(((y1 > py) != (y2 > py)) & (px < at), F.lit(False))


def ring_area(ring: Column) -> Column:
    """Signed area of an array of points ``(x, y)``, closing it."""
    n = F.size(ring)
    terms = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"],
    )
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2
