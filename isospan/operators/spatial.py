"""Radius and nearest-neighbour joins on a grid.

Cells are at least as large as the radius on both sides. One side of a join has one cell for each row, the other has
the nine cells around each row, so the join is on cells and the distance is checked on what meets there. The width
of a cell in degrees depends on its row, by the latitude farthest from the equator that a neighbour may have.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import EARTH_RADIUS_M, haversine
from ..tables import materialize

#: No two places are farther apart, in metres.
HALF_WAY = math.pi * EARTH_RADIUS_M
_METRES = math.radians(1) * EARTH_RADIUS_M


def _width(row: Column, side: float) -> Column:
    far = F.greatest(F.abs(row - 1), F.abs(row + 2)) * F.lit(side)
    return F.lit(side) / F.cos(F.radians(F.least(far, F.lit(89.0))))


def pairs_within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """All pairs of rows at most so far apart, with ``dist``. Both sides have lat and lon, and no other names in
    common; the result has the columns of both without these. Rows without a position meet none. Positions within a
    radius of the antimeridian or beyond 88 degrees aren't matched across these lines."""
    side = max(metres, 1.0) * 1.001 / _METRES
    row = lambda c: F.floor(F.col(c) / F.lit(side))
    around = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    a = left.withColumnsRenamed({"lat": "__lat1", "lon": "__lon1"}).withColumn("__d", around)
    a = a.withColumn("__row", row("__lat1") + F.col("__d")).withColumn("__e", around)
    a = a.withColumn("__cell", F.floor(F.col("__lon1") / _width(F.col("__row"), side)) + F.col("__e")).drop("__d", "__e")
    b = right.withColumnsRenamed({"lat": "__lat2", "lon": "__lon2"}).withColumn("__row", row("__lat2"))
    b = b.withColumn("__cell", F.floor(F.col("__lon2") / _width(F.col("__row"), side)))
    dist = haversine(F.col("__lat1"), F.col("__lon1"), F.col("__lat2"), F.col("__lon2"))
    both = a.join(b, ["__row", "__cell"]).withColumn("dist", dist).where(F.col("dist") <= F.lit(float(metres)))
    return both.drop("__row", "__cell", "__lat1", "__lon1", "__lat2", "__lon2")


def near_any(points: DataFrame, centres: DataFrame, metres: float, key: str) -> DataFrame:
    """The distinct keys of the points (key, lat, lon) within reach of a centre (lat, lon). Other columns of centres
    keep results apart and are returned too."""
    apart = [c for c in centres.columns if c not in ("lat", "lon")]
    return pairs_within(centres, points.select(key, "lat", "lon"), metres).select(*apart, key).distinct()


def nearest(points: DataFrame, centres: DataFrame, metres: float, key: str, order: str) -> DataFrame:
    """For each point with a centre within reach its key, the nearest centre's columns and dist; of equally near ones
    the first by order. Points without a position have no row; a key stands for one position."""
    return _in_rings(points, centres, key, order, metres, metres)


def nearest_of_all(points: DataFrame, centres: DataFrame, key: str, order: str, metres: float = 500.0, growth: float = 4.0) -> DataFrame:
    """As nearest(), with no limit on the distance; growth: of the rings beyond the distance given. Points and centres
    without a position, and points if there is no centre, have no row."""
    return _in_rings(points, centres, key, order, metres, None, growth)


#: Centres that the cell of a centre has on average in the first ring, at most, and how often its radius is halved for that.
CROWD, HALVINGS = 4, 16


def _first_ring(centres: DataFrame, metres: float) -> float:
    """The distance, halved until the centres aren't crowded: most points then meet a few of them, however many there are
    in all. By counts of cells; positions where centres pile up count once."""
    side = lambda k: F.lit(metres * 1.001 / _METRES) / F.pow(F.lit(2.0), F.col(k))
    at = centres.select("lat", "lon", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS))).alias("k"))
    row = F.floor(F.col("lat") / side("k"))
    cells = at.groupBy("k", row.alias("r"), F.floor(F.col("lon") * F.cos(F.radians(row * side("k"))) / side("k")).alias("c")).agg(F.count("*").alias("n"))
    crowd = cells.groupBy("k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd"))
    free = crowd.where(F.col("crowd") <= CROWD).agg(F.min("k")).first()[0]
    return metres / 2 ** (HALVINGS if free is None else free)


def _in_rings(points: DataFrame, centres: DataFrame, key: str, order: str, metres: float, limit: float | None, growth: float = 4.0) -> DataFrame:
    """The nearest centres in rings that double from the first one up to the distance, and grow on from there if there is
    no limit. Each is for the points that had no centre in the one before: what is found in a ring is nearer than all
    beyond it."""
    have = [c for c in centres.columns if c not in ("lat", "lon")]
    # Of centres in the same place only the first can be the nearest.
    own = centres.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.min_by(F.struct(*have), F.struct(order)).alias("c"))
    own = materialize(own.select("lat", "lon", "c.*"))
    left, found = materialize(points.where("lat IS NOT NULL AND lon IS NOT NULL").select(key, "lat", "lon")), []
    radius = _first_ring(own, metres)
    while True:
        met = pairs_within(left, own, radius)
        best = met.groupBy(key).agg(F.min_by(F.struct("dist", *have), F.struct("dist", order)).alias("b"))
        found.append(materialize(best.select(key, "b.*")))
        if radius >= (limit or HALF_WAY):
            break
        left = materialize(left.join(found[-1].select(key), key, "left_anti"))
        if left.isEmpty():
            break
        radius = min(radius * 2, metres) if radius < metres else radius * growth
    return reduce(DataFrame.unionAll, found)


def around_point(points: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """The points (lat, lon) within reach of one position."""
    dist = haversine(F.lit(float(lat)), F.lit(float(lon)), F.col("lat"), F.col("lon"))
    return points.where(dist <= F.lit(float(metres)))
