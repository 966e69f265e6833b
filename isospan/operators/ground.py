"""Walks between all stops within a radius, found from their positions where a search needs them.

As rows such walks grow with the square of the stops of an area. Here a zone knows its own stops and those within reach of
them, and what searches reach in it is walked on from until nothing in it gets better.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import EARTH_RADIUS_M, WALK_M_PER_MIN
from ..tables import materialize

#: Degrees of latitude of a zone's side, about 1 km, halved so often at most, until a stop's zone has so many on average.
SIDE, HALVINGS, CROWD = 0.009, 10, 4000
#: Pairs of stops that a task remembers, and stops and queries that it has at once, about.
PAIRS, STOPS, QUERIES = 8_000_000, 5_000, 64
_METRES = math.radians(1) * EARTH_RADIUS_M
_FAR = np.int32(1 << 30)

# Tasks get walker() as such, or searches would need this package on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Ground:
    """near: zone, stop_id, lat, lon, own: the stops of each zone, and those within so many metres of its own ones."""

    near: DataFrame
    zones: DataFrame
    metres: float
    stops: int


def survey(stops: DataFrame, metres: float) -> Ground | None:
    """The ground of stops (stop_id, stop_lat, stop_lon); those without a position are left out. None where walks have to
    be pairs: if a stop has several positions, or one beyond what radius joins match across."""
    placed = stops.where("stop_id IS NOT NULL AND stop_lat IS NOT NULL AND stop_lon IS NOT NULL")
    at = materialize(placed.select("stop_id", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")).distinct())
    reach = metres * 1.001 / _METRES
    odd = (F.abs("lat") > 87) | (F.abs("lon") + reach / F.cos(F.radians("lat")) >= 180)
    n, ids, far = at.agg(F.count("*"), F.countDistinct("stop_id"), F.coalesce(F.bool_or(odd), F.lit(False))).first()
    if n != ids or far:
        return None
    place = lambda side: (F.floor(F.col("lat") / side), F.floor(F.col("lon") * F.cos(F.radians(F.floor(F.col("lat") / side) * side)) / side))
    each = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(HALVINGS)))).withColumn("side", F.lit(SIDE) / F.pow(F.lit(2.0), F.col("k")))
    cells = each.groupBy("k", *(c.alias(n) for n, c in zip("rc", place(F.col("side"))))).agg(F.count("*").alias("n"))
    crowd = cells.groupBy("k").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).collect()
    k = min((r.k for r in crowd if r.crowd <= CROWD or r.k == HALVINGS), default=0)
    side = SIDE / 2**k
    zone = lambda row, column: row * F.lit(1 << 32) + column
    low, high = (F.floor((F.col("lat") + d) / side) for d in (-reach, reach))
    rows = at.withColumns({"zone0": zone(*place(F.lit(side))), "row": F.explode(F.sequence(low, high))})
    wide, shrunk = reach / F.cos(F.radians(F.abs("lat") + reach)), F.cos(F.radians(F.col("row") * side))
    west, east = (F.floor((F.col("lon") + d) * shrunk / side) for d in (-wide, wide))
    near = rows.withColumn("column", F.explode(F.sequence(west, east))).withColumn("zone", zone(F.col("row"), F.col("column")))
    near = materialize(near.select("zone", "stop_id", "lat", "lon", (F.col("zone") == F.col("zone0")).alias("own")))
    return Ground(near, materialize(near.where("own").select("stop_id", "zone")), metres, n)


class _Ways:
    """The walks from each place to others: their numbers and seconds."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, metres: float):
        self.order = np.argsort(lat, kind="stable")
        self.place = np.argsort(self.order)
        self.lat, self.lon, self.metres = lat[self.order], lon[self.order], metres
        self.cos, north, east = np.cos(np.radians(self.lat)), np.radians(self.lat), np.radians(self.lon)
        self.point = np.stack([self.cos * np.cos(east), self.cos * np.sin(east), np.sin(north)], 1)
        self.span, self.chord = metres * 1.001 / _METRES, 1 - (metres * 1.001 / EARTH_RADIUS_M) ** 2 / 2
        self.known, self.pairs = {}, 0

    def __getitem__(self, u: int) -> tuple[np.ndarray, np.ndarray]:
        if (found := self.known.get(u)) is not None:
            return found
        if self.pairs > PAIRS:
            self.known, self.pairs = {}, 0
        k = self.place[u]
        low, high = self.lat.searchsorted((self.lat[k] - self.span, self.lat[k] + self.span))
        some = np.flatnonzero(self.point[low:high] @ self.point[k] >= self.chord) + low
        # As functions.haversine() and walk_seconds() have it.
        north, east = (np.sin(np.radians(x[some] - x[k]) / 2) for x in (self.lat, self.lon))
        a = north * north + self.cos[k] * self.cos[some] * east * east
        metres = 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(a), np.sqrt(1.0 - a))
        keep = (metres <= self.metres) & (some != k)
        found = self.order[some[keep]], np.maximum(1, (metres[keep] / WALK_M_PER_MIN * 60).astype(np.int32))
        self.known[u], self.pairs = found, self.pairs + len(found[0])
        return found


def walker(key: list[str], metres: float, closed: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a zone: rows (key, met: an arrival found, had: what it was so far) and its stops, to the rows (key, arrival_sec,
    over) that are better than before once all is walked from: of its own stops, and (over) of those of other zones, which
    may have been reached as early before. closed: stops of the zone that had no row aren't walked to."""
    group = [c for c in key if c != "stop_id"]

    def walk(rows: pa.Table, stops: pa.Table) -> pa.Table:
        if not rows.num_rows or rows["met"].null_count == rows.num_rows:
            rows = rows.slice(0, 0)
            return rows.select(key).append_column("arrival_sec", rows["met"]).append_column("over", pa.array([], pa.bool_()))
        stops = stops.sort_by([("own", "descending")])
        ids, own = stops["stop_id"].combine_chunks(), int(pc.sum(stops["own"]).as_py() or 0)
        # Vertices without a position come after the zone's own stops: nobody walks from them, or to them.
        lost = pc.unique(rows["stop_id"].filter(pc.invert(pc.is_in(rows["stop_id"], value_set=ids))))
        lost = lost.combine_chunks() if isinstance(lost, pa.ChunkedArray) else lost
        ids, n, mine = pa.concat_arrays([ids.slice(0, own), lost, ids.slice(own)]), len(ids) + len(lost), own + len(lost)
        node = pc.index_in(rows["stop_id"], value_set=ids).to_numpy().astype(np.int64)
        where = np.r_[0:own, mine:n]
        lat, lon = np.full(n, 1e9), np.full(n, 1e9)
        lat[where], lon[where] = stops["lat"].to_numpy(), stops["lon"].to_numpy()
        ways = _Ways(lat[where], lon[where], metres)
        query = rows.select(group).to_pandas().groupby(group, sort=False, dropna=False).ngroup().to_numpy()
        first = np.unique(query, return_index=True)[1]
        deadline = rows["deadline"].to_numpy()
        ahead = lambda c: pc.fill_null(pc.subtract(rows[c], rows["deadline"]), int(_FAR)).to_numpy().clip(-_FAR, _FAR).astype(np.int32)
        met, had = ahead("met"), ahead("had")
        # Times count up to the deadline at 0. What hasn't been reached is there at 1.
        best = np.full((len(first), n), 1, np.int32)
        if closed:
            best[:, :mine] = -_FAR
        best[query, node] = np.minimum(had, 1)
        before = best[:, :mine].copy()
        waits = np.full(before.shape, _FAR)
        new = met < best[query, node]
        best[query[new], node[new]] = waits[query[new], node[new]] = met[new]
        flat, line = best.reshape(-1), waits.reshape(-1)
        waits[:, own:] = _FAR
        shift = mine - own
        while line.size and (t := line.min()) < _FAR:
            q, u = np.divmod(np.flatnonzero(line == t), mine)
            waits[q, u] = _FAR
            found = [ways[k] for k in u.tolist()]
            to = np.concatenate([f[0] for f in found])
            after = np.concatenate([f[1] for f in found]) + np.int32(t)
            if shift:
                to = np.where(to >= own, to + shift, to)
            goal = np.repeat(q, [len(f[0]) for f in found]) * n + to
            keep = (after <= 0) & (after < flat[goal])
            goal, after = goal[keep], after[keep]
            np.minimum.at(flat, goal, after)
            q, to = np.divmod(goal, n)
            inside = to < own
            waits[q[inside], to[inside]] = flat[goal[inside]]
        better = best < 1
        better[:, :mine] &= best[:, :mine] < before
        q, u = np.nonzero(better)
        origin = pa.array(first[q])
        out = {c: rows[c].combine_chunks().take(origin) for c in group} | {"stop_id": ids.take(pa.array(u))}
        return pa.table({c: out[c] for c in key} | {"arrival_sec": pa.array(best[q, u] + deadline[first[q]].astype(np.int64), pa.int64()), "over": pa.array(u >= mine)})

    return walk


def puller(key: list[str], metres: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a zone: rows (key, own) of stops that lost their arrival, also near the zone, and the stops of the zone and near
    it as they were reached before (stop_id, lat, lon, qid, before_sec), to the rows (key, arrival_sec) of the zone's own
    stops that can be walked to from one that kept its arrival."""
    group = [c for c in key if c != "stop_id"]

    def pull(rows: pa.Table, stops: pa.Table) -> pa.Table:
        own = rows["own"].to_numpy()
        if not own.any() or not stops.num_rows:
            return rows.slice(0, 0).select(key).append_column("arrival_sec", pa.array([], pa.int64()))
        ids, asked = (pc.unique(stops[c]) for c in ("stop_id", "qid"))
        at, q = (pc.index_in(stops[c], value_set=v).to_numpy() for c, v in (("stop_id", ids), ("qid", asked)))
        one = np.unique(at, return_index=True)[1]
        ways = _Ways(stops["lat"].to_numpy()[one], stops["lon"].to_numpy()[one], metres)
        before = np.full((len(asked) + 1, len(ids)), 1 << 60, np.int64)
        before[q, at] = stops["before_sec"].to_numpy()
        # A query without arrivals here is the last, which has none.
        node, query = (pc.fill_null(pc.index_in(rows[c], value_set=v), -1).to_numpy() for c, v in (("stop_id", ids), ("qid", asked)))
        parts = rows.select(group).to_pandas().groupby(group, sort=False, dropna=False).indices.values()
        got = np.full(rows.num_rows, 1 << 60, np.int64)
        for part in parts:
            since = before[query[part[0]]].copy()
            since[node[part][node[part] >= 0]] = 1 << 60
            for k in part[own[part] & (node[part] >= 0)].tolist():
                ends, secs = ways[int(node[k])]
                if len(ends):
                    got[k] = (since[ends] + secs).min()
        found = np.flatnonzero(got <= rows["deadline"].to_numpy())
        return rows.take(pa.array(found)).select(key).append_column("arrival_sec", pa.array(got[found]))

    return pull
