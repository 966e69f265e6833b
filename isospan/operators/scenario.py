"""Scenarios: rewrites of a network's edges. Each takes and returns DataFrames of bus or walk edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import attrgetter
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import DWELL_SEC, SERVICE_SPAN, WALK_EDGE_M, haversine, ride_seconds
from ..tables import materialize
from .network import stop_pairs
from .reach import earliest_arrivals, search
from .timetable import Overlay, Timetable, lay_out


@dataclass(frozen=True)
class Network:
    """Edges and stops. kept: the layout for searches of the network that this one was made of, if that was laid out, and
    what has changed since: trips gone (trip_id), rides and walks that are new (as edges), walks gone (from_stop, to_stop).
    """

    bus: DataFrame
    walk: DataFrame
    stops: DataFrame
    kept: Timetable | None = None
    gone: DataFrame | None = None
    new_bus: DataFrame | None = None
    new_walk: DataFrame | None = None
    gone_walk: DataFrame | None = None
    #: If walk has all pairs of stops so far apart and no others: these metres.
    walk_metres: float | None = None
    #: stop_id of vertices that aren't stops, by way of which some new walks lead.
    hubs: DataFrame | None = None

    def with_layout(self, folder: str | None = None) -> Network:
        """Laid out for searches, in a folder or as scratch; a network without a layout is laid out for each search."""
        return Network(self.bus, self.walk, self.stops, lay_out(self.bus, self.walk, folder=folder, stops=self.stops, metres=self.walk_metres))


def _both(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def overlay(changed: Mapping[Any, Network], kind: str = "int") -> Overlay:
    """What sets the networks apart from the one they were all made of, by scenario: the keys, of an SQL type."""
    mark = lambda df, k: df.withColumn("scenario", F.lit(k).cast(kind))
    each = lambda get: [mark(df, k) for k, net in changed.items() if (df := get(net)) is not None]
    all_ = lambda dfs: reduce(DataFrame.unionByName, dfs) if dfs else None
    gone, bus, walk, gone_walk = (all_(each(attrgetter(k))) for k in ("gone", "new_bus", "new_walk", "gone_walk"))
    if gone_walk is not None:
        gone_walk = gone_walk.select("scenario", F.col("from_stop").alias("stop_id"), "to_stop")
    extra = None
    if bus is not None or walk is not None:
        net = next(iter(changed.values()))
        none = lambda df: mark(df.limit(0), None)
        extra = lay_out(none(net.bus) if bus is None else bus, none(net.walk) if walk is None else walk, ["scenario"])
    # Each round of a search asks for what is gone, so it is worked out once.
    return Overlay(None if gone is None else materialize(gone), extra, None if gone_walk is None else materialize(gone_walk))


def arrivals(net: Network, queries: DataFrame, hubs: bool = False) -> DataFrame:
    """Earliest arrivals in a network, over the layout that it or the one that it was made of has; at hubs too if asked."""
    if net.kept is None:
        return earliest_arrivals(net.bus, net.walk, queries, net.stops)
    if net.gone is net.new_bus is net.new_walk is net.gone_walk is None:
        return search(net.kept, queries)
    found = search(net.kept, queries.withColumn("scenario", F.lit(1)), overlay({1: net})).drop("scenario")
    return found if hubs or net.hubs is None else found.join(net.hubs, "stop_id", "left_anti").select(found.columns)


def _values(like: DataFrame, column: str, values: Sequence) -> DataFrame:
    return like.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{column} {like.schema[column].dataType.simpleString()}")


def remove_routes(net: Network, route_ids: Sequence | str | None) -> Network:
    """Without the rides of the routes; rides of no known route stay. Nothing is removed by an empty list or None."""
    ids = [] if route_ids in (None, "") else [route_ids] if isinstance(route_ids, str) else list(route_ids)
    if not ids:
        return net
    routes = _values(net.bus, "route_id", ids)
    left = net.bus.join(routes, "route_id", "left_anti").select(net.bus.columns)
    # Rides that were added since have no place in the layout, so they go where they are.
    added = None if net.new_bus is None else net.new_bus.join(routes, "route_id", "left_anti").select(net.new_bus.columns)
    return replace(net, bus=left, gone=_both(net.gone, trips_of(net, routes)), new_bus=added)


def trips_of(net: Network, routes: DataFrame) -> DataFrame:
    """trip_id, and further columns of routes, of the trips of each route (route_id)."""
    return net.bus.select("trip_id", "route_id").join(routes, "route_id").drop("route_id").distinct()


def remove_stops(net: Network, stop_ids: Sequence, walk_metres: float = WALK_EDGE_M) -> Network:
    """Buses pass through the stops, and those who walked by way of them walk between their neighbours, up to twice
    the distance.

    The result has no layout: every trip is written anew from its calls: a call's departure becomes its arrival, hops that took no time come
    back if the calls around them are apart in time, and hops from a stop to itself go; also with no stop removed.
    """
    gone = _values(net.stops, "stop_id", stop_ids)
    in_trip = Window.partitionBy("trip_id").orderBy("departure_sec", "ord")
    hops = net.bus.withColumns({"k": F.row_number().over(in_trip), "before": F.lag("to_stop").over(in_trip)})
    call = lambda side, stop, at: F.struct(F.lit(side).alias("side"), F.col(stop).alias("stop_id"), F.col(at).alias("at"))
    first = F.when(F.col("before").isNull() | (F.col("before") != F.col("from_stop")), F.array(call(0, "from_stop", "departure_sec"), call(1, "to_stop", "arrival_sec")))
    calls = hops.select("ord", "trip_id", "route_id", "edge_type", "k", F.explode(first.otherwise(F.array(call(1, "to_stop", "arrival_sec")))).alias("c"))
    calls = calls.select("ord", "trip_id", "route_id", "edge_type", "k", "c.*").join(F.broadcast(gone), "stop_id", "left_anti")
    onward = Window.partitionBy("trip_id").orderBy("k", "side")
    bus = calls.select(
        F.struct("ord.part", "ord.trip", (F.col("k") * 2 + F.col("side")).cast("bigint").alias("seq")).cast(net.bus.schema["ord"].dataType).alias("ord"),
        F.col("stop_id").alias("from_stop"),
        F.lead("stop_id").over(onward).alias("to_stop"),
        F.col("at").alias("departure_sec"),
        F.lead("at").over(onward).alias("arrival_sec"),
        "trip_id",
        "route_id",
        "edge_type",
    ).where("arrival_sec > departure_sec AND from_stop <> to_stop")
    bus = bus.withColumn("travel_time", F.col("arrival_sec") - F.col("departure_sec")).select(net.bus.columns)
    at = lambda end: F.broadcast(gone.withColumnRenamed("stop_id", end))
    stay = net.walk.join(at("from_stop"), "from_stop", "left_anti").join(at("to_stop"), "to_stop", "left_anti")
    ends = [net.walk.join(at(a), a, "left_semi").join(at(b), b, "left_anti").select(F.col(b).alias("stop_id")) for a, b in (("from_stop", "to_stop"), ("to_stop", "from_stop"))]
    neighbours = net.stops.join(ends[0].unionAll(ends[1]).distinct(), "stop_id", "left_semi")
    return Network(bus, stay.select(net.walk.columns).unionByName(stop_pairs(neighbours, 2 * walk_metres)), net.stops)


def _first_departures(bus: DataFrame, *by: str) -> DataFrame:
    """Trips by route with the number of trips and, from 0, each one's place by first departure, then appearance."""
    trips = bus.groupBy("trip_id", *by).agg(F.min("departure_sec").alias("first"), F.min("ord").alias("appears"))
    return trips


def _without(net: Network, trips: DataFrame) -> Network:
    ids = trips.select("trip_id")
    less = lambda bus: None if bus is None else bus.join(ids, "trip_id", "left_anti").select(bus.columns)
    return replace(net, bus=less(net.bus), new_bus=less(net.new_bus), gone=_both(net.gone, ids))


def halve_route(net: Network, route_id: str) -> Network:
    """Every other trip of a route goes, in order of appearance; the first stays."""
    trips = _first_departures(net.bus.where(F.col("route_id") == route_id), "route_id")
    n = F.row_number().over(Window.partitionBy("route_id").orderBy("appears"))
    return _without(net, trips.withColumn("n", n).where("n % 2 = 0"))


def keep_every(net: Network, route_id: str, every: int) -> Network:
    """One in so many (2 at least) trips of a route stays, in order of first departure."""
    trips = _first_departures(net.bus.where(F.col("route_id") == route_id), "route_id")
    n = F.row_number().over(Window.partitionBy("route_id").orderBy("first", "appears"))
    return _without(net, trips.withColumn("n", n).where(f"(n - 1) % {max(2, int(every))} <> 0"))


def thin_all(net: Network, ratio: float) -> Network:
    """Of each route with two trips or more the part of its trips given goes, one at least, evenly spaced in order of
    first departure from the first on. Trips of no known route stay."""
    trips = _first_departures(net.bus.where("route_id IS NOT NULL"), "route_id")
    by_route = Window.partitionBy("route_id")
    # Whole numbers of 64 bits: place times trips is beyond 32 bits from some 85,000 trips of a route on.
    trips = trips.withColumns({"n": F.count("*").over(by_route), "k": F.row_number().over(by_route.orderBy("first", "appears")).cast("bigint") - 1}).where("n > 1")
    less = F.greatest(F.lit(1), F.col("n") * F.lit(float(ratio))).cast("bigint")
    # Place k goes if it is the whole part of i * n / less for some i below less; only i next to k * less / n can be it.
    i = F.floor(F.col("k") * less / F.col("n"))
    goes = F.lit(False)
    for step in (-1, 0, 1, 2):
        near = i + step
        goes = goes | ((near >= 0) & (near < less) & ((near * (F.col("n") / less)).cast("bigint") == F.col("k")))
    return _without(net, trips.where(goes))


#: Parts in which all pairs of a zone's stops are made.
ZONE_PARTS = 64


def demand_edges(stops: DataFrame, centre, metres: float = 2000, seconds: int = 900) -> DataFrame:
    """Edges of a demand-responsive zone: between any two stops within reach of the centre, in the same time. None if
    the centre is unknown or has no position."""
    inside = _inside(stops, centre, metres)
    # Each stop is in one part as a start and in all as an end, so no task has all pairs.
    starts = inside.select(F.col("stop_id").alias("from_stop"), F.pmod(F.xxhash64("stop_id"), F.lit(ZONE_PARTS)).cast("int").alias("part"))
    ends = inside.select(F.col("stop_id").alias("to_stop"), F.explode(F.sequence(F.lit(0), F.lit(ZONE_PARTS - 1))).alias("part"))
    both = starts.join(ends, "part").where("from_stop <> to_stop")
    return both.select("from_stop", "to_stop", F.lit(seconds).cast("bigint").alias("walk_time"), F.lit(0.0).alias("distance"), F.lit("demand").alias("edge_type"))


def demand_zone(net: Network, centre, metres: float = 2000, seconds: int = 900) -> Network:
    """With a zone. Its edges between all stops are only made if the walks are asked for as such; a network that is laid
    out is searched by way of the zone's hub, with two edges for each stop. A second zone has a hub of its own."""
    walk = net.walk.unionByName(demand_edges(net.stops, centre, metres, seconds))
    below = net.stops if net.hubs is None else net.stops.select("stop_id").unionAll(net.hubs)
    edges, hub = hub_edges(net.stops, centre, metres, seconds, below)
    return replace(net, walk=walk, walk_metres=None, new_walk=_both(net.new_walk, edges), hubs=_both(net.hubs, hub))


def hub_edges(stops: DataFrame, centre, metres: float = 2000, seconds: int = 900, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The zone of demand_edges() with a hub: from each of its stops to the hub in no time, from there to each in the
    zone's. Also the hub's stop_id, which no stop (of `taken`) has."""
    known = (stops if taken is None else taken).agg(F.min("stop_id").alias("low"), F.max("stop_id").alias("high"))
    text = stops.schema["stop_id"].dataType.simpleString() == "string"
    hub = known.select((F.concat(F.coalesce("high", F.lit("")), F.lit(" zone")) if text else F.coalesce("low", F.lit(0)) - 1).cast(stops.schema["stop_id"].dataType).alias("hub"))
    inside = _inside(stops, centre, metres).select("stop_id").crossJoin(F.broadcast(hub))
    edge = lambda a, b, s: inside.select(F.col(a).alias("from_stop"), F.col(b).alias("to_stop"), F.lit(s).cast("bigint").alias("walk_time"), F.lit(0.0).alias("distance"), F.lit("demand").alias("edge_type"))
    return edge("stop_id", "hub", 0).unionAll(edge("hub", "stop_id", seconds)), hub.select(F.col("hub").alias("stop_id"))


def without_hubs(preds: DataFrame, hubs: DataFrame) -> DataFrame:
    """Predecessors found by way of hubs as those of stops: what leads from a hub begins where what led there did."""
    ids = F.broadcast(hubs.select(F.col("stop_id").alias("hub")))
    key = ["qid", *(["scenario"] if "scenario" in preds.columns else [])]
    to_hub = preds.join(ids, preds["stop_id"] == F.col("hub"), "left_semi").select(*key, F.col("stop_id").alias("pred_stop"), F.col("pred_stop").alias("origin"))
    stops = preds.join(ids, preds["stop_id"] == F.col("hub"), "left_anti").join(to_hub, [*key, "pred_stop"], "left")
    return stops.withColumn("pred_stop", F.coalesce("origin", "pred_stop")).select(preds.columns)


def _inside(stops: DataFrame, centre, metres: float) -> DataFrame:
    middle = stops.where(F.col("stop_id") == F.lit(centre)).select(F.col("stop_lat").alias("lat0"), F.col("stop_lon").alias("lon0"))
    return stops.crossJoin(F.broadcast(middle)).where(haversine(F.col("lat0"), F.col("lon0"), F.col("stop_lat"), F.col("stop_lon")) <= float(metres))


def _new_trip(like: DataFrame, run: Column, back: int) -> Column:
    """Ids of added trips: texts, or numbers below 0."""
    if like.schema["trip_id"].dataType.simpleString() == "string":
        return F.concat(F.lit("NEW_"), run.cast("string"), F.lit("_R" if back else ""))
    return (-(run * 2 + back + 1)).cast(like.schema["trip_id"].dataType)


def line_edges(net: Network, line: Sequence, interval_min: int = 30, km_per_h: float = 25) -> DataFrame:
    """Bus edges of a new line along some stops: a run each interval in the service span, 30 s at each stop. The way
    back has the times of the way there. Pairs with an unknown stop are left out, and take no time."""
    spark = net.stops.sparkSession
    kind = net.stops.schema["stop_id"].dataType.simpleString()
    calls = spark.createDataFrame([(k, v) for k, v in enumerate(line)], f"k int, stop_id {kind}")
    along = Window.partitionBy(F.lit(0)).orderBy("k")
    placed = calls.join(net.stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id", "left")
    pair = placed.select(
        "k",
        F.col("stop_id").alias("a"),
        F.lead("stop_id").over(along).alias("b"),
        ride_seconds(haversine(F.col("stop_lat"), F.col("stop_lon"), F.lead("stop_lat").over(along), F.lead("stop_lon").over(along)), km_per_h).alias("ride"),
    ).where("ride IS NOT NULL")
    before = F.coalesce(F.sum(F.col("ride") + DWELL_SEC).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first, end = SERVICE_SPAN
    runs = F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(end - 1).cast("bigint"), F.lit(interval_min * 60).cast("bigint")))
    timed = pair.withColumn("before", before).withColumn("run", runs).withColumn("departure_sec", F.col("run") + F.col("before"))
    ways = []
    for back, (a, b) in enumerate((("a", "b"), ("b", "a"))):
        trip = _new_trip(net.bus, F.col("run"), back)
        ways.append(
            timed.select(
                F.struct(F.lit(1).alias("part"), trip.alias("trip"), (F.col("k") * 2 + back).cast("bigint").alias("seq")).alias("ord"),
                F.col(a).alias("from_stop"),
                F.col(b).alias("to_stop"),
                "departure_sec",
                (F.col("departure_sec") + F.col("ride")).alias("arrival_sec"),
                F.col("ride").alias("travel_time"),
                trip.alias("trip_id"),
                F.lit(None).cast("string").alias("route_id"),
                F.lit("bus").alias("edge_type"),
            )
        )
    return ways[0].unionAll(ways[1])


def replace_routes(net: Network, route_ids: Sequence | str | None, line: Sequence, interval_min: int = 30, km_per_h: float = 25) -> Network:
    """Without the routes, with a new line; fewer than two stops add none."""
    left = remove_routes(net, route_ids)
    if len(line) < 2:
        return left
    rides = line_edges(net, line, interval_min, km_per_h)
    return replace(left, bus=left.bus.unionByName(rides), new_bus=_both(left.new_bus, rides))
