"""Edges of a feed: timed rides between consecutive calls, and walks between stops close to each other.

Bus edges: ord, from_stop, to_stop, departure_sec, arrival_sec, travel_time, trip_id, route_id, edge_type. ord is a
struct (part, trip, seq) that sorts as the timetable does, trip by trip; added lines come in a later part.
Walk edges: from_stop, to_stop, walk_time, distance, edge_type; both directions.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import UNKNOWN_ROUTE, WALK_EDGE_M, walk_seconds
from ..sources.feed import DAYS, Feed
from ..tables import dealt, materialize
from .spatial import pairs_within


def services(feed: Feed, service_date: datetime.date | None = None) -> DataFrame:
    """service_id of weekday services: those that run on Mondays, whatever the dates. With a date, those that run on
    it by weekday, period and exceptions."""
    if service_date is None:
        return feed.calendar.where("monday = 1").select("service_id")
    day = service_date.strftime("%Y%m%d")
    runs = feed.calendar.where((F.col(DAYS[service_date.weekday()]) == 1) & F.lit(day).between(F.col("start_date"), F.col("end_date")))
    runs = runs.select("service_id")
    if feed.calendar_dates is None:
        return runs
    odd = feed.calendar_dates.where(F.col("date") == day)
    added = odd.where("exception_type = 1").select("service_id")
    return runs.unionAll(added).distinct().join(odd.where("exception_type = 2"), "service_id", "left_anti")


def running_trips(feed: Feed, service_date: datetime.date | None = None) -> DataFrame:
    # Written, as few services are then seen as such and sent to the trips, which would be dealt by service to a few tasks.
    return feed.trips.join(materialize(services(feed, service_date)), "service_id", "left_semi")


def build_bus_edges(feed: Feed, service_date: datetime.date | None = None) -> DataFrame:
    """From each call of a running trip to its next, where that takes time: others are dropped, and the trip can't be
    ridden across them."""
    trips = running_trips(feed, service_date).select("trip_id", "route_id")
    rows = feed.stop_times.count() if feed.calls is None else feed.calls
    # Trips too, or calls are dealt to the partitions that these may lie in by trip already.
    calls = dealt(feed.stop_times, rows, "trip_id").join(dealt(trips, rows, "trip_id"), "trip_id")
    after = Window.partitionBy("trip_id").orderBy("stop_sequence")
    hops = calls.select(
        F.struct(F.lit(0).alias("part"), F.col("trip_id").alias("trip"), F.col("stop_sequence").alias("seq")).alias("ord"),
        F.col("stop_id").alias("from_stop"),
        F.lead("stop_id").over(after).alias("to_stop"),
        F.col("departure_sec"),
        F.lead("arrival_sec").over(after).alias("arrival_sec"),
        "trip_id",
        "route_id",
    )
    timed = hops.withColumn("travel_time", F.col("arrival_sec") - F.col("departure_sec")).where("travel_time > 0 AND to_stop IS NOT NULL")
    return timed.select(
        "ord", "from_stop", "to_stop", "departure_sec", "arrival_sec", "travel_time", "trip_id", "route_id", F.lit("bus").alias("edge_type")
    )


def stop_pairs(stops: DataFrame, metres: float, kind: str = "walk") -> DataFrame:
    """Walk edges between all stops (stop_id, stop_lat, stop_lon) at most so far apart."""
    own = stops.where("stop_lat IS NOT NULL AND stop_lon IS NOT NULL")
    place = lambda name: own.select(F.col("stop_id").alias(name), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    # A task for each share of the stops, however few files they are in.
    starts = place("from_stop").repartition(int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions")), "from_stop")
    near = pairs_within(starts, place("to_stop"), metres).where("from_stop <> to_stop")
    return near.select(
        "from_stop", "to_stop", walk_seconds(F.col("dist")).alias("walk_time"), F.round("dist", 1).alias("distance"), F.lit(kind).alias("edge_type")
    )


def build_walk_edges(feed: Feed, metres: float = WALK_EDGE_M) -> DataFrame:
    return stop_pairs(feed.stops, metres)


def network_summary(bus: DataFrame, walk: DataFrame) -> DataFrame:
    """One row: nodes, bus_edges, walk_edges."""
    ends = [e.select(F.col(c).alias("stop")) for e in (bus, walk) for c in ("from_stop", "to_stop")]
    nodes = ends[0].unionAll(ends[1]).unionAll(ends[2]).unionAll(ends[3]).agg(F.countDistinct("stop").alias("nodes"))
    return nodes.crossJoin(bus.agg(F.count("*").alias("bus_edges"))).crossJoin(walk.agg(F.count("*").alias("walk_edges")))


def trip_names(feed: Feed) -> DataFrame:
    """trip_id, route_name; the unknown label where a trip has no route or its route no name."""
    names = feed.routes.select("route_id", F.col("route_long_name").alias("route_name"))
    named = feed.trips.select("trip_id", "route_id").join(names, "route_id", "left")
    return named.select("trip_id", F.coalesce("route_name", F.lit(UNKNOWN_ROUTE)).alias("route_name"))
