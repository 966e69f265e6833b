"""Lists, layers and texts for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import BBOX, MODE_BUS, PROFILE_HOURS, UNKNOWN_ROUTE, format_time, in_bbox, is_highway, marker, tenth_minutes, travel_band
from ..ordinals import ranked
from ..sources.feed import Feed

#: Colours of route lines, told apart by number.
PALETTE = 17


def bbox_stops(stops: DataFrame, bbox=BBOX) -> DataFrame:
    return stops.where(in_bbox(F.col("stop_lat"), F.col("stop_lon"), bbox))


def stop_names(stops: DataFrame, bbox=BBOX) -> DataFrame:
    """The distinct names of stops in the area, sorted."""
    return bbox_stops(stops, bbox).select("stop_name").distinct().orderBy("stop_name")


def stop_ids_by_name(stops: DataFrame, name: str) -> DataFrame:
    """The stops of that name in the order of the feed."""
    return stops.where(F.col("stop_name") == name).select("stop_id", "stop_ord").orderBy("stop_ord")


def default_origin(stops: DataFrame, name: str | None = None, bbox=BBOX) -> DataFrame:
    """One row, stop_name: the name given if a stop in the area has it, else the first."""
    inside = bbox_stops(stops, bbox)
    return inside.agg(F.coalesce(F.max(F.when(F.col("stop_name") == F.lit(name), F.col("stop_name"))), F.min("stop_name")).alias("stop_name"))


def area_routes(feed: Feed, bus: DataFrame, no_highway: bool = True, bbox=BBOX) -> DataFrame:
    """route_id, route_name, appears (first edge) of the routes with an edge to or from a stop in the area; a null
    route_id is one of them. Routes without a name have the unknown label."""
    inside = bbox_stops(feed.stops, bbox).select("stop_id")
    ends = [bus.join(inside.withColumnRenamed("stop_id", c), c, "left_semi").select("route_id", "ord") for c in ("from_stop", "to_stop")]
    found = ends[0].unionAll(ends[1]).groupBy("route_id").agg(F.min("ord").alias("appears"))
    named = found.join(feed.routes.select("route_id", F.col("route_long_name").alias("route_name")), "route_id", "left")
    named = named.withColumn("route_name", F.coalesce("route_name", F.lit(UNKNOWN_ROUTE)))
    return named.where(~is_highway(F.col("route_name"))) if no_highway else named


def routes_by_access(feed: Feed, bus: DataFrame, walk: DataFrame, start_name: str, no_highway: bool = True) -> DataFrame:
    """The routes of the area with ``direct``: they leave from a stop of that name or one that a walk joins to it."""
    start = feed.stops.where(F.col("stop_name") == start_name).select("stop_id")
    walks = [walk.join(start.withColumnRenamed("stop_id", a), a, "left_semi").select(F.col(b).alias("stop_id")) for a, b in (("from_stop", "to_stop"), ("to_stop", "from_stop"))]
    near = start.unionAll(walks[0]).unionAll(walks[1]).distinct()
    boarded = bus.join(near.withColumnRenamed("stop_id", "from_stop"), "from_stop", "left_semi").select(F.col("route_id").alias("r")).distinct()
    routes = area_routes(feed, bus, no_highway)
    return routes.join(boarded, F.col("route_id").eqNullSafe(F.col("r")), "left_semi").withColumn("direct", F.lit(True)).unionAll(
        routes.join(boarded, F.col("route_id").eqNullSafe(F.col("r")), "left_anti").withColumn("direct", F.lit(False))
    )


def bands(arrivals: DataFrame, queries: DataFrame) -> DataFrame:
    """Arrivals with travel_min and band."""
    minutes = (F.col("arrival_sec") - F.col("t0")) / F.lit(60.0)
    return arrivals.join(queries.select("qid", "t0"), "qid").select("qid", "stop_id", "arrival_sec", minutes.alias("travel_min"), travel_band(minutes).alias("band"))


def reached_by_hour(profile: DataFrame, hours: range = PROFILE_HOURS) -> DataFrame:
    """hour, reached; hours without any are 0. profile: qid is the hour."""
    every = profile.sparkSession.range(hours.start, hours.stop).select(F.col("id").alias("hour"))
    n = profile.groupBy(F.col("qid").alias("hour")).agg(F.count("*").alias("reached"))
    return every.join(n, "hour", "left").na.fill(0)


def path_routes(paths: DataFrame) -> DataFrame:
    """qid, stop_id, routes: the distinct names of the bus routes along a path, in order."""
    rides = F.filter("steps", lambda s: s["mode"] == MODE_BUS)
    return paths.select("qid", "stop_id", F.array_distinct(F.transform(rides, lambda s: s["route_name"])).alias("routes"))


def itinerary(paths: DataFrame, stops: DataFrame) -> DataFrame:
    """qid, stop_id, itinerary: one line for each step, with its times, mode, route and stops' names."""
    steps = paths.select("qid", "stop_id", F.posexplode("steps").alias("k", "s")).select("qid", "stop_id", "k", "s.*")
    for c in ("from", "to"):
        steps = steps.join(stops.select(F.col("stop_id").alias(f"{c}_stop"), F.col("stop_name").alias(f"{c}_name")), f"{c}_stop", "left")
    route = F.when(F.col("route_name") != "", F.concat(F.lit(" "), "route_name")).otherwise("")
    line = F.concat(
        format_time(F.col("departure_sec")), F.lit("-"), format_time(F.col("arrival_sec")), F.lit(" "), "mode", route, F.lit(" "),
        F.coalesce("from_name", F.lit("")), F.lit(" > "), F.coalesce("to_name", F.lit("")),
    )
    lines = steps.groupBy("qid", "stop_id").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("t")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    return paths.select("qid", "stop_id").join(lines.select("qid", "stop_id", text.alias("itinerary")), ["qid", "stop_id"], "left").na.fill("")


def stop_layer(changes: DataFrame, stops: DataFrame, queries: DataFrame) -> DataFrame:
    """The stops of compare() with name, position and minutes before and after; unknown stops are left out."""
    minutes = lambda c: (F.col(c) - F.col("t0")) / F.lit(60.0)
    return changes.join(stops, "stop_id").join(queries.select("qid", "t0"), "qid").select(
        "qid", "stop_id", "stop_name", "stop_lat", "stop_lon", "status", minutes("before_sec").alias("before_min"), minutes("after_sec").alias("after_min")
    )


def top_degraded(changes: DataFrame, n: int = 10) -> DataFrame:
    """The stops that lose most time."""
    return changes.where("status = 'degraded'").orderBy(F.desc("delta_sec"), "qid", "stop_id").limit(n)


def degraded_detail(changes: DataFrame, queries: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """For degraded stops, minutes and routes used before and after. before, after: of path_routes()."""
    slow = changes.where("status = 'degraded'").join(queries.select("qid", "t0"), "qid")
    for name, routes in (("before", before), ("after", after)):
        slow = slow.join(routes.withColumnRenamed("routes", f"{name}_routes"), ["qid", "stop_id"], "left")
    minutes = lambda c: tenth_minutes(F.col(c) - F.col("t0"))
    return slow.select("qid", "stop_id", minutes("before_sec").alias("before_min"), minutes("after_sec").alias("after_min"), "before_routes", "after_routes")


def facility_layer(changes: DataFrame) -> DataFrame:
    return changes.withColumn("marker", marker(F.col("type")))


def route_shapes(feed: Feed, routes: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """shape_id, route_id, route_name, colour (a number), highlighted, points: each shape of the routes once, for the
    first of them that has it. Shapes of fewer than two points are left out. routes: of area_routes()."""
    if feed.shapes is None:
        raise ValueError("the feed has no shapes")
    numbered = ranked(routes.select("route_id", "route_name", "appears"), "n", "appears").drop("appears")
    owner = feed.trips.select("route_id", "shape_id").where("shape_id IS NOT NULL").distinct().join(numbered, "route_id")
    owner = owner.groupBy("shape_id").agg(F.min_by(F.struct("route_id", "route_name", "n"), "n").alias("r"))
    points = feed.shapes.groupBy("shape_id").agg(F.sort_array(F.collect_list(F.struct("shape_pt_sequence", "shape_pt_lat", "shape_pt_lon"))).alias("p"))
    line = F.transform("p", lambda x: F.struct(x["shape_pt_lat"].alias("lat"), x["shape_pt_lon"].alias("lon")))
    lit = F.col("r.route_id").isin(targets) if targets else F.lit(False)
    return owner.join(points.where(F.size("p") >= 2), "shape_id").select(
        "shape_id", "r.route_id", "r.route_name", (F.col("r.n") % PALETTE).cast("bigint").alias("colour"), lit.alias("highlighted"), line.alias("points")
    )


def run_stats(changes: DataFrame) -> DataFrame:
    """For each qid: stops reached before and after, lost, degraded and new."""
    of = lambda s: F.count_if(F.col("status") == s)
    return changes.groupBy("qid").agg(
        F.count("before_sec").alias("before"), F.count("after_sec").alias("after"), of("lost").alias("lost"), of("degraded").alias("degraded"), of("new").alias("new")
    )


def area_summary(meshes: DataFrame) -> DataFrame:
    """total, elderly, meshes and the elderly's share in percent with one decimal."""
    share = F.when(F.sum("pop_t") > 0, F.round(F.sum("pop_65over") / F.sum("pop_t") * 100, 1))
    return meshes.agg(F.bround(F.sum("pop_t"), 0).cast("bigint").alias("total"), F.bround(F.sum("pop_65over"), 0).cast("bigint").alias("elderly"), F.count("*").alias("meshes"), share.alias("elderly_percent"))


def scenario_label(kind: str, names: Column, detail: Column) -> Column:
    return F.format_string("%s: %s (%s)", F.lit(kind), names, detail)
