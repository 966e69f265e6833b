"""One query for each operator: callables of (spark, sf_dir) over the network that the star-schema tables describe."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import WALK_EDGE_M, format_time, parse_time, percent_text, thousands, whole_minutes, with_access, without_access
from ..operators import impact, network, reach, repair, report, scenario
from ..operators.scenario import Network
from ..operators.timetable import Overlay
from ..sources import MissingColumns, read_facilities, read_gtfs, read_network, read_population, read_timetable, unzip, write_gtfs, write_network, zip_folders
from ..sources.feed import Feed
from ..sources.star import star_facilities, star_feed, star_population
from ..tables import materialize, scratch

# The default query and scenarios.
ORIGIN, T0, BUDGET = 0, 8 * 3600, 30 * 60
ROUTE, ROUTES = "R1", ("R1", "R2", "R3", "R4", "R5", "R6")
STOPS, WALK_M = (1, 2, 5, 7), 300.0
THIN_ROUTE, KEEP_EVERY, RATIO = "R3", 3, 0.3
ZONE_M, ZONE_SEC = 2000.0, 900
ORIGINS, HOURS, MINUTES = (0, 3, 7), (6, 8, 12, 18, 21), (15, 30)
LINE, LINE_MIN, LINE_KMH = (0, 3, 6, 9), 30, 25
NAME = "Stop 0"
POINT = (42.29, 140.94, 1500.0)
SLOW_M_PER_MIN, TYPES = 50.0, ("ECONOMY", "PROMO", "STANDARD")

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Case:
    """A feed with its network, and the default query."""

    spark: SparkSession
    sf_dir: str
    feed: Feed
    queries: DataFrame

    @property
    def edges(self) -> Network:
        """Without a layout: for queries that search nothing. Built once for each session and folder, and written, as
        prebuilt edges are; queries that ask for no edges build none."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _edges:
            _edges[key] = Network(self.bus, materialize(network.build_walk_edges(self.feed)), self.feed.stops)
        return _edges[key]

    @property
    def bus(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _bus:
            _bus[key] = materialize(network.build_bus_edges(self.feed))
        return _bus[key]

    @property
    def net(self) -> Network:
        """The rides with their layout, written once too. Walks are made where a query asks for them as edges: searches
        find them between all stops within the radius."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _built:
            walk = network.build_walk_edges(self.feed)
            _built[key] = Network(self.bus, walk, self.feed.stops, walk_metres=WALK_EDGE_M).with_layout()
        return _built[key]


_bus: dict[tuple[str, str], DataFrame] = {}
_edges: dict[tuple[str, str], Network] = {}
_built: dict[tuple[str, str], Network] = {}


def case(spark: SparkSession, sf_dir: str) -> Case:
    return Case(spark, sf_dir, star_feed(spark, sf_dir), one_query(spark))


def one_query(spark: SparkSession, budget: int = BUDGET) -> DataFrame:
    return spark.createDataFrame([(0, ORIGIN, T0, budget)], "qid bigint, start_stop bigint, t0 bigint, budget bigint")


def arrivals(c: Case, net: Network | None = None) -> DataFrame:
    return scenario.arrivals(net or c.net, c.queries)


def before_after(c: Case, after: Network) -> tuple[DataFrame, DataFrame]:
    """Arrivals in the base network and in a scenario, from one fixpoint over both."""
    mark = lambda df, k: df.withColumn("scenario", F.lit(k))
    if after.kept is not None:
        both = reach.search(c.net.kept, mark(c.queries, 0).unionAll(mark(c.queries, 1)), scenario.overlay({1: after}))
        return tuple(both.where(F.col("scenario") == k).drop("scenario") for k in (0, 1))
    bus = mark(c.net.bus, 0).unionByName(mark(after.bus, 1))
    walk = mark(c.net.walk, 0).unionByName(mark(after.walk, 1))
    both = reach.earliest_arrivals(bus, walk, mark(c.queries, 0).unionAll(mark(c.queries, 1)), c.feed.stops)
    return tuple(both.where(F.col("scenario") == k).drop("scenario") for k in (0, 1))


def without_routes(c: Case, net: Network | None = None) -> Network:
    return scenario.remove_routes(net or c.net, ROUTES)


def changes(c: Case) -> DataFrame:
    return impact.compare(*before_after(c, without_routes(c)))


QUERIES: dict[str, Query] = {}


def query(f: Callable[[Case], DataFrame]) -> Callable[[Case], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(case(spark, sf_dir))
    return f


def _clock(c: Case) -> DataFrame:
    s = F.col("arrival_sec")
    text = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), (s % 60).cast("bigint"))
    return c.feed.stop_times.select("trip_id", "stop_sequence", text.alias("time_text"), "arrival_sec")


@query
def parse_times(c):
    return _clock(c).select("trip_id", "stop_sequence", "time_text", parse_time("time_text").alias("seconds"))


@query
def format_times(c):
    return c.feed.stop_times.select("trip_id", "stop_sequence", format_time(F.col("arrival_sec")).alias("hhmm"))


@query
def mesh_latlon(c):
    meshes = star_population(c.spark, c.sf_dir)
    return meshes.select("mesh_ord", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query
def weekday_trips(c):
    return network.running_trips(c.feed).select("trip_id", "route_id")


@query
def bus_edges(c):
    edges = network.build_bus_edges(c.feed)
    return edges.select("from_stop", "to_stop", "departure_sec", "arrival_sec", "travel_time", "trip_id", "route_id", "edge_type")


@query
def walk_edges(c):
    return network.build_walk_edges(c.feed)


@query
def network_summary(c):
    return network.network_summary(c.edges.bus, c.edges.walk)


@query
def trip_route_names(c):
    return network.trip_names(c.feed)


@query
def bbox_stops(c):
    return report.bbox_stops(c.feed.stops).select("stop_id", "stop_name")


@query
def bbox_routes(c):
    return report.area_routes(c.feed, c.edges.bus).select("route_id", "route_name")


@query
def stop_names(c):
    return report.stop_names(c.feed.stops)


@query
def stop_ids_by_name(c):
    return report.stop_ids_by_name(c.feed.stops, NAME).select("stop_id")


@query
def default_origin(c):
    return report.default_origin(c.feed.stops, NAME)


@query
def routes_direct_vs_transfer(c):
    return report.routes_by_access(c.feed, c.edges.bus, c.edges.walk, NAME).select("route_id", "route_name", "direct")


@query
def isochrone(c):
    return arrivals(c)


@query
def isochrone_bands(c):
    return report.bands(arrivals(c), c.queries)


def _profile(c: Case) -> DataFrame:
    return scenario.arrivals(c.net, reach.hourly_queries(c.queries))


@query
def hourly_profile(c):
    return _profile(c).withColumnRenamed("qid", "hour")


@query
def reached_by_hour(c):
    return report.reached_by_hour(_profile(c))


@query
def route_removal(c):
    return arrivals(c, scenario.remove_routes(c.net, ROUTE))


@query
def multi_route_removal(c):
    return arrivals(c, without_routes(c))


def _plain(bus: DataFrame) -> DataFrame:
    return bus.select("from_stop", "to_stop", "departure_sec", "arrival_sec", "travel_time", "trip_id", "route_id")


@query
def route_removal_edges(c):
    return _plain(without_routes(c, c.edges).bus)


def _without_stops(c: Case) -> Network:
    return scenario.remove_stops(c.edges, STOPS, WALK_M)


@query
def stop_removal_bus_edges(c):
    return _plain(_without_stops(c).bus)


@query
def stop_removal_walk_edges(c):
    return _without_stops(c).walk


@query
def stop_removal(c):
    return arrivals(c, _without_stops(c))


def _half(c: Case, net: Network | None = None) -> Network:
    return scenario.halve_route(net or c.net, THIN_ROUTE)


def _every(c: Case, net: Network | None = None) -> Network:
    return scenario.keep_every(net or c.net, THIN_ROUTE, KEEP_EVERY)


def _thin(c: Case, net: Network | None = None) -> Network:
    return scenario.thin_all(net or c.net, RATIO)


@query
def thin_half_trips(c):
    return _half(c, c.edges).bus.where(F.col("route_id") == THIN_ROUTE).select("trip_id").distinct()


@query
def thin_interval_trips(c):
    return _every(c, c.edges).bus.where(F.col("route_id") == THIN_ROUTE).select("trip_id").distinct()


@query
def thin_all_trips(c):
    return _thin(c, c.edges).bus.select("trip_id", "route_id").distinct()


@query
def frequency_half(c):
    return arrivals(c, _half(c))


@query
def frequency_interval(c):
    return arrivals(c, _every(c))


@query
def frequency_all(c):
    return arrivals(c, _thin(c))


@query
def demand_edges(c):
    return scenario.demand_edges(c.feed.stops, ORIGIN, ZONE_M, ZONE_SEC)


@query
def demand_predecessors(c):
    """The last ride or walk to each stop with a zone, found by way of its hub."""
    zoned = scenario.demand_zone(c.net, ORIGIN, ZONE_M, ZONE_SEC)
    reached = materialize(scenario.arrivals(zoned, c.queries, hubs=True))
    preds = reach.predecessors(zoned.bus, c.net.walk.unionByName(zoned.new_walk), reached, c.queries)
    found = scenario.without_hubs(preds, zoned.hubs)
    return found.select("qid", "stop_id", "pred_stop", "mode", "trip_id", "edge_type", "arrival_sec")


@query
def demand_transit(c):
    return arrivals(c, scenario.demand_zone(c.net, ORIGIN, ZONE_M, ZONE_SEC))


@query
def replacement_edges(c):
    return _plain(scenario.line_edges(c.edges, LINE, LINE_MIN, LINE_KMH))


@query
def route_replacement(c):
    return arrivals(c, scenario.replace_routes(c.net, ROUTES, LINE, LINE_MIN, LINE_KMH))


def _routes(c: Case) -> DataFrame:
    return c.net.bus.where("route_id IS NOT NULL").select("route_id", F.col("route_id").alias("scenario")).distinct()


def _swept(c: Case) -> tuple[DataFrame, DataFrame]:
    """Arrivals, and what each single route that goes changes in them."""
    before = materialize(arrivals(c))
    used = materialize(reach.trips_used(_preds(c, reached=before), c.queries))
    return before, repair.repair(c.net.kept, c.queries, before, used, materialize(scenario.trips_of(c.net, _routes(c))))


@query
def route_sweep(c):
    """Every route taken away alone: the stops that are then reached later or no more."""
    found = _swept(c)[1].where("after_sec IS NULL OR after_sec > before_sec")
    return found.select(F.col("scenario").alias("route_id"), "qid", "stop_id", "before_sec", "after_sec")


@query
def route_sweep_counts(c):
    counts = repair.sweep_counts(*_swept(c), _routes(c))
    return counts.withColumnRenamed("scenario", "route_id")


@query
def route_pairs(c):
    """Routes taken away two at a time, in one search over the network that is stored once."""
    pairs = [(a, b) for k, a in enumerate(ROUTES) for b in ROUTES[k + 1 :]]
    routes = c.spark.createDataFrame([(r, f"{a}+{b}") for a, b in pairs for r in (a, b)], "route_id string, scenario string")
    gone = materialize(scenario.trips_of(c.net, routes))
    found = reach.search(c.net.kept, c.queries.join(routes.select("scenario").distinct(), how="cross"), Overlay(gone))
    return found.select("scenario", "qid", "stop_id", "arrival_sec")


@query
def origins_hours(c):
    """Several origins, hours and budgets in one search; qid is origin * 10000 + hour * 100 + minutes of the budget."""
    asked = c.spark.createDataFrame([(s * 10000 + h * 100 + m, s, h * 3600, m * 60) for s in ORIGINS for h in HOURS for m in MINUTES], "qid bigint, start_stop bigint, t0 bigint, budget bigint")
    return scenario.arrivals(c.net, asked)


@query
def compare_results(c):
    return changes(c)


@query
def degraded_top10(c):
    return report.top_degraded(changes(c)).select("stop_id", "delta_sec")


@query
def run_stats(c):
    return report.run_stats(changes(c))


@query
def stop_status_layer(c):
    return report.stop_layer(changes(c), c.feed.stops, c.queries).drop("stop_lat", "stop_lon")


@query
def population_in_radius(c):
    return impact.population_around(star_population(c.spark, c.sf_dir), *POINT)


@query
def area_summary(c):
    return report.area_summary(star_population(c.spark, c.sf_dir))


_near: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _catchments(c: Case) -> tuple[DataFrame, DataFrame]:
    """The places of meshes and which of them are near each stop; made once for each session and folder, as the network is."""
    key = (c.spark.sparkContext.applicationId, c.sf_dir)
    if key not in _near:
        places = materialize(impact.sites(star_population(c.spark, c.sf_dir)))
        _near[key] = places, materialize(impact.catchments(places, c.feed.stops))
    return _near[key]


@query
def population_near_stops(c):
    return impact.population_near(*_catchments(c), arrivals(c))


@query
def population_by_hour(c):
    """People near what each hour reaches, from one search and one set of catchments."""
    return impact.population_near(*_catchments(c), _profile(c)).withColumnRenamed("qid", "hour")


@query
def impact_population(c):
    before, after = before_after(c, without_routes(c))
    lost = impact.compare(before, after).where("status = 'lost'")
    return impact.affected_population(*_catchments(c), lost, before)


@query
def facility_types(c):
    return star_facilities(c.spark, c.sf_dir).select("type").distinct().orderBy("type")


def _placed(c: Case) -> DataFrame:
    return materialize(impact.facility_stops(star_facilities(c.spark, c.sf_dir), c.feed.stops))


@query
def facility_nearest_stop(c):
    return _placed(c).select("fac_ord", "nearest_stop", "distance_m", "walk_sec")


@query
def facility_nearest_any(c):
    """However far: no facility is left out."""
    return impact.nearest_stops(star_facilities(c.spark, c.sf_dir), c.feed.stops)


@query
def facility_access(c):
    found = impact.facility_access(arrivals(c), c.queries, _placed(c), c.feed.stops)
    return found.drop("latitude", "longitude")


def _facility_changes(c: Case) -> DataFrame:
    placed = _placed(c)
    return impact.facility_changes(*(impact.facility_access(a, c.queries, placed, c.feed.stops) for a in before_after(c, without_routes(c))))


@query
def facility_change(c):
    return report.facility_layer(_facility_changes(c))


@query
def facility_delta_by_type(c):
    return impact.change_by_type(*before_after(c, without_routes(c)), c.queries, _placed(c))


@query
def lost_facilities(c):
    return _facility_changes(c).where("status = 'lost'").select("fac_ord", "name", "type")


def _preds(c: Case, net: Network | None = None, reached: DataFrame | None = None) -> DataFrame:
    net = net or c.net
    return materialize(reach.predecessors(net.bus, net.walk, arrivals(c, net) if reached is None else reached, c.queries))


@query
def predecessors(c):
    return _preds(c).drop("route_id")


def _paths(c: Case, net: Network | None = None, reached: DataFrame | None = None) -> DataFrame:
    return reach.paths(_preds(c, net, reached), c.queries, network.trip_names(c.feed))


@query
def paths(c):
    step = lambda s: F.concat_ws("|", *(s[k] for k in ("from_stop", "to_stop", "mode", "route_name", "departure_sec", "arrival_sec")))
    return _paths(c).select("qid", "stop_id", F.size("steps").cast("bigint").alias("n_steps"), F.array_join(F.transform("steps", step), ";").alias("path"))


@query
def path_routes(c):
    found = report.path_routes(_paths(c))
    return found.select("qid", "stop_id", F.array_join("routes", ";").alias("routes"))


@query
def itinerary_text(c):
    return report.itinerary(_paths(c), c.feed.stops)


@query
def degraded_detail(c):
    after = without_routes(c)
    was, now = before_after(c, after)
    routes = [report.path_routes(_paths(c, net, reached)) for net, reached in ((c.net, was), (after, now))]
    detail = report.degraded_detail(impact.compare(was, now), c.queries, *routes)
    return detail.withColumns({k: F.array_join(k, ";") for k in ("before_routes", "after_routes")})


@query
def shape_polylines(c):
    lines = report.route_shapes(c.feed, report.area_routes(c.feed, c.edges.bus), [ROUTE])
    point = lambda p: F.concat_ws(" ", F.round(p["lat"] * 1e6).cast("bigint"), F.round(p["lon"] * 1e6).cast("bigint"))
    return lines.select(
        "shape_id", "route_id", "colour", "highlighted", F.size("points").cast("bigint").alias("n_points"), F.array_join(F.transform("points", point), ",").alias("line")
    )


def _stop_changes(c: Case) -> tuple[DataFrame, DataFrame]:
    before, after = before_after(c, _without_stops(c))
    return before, impact.compare(before, after, removed=STOPS)


@query
def stop_removal_changes(c):
    return _stop_changes(c)[1]


@query
def stop_removal_layer(c):
    return report.stop_layer(_stop_changes(c)[1], c.feed.stops, c.queries).drop("stop_lat", "stop_lon")


@query
def stop_removal_population(c):
    before, changed = _stop_changes(c)
    return impact.affected_population(*_catchments(c), changed.where("status = 'lost'"), before)


@query
def accessible_facilities(c):
    found = impact.reached_facilities(arrivals(c), c.queries, _placed(c), c.feed.stops)
    return impact.accessible_facilities(found, TYPES).select("qid", "fac_ord", "name", "type", "total_min")


@query
def facility_access_slow(c):
    placed = materialize(impact.facility_stops(star_facilities(c.spark, c.sf_dir), c.feed.stops, walk_m_per_min=SLOW_M_PER_MIN))
    found = impact.facility_access(arrivals(c), c.queries, placed, c.feed.stops)
    return found.select("qid", "fac_ord", "walk_min", "total_min", "accessible")


@query
def scenario_labels(c):
    routes = report.routes_by_access(c.feed, c.edges.bus, c.edges.walk, NAME)
    label = with_access(F.col("route_name"), F.col("direct"))
    return routes.select("route_id", label.alias("label"), without_access(label).alias("plain"), report.scenario_label("route removal", F.col("route_name"), F.lit("weekdays")).alias("scenario"))


@query
def summary_text(c):
    people = report.area_summary(star_population(c.spark, c.sf_dir))
    return people.select(thousands(F.col("total")).alias("total"), thousands(F.col("elderly")).alias("elderly"), percent_text(F.col("elderly_percent")).alias("share"))


@query
def minutes_text(c):
    banded = report.bands(arrivals(c), c.queries)
    return banded.select("qid", "stop_id", whole_minutes(F.col("travel_min")).alias("minutes"))


@query
def gtfs_bus_edges(c):
    """The feed written as GTFS text, read again, and its network."""
    folder = scratch(c.spark)
    write_gtfs(c.feed, folder)
    feed = read_gtfs(c.spark, folder)
    edges = network.build_bus_edges(feed)
    number = {k: F.col(k).cast("bigint") for k in ("from_stop", "to_stop", "trip_id")}
    return edges.withColumns(number).select("from_stop", "to_stop", "departure_sec", "arrival_sec", "travel_time", "trip_id", "route_id")


@query
def gtfs_shapes(c):
    folder = scratch(c.spark)
    write_gtfs(c.feed, folder)
    shapes = read_gtfs(c.spark, folder).shapes
    return shapes.select(F.col("shape_id").cast("bigint").alias("shape_id"), "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon")


@query
def network_files(c):
    """The walks of a network written and read again."""
    folder = scratch(c.spark)
    write_network(c.edges.bus, c.edges.walk, folder, csv=True, stops=c.feed.stops)
    return read_network(c.spark, folder)[1]


@query
def network_bus_files(c):
    """The rides of a network written and read again."""
    folder = scratch(c.spark)
    write_network(c.edges.bus, c.edges.walk, folder, stops=c.feed.stops)
    return _plain(read_network(c.spark, folder)[0])


@query
def kept_layout(c):
    """Arrivals over a layout that was written with a network and opened again."""
    folder = scratch(c.spark)
    write_network(c.edges.bus, c.edges.walk, folder, stops=c.feed.stops)
    return reach.search(read_timetable(c.spark, folder), reach.hourly_queries(c.queries)).withColumnRenamed("qid", "hour")


@query
def gtfs_archives(c):
    """Feeds in archives, unpacked by tasks: their bus edges, by feed."""
    folder, plain = scratch(c.spark), scratch(c.spark)
    write_gtfs(c.feed, plain)
    zip_folders(c.spark, {"first": plain, "second": plain}, folder)
    feeds = unzip(c.spark, f"{folder}/*/*.zip")
    edges = [network.build_bus_edges(read_gtfs(c.spark, at)).withColumn("feed", F.lit(name)) for name, at in sorted(feeds.items())]
    number = {k: F.col(k).cast("bigint") for k in ("from_stop", "to_stop", "trip_id")}
    return edges[0].unionByName(edges[1]).withColumns(number).select("feed", "from_stop", "to_stop", "departure_sec", "arrival_sec", "trip_id", "route_id")


@query
def checked_files(c):
    """What facility and population files lack, and their rows if nothing is missing."""
    folder, found = scratch(c.spark), []
    people = star_population(c.spark, c.sf_dir).select(F.col("meshcode").alias("Meshcode"), F.col("pop_t").alias("PopT"), F.col("pop_65over").alias("Pop65over"))
    tables = {"facilities": (star_facilities(c.spark, c.sf_dir), read_facilities, ("type", "latitude")), "population": (people, read_population, ("PopT",))}
    for name, (table, read, drop) in tables.items():
        for kind, df in (("whole", table), ("less", table.drop(*drop))):
            df.write.csv(f"{folder}/{name}_{kind}", header=True)
            try:
                found.append(read(c.spark, f"{folder}/{name}_{kind}").agg(F.lit(f"{name} {kind}").alias("file"), F.lit("").alias("missing"), F.count("*").alias("n")))
            except MissingColumns as e:
                found.append(c.spark.range(1).select(F.lit(f"{name} {kind}").alias("file"), F.lit(",".join(e.missing)).alias("missing"), F.lit(None).cast("bigint").alias("n")))
    return reduce(DataFrame.unionAll, found)


@query
def feed_tables(c):
    """Rows of each table of a feed that was written without shapes, and of one with them; null where there is none."""
    found = []
    for name, feed in (("with", c.feed), ("without", replace(c.feed, shapes=None))):
        folder = scratch(c.spark)
        write_gtfs(feed, folder)
        back = read_gtfs(c.spark, folder)
        for table in ("stops", "stop_times", "shapes", "calendar_dates"):
            df = getattr(back, table)
            n = c.spark.range(1).select(F.lit(None).cast("bigint").alias("n")) if df is None else df.agg(F.count("*").alias("n"))
            found.append(n.select(F.lit(name).alias("feed"), F.lit(table).alias("name"), "n"))
    return reduce(DataFrame.unionAll, found)


@query
def population_csv(c):
    folder = scratch(c.spark)
    meshes = star_population(c.spark, c.sf_dir)
    meshes.select(F.col("meshcode").alias("Meshcode"), F.col("pop_t").alias("PopT"), F.col("pop_65over").alias("Pop65over")).write.csv(folder, header=True)
    return read_population(c.spark, folder).select("meshcode", "pop_t", "pop_65over", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query
def facilities_csv(c):
    folder = scratch(c.spark)
    star_facilities(c.spark, c.sf_dir).select("name", "type", "latitude", "longitude").write.csv(folder, header=True)
    return read_facilities(c.spark, folder).drop("fac_ord")
