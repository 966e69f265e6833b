"""What a scenario changes: stops lost or slowed, people affected, facilities within reach.

Arrivals are (qid, stop_id, arrival_sec); qid keeps results apart throughout.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import FACILITY_M, POPULATION_M, WALK_M_PER_MIN, access_change, last_walk_seconds, tenth_minutes
from .spatial import around_point, nearest, nearest_of_all, pairs_within


def compare(before: DataFrame, after: DataFrame, threshold_min: float = 1, removed: Sequence = ()) -> DataFrame:
    """qid, stop_id, before_sec, after_sec, delta_sec, status: removed, lost (no longer reached), degraded (later by
    the threshold or more), new (reached only after) or unaffected."""
    both = before.withColumnRenamed("arrival_sec", "before_sec").join(after.withColumnRenamed("arrival_sec", "after_sec"), ["qid", "stop_id"], "full")
    delta = F.col("after_sec") - F.col("before_sec")
    status = (
        F.when(F.col("stop_id").isin(list(removed)) if removed else F.lit(False), "removed")
        .when(F.col("after_sec").isNull(), "lost")
        .when(F.col("before_sec").isNull(), "new")
        .when(delta >= F.lit(threshold_min * 60), "degraded")
        .otherwise("unaffected")
    )
    return both.withColumns({"delta_sec": delta, "status": status})


def sites(meshes: DataFrame) -> DataFrame:
    """Meshes of the same place as one: mesh_ord of the first, pop_t, pop_65over, meshes (their number), lat, lon. A grid
    has so many places in an area, however many rows; take them for meshes where catchments are asked for."""
    sums = [F.min("mesh_ord").alias("mesh_ord"), F.sum("pop_t").alias("pop_t"), F.sum("pop_65over").alias("pop_65over"), F.count("mesh_ord").alias("meshes")]
    return meshes.groupBy("lat", "lon").agg(*sums)


def _number(meshes: DataFrame) -> Column:
    """How many meshes a row stands for."""
    return F.col("meshes") if "meshes" in meshes.columns else F.when(F.col("mesh_ord").isNotNull(), 1).otherwise(0)


def _people(meshes: DataFrame, *by: str) -> DataFrame:
    whole = lambda c: F.bround(F.coalesce(F.sum(c), F.lit(0.0)), 0).cast("bigint")
    n = F.coalesce(F.sum(_number(meshes)), F.lit(0)).cast("bigint")
    return meshes.groupBy(*by).agg(whole("pop_t").alias("total"), whole("pop_65over").alias("elderly"), n.alias("mesh_count"))


def population_around(meshes: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """total, elderly and mesh_count around one position."""
    return _people(around_point(meshes, lat, lon, metres))


def catchments(meshes: DataFrame, stops: DataFrame, metres: float = POPULATION_M) -> DataFrame:
    """stop_id, mesh_ord of the meshes near each stop. It depends on no query, so write it once for any number of them."""
    at = stops.select("stop_id", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    return pairs_within(at, meshes.select("mesh_ord", "lat", "lon"), metres).select("stop_id", "mesh_ord")


def population_near(meshes: DataFrame, catchment: DataFrame, ids: DataFrame) -> DataFrame:
    """qid, total, elderly, mesh_count of the meshes near any of the stops; each mesh counts once. ids: qid, stop_id;
    catchment: as catchments() gives it. A qid without a mesh has no row."""
    return _people(_near(catchment, ids).join(meshes, "mesh_ord"), "qid")


def _near(catchment: DataFrame, ids: DataFrame) -> DataFrame:
    # Many stops are reached by the same queries: for a mesh these count once, not once for each of its stops and queries.
    sets = ids.groupBy("stop_id").agg(F.array_sort(F.collect_set("qid")).alias("qids"))
    met = sets.join(catchment, "stop_id").select("qids", "mesh_ord").distinct()
    return met.select(F.explode("qids").alias("qid"), "mesh_ord").distinct()


def affected_population(meshes: DataFrame, catchment: DataFrame, lost: DataFrame, reachable: DataFrame) -> DataFrame:
    """One row for each qid of reachable: people in meshes near lost stops and near none of the other reachable ones
    (affected_total, affected_elderly, uncovered_meshes), lost_meshes (near lost ones) and covered_by_others.

    Stops removed by a scenario are reachable and not lost: pass them so, and they go on covering their meshes.
    """
    rest = reachable.select("qid", "stop_id").join(lost.select("qid", "stop_id"), ["qid", "stop_id"], "left_anti")
    covered = _near(catchment, rest).withColumn("covered", F.lit(True))
    met = _near(catchment, lost).join(covered, ["qid", "mesh_ord"], "left").join(meshes.select("mesh_ord", "pop_t", "pop_65over", _number(meshes).alias("meshes")), "mesh_ord")
    open_ = F.col("covered").isNull()
    whole = lambda c: F.bround(F.coalesce(F.sum(F.when(open_, F.col(c))), F.lit(0.0)), 0).cast("bigint")
    sums = met.groupBy("qid").agg(
        whole("pop_t").alias("affected_total"),
        whole("pop_65over").alias("affected_elderly"),
        F.coalesce(F.sum(F.when(open_, F.col("meshes"))), F.lit(0)).cast("bigint").alias("uncovered_meshes"),
        F.sum("meshes").cast("bigint").alias("lost_meshes"),
    )
    out = reachable.select("qid").distinct().join(sums, "qid", "left").na.fill(0)
    return out.withColumn("covered_by_others", F.col("lost_meshes") - F.col("uncovered_meshes"))


def facility_stops(facilities: DataFrame, stops: DataFrame, max_metres: float = FACILITY_M, walk_m_per_min: float = WALK_M_PER_MIN) -> DataFrame:
    """fac_ord, name, type, latitude, longitude, nearest_stop, distance_m, walk_sec: the nearest stop of all; of equally
    near ones the first of the feed. Facilities without one in reach are left out."""
    points = facilities.select("fac_ord", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    centres = stops.select(F.col("stop_id").alias("nearest_stop"), "stop_ord", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    best = nearest(points, centres, max_metres, "fac_ord", "stop_ord")
    return facilities.join(best, "fac_ord").select(
        "fac_ord", "name", "type", "latitude", "longitude", "nearest_stop", F.bround("dist").cast("bigint").alias("distance_m"), last_walk_seconds(F.col("dist"), walk_m_per_min).alias("walk_sec")
    )


def nearest_stops(facilities: DataFrame, stops: DataFrame) -> DataFrame:
    """fac_ord, nearest_stop, distance_m of every facility with a position, however far its nearest stop is."""
    points = facilities.select("fac_ord", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    centres = stops.select(F.col("stop_id").alias("nearest_stop"), "stop_ord", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    best = nearest_of_all(points, centres, "fac_ord", "stop_ord")
    return best.select("fac_ord", "nearest_stop", F.bround("dist").cast("bigint").alias("distance_m"))


def facility_access(arrivals: DataFrame, queries: DataFrame, placed: DataFrame, stops: DataFrame) -> DataFrame:
    """For each query and facility of facility_stops(): its stop's name, walk_min, total_min (null unless accessible)
    and accessible: its nearest stop is reached. The walk from there may end after the deadline."""
    every = placed.crossJoin(queries.select("qid", "t0"))
    return _access(every.join(_reached(arrivals), ["qid", "nearest_stop"], "left"), stops)


def reached_facilities(arrivals: DataFrame, queries: DataFrame, placed: DataFrame, stops: DataFrame) -> DataFrame:
    """The accessible rows of facility_access(), found from the stops reached, without the others."""
    return _access(_reached(arrivals).join(placed, "nearest_stop").join(queries.select("qid", "t0"), "qid"), stops)


def _reached(arrivals: DataFrame) -> DataFrame:
    return arrivals.select("qid", F.col("stop_id").alias("nearest_stop"), "arrival_sec")


def _access(met: DataFrame, stops: DataFrame) -> DataFrame:
    named = met.join(stops.select(F.col("stop_id").alias("nearest_stop"), "stop_name"), "nearest_stop", "left")
    return named.select(
        "qid",
        "fac_ord",
        "name",
        "type",
        "latitude",
        "longitude",
        "nearest_stop",
        F.coalesce("stop_name", F.lit("")).alias("stop_name"),
        "distance_m",
        tenth_minutes(F.col("walk_sec")).alias("walk_min"),
        tenth_minutes(F.col("arrival_sec") - F.col("t0") + F.col("walk_sec")).alias("total_min"),
        F.col("arrival_sec").isNotNull().alias("accessible"),
    )


def of_types(facilities: DataFrame, types: Sequence[str] | None) -> DataFrame:
    """The rows of facilities, or of what comes of them, that are of these types; all if None are given."""
    return facilities if types is None else facilities.where(F.col("type").isin(list(types)))


def accessible_facilities(access: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """The accessible rows of facility_access() or reached_facilities(), those reached first at the top; equal ones by
    query and facility."""
    return of_types(access, types).where("accessible").orderBy("total_min", "qid", "fac_ord")


def facility_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Access before and after, by facility: qid, fac_ord, name, type, status, before_min, after_min."""
    a = before.select("qid", "fac_ord", "name", "type", F.col("accessible").alias("was"), F.col("total_min").alias("before_min"))
    b = after.select("qid", "fac_ord", F.col("accessible").alias("is"), F.col("total_min").alias("after_min"))
    return a.join(b, ["qid", "fac_ord"]).select(
        "qid", "fac_ord", "name", "type", access_change(F.col("was"), F.col("is")).alias("status"), "before_min", "after_min"
    )


def change_by_type(before: DataFrame, after: DataFrame, queries: DataFrame, placed: DataFrame) -> DataFrame:
    """qid, type, facilities, before, after, diff, from the stops reached before and after: only counts by type are put
    together with queries."""
    count = lambda a, name: _reached(a).join(placed, "nearest_stop").groupBy("qid", "type").agg(F.count("*").alias(name))
    types = placed.groupBy("type").agg(F.count("*").alias("facilities")).crossJoin(queries.select("qid"))
    out = types.join(count(before, "before"), ["qid", "type"], "left").join(count(after, "after"), ["qid", "type"], "left").fillna(0)
    return out.select("qid", "type", "facilities", "before", "after", (F.col("after") - F.col("before")).alias("diff"))
