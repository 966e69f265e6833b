"""Arrivals after trips are gone, from those before: only what a gone trip was on the way to is searched again.

A stop keeps its arrival as long as its path in the predecessor forest uses no trip that is gone, since to take trips
away makes nothing earlier. The others are reset: they first get what rides and walks bring from stops that keep theirs,
and then a search among themselves. What that costs follows the stops reset, not the network or the scenarios.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize
from .reach import Search
from .timetable import Overlay, Timetable


def broken(used: DataFrame, gone: DataFrame) -> DataFrame:
    """scenario, qid, stop_id of the stops whose path uses a trip that is gone. used: as trips_used() gives it, once for
    any number of scenarios; gone: scenario, trip_id."""
    return used.join(gone, "trip_id").select("scenario", "qid", "stop_id").distinct()


def repair(table: Timetable, queries: DataFrame, arrivals: DataFrame, used: DataFrame, gone: DataFrame) -> DataFrame:
    """scenario, qid, stop_id, before_sec, after_sec (null: lost) of each stop that was reset; all others keep the arrival
    that they had, in every scenario.

    queries: one row for each qid; arrivals and used: of these queries, with all trips; gone: scenario, trip_id.
    """
    ends = queries.select("qid", (F.col("t0") + F.col("budget")).cast("bigint").alias("deadline"))
    reset = materialize(broken(used, gone).join(ends, "qid"))
    asked = queries.join(gone.select("scenario").distinct(), how="cross")
    job = Search(table, asked, Overlay(gone))
    before = arrivals.select("qid", "stop_id", F.col("arrival_sec").alias("before_sec"))
    if not job._limit():
        return reset.join(before, ["qid", "stop_id"]).select("scenario", "qid", "stop_id", "before_sec", F.lit(None).cast("bigint").alias("after_sec"))
    # Into what was reset, from stops that keep their arrival.
    into = reset.withColumnRenamed("stop_id", "to_stop")
    rides = into.join(job.table.trips, "to_stop").where("arrives <= deadline").join(gone, ["scenario", "trip_id"], "left_anti")
    kept = before.withColumnRenamed("before_sec", "since")
    came = lambda e: e.join(reset.select("scenario", "qid", "stop_id"), ["scenario", "qid", "stop_id"], "left_anti").join(kept, ["qid", "stop_id"])
    got = lambda e, at: e.select("qid", "scenario", F.col("to_stop").alias("stop_id"), "deadline", at.alias("arrival_sec"))
    if job.grounded():
        walked = job.pulled(reset, before).select(job.row)
    else:
        walked = got(came(into.join(job.table.walks, "to_stop")), F.col("since") + F.col("walk_time"))
    seeds = got(came(rides).where("since <= departure_sec"), F.col("arrives")).unionAll(walked)
    found = job.fixpoint(job._best(seeds.where("arrival_sec <= deadline")).select(job.row), reset.select(job.key))
    after = found.groupBy("scenario", "qid", "stop_id").agg(F.min("arrival_sec").alias("after_sec"))
    return reset.join(before, ["qid", "stop_id"]).join(after, ["scenario", "qid", "stop_id"], "left").select("scenario", "qid", "stop_id", "before_sec", "after_sec")


def sweep_counts(arrivals: DataFrame, repaired: DataFrame, scenarios: DataFrame, threshold_min: float = 1) -> DataFrame:
    """scenario, qid, reached, lost, degraded for every scenario (scenario), also those that change nothing."""
    late = F.col("after_sec") - F.col("before_sec") >= threshold_min * 60
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    changed = repaired.groupBy("scenario", "qid").agg(count(F.col("after_sec").isNull()).alias("lost"), count(late).alias("degraded"))
    all_ = arrivals.groupBy("qid").agg(F.count("*").alias("n")).join(scenarios.select("scenario").distinct(), how="cross")
    none = {"lost": 0, "degraded": 0}
    return all_.join(changed, ["scenario", "qid"], "left").fillna(none).select("scenario", "qid", (F.col("n") - F.col("lost")).alias("reached"), "lost", "degraded")
