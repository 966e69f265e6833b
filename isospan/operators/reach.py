"""Earliest arrivals over a timetable, and the paths that lead there, for many queries at once.

A query is (qid, start_stop, t0, budget). Waiting is free and a later start never arrives earlier, so arrivals are
the least fixpoint of relaxation. A round boards: of each trip that can be caught where stops improved, the first call is
found and all later ones are reached from there, and from what is reached one walks on. So there are as many rounds as
vehicles are boarded, and walks beyond the first hop, on any best way. The cost is that of the rounds, not of the queries,
so queries go together; with a scenario column so do scenarios, which are laid over a network that is stored once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import MODE_BUS, MODE_WALK, PROFILE_HOURS, tenth_minutes
from ..tables import materialize, measured
from .ground import QUERIES, puller, walker
from .timetable import SLOT_SEC, Overlay, Timetable, lay_out

#: Rounds after which the pieces of the state are put together.
COMPACT = 8
#: Bytes of a frontier that are sent to all tasks, so that edges stay where they are; beyond, it is shuffled to them.
BROADCAST_BYTES = 16 << 20


def _apart(edges: DataFrame, queries: DataFrame) -> list[str]:
    return ["scenario"] if "scenario" in edges.columns and "scenario" in queries.columns else []


def earliest_arrivals(bus: DataFrame, walk: DataFrame, queries: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """qid, (scenario,) stop_id, arrival_sec of each stop reached by t0 + budget, the start at t0 too.

    A bus can be boarded if it leaves at or after the arrival at its stop. Both rides and walks must end by the
    deadline. A start unknown to the network reaches itself; of queries with the same qid each start counts.
    stops: as for lay_out().
    """
    apart = _apart(bus, queries)
    hours = queries.agg(F.min("t0"), F.max(F.col("t0") + F.col("budget"))).first()
    used = bus if hours[0] is None else bus.where(f"departure_sec >= {hours[0]} AND arrival_sec <= {hours[1]}")
    return search(lay_out(used, walk, apart, stops=stops), queries)


def search(table: Timetable, queries: DataFrame, overlay: Overlay | None = None) -> DataFrame:
    """As earliest_arrivals(), over a network that is laid out already, and scenarios laid over it."""
    return Search(table, queries, overlay).run()


@dataclass
class Search:
    """One fixpoint. After run(), rounds has what each round found: rows that got better."""

    table: Timetable
    queries: DataFrame
    overlay: Overlay | None = None
    rounds: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.overlay = self.overlay or Overlay()
        self.apart = ["scenario"] if "scenario" in self.queries.columns else []
        self.key = ["qid", *self.apart, "stop_id", "deadline"]
        self.row = [*self.key, "arrival_sec"]
        # Walks are bucketed by zone and joined by zone and stop, rides by stop and joined by stop and hour: the zone or stop
        # alone may deal them out.
        self.queries.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")

    def starts(self) -> DataFrame:
        end = (F.col("t0") + F.col("budget")).cast("bigint").alias("deadline")
        return self.queries.select("qid", *self.apart, F.col("start_stop").alias("stop_id"), end, F.col("t0").cast("bigint").alias("arrival_sec"))

    def _without(self, rows: DataFrame, gone: DataFrame | None, *keys: str) -> DataFrame:
        """Rows that aren't gone, in their scenario or in all."""
        return rows if gone is None else rows.join(gone, [*keys, *(c for c in self.apart if c in gone.columns)], "left_anti")

    def _tables(self) -> list[tuple[Timetable, bool]]:
        """What there is to ride and walk on, and whether the overlay takes some of it away."""
        more = self.overlay.extra
        return [(self.table, True)] + ([(more, False)] if more else [])

    def ridden(self, frontier: DataFrame, small: bool = False) -> DataFrame:
        """What trips reach from their first call that the frontier can catch. small: it may be sent to all rides, and
        then nothing is shuffled up to here."""
        found = []
        # By hour too, so that a query doesn't meet the rides of all others' hours.
        hour = lambda c: F.floor(F.col(c) / SLOT_SEC).cast("int")
        frontier = frontier.withColumn("slot", F.explode(F.sequence(hour("arrival_sec"), hour("deadline"))))
        for t, base in self._tables():
            catch = (F.broadcast(frontier) if small else frontier).join(t.trips if small else t.by_stop, ["stop_id", "slot", *t.apart])
            hits = catch.where("departure_sec >= arrival_sec AND arrives <= deadline").select("qid", *self.apart, "deadline", "trip_id", "chain", "place")
            trip = ["trip_id", "chain", *t.apart]
            first = hits.groupBy(*dict.fromkeys([*trip, "qid", "deadline", *self.apart])).agg(F.min("place").alias("from_place"))
            if base and self.overlay.gone is not None:
                # Dealt out as rides are, or they would be moved to where trips alone meet those that are gone.
                parts = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                first = self._without(first, self.overlay.gone, "trip_id").repartition(parts, *trip)
            legs = t.trips.select(*trip, "place", "to_stop", "arrives")
            # Rides are in many files of a bucket, so a merge would sort all of them.
            on = first.hint("shuffle_hash").join(legs, trip).where("place >= from_place AND arrives <= deadline")
            found.append(on.select("qid", *self.apart, F.col("to_stop").alias("stop_id"), "deadline", F.col("arrives").alias("arrival_sec")))
        return reduce(DataFrame.unionAll, found)

    def walked(self, rows: DataFrame, found_on: Sequence[tuple[Timetable, bool]] | None = None) -> DataFrame:
        """The rows, and what is one hop on foot from them."""
        found = []
        for t, base in found_on or self._tables():
            if t.zones is None:
                on = rows.join(t.walks, ["stop_id", *t.apart], "left")
            else:  # ends of walks are put together where their zone is, before they are dealt out by stop
                on = t.zoned(rows).repartition(t.zone_parts, "zone").hint("shuffle_hash").join(t.walks, ["zone", "stop_id", *t.apart], "left")
            if base and self.overlay.gone_walks is not None:
                gone = self.overlay.gone_walks.withColumn("gone", F.lit(True))
                on = on.join(gone, ["stop_id", "to_stop", *(c for c in self.apart if c in gone.columns)], "left").withColumn("to_stop", F.when(F.col("gone").isNull(), F.col("to_stop")))
            stay, go = F.struct("stop_id", "arrival_sec"), F.struct(F.col("to_stop").alias("stop_id"), (F.col("arrival_sec") + F.col("walk_time")).alias("arrival_sec"))
            both = on.select("qid", *self.apart, "deadline", F.explode(F.array(stay, go)).alias("x")).select(*self.key[:-2], "x.stop_id", "deadline", "x.arrival_sec")
            found.append(both.where("stop_id IS NOT NULL AND arrival_sec <= deadline"))
        return reduce(DataFrame.unionAll, found)

    def _best(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(self.key).agg(F.min("arrival_sec").alias("arrival_sec"))

    def better(self, met: DataFrame, state: DataFrame) -> DataFrame:
        """The best of what was met, where the state has nothing as good."""
        tagged = met.select(*self.row, F.lit(False).alias("old")).unionAll(state.select(*self.row, F.lit(True).alias("old")))
        best = tagged.groupBy(self.key).agg(F.min("arrival_sec").alias("best"), F.min(F.when(F.col("old"), F.col("arrival_sec"))).alias("had"))
        return best.where("had IS NULL OR best < had").select(*self.key, F.col("best").alias("arrival_sec"))

    def run(self) -> DataFrame:
        """qid, (scenario,) stop_id, arrival_sec of all that is reached from the starts."""
        first = self.starts()
        if not self._limit():
            return first.select("qid", *self.apart, "stop_id", "arrival_sec")
        state = self.fixpoint(first if self.grounded() else self._best(self.walked(first)).select(self.row))
        return state.groupBy("qid", *self.apart, "stop_id").agg(F.min("arrival_sec").alias("arrival_sec"))

    def _limit(self) -> bool:
        """Leave out of the table what no query can use; False if there are no queries."""
        first, last = self.queries.agg(F.min("t0"), F.max(F.col("t0") + F.col("budget"))).first()
        if first is not None:
            slots = F.explode(F.sequence(F.floor(F.col("t0") / SLOT_SEC), F.floor((F.col("t0") + F.col("budget")) / SLOT_SEC)))
            self.table = self.table.during(first, last, [r[0] for r in self.queries.where("budget >= 0").select(slots).distinct().collect()])
        return first is not None

    def grounded(self) -> bool:
        """Whether walks are found from positions."""
        return self.table.ground is not None and self.overlay.gone_walks is None

    def settled(self, met: DataFrame, state: DataFrame, shares: int, closed: bool = False) -> DataFrame:
        """What was met where it is better than the state, and what is walked from there to the end within each zone; over:
        in another zone, not compared with the state there. closed: what has no row in the state isn't asked for."""
        none, ground, zone = F.lit(None).cast("bigint"), self.table.ground, ["zone", "share"]
        rows = met.select(*self.key, F.col("arrival_sec").alias("met"), none.alias("had")).unionAll(state.select(*self.key, none.alias("met"), F.col("arrival_sec").alias("had")))
        at = self.table.zoned(rows).withColumn("share", F.pmod(F.xxhash64("qid", *self.apart), F.lit(shares)).cast("int")).repartition(self.table.zone_parts, *zone)
        both = at.groupBy(*zone, *self.key).agg(F.min("met").alias("met"), F.min("had").alias("had"))
        near = ground.near.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))).repartition(self.table.zone_parts, *zone)
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        out = ", ".join(f"`{c}` {kinds[c]}" for c in self.key) + ", arrival_sec bigint, over boolean"
        walk = walker(self.key, ground.metres, closed)
        return (both.where("had IS NOT NULL") if closed else both).groupBy(*zone).cogroup(near.groupBy(*zone)).applyInArrow(walk, out)

    def pulled(self, lost: DataFrame, before: DataFrame) -> DataFrame:
        """The earliest arrivals at stops that lost theirs (key) by a walk from a stop that kept its own. before: qid, stop_id,
        before_sec, of all scenarios."""
        ground, zone, shares = self.table.ground, ["zone", "share"], self._shares()
        at = ground.near.select("zone", "stop_id", "own").toDF("zone", "stop_id", "own")
        rows = lost.select(self.key).join(at, "stop_id").withColumn("share", F.pmod(F.xxhash64("qid", *self.apart), F.lit(shares)).cast("int"))
        near = ground.near.drop("own").join(before, "stop_id").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        dealt = [df.repartition(self.table.zone_parts, *zone).groupBy(*zone) for df in (rows, near)]
        kinds = {f.name: f.dataType.simpleString() for f in lost.schema}
        out = ", ".join(f"`{c}` {kinds[c]}" for c in self.key) + ", arrival_sec bigint"
        return dealt[0].cogroup(dealt[1]).applyInArrow(puller(self.key, ground.metres), out)

    def _shares(self) -> int:
        return -(-max(1, self.queries.count()) // QUERIES)

    def _settle(self, seeds: DataFrame, only: DataFrame | None) -> DataFrame:
        """As fixpoint(), over ground: a round walks as far as each zone goes, so it crosses into other zones once."""
        shares = self._shares()
        # What is asked for is there a second after the deadline.
        state = seeds.limit(0).select(self.row) if only is None else only.select(*self.key, (F.col("deadline") + 1).alias("arrival_sec"))
        met = seeds.select(self.row)
        while True:
            found, n, size = measured(self.settled(met, state, shares, only is not None), "stop_id")
            if not n:
                return state.where("arrival_sec <= deadline")
            self.rounds.append(n)
            frontier, met = found.where("NOT over").select(self.row), found.where("over").select(self.row)
            state = state.unionAll(frontier)
            met = met.unionAll(self.ridden(frontier, size <= BROADCAST_BYTES))
            if self.overlay.extra is not None:
                met = met.unionAll(self.walked(frontier, [(self.overlay.extra, False)]))
            if len(self.rounds) % COMPACT == 0:
                state = materialize(self._best(state).select(self.row))

    def fixpoint(self, seeds: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """All that gets better from the seeds on, in written pieces; of some keys only, if they are given."""
        if self.grounded():
            return self._settle(seeds, only)
        frontier, n, size = measured(seeds, "stop_id")
        state = frontier
        while n:
            self.rounds.append(n)
            small = size <= BROADCAST_BYTES
            rode = self.ridden(frontier, small).unionAll(frontier)
            met = self.walked(rode if small and self.table.zones is None else self._best(rode).select(self.row))
            if only is not None:
                met = met.join(only, self.key, "left_semi")
            frontier, n, size = measured(self.better(met, state), "stop_id")
            state = state.unionAll(frontier)
            if len(self.rounds) % COMPACT == 0:
                state = materialize(self._best(state).select(self.row))
        return state


def hourly_queries(queries: DataFrame, hours: range = PROFILE_HOURS) -> DataFrame:
    """Each query once for each hour as its t0; the hour takes the place of qid."""
    hour = F.explode(F.lit(list(hours)))
    return queries.withColumn("hour", hour).withColumns({"qid": F.col("hour"), "t0": F.col("hour") * 3600}).drop("hour")


def predecessors(bus: DataFrame, walk: DataFrame, arrivals: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, (scenario,) stop_id, pred_stop, mode, trip_id, route_id, edge_type, departure_sec, arrival_sec: the last
    edge of a path to each stop reached other than the start.

    Of the edges that arrive just when the stop is reached the one counts whose own stop was reached first, then that
    of the smaller stop, then a bus before a walk, the earlier departure and the earlier edge of the timetable. Edges
    are taken to last a second or more, as they all do in a network built here.
    """
    apart = _apart(bus, queries)
    start = queries.select("qid", *apart, F.col("start_stop").alias("stop_id"))
    arrivals, _, size = measured(arrivals, "stop_id")
    sent = F.broadcast if size <= 2 * BROADCAST_BYTES else lambda df: df  # then edges stay where they are
    reached = sent(arrivals.join(start, ["qid", *apart, "stop_id"], "left_anti"))
    source = sent(arrivals.select("qid", *apart, F.col("stop_id").alias("pred_stop"), F.col("arrival_sec").alias("reached_sec")))
    none = F.lit(None)
    kind = {f.name: f.dataType for f in bus.schema}
    rides = bus.select(*apart, F.col("from_stop").alias("pred_stop"), F.col("to_stop").alias("stop_id"), F.lit(0).alias("by"), "departure_sec", "arrival_sec", "ord", "trip_id", "route_id", "edge_type")
    walks = walk.select(*apart, F.col("from_stop").alias("pred_stop"), F.col("to_stop").alias("stop_id"), F.lit(1).alias("by"), "walk_time", none.cast(kind["ord"]).alias("ord"), none.cast(kind["trip_id"]).alias("trip_id"), none.cast(kind["route_id"]).alias("route_id"), "edge_type")
    ridden = reached.join(rides, [*apart, "stop_id", "arrival_sec"]).join(source, ["qid", *apart, "pred_stop"]).where("departure_sec >= reached_sec")
    walked = walks.join(source, [*apart, "pred_stop"]).join(reached, ["qid", *apart, "stop_id"]).where("reached_sec + walk_time = arrival_sec")
    walked = walked.withColumn("departure_sec", F.col("reached_sec"))
    what = ["qid", *apart, "stop_id", "reached_sec", "pred_stop", "by", "departure_sec", "ord", "trip_id", "route_id", "edge_type", "arrival_sec"]
    tight = ridden.select(what).unionAll(walked.select(what))
    first = F.min_by(F.struct("pred_stop", "by", "trip_id", "route_id", "edge_type", "departure_sec", "arrival_sec"), F.struct("reached_sec", "pred_stop", "by", "departure_sec", "ord"))
    best = tight.groupBy("qid", *apart, "stop_id").agg(first.alias("p"))
    return best.select("qid", *apart, "stop_id", "p.pred_stop", F.when(F.col("p.by") == 0, MODE_BUS).otherwise(MODE_WALK).alias("mode"), "p.trip_id", "p.route_id", "p.edge_type", "p.departure_sec", "p.arrival_sec")


def paths(preds: DataFrame, queries: DataFrame, names: DataFrame) -> DataFrame:
    """qid, (scenario,) stop_id, steps: for each stop reached the edges from the start, in order; none for the start.
    A step has from_stop, to_stop, mode, route_name (empty for walks and added lines), departure_sec, arrival_sec and
    duration_min. names: trip_id, route_name.

    Paths grow by doubling: a stop's steps so far are put behind those of the stop where they begin, so that the
    rounds are the logarithm of the longest path's length.
    """
    step = F.struct(
        F.col("pred_stop").alias("from_stop"),
        F.col("stop_id").alias("to_stop"),
        "mode",
        F.coalesce("route_name", F.lit("")).alias("route_name"),
        "departure_sec",
        "arrival_sec",
        tenth_minutes(F.col("arrival_sec") - F.col("departure_sec")).alias("duration_min"),
    )
    return _grown(preds.join(names, "trip_id", "left"), step, queries)


def trips_used(preds: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, (scenario,) stop_id, trip_id: the trips on the path to each stop reached, each once."""
    ridden = F.array_distinct(F.filter("steps", lambda t: t.isNotNull()))
    found = _grown(preds, F.col("trip_id"), queries).withColumn("trip_id", F.explode(ridden))
    return found.drop("steps")


def _grown(preds: DataFrame, step: Column, queries: DataFrame) -> DataFrame:
    """qid, (scenario,) stop_id, steps: the steps that lead from the start to each stop."""
    apart = ["scenario"] if "scenario" in preds.columns else []
    key = ["qid", *apart, "stop_id"]
    grown = preds.select(*key, F.col("pred_stop").alias("since"), F.array(step).alias("steps"))
    start = queries.select("qid", *apart, F.col("start_stop").alias("stop_id"))
    rest = [c for c in grown.columns if c not in start.columns]
    empty = start.select(*key, *(F.lit(None).cast(grown.schema[c].dataType).alias(c) for c in rest)).withColumn("steps", F.array().cast(grown.schema["steps"].dataType))
    # Paths that reach back to the start are done and set aside; the others are put behind the path to where they begin.
    grown, done = materialize(grown.unionAll(empty)), []
    while True:
        done.append(grown.where("since IS NULL"))
        open_ = grown.where("since IS NOT NULL")
        if open_.isEmpty():
            return reduce(DataFrame.unionAll, done).drop("since")
        before = reduce(DataFrame.unionAll, [*done, open_]).select("qid", *apart, F.col("stop_id").alias("since"), F.col("since").alias("since0"), F.col("steps").alias("steps0"))
        longer = open_.join(before, ["qid", *apart, "since"], "left")
        grown = materialize(longer.select(*key, F.col("since0").alias("since"), F.concat(F.coalesce("steps0", F.array().cast(grown.schema["steps"].dataType)), "steps").alias("steps")))
