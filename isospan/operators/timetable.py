"""A network laid out for searches, and changes laid over it.

Rides are kept twice: by trip, where all that happens aboard is in one place, for frontiers small enough to be sent to all
rides; and by the stop that they leave from, for those that have to be dealt out. Both are bucketed by what searches join
on and parted by the hour, so that a round of a search moves its frontier and never the rides, and reads only the hours
between its queries' first start and last deadline. A scenario is what differs from that: trips that are gone, and rides
and walks of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import LAYOUT, bucketed, materialize, read_bucketed
from .ground import STOPS, Ground, survey

SLOT_SEC = 3600
#: Degrees of latitude of a zone, about 1 km: walks from a zone end in it and few others. Squares of the stops of zones,
#: summed up, for which there is one more bucket of walks.
ZONE, ZONE_PAIRS = 0.009, 8_000_000
#: Square of the stops of a zone from where it is parted into smaller ones, by halving their sides so often at most.
CROWDED, HALVINGS = 1_000_000, 10


@dataclass(frozen=True)
class Timetable:
    """trips and rides: slot (the hour of departure), trip_id, chain, place, stop_id, to_stop, departure_sec, arrives;
    walks: stop_id, to_stop, walk_time. With a scenario column if `apart` names it.
    zones: stop_id, zone, where positions are known; walks then have their stop's zone, and are bucketed by it.
    ground: if walks are between all stops within a radius; they are then found from it, and walks is a plan of them.

    A chain is a part of a trip that can be ridden through: each ride begins where and no sooner than the one before
    it ends.
    """

    trips: DataFrame
    walks: DataFrame
    #: None in scratch layouts, where they are written for the hours of a search once its frontier is too large to be sent.
    rides: DataFrame | None = None
    apart: tuple[str, ...] = ()
    zones: DataFrame | None = None
    zone_parts: int = 0
    ground: Ground | None = None

    def zoned(self, rows: DataFrame) -> DataFrame:
        """Rows with the zone of their stop_id; stops without a position have one each."""
        return rows.join(self.zones, "stop_id", "left").withColumn("zone", F.coalesce("zone", F.xxhash64("stop_id")))

    def during(self, first: int, last: int, slots: Sequence[int] | None = None) -> Timetable:
        """What leaves and arrives between two times, and leaves in some hours if they are given; of the folders of other
        hours nothing is read."""
        hours = f"slot BETWEEN {first // SLOT_SEC} AND {last // SLOT_SEC} AND departure_sec >= {first} AND arrives <= {last}"
        if slots is not None and len(slots) <= last // SLOT_SEC - first // SLOT_SEC:
            hours += f" AND slot IN ({', '.join(map(str, slots))})"
        cut = lambda df: None if df is None else df.where(hours)
        return replace(self, trips=cut(self.trips), rides=cut(self.rides))

    @cached_property
    def by_stop(self) -> DataFrame:
        if self.rides is not None:
            return self.rides
        n, by = _parts(self.trips.sparkSession), keys_of(self.apart)["rides"]
        return bucketed(self.trips.repartition(n, *by), n, by)


def chained(bus: DataFrame, apart: Sequence[str] = ()) -> DataFrame:
    """Bus edges with the chain of their trip that they belong to, and their place in the trip."""
    ride = Window.partitionBy(*apart, "trip_id").orderBy("departure_sec", "ord")
    breaks = F.lag("to_stop").over(ride).isNull() | (F.lag("to_stop").over(ride) != F.col("from_stop")) | (F.lag("arrival_sec").over(ride) > F.col("departure_sec"))
    numbered = bus.withColumns({"place": F.row_number().over(ride), "breaks": breaks.cast("int")})
    return numbered.withColumn("chain", F.sum("breaks").over(ride.rowsBetween(Window.unboundedPreceding, 0))).drop("breaks")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lay_out(bus: DataFrame, walk: DataFrame, apart: Sequence[str] = (), folder: str | None = None, stops: DataFrame | None = None, metres: float | None = None) -> Timetable:
    """Write a network's edges for searches: to the folder, to be read again by open_timetable(), or to scratch. stops:
    stop_id, stop_lat, stop_lon; with them walks lie together by zone, so that a search moves what is reached in each
    zone and not every walk's end. metres: walk has all pairs of stops so far apart and no others; scratch layouts then write
    none of them."""
    n = _parts(bus.sparkSession)
    rides = chained(bus, apart).select(
        *apart, "trip_id", "chain", "place", F.col("from_stop").alias("stop_id"), "to_stop", "departure_sec", F.col("arrival_sec").alias("arrives"), F.floor(F.col("departure_sec") / SLOT_SEC).cast("int").alias("slot")
    )
    walks = walk.select(*apart, F.col("from_stop").alias("stop_id"), "to_stop", "walk_time")
    ground = survey(stops, metres) if metres and stops is not None and not folder and not apart else None
    if ground is not None:
        zones, parts = ground.zones, max(n, min(4 * n, ground.stops // STOPS))
    else:
        zones, parts = (None, n) if stops is None else zones_of(stops, f"{folder}/zones" if folder else None)
    table = Timetable(rides, walks, zones=zones)
    tables = {"trips": rides, "rides": rides, "walks": walks if zones is None else table.zoned(walks)}
    found = {}
    for name, by in keys_of(apart, zones is not None).items():
        if name == "rides" and not folder:
            continue
        if name == "walks" and ground is not None:
            found[name] = tables[name]
            continue
        df, k = tables[name], parts if name == "walks" else n
        found[name] = bucketed(df.repartition(k, *by), k, by, *(c for c in df.columns if c == "slot"), path=f"{folder}/{name}" if folder else None)
    return Timetable(**found, apart=tuple(apart), zones=zones, zone_parts=parts, ground=ground)


def zones_of(stops: DataFrame, path: str | None = None) -> tuple[DataFrame, int]:
    """stop_id, zone of the stops with a position, written; and in how many buckets walks between them fit. A zone with
    many stops is parted evenly, so that their walks, which grow with the square, can go to many buckets; stops in the
    same place stay together."""
    row = F.floor(F.col("stop_lat") / ZONE)
    east = F.col("stop_lon") * F.cos(F.radians(row * ZONE)) / ZONE
    at = stops.where("stop_lat IS NOT NULL AND stop_lon IS NOT NULL").select(
        "stop_id", (row * 100_000 + F.floor(east)).alias("whole"), (F.col("stop_lat") / ZONE).alias("north"), east.alias("east")
    )
    count = at.groupBy("whole").agg(F.countDistinct("stop_id").alias("n"))
    halved = F.ceil(F.log2(F.col("n") * F.col("n") / F.lit(CROWDED)) / 2)
    sides = F.pow(F.lit(2.0), F.least(halved, F.lit(HALVINGS)))
    part = F.xxhash64("whole", F.floor(F.col("north") * sides), F.floor(F.col("east") * sides))
    zones = at.join(count, "whole").select("stop_id", F.when(halved > 0, part).otherwise(F.col("whole")).alias("zone")).distinct()
    if path:
        zones.write.mode("overwrite").parquet(path)
        zones = stops.sparkSession.read.parquet(path)
    else:
        zones = materialize(zones)
    pairs = count.agg(F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()[0]
    return zones, max(_parts(stops.sparkSession), pairs // ZONE_PAIRS)


def keys_of(apart: Sequence[str] = (), zoned: bool = False) -> dict[str, list[str]]:
    """What each table is bucketed by: all that searches join it on, or of zoned walks the zone."""
    return {"trips": ["trip_id", "chain", *apart], "rides": ["stop_id", *apart], "walks": ["zone"] if zoned else ["stop_id", *apart]}


def open_timetable(spark: SparkSession, folder: str) -> Timetable:
    """What lay_out() wrote to a folder, with its buckets, hours and zones."""
    walks = spark.read.schema(LAYOUT).json(f"{folder}/walks.layout").first()
    zoned = "`zone`" in walks["columns"]
    found = {name: read_bucketed(spark, f"{folder}/{name}", by) for name, by in keys_of(zoned=zoned).items()}
    return Timetable(**found, zones=spark.read.parquet(f"{folder}/zones") if zoned else None, zone_parts=walks["buckets"])


@dataclass(frozen=True)
class Overlay:
    """What scenarios change in a network. Tables with a scenario column count for that scenario, others for all.

    gone: trip_id of trips that don't run; extra: rides and walks of scenarios; gone_walks: stop_id, to_stop.
    """

    gone: DataFrame | None = None
    extra: Timetable | None = None
    gone_walks: DataFrame | None = None
