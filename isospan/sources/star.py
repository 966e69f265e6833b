"""A feed, facilities and population read out of a star schema of orders: the test network.

The text of each table runs in Spark and in DuckDB alike; names in braces are the tables below it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..tables import dealt
from .feed import Feed
from .files import with_centres

_PLACE = (
    "CAST(42.25 AS DOUBLE) + CAST(({0}*{0}*{1} + {0}*{2}) % {3} AS DOUBLE) / {3} * CAST(0.0833 AS DOUBLE) AS {8}, "
    "CAST(140.875 AS DOUBLE) + CAST(({0}*{0}*{4} + {0}*{5}) % {6} AS DOUBLE) / {6} * CAST(0.125 AS DOUBLE) AS {9}"
)
_ORDER = "PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice"

TABLES = {
    "stops": "SELECT s_suppkey AS stop_id, s_suppkey AS stop_ord, 'Stop ' || CAST(s_suppkey - s_suppkey % 2 AS STRING) AS stop_name, "
    + _PLACE.format("s_suppkey", 31, 7919, 9973, 17, 104729, 9967, "", "stop_lat", "stop_lon")
    + " FROM {supplier}",
    "calendar": "SELECT DISTINCT o_orderpriority AS service_id, "
    "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 1 ELSE 0 END AS monday FROM {orders}",
    "trips": "SELECT o_orderkey AS trip_id, o_orderpriority AS service_id, o_custkey % (SELECT max(user_id) + 1 FROM {events}) AS shape_id, "
    "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'R' || CAST(o_custkey % 42 AS STRING) END AS route_id FROM {orders}",
    "routes": "SELECT 'R' || CAST(p_partkey AS STRING) AS route_id, CASE WHEN p_partkey = 41 THEN NULL "
    "WHEN p_partkey % 14 = 0 THEN '高速 Line ' || CAST(p_partkey AS STRING) WHEN p_partkey % 10 = 9 THEN 'Line 9' "
    "ELSE 'Line ' || CAST(p_partkey AS STRING) END AS route_long_name FROM {part}",
    "stop_times": "SELECT trip_id, stop_id, stop_sequence, arrival_sec, arrival_sec + dwell_sec AS departure_sec FROM ("
    f"SELECT o_orderkey AS trip_id, l_suppkey AS stop_id, CAST(ROW_NUMBER() OVER ({_ORDER}) AS BIGINT) AS stop_sequence, "
    "CAST(18000 + (o_orderkey*7919) % 61200 + SUM((CAST(l_quantity AS BIGINT) % 6) * 60) OVER "
    f"({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS arrival_sec, (l_partkey % 3) * 20 AS dwell_sec "
    "FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey) t",
    "facilities": "SELECT p_partkey AS fac_ord, p_name AS name, p_type AS type, "
    + _PLACE.format("p_partkey", 13, 6007, 9949, 29, 5003, 9941, "", "latitude", "longitude")
    + " FROM {part}",
    "population": "SELECT c_custkey AS mesh_ord, 6340370000 + (c_custkey*7919) % 10000 AS meshcode, "
    "CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 ELSE CAST(0 AS DOUBLE) END AS pop_t, "
    "CASE WHEN c_acctbal > 0 THEN c_acctbal / 100 ELSE CAST(0 AS DOUBLE) END * (c_nationkey % 10) / 20 AS pop_65over FROM {customer}",
    "shapes": "SELECT user_id AS shape_id, event_id AS shape_pt_sequence, "
    "CAST(42.25 AS DOUBLE) + CAST((event_id*7919) % 1000 AS DOUBLE) / 1000 * CAST(0.0833 AS DOUBLE) AS shape_pt_lat, "
    "CAST(140.875 AS DOUBLE) + CAST((event_id*6007) % 1000 AS DOUBLE) / 1000 * CAST(0.125 AS DOUBLE) AS shape_pt_lon "
    "FROM {events}",
}


def star_table(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """given: tables below it that aren't to be read from the folder."""
    text = TABLES[name]
    below = set(re.findall(r"\{(\w+)\}", text)) - given.keys()
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in below}, **given)


def star_feed(spark: SparkSession, sf_dir: str) -> Feed:
    names = ("stops", "routes", "trips", "calendar", "shapes")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = lines.count()  # of the files' footers
    # Every step up to the edges joins or sorts by order, that is by trip, and stays in these partitions.
    times = star_table(spark, sf_dir, "stop_times", lineitem=dealt(lines, n, "l_orderkey"))
    return Feed(**{n: star_table(spark, sf_dir, n) for n in names}, stop_times=times, calls=n)


def star_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_centres(star_table(spark, sf_dir, "population"))


def star_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_table(spark, sf_dir, "facilities")
