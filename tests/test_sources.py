import datetime
import zipfile

import pytest

from isospan import sources
from isospan.operators import network, report

FILES = {
    "stops": "stop_id,stop_name,stop_lat,stop_lon\nA,One,42.3000,140.9\nB,Two,42.3010,140.9\nC,Three,42.3900,140.9\n",
    "routes": "route_id,route_long_name\nr1,Old\nr1,Line\nr2,\n",
    "trips": "trip_id,route_id,service_id,shape_id\nt1,r1,wd,s1\nt2,r2,we,s1\nt3,,wd,\n",
    "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwd,1,1,1,1,1,0,0,20240101,20241231\nwe,0,0,0,0,0,1,1,20240101,20241231\n",
    "calendar_dates": "service_id,date,exception_type\nwd,20240103,2\nwe,20240103,1\n",
    "stop_times": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nt1,A,1,24:00:00,24:00:00\nt1,B,2,24:05:00,24:05:30\nt1,C,3,24:05:30,24:06:00\nt2,A,1,8:00:00,8:00:00\nt2,B,2,8:09:00,8:09:00\nt3,B,1,bad,\n",
    "shapes": "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\ns1,10,2,2\ns1,9,1,1\n",
}


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "feed.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("readme.txt", "x")
        for name, text in FILES.items():
            z.writestr(f"inner/{name}.txt", "﻿" + text)
    return str(path)


def test_feed(spark, archive, tmp_path):
    feed = sources.read_gtfs_zip(spark, archive)
    assert feed.stops.columns == ["stop_id", "stop_name", "stop_lat", "stop_lon", "stop_ord"]
    bus = network.build_bus_edges(feed)
    edges = [(r.from_stop, r.to_stop, r.departure_sec, r.arrival_sec, r.route_id) for r in bus.collect()]
    assert edges == [("A", "B", 86400, 86700, "r1")]  # the second hop takes no time
    day = network.build_bus_edges(feed, datetime.date(2024, 1, 3))
    assert [r.trip_id for r in day.collect()] == ["t2"]
    walk = network.build_walk_edges(feed)
    assert sorted((r.from_stop, r.to_stop, r.walk_time) for r in walk.collect()) == [("A", "B", 99), ("B", "A", 99)]
    assert {r.trip_id: r.route_name for r in network.trip_names(feed).collect()} == {"t1": "Line", "t2": "不明", "t3": "不明"}
    shapes = report.route_shapes(feed, report.area_routes(feed, bus), ["r1"]).first()
    assert shapes.highlighted and [tuple(p) for p in shapes.points] == [(1.0, 1.0), (2.0, 2.0)]
    sources.write_network(bus, walk, str(tmp_path / "net"), csv=True)
    again = sources.read_network(spark, str(tmp_path / "net"))
    assert (again[0].count(), again[1].count()) == (1, 2)
    r = network.network_summary(bus, walk).first()
    assert (r.nodes, r.bus_edges, r.walk_edges) == (2, 1, 2)


def test_checked_columns(spark, tmp_path):
    (tmp_path / "f.csv").write_text("name,type\na,b\n")
    with pytest.raises(sources.MissingColumns) as e:
        sources.read_facilities(spark, str(tmp_path / "f.csv"))
    assert e.value.missing == ["latitude", "longitude"]
    (tmp_path / "p.csv").write_text("Meshcode,PopT,Pop65over\n6340370000,1.5,\n12,3,4\n")
    rows = sources.read_population(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.meshcode, r.pop_t, r.pop_65over, round(r.lat, 7)) for r in rows] == [(6340370000, 1.5, 0.0, 42.2504167)]
    assert sources.optional(lambda: sources.read_population(spark, str(tmp_path / "none.csv"))) is None


def test_star_takes_all_rows(spark, sf):
    from isospan.sources import star

    count = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").count()
    feed = star.star_feed(spark, sf)
    assert feed.shapes.count() == count("events") and feed.routes.count() == count("part")
    users = spark.read.parquet(f"{sf}/events.parquet").agg({"user_id": "max"}).first()[0]
    assert feed.trips.agg({"shape_id": "max"}).first()[0] > min(users, 15) - 1


def test_many_archives(spark, archive, tmp_path):
    """Unpacked by tasks; names keep their zeros and odd signs, and archives without a feed give their root."""
    folder = tmp_path / "feeds"
    folder.mkdir()
    for name in ("007", "a b=c"):
        (folder / f"{name}.zip").write_bytes(open(archive, "rb").read())
    with zipfile.ZipFile(folder / "none.zip", "w") as z:
        z.writestr("readme.md", "x")
    feeds = sources.unzip(spark, f"file://{folder}/*.zip")
    assert sorted(feeds) == ["007", "a b=c"]
    for at in feeds.values():
        feed = sources.read_gtfs(spark, at)
        assert sorted(r.stop_id for r in feed.stops.collect()) == ["A", "B", "C"] and feed.shapes is not None
    with pytest.raises(ValueError, match="there are 2"):
        sources.read_gtfs_zip(spark, f"file://{folder}/*.zip")


def test_population_with_missing_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Meshcode,Other\n1,2\n")
    with pytest.raises(sources.MissingColumns) as e:
        sources.read_population(spark, str(tmp_path / "p.csv"))
    assert e.value.missing == ["Pop65over", "PopT"]


def test_archives_are_packed_by_tasks(spark, tmp_path, monkeypatch):
    """Several parts of a table and pieces of a file; every row comes back, in order, and no content comes to the driver."""
    from pyspark.sql import DataFrame

    from isospan.sources import feed as module

    monkeypatch.setattr(module, "CHUNK", 50)
    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    for name in FILES:
        (tmp_path / "plain" / f"{name}.txt").mkdir(parents=True)
    for name, text in FILES.items():
        head, *rows = text.splitlines()
        for k, own in enumerate((rows[:1], rows[1:])):
            (tmp_path / "plain" / f"{name}.txt" / f"part-{k:05}.csv").write_text("\n".join([head, *own]) + "\n")
    sources.zip_folders(spark, {"a": f"{tmp_path}/plain", "b": f"{tmp_path}/plain"}, f"{tmp_path}/zips")
    with zipfile.ZipFile(tmp_path / "zips" / "stops.txt-part-00001.csv" / "a.zip") as z:
        assert z.testzip() is None and z.read("stops.txt").decode().splitlines()[1:] == FILES["stops"].splitlines()[2:]
    feeds = sources.unzip(spark, f"{tmp_path}/zips/*/*.zip")
    assert sorted(feeds) == ["a", "b"]
    for at in feeds.values():
        feed = sources.read_gtfs(spark, at)
        assert [r.stop_id for r in feed.stops.orderBy("stop_ord").collect()] == ["A", "B", "C"]
        assert feed.stop_times.count() == 6 and feed.shapes.count() == 2 and feed.routes.count() == 2


@pytest.mark.parametrize("limit", ["10m", "4k"])
def test_more_calls_are_dealt_to_more_tasks(spark, sf, tmp_path, monkeypatch, limit):
    """By trip, once for all the sorts up to the edges, whatever the session's partitions; of feeds from files too, and
    whether trips are sent to them or not."""
    from pyspark.sql import functions as F

    from isospan import tables
    from isospan.sources import star

    edges = lambda bus: sorted(tuple(map(str, r)) for r in bus.select("ord.seq", "from_stop", "to_stop", "departure_sec", "arrival_sec", "trip_id", "route_id").collect())
    feed = star.star_feed(spark, sf)
    want = edges(network.build_bus_edges(feed))
    sources.write_gtfs(feed, str(tmp_path / "feed"))
    monkeypatch.setattr(tables, "SORTED_ROWS", 100, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        for again in (star.star_feed(spark, sf), sources.read_gtfs(spark, str(tmp_path / "feed"))):
            bus = network.build_bus_edges(again)
            assert edges(bus) == want
            most = bus.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert most < 150 < len(want) / 8
            assert bus._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2  # calls, trips
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_trips_are_not_dealt_by_service(spark, sf):
    """Of which there are few: most trips would meet in one task."""
    from isospan.sources import star

    feed = star.star_feed(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        text = network.running_trips(feed)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning" not in text and "BroadcastHashJoin" in text
