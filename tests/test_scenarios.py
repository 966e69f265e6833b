import pytest

from isospan.operators import impact, reach, scenario
from isospan.operators.scenario import Network

from test_reach import ASKED, BUS, WALK, random_network


@pytest.fixture(scope="module")
def net(spark):
    bus, walk = random_network(3)
    bus.append(((0, 900, 0), 1, 2, 10, 20, 10, 900, None, "bus"))
    stops = [(s, s, f"S{s}", 42.3 + s * 0.001, 140.9) for s in range(12)]
    return Network(
        spark.createDataFrame(bus, BUS),
        spark.createDataFrame(walk, WALK),
        spark.createDataFrame(stops, "stop_id bigint, stop_ord bigint, stop_name string, stop_lat double, stop_lon double"),
    )


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, 1, 0, 500)], ASKED)


def reached(net, queries):
    return {r.stop_id: r.arrival_sec for r in reach.earliest_arrivals(net.bus, net.walk, queries).collect()}


def test_removal_and_thinning_never_help(net, queries):
    base = reached(net, queries)
    for less in (
        scenario.remove_routes(net, "R1"),
        scenario.remove_routes(net, ["R1", "R2", "R3"]),
        scenario.halve_route(net, "R2"),
        scenario.keep_every(net, "R2", 3),
        scenario.thin_all(net, 0.5),
    ):
        assert less.bus.count() < net.bus.count()
        assert less.bus.where("route_id IS NULL").count() == 1
        after = reached(less, queries)
        assert after.keys() <= base.keys() and all(after[s] >= base[s] for s in after)
    assert scenario.remove_routes(net, []).bus.count() == scenario.remove_routes(net, None).bus.count() == net.bus.count()


def trips_left(net, route):
    return sorted(r.trip_id for r in net.bus.where(f"route_id = '{route}'").select("trip_id").distinct().collect())


def test_which_trips_go(spark):
    rows = [((0, t, 0), 1, 2, d, d + 10, 10, t, "R", "bus") for t, d in enumerate((50, 40, 30, 20, 10))]
    net = Network(spark.createDataFrame(rows, BUS), None, None)
    assert trips_left(scenario.halve_route(net, "R"), "R") == [0, 2, 4]
    assert trips_left(scenario.keep_every(net, "R", 2), "R") == [0, 2, 4]
    assert trips_left(scenario.keep_every(net, "R", 4), "R") == [0, 4]
    assert trips_left(scenario.thin_all(net, 0.4), "R") == [0, 1, 3]
    assert trips_left(scenario.thin_all(net, 0.01), "R") == [0, 1, 2, 3]


def test_stop_removal(spark, net, queries):
    less = scenario.remove_stops(net, [2, 5])
    for edges in (less.bus, less.walk):
        assert edges.where("from_stop IN (2, 5) OR to_stop IN (2, 5)").count() == 0
    assert not {2, 5} & reached(less, queries).keys()
    own = scenario.remove_stops(net, [1])
    assert reached(own, queries) == {1: 0}
    # Without a removal, dwell is lost and hops from a stop to itself go.
    rows = [((0, 7, 0), 1, 2, 10, 20, 10, 7, "R", "bus"), ((0, 7, 1), 2, 2, 25, 30, 5, 7, "R", "bus"), ((0, 7, 2), 2, 3, 40, 50, 10, 7, "R", "bus")]
    plain = scenario.remove_stops(Network(spark.createDataFrame(rows, BUS), net.walk, net.stops), [11])
    got = [tuple(r) for r in plain.bus.orderBy("ord").select("from_stop", "to_stop", "departure_sec", "arrival_sec").collect()]
    assert got == [(1, 2, 10, 20), (2, 3, 30, 50)]


def test_new_service(net, queries):
    base = reached(net, queries)
    for more in (scenario.demand_zone(net, 1, 250, 60), scenario.replace_routes(net, None, [1, 4, 9, 500])):
        after = reached(more, queries)
        assert base.keys() <= after.keys()
    zone = scenario.demand_edges(net.stops, 1, 250, 60)
    assert {(r.from_stop, r.to_stop) for r in zone.collect()} == {(a, b) for a in range(4) for b in range(4) if a != b}
    assert scenario.demand_edges(net.stops, 999).count() == 0
    line = scenario.line_edges(net, [1, 4, 999, 9], 60, 30)
    assert line.count() == 17 * 2 and line.where("departure_sec < 18000 OR trip_id >= 0").count() == 0
    assert scenario.replace_routes(net, None, [1]).bus.count() == net.bus.count()


def test_compare(spark):
    rows = lambda x: spark.createDataFrame([(0, s, t) for s, t in x.items()], "qid bigint, stop_id bigint, arrival_sec bigint")
    changed = impact.compare(rows({1: 0, 2: 60, 3: 60, 4: 60, 5: 60}), rows({1: 0, 2: 120, 3: 119, 6: 5}), 1, removed=[5])
    assert {r.stop_id: r.status for r in changed.collect()} == {1: "unaffected", 2: "degraded", 3: "unaffected", 4: "lost", 5: "removed", 6: "new"}


def test_thinning_a_route_of_many_trips(spark):
    """Place times trips that go is beyond 32 bits."""
    n = 90_000
    rows = spark.range(n).selectExpr("named_struct('part', 0, 'trip', id, 'seq', 0L) AS ord", "1L AS from_stop", "2L AS to_stop", "id AS departure_sec", "id + 10 AS arrival_sec", "10L AS travel_time", "id AS trip_id", "'R' AS route_id", "'bus' AS edge_type")
    left = {r.trip_id for r in scenario.thin_all(Network(rows, None, None), 0.3).bus.select("trip_id").collect()}
    assert left == set(range(n)) - {int(i * (n / 27_000)) for i in range(27_000)}
