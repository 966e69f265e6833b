"""Searches that find walks from stops' positions, against the heap search over all pairs."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from test_reach import ASKED, BUS, WALK, random_network
from test_timetable import STOPS, found, wanted

from isospan.operators import ground, impact, network, reach, repair, scenario, timetable
from isospan.operators.scenario import Network

QUERIES = [(k, k % 12, 100 * (k % 4), (150, 900)[k % 2]) for k in range(12)] + [(99, 777, 0, 300), (98, 3, 0, -5)]


@pytest.fixture(scope="module")
def town(spark):
    """Twelve stops of buses among others in several zones, some in one place, one without a position."""
    rng = random.Random(3)
    bus, _ = random_network(4, trips=60)
    places = [(k, 42.3 + rng.random() / 60, 141 + rng.random() / 60) for k in range(11)] + [(11, None, None)]
    places += [(100 + k, 42.3 + rng.random() / 60, 141 + rng.random() / 60) for k in range(120)] + [(300 + k, 42.305, 141.005) for k in range(3)]
    stops = spark.createDataFrame(places, STOPS)
    walk = [tuple(r) for r in network.stop_pairs(stops, 300.0).collect()]
    net = Network(spark.createDataFrame(bus, BUS), spark.createDataFrame(walk, WALK), stops, walk_metres=300.0).with_layout()
    return bus, walk, net


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, ASKED)


def asked(bus, walk):
    return wanted(bus, walk, [q for q in QUERIES if q[3] >= 0])


@pytest.mark.parametrize("limit", [reach.BROADCAST_BYTES, 0])
def test_walks_from_positions(spark, town, queries, monkeypatch, limit):
    bus, walk, net = town
    assert net.kept.ground is not None and net.kept.zones.select("zone").distinct().count() > 3
    monkeypatch.setattr(reach, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(reach, "QUERIES", 4)
    monkeypatch.setattr(ground, "PAIRS", 50)
    assert found(reach.search(net.kept, queries)) == asked(bus, walk)
    job = reach.Search(net.kept, queries)
    text = job.settled(job.starts(), job.starts().limit(0), 1)._jdf.queryExecution().executedPlan().toString()
    assert "walk_time" not in text  # no pairs of stops are made


def test_walks_in_a_row_are_a_round(spark):
    """Thirty walks of 30 m in a zone: before, each was a round; pairs are counted cut to whole seconds."""
    stops = spark.createDataFrame([(k, 42.3001 + k * 0.00027, 141.0) for k in range(30)], STOPS)
    walk = [tuple(r) for r in network.stop_pairs(stops, 300.0).collect()]
    net = Network(spark.createDataFrame([], BUS), spark.createDataFrame(walk, WALK), stops, walk_metres=300.0).with_layout()
    job = reach.Search(net.kept, spark.createDataFrame([(0, 0, 0, 3600)], ASKED))
    want = wanted([], walk, [(0, 0, 0, 3600)])
    assert found(job.run()) == want and len(want) == 30
    assert len(job.rounds) <= 2


def test_scenarios_over_ground(spark, town, queries):
    """Zones with hubs, removed routes and new lines, lost walks, and repair."""
    bus, walk, net = town
    zoned = scenario.demand_zone(net, 3, 1200, 40)
    clique = [tuple(r) for r in scenario.demand_edges(net.stops, 3, 1200, 40).collect()]
    assert found(scenario.arrivals(zoned, queries)) == asked(bus, walk + clique)
    changed = scenario.replace_routes(net, ["R1"], [0, 4, 100], 60)
    rows = [(tuple(r[0]), *r[1:]) for r in map(tuple, changed.bus.collect())]
    assert found(scenario.arrivals(changed, queries)) == asked(rows, walk)
    lost = {(w[0], w[1]) for w in walk[:40]}
    less = Network(net.bus, net.walk, net.stops, net.kept, gone_walk=spark.createDataFrame(list(lost), "from_stop bigint, to_stop bigint"))
    assert found(scenario.arrivals(less, queries)) == asked(bus, [w for w in walk if w[:2] not in lost])


def test_repair_over_ground(spark, town):
    bus, walk, net = town
    rows = [q for q in QUERIES if 0 <= q[3] and q[0] != 99]
    queries = spark.createDataFrame(rows, ASKED)
    gone = spark.createDataFrame([(f"s{k}", t) for k in range(4) for t in random.Random(k).sample(range(60), (1, 5, 30, 60)[k])], "scenario string, trip_id bigint")
    before = reach.search(net.kept, queries)
    used = reach.trips_used(reach.predecessors(net.bus, net.walk, before, queries), queries)
    kept = replace(net.kept, walks=None)  # no pairs are asked for
    got, was = repair.repair(kept, queries, before, used, gone).collect(), wanted(bus, walk, rows)
    assert got and all(r.before_sec == was[r.qid, r.stop_id] for r in got)
    for k in range(4):
        trips = {r.trip_id for r in gone.where(F.col("scenario") == f"s{k}").collect()}
        mine = {(r.qid, r.stop_id): r.after_sec for r in got if r.scenario == f"s{k}"}
        after = {key: t for key, t in was.items() if key not in mine} | {key: t for key, t in mine.items() if t is not None}
        assert after == wanted([e for e in bus if e[6] not in trips], walk, rows)


def test_no_ground(spark):
    """Where pairs say something else than positions, they are kept: a stop in two places, or near the antimeridian."""
    for rows in ([(1, 42.0, 141.0), (1, 42.1, 141.0)], [(1, 42.0, 179.9999)], [(1, 89.0, 10.0)]):
        assert ground.survey(spark.createDataFrame(rows, STOPS), 300.0) is None
    empty = ground.survey(spark.createDataFrame([], STOPS), 300.0)
    assert empty.zones.count() == 0
    texts = spark.createDataFrame([("a", 42.0, 141.0), ("b", 42.001, 141.0)], "stop_id string, stop_lat double, stop_lon double")
    bus = spark.createDataFrame([], BUS.replace("from_stop bigint, to_stop bigint", "from_stop string, to_stop string"))
    table = timetable.lay_out(bus, network.stop_pairs(texts, 300.0), stops=texts, metres=300.0)
    asked = spark.createDataFrame([("q", "a", 0, 300)], "qid string, start_stop string, t0 bigint, budget bigint")
    assert found(reach.search(table, asked)) == {("q", "a"): 0, ("q", "b"): 99}


def test_queries_share_catchments(spark):
    """A mesh meets what queries reach a stop once, however many they are."""
    rng = random.Random(1)
    reached = {(q, s) for q in range(6) for s in rng.sample(range(40), 30)} | {(q, s) for q in range(6) for s in (50, 51)}
    near = {(s, m) for s in range(60) for m in rng.sample(range(25), 4)}
    catchment, ids = spark.createDataFrame(list(near), "stop_id bigint, mesh_ord bigint"), spark.createDataFrame([(*r, 0) for r in reached], "qid bigint, stop_id bigint, arrival_sec bigint")
    meshes = spark.createDataFrame([(m, float(m), 1.0) for m in range(25)], "mesh_ord bigint, pop_t double, pop_65over double")
    met = {(q, m) for q, s in reached for t, m in near if s == t}
    found_ = impact.population_near(meshes, catchment, ids)
    assert {r.qid: (r.total, r.mesh_count) for r in found_.collect()} == {q: (sum(m for p, m in met if p == q), sum(p == q for p, _ in met)) for q in range(6)}
    assert "collect_set(qid" in found_._jdf.queryExecution().executedPlan().toString()


def test_only_hours_of_queries_are_read(spark):
    bus = [((0, h, 0), 0, 1, 3600 * h + 60, 3600 * h + 120, 60, h, "R", "bus") for h in range(10)]
    table = timetable.lay_out(spark.createDataFrame(bus, BUS), spark.createDataFrame([], WALK))
    asked = spark.createDataFrame([(0, 0, 3600, 600), (1, 0, 8 * 3600, 600)], ASKED)
    job = reach.Search(table, asked)
    assert found(job.run()) == {(0, 0): 3600, (0, 1): 3720, (1, 0): 28800, (1, 1): 28920}
    assert sorted(r.trip_id for r in job.table.trips.collect()) == [1, 8]
