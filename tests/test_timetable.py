"""Searches over a kept layout: rounds, plans, scenarios laid over it, and repaired arrivals."""

import random

import pytest
from pyspark.sql import functions as F
from test_reach import ASKED, BUS, WALK, random_network, search

from isospan.operators import reach, repair, scenario, timetable
from isospan.operators.scenario import Network
from isospan.operators.timetable import Overlay

STOPS = "stop_id bigint, stop_lat double, stop_lon double"
QUERIES = [(k, k % 12, 100 * (k % 4), (150, 400)[k % 2]) for k in range(12)]


def trips(*calls, gap=0):
    """Rides of trips given as [(stop, time), ...]; `gap` seconds of stay at each call."""
    return [((0, t, k), a, b, x + gap, y, y - x - gap, t, f"R{t}", "bus") for t, c in enumerate(calls) for k, ((a, x), (b, y)) in enumerate(zip(c, c[1:], strict=False))]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def network(spark):
    bus, walk = random_network(4, trips=60)
    stops = spark.createDataFrame([(k, 42.0 + k / 500, 141.0) for k in range(12)], STOPS)
    return bus, walk, Network(spark.createDataFrame(bus, BUS), spark.createDataFrame(walk, WALK), stops).with_layout()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, ASKED)


def wanted(bus, walk, asked=QUERIES):
    return {(q, s): t for q, start, t0, budget in asked for s, t in search(bus, walk, start, t0, budget)[0].items()}


def found(df, *keys):
    return {tuple(r[k] for k in (*keys, "qid", "stop_id")): r.arrival_sec for r in df.collect()}


def test_rounds_are_boardings(spark):
    """Three long trips with a change between them: three rounds that find something, whatever the number of calls."""
    long = [[(100 * t + k, 1000 * t + 10 * k) for k in range(30)] for t in range(3)]
    for t in (1, 2):
        long[t][0] = (100 * (t - 1) + 29, 1000 * t)
    table = timetable.lay_out(spark.createDataFrame(trips(*long), BUS), spark.createDataFrame([(229, 500, 30, 0.0, "walk")], WALK))
    job = reach.Search(table, spark.createDataFrame([(0, 0, 0, 9000)], ASKED))
    rows = found(job.run())
    assert len(job.rounds) == 4 and job.rounds[0] == 1 and sum(job.rounds) == len(rows) == 1 + 29 * 3 + 1
    assert rows[0, 500] == rows[0, 229] + 30 == 2320


def test_broken_chains_are_not_ridden_through(spark):
    bus = trips([(1, 0), (2, 10), (3, 20), (4, 30), (5, 40)])
    del bus[1]  # as a hop of no time
    bus += [((0, 9, 0), 1, 6, 0, 50, 50, 9, "R9", "bus"), ((0, 9, 1), 6, 7, 40, 60, 20, 9, "R9", "bus")]  # leaves before it comes
    table = timetable.lay_out(spark.createDataFrame(bus, BUS), spark.createDataFrame([], WALK))
    assert found(reach.search(table, spark.createDataFrame([(0, 1, 0, 900)], ASKED))) == {(0, 1): 0, (0, 2): 10, (0, 6): 50}


@pytest.mark.parametrize("limit", [reach.BROADCAST_BYTES, 0])
def test_rides_stay_where_they_are(spark, network, queries, monkeypatch, limit):
    """No exchange of rides in a round, with scenarios too, and folders of other hours aren't read."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        net = network[2]
        gone = spark.createDataFrame([(1, 7)], "scenario int, trip_id bigint")
        job = reach.Search(net.kept.during(0, 700), queries.withColumn("scenario", F.lit(1)), Overlay(gone))
        frontier = job.starts()
        text = plan(job.better(job.walked(job.ridden(frontier, limit > 0).unionAll(frontier)), frontier))
        scans = [line for line in text.split("\n") if "FileScan" in line and "isospan_" in line]
        assert len(scans) == 3 and all("Bucketed: true" in line for line in scans)
        pruned = [line for line in scans if "PartitionFilters: [isnotnull(slot" in line and "(slot" in line]
        assert len(pruned) == (2 if limit else 1)  # the rides of these hours are written anew by their stops
        monkeypatch.setattr(reach, "BROADCAST_BYTES", limit)
        assert found(reach.search(net.kept, queries)) == wanted(*network[:2])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hours_are_pruned(spark, tmp_path):
    bus = trips(*[[(k, 3600 * h), (k + 1, 3600 * h + 60)] for h in range(20) for k in range(3)])
    edges, walks = spark.createDataFrame(bus, BUS), spark.createDataFrame([(1, 2, 5, 0.0, "walk")], WALK)
    timetable.lay_out(edges, walks, folder=f"{tmp_path}/net")
    table = timetable.open_timetable(spark, f"{tmp_path}/net")
    assert len(table.rides.inputFiles()) >= 20 and table.rides.count() == 60
    part = table.during(7 * 3600, 8 * 3600 - 1)
    assert {f.split("slot=")[1].split("/")[0] for f in part.trips.select("trip_id").inputFiles()} >= {"7"}
    assert "slot" in plan(part.rides) and part.rides.count() == 3
    asked = spark.createDataFrame([(0, 0, 7 * 3600, 600)], ASKED)
    assert found(reach.search(table, asked)) == found(reach.earliest_arrivals(edges, walks, asked)) == {(0, 0): 25200, (0, 1): 25260, (0, 2): 25265}


def test_scenarios_over_one_network(spark, network, queries):
    bus, walk, net = network
    line = trips([(0, 5), (11, 60), (3, 90)])
    line = [((1, -1, e[0][2]), *e[1:6], -1, None, "bus") for e in line]
    new_walk, no_walk = [(2, 9, 20, 0.0, "demand")], {(w[0], w[1]) for w in walk[:6]}
    edges = lambda rows, kind: spark.createDataFrame(rows, kind)
    changed = {
        1: scenario.remove_routes(net, ["R1", "R4"]),
        2: Network(net.bus, net.walk, net.stops, net.kept, new_bus=edges(line, BUS), gone=edges([(5,)], "trip_id bigint")),
        3: Network(net.bus, net.walk, net.stops, net.kept, new_walk=edges(new_walk, WALK), gone_walk=edges(list(no_walk), "from_stop bigint, to_stop bigint")),
    }
    over = scenario.overlay(changed)
    asked = queries.crossJoin(spark.createDataFrame([(k,) for k in range(4)], "scenario int"))
    got = found(reach.search(net.kept, asked, over), "scenario")
    left = [w for w in walk if (w[0], w[1]) not in no_walk]
    want = {0: (bus, walk), 1: ([e for e in bus if e[7] not in ("R1", "R4")], walk), 2: ([e for e in bus if e[6] != 5] + line, walk), 3: (bus, left + new_walk)}
    for k, (b, w) in want.items():
        assert {(q, s): t for (x, q, s), t in got.items() if x == k} == wanted(b, w), k
    for k, n in changed.items():
        assert found(scenario.arrivals(n, queries)) == wanted(*want[k]), k


def test_changes_add_up(spark, network, queries):
    bus, walk, net = network
    stops = [0, 4, 8]
    twice = scenario.remove_routes(scenario.replace_routes(net, "R2", stops, 60), "R3")
    rows = [tuple(r) for r in twice.bus.collect()]
    assert found(scenario.arrivals(twice, queries)) == wanted([(tuple(r[0]), *r[1:]) for r in rows], walk)
    halved = scenario.halve_route(scenario.keep_every(net, "R1", 3), "R2")
    assert found(scenario.arrivals(halved, queries)) == wanted([(tuple(r[0]), *r[1:]) for r in map(tuple, halved.bus.collect())], walk)


@pytest.mark.parametrize("seed", [1])
def test_repair_is_a_full_run(spark, network, queries, seed):
    bus, walk, net = network
    rng = random.Random(seed)
    lost = {k: set(rng.sample(range(60), rng.choice([1, 5, 30]))) for k in range(6)}
    gone = spark.createDataFrame([(f"s{k}", t) for k, ts in lost.items() for t in ts], "scenario string, trip_id bigint")
    before = reach.search(net.kept, queries)
    preds = reach.predecessors(net.bus, net.walk, before, queries)
    used = reach.trips_used(preds, queries)
    rows = repair.repair(net.kept, queries, before, used, gone).collect()
    was, touched = wanted(bus, walk), {k: {(r.qid, r.stop_id) for r in rows if r.scenario == f"s{k}"} for k in lost}
    assert all(r.before_sec == was[r.qid, r.stop_id] for r in rows)
    for k, ts in lost.items():
        after = wanted([e for e in bus if e[6] not in ts], walk)
        got = {key: t for key, t in was.items() if key not in touched[k]} | {(r.qid, r.stop_id): r.after_sec for r in rows if r.scenario == f"s{k}" and r.after_sec is not None}
        assert got == after
    on_path = {}
    for r in used.collect():
        on_path.setdefault((r.qid, r.stop_id), set()).add(r.trip_id)
    assert all(touched[k] == {key for key, own in on_path.items() if own & ts} for k, ts in lost.items())
    assert 0 < len(rows) < len(was) * len(lost)
    counts = repair.sweep_counts(before, spark.createDataFrame(rows, "scenario string, qid bigint, stop_id bigint, before_sec bigint, after_sec bigint"), gone.unionAll(spark.createDataFrame([("none", 0)], gone.schema)))
    n = {(r.scenario, r.qid): (r.reached, r.lost, r.degraded) for r in counts.collect()}
    assert len(n) == 7 * len(QUERIES) and n["none", 3] == (sum(q == 3 for q, _ in was), 0, 0)
    assert repair.repair(net.kept, queries.limit(0), before.limit(0), used.limit(0), gone).count() == 0


def test_zones_have_a_hub(spark, network, queries):
    """Two edges for each stop instead of one for each pair, the same arrivals, and predecessors without the hub."""
    bus, walk, net = network
    zoned = scenario.demand_zone(scenario.demand_zone(net, 3, 1200, 40), 9, 700, 25)
    clique = scenario.demand_edges(net.stops, 3, 1200, 40).unionAll(scenario.demand_edges(net.stops, 9, 700, 25))
    n = [r.n for r in zoned.new_walk.groupBy("walk_time").agg(F.count("*").alias("n")).orderBy("walk_time").collect()]
    rows = [tuple(r) for r in clique.collect()]
    assert n[0] == n[1] + n[2] and len(rows) == n[1] * (n[1] - 1) + n[2] * (n[2] - 1) > 2 * n[0]
    assert zoned.hubs.distinct().count() == 2 and zoned.hubs.join(net.stops, "stop_id").count() == 0
    want = wanted(bus, walk + rows)
    assert found(scenario.arrivals(zoned, queries)) == want
    reached = scenario.arrivals(zoned, queries, hubs=True)
    preds = reach.predecessors(net.bus, net.walk.unionByName(zoned.new_walk), reached, queries)
    got = scenario.without_hubs(preds, zoned.hubs).collect()
    edges = {(w[0], w[1], w[2]) for w in walk + rows}
    assert {(r.qid, r.stop_id) for r in got} == want.keys() - {(q, s) for q, s, _, _ in QUERIES}
    for r in got:
        since, at = want[r.qid, r.pred_stop], want[r.qid, r.stop_id]
        assert r.arrival_sec == at and since <= r.departure_sec
        assert r.trip_id is not None or since == r.departure_sec and (r.pred_stop, r.stop_id, at - since) in edges
    text = scenario.hub_edges(net.stops.withColumn("stop_id", F.concat(F.lit("S"), "stop_id")), "S3", 1200)[1]
    assert text.first().stop_id == "S9 zone"


def test_walks_lie_by_zone(spark, network, queries, tmp_path):
    """Also when kept in a folder, with stops of no position and extra walks; no walk is exchanged."""
    bus, walk, net = network
    some = net.stops.where("stop_id <> 3").unionAll(spark.createDataFrame([(4, None, None)], STOPS))
    edges, walks = spark.createDataFrame(bus, BUS), spark.createDataFrame(walk, WALK)
    timetable.lay_out(edges, walks, folder=f"{tmp_path}/net", stops=some)
    table = timetable.open_timetable(spark, f"{tmp_path}/net")
    assert table.zones.select("zone").distinct().count() > 1 and "zone" in table.walks.columns
    assert found(reach.search(table, queries)) == wanted(bus, walk)
    job = reach.Search(table, queries)
    frontier = job.starts()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(job.walked(frontier))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in text and "Bucketed: true" in text
    assert found(reach.earliest_arrivals(edges, walks, queries, some)) == wanted(bus, walk)


def test_crowded_zones_are_parted(spark, network, queries, monkeypatch):
    """Evenly, by their squares; stops in one place stay together, others keep their zone, and arrivals are the same."""
    bus, walk, net = network
    crowd = [(100 + k, 42.0001 + k % 20 / 2500, 141.0001 + k // 20 / 2000) for k in range(400)] + [(600 + k, 42.5, 141.0) for k in range(30)]
    stops = net.stops.unionAll(spark.createDataFrame(crowd, STOPS))
    whole = {r.stop_id: r.zone for r in timetable.zones_of(stops)[0].collect()}
    monkeypatch.setattr(timetable, "CROWDED", 600, raising=False)
    zones, buckets = timetable.zones_of(stops)
    parts = {r.stop_id: r.zone for r in zones.collect()}
    size = lambda zone: sum(z == zone for z in parts.values())
    assert len(parts) == 442 and buckets == 8
    assert max(size(parts[k]) for k in range(100, 500)) < 60 < max(list(whole.values()).count(whole[k]) for k in range(100, 500))
    assert len({parts[k] for k in range(600, 630)}) == 1
    assert all(whole[a] == whole[b] for a in parts for b in parts if parts[a] == parts[b])
    assert found(reach.earliest_arrivals(spark.createDataFrame(bus, BUS), spark.createDataFrame(walk, WALK), queries, stops)) == wanted(bus, walk)
