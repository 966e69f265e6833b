"""Arrivals and paths against a heap search, on random networks with many ties."""

import heapq
import random

import pytest

from isospan.operators import reach

BUS = "ord struct<part:int,trip:bigint,seq:bigint>, from_stop bigint, to_stop bigint, departure_sec bigint, arrival_sec bigint, travel_time bigint, trip_id bigint, route_id string, edge_type string"
WALK = "from_stop bigint, to_stop bigint, walk_time bigint, distance double, edge_type string"
ASKED = "qid bigint, start_stop bigint, t0 bigint, budget bigint"


def random_network(seed, stops=12, trips=40):
    rng = random.Random(seed)
    bus, walk = [], []
    for trip in range(trips):
        t = rng.randrange(0, 60) * 10
        stop = rng.randrange(stops)
        for seq in range(rng.randrange(1, 6)):
            to, arrive = rng.randrange(stops), t + rng.randrange(1, 5) * 10
            bus.append(((0, trip, seq), stop, to, t, arrive, arrive - t, trip, f"R{trip % 5}", "bus"))
            stop, t = to, arrive + rng.randrange(0, 2) * 10
    for _ in range(8):
        a, b, s = rng.randrange(stops), rng.randrange(stops), rng.randrange(1, 6) * 10
        walk += [(a, b, s, 0.0, "walk"), (b, a, s, 0.0, "walk")]
    return bus, walk


def search(bus, walk, start, t0, budget):
    rides, walks = {}, {}
    for e in sorted(bus, key=lambda e: (e[3], e[0])):
        rides.setdefault(e[1], []).append(e)
    for w in walk:
        walks.setdefault(w[0], []).append(w)
    best, prev, heap = {start: t0}, {}, [(t0, start)]
    while heap:
        t, u = heapq.heappop(heap)
        if t > best[u]:
            continue
        steps = [(e[4], e[2], e[6]) for e in rides.get(u, []) if e[3] >= t] + [(t + w[2], w[1], None) for w in walks.get(u, [])]
        for arrive, v, trip in steps:
            if arrive <= t0 + budget and arrive < best.get(v, 1 << 60):
                best[v], prev[v] = arrive, (u, trip)
                heapq.heappush(heap, (arrive, v))
    return best, prev


@pytest.mark.parametrize("seed", [1, 2])
def test_against_search(spark, seed):
    bus, walk = random_network(seed)
    asked = [(k, k % 12, 100 * (k % 4), (0, 150, 400)[k % 3]) for k in range(24)] + [(99, 777, 0, 300)]
    edges, walks, queries = spark.createDataFrame(bus, BUS), spark.createDataFrame(walk, WALK), spark.createDataFrame(asked, ASKED)
    arrivals = reach.earliest_arrivals(edges, walks, queries)
    got = {(r.qid, r.stop_id): r.arrival_sec for r in arrivals.collect()}
    want, before = {}, {}
    for q, start, t0, budget in asked:
        best, prev = search(bus, walk, start, t0, budget)
        want |= {(q, s): t for s, t in best.items()}
        before |= {(q, s): p for s, p in prev.items()}
    assert got == want
    preds = reach.predecessors(edges, walks, arrivals, queries)
    assert {(r.qid, r.stop_id): (r.pred_stop, r.trip_id) for r in preds.collect()} == before
    names = spark.createDataFrame([(t, f"name {t}") for t in range(39)], "trip_id bigint, route_name string")
    rows = reach.paths(preds, queries, names).collect()
    assert {(r.qid, r.stop_id) for r in rows} == set(want)
    starts = {q: s for q, s, _, _ in asked}
    for r in rows:
        at, t = starts[r.qid], want[r.qid, starts[r.qid]]
        for s in r.steps:
            assert s.from_stop == at and t <= s.departure_sec < s.arrival_sec
            at, t = s.to_stop, s.arrival_sec
        assert (at, t) == (r.stop_id, want[r.qid, r.stop_id])


def test_budget_and_hours(spark):
    bus, walk = random_network(5)
    edges, walks = spark.createDataFrame(bus, BUS), spark.createDataFrame(walk, WALK)
    queries = spark.createDataFrame([(b, 3, 0, b) for b in (0, 100, 200, 400)], ASKED)
    rows = reach.earliest_arrivals(edges, walks, queries).collect()
    reached = {b: {r.stop_id for r in rows if r.qid == b} for b in (0, 100, 200, 400)}
    assert reached[0] == {3} and reached[100] <= reached[200] <= reached[400]
    assert all(0 <= r.arrival_sec <= r.qid for r in rows)
    hours = reach.hourly_queries(queries.where("qid = 0"))
    assert [(r.qid, r.t0) for r in hours.orderBy("qid").collect()] == [(h, h * 3600) for h in range(5, 23)]
    assert reach.earliest_arrivals(edges, walks, queries.limit(0)).count() == 0
