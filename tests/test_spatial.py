import math
import random

from isospan.operators import impact, spatial


def metres(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def points(n, seed, lat=42.3, spread=0.02):
    rng = random.Random(seed)
    return [(k, lat + rng.uniform(-spread, spread), 140.9 + rng.uniform(-spread, spread)) for k in range(n)]


def test_pairs_and_nearest(spark):
    for lat in (42.3, -33.0, 0.0, 70.0):
        a, b = points(150, 1, lat), points(150, 2, lat)
        left, right = spark.createDataFrame(a, "i int, lat double, lon double"), spark.createDataFrame(b, "j int, lat double, lon double")
        near = {(p[0], q[0]): metres(p[1:], q[1:]) for p in a for q in b if metres(p[1:], q[1:]) <= 300}
        got = [(r.i, r.j) for r in spatial.pairs_within(left, right, 300).collect()]
        assert len(got) == len(set(got)) and set(got) == set(near)
        best = {r.i: r.j for r in spatial.nearest(left, right, 300, "i", "j").collect()}
        assert best == {i: min((d, y) for (x, y), d in near.items() if x == i)[1] for i, _ in near}
        covered = {r.j for r in spatial.near_any(right, left.select("lat", "lon"), 300, "j").collect()}
        assert covered == {j for _, j in near}


def test_population(spark):
    place = lambda k: 42.3 + 0.001 * k
    meshes = spark.createDataFrame([(k, 10.0 + k, 1.0, place(k), 140.9) for k in range(8)], "mesh_ord int, pop_t double, pop_65over double, lat double, lon double")
    stops = spark.createDataFrame([(k, place(k), 140.9) for k in range(8)], "stop_id int, stop_lat double, stop_lon double")
    ids = lambda *s: spark.createDataFrame([(0, x) for x in s], "qid int, stop_id int")
    near = impact.catchments(meshes, stops, 120)
    assert {(r.stop_id, r.mesh_ord) for r in near.collect()} == {(s, m) for s in range(8) for m in range(8) if abs(s - m) < 2}
    r = impact.population_near(meshes, near, ids(0, 1, 99)).first()
    assert (r.total, r.elderly, r.mesh_count) == (10 + 11 + 12, 3, 3)
    r = impact.affected_population(meshes, near, ids(2), ids(1, 2, 7)).first()
    assert (r.affected_total, r.affected_elderly, r.uncovered_meshes, r.lost_meshes, r.covered_by_others) == (13, 1, 1, 3, 2)
    r = impact.affected_population(meshes, near, ids(2).limit(0), ids(1, 2, 7)).first()
    assert (r.affected_total, r.lost_meshes) == (0, 0)
    assert impact.population_around(meshes, place(0), 140.9, 120).first().mesh_count == 2


def test_facilities(spark):
    facilities = spark.createDataFrame([(0, "a", "t", 42.3, 140.9), (1, "b", "t", 42.35, 140.9)], "fac_ord int, name string, type string, latitude double, longitude double")
    stops = spark.createDataFrame([(5, 1, "S", 42.301, 140.9), (6, 0, "S", 42.299, 140.9)], "stop_id int, stop_ord int, stop_name string, stop_lat double, stop_lon double")
    placed = impact.facility_stops(facilities, stops)
    row = placed.collect()
    assert [(r.fac_ord, r.nearest_stop, r.distance_m) for r in row] == [(0, 5 if metres((42.3, 0), (42.301, 0)) < metres((42.3, 0), (42.299, 0)) else 6, 111)]
    queries = spark.createDataFrame([(0, 0), (1, 0)], "qid int, t0 int")
    arrivals = spark.createDataFrame([(0, row[0].nearest_stop, 120)], "qid int, stop_id int, arrival_sec int")
    got = {r.qid: (r.accessible, r.total_min) for r in impact.facility_access(arrivals, queries, placed, stops).collect()}
    assert got == {0: (True, 3.7), 1: (False, None)}
    found = [tuple(r)[:4] for r in impact.accessible_facilities(impact.reached_facilities(arrivals, queries, placed, stops)).collect()]
    assert found == [(0, 0, "a", "t")]
    delta = impact.change_by_type(arrivals, arrivals.limit(0), queries, placed)
    assert sorted(map(tuple, delta.collect())) == [(0, "t", 1, 1, 0, -1), (1, "t", 1, 0, 0, 0)]


def test_nearest_of_all(spark):
    """Near, far and very far centres, with ties and rows without a position."""
    a = points(60, 3) + [(100, 43.5, 141.2), (101, -30.0, 20.0), (102, 42.3, -60.0)]
    b = [*points(40, 4), (900, 43.0, 141.0), (901, 44.0, 141.4), (50, 10.0, 100.0), (51, 10.0, 100.0)]
    left = spark.createDataFrame([*a, (103, None, 1.0)], "i int, lat double, lon double")
    right = spark.createDataFrame([*b, (902, None, None)], "j int, lat double, lon double")
    got = {r.i: (r.j, r.dist) for r in spatial.nearest_of_all(left, right, "i", "j", 50.0).collect()}
    want = {p[0]: min((metres(p[1:], q[1:]), q[0]) for q in b) for p in a}
    assert {i: j for i, (j, _) in got.items()} == {i: j for i, (_, j) in want.items()}
    assert all(abs(got[i][1] - want[i][0]) < 1e-3 for i in want)
    assert spatial.nearest_of_all(left, right.limit(0), "i", "j").count() == 0 == spatial.nearest_of_all(left.limit(0), right, "i", "j").count()


def test_nearest_meets_few_centres_where_they_are_dense(spark, monkeypatch):
    """Pairs that are made grow with the points, not with points times centres near them; ties and copies too."""
    a, b = points(600, 5, spread=0.004), points(3000, 6, spread=0.004)
    b += [(k + 10_000, *p) for k, p in enumerate(x[1:] for x in b[:500])]
    left, right = spark.createDataFrame(a, "i int, lat double, lon double"), spark.createDataFrame(b, "j int, lat double, lon double")
    made, plain = [], spatial.pairs_within
    monkeypatch.setattr(spatial, "pairs_within", lambda *args: made.append(plain(*args)) or made[-1])
    got = {r.i: r.j for r in spatial.nearest(left, right, 500, "i", "j").collect()}
    assert got == {p[0]: min((metres(p[1:], q[1:]), q[0]) for q in b)[1] for p in a}
    assert sum(df.count() for df in made) < 30 * len(a)
    assert len(got) == spatial.nearest_of_all(left, right, "i", "j").count()


def test_meshes_of_one_place_are_one_site(spark):
    """Catchments grow with places and not with the rows there; the numbers are those of all rows."""
    meshes = spark.createDataFrame([(k, 1.5 + k, 0.25, 42.3 + 0.001 * (k % 4), 140.9) for k in range(200)], "mesh_ord int, pop_t double, pop_65over double, lat double, lon double")
    stops = spark.createDataFrame([(k, 42.3 + 0.001 * k, 140.9) for k in range(4)], "stop_id int, stop_lat double, stop_lon double")
    ids = lambda *s: spark.createDataFrame([(0, x) for x in s], "qid int, stop_id int")
    places = impact.sites(meshes)
    near, rows = impact.catchments(places, stops, 120), impact.catchments(meshes, stops, 120)
    assert (near.count(), rows.count()) == (10, 500)
    assert impact.population_near(places, near, ids(0)).first() == impact.population_near(meshes, rows, ids(0)).first()
    lost = [impact.affected_population(m, n, ids(2), ids(0, 2)).first() for m, n in ((places, near), (meshes, rows))]
    assert lost[0] == lost[1] and (lost[0].lost_meshes, lost[0].uncovered_meshes) == (150, 100)
