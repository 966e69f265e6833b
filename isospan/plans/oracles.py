"""DuckDB SQL for the catalogue: the same rows from the same tables, by plain joins and keyed recursion."""

from __future__ import annotations

import re

from ..functions import BBOX, EARTH_RADIUS_M, HIGHWAY_WORDS, MARKERS, MODE_BUS, MODE_WALK, OTHER_MARKER, UNKNOWN_ROUTE
from ..sources.star import TABLES
from .catalog import BUDGET, HOURS, KEEP_EVERY, LINE, LINE_KMH, LINE_MIN, MINUTES, NAME, ORIGIN, ORIGINS, POINT, RATIO, ROUTE, ROUTES, SLOW_M_PER_MIN, STOPS, T0, THIN_ROUTE, TYPES, WALK_M, ZONE_M, ZONE_SEC

_R = f"CAST({EARTH_RADIUS_M} AS DOUBLE)"


def _hav(a: str, b: str, c: str, d: str) -> str:
    s = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * {_R} * atan2(sqrt({s}), sqrt(1 - {s})))"


def _num(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def _set(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


_WALK_COLUMNS = f"greatest(1, CAST(trunc(d / {_num(67.0)} * 60) AS BIGINT)) AS walk_time, round(d, 1) AS distance, 'walk' AS edge_type"


def _pairs(stops: str, metres: float) -> str:
    return (
        f"SELECT from_stop, to_stop, {_WALK_COLUMNS} FROM (SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, "
        f"{_hav('a.stop_lat', 'a.stop_lon', 'b.stop_lat', 'b.stop_lon')} AS d FROM {stops} a JOIN {stops} b ON a.stop_id <> b.stop_id) WHERE d <= {_num(metres)}"
    )


#: Numbers of the routes that are taken away in pairs, in order.
_PAIRED = [int(r[1:]) for r in ROUTES]
_RIDES = "trip_id, route_id, seq, from_stop, to_stop, departure_sec, arrival_sec, arrival_sec - departure_sec AS travel_time, part"
_KEEP = "SELECT trip_id, route_id, seq, from_stop, to_stop, departure_sec, arrival_sec, travel_time, part FROM bus"

CTES = {name: re.sub(r"[{}]", "", text) for name, text in TABLES.items()} | {
    "bus": f"SELECT {_RIDES} FROM (SELECT t.trip_id, t.route_id, s.stop_sequence AS seq, s.stop_id AS from_stop, lead(s.stop_id) OVER w AS to_stop, "
    "s.departure_sec, lead(s.arrival_sec) OVER w AS arrival_sec, 0 AS part FROM stop_times s JOIN trips t ON s.trip_id = t.trip_id "
    "JOIN calendar c ON c.service_id = t.service_id AND c.monday = 1 WINDOW w AS (PARTITION BY t.trip_id ORDER BY s.stop_sequence)) WHERE arrival_sec > departure_sec",
    "walk": _pairs("stops", 300.0),
    "names": f"SELECT t.trip_id, coalesce(r.route_long_name, '{UNKNOWN_ROUTE}') AS route_name FROM trips t LEFT JOIN routes r ON t.route_id = r.route_id",
    "inside": f"SELECT * FROM stops WHERE stop_lat BETWEEN {BBOX[0]} AND {BBOX[1]} AND stop_lon BETWEEN {BBOX[2]} AND {BBOX[3]}",
    "area": f"SELECT e.route_id, coalesce(r.route_long_name, '{UNKNOWN_ROUTE}') AS route_name, min((e.trip_id, e.seq)) AS appears FROM bus e "
    "LEFT JOIN routes r ON e.route_id = r.route_id WHERE from_stop IN (SELECT stop_id FROM inside) OR to_stop IN (SELECT stop_id FROM inside) GROUP BY 1, 2 "
    "HAVING NOT (" + " OR ".join(f"contains(route_name, '{w}')" for w in HIGHWAY_WORDS) + ")",
    "asked": f"SELECT CAST(0 AS BIGINT) AS qid, CAST({ORIGIN} AS BIGINT) AS start_stop, CAST({T0} AS BIGINT) AS t0, CAST({BUDGET} AS BIGINT) AS budget",
    "hours": f"SELECT CAST(h AS BIGINT) AS qid, CAST({ORIGIN} AS BIGINT) AS start_stop, CAST(h * 3600 AS BIGINT) AS t0, CAST({BUDGET} AS BIGINT) AS budget FROM range(5, 23) x(h)",
    "asked_many": "SELECT CAST(s * 10000 + h * 100 + m AS BIGINT) AS qid, CAST(s AS BIGINT) AS start_stop, CAST(h * 3600 AS BIGINT) AS t0, CAST(m * 60 AS BIGINT) AS budget FROM "
    + ", ".join(f"(SELECT unnest({list(v)}) AS {k}) {k}" for k, v in (("s", ORIGINS), ("h", HOURS), ("m", MINUTES))),
    "asked_single": f"SELECT DISTINCT CAST(substr(route_id, 2) AS BIGINT) AS qid, CAST({ORIGIN} AS BIGINT) AS start_stop, CAST({T0} AS BIGINT) AS t0, CAST({BUDGET} AS BIGINT) AS budget FROM bus WHERE route_id IS NOT NULL",
    "asked_pairs": f"SELECT CAST(a * 100 + b AS BIGINT) AS qid, CAST({ORIGIN} AS BIGINT) AS start_stop, CAST({T0} AS BIGINT) AS t0, CAST({BUDGET} AS BIGINT) AS budget FROM "
    f"(SELECT unnest({_PAIRED}) AS a) x, (SELECT unnest({_PAIRED}) AS b) y WHERE a < b",
    "bus_one": f"{_KEEP} WHERE route_id IS DISTINCT FROM '{ROUTE}'",
    "bus_many": f"{_KEEP} WHERE route_id IS NULL OR route_id NOT IN {_set(ROUTES)}",
    "hops": "SELECT *, row_number() OVER w AS k, lag(to_stop) OVER w AS before FROM bus WINDOW w AS (PARTITION BY trip_id ORDER BY departure_sec, seq)",
    "calls": "SELECT trip_id, route_id, k, 0 AS side, from_stop AS stop_id, departure_sec AS clock FROM hops WHERE before IS NULL OR before <> from_stop "
    "UNION ALL SELECT trip_id, route_id, k, 1, to_stop, arrival_sec FROM hops",
    "bus_stops": f"SELECT {_RIDES} FROM (SELECT trip_id, route_id, k * 2 + side AS seq, stop_id AS from_stop, lead(stop_id) OVER w AS to_stop, clock AS departure_sec, "
    f"lead(clock) OVER w AS arrival_sec, 0 AS part FROM calls WHERE stop_id NOT IN {_set(STOPS)} WINDOW w AS (PARTITION BY trip_id ORDER BY k, side)) "
    "WHERE arrival_sec > departure_sec AND from_stop <> to_stop",
    "neighbours": f"SELECT * FROM stops WHERE stop_id NOT IN {_set(STOPS)} AND stop_id IN (SELECT to_stop FROM walk WHERE from_stop IN {_set(STOPS)})",
    "walk_stops": f"SELECT * FROM walk WHERE from_stop NOT IN {_set(STOPS)} AND to_stop NOT IN {_set(STOPS)} UNION ALL {_pairs('neighbours', 2 * WALK_M)}",
    "firsts": "SELECT trip_id, route_id, min(departure_sec) AS f FROM bus WHERE route_id IS NOT NULL GROUP BY 1, 2",
    "bus_half": f"{_KEEP} WHERE trip_id NOT IN (SELECT trip_id FROM (SELECT trip_id, row_number() OVER (ORDER BY trip_id) AS n FROM firsts WHERE route_id = '{THIN_ROUTE}') WHERE n % 2 = 0)",
    "bus_every": f"{_KEEP} WHERE trip_id NOT IN (SELECT trip_id FROM (SELECT trip_id, row_number() OVER (ORDER BY f, trip_id) AS n FROM firsts WHERE route_id = '{THIN_ROUTE}') "
    f"WHERE (n - 1) % {KEEP_EVERY} <> 0)",
    "places": f"SELECT *, greatest(1, CAST(trunc(n * {_num(RATIO)}) AS BIGINT)) AS less FROM (SELECT trip_id, count(*) OVER (PARTITION BY route_id) AS n, "
    "row_number() OVER (PARTITION BY route_id ORDER BY f, trip_id) - 1 AS k FROM firsts)",
    "bus_thin": f"{_KEEP} WHERE trip_id NOT IN (SELECT trip_id FROM places WHERE n > 1 AND "
    "list_contains(list_transform(range(0, less), lambda i: CAST(trunc(i * (CAST(n AS DOUBLE) / less)) AS BIGINT)), k))",
    "zone": f"SELECT s.stop_id FROM stops s, stops c WHERE c.stop_id = {ORIGIN} AND {_hav('c.stop_lat', 'c.stop_lon', 's.stop_lat', 's.stop_lon')} <= {_num(ZONE_M)}",
    "demand": f"SELECT a.stop_id AS from_stop, b.stop_id AS to_stop, CAST({ZONE_SEC} AS BIGINT) AS walk_time, CAST(0 AS DOUBLE) AS distance, 'demand' AS edge_type FROM zone a JOIN zone b ON a.stop_id <> b.stop_id",
    "walk_demand": "SELECT * FROM walk UNION ALL SELECT * FROM demand",
    "line": "SELECT * FROM (VALUES " + ", ".join(f"({k}, {v})" for k, v in enumerate(LINE)) + ") t(k, stop_id)",
    "rides": "SELECT *, coalesce(sum(ride + 30) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ("
    f"SELECT l.k, l.stop_id AS a, lead(l.stop_id) OVER w AS b, CAST(trunc({_hav('stop_lat', 'stop_lon', 'lead(stop_lat) OVER w', 'lead(stop_lon) OVER w')} / {_num(LINE_KMH * 1000 / 3600)}) AS BIGINT) AS ride "
    "FROM line l LEFT JOIN stops s ON l.stop_id = s.stop_id WINDOW w AS (ORDER BY l.k)) WHERE ride IS NOT NULL",
    "added": "SELECT CAST(-(run * 2 + back + 1) AS BIGINT) AS trip_id, CAST(NULL AS VARCHAR) AS route_id, k * 2 + back AS seq, CASE WHEN back = 0 THEN a ELSE b END AS from_stop, "
    "CASE WHEN back = 0 THEN b ELSE a END AS to_stop, CAST(run + before AS BIGINT) AS departure_sec, CAST(run + before + ride AS BIGINT) AS arrival_sec, ride AS travel_time, 1 AS part "
    f"FROM rides, range(18000, 79200, {LINE_MIN * 60}) x(run), range(0, 2) y(back)",
    "bus_line": "SELECT * FROM bus_many UNION ALL SELECT * FROM added",
    "meshes": "SELECT *, CAST(left(m, 2) AS DOUBLE) / 1.5::DOUBLE + CAST(m[5] AS DOUBLE) / 12 + CAST(m[7] AS DOUBLE) / 120 + CAST(m[9] AS DOUBLE) / 1200 + 1::DOUBLE / 2400 AS lat, "
    "CAST(m[3:4] AS DOUBLE) + 100 + CAST(m[6] AS DOUBLE) / 8 + CAST(m[8] AS DOUBLE) / 80 + CAST(m[10] AS DOUBLE) / 800 + 1::DOUBLE / 1600 AS lon "
    "FROM (SELECT *, CAST(meshcode AS VARCHAR) AS m FROM population)",
    "placed": "SELECT fac_ord, name, type, stop_id AS nearest_stop, CAST(round_even(d, 0) AS BIGINT) AS distance_m, CAST(round_even(d / 67::DOUBLE * 60, 0) AS BIGINT) AS walk_sec FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY fac_ord ORDER BY d, stop_ord) AS n FROM (SELECT f.*, s.stop_id, s.stop_ord, {_hav('latitude', 'longitude', 'stop_lat', 'stop_lon')} AS d "
    "FROM facilities f, stops s)) WHERE n = 1 AND d <= 500",
}


def _reach(name: str, bus: str, walk: str, asked: str = "asked", unless: str = "false") -> tuple[str, str]:
    """The earliest arrivals as a recursion with one row for each query and stop. unless: rides that a query leaves out."""
    return (
        f"{name}(qid, stop_id, arrival_sec, deadline) USING KEY (qid, stop_id)",
        f"SELECT qid, start_stop, t0, t0 + budget FROM {asked} UNION SELECT n.qid, n.s, min(n.a), min(n.deadline) FROM ("
        f"SELECT r.qid, e.to_stop AS s, e.arrival_sec AS a, r.deadline FROM {name} r JOIN {bus} e ON e.from_stop = r.stop_id AND e.departure_sec >= r.arrival_sec AND e.arrival_sec <= r.deadline AND NOT ({unless}) "
        f"UNION ALL SELECT r.qid, w.to_stop, r.arrival_sec + w.walk_time, r.deadline FROM {name} r JOIN {walk} w ON w.from_stop = r.stop_id AND r.arrival_sec + w.walk_time <= r.deadline) n "
        f"LEFT JOIN recurring.{name} cur ON cur.qid = n.qid AND cur.stop_id = n.s WHERE cur.arrival_sec IS NULL OR n.a < cur.arrival_sec GROUP BY n.qid, n.s",
    )


def _tight(arrived: str, bus: str) -> str:
    return (
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, stop_id ORDER BY u, pred_stop, way, departure_sec, part, trip_id, seq) AS n FROM ("
        f"SELECT v.qid, v.stop_id, e.from_stop AS pred_stop, a.arrival_sec AS u, 0 AS way, '{MODE_BUS}' AS mode, e.trip_id, e.part, e.seq, 'bus' AS edge_type, e.departure_sec, v.arrival_sec "
        f"FROM {arrived} v JOIN {bus} e ON e.to_stop = v.stop_id AND e.arrival_sec = v.arrival_sec JOIN {arrived} a ON a.qid = v.qid AND a.stop_id = e.from_stop AND e.departure_sec >= a.arrival_sec "
        f"UNION ALL SELECT v.qid, v.stop_id, w.from_stop, a.arrival_sec, 1, '{MODE_WALK}', NULL, NULL, NULL, w.edge_type, a.arrival_sec, v.arrival_sec "
        f"FROM {arrived} v JOIN walk w ON w.to_stop = v.stop_id JOIN {arrived} a ON a.qid = v.qid AND a.stop_id = w.from_stop AND a.arrival_sec + w.walk_time = v.arrival_sec) "
        f"WHERE (qid, stop_id) NOT IN (SELECT (qid, start_stop) FROM asked)) WHERE n = 1"
    )


def _chase(tight: str, arrived: str, name: str) -> dict[str, str]:
    return {
        f"{name}_c(qid, target, here, depth)": f"SELECT qid, stop_id, stop_id, 0 FROM {arrived} UNION ALL SELECT c.qid, c.target, p.pred_stop, c.depth + 1 FROM {name}_c c JOIN {tight} p ON p.qid = c.qid AND p.stop_id = c.here",
        f"{name}_s": f"SELECT c.qid, c.target, c.depth, p.*, coalesce(m.route_name, '') AS route_name FROM {name}_c c JOIN {tight} p ON p.qid = c.qid AND p.stop_id = c.here LEFT JOIN names m ON m.trip_id = p.trip_id",
    }


_SPLIT = {
    "old": _reach("old", "bus", "walk"),
    "one": _reach("one", "bus_one", "walk"),
    "new": _reach("new", "bus_many", "walk"),
    "profile": _reach("profile", "bus", "walk", "hours"),
    "many": _reach("many", "bus", "walk", "asked_many"),
    "single": _reach("single", "bus", "walk", "asked_single", "coalesce(e.route_id = 'R' || r.qid, false)"),
    "paired": _reach("paired", "bus", "walk", "asked_pairs", "coalesce(e.route_id IN ('R' || r.qid // 100, 'R' || r.qid % 100), false)"),
    "stopless": _reach("stopless", "bus_stops", "walk_stops"),
    "half": _reach("half", "bus_half", "walk"),
    "every": _reach("every", "bus_every", "walk"),
    "thin": _reach("thin", "bus_thin", "walk"),
    "zoned": _reach("zoned", "bus", "walk_demand"),
    "lined": _reach("lined", "bus_line", "walk"),
}
_LATER = {
    "compared": "SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.stop_id, b.stop_id) AS stop_id, a.arrival_sec AS before_sec, b.arrival_sec AS after_sec, b.arrival_sec - a.arrival_sec AS delta_sec, "
    "CASE WHEN b.arrival_sec IS NULL THEN 'lost' WHEN a.arrival_sec IS NULL THEN 'new' WHEN b.arrival_sec - a.arrival_sec >= 60 THEN 'degraded' ELSE 'unaffected' END AS status "
    "FROM old a FULL JOIN new b ON a.qid = b.qid AND a.stop_id = b.stop_id",
    "stopped": "SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.stop_id, b.stop_id) AS stop_id, a.arrival_sec AS before_sec, b.arrival_sec AS after_sec, b.arrival_sec - a.arrival_sec AS delta_sec, "
    f"CASE WHEN coalesce(a.stop_id, b.stop_id) IN {_set(STOPS)} THEN 'removed' WHEN b.arrival_sec IS NULL THEN 'lost' WHEN a.arrival_sec IS NULL THEN 'new' WHEN b.arrival_sec - a.arrival_sec >= 60 THEN 'degraded' ELSE 'unaffected' END AS status "
    "FROM old a FULL JOIN stopless b ON a.qid = b.qid AND a.stop_id = b.stop_id",
    "sweep": "SELECT 'R' || k.qid AS route_id, o.qid, o.stop_id, o.arrival_sec AS before_sec, s.arrival_sec AS after_sec FROM old o CROSS JOIN asked_single k LEFT JOIN single s ON s.qid = k.qid AND s.stop_id = o.stop_id",
    "tight": _tight("old", "bus"),
    "tight_new": _tight("new", "bus_many"),
    **_chase("tight", "old", "p"),
    **_chase("tight_new", "new", "q"),
    **{
        f"{k}_routes": f"SELECT qid, target, string_agg(route_name, ';' ORDER BY d DESC) AS routes FROM "
        f"(SELECT qid, target, route_name, max(depth) AS d FROM {k}_s WHERE mode = '{MODE_BUS}' GROUP BY ALL) GROUP BY ALL"
        for k in "pq"
    },
    "access": "SELECT q.qid, f.*, coalesce(s.stop_name, '') AS stop_name, q.t0, a.arrival_sec AS was, b.arrival_sec AS now FROM placed f CROSS JOIN asked q LEFT JOIN stops s ON s.stop_id = f.nearest_stop "
    "LEFT JOIN old a ON a.qid = q.qid AND a.stop_id = f.nearest_stop LEFT JOIN new b ON b.qid = q.qid AND b.stop_id = f.nearest_stop",
    "changed": "SELECT qid, fac_ord, name, type, CASE WHEN was IS NOT NULL AND now IS NOT NULL THEN 'unchanged' WHEN was IS NOT NULL THEN 'lost' WHEN now IS NOT NULL THEN 'gained' ELSE 'never' END AS status, "
    "((was - t0 + walk_sec) * 10 + 30) // 60 / 10.0::DOUBLE AS before_min, ((now - t0 + walk_sec) * 10 + 30) // 60 / 10.0::DOUBLE AS after_min FROM access",
}
_ALL: dict[str, str] = dict(CTES) | {head: body for head, body in _SPLIT.values()} | _LATER
_NAMES = {re.match(r"\w+", head)[0]: head for head in _ALL}


def _with(select: str) -> str:
    """The query with the definitions that it needs, each after those that it needs itself."""
    order: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in dict.fromkeys(re.findall(r"\w+", re.sub(r"'[^']*'", "", text))):
            if name in _NAMES and name != own and name not in order and re.search(rf"(?:FROM|JOIN|,|recurring\.)\s*{name}\b", text):
                need(_ALL[_NAMES[name]], name)
                order.append(name)

    need(select)
    return "WITH RECURSIVE " + ",\n".join(f"{_NAMES[n]} AS ({_ALL[_NAMES[n]]})" for n in order) + f"\n{select}"


_ARRIVED = "SELECT qid, stop_id, arrival_sec FROM {0}"
_PLAIN = "SELECT from_stop, to_stop, departure_sec, arrival_sec, travel_time, trip_id, route_id FROM {0}"
_MIN = "(arrival_sec - t0) / 60.0::DOUBLE"
_CLOCK = "lpad(CAST({0} // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 3600 // 60 AS VARCHAR), 2, '0')"
_SUMS = "CAST(round_even(coalesce(sum(pop_t), 0), 0) AS BIGINT) AS total, CAST(round_even(coalesce(sum(pop_65over), 0), 0) AS BIGINT) AS elderly"
_NEAR = "SELECT DISTINCT m.mesh_ord FROM meshes m, stops s WHERE s.stop_id IN ({0}) AND " + _hav("m.lat", "m.lon", "s.stop_lat", "s.stop_lon") + " <= 300"
_GONE = "SELECT stop_id FROM stopped WHERE status = 'lost'"
_LOST = "SELECT stop_id FROM compared WHERE status = 'lost'"
_MARKER = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(type, {w!r})' for w in words)} THEN '{m}'" for words, m in MARKERS) + f" ELSE '{OTHER_MARKER}' END"

_ACCESS = (
    f"SELECT a.route_id, a.route_name, EXISTS (SELECT 1 FROM bus e WHERE e.route_id IS NOT DISTINCT FROM a.route_id AND e.from_stop IN (SELECT stop_id FROM stops WHERE stop_name = '{NAME}' "
        f"UNION SELECT w.to_stop FROM walk w JOIN stops s ON s.stop_id = w.from_stop WHERE s.stop_name = '{NAME}')) AS direct FROM area a"
)


def _affected(lost: str) -> str:
    return (
        f"SELECT CAST(0 AS BIGINT) AS qid, CAST(round_even(coalesce(sum(pop_t) FILTER (NOT c), 0), 0) AS BIGINT) AS affected_total, CAST(round_even(coalesce(sum(pop_65over) FILTER (NOT c), 0), 0) AS BIGINT) AS affected_elderly, "
        "count(*) FILTER (NOT c) AS uncovered_meshes, count(*) AS lost_meshes, count(*) FILTER (c) AS covered_by_others FROM ("
        f"SELECT *, mesh_ord IN ({_NEAR.format(f'SELECT stop_id FROM old WHERE stop_id NOT IN ({lost})')}) AS c FROM meshes WHERE mesh_ord IN ({_NEAR.format(lost)}))"
    )


ORACLE = {
    name: _with(text)
    for name, text in {
        "route_sweep": "SELECT * FROM sweep WHERE after_sec IS NULL OR after_sec > before_sec",
        "route_sweep_counts": "SELECT route_id, qid, count(after_sec) AS reached, count(*) - count(after_sec) AS lost, count(*) FILTER (after_sec - before_sec >= 60) AS degraded FROM sweep GROUP BY ALL",
        "route_pairs": "SELECT 'R' || qid // 100 || '+R' || qid % 100 AS scenario, CAST(0 AS BIGINT) AS qid, stop_id, arrival_sec FROM paired",
        "origins_hours": _ARRIVED.format("many"),
        "population_by_hour": f"SELECT x.qid AS hour, {_SUMS}, count(*) AS mesh_count FROM (SELECT DISTINCT p.qid, m.mesh_ord FROM profile p JOIN stops s ON s.stop_id = p.stop_id, meshes m WHERE {_hav("m.lat", "m.lon", "s.stop_lat", "s.stop_lon")} <= 300) x JOIN meshes m ON m.mesh_ord = x.mesh_ord GROUP BY 1",
        "facility_nearest_any": "SELECT fac_ord, stop_id AS nearest_stop, CAST(round_even(d, 0) AS BIGINT) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY fac_ord ORDER BY d, stop_ord) AS n FROM "
        f"(SELECT f.fac_ord, s.stop_id, s.stop_ord, {_hav('latitude', 'longitude', 'stop_lat', 'stop_lon')} AS d FROM facilities f, stops s)) WHERE n = 1",
        "demand_predecessors": "SELECT qid, stop_id, pred_stop, mode, trip_id, edge_type, arrival_sec FROM (" + _tight("zoned", "bus").replace("JOIN walk w", "JOIN walk_demand w") + ")",
        "network_bus_files": _PLAIN.format("bus"),
        "kept_layout": "SELECT qid AS hour, stop_id, arrival_sec FROM profile",
        "gtfs_archives": "SELECT feed, from_stop, to_stop, departure_sec, arrival_sec, trip_id, route_id FROM bus, (VALUES ('first'), ('second')) f(feed)",
        "checked_files": "SELECT 'facilities whole' AS file, '' AS missing, count(*) AS n FROM facilities UNION ALL SELECT 'facilities less', 'latitude,type', NULL "
        "UNION ALL SELECT 'population whole', '', count(*) FROM population UNION ALL SELECT 'population less', 'PopT', NULL",
        "feed_tables": "SELECT feed, name, CASE WHEN feed = 'with' OR name <> 'shapes' THEN n END AS n FROM (VALUES ('with'), ('without')) f(feed), "
        "(SELECT 'stops' AS name, count(*) AS n FROM stops UNION ALL SELECT 'stop_times', count(*) FROM stop_times UNION ALL SELECT 'shapes', count(*) FROM shapes UNION ALL SELECT 'calendar_dates', NULL)",
        "parse_times": f"SELECT trip_id, stop_sequence, {_CLOCK.format('arrival_sec')} || ':' || lpad(CAST(arrival_sec % 60 AS VARCHAR), 2, '0') AS time_text, arrival_sec AS seconds FROM stop_times",
        "format_times": f"SELECT trip_id, stop_sequence, {_CLOCK.format('arrival_sec')} AS hhmm FROM stop_times",
        "mesh_latlon": "SELECT mesh_ord, round(lat, 7) AS lat, round(lon, 7) AS lon FROM meshes",
        "weekday_trips": "SELECT trip_id, route_id FROM trips t JOIN calendar c ON c.service_id = t.service_id WHERE c.monday = 1",
        "bus_edges": "SELECT from_stop, to_stop, departure_sec, arrival_sec, travel_time, trip_id, route_id, 'bus' AS edge_type FROM bus",
        "walk_edges": "SELECT * FROM walk",
        "network_summary": "SELECT (SELECT count(*) FROM (SELECT from_stop FROM bus UNION SELECT to_stop FROM bus UNION SELECT from_stop FROM walk UNION SELECT to_stop FROM walk)) AS nodes, "
        "(SELECT count(*) FROM bus) AS bus_edges, (SELECT count(*) FROM walk) AS walk_edges",
        "trip_route_names": "SELECT * FROM names",
        "bbox_stops": "SELECT stop_id, stop_name FROM inside",
        "bbox_routes": "SELECT route_id, route_name FROM area",
        "stop_names": "SELECT DISTINCT stop_name FROM inside",
        "stop_ids_by_name": f"SELECT stop_id FROM stops WHERE stop_name = '{NAME}'",
        "default_origin": f"SELECT coalesce(max(CASE WHEN stop_name = '{NAME}' THEN stop_name END), min(stop_name)) AS stop_name FROM inside",
        "routes_direct_vs_transfer": _ACCESS,
        "isochrone": _ARRIVED.format("old"),
        "isochrone_bands": f"SELECT o.qid, stop_id, arrival_sec, {_MIN} AS travel_min, CASE WHEN {_MIN} <= 15 THEN 'green' WHEN {_MIN} <= 30 THEN 'orange' WHEN {_MIN} <= 45 THEN 'red' ELSE 'darkred' END AS band FROM old o JOIN asked a ON a.qid = o.qid",
        "hourly_profile": "SELECT qid AS hour, stop_id, arrival_sec FROM profile",
        "reached_by_hour": "SELECT h.qid AS hour, count(p.stop_id) AS reached FROM hours h LEFT JOIN profile p ON p.qid = h.qid GROUP BY h.qid",
        "route_removal": _ARRIVED.format("one"),
        "multi_route_removal": _ARRIVED.format("new"),
        "route_removal_edges": _PLAIN.format("bus_many"),
        "stop_removal_bus_edges": _PLAIN.format("bus_stops"),
        "stop_removal_walk_edges": "SELECT * FROM walk_stops",
        "stop_removal": _ARRIVED.format("stopless"),
        "thin_half_trips": f"SELECT DISTINCT trip_id FROM bus_half WHERE route_id = '{THIN_ROUTE}'",
        "thin_interval_trips": f"SELECT DISTINCT trip_id FROM bus_every WHERE route_id = '{THIN_ROUTE}'",
        "thin_all_trips": "SELECT DISTINCT trip_id, route_id FROM bus_thin",
        "frequency_half": _ARRIVED.format("half"),
        "frequency_interval": _ARRIVED.format("every"),
        "frequency_all": _ARRIVED.format("thin"),
        "demand_edges": "SELECT * FROM demand",
        "demand_transit": _ARRIVED.format("zoned"),
        "replacement_edges": _PLAIN.format("added"),
        "route_replacement": _ARRIVED.format("lined"),
        "compare_results": "SELECT * FROM compared",
        "degraded_top10": "SELECT stop_id, delta_sec FROM compared WHERE status = 'degraded' ORDER BY delta_sec DESC, qid, stop_id LIMIT 10",
        "run_stats": "SELECT qid, count(before_sec) AS before, count(after_sec) AS after, count(*) FILTER (status = 'lost') AS lost, count(*) FILTER (status = 'degraded') AS degraded, count(*) FILTER (status = 'new') AS new FROM compared GROUP BY qid",
        "stop_status_layer": "SELECT c.qid, c.stop_id, s.stop_name, c.status, (before_sec - t0) / 60.0::DOUBLE AS before_min, (after_sec - t0) / 60.0::DOUBLE AS after_min FROM compared c JOIN stops s ON s.stop_id = c.stop_id JOIN asked q ON q.qid = c.qid",
        "population_in_radius": f"SELECT {_SUMS}, count(*) AS mesh_count FROM meshes WHERE {_hav(_num(POINT[0]), _num(POINT[1]), 'lat', 'lon')} <= {POINT[2]}",
        "area_summary": f"SELECT {_SUMS}, count(*) AS meshes, CASE WHEN sum(pop_t) > 0 THEN round(sum(pop_65over) / sum(pop_t) * 100, 1) END AS elderly_percent FROM meshes",
        "population_near_stops": f"SELECT CAST(0 AS BIGINT) AS qid, {_SUMS}, count(*) AS mesh_count FROM meshes WHERE mesh_ord IN ({_NEAR.format('SELECT stop_id FROM old')}) HAVING count(*) > 0",
        "impact_population": _affected(_LOST),
        "stop_removal_population": _affected(_GONE),
        "stop_removal_changes": "SELECT * FROM stopped",
        "stop_removal_layer": "SELECT c.qid, c.stop_id, s.stop_name, c.status, (before_sec - t0) / 60.0::DOUBLE AS before_min, (after_sec - t0) / 60.0::DOUBLE AS after_min FROM stopped c JOIN stops s ON s.stop_id = c.stop_id JOIN asked q ON q.qid = c.qid",
        "accessible_facilities": f"SELECT qid, fac_ord, name, type, ((was - t0 + walk_sec) * 10 + 30) // 60 / 10.0::DOUBLE AS total_min FROM access WHERE was IS NOT NULL AND type IN {_set(TYPES)}",
        "facility_access_slow": f"SELECT qid, fac_ord, (slow * 10 + 30) // 60 / 10.0::DOUBLE AS walk_min, ((was - t0 + slow) * 10 + 30) // 60 / 10.0::DOUBLE AS total_min, was IS NOT NULL AS accessible FROM (SELECT a.*, CAST(round_even(d / {_num(SLOW_M_PER_MIN)} * 60, 0) AS BIGINT) AS slow "
        f"FROM access a JOIN (SELECT f.fac_ord AS fo, s.stop_id AS si, {_hav('latitude', 'longitude', 'stop_lat', 'stop_lon')} AS d FROM facilities f, stops s) x ON x.fo = a.fac_ord AND x.si = a.nearest_stop)",
        "scenario_labels": f"SELECT route_id, CASE WHEN direct THEN '[direct] ' ELSE '[transfer] ' END || route_name AS label, route_name AS plain, 'route removal: ' || route_name || ' (weekdays)' AS scenario FROM ({_ACCESS})",
        "summary_text": f"SELECT format('{{:,}}', total) AS total, format('{{:,}}', elderly) AS elderly, format('{{:.1f}}%', p) AS share FROM (SELECT {_SUMS}, round(sum(pop_65over) / sum(pop_t) * 100, 1) AS p FROM meshes)",
        "minutes_text": f"SELECT o.qid, stop_id, CAST(CAST(round_even({_MIN}, 0) AS BIGINT) AS VARCHAR) AS minutes FROM old o JOIN asked a ON a.qid = o.qid",
        "gtfs_bus_edges": _PLAIN.format("bus"),
        "gtfs_shapes": "SELECT shape_id, shape_pt_sequence, shape_pt_lat, shape_pt_lon FROM shapes",
        "network_files": "SELECT * FROM walk",
        "population_csv": "SELECT meshcode, pop_t, pop_65over, round(lat, 7) AS lat, round(lon, 7) AS lon FROM meshes",
        "facilities_csv": "SELECT name, type, latitude, longitude FROM facilities",
        "facility_types": "SELECT DISTINCT type FROM facilities",
        "facility_nearest_stop": "SELECT fac_ord, nearest_stop, distance_m, walk_sec FROM placed",
        "facility_access": "SELECT qid, fac_ord, name, type, nearest_stop, stop_name, distance_m, (walk_sec * 10 + 30) // 60 / 10.0::DOUBLE AS walk_min, ((was - t0 + walk_sec) * 10 + 30) // 60 / 10.0::DOUBLE AS total_min, was IS NOT NULL AS accessible FROM access",
        "facility_change": f"SELECT *, {_MARKER} AS marker FROM changed",
        "facility_delta_by_type": "SELECT qid, type, count(*) AS facilities, count(*) FILTER (status IN ('unchanged', 'lost')) AS before, count(*) FILTER (status IN ('unchanged', 'gained')) AS after, "
        "count(*) FILTER (status = 'gained') - count(*) FILTER (status = 'lost') AS diff FROM changed GROUP BY qid, type",
        "lost_facilities": "SELECT fac_ord, name, type FROM changed WHERE status = 'lost'",
        "predecessors": "SELECT qid, stop_id, pred_stop, mode, trip_id, edge_type, departure_sec, arrival_sec FROM tight",
        "paths": "SELECT o.qid, o.stop_id, count(s.depth) AS n_steps, coalesce(string_agg(concat_ws('|', s.pred_stop, s.stop_id, s.mode, s.route_name, s.departure_sec, s.arrival_sec), ';' ORDER BY s.depth DESC), '') AS path "
        "FROM old o LEFT JOIN p_s s ON s.qid = o.qid AND s.target = o.stop_id GROUP BY o.qid, o.stop_id",
        "path_routes": "SELECT o.qid, o.stop_id, coalesce(r.routes, '') AS routes FROM old o LEFT JOIN p_routes r ON r.qid = o.qid AND r.target = o.stop_id",
        "itinerary_text": f"SELECT o.qid, o.stop_id, coalesce(string_agg({_CLOCK.format('s.departure_sec')} || '-' || {_CLOCK.format('s.arrival_sec')} || ' ' || s.mode || CASE WHEN s.route_name <> '' THEN ' ' || s.route_name ELSE '' END || ' ' || a.stop_name || ' > ' || b.stop_name, chr(10) ORDER BY s.depth DESC), '') AS itinerary "
        "FROM old o LEFT JOIN p_s s ON s.qid = o.qid AND s.target = o.stop_id LEFT JOIN stops a ON a.stop_id = s.pred_stop LEFT JOIN stops b ON b.stop_id = s.stop_id GROUP BY o.qid, o.stop_id",
        "degraded_detail": "SELECT c.qid, c.stop_id, ((before_sec - t0) * 10 + 30) // 60 / 10.0::DOUBLE AS before_min, ((after_sec - t0) * 10 + 30) // 60 / 10.0::DOUBLE AS after_min, coalesce(p.routes, '') AS before_routes, coalesce(r.routes, '') AS after_routes "
        "FROM compared c JOIN asked q ON q.qid = c.qid LEFT JOIN p_routes p ON p.qid = c.qid AND p.target = c.stop_id LEFT JOIN q_routes r ON r.qid = c.qid AND r.target = c.stop_id WHERE status = 'degraded'",
        "shape_polylines": f"SELECT o.shape_id, o.route_id, n % 17 AS colour, o.route_id = '{ROUTE}' AS highlighted, count(*) AS n_points, string_agg(CAST(CAST(round(shape_pt_lat * 1e6) AS BIGINT) AS VARCHAR) || ' ' || CAST(CAST(round(shape_pt_lon * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY shape_pt_sequence, shape_pt_lat) AS line "
        "FROM (SELECT t.shape_id, arg_min(a.route_id, a.n) AS route_id, min(a.n) AS n FROM trips t JOIN (SELECT *, row_number() OVER (ORDER BY appears) - 1 AS n FROM area) a ON a.route_id = t.route_id GROUP BY t.shape_id) o JOIN shapes s ON s.shape_id = o.shape_id GROUP BY ALL HAVING count(*) >= 2",
    }.items()
}
