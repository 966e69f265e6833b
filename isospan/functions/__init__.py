"""Column functions: times of day, distances, mesh codes, travel bands and labels. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_000.0
WALK_M_PER_MIN = 67.0
WALK_EDGE_M = 300.0
POPULATION_M = 300.0
FACILITY_M = 500.0
BBOX = (42.28, 42.42, 140.88, 141.05)
HIGHWAY_WORDS = ("高速", "都市間")
UNKNOWN_ROUTE = "不明"
MODE_WALK, MODE_BUS = "徒歩", "バス"
SERVICE_SPAN = (5 * 3600, 22 * 3600)
DWELL_SEC = 30
PROFILE_HOURS = range(5, 23)
BANDS = ((15, "green"), (30, "orange"), (45, "red"))
LAST_BAND = "darkred"
#: Marker by what the type of a facility contains: (words, marker), the first that fits.
MARKERS = (
    (("病院", "歯科"), "plus"),
    (("スーパー", "コンビニ"), "shopping-cart"),
    (("郵便局",), "envelope"),
    (("薬局",), "medkit"),
)
OTHER_MARKER = "info-sign"


def parse_time(text: Column | str) -> Column:
    """Seconds since the start of the service day from H:MM:SS; hours beyond 23 count on. Null for other texts."""
    part = F.split(text, ":")
    h, m, s = (F.get(part, F.lit(k)).try_cast("bigint") for k in range(3))
    return F.when(F.size(part) == 3, h * 3600 + m * 60 + s)


def format_time(seconds: Column) -> Column:
    """HH:MM, seconds dropped; hours may exceed 23."""
    hours = F.floor(seconds / 3600).cast("bigint")
    return F.format_string("%02d:%02d", hours, F.floor((seconds - hours * 3600) / 60).cast("bigint"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere."""
    half = lambda x, y: F.sin(F.radians(y - x) / 2)
    north, east = half(lat1, lat2), half(lon1, lon2)
    a = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * east * east
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def mesh_centre(code: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the centre of a 100 m mesh by its code of ten digits or more; null for shorter ones."""
    text = code.cast("string")
    digits = lambda at, n=1: F.substring(text, at, n).try_cast("double")
    lat = digits(1, 2) / 1.5 + digits(5) / 12 + digits(7) / 120 + digits(9) / 1200 + F.lit(1.0) / 2400
    lon = digits(3, 2) + 100 + digits(6) / 8 + digits(8) / 80 + digits(10) / 800 + F.lit(1.0) / 1600
    full = F.length(text) >= 10
    return F.when(full, lat), F.when(full, lon)


def walk_seconds(metres: Column) -> Column:
    """Of a walk between stops: cut to whole seconds, 1 at least."""
    return F.greatest(F.lit(1), (metres / WALK_M_PER_MIN * 60).cast("bigint"))


def last_walk_seconds(metres: Column, m_per_min: float = WALK_M_PER_MIN) -> Column:
    """Of the walk from a stop to a facility: rounded to whole seconds, may be 0."""
    return F.bround(metres / F.lit(float(m_per_min)) * 60).cast("bigint")


def ride_seconds(metres: Column, km_per_h: float) -> Column:
    """Of a ride between two stops of a new line: cut to whole seconds, may be 0."""
    return (metres / F.lit(km_per_h * 1000 / 3600)).cast("bigint")


def tenth_minutes(seconds: Column) -> Column:
    """Minutes with one decimal, halves up, in whole-number arithmetic."""
    return F.floor((seconds * 10 + 30) / 60).cast("bigint") / F.lit(10.0)


def travel_band(minutes: Column) -> Column:
    """Colour of a travel time; limits belong to the lower band."""
    out = F.when(minutes <= BANDS[0][0], BANDS[0][1])
    for most, colour in BANDS[1:]:
        out = out.when(minutes <= most, colour)
    return out.otherwise(LAST_BAND)


def in_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float] = BBOX) -> Column:
    return lat.between(bbox[0], bbox[1]) & lon.between(bbox[2], bbox[3])


def is_highway(name: Column) -> Column:
    """False for a null name."""
    found = F.lit(False)
    for word in HIGHWAY_WORDS:
        found = found | F.contains(name, F.lit(word))
    return F.coalesce(found, F.lit(False))


def marker(kind: Column) -> Column:
    """Marker of a facility by its type."""
    out = F.lit(OTHER_MARKER)
    for words, name in reversed(MARKERS):
        fits = F.lit(False)
        for word in words:
            fits = fits | F.contains(kind, F.lit(word))
        out = F.when(fits, name).otherwise(out)
    return out


def access_change(before: Column, after: Column) -> Column:
    """unchanged, lost, gained or never, from whether a facility was and is within reach."""
    return F.when(before & after, "unchanged").when(before, "lost").when(after, "gained").otherwise("never")


def with_access(name: Column, direct: Column) -> Column:
    """A route's name with whether it is boarded directly or after a transfer."""
    return F.concat(F.when(direct, "[direct] ").otherwise("[transfer] "), name)


def without_access(label: Column) -> Column:
    """What stands behind the first "] " of a label, or all of it."""
    return F.regexp_replace(label, r"^.*?\] ", "")


def thousands(number: Column) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(number, 0)


def percent_text(share: Column) -> Column:
    """A number of percent with one decimal and the sign."""
    return F.format_string("%.1f%%", F.round(share, 1))


def whole_minutes(minutes: Column) -> Column:
    """Minutes without decimals, halves to the even number."""
    return F.bround(minutes, 0).cast("bigint").cast("string")
