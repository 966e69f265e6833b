import math

from pyspark.sql import functions as F

from isospan import functions as fn


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def test_times(spark):
    texts = ["8:05:09", "25:00:00", "x", "08:05", None, "1:2:z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fn.parse_time("t")).collect()
    assert [r[0] for r in rows] == [29109, 90000, None, None, None, None]
    got = one(spark, a=fn.format_time(F.lit(29109)), b=fn.format_time(F.lit(90059)))
    assert got == {"a": "08:05", "b": "25:00"}


def test_distance_and_durations(spark):
    got = one(
        spark,
        d=fn.haversine(F.lit(42.0), F.lit(141.0), F.lit(43.0), F.lit(141.0)),
        w=fn.walk_seconds(F.lit(300.0)),
        least=fn.walk_seconds(F.lit(0.2)),
        half=fn.last_walk_seconds(F.lit(67 * 2.5 / 60)),
        ride=fn.ride_seconds(F.lit(100.0), 25),
        minutes=fn.tenth_minutes(F.lit(63)),
    )
    assert abs(got["d"] - math.radians(1) * 6_371_000) < 1e-3
    assert (got["w"], got["least"], got["half"], got["ride"], got["minutes"]) == (268, 1, 2, 14, 1.1)


def test_mesh_centre(spark):
    lat, lon = fn.mesh_centre(F.lit(6340370000))
    short, _ = fn.mesh_centre(F.lit(634037))
    got = one(spark, lat=F.round(lat, 7), lon=F.round(lon, 7), short=short)
    assert got == {"lat": 42.2504167, "lon": 140.875625, "short": None}


def test_labels(spark):
    got = one(
        spark,
        band=F.concat_ws(",", *(fn.travel_band(F.lit(x)) for x in (15, 15.1, 45, 46))),
        highway=F.concat_ws(",", *(fn.is_highway(F.lit(x)).cast("string") for x in ("都市間A", "B"))),
        none=fn.is_highway(F.lit(None).cast("string")),
        mark=F.concat_ws(",", *(fn.marker(F.lit(x)) for x in ("歯科医院", "薬局", "他"))),
        change=F.concat_ws(",", *(fn.access_change(F.lit(a), F.lit(b)) for a in (True, False) for b in (True, False))),
        label=fn.without_access(fn.with_access(F.lit("A] b"), F.lit(True))),
    )
    assert got == {
        "band": "green,orange,red,darkred",
        "highway": "true,false",
        "none": False,
        "mark": "plus,medkit,info-sign",
        "change": "unchanged,lost,gained,never",
        "label": "A] b",
    }
