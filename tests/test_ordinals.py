import random

from isospan import ordinals, sources


def test_ranked(spark):
    values = random.Random(1).sample(range(10_000), 700)
    df = spark.createDataFrame([(v, f"x{v}") for v in values], "v int, name string")
    got = ordinals.ranked(df, "n", "v")
    assert got.columns == ["v", "name", "n"]
    assert [(r.v, r.n) for r in got.orderBy("n").collect()] == [(v, k) for k, v in enumerate(sorted(values))]
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert ordinals.ranked(df.limit(0), "n", "v").count() == 0


def test_file_order(spark, tmp_path):
    """Of several files with small splits, rows have the order of the files one after the other."""
    want = []
    for f in range(4):
        rows = [f"{f},{k},{'y' * (k % 40)}" for k in range((40, 0, 300, 1)[f])]
        want += [tuple(map(int, r.split(",")[:2])) for r in rows]
        (tmp_path / f"part-{f}.csv").write_text("\n".join(["f,k,text", *rows]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        raw = ordinals.placed(spark.read.csv(str(tmp_path), header=True, inferSchema=False))
        assert raw.rdd.getNumPartitions() > 20
        got = ordinals.in_file_order(raw, "n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(int(r.f), int(r.k)) for r in sorted(got, key=lambda r: r.n)] == want
    assert sorted(r.n for r in got) == list(range(len(want)))


def test_feed_of_several_files(spark, tmp_path):
    for name, head, rows in (
        ("stops", "stop_id,stop_name,stop_lat,stop_lon", ["B,b,1,1", "A,a,1,2", "C,c,1,3", "D,d,1,4"]),
        ("routes", "route_id,route_long_name", ["r,old", "s,one", "r,new", "t,two"]),
        ("trips", "trip_id,route_id,service_id", ["1,r,w"]),
        ("calendar", "service_id,monday", ["w,1"]),
        ("stop_times", "trip_id,stop_id,stop_sequence,arrival_time,departure_time", ["1,A,1,08:00:00,08:00:00"]),
    ):
        folder = tmp_path / f"{name}.txt"
        folder.mkdir()
        for k in (0, 1):
            (folder / f"part-{k}").write_text("\n".join([head, *rows[2 * k : 2 * k + 2]]) + "\n")
    feed = sources.read_gtfs(spark, str(tmp_path))
    assert [r.stop_id for r in feed.stops.orderBy("stop_ord").collect()] == ["B", "A", "C", "D"]
    assert {r.route_id: r.route_long_name for r in feed.routes.collect()} == {"r": "new", "s": "one", "t": "two"}
