import datetime as dt
import random
from statistics import median

from pyspark.sql import functions as F

from lodestrata.operators import history, ordering, timeseries


def made(spark, n=3000):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.8 else rng.choice(["a", "b", None]), i, rng.randrange(500)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, i int, v int").repartition(7)


def test_running_total_over_a_group_of_many_ranges(spark):
    rows, df = made(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ordering.by_ranges(df, ["g"], ["i"]).filter("g = 'hot'").select("_p").distinct().count() > 2
        got = {(r.g, r.i): r.t for r in ordering.running_total(df, ["g"], ["i"], F.col("v"), "t").collect()}
        sides = {(r.g, r.i): (r.before, r.after) for r in ordering.beside(df, ["g"], ["i"], "i", "before", "after").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(sides) == len(rows)
    for g in ("hot", "a", "b", None):
        own, total = sorted((i, v) for h, i, v in rows if h == g), 0
        for at, (i, v) in enumerate(own):
            total += v
            assert got[g, i] == total
            assert sides[g, i] == (own[at - 1][0] if at else None, own[at + 1][0] if at + 1 < len(own) else None)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, i int, v int")
    assert ordering.running_total(df, ["g"], ["i"], F.col("v"), "t").count() == 0
    assert ordering.beside(df, ["g"], ["i"], "i", "before", "after").count() == 0
    assert timeseries.medians(df, "g", "v").count() == 0


def test_medians_with_ties_and_nulls(spark):
    rows, df = made(spark, 501)
    df = df.unionByName(spark.createDataFrame([("a", 1, None), ("only nulls", 1, None)], "g string, i int, v int"))
    got = {r.g: r["median"] for r in timeseries.medians(df, "g", "v").collect()}
    assert got == {g: median([v for h, _, v in rows if h == g]) for g in ("hot", "a", "b")}


def test_delete_by_project_and_id(spark):
    c = spark.createDataFrame([("p", 1), ("p", 2), (None, 3), (None, 4), ("q", 1)], "project string, id int")
    keys = spark.createDataFrame([("p", 1), (None, 3), ("q", 2), ("p", None)], "project string, id int")
    assert sorted((r.project or "", r.id) for r in history.without(c, keys).collect()) == [("", 4), ("p", 2), ("q", 1)]


def test_series_picks_its_axes(spark):
    day = dt.datetime(2024, 1, 31)
    df = spark.createDataFrame([(1, "2024-01-01", 2.0, "x"), (2, "2024-02-03", None, "y"), (3, "2024-02-04", 5.0, "z")], "n int, made_date string, v double, w string")
    assert (timeseries.pick_x(df), timeseries.pick_x(df, "v"), timeseries.pick_x(df, "none"), timeseries.pick_x(df.select("w", "v"))) == ("made_date", "v", "made_date", "w")
    assert (timeseries.pick_y(df), timeseries.pick_y(df, " v, q,w"), timeseries.pick_y(df.select("made_date", "w"))) == (["n", "v"], ["v", "w"], ["w"])
    got = timeseries.series(df, y="v", freq="M").orderBy("x").collect()
    assert [(str(r.x), r.series, r.value) for r in got] == [("2024-01-31", "v", 2.0), ("2024-02-29", "v", 5.0)]
    plain = timeseries.series(df.unionByName(spark.createDataFrame([(4, "soon", 1.0, "x")], df.schema)), y="v", freq="M")
    assert dict(plain.dtypes)["x"] == "string" and plain.count() == 4  # one value that is no date leaves all as they are
    assert dict(timeseries.series(df, y="v", parse_dates=False).dtypes)["x"] == "string"
    assert timeseries.series(df.filter("n > 9"), y="v", freq="M").count() == 0
    assert timeseries.series(df.withColumn("made_date", F.lit(day)), y="v").filter(F.col("x") == F.lit(day)).count() == 3
