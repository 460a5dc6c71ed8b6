"""Resampling, histograms, sessions, as-of and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from lodestrata.operators.ordering import running_total


def bucket_label(ts: Column, freq: str) -> Column:
    """Day, week (labelled by its Sunday) or month (by its last day)."""
    d = ts.cast("date")
    return {"D": d, "W": F.date_add(F.date_trunc("week", ts).cast("date"), 6), "M": F.last_day(d)}[freq]


def spine(buckets: DataFrame, name: str, freq: str) -> DataFrame:
    """``(name)``: every bucket from the first to the last of ``buckets``."""
    step = {"D": "interval 1 day", "W": "interval 7 days", "M": "interval 1 month"}[freq]
    ends = buckets.agg(F.min(name).alias("a"), F.max(name).alias("z"))
    day = F.explode(F.sequence(F.trunc("a", "month") if freq == "M" else F.col("a"), F.col("z"), F.expr(step)))
    return ends.filter("a IS NOT NULL").select(day.alias("d")).select((F.last_day("d") if freq == "M" else F.col("d")).alias(name))


def medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """``(by, median)``, exact, the mean of the two in the middle for an even number; nulls don't count.

    Equal values are counted first, and the counts added up over ranges of the values, so that no task holds all values of a group.
    """
    counted = df.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = running_total(counted, [by], ["_v"], F.col("_c"), "_upto")
    n = upto.groupBy(by).agg(F.sum("_c").alias("_all"))
    at = lambda rank: F.max(F.when((F.expr(rank) > F.col("_upto") - F.col("_c")) & (F.expr(rank) <= F.col("_upto")), F.col("_v")))
    middle = upto.join(n, by).groupBy(by).agg(at("(_all + 1) div 2").alias("_lo"), at("(_all + 2) div 2").alias("_hi"))
    return middle.select(by, ((F.col("_lo") + F.col("_hi")) / 2).alias("median"))


def resample(df: DataFrame, ts_col: str, value_col: str, freq: str) -> DataFrame:
    """``(bucket, mean, sum, min, max, median, n)`` of every bucket from the first to the last; empty ones have sum 0 and nulls.

    Rows are aggregated before anything else; the spine of buckets is as long as the time span, not the data. The median is exact.
    """
    rows = df.filter(F.col(ts_col).isNotNull()).select(bucket_label(F.col(ts_col), freq).alias("bucket"), F.col(value_col).alias("v"))
    agg = rows.groupBy("bucket").agg(F.avg("v").alias("mean"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))
    agg = agg.join(medians(rows, "bucket", "v"), "bucket", "left").select("bucket", "mean", "sum", "min", "max", "median", "n")
    return spine(agg, "bucket", freq).join(agg, "bucket", "left").withColumn("sum", F.coalesce("sum", F.lit(0.0))).withColumn("n", F.coalesce("n", F.lit(0)))


def pick_x(df: DataFrame, want: str | None = None) -> str:
    """The column of the horizontal axis: the one asked for, else the first with "date" or "time" in its name, else the first."""
    if want in df.columns:
        return want
    return next((c for c in df.columns if "date" in c.lower() or "time" in c.lower()), df.columns[0])


def pick_y(df: DataFrame, want: str | list[str] | None = None) -> list[str]:
    """The columns of values: those asked for (a list or a text divided by commas) that exist, else all numeric ones, else the second column."""
    if want is None:
        return [f.name for f in df.schema if isinstance(f.dataType, NumericType)] or df.columns[1:2]
    names = [c.strip() for c in want.split(",")] if isinstance(want, str) else want
    return [c for c in names if c in df.columns]


def _as_times(df: DataFrame, x: str) -> DataFrame:
    """``df`` with texts of ``x`` as timestamps when every one that isn't null is one, else unchanged."""
    t = F.try_to_timestamp(F.col(x))
    wrong = df.filter(F.col(x).isNotNull() & t.isNull()).limit(1).count()
    return df if wrong else df.withColumn(x, t)


def series(df: DataFrame, x: str | None = None, y: str | list[str] | None = None, freq: str | None = None, parse_dates: bool = True) -> DataFrame:
    """``(x, series, value)``: the data of a chart, long, a row for each row (or bucket) and column of values.

    Axes are chosen by ``pick_x`` and ``pick_y``; texts on the horizontal axis become times if all of them are. With ``freq`` (D, W or M) times are put into buckets with
    the mean of each column, buckets without rows have null; an axis that isn't of times is left as it is.
    """
    x, names = pick_x(df, x), pick_y(df, y)
    rows = df.select(F.col(x).alias("x"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(names)])
    if parse_dates and isinstance(rows.schema["x"].dataType, StringType):
        rows = _as_times(rows, "x")
    is_time = isinstance(rows.schema["x"].dataType, (DateType, TimestampType, TimestampNTZType))
    values = [f"y{i}" for i, f in enumerate(rows.schema.fields[1:]) if not (freq and is_time) or isinstance(f.dataType, NumericType)]
    if freq and is_time:
        means = rows.filter("x IS NOT NULL").groupBy(bucket_label(F.col("x"), freq).alias("x")).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("_n"))
        rows = spine(means, "x", freq).join(means, "x", "left")
    kind = "double" if all(isinstance(rows.schema[v].dataType, NumericType) for v in values) else "string"
    pairs = F.explode(F.array(*[F.struct(F.lit(names[int(v[1:])]).alias("series"), F.col(v).cast(kind).alias("value")) for v in values]))
    return rows.select("x", pairs.alias("p")).select("x", "p.series", "p.value")


def histogram(df: DataFrame, value_col: str, bins: int = 30) -> DataFrame:
    """``(bin, n)`` over equal bins of the whole range; the last bin holds the maximum. Empty bins are listed; equal values give one bin."""
    v = df.select(F.col(value_col).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"))).otherwise(0)
    counted = v.join(F.broadcast(ends), F.lit(True)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").fillna(0, ["n"])


def sessions(events: DataFrame, user_col: str, ts_col: str, gap_seconds: int) -> DataFrame:
    """``(user, session_start, session_end, n)``: runs of events no further apart than the gap."""
    e = events.filter(F.col(user_col).isNotNull() & F.col(ts_col).isNotNull()).withColumn("_t", F.col(ts_col).cast("timestamp"))
    s = e.groupBy(user_col, F.session_window("_t", f"{gap_seconds} seconds")).agg(F.min("_t").alias("session_start"), F.max("_t").alias("session_end"), F.count("*").alias("n"))
    return s.drop("session_window")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, left_id: str) -> DataFrame:
    """For every left row the ``value`` of the latest right row of its key at or before it; no pairs are made.

    Both sides are sorted together by (key, day, time), so a key with very many rows is spread over its days; what is valid at a day's begin comes from
    the last right rows of the days before it, one a day. Times that aren't dates make one day.
    """
    both = left.select(key, F.col(left_ts).alias("t"), F.lit(1).alias("side"), F.col(left_id).alias("lid"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(None).cast(right.schema[right_ts].dataType).alias("rt")).unionByName(
        right.select(key, F.col(right_ts).alias("t"), F.lit(0).alias("side"), F.lit(None).cast(left.schema[left_id].dataType).alias("lid"), F.col(value).alias("v"), F.col(right_ts).alias("rt"))
    )
    both = both.withColumn("day", F.to_date("t") if isinstance(left.schema[left_ts].dataType, (DateType, TimestampType, TimestampNTZType)) else F.lit(None).cast("date"))
    days = both.groupBy(key, "day").agg(F.max_by(F.struct("rt", "v"), F.when(F.col("side") == 0, F.col("t"))).alias("last"))
    ahead = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col(key).alias("_key"), F.col("day").alias("_day"), F.last(F.when(F.col("last.rt").isNotNull(), F.col("last")), True).over(ahead).alias("carried"))
    w = Window.partitionBy(key, "day").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("own", F.last(F.when(F.col("side") == 0, F.struct("rt", "v")), True).over(w)).filter("side = 1")
    out = own.join(days, F.col(key).eqNullSafe(F.col("_key")) & F.col("day").eqNullSafe(F.col("_day")), "left").withColumn("got", F.coalesce("own", "carried"))
    return out.select(F.col("lid").alias(left_id), key, F.col("got.rt").alias("asof_ts"), F.col("got.v").alias("asof_value"))


def range_join(points: DataFrame, spans: DataFrame, point: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs with start <= point < end: both sides get the cells of ``width`` that they lie in, so the join is an equi-join."""
    cell = lambda c: F.floor(F.col(c) / width)
    s = spans.withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    return points.withColumn("_cell", cell(point)).join(s, "_cell").filter((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_cell")
