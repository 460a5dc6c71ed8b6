"""Positions, running totals and neighbours in an order, for groups of which one may hold a great share of the rows.

Rows are divided by ranges of (group, order), so a large group lies in as many tasks as its rows need. What a range has to know of the ranges before
and after it is one row a range, as only the first and last group of a range can go on beyond it; that table is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage


def by_ranges(df: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` with ``_p``, the number of its range; written once, as all later steps must see the same division. Texts should be left out."""
    ends = [F.col(c) if isinstance(c, str) else c for c in (*by, *order)]
    return cut_lineage(df.repartitionByRange(*ends).withColumn("_p", F.spark_partition_id()))


def _beside(rows: DataFrame, few: DataFrame, by: list[str]) -> DataFrame:
    """Left join on the range and the group, null groups included."""
    other = few.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(("_p", *by))], *[c for c in few.columns if c not in ("_p", *by)])
    on = F.lit(True)
    for i, c in enumerate(("_p", *by)):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(other), on, "left").drop(*[f"_k{i}" for i in range(len(by) + 1)])


def running_total(df: DataFrame, by: list[str], order: list[Column | str], amount: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` (not null) over the rows of the group up to and with this one. ``order`` should leave no ties."""
    parts = by_ranges(df.withColumn("_a", amount), by, order)
    sums = parts.groupBy("_p", *by).agg(F.sum("_a").alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_b", F.sum("_s").over(earlier)).filter("_b IS NOT NULL").drop("_s")
    own = F.sum("_a").over(Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = _beside(parts.withColumn("_own", own), before, by)
    return out.withColumn(name, F.col("_own") + F.coalesce("_b", F.lit(0))).drop("_a", "_own", "_b", "_p")


def beside(df: DataFrame, by: list[str], order: list[Column | str], value: str, before: str, after: str) -> DataFrame:
    """Adds ``before`` and ``after``: the ``value`` (not null) of the row before and after in the group."""
    parts = by_ranges(df, by, order)
    w = Window.partitionBy("_p", *by).orderBy(*order)
    rows = parts.withColumn("_n", F.row_number().over(w)).withColumn("_before", F.lag(value).over(w)).withColumn("_after", F.lead(value).over(w))
    ends = parts.withColumn("_n", F.row_number().over(w)).groupBy("_p", *by).agg(F.min_by(value, "_n").alias("_first"), F.max_by(value, "_n").alias("_last"))
    g = Window.partitionBy(*by).orderBy("_p")
    over = ends.select("_p", *by, F.lag("_last").over(g).alias("_b"), F.lead("_first").over(g).alias("_f")).filter("_b IS NOT NULL OR _f IS NOT NULL")
    out = _beside(rows, over, by)
    return out.withColumn(before, F.coalesce("_before", "_b")).withColumn(after, F.coalesce("_after", "_f")).drop("_n", "_before", "_after", "_b", "_f", "_p")
