"""Graph operators: connected components and bounded reachability over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of an undirected edge table.

    Contraction: in each round every node points at the one of itself and its neighbours that comes
    first in a random order of that round, edges are renamed to what their ends point at, and those
    within one node vanish. The edge table shrinks by a constant factor a round, so the rounds are
    logarithmic also for long chains; minima are combined before the shuffle, so a node with very
    many edges is no hot spot. Null ends and self loops are ignored; no edges give no rows.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = cut_lineage(e)
    total: DataFrame | None = None
    for k in range(max_rounds):
        if e.isEmpty():
            break
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)), F.col(c).alias("node"))  # noqa: E731, B023
        best = both.groupBy("u").agg(F.least(F.min(rank("v")), F.min(rank("u"))).alias("best"))
        step = cut_lineage(best.select(F.col("u").alias("node"), F.col("best.node").alias("to")))
        total = step if total is None else cut_lineage(
            total.alias("t").join(step.withColumnRenamed("node", "n2").withColumnRenamed("to", "to2"), F.col("to") == F.col("n2"), "left")
            .select("node", F.coalesce("to2", "to").alias("to"))
        )
        a = step.select(F.col("node").alias("u"), F.col("to").alias("pu"))
        b = step.select(F.col("node").alias("v"), F.col("to").alias("pv"))
        e = e.join(a, "u").join(b, "v").filter("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        e = cut_lineage(e)
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    if total is None:
        return edges.select(F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
    return total.select("node", F.col("to").alias("component"))


def reachable(edges: DataFrame, starts: DataFrame, depth: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(start, node, depth)``: the least number of edges, at most ``depth``, from each start to each node."""
    e = cut_lineage(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    front = starts.select(F.col(starts.columns[0]).alias("start"), F.col(starts.columns[0]).alias("node")).distinct()
    seen = front = cut_lineage(front.withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        new = front.join(e, F.col("node") == F.col("a")).select("start", F.col("b").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        front = cut_lineage(new.withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.select("start", "node", "depth")
