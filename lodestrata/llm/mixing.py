"""Problem 8: one mix of several sources with target shares of the total size.

Method: every record gets a hash-random key. Within a source the records are sorted by ranges of
that key; token sums a range, summed up over the ranges, give each range its place in the source's
running total. The one range that holds the source's cut is divided into finer ranges the same way until it
holds at most ``IN_ONE_TASK`` records, and only these are ordered record by record.
The total is the largest that all sources can fill within their caps (or one that is passed in); a
source whose budget exceeds its tokens is used in whole epochs first, and the cut falls in the last.

Sources are compared trimmed and in lower case. Defined results: records with a null source, with a
source that has no target and records without a token take no part; a source with a target but no
tokens limits an automatic total to nothing only if ``skip_empty`` is off (by default it reports an
actual share of 0 and the others fill the mix in proportion); a null or negative target counts as 0, a null or
non-positive cap as 1. Repeated rows are records of their own, ordered by the key and then ``id_col``.
An empty table gives an empty mix. Other columns are ignored. More than ``MAX_SOURCES`` targets raise an error: every task holds a row for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.tokenids import DEFAULT_VOCABULARY, count_tokens
from lodestrata.session import cut_lineage

STEP = 10  # bits of the key that a division into ranges adds
IN_ONE_TASK = 100_000  # records of a source that are ordered one by one, at most
MAX_SOURCES = 10_000


def _source(c: str):
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def _targets(targets: DataFrame) -> DataFrame:
    return targets.groupBy(_source("source").alias("source")).agg(
        F.greatest(F.lit(0.0), F.coalesce(F.sum("target_share"), F.lit(0.0))).alias("target_share"),
        F.greatest(F.lit(1), F.coalesce(F.max("max_repeats"), F.lit(1))).alias("max_repeats"),
    ).filter(F.col("source").isNotNull())


def sized_records(docs: DataFrame, id_col: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY, seed: int = 17) -> DataFrame:
    """``(id_col, source, n_tokens, key)`` of the records that can take part, written once."""
    named = docs.select(F.col(id_col), _source("source").alias("source"), "text").filter(F.col("source").isNotNull() & F.col("text").isNotNull())
    named = named.withColumn("key", F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col("text")), F.lit(seed)))
    return cut_lineage(count_tokens(named, [id_col, "source", "key"], "text", vocabulary).filter("n_tokens > 0"))


def _budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None, skip_empty: bool) -> DataFrame:
    """``(source, max_repeats, epochs, rest)``: per source the epochs in full and the budget of the last one."""
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = _targets(targets)
    if t.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; raise MAX_SOURCES if executors can hold a row for each")
    t = t.join(have, "source", "left").fillna(0, ["available"])
    if skip_empty:
        filled = F.sum(F.when(F.col("available") > 0, F.col("target_share"))).over(Window.partitionBy())
        t = t.withColumn("share", F.when(F.col("available") > 0, F.try_divide(F.col("target_share"), filled)).otherwise(0.0))
    else:
        t = t.withColumn("share", F.col("target_share"))
    most = F.min(F.when(F.col("share") > 0, F.col("available") * F.col("max_repeats") / F.col("share"))).over(Window.partitionBy())
    t = t.withColumn("total", F.coalesce(F.lit(total_tokens).cast("double") if total_tokens is not None else most, F.lit(0.0)))
    t = t.withColumn("budget", F.least(F.floor(F.col("share") * F.col("total") + 1e-6), F.col("available") * F.col("max_repeats")))
    t = t.withColumn("epochs", F.coalesce(F.floor(F.try_divide(F.col("budget"), F.col("available"))), F.lit(0)).cast("int"))
    return t.select("source", "max_repeats", "epochs", (F.col("budget") - F.col("epochs") * F.col("available")).alias("rest"))


def _cuts(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Adds ``shift, cut, before`` to the budgets: the range ``key >> shift`` that holds the source's cut, and the tokens ahead of it; no cut where the whole source fits."""
    plan = budgets.withColumns({"shift": F.lit(64), "cut": F.lit(None).cast("bigint"), "before": F.lit(0).cast("bigint"), "records": F.lit(None).cast("bigint")})
    while True:
        wide_ = plan.filter(F.col("records").isNull() | ((F.col("records") > IN_ONE_TASK) & (F.col("shift") >= STEP)))
        if wide_.isEmpty():
            return plan.drop("records")
        inside = sized.join(F.broadcast(wide_), "source").filter(F.col("cut").isNull() | (F.expr("shiftright(key, shift)") == F.col("cut")))  # a row a source
        ranges = inside.groupBy("source", F.expr(f"shiftright(key, shift - {STEP})").alias("range")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
        over = ranges.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
        first = over.groupBy("source").agg(F.min_by(F.struct("range", (F.col("upto") - F.col("tokens")).alias("before"), "n"), "range").alias("f"))
        finer = wide_.drop("cut", "before", "records").join(first, "source", "left").select(
            "source", "max_repeats", "epochs", "rest", (F.col("shift") - STEP).alias("shift"), F.col("f.range").alias("cut"), F.coalesce("f.before", F.lit(0)).alias("before"), F.coalesce("f.n", F.lit(0)).alias("records")
        )
        plan = cut_lineage(plan.join(wide_.select("source"), "source", "left_anti").unionByName(finer))


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY, total_tokens: int | None = None, seed: int = 17, skip_empty: bool = True, sized: DataFrame | None = None) -> DataFrame:
    """``(id_col, source, n_tokens, uses)``: the records of the mix and how often each is used.

    ``uses`` never exceeds the source's ``max_repeats``. The record at a source's cut is taken if more
    than half of it lies within the budget, so a source is off its budget by half a record at most.
    """
    sized = sized_records(docs, id_col, vocabulary, seed) if sized is None else sized
    plan = _cuts(sized, cut_lineage(_budgets(sized, targets, total_tokens, skip_empty)))
    rows = sized.join(F.broadcast(plan), "source")  # at most MAX_SOURCES rows
    place = F.expr("shiftright(key, shift)")
    rows = rows.withColumn("side", F.when(F.col("cut").isNull() | (place < F.col("cut")), "in").when(place > F.col("cut"), "out").otherwise("cut"))
    whole = rows.filter("side <> 'cut'").select(id_col, "source", "n_tokens", (F.col("epochs") + (F.col("side") == "in").cast("int")).alias("uses"))
    order = Window.partitionBy("source").orderBy("key", id_col).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n_tokens").over(order)
    taken = (upto - F.col("n_tokens") / 2 < F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))
    at_cut = rows.filter("side = 'cut'").withColumn("uses", F.col("epochs") + taken.cast("int")).select(id_col, "source", "n_tokens", "uses")
    return whole.unionByName(at_cut).filter("uses > 0")


def mix_report(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY, total_tokens: int | None = None, seed: int = 17, skip_empty: bool = True) -> DataFrame:
    """A row for each target: ``source, target_share, actual_share, records, uses, tokens, most_uses, max_repeats``."""
    used = mix(docs, targets, id_col, vocabulary, total_tokens, seed, skip_empty)
    by = used.groupBy("source").agg(
        F.count("*").alias("records"), F.sum("uses").cast("long").alias("uses"),
        F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.max("uses").alias("most_uses"),
    )
    out = F.broadcast(_targets(targets)).join(by, "source", "left").fillna(0, ["records", "uses", "tokens", "most_uses"])
    share = F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(Window.partitionBy()).cast("double")), F.lit(0.0))
    return out.select("source", "target_share", share.alias("actual_share"), "records", "uses", "tokens", "most_uses", "max_repeats")
