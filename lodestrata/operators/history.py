"""Conversation history: filters, searches, grids, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage

SEARCHED = ("prompt", "answer", "mode", "model", "embedder")


def unique_chats(chats: DataFrame) -> DataFrame:
    """One row an id (equal rows arrive twice)."""
    return chats.dropDuplicates(["id"])


def between_days(chats: DataFrame, first: float, last: float) -> DataFrame:
    """Rows from the begin of day ``first`` to the end of day ``last`` (epoch seconds of their midnights)."""
    return chats.filter(F.col("ts").between(first, last + 86399.0))


def _escape(term: str) -> str:
    return term.replace("\\", "\\\\")


def search_like(chats: DataFrame, term: str) -> DataFrame:
    """SQL LIKE ``%term%`` in any case over five columns; % and _ in the term are wildcards."""
    tests = [F.coalesce(F.col(c).ilike(f"%{_escape(term)}%"), F.lit(False)) for c in SEARCHED]
    return chats.filter(_any(tests))


def search_regex(chats: DataFrame, pattern: str) -> DataFrame:
    """A regular expression in any case over five columns; an invalid one matches nothing."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        return chats.filter(F.lit(False))
    return chats.filter(_any([F.coalesce(F.col(c).rlike(f"(?i){pattern}"), F.lit(False)) for c in SEARCHED]))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def newest(chats: DataFrame, n: int) -> DataFrame:
    return chats.orderBy(F.desc("ts"), F.desc("id")).limit(max(1, n))


def oldest(chats: DataFrame, n: int) -> DataFrame:
    return chats.orderBy("ts", "id").limit(max(1, n))


def appendable(chats: DataFrame) -> DataFrame:
    """Rows that may be stored: an answer and a project that aren't blank; null texts become empty."""
    kept = chats.filter((F.trim(F.coalesce("answer", F.lit(""))) != "") & (F.trim(F.coalesce("project", F.lit(""))) != ""))
    return kept.fillna("", ["ts_iso", "project_path", "mode", "model", "embedder", "prompt"]).fillna(0, ["streaming", "rag_on"])


def without(chats: DataFrame, keys: DataFrame) -> DataFrame:
    """The chats but for those of ``keys`` (project, id); a null project is a project of its own. Written as a new version, this is the delete."""
    k = keys.select(F.col("project").alias("_project"), F.col("id").alias("_id"))
    return chats.join(k, F.col("project").eqNullSafe(F.col("_project")) & (F.col("id") == F.col("_id")), "left_anti")


def with_ids(existing_max: int, fresh: DataFrame, order: list[str]) -> DataFrame:
    """Numbers on from ``existing_max``: positions within ranges of the order plus the sizes of the ranges before, no single-task sort."""
    ranged = fresh.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    part, pos = F.shiftright("_m", 33), F.col("_m") % F.lit(1 << 33)
    ranged = cut_lineage(ranged.withColumn("_p", part).withColumn("_i", pos))  # sizes and rows must come from one and the same division
    sizes = ranged.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(sizes.select("_p", "_before")), "_p").withColumn("new_id", F.lit(existing_max) + F.col("_before") + F.col("_i") + 1).drop("_m", "_p", "_i", "_before")


def context_messages(chats: DataFrame, turns: int) -> DataFrame:
    """``(pos, role, content)``: the latest turns, oldest first, two messages a turn, blank ones left out."""
    last = newest(chats, turns).withColumn("turn", F.row_number().over(Window.orderBy("ts", "id")))  # at most `turns` rows
    two = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    m = last.select("turn", F.explode(two).alias("m")).filter(F.trim(F.coalesce("m.content", F.lit(""))) != "")
    return m.select((F.col("turn") * 2 + F.col("m.k") - 1).alias("pos"), "m.role", "m.content")


def markdown(chats: DataFrame) -> DataFrame:
    """``(id, section)``: one Markdown section a chat; sections are concatenated in (ts, id) order on write."""
    return chats.select("id", F.format_string("## Chat %d\n\n**Project:** %s\n\n**Prompt**\n\n%s\n\n**Answer**\n\n%s", F.col("id"), F.coalesce("project", F.lit("")), F.coalesce("prompt", F.lit("")), F.regexp_replace(F.coalesce("answer", F.lit("")), r"[\t-\r ]+$", "")).alias("section"))
