"""Line search, relevance, statistics and replacement over texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import split_lines


def lines_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, line_no, line)``, 1-based."""
    return df.select(id_col, F.posexplode(split_lines(F.col(text_col))).alias("pos", "line")).select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


def grep(df: DataFrame, id_col: str, text_col: str, pattern: str, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """``(id_col, line_no, line)`` of the matching lines, without white space at their ends. Whole texts are tested first, so that few are split."""
    def test(c: Column) -> Column:
        if regex:
            return c.rlike(("(?im)" if ignore_case else "(?m)") + pattern)
        return F.lower(c).contains(pattern.lower()) if ignore_case else c.contains(pattern)

    hit = lines_of(df.filter(test(F.col(text_col))), id_col, text_col).filter(test(F.col("line")))
    return hit.withColumn("line", F.regexp_replace("line", r"\s+$", ""))


def grep_context(df: DataFrame, id_col: str, text_col: str, pattern: str, around: int = 2) -> DataFrame:
    """``(id_col, line_no, snippet)``: each matching line with the lines around it, as ``number:line``."""
    some = df.filter(F.col(text_col).contains(pattern))
    ln = some.select(id_col, split_lines(F.col(text_col)).alias("lines")).select(id_col, "lines", F.posexplode("lines").alias("pos", "line")).filter(F.col("line").contains(pattern))
    first = F.greatest(F.lit(0), F.col("pos") - around)
    part = F.slice("lines", first + 1, F.least(F.size("lines"), F.col("pos") + around + 1) - first)
    text = F.array_join(F.transform(part, lambda x, i: F.concat((first + i + 1).cast("string"), F.lit(":"), x)), "\n")
    return ln.select(id_col, (F.col("pos") + 1).alias("line_no"), text.alias("snippet"))


def relevance(df: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """``(id_col, score)``: how many of the terms (repeated ones count again) the text contains, in any case; zero scores left out."""
    low = F.lower(F.coalesce(text_col, F.lit("")))
    score = reduce(lambda a, b: a + b, [low.contains(t.lower()).cast("int") for t in terms], F.lit(0))
    return df.select(id_col, score.alias("score")).filter("score > 0")


def line_relevance(df: DataFrame, id_col: str, text_col: str, patterns: list[str]) -> DataFrame:
    """``(id_col, score)``: the number of (line, pattern) matches, in any case."""
    per = lambda x: reduce(lambda a, b: a + b, [F.lower(x).contains(p.lower()).cast("int") for p in patterns])
    score = F.aggregate(F.transform(split_lines(F.col(text_col)), per), F.lit(0), lambda a, x: a + x)
    return df.select(id_col, score.alias("score")).filter("score > 0")


def file_statistics(df: DataFrame, id_col: str, text_col: str, ends: int = 20, max_bytes: int = 4000) -> DataFrame:
    """``(id_col, bytes, n_lines, head, tail)``; head and tail are ``ends`` lines, cut at half of max_bytes characters."""
    ln = split_lines(F.col(text_col))
    cut = lambda a: F.substring(F.array_join(a, "\n"), 1, max_bytes // 2)
    n = F.size("l")
    s = df.select(id_col, F.octet_length(F.coalesce(text_col, F.lit(""))).alias("bytes"), ln.alias("l"))
    return s.select(id_col, "bytes", n.alias("n_lines"), cut(F.slice("l", 1, ends)).alias("head"), cut(F.slice("l", F.greatest(F.lit(1), n - ends + 1), F.lit(ends))).alias("tail"))


def replace_preview(df: DataFrame, id_col: str, text_col: str, find: str, replacement: str, regex: bool = False) -> DataFrame:
    """``(id_col, replacements, new_text)`` of the texts in which something would be replaced."""
    if regex:
        n, new = F.regexp_count(F.col(text_col), F.lit(find)), F.regexp_replace(text_col, find, replacement)
    else:
        n = ((F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit(find), F.lit("")))) / len(find)).cast("int")
        new = F.replace(F.col(text_col), F.lit(find), F.lit(replacement))
    return df.select(id_col, n.alias("replacements"), new.alias("new_text")).filter("replacements > 0")


def bulk_replace(df: DataFrame, id_col: str, text_col: str, edits: DataFrame) -> DataFrame:
    """Literal edits ``(id_col, ord, find, replacement)``, folded in order a text: ``(id_col, edits, new_text)``. Edits without a text give a null text."""
    by = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("ord", "find", "replacement"))).alias("e"))  # a text's own edits
    new = F.aggregate("e", F.col(text_col), lambda t, e: F.replace(t, e["find"], e["replacement"]))
    return by.join(df.select(id_col, text_col), id_col, "left").select(id_col, F.size("e").alias("edits"), new.alias("new_text"))


def first_lines_by_file(hits: DataFrame, file_col: str, order: list[str], lines: int, files: int) -> DataFrame:
    """The first ``lines`` hits of each of the first ``files`` files."""
    own = Window.partitionBy(file_col).orderBy(*order)
    few = hits.select(file_col).distinct().orderBy(file_col).limit(files)
    return hits.join(F.broadcast(few), file_col).withColumn("rn", F.row_number().over(own)).filter(F.col("rn") <= lines)
