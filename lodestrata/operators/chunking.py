"""Windows, blocks and pages of texts as generators over sequences: no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import split_lines, strip


def _starts(n: Column, step: int, last: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def text_windows(df: DataFrame, text_col: str, size: int = 1100, overlap: int = 120) -> DataFrame:
    """Adds ``seq, char_start, char_end, piece``: a window begins at every step up to the end of the text (so the last may lie within the one before). Zero means the default."""
    size, overlap = size or 1100, overlap or 120
    step = max(1, size - overlap)
    n = F.length(F.coalesce(text_col, F.lit("")))
    out = df.withColumn("_n", n).select("*", F.posexplode(_starts(F.col("_n"), step, F.col("_n") - 1)).alias("seq", "char_start"))
    return out.withColumn("seq", F.col("seq") + 1).withColumn("char_end", F.least(F.col("_n"), F.col("char_start") + size)).withColumn("piece", F.substring(F.col(text_col), F.col("char_start") + 1, F.lit(size))).drop("_n")


def stopping_windows(df: DataFrame, length: Column, size: int, overlap: int) -> DataFrame:
    """Adds ``seq, start, end`` (0-based, end exclusive): windows that stop as soon as one reaches the end."""
    if overlap >= size:
        raise ValueError("overlap must be below the window size")
    step = size - overlap
    out = df.withColumn("_n", length)
    last = F.greatest(F.lit(0), F.col("_n") - size) + step - 1
    out = out.select("*", F.posexplode(_starts(F.col("_n"), step, last)).alias("seq", "start"))
    return out.withColumn("seq", F.col("seq") + 1).withColumn("end", F.least(F.col("_n"), F.col("start") + size)).drop("_n")


def line_windows(df: DataFrame, text_col: str, size: int = 120, overlap: int = 20) -> DataFrame:
    """Adds ``seq, line_start, line_end`` (1-based, inclusive) over the lines of a text."""
    out = stopping_windows(df, F.size(split_lines(F.col(text_col))), size or 120, overlap or 20)
    return out.withColumn("line_start", F.col("start") + 1).withColumn("line_end", F.col("end")).drop("start", "end")


def blocks(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``block_no, block``: the text divided at blank lines, each part stripped, empty ones dropped."""
    parts = F.filter(F.transform(F.split(strip(F.coalesce(text_col, F.lit(""))), r"\n[\t-\r ]*\n"), strip), lambda x: x != "")
    out = df.select("*", F.posexplode(parts).alias("block_no", "block"))
    return out.withColumn("block_no", F.col("block_no") + 1)


def block_kind(block: Column) -> Column:
    """questions, answers, table, heading or para, by the first rule that holds."""
    lines = split_lines(block)
    header = F.lower(strip(F.element_at(lines, 1)))
    piped = F.size(F.filter(lines, lambda x: (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2) | x.contains("\t")))
    return (
        F.when(header.rlike(r"^(questions?|exercises?|practice|problems?)\b"), "questions")
        .when(header.rlike(r"^(answers?|solutions?)\b"), "answers")
        .when(piped >= 2, "table")
        .when((F.size(lines) == 1) & F.length(strip(block)).between(2, 80), "heading")
        .otherwise("para")
    )


def repeated_edges(pages: DataFrame, doc_col: str, page_col: str, text_col: str) -> DataFrame:
    """Adds ``cleaned``: pages without their physical first and last line where that line is the first or last non-empty line of enough pages.

    Enough is three or six tenths of the document's pages, whichever is more. Counts are combined before the shuffle; the
    repeated lines, a few a document, are joined back.
    """
    lines = split_lines(F.col(text_col))
    full = F.filter(F.transform(lines, strip), lambda x: x != "")
    p = pages.withColumn("_lines", lines).withColumn("_first", F.try_element_at(full, F.lit(1))).withColumn("_last", F.try_element_at(full, F.lit(-1)))
    per_doc = p.groupBy(doc_col).agg(F.count("*").alias("_pages"))

    def often(c: str) -> DataFrame:
        n = p.filter(F.col(c).isNotNull()).groupBy(doc_col, c).agg(F.count("*").alias("_n")).join(per_doc, doc_col)
        return n.filter(F.col("_n") >= F.greatest(F.lit(3), F.floor(F.col("_pages") * 0.6))).select(doc_col, F.col(c).alias("_line"), F.lit(True).alias(f"_rep{c}"))

    phys_first, phys_last = strip(F.try_element_at("_lines", F.lit(1))), strip(F.try_element_at("_lines", F.lit(-1)))
    p = p.withColumn("_pf", phys_first).withColumn("_pl", phys_last)
    f, e = often("_first"), often("_last")
    p = p.join(f.withColumnRenamed("_line", "_pf"), [doc_col, "_pf"], "left").join(e.withColumnRenamed("_line", "_pl"), [doc_col, "_pl"], "left")
    drop_f, drop_l = F.coalesce("_rep_first", F.lit(False)).cast("int"), F.coalesce("_rep_last", F.lit(False)).cast("int")
    keep = F.greatest(F.lit(0), F.size("_lines") - drop_f - drop_l)
    out = p.withColumn("cleaned", F.array_join(F.slice("_lines", drop_f + 1, keep), "\n"))
    return out.drop("_lines", "_first", "_last", "_pf", "_pl", "_rep_first", "_rep_last")


def merged_spans(spans: DataFrame, key: str, start: str = "line_start", end: str = "line_end", gap: int = 1) -> DataFrame:
    """``(key, line_start, line_end, parts)``: spans that overlap or are at most ``gap`` apart as one."""
    s = spans.select(key, F.col(start).alias("line_start"), F.col(end).alias("line_end")).filter("line_start IS NOT NULL AND line_end IS NOT NULL")
    w = Window.partitionBy(key).orderBy("line_start", "line_end")
    before = F.max("line_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("new", F.coalesce((F.col("line_start") > before + gap).cast("int"), F.lit(1)))
    s = s.withColumn("grp", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "grp").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.count("*").alias("parts")).drop("grp")


def gaps(spans: DataFrame, key: str) -> DataFrame:
    """``(key, line_start, line_end)``: the lines between merged spans."""
    w = Window.partitionBy(key).orderBy("line_start")
    g = merged_spans(spans, key).withColumn("before", F.lag("line_end").over(w))
    return g.filter(F.col("line_start") > F.col("before") + 1).select(key, (F.col("before") + 1).alias("gap_start"), (F.col("line_start") - 1).alias("gap_end"))
