"""Grouping of hits: kinds, scope, neighbours, style, packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import split_lines, strip
from lodestrata.operators.ordering import beside

# Chunk types by bucket.
BUCKETS = {
    "topics": ("chapter", "section", "subsection", "paragraph", "heading", "title", "intro", "toc"),
    "questions": ("questions", "question", "qa", "exercise", "exercises", "problems", "practice"),
    "answers": ("answer", "answers", "solution", "solutions", "worked_solution"),
    "tables": ("table", "tables", "tabular", "grid"),
    "pages": ("pdf_page", "page"),
}


def inferred_bucket(chunk_type: Column, name: Column, document: Column) -> Column:
    """The bucket of a chunk by its type, or where that is missing by its name or first line."""
    t = F.lower(strip(F.coalesce(chunk_type, F.lit(""))))
    label = strip(F.coalesce(name, F.lit("")))
    header = F.when(label != "", label).otherwise(F.coalesce(F.try_element_at(split_lines(document), F.lit(1)), F.lit("")))
    h = F.lower(strip(header))
    guess = (
        F.when(h.rlike(r"^(questions|exercises?|practice|problems)\b"), "questions")
        .when(h.rlike(r"^(answers?|solutions?)\b"), "answers")
        .when(h.rlike(r"^table\s*\d*") | header.contains("│") | header.contains("┼"), "tables")
        .when(header.rlike(r"^(chapter\s*\d+|[0-9]+\s+[A-Z][^\n]{1,80})$"), "topics")
        .when(header.rlike(r"^\d+\.\d+(\.\d+)?\s+"), "topics")
        .when(h.contains("page"), "pages")
        .otherwise("other")
    )
    known = F.lit(None).cast("string")
    for bucket, types in BUCKETS.items():
        known = F.when(t.isin(*types), bucket).otherwise(known)
    return F.when((t == "") | (t == "unknown"), guess).otherwise(F.coalesce(known, F.lit("other")))


def in_scope(book: Column, chapter: Column, want_book: str | None, want_chapter: str | None, scope: str) -> Column:
    """Without a hint everything; ``book`` compares the book, ``chapter`` both (nulls equal); any other scope nothing."""
    if not want_book and not want_chapter:
        return F.lit(True)
    if scope == "book":
        return book.eqNullSafe(F.lit(want_book))
    if scope == "chapter":
        return book.eqNullSafe(F.lit(want_book)) & chapter.eqNullSafe(F.lit(want_chapter))
    return F.lit(False)


def page_neighbours(seeds: DataFrame, pool: DataFrame, file_col: str, before: int = 1, after: int = 1, cap: int = 4) -> DataFrame:
    """``(seed_id, id, offset)``: rows of the pool on the seed's page or near it, nearest first, ``cap`` a seed. The band is an equi-join on exploded offsets."""
    want = seeds.filter("page_number IS NOT NULL").select(F.col("id").alias("seed_id"), file_col, "page_number", F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    want = want.select("seed_id", file_col, (F.col("page_number") + F.col("offset")).alias("page_number"), "offset")
    got = want.join(pool.select("id", file_col, "page_number"), [file_col, "page_number"]).filter("id <> seed_id")
    w = Window.partitionBy("seed_id").orderBy(F.abs("offset"), "offset", "id")
    return got.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).select("seed_id", "id", "offset")


def siblings(chunks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``prev_chunk`` and ``next_chunk``: the ids before and after in order within ``by``. A group of very many chunks is spread over tasks."""
    return beside(chunks, by, order, "id", "prev_chunk", "next_chunk")


VERBS = "explain|derive|prove|calculate|show|define|list|choose|find|evaluate|simplify"


def style_profile(texts: DataFrame, by: str, text_col: str, id_col: str) -> DataFrame:
    """``(by, avg_len, verbs, math_style)``: words a text, task verbs in order (ten at most), whether formulas occur; an id counts once."""
    words = F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\t-\r ]+"), lambda w: w != ""))
    verbs = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(rf"(?i)\b({VERBS})\b"), 1), F.lower)
    math = F.col(text_col).rlike(r"\\frac|\\int|\\sum|\$|²|³")
    s = texts.select(id_col, by, words.alias("w"), F.array_distinct(verbs).alias("v"), math.alias("m")).dropDuplicates([id_col])
    a = s.groupBy(by).agg(F.floor(F.avg("w")).cast("int").alias("avg_len"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("v")))).alias("verbs"), F.max(F.coalesce(F.col("m"), F.lit(False))).alias("m"))  # sets of eleven verbs at most
    return a.select(by, "avg_len", F.array_join(F.slice("verbs", 1, 10), ",").alias("verbs"), F.when(F.col("m"), "latex_like").otherwise("plain").alias("math_style"))


def evidence_label(name: str) -> Column:
    """``[name p.N, type, La-Lb]`` with the parts that are there."""
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit("p."), F.col("page_number").cast("string")))
    lines = F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), F.concat(F.lit("L"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string")))
    return F.concat(F.lit("["), F.concat_ws(", ", F.col(name), page, F.col("chunk_type"), lines), F.lit("]"))
