"""Vector retrieval, boosts, merging, routing: DataFrame in, DataFrame out, every order total."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.vector import cosine_distance, l2_squared, score_from_distance, usable

# What the routes and buckets are told by.
CODE_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".cpp", ".c")
DOCUMENT_EXTENSIONS = (".pdf", ".md", ".txt", ".docx", ".rst")
TABLE_EXTENSIONS = (".csv", ".xlsx", ".tsv")
SYMBOL_STOP_WORDS = ("the", "and", "for", "with", "into", "using", "please", "explain", "call", "graph", "file")
FILE_NAME_PATTERN = r"(?i)([\w-]+(?:\.[\w-]+)*\.(?:pdf|docx|txt|md|csv|xlsx|pptx|py|js|jsx|ts|tsx))\b"


def compile_where(where: dict[str, Any] | None) -> Column:
    """A metadata filter as a Column: ``{k: v}``, ``$eq $ne $gt $gte $lt $lte $in $nin``, ``$and``, ``$or``; SQL's null rules."""
    if not where:
        return F.lit(True)
    ops = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
    }
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            sides = [compile_where(w) for w in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), sides))
        elif isinstance(value, dict):
            parts += [ops[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts)


def distances(rows: DataFrame, query: DataFrame, vector_col: str, dim: int, metric: str = "cosine") -> DataFrame:
    """The usable rows with ``distance`` to the one query vector (column ``qv`` of a one-row frame, sent to every task)."""
    f = {"cosine": cosine_distance, "l2sq": l2_squared}[metric]
    q = F.broadcast(query.select("qv").limit(1))
    return rows.filter(usable(F.col(vector_col), dim)).join(q, F.lit(True)).withColumn("distance", f(F.col(vector_col), F.col("qv"))).drop("qv", vector_col)


def nearest(rows: DataFrame, query: DataFrame, vector_col: str, id_col: str, k: int, dim: int = 64, metric: str = "cosine", where: dict[str, Any] | None = None) -> DataFrame:
    """The k nearest rows by distance, then id; rows with the same id count once.

    Every task sends its k best ids only; other columns are fetched for the k that are left.
    """
    some = rows.filter(compile_where(where))
    top = best(distances(some.select(id_col, vector_col), query, vector_col, dim, metric), id_col, k)
    rest = [c for c in rows.columns if c not in (id_col, vector_col)]
    if not rest:
        return top.orderBy("distance", id_col)
    return some.select(id_col, *rest).join(F.broadcast(top), id_col).dropDuplicates([id_col]).orderBy("distance", id_col)  # k rows are broadcast


def best(rows: DataFrame, id_col: str, k: int, by: str | None = None) -> DataFrame:
    """The k rows ``([by,] id_col, distance)`` of the least (distance, id), of each value of ``by`` if given; rows with the same id count once.

    Each task keeps k a group while it reads, whatever copies there are, so what is shuffled doesn't grow with the table.
    """
    keys = [by] if by else []
    slim = rows.select(*keys, id_col, F.col("distance").cast("double").alias("distance"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[Any, dict[Any, float]] = {}
        shape = None
        for b in batches:
            shape = b.schema
            d = b.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            groups = np.array(b.column(0).to_pylist(), dtype=object) if keys else np.zeros(len(d), dtype=object)
            for g in dict.fromkeys(groups.tolist()):
                own = kept.setdefault(g, {})
                at = np.flatnonzero((groups == g) & (d <= (max(own.values()) if len(own) >= k else np.inf)))
                for i, x in zip(b.column(len(keys)).take(pa.array(at)).to_pylist(), d[at].tolist(), strict=True):
                    own[i] = x
                kept[g] = dict(sorted(own.items(), key=lambda p: (p[1], p[0]))[:k])
        rows_ = [(*((g,) if keys else ()), i, x) for g, own in kept.items() for i, x in own.items()]
        if rows_:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows_, strict=True), shape, strict=True)], schema=shape)

    tops = slim.mapInArrow(run, schema).dropDuplicates([*keys, id_col])
    if not by:
        return tops.orderBy("distance", id_col).limit(k)
    w = Window.partitionBy(by).orderBy("distance", id_col)
    return tops.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def nearest_of_each(rows: DataFrame, queries: DataFrame, vector_col: str, id_col: str, k: int, dim: int = 64) -> DataFrame:
    """``(query, id_col, distance)``: the k nearest rows of each query ``(query, qv)``, a bounded list that every task holds; one scan serves all."""
    q = F.broadcast(queries.agg(F.collect_list(F.struct("query", "qv")).alias("qs")))
    some = rows.filter(usable(F.col(vector_col), dim)).select(id_col, vector_col).join(q, F.lit(True))
    each = some.select(id_col, vector_col, F.explode("qs").alias("q")).select(F.col("q.query").alias("query"), id_col, cosine_distance(F.col(vector_col), F.col("q.qv")).alias("distance"))
    return best(each, id_col, k, "query")


def symbol_candidates(text: str) -> list[str]:
    """Probable function and class names of a query text, in order."""
    import re

    words = re.findall(r"\b[A-Za-z_]\w{2,}\b", text or "", flags=re.A)
    return list(dict.fromkeys(w for w in words if w.lower() not in SYMBOL_STOP_WORDS and ("_" in w or w[0].isupper())))


def file_candidates(text: str) -> list[str]:
    import re

    return list(dict.fromkeys(re.findall(FILE_NAME_PATTERN, text or "")))


def mentions_file(names: list[str]) -> Column:
    """file_path contains, or relpath ends with, one of the names (lower case)."""
    tests = [F.lower(F.coalesce("file_path", F.lit(""))).contains(n.lower()) | F.lower(F.coalesce("relpath", F.lit(""))).endswith(n.lower()) for n in names]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def mentions_symbol(symbols: list[str]) -> Column:
    """Named in name or symbols, or defined or called in the document."""
    name, syms, doc = (F.lower(F.coalesce(c, F.lit(""))) for c in (F.col("name"), F.array_join("symbols", " "), F.col("document")))
    tests = []
    for s in (x.lower() for x in symbols):
        tests.append(name.contains(s) | syms.contains(s) | doc.contains(f"def {s}") | doc.contains(f"class {s}") | doc.contains(f"{s}("))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def retrieve(
    rows: DataFrame, query: DataFrame, vector_col: str, id_col: str, k: int = 8, dim: int = 64, where: dict[str, Any] | None = None,
    min_score: float | None = None, files: list[str] | None = None, symbols: list[str] | None = None,
) -> DataFrame:
    """Top-k with file-name (x 1.2) and symbol (x 1.3) boosts, threshold and final order.

    One distance computation serves the three searches: ranks over the rows that pass ``where`` give the base
    list, ranks over all rows the wider lists from which boosts are taken (so boosted rows may violate ``where``, as
    specified). Ranks are taken of top-k's, so no window sees the whole table.
    """
    extra = [c for c in ("file_path", "relpath", "name", "symbols", "document") if c in rows.columns]
    far_f, far_s = max(2 * k, 16), max(3 * k, 48)
    passes = F.coalesce(compile_where(where), F.lit(False)).cast("int").alias("passes")
    scored = distances(rows.select(id_col, vector_col, passes), query, vector_col, dim)
    # group 1: rows that pass; group 0: all rows, for the boosts
    both = scored.select(id_col, "distance", F.explode(F.when(F.col("passes") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("group"))
    tops = best(both, id_col, max(k, far_f, far_s), "group").withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("distance", id_col)))
    parts = [tops.filter((F.col("group") == 1) & (F.col("place") <= k)).select(id_col, "distance", F.lit(1.0).alias("factor"))]
    # texts and names are looked at for the few rows at the top only
    named = rows.select(id_col, *extra).join(F.broadcast(tops.filter("group = 0")), id_col)
    if files:
        parts.append(named.filter((F.col("place") <= far_f) & mentions_file(files)).select(id_col, "distance", F.lit(1.2).alias("factor")))
    if symbols:
        parts.append(named.filter((F.col("place") <= far_s) & mentions_symbol(symbols)).select(id_col, "distance", F.lit(1.3).alias("factor")))
    merged = reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.min("distance").alias("distance"), F.max("factor").alias("factor"))
    out = merged.select(id_col, "distance", score_from_distance(F.col("distance")).alias("base_score"), (score_from_distance(F.col("distance")) * F.col("factor")).alias("score"), (F.col("factor") > 1).alias("boosted"))
    if min_score is not None:
        out = out.filter(F.col("score") >= min_score)
    # sorted by score only where a boost fired, else by distance: at most k + 16 + 48 rows are left here
    fired = F.max(F.col("boosted").cast("int")).over(Window.partitionBy()) > 0
    order = Window.orderBy(F.when(F.col("fired"), -F.col("score")).otherwise(F.col("distance")), F.col("distance"), F.col(id_col))
    return out.withColumn("fired", fired).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("fired")


def relaxed(hits: DataFrame, by: str, id_col: str, k: int, threshold: float, least: int = 10) -> DataFrame:
    """``(by, id_col, score, rank, relaxed)``: the k best hits of each ``by`` from ``threshold`` on; where they are fewer than ``least``, max(2k, 16) from 0.7 of it, if that gives more."""
    wide_k, low = max(2 * k, 16), round(threshold * 0.7, 9)
    top = hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), id_col))).filter(F.col("rank") <= wide_k)
    strict, loose = (F.col("score") >= threshold) & (F.col("rank") <= k), F.col("score") >= low
    n = Window.partitionBy(by)  # wide_k rows at most
    counted = top.withColumn("_s", F.count_if(strict).over(n)).withColumn("_l", F.count_if(loose).over(n))
    out = counted.withColumn("relaxed", (F.col("_s") < least) & (F.col("_l") > F.col("_s")))
    return out.filter(F.when(F.col("relaxed"), loose).otherwise(strict)).drop("_s", "_l")


def merge_best(primary: DataFrame, extra: DataFrame, id_col: str, boost: float = 1.15) -> DataFrame:
    """Both lists by id with the better score, that of ``extra`` multiplied by ``boost``; rows of ``extra`` without id are left out."""
    both = primary.select(id_col, "score").unionByName(extra.filter(F.col(id_col).isNotNull()).select(id_col, (F.col("score") * boost).alias("score")))
    return both.groupBy(id_col).agg(F.max("score").alias("score"))


def bucket_scores(hits: DataFrame, by: list[str]) -> DataFrame:
    """Sums of similarity by kind: columns code, document, tabular. Needs score, distance, file_path, relpath, profile, chunk_type."""
    sim = F.when(F.coalesce("score", F.lit(0.0)) != 0, F.col("score")).otherwise(score_from_distance(F.col("distance")))
    path = F.lower(F.coalesce(F.when(F.col("file_path") != "", F.col("file_path")), F.col("relpath"), F.lit("")))
    ext = F.when(path.contains("."), F.concat(F.lit("."), F.element_at(F.split(path, r"\."), -1))).otherwise("")
    prof = F.lower(F.coalesce("profile", F.lit("")))
    code = (prof == "code") | ext.isin(*CODE_EXTENSIONS)
    doc = (prof == "document") | ext.isin(*DOCUMENT_EXTENSIONS) | F.coalesce(F.col("chunk_type").startswith("pdf"), F.lit(False))
    kind = F.when(code, "code").when(doc, "document").when(ext.isin(*TABLE_EXTENSIONS), "tabular").otherwise("rest")
    s = hits.select(*by, sim.alias("sim"), kind.alias("kind"))
    part = lambda k, f=1.0: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("sim") * f)), F.lit(0.0))
    return s.groupBy(*by).agg(part("code").alias("code"), (part("document") + part("rest", 0.5)).alias("document"), part("tabular").alias("tabular"))


def decide_route(scores: DataFrame) -> DataFrame:
    """Adds ``route``: tabular, code, hybrid or document."""
    c, d, t = F.col("code"), F.col("document"), F.col("tabular")
    route = F.when((t > F.greatest(c, d) * 1.2) & (t > 0.35), "tabular").when((c > d * 1.15) & (c > 0.25), "code").when((c > 0.3) & (d > 0.3), "hybrid").otherwise("document")
    return scores.withColumn("route", route)


def first_seen(lists: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """One row an id: the first in ``order``."""
    first = F.min(F.struct(*order, *[c for c in lists.columns if c not in order and c != id_col])).alias("first")
    return lists.groupBy(id_col).agg(first).select(id_col, "first.*")
