"""Compositions: the data part of answering from a corpus, as one lazy plan each."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import snippet
from lodestrata.operators import retrieval, shaping


def evidence(chunks: DataFrame, query: DataFrame, k: int = 8, where: dict[str, Any] | None = None, min_score: float | None = None, question: str = "", vector_col: str = "embeddings", most_chars: int = 700) -> DataFrame:
    """``(rank, id, label, bucket, score, text)``: retrieved chunks with label, bucket and snippet, ready to be shown."""
    files, symbols = retrieval.file_candidates(question), retrieval.symbol_candidates(question)
    hits = retrieval.retrieve(chunks, query, vector_col, "id", k, where=where, min_score=min_score, files=files, symbols=symbols)
    full = F.broadcast(hits.select("id", "rank", "score")).join(chunks, "id")  # at most k rows
    bucket = shaping.inferred_bucket(F.col("chunk_type"), F.col("name"), F.col("document"))
    return full.select("rank", "id", shaping.evidence_label("file_name").alias("label"), bucket.alias("bucket"), "score", snippet(F.col("document"), most_chars).alias("text"))


def with_neighbours(seeds: DataFrame, chunks: DataFrame, cap: int = 4) -> DataFrame:
    """The seeds and the chunks on their pages and the pages around, each id once, seeds first."""
    near = shaping.page_neighbours(seeds.select("id", "file_path", "page_number"), chunks.select("id", "file_path", "page_number"), "file_path", cap=cap)
    both = seeds.select("id", F.lit(0).alias("step")).unionByName(near.select("id", F.lit(1).alias("step")))
    return both.groupBy("id").agg(F.min("step").alias("step"))


def best_per_bucket(hits: DataFrame, n: int = 3) -> DataFrame:
    """The n best hits of each bucket (columns bucket, score, id)."""
    w = Window.partitionBy("bucket").orderBy(F.desc("score"), "id")
    return hits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
