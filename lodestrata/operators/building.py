"""A chunk index from files: dispatch by extension, keys, vectors by a pluggable embedder, manifest and summary."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import collapse, extension, is_meaningful, split_lines
from lodestrata.operators.chunking import blocks, line_windows, stopping_windows, text_windows

CODE = (".py",)
PAGED = (".pdf",)
Embedder = Callable[[list[str]], np.ndarray]


def chunk_files(files: DataFrame, text_col: str = "text", path_col: str = "relpath") -> DataFrame:
    """The chunks of files, with ``chunk_type, seq, part, line_start, line_end, char_start, char_end, document`` beside the other columns.

    Code is divided into windows of 120 lines (20 shared), paged texts (pages end with a form feed) into blocks and these into windows of 1 100 characters
    (120 shared), any other text into such windows of its text with white space collapsed. Texts without meaning give no chunks; ``part`` is the page of
    paged texts, else null; ``seq`` counts within a part (and block).
    """
    rest = [c for c in files.columns if c != text_col]
    ext = extension(F.col(path_col))
    null = lambda *names: [F.lit(None).cast("int").alias(n) for n in names]
    whole = files.filter(is_meaningful(F.col(text_col)))
    lines = line_windows(whole.filter(ext.isin(*CODE)), text_col)
    piece = F.array_join(F.slice(split_lines(F.col(text_col)), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n")
    code = lines.select(*rest, F.lit("code").alias("chunk_type"), "seq", *null("part"), "line_start", "line_end", *null("char_start", "char_end"), piece.alias("document"))
    paged = whole.filter(ext.isin(*PAGED)).select(*rest, F.posexplode(F.split(text_col, "\f")).alias("_page", "_text"))
    parts = blocks(paged, "_text").select(*rest, (F.col("_page") + 1).alias("part"), "block")
    cut = stopping_windows(parts, F.length("block"), 1100, 120)
    pages = cut.select(*rest, F.lit("pdf_block").alias("chunk_type"), "seq", "part", *null("line_start", "line_end"), F.col("start").alias("char_start"), F.col("end").alias("char_end"), F.substring("block", F.col("start") + 1, F.col("end") - F.col("start")).alias("document"))
    prose = text_windows(whole.filter(~ext.isin(*CODE, *PAGED)).withColumn(text_col, collapse(F.col(text_col))), text_col)
    text = prose.select(*rest, F.lit("text").alias("chunk_type"), "seq", *null("part", "line_start", "line_end"), "char_start", "char_end", F.col("piece").alias("document"))
    return code.unionByName(pages).unionByName(text)


def file_key(root: Column, path: Column, mtime: Column, seq: Column) -> Column:
    """root-sha1[:8]::path::mtime::seq."""
    return F.concat_ws("::", F.concat(root, F.lit("-"), F.substring(F.sha1(root), 1, 8)), path, mtime.cast("string"), seq.cast("string"))


def hashed_words(dim: int = 64) -> Embedder:
    """An embedder without a model: words hashed to signed places, norms divided out; texts without words are zeros."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h & (1 << 31) else -1
            n = np.linalg.norm(row)
            if n:
                row /= n
        return out

    return embed


def embedded(df: DataFrame, text_col: str, embedder: Embedder, dim: int, batch: int = 16, vector_col: str = "embeddings") -> DataFrame:
    """Adds the vectors of the texts (null ones as empty), ``batch`` at a time; another number or width of vectors than asked for raises ValueError."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{vector_col}` array<float>"
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            parts = []
            for k in range(0, len(texts), batch):
                x = np.asarray(embedder(texts[k : k + batch]), dtype=np.float32)
                if x.shape != (len(texts[k : k + batch]), dim):
                    raise ValueError(f"the embedder gave {x.shape}, not {dim} numbers for each of {len(texts[k : k + batch])} texts")
                parts.append(x)
            flat = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, dtype=np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], names=[*b.schema.names, vector_col])

    return df.mapInArrow(run, schema)


def manifest_of(files: DataFrame, text_col: str = "text") -> DataFrame:
    """``(relpath, mtime, size)`` of files with their texts."""
    return files.select("relpath", "mtime", F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("size"))
