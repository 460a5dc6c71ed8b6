"""The chunk index: manifests and their difference, applying a delta, keys, statistics, versioned upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.ordering import running_total


def latest_manifest(manifest: DataFrame) -> DataFrame:
    """``(relpath, mtime, size)``, one row a file: the newest version (a known size before a null one)."""
    rows = manifest.filter(F.col("relpath").isNotNull())
    best = F.max(F.struct(F.coalesce("mtime", F.lit(-1)).alias("m"), F.col("size"))).alias("b")
    return rows.groupBy("relpath").agg(best).select("relpath", F.nullif(F.col("b.m"), F.lit(-1)).alias("mtime"), F.col("b.size").alias("size"))


def manifest_difference(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(relpath, status)`` of the files that were added, deleted or changed (mtime or size)."""
    p = previous.select("relpath", F.col("mtime").alias("pm"), F.col("size").alias("ps"), F.lit(True).alias("was"))
    c = current.select("relpath", F.col("mtime").alias("cm"), F.col("size").alias("cs"), F.lit(True).alias("now"))
    same = F.col("pm").eqNullSafe(F.col("cm")) & F.col("ps").eqNullSafe(F.col("cs"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(~same, "changed")
    return p.join(c, "relpath", "full_outer").select("relpath", status.alias("status")).filter("status IS NOT NULL")


def apply_delta(index: DataFrame, difference: DataFrame, fresh: DataFrame, path_col: str = "relpath") -> DataFrame:
    """The index without the chunks of deleted and changed files and with the fresh chunks of added and changed ones."""
    gone = difference.filter("status IN ('deleted', 'changed')").select(F.col("relpath").alias(path_col))
    new = difference.filter("status IN ('added', 'changed')").select(F.col("relpath").alias(path_col))
    return index.join(gone, path_col, "left_anti").unionByName(fresh.join(new, path_col, "left_semi"))


def chunk_keys(chunks: DataFrame, root: Column, order: list[Column], path_col: str = "relpath") -> DataFrame:
    """Adds ``seq`` (1.. within a file, in order) and ``key`` root-sha1[:8]::path::mtime::seq. A file of very many chunks is spread over tasks."""
    out = running_total(chunks, [path_col, "mtime"], order, F.lit(1), "seq")
    return out.withColumn("key", F.concat_ws("::", F.concat(root, F.lit("-"), F.substring(F.sha1(root), 1, 8)), F.col(path_col), F.col("mtime").cast("string"), F.col("seq").cast("string")))


def upsert(index: DataFrame, fresh: DataFrame, id_col: str = "id") -> DataFrame:
    """The index with the rows of ``fresh`` in place of those with the same id."""
    return index.join(fresh.select(id_col), id_col, "left_anti").unionByName(fresh)


def write_version(df: DataFrame, folder: str, version: int) -> str:
    """Writes a new version beside the old ones (a folder that is being read is never overwritten)."""
    path = f"{folder}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/v={version}")
