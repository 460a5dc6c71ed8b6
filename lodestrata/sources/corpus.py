"""Sources: directories of files, CSV and JSON records, page tables, chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import base_name, extension, strip_markup

SUPPORTED = (".py", ".md", ".txt", ".pdf")
IGNORED_FOLDERS = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")


def should_index(path: Column, extensions: tuple[str, ...] = SUPPORTED, folders: tuple[str, ...] = IGNORED_FOLDERS, files: tuple[str, ...] = ()) -> Column:
    """Supported extension (files without one pass), no ignored folder on the way, no ignored name."""
    ok = extension(path).isin("", *extensions) if extensions else F.lit(True)
    if folders:
        ok = ok & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(f) for f in folders]))
    return ok & ~base_name(path).isin(*files) if files else ok


def scan_folder(spark: SparkSession, root: str, with_content: bool = True, **rules: tuple[str, ...]) -> DataFrame:
    """``(relpath, mtime, size[, content])`` of the files below ``root`` that pass ``should_index``. Without content only the listing is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    rel = F.element_at(F.split(F.regexp_replace("path", r"^file:/*", "/"), plain.replace(".", r"\."), 2), -1)
    cols = [rel.alias("relpath"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size")]
    return df.select(*cols, *([F.col("content")] if with_content else [])).filter(should_index(F.col("relpath"), **rules))


def decoded(content: Column) -> Column:
    """UTF-8 text with invalid bytes dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; types are inferred only where no schema is given. An empty file raises ValueError."""
    r = spark.read.option("header", "true")
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", "true").csv(path)
    if not df.columns:
        raise ValueError(f"no columns in {path}")
    return df


def json_records(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A row for each record of a JSON list (or a single record) in ``column``, beside the other columns; unreadable ones give none."""
    text = F.trim(F.col(column))
    as_list = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.from_json(as_list, f"array<struct<{schema}>>")).alias("_r")).select(*rest, "_r.*")


def read_pages(pages: DataFrame, html_col: str = "html", most: int = 20_000) -> DataFrame:
    """Adds ``title`` and ``text`` (at most ``most`` characters) of HTML pages."""
    title = F.trim(F.regexp_extract(html_col, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.withColumn("title", title).withColumn("text", F.substring(strip_markup(F.col(html_col)), 1, most))
