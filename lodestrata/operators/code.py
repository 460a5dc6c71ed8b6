"""Code analysis: structure by the language's own parser, call edges by lines, related files, simple issues."""

from __future__ import annotations

import ast
import builtins
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import split_lines
from lodestrata.operators.textsearch import lines_of

MAX_PACKAGES = 2000
MAX_PATH = 120
# Words that name no folder.
FOLDER_STOP = (
    "the", "this", "that", "these", "those", "folder", "dir", "directory", "module", "modules", "pkg", "package", "project", "repo", "code", "inside", "within", "under", "in",
)

# Callees that say nothing about a program, beside the language's own names.
NOISY_METHODS = (
    "get", "values", "items", "keys", "extend", "append", "sort", "split", "strip", "isalpha", "lower", "upper", "format",
    "info", "warning", "debug", "error", "exception", "print", "group", "groups",
)
NOISE = tuple(sorted({*NOISY_METHODS, *dir(builtins)}))


def line_calls(code: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, line_no, func, callee)``: names followed by a bracket, in lines below a ``def`` line, without noise: noisy names count only where the code defines them.

    Works on any window of code, also one that no parser accepts. Texts aren't shuffled, only their def and call lines are, and rows with the same id count once.
    """
    name = lambda x: F.regexp_extract(x, r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", 1)
    numbered = F.transform(split_lines(F.col(text_col)), lambda x, i: F.struct((i + 1).alias("line_no"), name(x).alias("own"), F.regexp_extract_all(x, F.lit(r"([A-Za-z_]\w*)\("), 1).alias("callees")))
    told = code.select(id_col, F.filter(numbered, lambda x: (x["own"] != "") | (F.size(x["callees"]) > 0)).alias("lines")).filter(F.size("lines") > 0).dropDuplicates([id_col])
    w = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    ln = told.select(id_col, F.explode("lines").alias("x")).select(id_col, "x.*").withColumn("func", F.last(F.nullif("own", F.lit("")), True).over(w))
    ln = ln.filter("own = '' AND func IS NOT NULL").select(id_col, "line_no", "func", F.explode("callees").alias("callee"))
    own = told.select(F.explode("lines.own").alias("callee")).filter(F.col("callee").isin(*NOISE)).distinct().withColumn("defined", F.lit(True))  # at most as many as NOISE
    ln = ln.join(F.broadcast(own), "callee", "left").filter(~F.col("callee").isin(*NOISE) | F.col("defined"))
    return ln.select(id_col, "line_no", "func", "callee")


def structure(code: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, kind, name, line, parent)``: functions, classes, imports of the texts that parse; others give one row of kind ``error``."""
    kind = code.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    rows.append((i, "error", "", 0, ""))
                    continue
                stack = [(tree, "")]
                while stack:
                    node, parent = stack.pop()
                    for child in ast.iter_child_nodes(node):
                        inner = parent
                        if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                            rows.append((i, "class" if isinstance(child, ast.ClassDef) else "function", child.name, child.lineno, parent))
                            inner = child.name
                        elif isinstance(child, ast.Import):
                            rows += [(i, "import", a.name.split(".")[0], child.lineno, parent) for a in child.names]
                        elif isinstance(child, ast.ImportFrom):
                            rows.append((i, "import", (child.module or "").split(".")[0], child.lineno, parent))
                        stack.append((child, inner))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], type=b.schema.field(0).type), pa.array(cols[1], type=pa.string()), pa.array(cols[2], type=pa.string()), pa.array(cols[3], type=pa.int32()), pa.array(cols[4], type=pa.string())], names=[id_col, "kind", "name", "line", "parent"])

    return code.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, kind string, name string, line int, parent string")


def issues(code: DataFrame, id_col: str, text_col: str, only: bool = True) -> DataFrame:
    """``(id_col, naive_open, broad_except)`` of the texts with either, or of all."""
    t = F.col(text_col)
    flags = code.select(id_col, (t.contains("open(") & ~t.contains("with open(")).alias("naive_open"), (t.contains("except:") | t.contains("except Exception:")).alias("broad_except"))
    return flags.filter("naive_open OR broad_except") if only else flags


def imports_of(code: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, package)``: top packages of import lines, distinct."""
    ln = lines_of(code.filter(F.col(text_col).contains("import ")), id_col, text_col)
    name = F.regexp_extract("line", r"^(?:import|from)\s+([A-Za-z_]\w*)", 1)
    return ln.select(id_col, name.alias("package")).filter("package <> ''").distinct()


def related_files(texts: DataFrame, file_col: str, text_col: str, ext_col: str) -> DataFrame:
    """``(file_col, related)``: of every .py file the number of other files that name one of the packages it imports, in any case.

    Files that import the same packages are one set; sets, not files, meet the files that name their packages. The packages, at most
    ``MAX_PACKAGES`` (more raise an error), are tested in one pass over the texts.
    """
    own = imports_of(texts.filter(F.col(ext_col) == ".py"), file_col, text_col).withColumn("package", F.lower("package")).distinct()
    rows = own.select("package").distinct().limit(MAX_PACKAGES + 1).collect()
    if len(rows) > MAX_PACKAGES:
        raise ValueError(f"more than {MAX_PACKAGES} packages")
    packages = F.array(*[F.lit(r.package) for r in sorted(rows)]) if rows else F.array().cast("array<string>")
    low = F.lower(F.col(text_col))
    naming = texts.select(file_col, F.explode(F.filter(packages, lambda p: low.contains(p))).alias("package")).distinct()
    of_file = own.groupBy(file_col).agg(F.array_join(F.sort_array(F.collect_set("package")), " ").alias("imports"))
    sets = of_file.select("imports").distinct().select("imports", F.explode(F.split("imports", " ")).alias("package"))
    named = sets.join(naming.withColumnRenamed(file_col, "_other"), "package").select("imports", "_other").distinct()
    sizes = named.groupBy("imports").agg(F.count("*").alias("n"))
    itself = of_file.join(named, (of_file["imports"] == named["imports"]) & (F.col(file_col) == F.col("_other")), "left_semi").select(file_col, F.lit(1).alias("me"))
    return of_file.join(sizes, "imports").join(itself, file_col, "left").select(file_col, (F.col("n") - F.coalesce("me", F.lit(0))).alias("related"))


def guessed_folders(prompts: DataFrame, paths: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """``(id_col, dir, score)``: the folder that a prompt's words speak of: 2 for each word that is a part of its path, 1 for each that the path contains; of equals the first by name.

    Words after in, under, inside or within count alone where there are such. Folders give the texts that they contain as keys, so words and folders meet in
    an equi-join of distinct words; a folder path has at most ``MAX_PATH`` characters that count.
    """
    low = F.lower(F.coalesce(text_col, F.lit("")))
    tail = F.regexp_extract(low, r"\b(?:in|under|inside|within)\b\s+(.*)", 1)
    raw = F.regexp_extract_all(F.when(F.regexp_like(low, F.lit(r"\b(?:in|under|inside|within)\b\s+(.*)")), tail).otherwise(low), F.lit(r"([a-z0-9_\-/.]+)"), 1)
    words = prompts.select(id_col, F.explode(F.transform(F.filter(raw, lambda w: ~w.isin(*FOLDER_STOP)), lambda w: F.regexp_replace(w, r"^[/.]+|[/.]+$", ""))).alias("word")).filter("word <> ''")
    words = words.groupBy(id_col, "word").agg(F.count("*").alias("times"))
    parts = F.split(path_col, "/")
    dirs = paths.filter(F.col(path_col).isNotNull()).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("dir"))
    dirs = dirs.filter("dir <> ''").distinct().withColumn("_low", F.substring(F.lower("dir"), 1, MAX_PATH))
    n = F.length("_low")
    inside = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(F.lit(1), n - a + 1), lambda m: F.substring(F.col("_low"), a, m))))
    keys = dirs.select("dir", "_low", F.explode(F.array_distinct(inside)).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    points = keys.select("word", "dir", F.when(F.array_contains(F.split("_low", "/"), F.col("word")), 2).otherwise(1).alias("points"))
    scores = words.join(points, "word").groupBy(id_col, "dir").agg(F.sum(F.col("points") * F.col("times")).alias("score"))
    return scores.groupBy(id_col).agg(F.min_by(F.struct("dir", "score"), F.struct(-F.col("score"), F.col("dir"))).alias("b")).select(id_col, "b.dir", "b.score")


def line_spans(code: DataFrame, file_col: str, text_col: str, start_col: str) -> DataFrame:
    """``(file_col, kind, name, line_start, line_end)``: functions and classes at the outer level, told by indentation.

    The windows of a file are put together by their line numbers (lines that two windows share count once); a span ends before the next line
    without indentation. Works on code that no parser accepts.
    """
    ln = code.select(file_col, start_col, F.posexplode(split_lines(F.col(text_col))).alias("pos", "line")).filter(F.regexp_like("line", F.lit(r"^\S")) & ~F.regexp_like("line", F.lit(r"^[#)\]}]")))
    head = r"^(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)"
    outer = ln.select(file_col, (F.col(start_col) + F.col("pos")).alias("line_no"), F.regexp_extract("line", head, 1).alias("word"), F.regexp_extract("line", head, 2).alias("name"))
    outer = outer.groupBy(file_col, "line_no").agg(F.max("word").alias("word"), F.max("name").alias("name"))
    last = code.groupBy(file_col).agg(F.max(F.col(start_col) + F.size(split_lines(F.col(text_col))) - 1).alias("last"))
    w = Window.partitionBy(file_col).orderBy("line_no")
    spans = outer.withColumn("next", F.lead("line_no").over(w)).filter("word <> ''").join(last, file_col)
    kind = F.when(F.col("word") == "class", "class").otherwise("function")
    return spans.select(file_col, kind.alias("kind"), "name", F.col("line_no").alias("line_start"), F.coalesce(F.col("next") - 1, F.col("last")).alias("line_end"))
