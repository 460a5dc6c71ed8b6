"""Rewriting of texts: open() calls without a with block, formula marks, section rules, replace commands."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import split_lines

_OPEN = re.compile(r"^(?P<indent>[ \t]*)(?P<name>[A-Za-z_]\w*)\s*=\s*open\((?P<args>.*)\)\s*$")


def with_blocks(text: str, aggressive: bool = False) -> tuple[str, int]:
    """(text, rewrites): ``v = open(...)`` up to its ``v.close()`` becomes a with block; without a close only if aggressive, then with an empty body."""
    lines = text.split("\n")
    out: list[str] = []
    n = i = 0
    while i < len(lines):
        m = _OPEN.match(lines[i])
        if not m:
            out.append(lines[i])
            i += 1
            continue
        close = re.compile(rf"^{m['indent']}{re.escape(m['name'])}\.close\(\)\s*$")
        end = next((j for j in range(i + 1, len(lines)) if close.match(lines[j])), None)
        if end is None and not aggressive:
            out.append(lines[i])
            i += 1
            continue
        out.append(f"{m['indent']}with open({m['args']}) as {m['name']}:")
        body = lines[i + 1 : end] if end is not None else []
        out += [f"    {x}" if x.strip() else x for x in body] or [f"{m['indent']}    pass"]
        n += 1
        i = end + 1 if end is not None else i + 1
    return "\n".join(out), n


def rewrite_open(code: DataFrame, id_col: str, text_col: str, aggressive: bool = False) -> DataFrame:
    """``(id_col, rewrites, new_text)`` of the texts in which something is rewritten; only texts with ``open(`` reach Python."""
    kind = code.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [with_blocks(t, aggressive) for t in b.column(1).to_pylist()]
            keep = [k for k, (_, n) in enumerate(got) if n]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, type=pa.int64())), pa.array([got[k][1] for k in keep], type=pa.int32()), pa.array([got[k][0] for k in keep], type=pa.string())], names=[id_col, "rewrites", "new_text"])

    return code.filter(F.col(text_col).contains("open(")).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, rewrites int, new_text string")


# Raised digits and what they become.
RAISED = (("²", "^2"), ("³", "^3"), ("¹", "^1"), ("₀", "_0"), ("₁", "_1"), ("₂", "_2"))


def plain_formulas(c: Column) -> Column:
    r"""``\( \)`` and ``\[ \]`` as dollar signs, raised and lowered digits as marks, mojibake quotes repaired."""
    out = F.regexp_replace(F.regexp_replace(c, r"\\\((.*?)\\\)", r"\$$1\$"), r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")
    for a, b in (*RAISED, ("â€™", "’"), ("â€œ", "“")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def section_rules(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, section, questions, marks)`` of lines like "Section A has 20 questions of 1 mark"; of equal sections that with most questions."""
    ln = pages.select(id_col, F.explode(split_lines(F.col(text_col))).alias("line"))
    pattern = r"(?i)section\s+([A-Z]).*?(?:consists|contains|has)\s+(\d{1,3})\s+(?:questions?|items?)\s+(?:of|worth)\s+(\d{1,2})\s+mark"
    got = ln.filter(F.col("line").rlike(pattern)).select(
        id_col, F.upper(F.regexp_extract("line", pattern, 1)).alias("section"), F.regexp_extract("line", pattern, 2).cast("int").alias("questions"), F.regexp_extract("line", pattern, 3).cast("int").alias("marks")
    )
    best = F.max_by(F.struct("questions", "marks"), F.struct("questions", -F.col("marks"))).alias("b")
    return got.groupBy(id_col, "section").agg(best).select(id_col, "section", "b.questions", "b.marks")


def marked_totals(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id_col, n, marks)``: how many "(N marks)" a text states and their sum."""
    m = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(r"\((\d{1,2}) marks?\)"), 1), lambda x: x.cast("int"))
    return pages.select(id_col, m.alias("m")).filter(F.size("m") > 0).select(id_col, F.size("m").alias("n"), F.aggregate("m", F.lit(0), lambda a, x: a + x).alias("marks"))


def replace_command(prompt: Column) -> Column:
    """``find`` and ``replacement`` of prompts like: replace "a" with "b"; nulls where there is no such command."""
    pattern = r"(?i)\b(?:replace|substitute|refactor)\s+[\"'`]?([\w.]+)[\"'`]?\s+(?:with|by|so)\s+[\"'`]?([\w.]+)"
    p = F.coalesce(prompt, F.lit(""))
    return F.when(p.rlike(pattern), F.struct(F.regexp_extract(p, pattern, 1).alias("find"), F.regexp_extract(p, pattern, 2).alias("replacement")))


def wanted_counts(prompt: Column) -> Column:
    """The first number in front of a word for questions, in four languages."""
    n = F.regexp_extract(F.coalesce(prompt, F.lit("")), r"(?i)(\d{1,4}) (?:questions?|fragen|preguntas)", 1)
    return F.when(n != "", n.cast("int"))
