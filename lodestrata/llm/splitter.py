"""Problem 6: pieces of oversized items, cut at natural boundaries with a stated overlap.

Method: balanced targets. The least number of pieces follows from length, limit and overlap; equal
targets are placed and each is snapped to the strongest boundary near it. Where a piece would exceed
the limit or a needed boundary is missing, pieces are added and the targets are placed anew.

Boundaries, from strong to weak: blank line, line end, sentence mark, comma or colon before white
space, other white space. A cut that falls on none of them is ``forced``; it occurs only inside a
stretch of more than the limit without white space and sentence mark. Consecutive pieces share
exactly the stated overlap, except where a stretch without a boundary leaves no room for it beside a
natural cut: there the shared part is as long as it fits (``overlap`` gives what each piece shares
with the one before it). Cutting the overlap off every piece gives back the document.

Defined results: null documents and those within the limit give no rows; a null, blank or unknown
chunk_type takes the limit of ``*``; types are compared trimmed and in lower case; rows with the same
id count once; a null id is an id of its own value; an overlap that isn't below half the limit is cut to half of it;
types without a limit and without ``*`` give no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import wide

MAX_TYPES = 10_000  # a limit for each is held by every task

_BOUNDARY = re.compile(r"(?P<p>\s*\n[ \t\r]*\n\s*)|(?P<l>[ \t\r]*\n[ \t]*)|(?P<s>[.!?;。！？；]+[\"'”’»)\]]*\s?)|(?P<c>[,:，、：]+\s)|(?P<w>\s+)")
_STRENGTH = {"p": 5, "l": 4, "s": 3, "c": 2, "w": 1}


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places of possible natural cuts, in order, and how strong each is."""
    at: list[int] = []
    strength: list[int] = []
    for m in _BOUNDARY.finditer(text):
        kind, (a, b) = m.lastgroup, m.span()
        s = _STRENGTH[kind]
        if kind == "s" and text[b - 1] in ".!?;" and b < len(text):
            s = 1  # a mark inside a number, a path or a name
        if kind == "c":
            inner = ()
        else:
            inner = range(a + 16, b, 16)
        for place, power in ((a, 0 if kind != "c" else -1), *((i, 0) for i in inner), (b, s)):
            if power >= 0 and 0 < place:
                if at and at[-1] >= place:
                    strength[-1] = max(strength[-1], power)
                else:
                    at.append(place)
                    strength.append(power)
    return at, strength


def _attempt(n: int, size: int, limit: int, overlap: int, at: list[int], strength: list[int]) -> list[tuple[int, int, bool]] | None:
    """n balanced pieces as (start, end, whether the end is forced), or None if that many don't do."""
    pieces: list[tuple[int, int, bool]] = []
    start = cut = 0
    for left in range(n, 0, -1):
        if size - start <= limit:
            pieces.append((start, size, False))
            return pieces
        if left == 1:
            return None
        step = (size - cut) / left
        target = cut + step
        top = start + limit
        near = step / 4
        lo, hi = max(cut + 1, int(target - near)), min(top, int(target + near))
        end, forced = -1, False
        a, b = bisect_left(at, lo), bisect_right(at, hi)
        if a < b:
            best = max(range(a, b), key=lambda i: (strength[i], -abs(at[i] - target)))
            end = at[best]
        else:
            b = bisect_right(at, top)
            below = at[b - 1] if b and at[b - 1] > cut else -1
            above = at[b] if b < len(at) and at[b] <= cut + limit else -1
            if below > 0:
                end = below
            elif above > 0:  # only a shorter overlap lets this piece end naturally
                end, start = above, max(start, above - limit)
            else:
                end, forced = top, True
        pieces.append((start, end, forced))
        cut = end
        start = max(end - overlap, 0)
    return None


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(start, end, forced) of the pieces of a text; one piece if it is within the limit."""
    size = len(text)
    if size <= limit:
        return [(0, size, False)]
    overlap = max(0, min(overlap, limit // 2))
    at, strength = boundaries(text)
    n = -(-(size - overlap) // (limit - overlap))
    while True:
        pieces = _attempt(n, size, limit, overlap, at, strength)
        if pieces:
            return pieces
        n += max(1, n // 16)


def _pieces_schema(with_text: bool) -> str:
    return "id string, chunk_type string, page_number int, piece_no int, n_pieces int, char_start int, char_end int, overlap int, forced boolean" + ", piece string" * with_text


def split_oversized(chunks: DataFrame, limits: DataFrame, with_text: bool = True) -> DataFrame:
    """The pieces of every chunk whose document exceeds the limit of its type."""
    kind = F.lower(F.regexp_replace(F.col("chunk_type"), r"(?U)^\s+|\s+$", ""))
    lim = limits.select(F.lower(F.trim("chunk_type")).alias("kind"), "max_chars", "overlap_chars").filter("max_chars > 0").dropDuplicates(["kind"])
    if lim.limit(MAX_TYPES + 1).count() > MAX_TYPES:
        raise ValueError(f"more than {MAX_TYPES} types; raise MAX_TYPES if executors can hold a row for each")
    rest = lim.filter("kind = '*'").select(F.col("max_chars").alias("any_max"), F.col("overlap_chars").alias("any_overlap"))
    rows = chunks.select("id", "chunk_type", "page_number", "document", kind.alias("kind")).filter(F.col("document").isNotNull())
    rows = rows.join(F.broadcast(lim.filter("kind <> '*'")), "kind", "left").join(F.broadcast(rest), F.lit(True), "left")  # size_limits has a row a type
    rows = rows.select(
        "id", "chunk_type", "page_number", "document",
        F.coalesce("max_chars", "any_max").alias("max_chars"),
        F.coalesce(F.when(F.col("max_chars").isNotNull(), F.col("overlap_chars")).otherwise(F.col("any_overlap")), F.lit(0)).alias("overlap_chars"),
    )
    over = rows.filter(F.length("document") > F.col("max_chars")).dropDuplicates(["id"]).repartition(wide(chunks.sparkSession))  # a width of its own for the heavy work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(10 if with_text else 9)]
            for i, t, page, doc, limit, overlap in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pieces = split_text(doc, limit, overlap)
                end_before = 0
                for k, (s, e, forced) in enumerate(pieces):
                    row = (i, t, page, k + 1, len(pieces), s, e, max(0, end_before - s), forced, *((doc[s:e],) if with_text else ()))
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                    end_before = e
            types = [pa.string(), pa.string(), *[pa.int32()] * 6, pa.bool_(), *[pa.string()] * with_text]
            names = ["id", "chunk_type", "page_number", "piece_no", "n_pieces", "char_start", "char_end", "overlap", "forced", *["piece"] * with_text]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=x) for c, x in zip(out, types, strict=True)], names=names)

    return over.mapInArrow(run, _pieces_schema(with_text))


def found(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``(id, cut)``: whether the split of an oversized chunk had to be forced anywhere."""
    p = split_oversized(chunks, limits, with_text=False)
    return p.groupBy("id").agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("cut"))


def covered(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """``(id, chars)``: how many characters the pieces of a chunk hold without their overlap; they give back the document."""
    p = split_oversized(chunks, limits, with_text=False)
    return p.groupBy("id").agg(F.sum(F.col("char_end") - F.col("char_start") - F.col("overlap")).alias("chars"))
