"""Problem 2: functions of source windows paired with their documentation.

Method: a state machine that knows strings and comments walks over each window and matches
brackets, so that only ``def`` lines which stand as code at bracket depth 0 count. A function ends
before the next code line, outside brackets, that is not indented deeper. Its documentation is the string literal
that is the first statement of its body or else the comment lines directly above it.

A window may begin within a string: the machine is started as code and, if that leaves lines which
don't read as code, also inside either kind of triple-quoted string; the start under which the
lines read best is kept.

Trivial documentation is left out: fewer than three words, a first word of ``MARKERS``, or no word beyond those of the
name and ``FILLER`` (also with an s added).

Defined results: null and blank documents give no rows; only .py chunks are read (``file_ext`` trimmed, in lower
case); rows with the same id count once; a literal that the window cuts off is no documentation;
other columns are ignored.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import wide

# Fixed values of the problem's statement.
MARKERS = frozenset({"todo", "fixme", "tbd", "xxx"})
FILLER = ("the", "a", "an", "and", "of", "to", "for", "in", "this", "it", "function", "method")

_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"""(?P<prefix>(?<![\w])[rRbBuUfFtT]{1,2}(?=["']))?(?P<quote>\"\"\"|'''|"|')|(?P<comment>\#[^\r\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<join>\\\r?\n)|(?P<line>\n)""")
_CLOSE = {
    '"""': re.compile(r'(?:[^\\"]|\\.|"(?!""))*"""', re.S),
    "'''": re.compile(r"(?:[^\\']|\\.|'(?!''))*'''", re.S),
    '"': re.compile(r'(?:[^\\"\n]|\\.)*"', re.S),
    "'": re.compile(r"(?:[^\\'\n]|\\.)*'", re.S),
}
_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?=[(\[\\\r\n]|$)")
_CODE_LINE = re.compile(
    r"\s*(?:(?:async\s+)?def\s+\w+\s*[(\[]|class\s+\w+\s*[:(\[]|@[\w.]+|return\b|if\b.*:|elif\b.*:|else\s*:|for\s+.*\bin\b.*:|while\b.*:|with\b.*:|async\s+(?:for|with)\b|try\s*:|except\b.*:|"
    r"finally\s*:|import\s+[\w.]+|from\s+[\w.]+\s+import\b|raise\b|pass\s*$|break\s*$|continue\s*$|yield\b|await\b|assert\b|del\s+\w|global\s+\w|nonlocal\s+\w|lambda\b|match\b.*:|case\b.*:|"
    r"[\w.\[\]'\", ]+\s*(?::\s*[\w.\[\], |]+)?\s*(?:[-+*/%&|^@]|//|\*\*|<<|>>)?=(?!=)|[\w.]+\(.*|[\])}].*|\.\.\.\s*$|['\"].*['\"]\s*[:,]?.*$|[\w.\[\]]+\s*,?\s*$|\w+\s*:\s*[\w.\[\], |]+.*$)"
)
_STRONG_CODE = re.compile(r"\s*(?:(?:async\s+)?def\s+\w+\s*\(|class\s+\w+\s*[:(]|@\w+|return\b(?:\s+[\w.\[\]()]+)?\s*$|if [^.]*:\s*$|for \w+ in [^.]*:\s*$|try:\s*$|except\b[^.]*:\s*$|\w+ (?:[-+*/])?= \S|import \w+\s*$|from \w+ import )")


class Function(NamedTuple):
    name: str
    def_line: int
    end_line: int
    code: str
    documentation: str
    doc_kind: str  # literal or comment


class _Scan(NamedTuple):
    #: state at the start of each line: True where it is code outside brackets and strings
    fresh: list[bool]
    in_string: list[bool]
    strings: list[tuple[int, int, str, str]]  # start, end, prefix, quote of complete literals
    comments: dict[int, str]  # line -> text of a comment that stands alone on it
    starts: list[int]  # offset of each line
    trailing: set[int]  # offsets where a comment begins


def _scan(text: str, begin: str = "") -> _Scan:
    """Walks over the text; ``begin`` is the quote inside which it begins, if any."""
    starts = [0]
    pos = text.find("\n")
    while pos >= 0:
        starts.append(pos + 1)
        pos = text.find("\n", pos + 1)
    n = len(starts)
    fresh, in_string = [False] * n, [False] * n
    strings: list[tuple[int, int, str, str]] = []
    comments: dict[int, str] = {}
    trailing: set[int] = set()
    line = depth = 0
    joined = False

    def pass_string(a: int, b: int) -> None:
        nonlocal line
        while line + 1 < n and starts[line + 1] <= b:
            line += 1
            in_string[line] = starts[line] < b or b == len(text)

    pos = 0
    if begin:
        in_string[0] = True
        m = _CLOSE[begin].match(text, 0)
        pos = m.end() if m else len(text)
        pass_string(0, pos)
    else:
        fresh[0] = True
    size = len(text)
    while pos < size:
        m = _TOKEN.search(text, pos)
        if not m:
            break
        kind = m.lastgroup
        if kind == "quote":
            quote = m["quote"]
            end = _CLOSE[quote].match(text, m.end())
            if end:
                pos = end.end()
                strings.append((m.start(), pos, m["prefix"] or "", quote))
            elif len(quote) == 3:
                pos = size
            else:  # an unfinished string ends with its line
                nl = text.find("\n", m.end())
                pos = nl if nl >= 0 else size
            pass_string(m.start(), pos)
            continue
        if kind == "comment":
            trailing.add(m.start())
            if not text[starts[line] : m.start()].strip() and not in_string[line]:
                comments[line] = m.group()
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        else:
            line += 1
            if line < n:
                joined = kind == "join"
                if depth and not joined and _DEF.match(text, starts[line]):
                    depth = 0  # a def can't stand within brackets: one was never closed
                fresh[line] = depth == 0 and not joined
        pos = m.end()
    return _Scan(fresh, in_string, strings, comments, starts, trailing)


def _reads(text: str, s: _Scan) -> tuple[int, int]:
    """(how well the lines read under this scan, number of lines that don't)."""
    good = bad = 0
    n = len(s.starts)
    for k in range(n):
        a = s.starts[k]
        b = s.starts[k + 1] - 1 if k + 1 < n else len(text)
        line = text[a:b]
        if not line.strip() or k in s.comments:
            continue
        if s.in_string[k]:
            if _STRONG_CODE.match(line):
                bad += 1
        elif s.fresh[k]:
            if _CODE_LINE.match(line):
                good += 1
            elif not line.lstrip().startswith(('"', "'", "r\"", "r'", "f\"", "f'", "u\"", "b\"")):
                bad += 1
    return good - 2 * bad, bad


def _best_scan(text: str) -> _Scan:
    best = _scan(text)
    value, bad = _reads(text, best)
    if bad:
        for quote in ('"""', "'''"):
            if quote in text:
                other = _scan(text, quote)
                v, _ = _reads(text, other)
                if v > value:
                    best, value = other, v
    return best


def _indent(line: str) -> int:
    return len(line.expandtabs(8)) - len(line.expandtabs(8).lstrip(" \t\x0c"))


def is_trivial(documentation: str, name: str) -> bool:
    words = [w.lower() for w in _WORD.findall(documentation)]
    if len(words) < 3 or words[0] in MARKERS:
        return True
    known = {*FILLER, *(w.lower() for w in _WORD.findall(name))}
    known |= {w + "s" for w in known}
    return all(w in known for w in words)


def _literal_text(raw: str, prefix: str, quote: str) -> str:
    try:
        with_escapes = ast.literal_eval(raw)
        return with_escapes if isinstance(with_escapes, str) else ""
    except (SyntaxError, ValueError, MemoryError):
        return raw[len(prefix) + len(quote) : len(raw) - len(quote)]


def functions_of(text: str) -> list[Function]:
    """The functions of a window whose documentation isn't trivial."""
    if "def" not in text:
        return []
    s = _best_scan(text)
    n = len(s.starts)
    lines = [text[a : (s.starts[k + 1] - 1 if k + 1 < n else len(text))] for k, a in enumerate(s.starts)]
    at_start = {a: (b, p, q) for a, b, p, q in s.strings}
    out = []
    for k in range(n):
        if not s.fresh[k] or s.in_string[k]:
            continue
        m = _DEF.match(lines[k])
        if not m:
            continue
        doc, kind = _docstring(text, s, at_start, s.starts[k] + m.end()), "literal"
        first = _decorators(lines, s, k)
        if doc is None:
            doc, kind = "\n".join(_comments_above(lines, s, k, first)), "comment"
        if is_trivial(doc, m[1]):
            continue
        end = _block_end(lines, s, k)
        out.append(Function(m[1], k + 1, end + 1, "\n".join(lines[first : end + 1]), doc, kind))
    return out


def _docstring(text: str, s: _Scan, at_start: dict[int, tuple[int, str, str]], pos: int) -> str | None:
    """The literal that is the first statement after the signature that begins at pos."""
    depth, size = 0, len(text)
    while pos < size:  # to the colon of the signature
        c = text[pos]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "#" and pos in s.trailing:
            pos = text.find("\n", pos)
            if pos < 0:
                return None
        elif c == ":" and depth <= 0:
            pos += 1
            break
        elif c == "\n" and depth <= 0 and text[pos - 1 : pos] != "\\" and text[pos - 2 : pos] != "\\\r":
            return None
        if pos in at_start:
            pos = at_start[pos][0]
        else:
            pos += 1
    while pos < size:  # over blanks and comments
        if text[pos].isspace():
            pos += 1
        elif text[pos] == "#":
            pos = text.find("\n", pos)
            if pos < 0:
                return None
        else:
            break
    opened = 0
    while pos < size and text[pos] == "(":
        opened += 1
        pos += 1
        while pos < size and text[pos].isspace():
            pos += 1
    parts = []
    while pos in at_start:
        end, prefix, quote = at_start[pos]
        if set(prefix.lower()) & set("bft"):
            return None
        parts.append(_literal_text(text[pos:end], prefix, quote))
        pos = end
        while pos < size and (text[pos] in " \t\r" or (opened and text[pos] == "\n")):
            pos += 1
    if not parts:
        return None
    while opened and pos < size and text[pos] == ")":
        opened -= 1
        pos += 1
        while pos < size and text[pos] in " \t\r":
            pos += 1
    return "".join(parts) if not opened and (pos >= size or text[pos] in "\n#;") else None


def _decorators(lines: list[str], s: _Scan, k: int) -> int:
    """The first line of the decorators above line k, or k."""
    first = at = k
    while at > 0:
        at -= 1
        if s.in_string[at] and not s.fresh[at]:
            continue
        if s.fresh[at]:
            if lines[at].lstrip().startswith("@"):
                first = at
            elif at in s.comments and _above_is_decorator(lines, s, at):
                continue
            else:
                break
        elif not lines[at].strip():
            break
    return first


def _above_is_decorator(lines: list[str], s: _Scan, at: int) -> bool:
    while at >= 0 and at in s.comments:
        at -= 1
    while at >= 0 and not s.fresh[at]:
        at -= 1
    return at >= 0 and lines[at].lstrip().startswith("@")


def _comments_above(lines: list[str], s: _Scan, k: int, first: int) -> list[str]:
    found: list[str] = []
    for start in dict.fromkeys((k, first)):
        at = start - 1
        block = []
        while at >= 0 and at in s.comments:
            block.append(s.comments[at].lstrip("#").strip())
            at -= 1
        found = block[::-1] + found if start == first and start != k else block[::-1]
    return found


def _block_end(lines: list[str], s: _Scan, k: int) -> int:
    """The last non-blank line of the block that line k opens."""
    own, last = _indent(lines[k]), k
    for j in range(k + 1, len(lines)):
        if not lines[j].strip():
            continue
        if s.fresh[j] and not s.in_string[j] and _indent(lines[j]) <= own:
            break
        last = j
    return last


_FIELDS = [("id", pa.string()), ("func_name", pa.string()), ("def_line", pa.int32()), ("end_line", pa.int32()), ("code", pa.string()), ("documentation", pa.string()), ("doc_kind", pa.string()), ("listed", pa.bool_())]


def document_pairs(chunks: DataFrame, with_text: bool = True) -> DataFrame:
    """``id, func_name, def_line, end_line, code, documentation, doc_kind, listed`` of every documented function.

    ``listed`` tells whether the chunk's ``name`` or ``symbols`` name the function. ``with_text=False`` leaves out code and documentation.
    """
    fields = [f for f in _FIELDS if with_text or f[0] not in ("code", "documentation")]
    py = chunks.filter(F.lower(F.trim("file_ext")) == ".py").filter(F.col("document").isNotNull())
    py = py.select("id", "document", F.concat_ws("; ", "name", F.array_join("symbols", "; ")).alias("labels")).dropDuplicates(["id"]).repartition(wide(chunks.sparkSession))  # a width of its own for the heavy work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, doc, labels in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for f in functions_of(doc):
                    listed = re.search(rf"\bdef {re.escape(f.name)}\b", labels) is not None
                    row = {"id": i, "func_name": f.name, "def_line": f.def_line, "end_line": f.end_line, "code": f.code, "documentation": f.documentation, "doc_kind": f.doc_kind, "listed": listed}
                    rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], type=t) for n, t in fields], names=[n for n, _ in fields])

    kinds = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}
    return py.mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def found(chunks: DataFrame) -> DataFrame:
    """``(id, func_name, def_line)``, distinct."""
    return document_pairs(chunks, with_text=False).select("id", "func_name", "def_line").distinct()
