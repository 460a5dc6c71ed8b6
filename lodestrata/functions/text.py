"""Column helpers over strings. All take and return Columns; lengths and places count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space of Unicode, spelled out so that every regex dialect reads it alike
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INK = "[^" + WS[1:]
#: line ends of Python's splitlines
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    """Without white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_extract(c, rf"(?s){INK}.*{INK}|{INK}", 0)


def collapse(c: Column) -> Column:
    """Every run of white space as one space, none at the ends; null as the empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{WS}+", " "))


def split_lines(c: Column) -> Column:
    """Python's ``splitlines``: no last empty line, no line of an empty text, null as an empty text."""
    parts = F.split(F.coalesce(c, F.lit("")), LINE_BREAK)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def is_meaningful(c: Column, least: int = 8) -> Column:
    """At least ``least`` (two or more) characters without white space at the ends, and one ASCII letter or digit."""
    return F.coalesce(c.rlike(rf"(?s){INK}.{{{least - 2},}}{INK}") & c.rlike("[A-Za-z0-9]"), F.lit(False))


def truncate(c: Column, n: int) -> Column:
    """The first n characters; n <= 0 keeps all."""
    return c if n <= 0 else F.substring(c, 1, n)


def snippet(c: Column, n: int) -> Column:
    """Cut at n with the number of characters that were cut."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("...(+"), (F.length(c) - n).cast("string"), F.lit(" chars)")))


def one_line(c: Column, n: int = 90) -> Column:
    """White space collapsed, cut to n characters with an ellipsis."""
    s = collapse(c)
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, 1, n - 1), F.lit("…")))


def dehyphenate(c: Column) -> Column:
    """Joins words broken at line ends, makes line ends ``\\n``, keeps two line ends at most and no blanks before them."""
    joined = F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    unix = F.replace(F.replace(joined, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(unix, r"\n{3,}", "\n\n"), r"[ \t]+\n", "\n")


def extension(c: Column) -> Column:
    """Lower-case extension with its dot, or the empty text; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(c, r"[^/.][^/]*?(\.[^./]*)$", 1))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def strip_markup(c: Column) -> Column:
    """Text of an HTML page: scripts and styles dropped, tags to spaces, the commonest entities resolved, white space collapsed."""
    body = F.regexp_replace(c, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>", " ")
    plain = F.regexp_replace(body, r"<[^<>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return collapse(plain)
