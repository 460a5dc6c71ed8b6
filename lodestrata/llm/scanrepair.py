"""Problem 5: noise in the text of scanned pages, and its repair into running paragraphs.

Method: skip-gram vectors are learned from all pages (Spark's Word2Vec; words too rare for it get the mean of the vectors around them). A rare word
is linked, by joins of its glyph edits with the counts of all words, to the frequent words that plausible edits make of it and to whose vectors its own is near;
on a page, of these the one is taken that also fits the vectors of the words around it. Then furniture (lines that recur at page edges, printed page
numbers) is removed, words broken at line ends are joined, also over pages, and the lines are reflowed. A page gets the counts and
links of its own words by a join, so no table that grows with the corpus is held by a task; vectors are kept of at most ``vocabulary`` words.

Recurring lines are found over all pages of a file without bringing them together: each edge line gives parts of its
skeleton (letters with confusable glyphs made equal), counted from both ends, as keys, lines that share a key are compared by edit distance with the
key's most frequent skeleton, and three pages that agree make a running line. In files whose share of misread words is
that of chance only sure corrections are made: those of words with digits or signs inside, or that hardly occur beside the right form.

Defined results: null and blank documents and rows without page number give lines of their own only (no
recurrence, no continuation on another page) or nothing; rows with the same id count once; a file is what the ids of its rows share (project, path,
version), or the file_path where the id has another form; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import cut_lineage, wide, written

VOCABULARY = 100_000  # the most frequent words, which have vectors that every task holds
MAX_LEXICON = 100_000  # a larger lexicon raises an error
BROADCAST_ROWS = 200_000  # of words with their links; larger tables are joined by a shuffle
DIM = 24
RARE = 5  # words that occur less often are no targets of corrections
RATIO = 5.0  # how much more often than a misread form the right one occurs, at least
SURE_RATIO = 400.0  # and in a file without signs of scanning
MIN_RECURRING = 3
MISREAD_SHARE = 0.004  # of a file's words; below it only sure corrections are made

# How glyphs are misread (as read -> as printed).
GLYPHS = (
    ("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n"), ("h", "li"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("c", "e"), ("b", "h"), ("f", "t"),
    ("l", "r"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "f"), ("e", "c"), ("h", "b"), ("m", "rn"), ("w", "vv"), ("d", "cl"), ("u", "ii"), ("n", "ri"), ("n", "u"), ("u", "n"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"),
    ("2", "z"), ("4", "a"), ("7", "t"), ("|", "l"), ("!", "l"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("a", "o"), ("o", "a"), ("o", "e"), ("nn", "m"), ("in", "m"), ("m", "in"), ("lc", "k"), ("k", "lc"), ("ß", "b"), ("b", "ß"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("e", "é"),
)
HYPHENS = "-‐‑¬­"
PAGE_WORDS = r"(?:page|pages|seite|página|pagina|pág|pag|pg|p|s|blatt|folio|fol|no|nr)"

_TOKEN = re.compile(r"[^\W_](?:[\w|!]*\w)?(?:['’\-‐‑][^\W_](?:[\w|!]*\w)?)*")
_NUMBER_LINE = re.compile(rf"^[\W_]*(?:{PAGE_WORDS}\b\.?[\W_]*)?(?P<n>[0-9OolIS]{{1,6}}|[ivxlcdm]{{1,7}})[\W_]*(?:(?:of|von|de|sur|/)[\W_]*[0-9OolIS]+[\W_]*)?$", re.I)
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
_EDGE_GLYPHS = str.maketrans({"e": "c", "0": "o", "5": "s", "9": "g", "6": "b", "1": "l", "i": "l", "f": "t", "|": "l"})


def skeleton(line: str) -> str:
    """The letters of a line with numbers dropped and confusable glyphs made equal."""
    low = re.sub(r"(?<![^\W_])[\d]+(?![^\W_])", " ", line.lower())
    low = "".join(c for c in low if c.isalnum())
    for a, b in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("ri", "n")):
        low = low.replace(a, b)
    return low.translate(_EDGE_GLYPHS).replace("b", "h")


def printed_number(line: str) -> tuple[int, bool] | None:
    """(number, whether it is marked as a page number) if the line holds nothing else."""
    m = _NUMBER_LINE.match(line)
    if not m:
        return None
    n = m["n"].lower()
    marked = re.sub(r"\s", "", line) != re.sub(r"\s", "", m["n"])
    if re.fullmatch(r"[ivxlcdm]+", n) and not (n in "l" and marked):
        values = [_ROMAN[c] for c in n]
        total = sum(-v if i + 1 < len(values) and v < values[i + 1] else v for i, v in enumerate(values))
        return (total, marked) if total < 400 else None
    digits = n.replace("o", "0").replace("l", "1").replace("i", "1").replace("s", "5")
    return (int(digits), marked) if digits.isdigit() and any(c.isdigit() for c in n) else None


def pdf_pages(chunks: DataFrame) -> DataFrame:
    """``(id, file, page, document)`` of the chunks that are pages of .pdf files."""
    kind = F.lower(F.regexp_replace("chunk_type", r"(?U)^\s+|\s+$", ""))
    pdf = F.lower(F.coalesce("file_ext", F.regexp_extract("file_path", r"(\.\w+)$", 1))) == ".pdf"
    block = F.coalesce(F.regexp_like("name", F.lit(r"::\s*p\d+\s*::")), F.lit(False))
    own = F.regexp_extract("id", r"^(.*)::[^:]*$", 1)
    rows = chunks.filter((kind == "pdf_page") | (F.col("chunk_type").isNull() & pdf & ~block)).filter(F.col("id").isNotNull() & F.col("document").isNotNull())
    rows = rows.select("id", F.when(own != "", own).otherwise(F.coalesce("file_path", F.lit(""))).alias("file"), F.col("page_number").alias("page"), "document")
    return rows.dropDuplicates(["id"])


def _edges(pages: DataFrame) -> DataFrame:
    """The first and last two non-blank lines of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, file, page, doc in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = doc.split("\n")
                full = [k for k, t in enumerate(lines) if t.strip()]
                for k in dict.fromkeys((*full[:2], *full[-2:])):
                    n = printed_number(lines[k].strip())
                    s = skeleton(lines[k])
                    mid = len(s) // 2 - 3
                    keys = [f"a{s[:7]}", f"b{s[5:12]}", f"m{s[mid : mid + 7]}", f"y{s[-12:-5]}", f"z{s[-7:]}"] if len(s) > 12 else [s] if len(s) > 2 else []
                    rows.append((i, file, page, k + 1, s, keys, n[0] if n else None, n[1] if n else None))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["id", "file", "page", "line_no", "skel", "keys", "number", "marked"])

    return pages.select("id", "file", "page", "document").mapInArrow(run, "id string, file string, page int, line_no int, skel string, keys array<string>, number int, marked boolean")


def furniture(pages: DataFrame) -> DataFrame:
    """``(id, line_no, kind)``: the running lines and page numbers."""
    edges = cut_lineage(_edges(pages))
    # page numbers: those that keep the file's usual distance to page_number, or are marked as such
    num = edges.filter("number IS NOT NULL").withColumn("gap", F.col("number") - F.col("page"))
    usual = num.filter("gap IS NOT NULL").groupBy("file", "gap").count().groupBy("file").agg(F.max_by("gap", F.struct("count", -F.abs("gap"))).alias("usual"), F.max("count").alias("times"))
    num = num.join(usual, "file", "left").filter(F.col("marked") | ((F.col("gap") == F.col("usual")) & ((F.col("times") > 1) | (F.col("gap") == 0))))
    numbers = num.select("id", "line_no", F.lit("page_number").alias("kind"))
    text = edges.filter("number IS NULL AND page IS NOT NULL AND size(keys) > 0").select("id", "file", "page", "line_no", "skel", F.explode("keys").alias("key"))
    by = text.groupBy("file", "key", "skel").agg(F.count("*").alias("n"))
    top = by.groupBy("file", "key").agg(F.sum("n").alias("all"), F.max_by("skel", F.struct("n", "skel")).alias("model")).filter(F.col("all") >= MIN_RECURRING).drop("all")
    near = F.levenshtein("skel", "model") <= F.ceil(F.greatest(F.length("skel"), F.length("model")) * 0.25)
    alike = text.join(top, ["file", "key"]).filter(near)
    often = alike.groupBy("file", "key", "model").agg(F.count_distinct("page").alias("pages")).filter(F.col("pages") >= MIN_RECURRING)
    running = alike.join(often.select("file", "key"), ["file", "key"]).select("id", "line_no").distinct().withColumn("kind", F.lit("running_line"))
    return numbers.unionByName(running.join(numbers.select("id", "line_no"), ["id", "line_no"], "left_anti"))


def _core(token: str) -> str:
    return token.lower().replace("’", "'").replace("‑", "-").replace("‐", "-")


def body_words(line: str) -> list[str]:
    return _TOKEN.findall(line)


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _read, _printed in GLYPHS:
    _BY_FIRST.setdefault(_read[0], []).append((_read, _printed))


def glyph_edits(word: str) -> Iterator[tuple[str, float]]:
    """(form, cost) of every single glyph edit of a word."""
    for i, c in enumerate(word):
        for a, b in _BY_FIRST.get(c, ()):
            if word.startswith(a, i):
                yield word[:i] + b + word[i + len(a) :], 0.5 if not a.isalpha() else 1.0 if len(a) > 1 or (a, b) in (("c", "e"), ("b", "h"), ("f", "t")) else 1.6


def forms_of(word: str, edits: int) -> dict[str, float]:
    """The forms that up to so many glyph edits make of a word, with the least cost of each; forms with digits are left out."""
    out: dict[str, float] = {}
    level = {word: 0.0}
    for _ in range(edits):
        nxt: dict[str, float] = {}
        for w, cost in level.items():
            for v, extra in glyph_edits(w):
                if v != word and cost + extra < nxt.get(v, 9.0):
                    nxt[v] = cost + extra
        for v, c in nxt.items():
            if c < out.get(v, 9.0) and not any(x.isdigit() for x in v):
                out[v] = c
        level = nxt
    return out


class Corrector:
    """Chooses among the forms that the words of one page are linked with, by frequency and context.

    ``facts`` are the counts and links of the page's words: word -> (n, ((form, score, sure), ...)).
    """

    def __init__(self, lexicon: frozenset[str], vectors: dict[str, np.ndarray]):
        self.lexicon, self.vectors = lexicon, vectors
        self.facts: dict[str, tuple[int, tuple]] = {}

    def count(self, word: str) -> int:
        return self.facts[word][0] if word in self.facts else 0

    def link(self, word: str) -> tuple:
        return self.facts[word][1] if word in self.facts and word not in self.lexicon else ()

    def right(self, word: str, around: list[str]) -> tuple[str, bool] | None:
        """(right form in lower case, whether that is sure) of a word, or None if it stands."""
        options = self.link(word)
        if not options:
            return None
        best, score, sure = None, -9.0, False
        mean = self._mean(around)
        for v, s, sure_ in options:
            x = self.vectors.get(v)
            if mean is not None and x is not None:
                s += 1.5 * float(mean @ x)
            if s > score:
                best, score, sure = v, s, sure_
        return best, sure

    def _mean(self, around: list[str]) -> np.ndarray | None:
        have = [self.vectors[w] for w in around if w in self.vectors]
        if not have:
            return None
        m = np.sum(have, axis=0)
        n = np.linalg.norm(m)
        return m / n if n else None

    def known(self, word: str) -> bool:
        return word in self.lexicon or (self.count(word) >= RARE and not self.link(word))

    def joined(self, head: str, tail: str, around: list[str]) -> str:
        """A broken word as it should be written: without the hyphen, or with it where that is the known form."""
        low_h, low_t = _core(head), _core(tail)
        whole, hyphened = low_h + low_t, f"{low_h}-{low_t}"
        if whole in self.lexicon or (self.count(whole) > 0 and self.known(whole)):
            return head + tail
        if hyphened in self.lexicon or self.count(hyphened) > 0:
            return f"{head}-{tail}"
        for form in (whole, hyphened):
            right = self.right(form, around)
            if right:
                return _cased(right[0], head)
        if self.known(low_h) and self.known(low_t) and len(low_h) > 2 and len(low_t) > 2 and self.count(whole) == 0:
            return f"{head}-{tail}"
        return head + tail


def _cased(right: str, read: str) -> str:
    letters = [c for c in read if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[0].upper() + right[1:] if read[:1].isupper() else right


def _vectors(pages: DataFrame, words: DataFrame, vocabulary: int) -> dict[str, np.ndarray]:
    """Skip-gram vectors, learned from all pages, of the words that occur at least ``RARE`` times, the ``vocabulary`` most frequent at most."""
    least = words.filter(F.col("n") >= RARE).orderBy(F.desc("n")).limit(vocabulary).agg(F.count("*").alias("words"), F.min("n").alias("n")).first()
    if not least.words:
        return {}
    least_n = least.n + (least.words == vocabulary)  # words as frequent as the last one may be more
    tokens = pages.select(F.filter(F.split(F.lower("document"), r"[^\p{L}\p{N}'’-]+"), lambda w: w != "").alias("words"))
    counted = tokens.select(F.explode("words").alias("w")).groupBy("w").count().filter(F.col("count") >= least_n).isEmpty()
    if counted:  # the learner splits words a little differently, and fails on no words
        return {}
    parts = wide(pages.sparkSession)
    model = Word2Vec(vectorSize=DIM, minCount=int(least_n), maxIter=1, numPartitions=parts, windowSize=2, inputCol="words", outputCol="v", seed=1).fit(tokens.repartition(parts))
    out = {}
    for r in model.getVectors().collect():
        v = r.vector.toArray()
        n = np.linalg.norm(v)
        if n:
            out[r.word] = (v / n).astype(np.float32)
    return out


def _vectors_of_rare(marked: DataFrame, vectors: dict[str, np.ndarray], lexicon: frozenset[str]) -> DataFrame:
    """``(word, v array<float>)``: for words without a vector the sum of the vectors around them, over all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[str, np.ndarray] = {}
            for doc, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                page = _Page(doc, {x["line_no"] for x in f or ()})
                for k in page.body:
                    low = [_core(w) for w in body_words(page.lines[k])]
                    for i, w in enumerate(low):
                        if w not in vectors and w not in lexicon:
                            near = [vectors[x] for x in low[max(0, i - 3) : i] + low[i + 1 : i + 4] if x in vectors]
                            if near:
                                sums[w] = sums.get(w, 0) + np.sum(near, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.string()), pa.array([v.tolist() for v in sums.values()], type=pa.list_(pa.float32()))], names=["word", "v"])

    sums = marked.select("document", "furniture").mapInArrow(run, "word string, v array<float>")
    return sums.groupBy("word").agg(F.array(*[F.sum(F.col("v")[i]).cast("float") for i in range(DIM)]).alias("v"))


def link_words(words: DataFrame, lexicon: frozenset[str], vectors: dict[str, np.ndarray], rare_vectors: DataFrame) -> DataFrame:
    """``(word, links array<struct<score, form, sure>>)``, best first: the frequent words that plausible glyph edits make of a word, by frequency, cost and nearness of their vectors.

    Words that one edit explains aren't tried with two (with several digits: three).
    """
    spark = words.sparkSession
    lex = spark.createDataFrame([(w,) for w in sorted(lexicon)], "form string").withColumn("listed", F.lit(True))
    targets = words.filter(F.col("n") >= RARE).select(F.col("word").alias("form"), F.col("n").alias("m")).join(F.broadcast(lex), "form", "full")
    targets = targets.select("form", F.coalesce("m", F.lit(1)).alias("m"), F.coalesce("listed", F.lit(False)).alias("listed"))
    doubted = words.join(F.broadcast(lex.withColumnRenamed("form", "word")), "word", "left_anti").filter(F.length("word") > 1)
    doubted = doubted.filter(F.regexp_like("word", F.lit(r"\p{L}")) & ~F.regexp_like("word", F.lit(r"\d{3}")))

    def edited(rows: DataFrame, one: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, 500):
                    part = b.slice(a, 500)
                    out = [(w, n, v, c) for w, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for v, c in forms_of(w, 1 if one else 3 if sum(x.isdigit() for x in w) > 1 else 2).items()]
                    cols = list(zip(*out, strict=True)) or [()] * 4
                    types = (pa.string(), pa.int64(), pa.string(), pa.float32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["word", "n", "form", "cost"])

        forms = rows.select("word", "n").repartition(wide(spark)).mapInArrow(run, "word string, n bigint, form string, cost float")
        return forms.join(targets, "form").filter((F.col("m") >= RATIO * F.col("n")) | (F.col("listed") & (F.col("m") >= F.col("n"))))

    once = written(edited(doubted, True))
    both = once.unionByName(edited(doubted.join(once.select("word").distinct(), "word", "left_anti"), False))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pydict()
            out = []
            for w, n, v, c, m, listed, own in zip(*(rows[k] for k in ("word", "n", "form", "cost", "m", "listed", "v")), strict=True):
                x, y = vectors.get(w), vectors.get(v)
                if x is None and own is not None:
                    x = np.array(own, dtype=np.float32)
                    x = x / (np.linalg.norm(x) or 1.0)
                out.append(math.log(m + 1) * 0.4 - c * 1.5 + listed + (float(x @ y) if x is not None and y is not None else 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out, type=pa.float64())], names=["word", "n", "form", "m", "score"])

    scored = both.join(rare_vectors, "word", "left").select("word", "n", "form", "m", "cost", "listed", "v").mapInArrow(score, "word string, n bigint, form string, m bigint, score double")
    signs = F.regexp_like("word", F.lit(r"[\d|!]"))
    sure = signs | (F.col("m") >= SURE_RATIO * F.col("n"))
    best = scored.groupBy("word").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "form", sure.alias("sure"))), asc=False), 1, 12).alias("links"), F.max("n").alias("n"), F.max("m").alias("m"))
    # a word that is nearly as frequent as the right one needs an edit of the surest kind
    return best.filter(signs | (F.col("m") >= RATIO * F.col("n")) | (F.col("links")[0]["score"] > 1.2)).select("word", "links")


class _Page:
    """The body of a page: its lines without furniture."""

    def __init__(self, document: str, furniture_lines: set[int]):
        self.lines = document.replace("\r\n", "\n").split("\n")
        self.body = [k for k, t in enumerate(self.lines) if t.strip() and k + 1 not in furniture_lines]

    def first_word(self) -> str:
        m = _TOKEN.match(self.lines[self.body[0]].strip()) if self.body else None
        return m[0] if m else ""


def _broken_end(line: str) -> str | None:
    """The head of a word broken at the end of the line."""
    m = re.search(rf"([^\W\d_][\w'’]*(?:-[^\W_][\w'’]*)*)[{HYPHENS}]$", line.rstrip())
    return m[1] if m else None


def _marked_pages(pages: DataFrame) -> DataFrame:
    """``(id, file, page, document, furniture array<struct<line_no, kind>>)``, written once."""
    f = furniture(pages).groupBy("id").agg(F.collect_list(F.struct("line_no", "kind")).alias("furniture"))  # at most four lines a page
    return cut_lineage(pages.join(f, "id", "left"))


def _with_next(marked: DataFrame) -> DataFrame:
    """Adds the first word of the file's next page."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [_Page(d, {x["line_no"] for x in f or ()}).first_word() for d, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, type=pa.string())], names=["file", "page", "following"])

    words = marked.filter("page IS NOT NULL").select("file", (F.col("page") - 1).alias("page"), "document", "furniture").mapInArrow(first, "file string, page int, following string")
    return marked.join(words.groupBy("file", "page").agg(F.min("following").alias("following")), ["file", "page"], "left")


def _broken_words(page: _Page, following: str | None) -> Iterator[tuple[int, str, str]]:
    """(index in the body, head, tail) of the words broken at line ends."""
    for n, k in enumerate(page.body):
        head = _broken_end(page.lines[k])
        if head:
            m = _TOKEN.match(page.lines[page.body[n + 1]].strip() if n + 1 < len(page.body) else (following or ""))
            if m and (m[0][0].isalpha() or m[0][0].isdigit()):
                yield n, head, m[0]


def _read_words(rows: DataFrame) -> DataFrame:
    """``(word, n)`` over the bodies of all pages; the two ways to write a broken word come with a count of 0 beside what they have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, int] = {}
            for doc, f, following in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                page = _Page(doc, {x["line_no"] for x in f or ()})
                tail_open = False
                for k in page.body:
                    words = [_core(w) for w in body_words(page.lines[k])]
                    if tail_open:
                        words = words[1:]
                    tail_open = _broken_end(page.lines[k]) is not None
                    for w in words[:-1] if tail_open else words:
                        seen[w] = seen.get(w, 0) + 1
                for _, head, tail in _broken_words(page, following):
                    for w in (_core(head) + _core(tail), f"{_core(head)}-{_core(tail)}"):
                        seen.setdefault(w, 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.string()), pa.array(list(seen.values()), type=pa.int64())], names=["word", "n"])

    return rows.select("document", "furniture", "following").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _lexicon(lexicon: DataFrame) -> frozenset[str]:
    words = frozenset(r.word.lower() for r in lexicon.select("word").filter("word IS NOT NULL").distinct().limit(MAX_LEXICON + 1).collect())
    if len(words) > MAX_LEXICON:
        raise ValueError(f"lexicon: more than {MAX_LEXICON} words; raise MAX_LEXICON if executors can hold them")
    return words


def _with_facts(rows: DataFrame, words: DataFrame, links: DataFrame, lexicon: frozenset[str]) -> DataFrame:
    """Adds to each page what is known of its words: ``facts array<struct<word, n, links>>`` of those with links and of the parts of broken words."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, asked, always = [], [], []
            for i, doc, f, following in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page = _Page(doc, {x["line_no"] for x in f or ()})
                own = {_core(w): False for k in page.body for w in body_words(page.lines[k])}
                for _, head, tail in _broken_words(page, following):
                    h, t = _core(head), _core(tail)
                    own |= {h: True, t: True, h + t: True, f"{h}-{t}": True}
                for w, whatever in own.items():
                    if w not in lexicon:
                        ids.append(i)
                        asked.append(w)
                        always.append(whatever)
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.string()), pa.array(asked, type=pa.string()), pa.array(always, type=pa.bool_())], names=["id", "word", "always"])

    known = written(words.join(links, "word", "left").filter("n > 0 OR links IS NOT NULL"))
    few = known.count() <= BROADCAST_ROWS
    asked = rows.select("id", "document", "furniture", "following").mapInArrow(ask, "id string, word string, always boolean")
    facts = asked.join(F.broadcast(known) if few else known, "word").filter("always OR links IS NOT NULL")
    facts = facts.groupBy("id").agg(F.collect_list(F.struct("word", "n", "links")).alias("facts"))  # as many as a page has words
    return rows.join(facts, "id", "left").repartition(wide(rows.sparkSession))


def _fixes(page: _Page, fix: Corrector, following: str | None) -> Iterator[tuple[str, int, int, int, str, bool]]:
    """(kind, line, start, end, right word, sure) of broken and misread words; places are within the line."""
    skip = 0
    broken = {n: (head, tail) for n, head, tail in _broken_words(page, following)}
    for n, k in enumerate(page.body):
        line = page.lines[k]
        tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(line)][skip:]
        skip = 0
        low = [_core(t) for _, _, t in tokens]
        if n in broken:
            head, tail = broken[n]
            whole = fix.joined(head, tail, low[-5:-1])
            yield "hyphenation", k + 1, line.rstrip().rfind(head), len(line.rstrip()), whole, True
            skip = 1 if n + 1 < len(page.body) else 0
            tokens, low = tokens[:-1], low[:-1]
        for i, (a, b, t) in enumerate(tokens):
            if low[i] not in fix.facts or line[b : b + 1] == "_" or line[a - 1 : a] == "_":
                continue
            right = fix.right(low[i], low[max(0, i - 3) : i] + low[i + 1 : i + 4])
            if right:
                yield "misread", k + 1, a, b, _cased(right[0], t), right[1]


def _pass(chunks: DataFrame, lexicon: DataFrame, vocabulary: int) -> tuple[DataFrame, frozenset[str], dict[str, np.ndarray]]:
    rows = _with_next(_marked_pages(pdf_pages(chunks)))
    words = written(_read_words(rows))
    listed = _lexicon(lexicon)
    vectors = _vectors(rows, words, vocabulary)
    links = written(link_words(words, listed, vectors, _vectors_of_rare(rows, vectors, listed)))
    return _with_facts(rows, words, links, listed), listed, vectors


def _facts(column: pa.Array) -> Iterator[dict[str, tuple[int, tuple]]]:
    for f in column.to_pylist():
        yield {x["word"]: (x["n"], tuple((o["form"], o["score"], o["sure"]) for o in x["links"] or ())) for x in f or ()}


def found(chunks: DataFrame, lexicon: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(id, kind, line_no, fixed)``, distinct."""
    rows, listed, vectors = _pass(chunks, lexicon, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Corrector(listed, vectors)
        for b in batches:
            out = []
            texts = zip(*(b.column(i).to_pylist() for i in range(5)), _facts(b.column(5)), strict=True)
            for i, file, doc, f, following, facts in texts:
                fix.facts = facts
                out += [(i, file, x["kind"], x["line_no"], "", 0, True) for x in f or ()]
                page = _Page(doc, {x["line_no"] for x in f or ()})
                out.append((i, file, "", 0, "", sum(len(body_words(page.lines[k])) for k in page.body), True))
                out += [(i, file, kind, line, whole, 0, sure) for kind, line, _, _, whole, sure in _fixes(page, fix, following)]
            cols = list(zip(*out, strict=True)) or [()] * 7
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names=["id", "file", "kind", "line_no", "fixed", "words", "sure"])

    all_ = written(rows.select("id", "file", "document", "furniture", "following", "facts").mapInArrow(run, "id string, file string, kind string, line_no int, fixed string, words bigint, sure boolean"))
    share = all_.groupBy("file").agg((F.count_if(F.col("kind") == "misread") / F.greatest(F.sum("words"), F.lit(1))).alias("share"))
    scanned = share.filter(F.col("share") >= MISREAD_SHARE).select("file")
    kept = all_.filter("kind <> '' AND sure").select("id", "kind", "line_no", "fixed")
    doubtful = all_.filter("kind = 'misread' AND NOT sure").join(scanned, "file", "left_semi").select("id", "kind", "line_no", "fixed")
    return kept.unionByName(doubtful).distinct()


def repaired(chunks: DataFrame, lexicon: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    """``(id, text)``: every page as running paragraphs; a word broken over a page end stays whole on the page where it begins."""
    rows, listed, vectors = _pass(chunks, lexicon, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fix = Corrector(listed, vectors)
        for b in batches:
            ids, files, texts, bad, total = [], [], [], [], []
            plain = []
            pages = zip(*(b.column(i).to_pylist() for i in range(5)), _facts(b.column(5)), strict=True)
            for i, file, doc, f, following, facts in pages:
                fix.facts = facts
                page = _Page(doc, {x["line_no"] for x in f or ()})
                fixes = list(_fixes(page, fix, following))
                ids.append(i)
                files.append(file)
                texts.append(_reflow(page, [x[:5] for x in fixes]))
                plain.append(_reflow(page, [x[:5] for x in fixes if x[5]]))
                bad.append(sum(x[0] == "misread" for x in fixes))
                total.append(sum(len(body_words(page.lines[k])) for k in page.body))
            cols = [pa.array(c, type=pa.string()) for c in (ids, files, texts, plain)] + [pa.array(c, type=pa.int64()) for c in (bad, total)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "file", "corrected", "sure", "bad", "words"])

    out = written(rows.select("id", "file", "document", "furniture", "following", "facts").mapInArrow(run, "id string, file string, corrected string, sure string, bad bigint, words bigint"))
    share = out.groupBy("file").agg((F.sum("bad") / F.greatest(F.sum("words"), F.lit(1))).alias("share"))
    return out.join(share, "file").select("id", F.when(F.col("share") >= MISREAD_SHARE, F.col("corrected")).otherwise(F.col("sure")).alias("text"))


def _reflow(page: _Page, fixes: list[tuple[str, int, int, int, str]]) -> str:
    by_line: dict[int, list[tuple[str, int, int, str]]] = {}
    for kind, line, a, b, whole in fixes:
        by_line.setdefault(line - 1, []).append((kind, a, b, whole))
    paragraphs: list[list[str]] = [[]]
    at = -1
    carried = False
    for k in page.body:
        if at >= 0 and any(not page.lines[j].strip() for j in range(at + 1, k)):
            paragraphs.append([])
        line = page.lines[k]
        broken = False
        for kind, a, b, whole in sorted(by_line.get(k, ()), key=lambda x: -x[1]):
            line = line[:a] + whole + line[b:]
            broken |= kind == "hyphenation"
        line = line.strip()
        if carried and (m := _TOKEN.match(line)):
            line, rest = "", line[m.end() :]
            if paragraphs[-1]:
                paragraphs[-1][-1] += re.match(r"\S*", rest)[0]
            line = re.sub(r"^\S*\s*", "", rest)
        if line:
            paragraphs[-1].append(re.sub(r"[ \t]+", " ", line))
        carried = broken
        at = k
    return "\n\n".join(" ".join(p) for p in paragraphs if p)
