"""The registered queries of the core and the SQL that each is compared with.

Chunks and chats are delivered twice in part; every query counts an id once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import vector as V
from lodestrata.operators import building, chunking, code, graph, history, indexing, intents, retrieval, rewriting, shaping, textsearch, timeseries
from lodestrata.plans import packs
from lodestrata.session import ensure_checkpoint_dir, table
from lodestrata.sources import corpus
from lodestrata.streaming import refresh

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def chunks(s: SparkSession, d: str, *columns: str, where: Column | str = "true") -> DataFrame:
    """The chunk rows with the given columns that pass ``where``, an id once; the filter comes first and reaches the scan."""
    return table(s, d, "chunk").filter(where).select("id", *columns).dropDuplicates(["id"])


def chunk_rows(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The chunk rows as delivered, for operators that count an id once themselves."""
    return table(s, d, "chunk").select("id", *columns)


def query_vector(s: SparkSession, d: str, vec_id: int = 0) -> DataFrame:
    return table(s, d, "embeddings").filter(F.col("vec_id") == vec_id).select(F.col("embedding").alias("qv"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# SQL fragments
WS = T.WS.replace(r"\t-\r", r"\t\n\x0b\f\r")
C = "c AS (SELECT DISTINCT ON (id) * FROM chunk)"
OK = "embeddings IS NOT NULL AND len(embeddings) = 64 AND len(list_filter(embeddings, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0"
DIST = f"q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), {C}, k AS (SELECT c.*, 1 - list_cosine_similarity(c.embeddings::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM c, q WHERE {OK})"
SCORE = "CASE WHEN distance IS NULL THEN 0 WHEN distance BETWEEN 0 AND 1 THEN 1 - distance ELSE 1 / (1 + greatest(0, distance)) END"
LINES = r"string_split_regex(coalesce({0}, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]')"


def lines_sql(c: str) -> str:
    """Python's splitlines in SQL."""
    x = LINES.format(c)
    return f"(CASE WHEN {x}[-1] = '' THEN {x}[:-2] ELSE {x} END)"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{WS}+', ' ', 'g'))"


# --- vectors and retrieval -------------------------------------------------------------------------------------


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Filtered top-k retrieval with threshold over the chunk table."""
    rows = chunk_rows(s, d, "embeddings", "file_ext", "lang")
    near = retrieval.nearest(rows, query_vector(s, d), "embeddings", "id", 8, where={"file_ext": {"$in": [".md", ".txt", ".pdf"]}})
    return near.select("id", "file_ext", r6("distance").alias("distance"), r6(V.score_from_distance(F.col("distance"))).alias("score"))


@query(f"WITH {DIST} SELECT id, round(distance, 6) AS distance FROM k ORDER BY k.distance, id LIMIT 10")
def knn_topk(s, d):
    return retrieval.nearest(chunk_rows(s, d, "embeddings"), query_vector(s, d), "embeddings", "id", 10).select("id", r6("distance").alias("distance"))


@query(f"WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), {C} SELECT id, round(list_sum(list_transform(list_zip(c.embeddings::DOUBLE[], q.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM c, q WHERE {OK} ORDER BY 2, 1 LIMIT 10")
def knn_l2(s, d):
    return retrieval.nearest(chunk_rows(s, d, "embeddings"), query_vector(s, d), "embeddings", "id", 10, metric="l2sq").select("id", r6("distance").alias("distance"))


@query(f"WITH {DIST} SELECT id, round(distance, 6) AS distance, round({SCORE}, 6) AS score FROM k")
def score_from_distance(s, d):
    k = retrieval.distances(chunk_rows(s, d, "embeddings"), query_vector(s, d), "embeddings", 64).dropDuplicates(["id"])
    return k.select("id", r6("distance").alias("distance"), r6(V.score_from_distance(F.col("distance"))).alias("score"))


@query("WITH h AS (SELECT DISTINCT * FROM hits) SELECT chat_id, hit_no, id, round(coalesce(" + SCORE + ", 0), 6) AS score FROM h WHERE distance IS NULL OR distance >= 0")
def score_hits(s, d):
    h = table(s, d, "hits").distinct().filter("distance IS NULL OR distance >= 0")
    return h.select("chat_id", "hit_no", "id", r6(V.score_from_distance(F.col("distance"))).alias("score"))


@query(f"WITH {DIST} SELECT id, file_ext, lang, round(distance, 6) AS distance, round({SCORE}, 6) AS score FROM k WHERE file_ext IN ('.md', '.txt') AND lang = 'de' ORDER BY k.distance, id LIMIT 8")
def retrieve_where(s, d):
    where = {"$and": [{"file_ext": {"$in": [".md", ".txt"]}}, {"lang": "de"}]}
    near = retrieval.nearest(chunk_rows(s, d, "embeddings", "file_ext", "lang"), query_vector(s, d), "embeddings", "id", 8, where=where)
    return near.select("id", "file_ext", "lang", r6("distance").alias("distance"), r6(V.score_from_distance(F.col("distance"))).alias("score"))


@query(f"WITH {DIST} SELECT id, round(distance, 6) AS distance, round({SCORE}, 6) AS score FROM k WHERE {SCORE} >= 0.35")
def retrieve_threshold(s, d):
    k = retrieval.distances(chunk_rows(s, d, "embeddings"), query_vector(s, d), "embeddings", 64).dropDuplicates(["id"])
    k = k.withColumn("score", V.score_from_distance(F.col("distance"))).filter("score >= 0.35")
    return k.select("id", r6("distance").alias("distance"), r6("score").alias("score"))


_FILE = "(lower(coalesce(file_path, '')) LIKE '%work_journal.txt%')"
_SYMB = "(contains(lower(coalesce(name, '')), 'journal') OR contains(lower(coalesce(array_to_string(symbols, ' '), '')), 'journal') OR contains(lower(coalesce(document, '')), 'def journal') OR contains(lower(coalesce(document, '')), 'class journal') OR contains(lower(coalesce(document, '')), 'journal('))"


@query(f"WITH {DIST} SELECT id, round({SCORE}, 6) AS base_score, round(({SCORE}) * 1.2, 6) AS score FROM (SELECT * FROM k ORDER BY distance, id LIMIT 400) WHERE {_FILE}")
def boost_filename(s, d):
    rows = chunk_rows(s, d, "embeddings", "file_path", "relpath")
    wide = retrieval.nearest(rows, query_vector(s, d), "embeddings", "id", 400).filter(retrieval.mentions_file(retrieval.file_candidates("see 'work_journal.txt'")))
    sc = V.score_from_distance(F.col("distance"))
    return wide.select("id", r6(sc).alias("base_score"), r6(sc * 1.2).alias("score"))


@query(f"WITH {DIST} SELECT id, round({SCORE}, 6) AS base_score, round(({SCORE}) * 1.3, 6) AS score FROM (SELECT * FROM k ORDER BY distance, id LIMIT 400) WHERE {_SYMB}")
def boost_symbol(s, d):
    rows = chunk_rows(s, d, "embeddings", "name", "symbols", "document")
    wide = retrieval.nearest(rows, query_vector(s, d), "embeddings", "id", 400).filter(retrieval.mentions_symbol(retrieval.symbol_candidates("what does Journal do")))
    sc = V.score_from_distance(F.col("distance"))
    return wide.select("id", r6(sc).alias("base_score"), r6(sc * 1.3).alias("score"))


@query(
    f"""WITH {DIST}, b AS (SELECT id, distance, 1.0 AS f FROM k WHERE file_ext IN ('.md', '.txt') ORDER BY distance, id LIMIT 8),
    w1 AS (SELECT id, distance, 1.2 AS f FROM (SELECT * FROM k ORDER BY distance, id LIMIT 16) WHERE {_FILE}),
    w2 AS (SELECT id, distance, 1.3 AS f FROM (SELECT * FROM k ORDER BY distance, id LIMIT 48) WHERE {_SYMB}),
    m AS (SELECT id, min(distance) AS distance, max(f) AS f FROM (SELECT * FROM b UNION ALL SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY id),
    s AS (SELECT id, distance, {SCORE} AS base, ({SCORE}) * f AS score, f > 1 AS boosted FROM m),
    r AS (SELECT *, max(boosted::INT) OVER () AS fired FROM s WHERE score >= 0.2),
    o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN fired > 0 THEN -score ELSE distance END, distance, id) AS rank FROM r)
    SELECT id, rank, round(score, 6) AS score, boosted FROM o WHERE rank <= 8"""
)
def retrieve_full(s, d):
    rows = chunk_rows(s, d, "embeddings", "file_ext", "file_path", "relpath", "name", "symbols", "document")
    out = retrieval.retrieve(
        rows, query_vector(s, d), "embeddings", "id", 8, where={"file_ext": {"$in": [".md", ".txt"]}}, min_score=0.2,
        files=retrieval.file_candidates("'work_journal.txt'"), symbols=retrieval.symbol_candidates("about Journal"),
    )
    return out.select("id", "rank", r6("score").alias("score"), "boosted")


@query(f"WITH {DIST}, b AS (SELECT id, {SCORE} AS score FROM (SELECT * FROM k ORDER BY distance, id LIMIT 50)), e AS (SELECT id, max(score) * 1.15 AS score FROM hits WHERE id IS NOT NULL AND score IS NOT NULL GROUP BY id) SELECT id, round(max(score), 9) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM e) GROUP BY id")
def merge_by_id(s, d):
    near = retrieval.nearest(chunk_rows(s, d, "embeddings"), query_vector(s, d), "embeddings", "id", 50).select("id", V.score_from_distance(F.col("distance")).alias("score"))
    extra = table(s, d, "hits").filter("score IS NOT NULL").groupBy("id").agg(F.max("score").alias("score"))
    return retrieval.merge_best(near, extra, "id").select("id", F.round("score", 9).alias("score"))


def _hit_chunks(s, d):
    """Hits with their chunks' metadata: a third of the hits may be of one chunk, so hits are made distinct first and chunks are unique."""
    h = table(s, d, "hits").filter("id IS NOT NULL").distinct()
    return h.join(chunks(s, d, "file_path", "relpath", "profile", "chunk_type"), "id")


_HIT_CHUNKS = f"{C}, h AS (SELECT DISTINCT * FROM hits WHERE id IS NOT NULL), hc AS (SELECT h.*, c.file_path, c.relpath, c.profile, c.chunk_type FROM h JOIN c USING (id))"
_BUCKETS = f"""{_HIT_CHUNKS}, sim AS (SELECT *, CASE WHEN coalesce(score, 0) <> 0 THEN score ELSE coalesce({SCORE}, 0) END AS sim,
    lower(coalesce(nullif(file_path, ''), relpath, '')) AS p, lower(coalesce(profile, '')) AS prof FROM hc),
  e AS (SELECT *, CASE WHEN contains(p, '.') THEN '.' || split_part(p, '.', -1) ELSE '' END AS ext FROM sim),
  kd AS (SELECT *, CASE WHEN prof = 'code' OR ext IN ('.py','.js','.jsx','.ts','.tsx','.java','.go','.rs','.cpp','.c') THEN 'code'
    WHEN prof = 'document' OR ext IN ('.pdf','.md','.txt','.docx','.rst') OR coalesce(starts_with(chunk_type, 'pdf'), false) THEN 'document'
    WHEN ext IN ('.csv','.xlsx','.tsv') THEN 'tabular' ELSE 'rest' END AS kind FROM e),
  bs AS (SELECT chat_id, sum(CASE WHEN kind = 'code' THEN sim ELSE 0 END) AS code, sum(CASE WHEN kind = 'document' THEN sim WHEN kind = 'rest' THEN 0.5 * sim ELSE 0 END) AS document, sum(CASE WHEN kind = 'tabular' THEN sim ELSE 0 END) AS tabular FROM kd GROUP BY chat_id)"""


@query(f"WITH {_BUCKETS} SELECT chat_id, round(code, 6) AS code, round(document, 6) AS document, round(tabular, 6) AS tabular FROM bs")
def score_buckets(s, d):
    b = retrieval.bucket_scores(_hit_chunks(s, d), ["chat_id"])
    return b.select("chat_id", r6("code").alias("code"), r6("document").alias("document"), r6("tabular").alias("tabular"))


@query(f"WITH {_BUCKETS} SELECT chat_id, CASE WHEN tabular > greatest(code, document) * 1.2 AND tabular > 0.35 THEN 'tabular' WHEN code > document * 1.15 AND code > 0.25 THEN 'code' WHEN code > 0.3 AND document > 0.3 THEN 'hybrid' ELSE 'document' END AS route FROM bs")
def route_decide(s, d):
    return retrieval.decide_route(retrieval.bucket_scores(_hit_chunks(s, d), ["chat_id"])).select("chat_id", "route")


@query(
    """WITH h AS (SELECT chat_id, id, max(coalesce(score, 0)) AS score FROM hits WHERE id IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY score DESC, id) AS rn FROM h),
    n AS (SELECT chat_id, count(*) FILTER (WHERE score >= 0.55 AND rn <= 8) AS strict, count(*) FILTER (WHERE score >= 0.385 AND rn <= 16) AS relaxed FROM r GROUP BY chat_id)
    SELECT r.chat_id, r.id, r.rn::BIGINT AS rank, strict < 10 AND relaxed > strict AS relaxed FROM r JOIN n USING (chat_id) WHERE CASE WHEN strict < 10 AND relaxed > strict THEN score >= 0.385 AND rn <= 16 ELSE score >= 0.55 AND rn <= 8 END"""
)
def route_relax(s, d):
    h = table(s, d, "hits").filter("id IS NOT NULL").groupBy("chat_id", "id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    return retrieval.relaxed(h, "chat_id", "id", 8, 0.55).select("chat_id", "id", F.col("rank").cast("long").alias("rank"), "relaxed")


@query(f"WITH {DIST}, t AS (SELECT *, {SCORE} AS s FROM (SELECT * FROM k ORDER BY distance, id LIMIT 40)) SELECT coalesce(file_path, relpath, '?') AS file, round(sum(s), 3) AS score FROM t GROUP BY 1 ORDER BY sum(s) DESC, 1 LIMIT 10")
def grounding_summary(s, d):
    top = retrieval.nearest(chunk_rows(s, d, "embeddings", "file_path", "relpath"), query_vector(s, d), "embeddings", "id", 40)
    g = top.groupBy(F.coalesce("file_path", "relpath", F.lit("?")).alias("file")).agg(F.sum(V.score_from_distance(F.col("distance"))).alias("s"))
    return g.orderBy(F.desc("s"), "file").limit(10).select("file", F.round("s", 3).alias("score"))


_THREE = f"""{C}, q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IN (0, 1, 2)), k AS (SELECT c.id, q.vec_id, 1 - list_cosine_similarity(c.embeddings::DOUBLE[], q.embedding::DOUBLE[]) AS distance FROM c, q WHERE {OK}),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, id) AS rn FROM k)"""


@query(f"WITH {_THREE}, t AS (SELECT * FROM r WHERE rn <= 20), f AS (SELECT id, min(vec_id * 1000 + rn) AS o FROM t GROUP BY id) SELECT t.id, t.vec_id AS first_query, round({SCORE}, 6) AS score FROM f JOIN t ON t.id = f.id AND t.vec_id * 1000 + t.rn = f.o")
def multi_query_dedupe(s, d):
    three = table(s, d, "embeddings").filter("vec_id IN (0, 1, 2)").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    lists = retrieval.nearest_of_each(chunk_rows(s, d, "embeddings"), three, "embeddings", "id", 20).withColumnRenamed("query", "first_query")
    first = retrieval.first_seen(lists, "id", ["first_query", "distance"])
    return first.select("id", F.col("first_query").cast("long").alias("first_query"), r6(V.score_from_distance(F.col("distance"))).alias("score"))


@query("WITH q AS (SELECT embedding AS qv FROM embeddings WHERE vec_id = 0), k AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], qv::DOUBLE[]) AS distance FROM embeddings, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rn FROM k) SELECT label, vec_id, rn FROM r WHERE rn <= 3")
def exemplars_topn(s, d):
    k = retrieval.distances(table(s, d, "embeddings"), query_vector(s, d), "embedding", 64)
    w = Window.partitionBy("label").orderBy("distance", "vec_id")
    return k.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("label", "vec_id", "rn")


@query(f"WITH {C}, v AS (SELECT id, embeddings::DOUBLE[] AS e FROM c WHERE {OK}), m AS (SELECT id, list_avg(e) AS mean, list_avg(list_transform(e, lambda x: x * x)) - list_avg(e) ^ 2 AS var FROM v) SELECT id, round(mean, 6) AS mean, round(var, 6) AS var, var >= 1e-12 AS valid FROM m")
def vector_guard(s, d):
    v = chunk_rows(s, d, "embeddings").filter(V.usable(F.col("embeddings"), 64))
    m, x = V.mean(F.col("embeddings")), V.variance(F.col("embeddings"))
    return v.select("id", r6(m).alias("mean"), r6(x).alias("var"), (x >= 1e-12).alias("valid")).dropDuplicates(["id"])


@query(f"WITH {DIST} SELECT id, round({SCORE} * CASE WHEN contains(lower(coalesce(chunk_type, '')), 'heading') THEN 1.15 ELSE 1.0 END * CASE WHEN contains(lower(coalesce(document, '')), 'general instruction') OR contains(lower(coalesce(document, '')), 'section a') THEN 1.1 ELSE 1.0 END, 6) AS score FROM k")
def rerank_heading(s, d):
    k = retrieval.distances(chunk_rows(s, d, "embeddings", "chunk_type", "document"), query_vector(s, d), "embeddings", 64)
    low = F.lower(F.coalesce("document", F.lit("")))
    f = F.when(F.lower(F.coalesce("chunk_type", F.lit(""))).contains("heading"), 1.15).otherwise(1.0) * F.when(low.contains("general instruction") | low.contains("section a"), 1.1).otherwise(1.0)
    return k.select("id", r6(V.score_from_distance(F.col("distance")) * f).alias("score")).dropDuplicates(["id"])


# --- shaping ---------------------------------------------------------------------------------------------------

_KIND = f"""CASE WHEN t IN ('', 'unknown') THEN
      CASE WHEN regexp_matches(h, '^(questions|exercises?|practice|problems)\\b') THEN 'questions' WHEN regexp_matches(h, '^(answers?|solutions?)\\b') THEN 'answers'
      WHEN regexp_matches(h, '^table\\s*\\d*') OR contains(header, '│') OR contains(header, '┼') THEN 'tables' WHEN regexp_matches(header, '^(chapter\\s*\\d+|[0-9]+\\s+[A-Z][^\\n]{{1,80}})$') OR regexp_matches(header, '^\\d+\\.\\d+(\\.\\d+)?\\s+') THEN 'topics'
      WHEN contains(h, 'page') THEN 'pages' ELSE 'other' END
    WHEN t IN ('chapter','section','subsection','paragraph','heading','title','intro','toc') THEN 'topics' WHEN t IN ('questions','question','qa','exercise','exercises','problems','practice') THEN 'questions'
    WHEN t IN ('answer','answers','solution','solutions','worked_solution') THEN 'answers' WHEN t IN ('table','tables','tabular','grid') THEN 'tables' WHEN t IN ('pdf_page','page') THEN 'pages' ELSE 'other' END"""
_SHAPED = f"""{C}, n AS (SELECT *, lower({strip_sql("coalesce(chunk_type, '')")}) AS t, coalesce(nullif({strip_sql("coalesce(name, '')")}, ''), {lines_sql("document")}[1], '') AS header FROM c),
  sh AS (SELECT *, {_KIND} AS bucket FROM (SELECT *, lower({strip_sql("header")}) AS h FROM n))"""


def _buckets(s, d, *columns):
    """``(id, columns, bucket)``, an id once; the texts stay where they are read."""
    b = shaping.inferred_bucket(F.col("chunk_type"), F.col("name"), F.col("document")).alias("bucket")
    return chunk_rows(s, d, *dict.fromkeys((*columns, "chunk_type", "name", "document"))).select("id", *columns, b).dropDuplicates(["id"])


@query(f"WITH {_SHAPED} SELECT id, bucket FROM sh")
def shape_buckets(s, d):
    return _buckets(s, d)


@query(f"WITH {C} SELECT id, book, chapter FROM c WHERE book = 'Optional Triangle Reader'")
def scope_filter(s, d):
    return chunks(s, d, "book", "chapter", where=shaping.in_scope(F.col("book"), F.col("chapter"), "Optional Triangle Reader", None, "book"))


@query(f"WITH {_SHAPED}, o AS (SELECT *, CASE bucket WHEN 'topics' THEN 0 WHEN 'questions' THEN 1 WHEN 'pages' THEN 2 ELSE 3 END AS p FROM sh), f AS (SELECT file_path, book, chapter, row_number() OVER (PARTITION BY file_path ORDER BY p, id) AS rn FROM o) SELECT file_path, book, chapter FROM f WHERE rn = 1")
def select_scope(s, d):
    c = _buckets(s, d, "file_path", "book", "chapter")
    b = F.col("bucket")
    p = F.when(b == "topics", 0).when(b == "questions", 1).when(b == "pages", 2).otherwise(3)
    first = c.groupBy("file_path").agg(F.min_by(F.struct("book", "chapter"), F.struct(p.alias("p"), F.col("id"))).alias("f"))
    return first.select("file_path", "f.book", "f.chapter")


@query(f"WITH {C}, o AS (SELECT id, lag(id) OVER w AS prev_chunk, lead(id) OVER w AS next_chunk FROM c WHERE char_start IS NOT NULL WINDOW w AS (PARTITION BY file_path, mtime ORDER BY coalesce(page_number, 0), char_start, id)) SELECT * FROM o")
def neighbors_id(s, d):
    c = chunks(s, d, "file_path", "mtime", "page_number", "char_start").filter("char_start IS NOT NULL").withColumn("page_number", F.coalesce("page_number", F.lit(0)))
    return shaping.siblings(c, ["file_path", "mtime"], ["page_number", "char_start", "id"]).select("id", "prev_chunk", "next_chunk")


_PAGE_FILE = "regexp_extract(id, '^(.*)::[^:]*$', 1)"


@query(
    f"""WITH {C}, p AS (SELECT id, {_PAGE_FILE} AS file, page_number FROM c WHERE page_number IS NOT NULL), seeds AS (SELECT p.* FROM p JOIN (SELECT DISTINCT id FROM hits) h USING (id)),
    j AS (SELECT s.id AS seed_id, p.id, p.page_number - s.page_number AS off FROM seeds s JOIN p ON p.file = s.file AND p.page_number BETWEEN s.page_number - 1 AND s.page_number + 1 WHERE p.id <> s.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY seed_id ORDER BY abs(off), off, id) AS rn FROM j) SELECT seed_id, id, off AS "offset" FROM r WHERE rn <= 4"""
)
def neighbors_page(s, d):
    c = chunks(s, d, "page_number").withColumn("file", F.regexp_extract("id", r"^(.*)::[^:]*$", 1)).filter("page_number IS NOT NULL")
    seeds = c.join(table(s, d, "hits").select("id").distinct(), "id", "left_semi")
    return shaping.page_neighbours(seeds, c, "file")


@query(
    f"""WITH {C}, w AS (SELECT coalesce(lang, '?') AS lang, len(list_filter(string_split_regex(coalesce(document, ''), '[\\t\\n\\x0b\\f\\r ]+'), lambda x: x <> '')) AS n, list_distinct(list_transform(regexp_extract_all(document, '(?i)\\b({shaping.VERBS})\\b', 1), lambda x: lower(x))) AS v,
      coalesce(regexp_matches(document, '\\\\frac|\\\\int|\\\\sum|\\$|²|³'), false) AS m FROM c)
    SELECT lang, floor(avg(n))::INT AS avg_len, coalesce(array_to_string(list_sort(list_distinct(flatten(list(v))))[1:10], ','), '') AS verbs, CASE WHEN bool_or(m) THEN 'latex_like' ELSE 'plain' END AS math_style FROM w GROUP BY lang"""
)
def style_profile(s, d):
    return shaping.style_profile(chunk_rows(s, d, "document", "lang").withColumn("lang", F.coalesce("lang", F.lit("?"))), "lang", "document", "id")


@query(f"WITH {_SHAPED} SELECT id, file_path, page_number, CASE WHEN length(document) <= 700 THEN document ELSE document[1:700] || '...(+' || (length(document) - 700)::VARCHAR || ' chars)' END AS text FROM sh WHERE bucket = 'tables' AND document IS NOT NULL")
def edu_pack(s, d):
    c = chunk_rows(s, d, "file_path", "page_number", "chunk_type", "name", "document").filter("document IS NOT NULL")
    t = c.filter(shaping.inferred_bucket(F.col("chunk_type"), F.col("name"), F.col("document")) == "tables")
    return t.select("id", "file_path", "page_number", T.snippet(F.col("document"), 700).alias("text")).dropDuplicates(["id"])


@query(f"WITH {C} SELECT id, '[' || concat_ws(', ', file_name, 'p.' || page_number::VARCHAR, chunk_type, 'L' || line_start::VARCHAR || '-' || line_end::VARCHAR) || ']' AS label FROM c")
def evidence_label(s, d):
    return chunks(s, d, "file_name", "page_number", "chunk_type", "line_start", "line_end").select("id", shaping.evidence_label("file_name").alias("label"))


@query(f"WITH {C}, h AS (SELECT DISTINCT chat_id, hit_no, id FROM hits WHERE id IS NOT NULL), o AS (SELECT chat_id, id, min(hit_no) AS hit_no FROM h GROUP BY 1, 2), j AS (SELECT o.*, c.document, row_number() OVER (PARTITION BY chat_id ORDER BY o.hit_no NULLS FIRST, o.id) AS pos FROM o JOIN c USING (id) WHERE {strip_sql('c.document')} <> '') SELECT chat_id, pos, id, {collapse_sql('document[1:400]')} AS text FROM j WHERE pos <= 128")
def evidence_block(s, d):
    h = table(s, d, "hits").filter("id IS NOT NULL").groupBy("chat_id", "id").agg(F.min("hit_no").alias("hit_no"))
    c = chunk_rows(s, d, "document").filter(T.strip(F.col("document")) != "").select("id", T.collapse(F.substring("document", 1, 400)).alias("text")).dropDuplicates(["id"])
    w = Window.partitionBy("chat_id").orderBy(F.asc_nulls_first("hit_no"), "id")
    return h.join(c, "id").withColumn("pos", F.row_number().over(w)).filter("pos <= 128").select("chat_id", "pos", "id", "text")


# --- chunking and indexing --------------------------------------------------------------------------------------


@query("WITH g AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 980)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, (i / 980)::INT + 1 AS seq, i AS char_start, least(n, i + 1100) AS char_end, sha1(text[i + 1 : i + 1100]) AS sha1 FROM g")
def chunk_text(s, d):
    w = chunking.text_windows(table(s, d, "documents").select("doc_id", "text"), "text")
    return w.select("doc_id", "seq", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), F.sha1("piece").alias("sha1"))


@query("WITH g AS (SELECT doc_id, length(text) AS n, unnest(range(0, greatest(0, length(text) - 1100) + 980, 980)) AS i FROM documents WHERE length(text) > 0) SELECT doc_id, (i / 980)::INT + 1 AS seq, i AS char_start, least(n, i + 1100) AS char_end FROM g")
def chunk_semantic(s, d):
    docs = table(s, d, "documents").select("doc_id", "text").filter(F.length("text") > 0)
    w = chunking.stopping_windows(docs, F.length("text"), 1100, 120)
    return w.select("doc_id", "seq", F.col("start").cast("long").alias("char_start"), F.col("end").cast("long").alias("char_end"))


@query(f"WITH l AS (SELECT doc_id, len({lines_sql('text')}) AS n FROM documents), g AS (SELECT doc_id, n, unnest(range(0, greatest(0, n - 20) + 15, 15)) AS i FROM l WHERE n > 0) SELECT doc_id, (i / 15)::INT + 1 AS seq, i + 1 AS line_start, least(n, i + 20) AS line_end FROM g")
def chunk_lines(s, d):
    w = chunking.line_windows(table(s, d, "documents").select("doc_id", "text"), "text", 20, 5)
    return w.select("doc_id", "seq", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


_PAGES = f"{C}, p AS (SELECT id, {_PAGE_FILE} AS file, page_number, document FROM c WHERE lower(trim(chunk_type)) = 'pdf_page' AND document IS NOT NULL)"
_SPLIT = f"list_filter(list_transform(string_split_regex({strip_sql('document')}, '\\n[\\t\\n\\x0b\\f\\r ]*\\n'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


def _pages(s, d):
    """The pages as delivered; what is made of them is counted once by id, when it is narrow."""
    c = chunk_rows(s, d, "chunk_type", "page_number", "document").filter((F.lower(F.trim("chunk_type")) == "pdf_page") & F.col("document").isNotNull())
    return c.select("id", F.regexp_extract("id", r"^(.*)::[^:]*$", 1).alias("file"), "page_number", "document")


@query(f"WITH {_PAGES} SELECT file, page_number, id, length(document[1:16000]) AS n FROM p WHERE {strip_sql('document')} <> ''")
def pdf_pages(s, d):
    return _pages(s, d).filter(T.strip(F.col("document")) != "").select("file", "page_number", "id", F.length(T.truncate(F.col("document"), 16000)).cast("long").alias("n")).dropDuplicates(["id"])


@query(f"WITH {_PAGES}, b AS (SELECT id, {_SPLIT} AS bl FROM p) SELECT id, unnest(range(1, len(bl) + 1)) AS block_no, sha1(unnest(bl)) AS sha1 FROM b")
def split_blocks(s, d):
    return chunking.blocks(_pages(s, d), "document").select("id", F.col("block_no").cast("long").alias("block_no"), F.sha1("block").alias("sha1")).dropDuplicates(["id", "block_no"])


_BLOCK_KIND = f"CASE WHEN regexp_matches(lower({strip_sql('l[1]')}), '^(questions?|exercises?|practice|problems?)\\b') THEN 'questions' WHEN regexp_matches(lower({strip_sql('l[1]')}), '^(answers?|solutions?)\\b') THEN 'answers' WHEN len(list_filter(l, lambda x: length(x) - length(replace(x, '|', '')) >= 2 OR contains(x, chr(9)))) >= 2 THEN 'table' WHEN len(l) = 1 AND length({strip_sql('b')}) BETWEEN 2 AND 80 THEN 'heading' ELSE 'para' END"


@query(f"WITH {_PAGES}, b AS (SELECT id, unnest({_SPLIT}) AS b FROM p), l AS (SELECT id, b, {lines_sql('b')} AS l FROM b) SELECT {_BLOCK_KIND} AS kind, count(*) AS n, sum(length(b))::BIGINT AS chars FROM l GROUP BY 1")
def classify_block(s, d):
    b = chunking.blocks(_pages(s, d), "document").select("id", "block_no", chunking.block_kind(F.col("block")).alias("kind"), F.length("block").alias("n")).dropDuplicates(["id", "block_no"])
    return b.groupBy("kind").agg(F.count("*").alias("n"), F.sum("n").alias("chars")).select("kind", "n", "chars")


@query(f"WITH {_PAGES}, b AS (SELECT id, {_SPLIT} AS bl FROM p), e AS (SELECT id, unnest(range(1, len(bl) + 1)) AS block_no, unnest(bl) AS b FROM b), g AS (SELECT id, block_no, b, length(b) AS n, unnest(range(0, greatest(0, length(b) - 1100) + 980, 980)) AS i FROM e) SELECT id, block_no, (i / 980)::INT + 1 AS seq, i AS char_start, least(n, i + 1100) AS char_end FROM g")
def pdf_blocks(s, d):
    b = chunking.blocks(_pages(s, d), "document").select("id", F.col("block_no").cast("long").alias("block_no"), F.length("block").alias("n")).dropDuplicates(["id", "block_no"])
    w = chunking.stopping_windows(b, F.col("n"), 1100, 120)
    return w.select("id", "block_no", "seq", F.col("start").cast("long").alias("char_start"), F.col("end").cast("long").alias("char_end"))


_F = f"{_PAGES}, l AS (SELECT *, {lines_sql('document')} AS l FROM p), f AS (SELECT *, list_filter(list_transform(l, lambda x: {strip_sql('x')}), lambda x: x <> '') AS full_ FROM l), n AS (SELECT file, count(*) AS pages FROM f GROUP BY file)"


@query(
    f"""WITH {_F}, a AS (SELECT file, full_[1] AS x, count(*) AS n FROM f WHERE len(full_) > 0 GROUP BY 1, 2), z AS (SELECT file, full_[-1] AS x, count(*) AS n FROM f WHERE len(full_) > 0 GROUP BY 1, 2),
    ra AS (SELECT file, x FROM a JOIN n USING (file) WHERE a.n >= greatest(3, floor(pages * 0.6))), rz AS (SELECT file, x FROM z JOIN n USING (file) WHERE z.n >= greatest(3, floor(pages * 0.6))),
    j AS (SELECT f.id, f.l, ra.x IS NOT NULL AS da, rz.x IS NOT NULL AS dz FROM f LEFT JOIN ra ON ra.file = f.file AND ra.x = {strip_sql('f.l[1]')} LEFT JOIN rz ON rz.file = f.file AND rz.x = {strip_sql('f.l[-1]')})
    SELECT id, coalesce(array_to_string(l[CASE WHEN da THEN 2 ELSE 1 END : len(l) - CASE WHEN dz THEN 1 ELSE 0 END], chr(10)), '') AS cleaned FROM j"""
)
def dedupe_headers(s, d):
    return chunking.repeated_edges(_pages(s, d).dropDuplicates(["id"]), "file", "page_number", "document").select("id", "cleaned")


@query(f"WITH {_PAGES} SELECT id, sha1(regexp_replace(regexp_replace(replace(replace(regexp_replace(document, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g')) AS sha1 FROM p")
def dehyphenate(s, d):
    return _pages(s, d).select("id", F.sha1(T.dehyphenate(F.col("document"))).alias("sha1")).dropDuplicates(["id"])


@query(f"SELECT doc_id, sha1({collapse_sql('text')}) AS sha1, length({collapse_sql('text')}) AS n FROM documents")
def clean_text(s, d):
    c = T.collapse(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.sha1(c).alias("sha1"), F.length(c).cast("long").alias("n"))


@query(f"SELECT coalesce(lang, '?') AS lang, count(*) AS n FROM documents WHERE length({strip_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) >= 8 AND regexp_matches(text, '[A-Za-z0-9]') GROUP BY 1")
def filter_meaningful(s, d):
    return table(s, d, "documents").filter(T.is_meaningful(F.col("text"))).groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("n"))


@query(f"WITH {C} SELECT id, length(document[1:4000]) AS n, length(document) > 4000 AS truncated FROM c WHERE document IS NOT NULL")
def truncate_text(s, d):
    c = chunk_rows(s, d, "document").filter("document IS NOT NULL")
    return c.select("id", F.length(T.truncate(F.col("document"), 4000)).cast("long").alias("n"), (F.length("document") > 4000).alias("truncated")).dropDuplicates(["id"])


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE text[1:300] || '...(+' || (length(text) - 300)::VARCHAR || ' chars)' END AS snippet FROM documents WHERE text IS NOT NULL")
def snippet(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", T.snippet(F.col("text"), 300).alias("snippet"))


_KEY_ORDER = "coalesce(page_number, 0), coalesce(line_start, 0), coalesce(char_start, 0), id"


@query(f"WITH {C}, k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(relpath, file_path), mtime ORDER BY {_KEY_ORDER}) AS seq FROM c) SELECT id, profile || '-' || sha1(profile)[1:8] || '::' || coalesce(relpath, file_path) || '::' || mtime::VARCHAR || '::' || seq::VARCHAR AS key FROM k")
def chunk_rekey(s, d):
    c = chunks(s, d, "relpath", "file_path", "mtime", "page_number", "line_start", "char_start", "profile").withColumn("relpath", F.coalesce("relpath", "file_path"))
    order = [F.coalesce("page_number", F.lit(0)), F.coalesce("line_start", F.lit(0)), F.coalesce("char_start", F.lit(0)), F.col("id")]
    return indexing.chunk_keys(c, F.col("profile"), order).select("id", "key")


@query(f"WITH {C} SELECT id, sha1(concat_ws(':', coalesce(relpath, file_path), coalesce(line_start, char_start, page_number)::VARCHAR, coalesce(line_end, char_end, page_number)::VARCHAR, name)) AS sha1 FROM c")
def chunk_sha(s, d):
    c = chunks(s, d, "relpath", "file_path", "line_start", "line_end", "char_start", "char_end", "page_number", "name")
    parts = F.concat_ws(":", F.coalesce("relpath", "file_path"), F.coalesce("line_start", "char_start", "page_number").cast("string"), F.coalesce("line_end", "char_end", "page_number").cast("string"), "name")
    return c.select("id", F.sha1(parts).alias("sha1"))


@query(f"WITH {C} SELECT id, to_json(symbols)::VARCHAR AS symbols FROM c WHERE symbols IS NOT NULL")
def meta_json(s, d):
    return chunks(s, d, "symbols").filter("symbols IS NOT NULL").select("id", F.to_json("symbols").alias("symbols"))


@query(f"WITH m AS (SELECT doc_id, lower(trim(source)) AS source, {collapse_sql('text')} AS t FROM documents WHERE source IS NOT NULL), k AS (SELECT source, doc_id, unnest(range(0, length(t), 980)) AS i, t FROM m WHERE length(t) >= 8 AND regexp_matches(t, '[A-Za-z0-9]')), p AS (SELECT source, doc_id, t[i + 1 : i + 1100] AS piece FROM k) SELECT source, count(DISTINCT doc_id) AS files, count(*) AS chunks, sum(length(piece))::BIGINT AS chars FROM p GROUP BY source")
def index_build(s, d):
    docs = table(s, d, "documents").filter("source IS NOT NULL").select("doc_id", F.lower(F.trim("source")).alias("source"), T.collapse(F.col("text")).alias("t"))
    w = chunking.text_windows(docs.filter(T.is_meaningful(F.col("t"))), "t").select("source", "doc_id", "seq", F.length("piece").alias("n"))
    per = w.groupBy("source", "doc_id").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    return per.groupBy("source").agg(F.count("*").alias("files"), F.sum("c").alias("chunks"), F.sum("n").alias("chars"))


_FILES = f"""fl AS (SELECT project, relpath, floor(epoch(updated_at))::BIGINT AS mtime, text FROM documents WHERE relpath IS NOT NULL UNION ALL SELECT profile, id || '.py', mtime, document FROM (SELECT DISTINCT ON (id) * FROM chunk) WHERE file_ext = '.py'),
  mf AS (SELECT *, {collapse_sql('text')} AS t, {lines_sql('text')} AS l FROM fl WHERE length({strip_sql("coalesce(text, '')")}) >= 8 AND regexp_matches(text, '[A-Za-z0-9]')),
  ck AS (SELECT project, relpath, mtime, 'text' AS chunk_type, unnest(range(0, length(t), 980)) AS i, t, NULL AS l FROM mf WHERE NOT ends_with(relpath, '.py') UNION ALL SELECT project, relpath, mtime, 'code', unnest(range(0, greatest(0, len(l) - 120) + 100, 100)), NULL, l FROM mf WHERE ends_with(relpath, '.py')),
  cf AS (SELECT *, (CASE WHEN chunk_type = 'text' THEN i / 980 ELSE i / 100 END)::INT + 1 AS seq, CASE WHEN chunk_type = 'text' THEN t[i + 1 : i + 1100] ELSE array_to_string(l[i + 1 : i + 120], chr(10)) END AS document FROM ck)"""


def _files(s, d):
    """Documents, and code windows as files of their own."""
    docs = table(s, d, "documents").filter("relpath IS NOT NULL").select("project", "relpath", F.unix_timestamp(F.col("updated_at").cast("timestamp")).alias("mtime"), "text")
    code_ = chunks(s, d, "profile", "mtime", "document", where="file_ext = '.py'").select(F.col("profile").alias("project"), F.concat("id", F.lit(".py")).alias("relpath"), "mtime", F.col("document").alias("text"))
    return docs.unionByName(code_)


@query(f"WITH {_FILES} SELECT relpath, chunk_type, seq, coalesce(project, '-') || '-' || sha1(coalesce(project, '-'))[1:8] || '::' || concat_ws('::', relpath, mtime::VARCHAR, seq::VARCHAR) AS key, sha1(document) AS sha1 FROM cf")
def index_chunks(s, d):
    key = building.file_key(F.coalesce("project", F.lit("-")), F.col("relpath"), F.col("mtime"), F.col("seq"))
    return building.chunk_files(_files(s, d)).select("relpath", "chunk_type", "seq", key.alias("key"), F.sha1("document").alias("sha1"))


@query(f"WITH {_FILES} SELECT chunk_type, count(DISTINCT relpath) AS files, count(*) AS chunks, count(*) FILTER (WHERE regexp_matches(document, '[\\p{{L}}\\p{{N}}_]')) AS with_vector FROM cf GROUP BY 1")
def index_embed(s, d):
    """The whole way from files to chunks with vectors, summed up."""
    v = building.embedded(building.chunk_files(_files(s, d)).select("relpath", "chunk_type", "document"), "document", building.hashed_words(64), 64)
    per = v.select("relpath", "chunk_type", F.exists("embeddings", lambda x: x != 0).alias("has")).groupBy("relpath", "chunk_type").agg(F.count("*").alias("n"), F.count_if("has").alias("w"))
    return per.groupBy("chunk_type").agg(F.count("*").alias("files"), F.sum("n").alias("chunks"), F.sum("w").alias("with_vector"))


@query(f"WITH {_FILES} SELECT relpath, mtime, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM fl")
def index_manifest(s, d):
    return building.manifest_of(_files(s, d))


@query(f"WITH {C} SELECT file_path, count(*) AS chunks, max(mtime) AS mtime, count(document) AS texts FROM c GROUP BY file_path")
def index_stats(s, d):
    return chunks(s, d, "file_path", "mtime", "document").groupBy("file_path").agg(F.count("*").alias("chunks"), F.max("mtime").alias("mtime"), F.count("document").alias("texts"))


_LATEST = "lm AS (SELECT relpath, max(mtime) AS mtime FROM manifest WHERE relpath IS NOT NULL GROUP BY relpath), m AS (SELECT lm.relpath, lm.mtime, max(x.size) AS size FROM lm JOIN manifest x ON x.relpath = lm.relpath AND x.mtime IS NOT DISTINCT FROM lm.mtime GROUP BY 1, 2)"
_OLDEST = "lo AS (SELECT relpath, min(mtime) AS mtime FROM manifest WHERE relpath IS NOT NULL AND mtime IS NOT NULL GROUP BY relpath), ol AS (SELECT lo.relpath, lo.mtime, min(x.size) AS size FROM lo JOIN manifest x ON x.relpath = lo.relpath AND x.mtime = lo.mtime GROUP BY 1, 2)"
_DELTA = f"{C}, {_LATEST}, {_OLDEST}, df AS (SELECT coalesce(m.relpath, ol.relpath) AS relpath, CASE WHEN ol.relpath IS NULL THEN 'added' WHEN m.relpath IS NULL THEN 'deleted' WHEN m.mtime IS DISTINCT FROM ol.mtime OR m.size IS DISTINCT FROM ol.size THEN 'changed' END AS status FROM m FULL JOIN ol ON m.relpath = ol.relpath)"


@query(f"WITH {_LATEST} SELECT * FROM m")
def manifest_latest(s, d):
    return indexing.latest_manifest(table(s, d, "manifest"))


def _difference(s, d):
    """From the oldest to the newest version of every file."""
    m = table(s, d, "manifest").filter("relpath IS NOT NULL AND mtime IS NOT NULL")
    oldest = m.groupBy("relpath").agg(F.min(F.struct("mtime", F.col("size").isNull().alias("n"), "size")).alias("b")).select("relpath", "b.mtime", "b.size")
    return indexing.manifest_difference(oldest, indexing.latest_manifest(table(s, d, "manifest")))


@query(f"WITH {_DELTA} SELECT relpath, status FROM df WHERE status IS NOT NULL")
def delta_diff(s, d):
    return _difference(s, d)


@query(f"WITH {_DELTA}, f AS (SELECT * FROM c WHERE file_ext <> '.pdf'), o AS (SELECT * FROM c WHERE file_path NOT IN (SELECT relpath FROM df WHERE status IN ('deleted', 'changed'))), a AS (SELECT id, file_path FROM o UNION ALL SELECT id, file_path FROM f WHERE file_path IN (SELECT relpath FROM df WHERE status IN ('added', 'changed'))) SELECT file_path, count(*) AS chunks FROM a GROUP BY 1")
def delta_apply(s, d):
    c = chunks(s, d, "file_path", "file_ext").withColumnRenamed("file_path", "relpath")
    out = indexing.apply_delta(c.select("id", "relpath"), _difference(s, d), c.filter("file_ext <> '.pdf'").select("id", "relpath"))
    return out.groupBy(F.col("relpath").alias("file_path")).agg(F.count("*").alias("chunks"))


@query(f"WITH {C}, f AS (SELECT id, upper(lang) AS lang FROM c WHERE file_ext = '.md' UNION ALL SELECT 'new::' || id, lang FROM c WHERE file_ext = '.py'), u AS (SELECT id, lang FROM c WHERE id NOT IN (SELECT id FROM f) UNION ALL SELECT * FROM f) SELECT lang, count(*) AS n FROM u GROUP BY lang")
def index_upsert(s, d):
    c = chunks(s, d, "lang", "file_ext")
    fresh = c.filter("file_ext = '.md'").select("id", F.upper("lang").alias("lang")).unionByName(c.filter("file_ext = '.py'").select(F.concat(F.lit("new::"), "id").alias("id"), "lang"))
    return indexing.upsert(c.select("id", "lang"), fresh).groupBy("lang").agg(F.count("*").alias("n"))


_PATHS = "f AS (SELECT DISTINCT relpath FROM manifest WHERE relpath IS NOT NULL)"


@query(f"WITH {_PATHS} SELECT relpath FROM f WHERE regexp_extract(lower(relpath), '[^/.][^/]*?(\\.[^./]*)$', 1) IN ('', '.py', '.md', '.txt', '.pdf') AND NOT list_has_any(string_split(relpath, '/'), ['tests', 'exports', 'node_modules', '.git']) AND split_part(relpath, '/', -1) <> 'work_journal.txt'")
def filter_corpus(s, d):
    f = table(s, d, "manifest").select("relpath").filter("relpath IS NOT NULL").distinct()
    return f.filter(corpus.should_index(F.col("relpath"), folders=("tests", "exports", "node_modules", ".git"), files=("work_journal.txt",)))


@query(f"WITH {_PATHS} SELECT split_part(relpath, '/', 1) AS top, regexp_extract(lower(relpath), '[^/.][^/]*?(\\.[^./]*)$', 1) AS ext, count(*) AS files FROM f GROUP BY 1, 2")
def scan_corpus(s, d):
    f = table(s, d, "manifest").select("relpath").filter("relpath IS NOT NULL").distinct()
    return f.groupBy(F.element_at(F.split("relpath", "/"), 1).alias("top"), T.extension(F.col("relpath")).alias("ext")).agg(F.count("*").alias("files"))


@query(f"WITH {_PATHS} SELECT relpath FROM f WHERE ends_with(relpath, '.py') AND starts_with(relpath, 'src/')")
def list_docs(s, d):
    return table(s, d, "manifest").select("relpath").filter(F.col("relpath").endswith(".py") & F.col("relpath").startswith("src/")).distinct()


@query(f"WITH {_PATHS}, {C}, h AS (SELECT DISTINCT file_name FROM c WHERE file_ext = '.py'), j AS (SELECT h.file_name, f.relpath, row_number() OVER (PARTITION BY h.file_name ORDER BY CASE WHEN f.relpath = h.file_name THEN 0 WHEN starts_with(f.relpath, 'src/') THEN 1 ELSE 2 END, length(f.relpath), f.relpath) AS rn FROM h JOIN f ON split_part(f.relpath, '/', -1) = h.file_name) SELECT file_name, relpath FROM j WHERE rn = 1")
def resolve_path(s, d):
    hints = table(s, d, "chunk").filter("file_ext = '.py'").select("file_name").distinct()
    f = table(s, d, "manifest").select("relpath").filter("relpath IS NOT NULL").distinct().withColumn("file_name", T.base_name(F.col("relpath")))
    prio = F.when(F.col("relpath") == F.col("file_name"), 0).when(F.col("relpath").startswith("src/"), 1).otherwise(2)
    best = F.min(F.struct(prio.alias("p"), F.length("relpath").alias("n"), "relpath")).alias("b")
    return hints.join(f, "file_name").groupBy("file_name").agg(best).select("file_name", "b.relpath")


_SPANS = f"""{C}, k AS (SELECT {_PAGE_FILE} AS file, line_start, {lines_sql('document')} AS l FROM c WHERE file_ext = '.py' AND line_start IS NOT NULL AND document IS NOT NULL),
  ln AS (SELECT file, unnest(range(line_start, line_start + len(l))) AS line_no, unnest(l) AS line FROM k), o AS (SELECT file, line_no, max(regexp_extract(line, '^(?:async[\\t ]+)?(def|class)[\\t ]+([A-Za-z_]\\w*)', 1)) AS word, max(regexp_extract(line, '^(?:async[\\t ]+)?(def|class)[\\t ]+([A-Za-z_]\\w*)', 2)) AS name
    FROM ln WHERE regexp_matches(line, '^[^\\t\\n\\x0b\\f\\r ]') AND NOT regexp_matches(line, '^[#)\\]}}]') GROUP BY 1, 2),
  la AS (SELECT file, max(line_start + len(l) - 1) AS last FROM k GROUP BY file), nx AS (SELECT *, lead(line_no) OVER (PARTITION BY file ORDER BY line_no) AS next FROM o),
  sp AS (SELECT file, CASE WHEN word = 'class' THEN 'class' ELSE 'function' END AS kind, name, line_no AS a, coalesce(next - 1, last) AS z FROM nx JOIN la USING (file) WHERE word <> ''),
  n AS (SELECT *, CASE WHEN a <= max(z) OVER w + 1 THEN 0 ELSE 1 END AS new_ FROM sp WINDOW w AS (PARTITION BY file ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  g AS (SELECT *, sum(new_) OVER (PARTITION BY file ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS grp FROM n), ms AS (SELECT file, min(a) AS line_start, max(z) AS line_end, count(*) AS parts FROM g GROUP BY file, grp)"""


def _spans(s, d):
    c = chunk_rows(s, d, "line_start", "file_ext", "document").filter("file_ext = '.py' AND line_start IS NOT NULL AND document IS NOT NULL")
    return code.line_spans(c.withColumn("file", F.regexp_extract("id", r"^(.*)::[^:]*$", 1)), "file", "document", "line_start")


@query(f"WITH {_SPANS} SELECT file, kind, name, a AS line_start, z AS line_end FROM sp")
def code_spans(s, d):
    return _spans(s, d).select("file", "kind", "name", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@query(f"WITH {_SPANS} SELECT * FROM ms")
def span_merge(s, d):
    m = chunking.merged_spans(_spans(s, d), "file")
    return m.select("file", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "parts")


@query(f"WITH {_SPANS}, b AS (SELECT *, lag(line_end) OVER (PARTITION BY file ORDER BY line_start) AS before FROM ms) SELECT file, before + 1 AS gap_start, line_start - 1 AS gap_end FROM b WHERE line_start > before + 1")
def uncovered_regions(s, d):
    return chunking.gaps(_spans(s, d), "file").select("file", F.col("gap_start").cast("long").alias("gap_start"), F.col("gap_end").cast("long").alias("gap_end"))


@query()
def keywordize(s, d):
    return history.unique_chats(table(s, d, "chats")).select("id", F.array_join(intents.keyword_queries(F.col("prompt")), " ; ").alias("queries"))


# --- text and code tools ------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({lines_sql('text')}) AS n_lines, coalesce(list_max(list_transform({lines_sql('text')}, lambda x: length(x))), 0) AS longest FROM documents")
def doc_lines(s, d):
    ln = T.split_lines(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(ln).cast("long").alias("n_lines"), F.coalesce(F.array_max(F.transform(ln, F.length)), F.lit(0)).cast("long").alias("longest"))


@query(f"WITH {C}, l AS (SELECT id, unnest(range(1, len({lines_sql('document')}) + 1)) AS line_no, unnest({lines_sql('document')}) AS line FROM c) SELECT id, line_no, regexp_replace(line, '[\\t\\n\\x0b\\f\\r ]+$', '') AS line FROM l WHERE contains(line, 'logger.debug(')")
def grep_literal(s, d):
    g = textsearch.grep(chunk_rows(s, d, "document"), "id", "document", "logger.debug(").dropDuplicates(["id", "line_no"])
    return g.select("id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"WITH {C}, l AS (SELECT id, unnest(range(1, len({lines_sql('document')}) + 1)) AS line_no, unnest({lines_sql('document')}) AS line FROM c) SELECT id, line_no, regexp_replace(line, '[\\t\\n\\x0b\\f\\r ]+$', '') AS line FROM l WHERE regexp_matches(line, '(?i)raise [a-z]+error')")
def grep_regex(s, d):
    g = textsearch.grep(chunk_rows(s, d, "document"), "id", "document", "raise [a-z]+error", regex=True, ignore_case=True).dropDuplicates(["id", "line_no"])
    return g.select("id", F.col("line_no").cast("long").alias("line_no"), "line")


@query(f"WITH {C}, l AS (SELECT file_path, id, unnest(range(1, len({lines_sql('document')}) + 1)) AS line_no, unnest({lines_sql('document')}) AS line FROM c), h AS (SELECT * FROM l WHERE contains(line, 'return None')), f AS (SELECT DISTINCT file_path FROM h ORDER BY file_path LIMIT 8), r AS (SELECT h.*, row_number() OVER (PARTITION BY h.file_path ORDER BY id, line_no) AS rn FROM h JOIN f USING (file_path)) SELECT file_path, id, line_no FROM r WHERE rn <= 10")
def grep_grouped(s, d):
    hit = textsearch.grep(chunk_rows(s, d, "document"), "id", "document", "return None").select("id", "line_no").dropDuplicates(["id", "line_no"])
    g = hit.join(chunks(s, d, "file_path", where=F.col("document").contains("return None")), "id")
    return textsearch.first_lines_by_file(g, "file_path", ["id", "line_no"], 10, 8).select("file_path", "id", F.col("line_no").cast("long").alias("line_no"))


@query(f"WITH {C}, a AS (SELECT id, {lines_sql('document')} AS l FROM c WHERE contains(document, 'raise ValueError')), p AS (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM a), h AS (SELECT * FROM p WHERE contains(l[i], 'raise ValueError')) SELECT id, i AS line_no, array_to_string(list_transform(range(greatest(1, i - 2), least(len(l), i + 2) + 1), lambda j: j::VARCHAR || ':' || l[j]), chr(10)) AS snippet FROM h")
def grep_context(s, d):
    g = textsearch.grep_context(chunk_rows(s, d, "document"), "id", "document", "raise ValueError").dropDuplicates(["id", "line_no"])
    return g.select("id", F.col("line_no").cast("long").alias("line_no"), "snippet")


_TERMS = ["session", "cache", "tabelle", "columna", "router", "session"]


@query("SELECT doc_id, s AS score FROM (SELECT doc_id, " + " + ".join(f"contains(lower(coalesce(text, '')), '{t}')::INT" for t in _TERMS) + " AS s FROM documents) WHERE s > 0 ORDER BY s DESC, doc_id LIMIT 200")
def scan_relevant(s, d):
    return textsearch.relevance(table(s, d, "documents"), "doc_id", "text", _TERMS).orderBy(F.desc("score"), "doc_id").limit(200)


@query(f"SELECT doc_id, s AS score FROM (SELECT doc_id, coalesce(list_sum(list_transform({lines_sql('text')}, lambda x: contains(lower(x), 'router')::INT + contains(lower(x), 'session')::INT)), 0)::INT AS s FROM documents) WHERE s > 0")
def scan_relevant_lines(s, d):
    return textsearch.line_relevance(table(s, d, "documents"), "doc_id", "text", ["router", "session"])


@query(f"SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, len({lines_sql('text')}) AS n_lines, coalesce(array_to_string({lines_sql('text')}[1:20], chr(10)), '')[1:2000] AS head, coalesce(array_to_string({lines_sql('text')}[greatest(1, len({lines_sql('text')}) - 19):], chr(10)), '')[1:2000] AS tail FROM documents")
def analyze_files(s, d):
    f = textsearch.file_statistics(table(s, d, "documents"), "doc_id", "text")
    return f.select("doc_id", F.col("bytes").cast("long").alias("bytes"), F.col("n_lines").cast("long").alias("n_lines"), "head", "tail")


@query(f"WITH {C} SELECT id, contains(document, 'TODO') AS has_todo, contains(document, 'json.loads(') AS has_json_loads, contains(document, 'open(') AS has_open_calls FROM c WHERE document IS NOT NULL")
def analyze_flags(s, d):
    c = chunk_rows(s, d, "document").filter("document IS NOT NULL")
    flags = {"has_todo": "TODO", "has_json_loads": "json.loads(", "has_open_calls": "open("}
    return c.select("id", *[F.col("document").contains(what).alias(name) for name, what in flags.items()]).dropDuplicates(["id"])


@query("WITH r AS (SELECT doc_id, len(regexp_extract_all(text, '(\\w+)_rows')) AS n, regexp_replace(text, '(\\w+)_rows', '\\1_lines', 'g') AS t FROM documents) SELECT doc_id, n::INT AS replacements, sha1(t) AS sha1 FROM r WHERE n > 0")
def replace_preview(s, d):
    r = textsearch.replace_preview(table(s, d, "documents"), "doc_id", "text", r"(\w+)_rows", "$1_lines", regex=True)
    return r.select("doc_id", "replacements", F.sha1("new_text").alias("sha1"))


@query("SELECT doc_id, 2 AS edits, sha1(replace(replace(text, 'session', 'visit'), 'visit', lang)) AS sha1 FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL")
def bulk_replace(s, d):
    docs = table(s, d, "documents").filter("lang IS NOT NULL AND text IS NOT NULL")
    pair = F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("session").alias("find"), F.lit("visit").alias("replacement")), F.struct(F.lit(2).alias("ord"), F.lit("visit").alias("find"), F.col("lang").alias("replacement"))))
    edits = docs.select("doc_id", pair.alias("e")).select("doc_id", "e.*")
    return textsearch.bulk_replace(docs, "doc_id", "text", edits).select("doc_id", "edits", F.sha1("new_text").alias("sha1"))


@query(f"WITH {C}, i AS (SELECT id, contains(document, 'open(') AND NOT contains(document, 'with open(') AS naive_open, contains(document, 'except:') OR contains(document, 'except Exception:') AS broad_except FROM c WHERE file_ext = '.py' AND document IS NOT NULL) SELECT * FROM i")
def detect_issues(s, d):
    return code.issues(chunk_rows(s, d, "file_ext", "document").filter("file_ext = '.py' AND document IS NOT NULL"), "id", "document", only=False).dropDuplicates(["id"])


_CALLS = f"""{C}, ln AS (SELECT id, unnest(range(1, len({lines_sql('document')}) + 1)) AS line_no, unnest({lines_sql('document')}) AS line FROM c WHERE file_ext = '.py' AND document IS NOT NULL),
  o AS (SELECT *, nullif(regexp_extract(line, '^[\\t\\n\\x0b\\f\\r ]*(?:async[\\t ]+)?def[\\t ]+([A-Za-z_]\\w*)', 1), '') AS own FROM ln), fu AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS func FROM o),
  ca AS (SELECT id, line_no, func, unnest(regexp_extract_all(line, '([A-Za-z_]\\w*)\\(', 1)) AS callee FROM fu WHERE own IS NULL AND func IS NOT NULL),
  calls AS (SELECT * FROM ca WHERE callee NOT IN ({", ".join(f"'{n}'" for n in code.NOISE)}) OR callee IN (SELECT own FROM o WHERE own IS NOT NULL))"""


def _calls(s, d):
    return code.line_calls(chunk_rows(s, d, "file_ext", "document").filter("file_ext = '.py' AND document IS NOT NULL"), "id", "document")


@query(f"WITH {_CALLS} SELECT func, callee, count(*) AS n FROM calls GROUP BY 1, 2")
def call_graph(s, d):
    return _calls(s, d).groupBy("func", "callee").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_CALLS}, e AS (SELECT DISTINCT func AS a, callee AS b FROM calls), st AS (SELECT DISTINCT a FROM e WHERE starts_with(a, 'rank_')), r(start, node, depth) AS (SELECT a, a, 0 FROM st UNION SELECT r.start, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 3) SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2")
def call_graph_reach(s, d):
    e = _calls(s, d).select("func", "callee").distinct()
    starts = e.filter(F.col("func").startswith("rank_")).select("func").distinct()
    return graph.reachable(e, starts, 3, "func", "callee")


@query(f"WITH {_CALLS} SELECT DISTINCT '\"' || func || '\" -> \"' || callee || '\";' AS edge FROM calls")
def call_graph_dot(s, d):
    return _calls(s, d).select("func", "callee").distinct().select(F.format_string('"%s" -> "%s";', "func", "callee").alias("edge"))


@query(
    f"""WITH l AS (SELECT file_path, unnest({lines_sql('document')}) AS line FROM chunk WHERE file_ext = '.py'), i AS (SELECT DISTINCT file_path, lower(regexp_extract(line, '^(?:import|from)[\\t ]+([A-Za-z_]\\w*)', 1)) AS package FROM l),
    p AS (SELECT DISTINCT package FROM i WHERE package <> ''), t AS (SELECT DISTINCT file_path AS other, package FROM chunk, p WHERE contains(lower(document), package))
    SELECT i.file_path, count(DISTINCT CASE WHEN t.other <> i.file_path THEN t.other END) AS related FROM i JOIN t USING (package) WHERE package <> '' GROUP BY 1"""
)
def related_files(s, d):
    return code.related_files(table(s, d, "chunk").select("file_path", "file_ext", "document"), "file_path", "document", "file_ext")


@query()
def code_structure(s, d):
    return code.structure(chunk_rows(s, d, "file_ext", "document").filter("file_ext = '.py' AND document IS NOT NULL"), "id", "document").dropDuplicates()


_TAIL = "(?s)\\b(?:in|under|inside|within)\\b\\s+([^\\n]*)"


@query(
    f"""WITH t AS (SELECT id, CASE WHEN regexp_matches(lower(prompt), '{_TAIL}') THEN regexp_extract(lower(prompt), '{_TAIL}', 1) ELSE lower(prompt) END AS t FROM (SELECT DISTINCT ON (id) id, prompt FROM chats)),
    w AS (SELECT id, regexp_replace(w, '^[/.]+|[/.]+$', '', 'g') AS w FROM (SELECT id, unnest(regexp_extract_all(t, '[a-z0-9_\\-/.]+')) AS w FROM t) WHERE w NOT IN ({", ".join(f"'{x}'" for x in code.FOLDER_STOP)})),
    p AS (SELECT DISTINCT string_split(relpath, '/') AS p FROM manifest WHERE relpath IS NOT NULL), g AS (SELECT p, unnest(range(1, len(p))) AS n FROM p), d AS (SELECT DISTINCT array_to_string(p[1:n], '/') AS dir FROM g),
    s AS (SELECT w.id, d.dir, sum(CASE WHEN list_contains(string_split(lower(d.dir), '/'), w.w) THEN 2 ELSE 1 END)::BIGINT AS score FROM w JOIN d ON contains(lower(d.dir), w.w) WHERE w.w <> '' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, dir) AS rn FROM s) SELECT id, dir, score FROM r WHERE rn = 1"""
)
def guess_dir(s, d):
    prompts = history.unique_chats(table(s, d, "chats").select("id", "prompt"))
    return code.guessed_folders(prompts, table(s, d, "manifest").select("relpath"), "id", "prompt", "relpath")


# --- history ------------------------------------------------------------------------------------------------------

H = "ch AS (SELECT DISTINCT ON (id) * FROM chats)"


def chats(s, d):
    return history.unique_chats(table(s, d, "chats"))


@query(f"WITH {H} SELECT id, ts, project FROM ch WHERE ts BETWEEN (SELECT floor(avg(ts) / 86400) * 86400 FROM ch) AND (SELECT floor(avg(ts) / 86400) * 86400 FROM ch) + 86399")
def history_range(s, d):
    c = chats(s, d).select("id", "ts", "project")
    day = c.agg((F.floor(F.avg("ts") / 86400) * 86400).alias("day"))
    return c.join(F.broadcast(day), F.col("ts").between(F.col("day"), F.col("day") + 86399.0)).select("id", "ts", "project")


_COLS5 = ("prompt", "answer", "mode", "model", "embedder")


@query(f"WITH {H} SELECT id, project FROM ch WHERE " + " OR ".join(f"coalesce({c} ILIKE '%merge%rows%', false)" for c in _COLS5))
def history_search_like(s, d):
    return history.search_like(chats(s, d), "merge%rows").select("id", "project")


@query(f"WITH {H} SELECT id, project FROM ch WHERE " + " OR ".join(f"coalesce(regexp_matches({c}, '(?i)merge_[a-z]+_rows'), false)" for c in _COLS5))
def history_search_regex(s, d):
    return history.search_regex(chats(s, d), "merge_[a-z]+_rows").select("id", "project")


@query(f"WITH {H} SELECT id, ts FROM ch ORDER BY ts DESC, id DESC LIMIT 25")
def history_top_n(s, d):
    return history.newest(chats(s, d), 25).select("id", "ts")


@query(f"WITH {H} SELECT id, ts FROM ch ORDER BY ts, id LIMIT 25")
def history_last_n(s, d):
    return history.oldest(chats(s, d), 25).select("id", "ts")


@query(f"WITH {H}, k AS (SELECT * FROM ch WHERE trim(coalesce(answer, '')) <> '' AND trim(coalesce(project, '')) <> '') SELECT id, 1000000 + row_number() OVER (ORDER BY ts, id) AS new_id, coalesce(model, '') AS model FROM k")
def history_append(s, d):
    return history.with_ids(1_000_000, history.appendable(chats(s, d)), ["ts", "id"]).select("id", "new_id", "model")


@query(f"WITH {H} SELECT id, project FROM ch WHERE answer IS NOT NULL")
def history_delete(s, d):
    all_chats = chats(s, d)
    return history.without(all_chats, all_chats.filter("answer IS NULL")).select("id", "project")


def _one_line_sql(c: str, n: int) -> str:
    x = collapse_sql(c)
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE {x}[1:{n - 1}] || '…' END"


@query(f"WITH {H} SELECT id, {_one_line_sql('prompt', 90)} AS prompt, {_one_line_sql('answer', 90)} AS answer FROM ch")
def history_preview(s, d):
    return chats(s, d).select("id", T.one_line(F.col("prompt")).alias("prompt"), T.one_line(F.col("answer")).alias("answer"))


@query(f"WITH {H} SELECT id, mode || ' / ' || coalesce(nullif(model, ''), '-') AS engine, coalesce(streaming, 0) = 1 AS viewed FROM ch")
def history_grid(s, d):
    return chats(s, d).select("id", F.concat("mode", F.lit(" / "), F.coalesce(F.nullif("model", F.lit("")), F.lit("-"))).alias("engine"), (F.coalesce("streaming", F.lit(0)) == 1).alias("viewed"))


@query(f"WITH {H}, l AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS turn FROM (SELECT * FROM ch ORDER BY ts DESC, id DESC LIMIT 10)), m AS (SELECT turn, 0 AS k, 'user' AS role, prompt AS content FROM l UNION ALL SELECT turn, 1, 'assistant', answer FROM l) SELECT (turn * 2 + k - 1)::BIGINT AS pos, role, content FROM m WHERE trim(coalesce(content, '')) <> ''")
def context_messages(s, d):
    return history.context_messages(chats(s, d), 10).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {H} SELECT id, sha1('## Chat ' || id::VARCHAR || chr(10) || chr(10) || '**Project:** ' || coalesce(project, '') || chr(10) || chr(10) || '**Prompt**' || chr(10) || chr(10) || coalesce(prompt, '') || chr(10) || chr(10) || '**Answer**' || chr(10) || chr(10) || regexp_replace(coalesce(answer, ''), '[\\t\\n\\x0b\\f\\r ]+$', '')) AS sha1 FROM ch")
def export_markdown(s, d):
    return history.markdown(chats(s, d)).select("id", F.sha1("section").alias("sha1"))


@query(f"WITH {H}, h AS (SELECT DISTINCT * FROM hits), {C}, f AS (SELECT h.chat_id, count(*) AS chunks, count(DISTINCT c.file_path) AS files FROM h LEFT JOIN c USING (id) GROUP BY 1) SELECT ch.mode, count(*) AS chats, sum(coalesce(f.chunks, 0))::BIGINT AS chunks, sum(coalesce(f.files, 0))::BIGINT AS files FROM ch LEFT JOIN f ON f.chat_id = ch.id GROUP BY ch.mode")
def rag_summary(s, d):
    h = table(s, d, "hits").distinct().join(chunks(s, d, "file_path"), "id", "left").groupBy("chat_id").agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("files"))
    j = chats(s, d).select("id", "mode").join(h, F.col("id") == F.col("chat_id"), "left")
    return j.groupBy("mode").agg(F.count("*").alias("chats"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def _case_sql(rules: tuple, column: str, otherwise: str) -> str:
    q = lambda w: "'" + w.replace("'", "''") + "'"
    parts = [f"WHEN {' OR '.join(f'contains({column}, {q(w)})' for w in words)} THEN {q(name)}" for name, words in rules]
    return f"CASE {' '.join(parts)} ELSE {otherwise} END"


_LOW = "lower(coalesce(prompt, ''))"


@query(f"WITH {H} SELECT id, {_case_sql(intents.GENERAL, _LOW, chr(39) + 'general' + chr(39))} AS intent FROM ch")
def intent_general(s, d):
    return chats(s, d).select("id", intents.general_intent(F.col("prompt")).alias("intent"))


@query(
    f"WITH {H} SELECT id, {_case_sql(intents.STUDY, _LOW, chr(39) + 'unknown' + chr(39))} AS intent, CASE WHEN regexp_extract(prompt, '\\b(\\d{{1,3}})\\b', 1) <> '' THEN greatest(1, least(200, regexp_extract(prompt, '\\b(\\d{{1,3}})\\b', 1)::INT)) END AS n, regexp_extract({_LOW}, '(chapter|ch\\.?)\\s*([0-9]{{1,3}})', 2) AS chapter, "
    + _case_sql((("hard", ("hard", "challenging", "advanced")), ("medium", ("medium", "moderate")), ("easy", ("easy", "beginner", "basic"))), _LOW, "'mixed'") + " AS difficulty FROM ch"
)
def intent_edu(s, d):
    p = F.col("prompt")
    return chats(s, d).select("id", intents.study_intent(p).alias("intent"), intents.study_count(p).alias("n"), intents.study_chapter(p).alias("chapter"), intents.study_difficulty(p).alias("difficulty"))


_REST = f"CASE WHEN (contains({_LOW}, 'list') OR contains({_LOW}, 'show')) AND contains({_LOW}, 'file') THEN 'list_files' WHEN (" + " OR ".join(f"contains({_LOW}, '{w}')" for w in ("search", "find", "grep", "look for", "scan")) + ") AND (" + " OR ".join(f"contains({_LOW}, '{w}')" for w in ("code", "function", "class", "def ", ".py", ".js", ".ts", ".jsx", ".tsx")) + ") THEN 'search_code' WHEN " + " OR ".join(f"contains({_LOW}, '{w}')" for w in ("read", "open", "show contents", "view file", "print file")) + " THEN 'read_file' ELSE 'none' END"


@query(f"WITH {H} SELECT id, {_case_sql(intents.TOOLS, _LOW, _REST)} AS tool FROM ch")
def intent_tool(s, d):
    return chats(s, d).select("id", intents.tool_for(F.col("prompt")).alias("tool"))


# --- time series ----------------------------------------------------------------------------------------------------


def _resample_sql(label: str, spine: str) -> str:
    return f"""WITH a AS (SELECT {label} AS bucket, avg(value) AS mean, sum(value) AS s, min(value) AS mn, max(value) AS mx, median(value) AS med, count(value) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
      e AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM a), sp AS ({spine})
      SELECT sp.bucket, round(mean, 6) AS mean, round(coalesce(s, 0), 4) AS sum, mn AS min, mx AS max, round(med, 6) AS median, coalesce(n, 0) AS n FROM sp LEFT JOIN a ON a.bucket = sp.bucket"""


def _resampled(s, d, freq):
    r = timeseries.resample(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", freq)
    return r.select("bucket", r6("mean").alias("mean"), F.round("sum", 4).alias("sum"), "min", "max", r6("median").alias("median"), "n")


@query(_resample_sql("ts::DATE", "SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS bucket FROM e"))
def resample_day(s, d):
    return _resampled(s, d, "D")


@query(_resample_sql("date_trunc('week', ts)::DATE + 6", "SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY))::DATE AS bucket FROM e"))
def resample_week(s, d):
    return _resampled(s, d, "W")


@query(_resample_sql("last_day(ts::DATE)", "SELECT last_day(unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH))::DATE) AS bucket FROM e"))
def resample_month(s, d):
    return _resampled(s, d, "M")


@query("WITH v AS (SELECT value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value)), e AS (SELECT min(v) AS lo, max(v) AS hi FROM v), b AS (SELECT least(29, floor((v - lo) / (hi - lo) * 30)::INT) AS bin FROM v, e) SELECT g.bin, count(b.bin) AS n FROM (SELECT unnest(range(30))::INT AS bin) g LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin")
def histogram(s, d):
    return timeseries.histogram(table(s, d, "events"), "value", 30)


@query("SELECT o_orderdate::DATE AS day, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def chart_series(s, d):
    return table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH m AS (SELECT last_day(o_orderdate::DATE) AS x, avg(o_orderkey) AS k, avg(o_custkey) AS c, avg(o_totalprice) AS p FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
      sp AS (SELECT last_day(unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders), (SELECT max(o_orderdate) FROM orders), INTERVAL 1 MONTH))::DATE) AS x)
      SELECT sp.x, s.series, round(CASE s.series WHEN 'o_orderkey' THEN k WHEN 'o_custkey' THEN c ELSE p END, 4) AS value
      FROM sp LEFT JOIN m ON m.x = sp.x, (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice')) s(series)""")
def chart_axes(s, d):
    return timeseries.series(table(s, d, "orders"), freq="M").withColumn("value", F.round("value", 4))


@query("SELECT event_type, (json_extract_string(props, '$.k'))::INT AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_records(s, d):
    e = corpus.json_records(table(s, d, "events").select("event_type", "props"), "props", "k: int")
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha1(" + collapse_sql("replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<noscript\\b.*?</noscript>', ' ', 'g'), '<[^<>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')") + ") AS sha1 FROM documents WHERE text IS NOT NULL")
def web_extract(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha1(T.strip_markup(F.col("text"))).alias("sha1"))


# --- extensions over the star schema -----------------------------------------------------------------------------------


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n FROM g GROUP BY user_id, g.g")
def ext_sessions(s, d):
    x = timeseries.sessions(table(s, d, "events"), "user_id", "ts", 3600)
    return x.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("WITH r AS (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT e.event_id, e.user_id, r.ts AS asof_ts, r.v AS asof_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts >= r.ts")
def ext_asof(s, d):
    e = table(s, d, "events")
    right = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return timeseries.asof_join(e.filter("event_type <> 'purchase'"), right, "user_id", "ts", "ts", "value", "event_id")


@query("WITH sp AS (SELECT p_partkey, p_retailprice AS lo, p_retailprice + 5 AS hi FROM part) SELECT p_partkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN sp ON c_acctbal >= lo AND c_acctbal < hi GROUP BY 1")
def ext_range_join(s, d):
    spans = table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    j = timeseries.range_join(table(s, d, "customer").select("c_acctbal"), spans, "c_acctbal", "lo", "hi", 50)
    return j.groupBy("p_partkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def ext_pricing_summary(s, d):
    li = table(s, d, "lineitem").filter("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1")
def ext_revenue_by_nation(s, d):
    nations = table(s, d, "nation").join(table(s, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    cust = table(s, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")  # 25 nations
    per_order = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = table(s, d, "orders").select("o_orderkey", "o_custkey").join(cust, F.col("o_custkey") == F.col("c_custkey"))
    return o.join(per_order, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def ext_semi_anti(s, d):
    o = table(s, d, "orders")
    c = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    c = c.join(o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return c.join(o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_cube(s, d):
    g = table(s, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return g.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), F.col("level").cast("long").alias("level"), "n", "total")


@query("SELECT p_brand, s_nationkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def ext_part_supplier(s, d):
    li = table(s, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey")
    j = li.join(table(s, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(table(s, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query()
def ext_approx_distinct(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.expr("percentile_approx(value, 0.9, 1000)").alias("p90"))


# --- streaming ------------------------------------------------------------------------------------------------------------

_WINDOWS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


@query(_WINDOWS)
def ext_event_windows(s, d):
    return refresh.event_windows(table(s, d, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(_WINDOWS)
def stream_event_windows(s, d):
    """The same windows, by a stream that reads the events table as arriving files."""
    import uuid

    name = f"stream_event_windows_{uuid.uuid4().hex[:8]}"
    events = table(s, d, "events")
    stream = s.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")
    out = refresh.drain(refresh.event_windows(stream), f"{ensure_checkpoint_dir(s)}/{name}")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- rewriting ------------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '\((\d{1,2}) marks?\)', 1)) AS n, list_sum(list_transform(regexp_extract_all(text, '\((\d{1,2}) marks?\)', 1), lambda x: x::INT))::INT AS marks FROM documents WHERE regexp_matches(text, '\((\d{1,2}) marks?\)')""")
def paper_marks(s, d):
    return rewriting.marked_totals(table(s, d, "documents"), "doc_id", "text").select("doc_id", F.col("n").cast("long").alias("n"), "marks")


@query(rf"""SELECT doc_id, sha1(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '\\\((.*?)\\\)', '$\1$', 'g'), '(?s)\\\[(.*?)\\\]', '$$\1$$', 'g'), '²', '^2'), '³', '^3'), '¹', '^1'), '₀', '_0'), '₁', '_1'), '₂', '_2'), 'â€™', '’'), 'â€œ', '“')) AS sha1 FROM documents WHERE text IS NOT NULL""")
def latex_normalize(s, d):
    return table(s, d, "documents").filter("text IS NOT NULL").select("doc_id", F.sha1(rewriting.plain_formulas(F.col("text"))).alias("sha1"))


@query(rf"""WITH {H} SELECT id, regexp_extract(prompt, '(?i)\b(?:replace|substitute|refactor)\s+[\x22\x27`]?([\w.]+)[\x22\x27`]?\s+(?:with|by|so)\s+[\x22\x27`]?([\w.]+)', 1) AS find, regexp_extract(prompt, '(?i)\b(?:replace|substitute|refactor)\s+[\x22\x27`]?([\w.]+)[\x22\x27`]?\s+(?:with|by|so)\s+[\x22\x27`]?([\w.]+)', 2) AS replacement FROM ch WHERE regexp_matches(prompt, '(?i)\b(?:replace|substitute|refactor)\s+[\x22\x27`]?([\w.]+)[\x22\x27`]?\s+(?:with|by|so)\s+[\x22\x27`]?([\w.]+)')""")
def parse_command(s, d):
    c = chats(s, d).select("id", rewriting.replace_command(F.col("prompt")).alias("c")).filter("c IS NOT NULL")
    return c.select("id", "c.find", "c.replacement")


@query(rf"""WITH {H} SELECT id, regexp_extract(prompt, '(?i)(\d{{1,4}}) (?:questions?|fragen|preguntas)', 1)::INT AS wanted FROM ch WHERE regexp_matches(prompt, '(?i)(\d{{1,4}}) (?:questions?|fragen|preguntas)')""")
def wanted_counts(s, d):
    return chats(s, d).select("id", rewriting.wanted_counts(F.col("prompt")).alias("wanted")).filter("wanted IS NOT NULL")


@query(f"WITH {C} SELECT id, length(replace(document, chr(13), '')) AS n FROM c WHERE document IS NOT NULL")
def read_doc(s, d):
    c = chunk_rows(s, d, "document").filter("document IS NOT NULL")
    return c.select("id", F.length(F.replace(corpus.decoded(F.encode("document", "UTF-8")), F.lit("\r"), F.lit(""))).cast("long").alias("n")).dropDuplicates(["id"])


@query(f"WITH {_SHAPED}, h AS (SELECT id, max(score) AS score FROM hits WHERE id IS NOT NULL AND score IS NOT NULL GROUP BY id), j AS (SELECT sh.bucket, h.id, h.score, row_number() OVER (PARTITION BY sh.bucket ORDER BY h.score DESC, h.id) AS rn FROM h JOIN sh USING (id)) SELECT bucket, id, score, rn FROM j WHERE rn <= 3")
def best_per_bucket(s, d):
    h = table(s, d, "hits").filter("id IS NOT NULL AND score IS NOT NULL").groupBy("id").agg(F.max("score").alias("score"))
    c = _buckets(s, d)
    return packs.best_per_bucket(h.join(c, "id"), 3).select("bucket", "id", "score", "rn")
