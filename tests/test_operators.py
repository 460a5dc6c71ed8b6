import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import chunking, code, graph, history, indexing, intents, retrieval, shaping, textsearch, timeseries


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_where_compiles(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    count = lambda w: df.filter(retrieval.compile_where(w)).count()
    assert [count(w) for w in (None, {"s": "a"}, {"n": {"$gte": 2}}, {"$or": [{"n": 1}, {"s": {"$in": ["b"]}}]}, {"s": {"$nin": ["a"]}}, {"$and": [{"n": {"$lt": 3}}, {"s": {"$ne": "a"}}]})] == [3, 1, 2, 2, 1, 1]


def test_retrieve_boosts_against_a_model(spark):
    rng = random.Random(3)
    data = [(f"i{i:03}", [rng.gauss(0, 1) for _ in range(4)], rng.choice(["x.py", "y.md"]), rng.choice(["def Alpha", "other"]), i % 3) for i in range(120)]
    df = spark.createDataFrame(data, "id string, v array<float>, file_path string, name string, g int").withColumn("relpath", F.col("file_path")).withColumn("symbols", F.array(F.lit("s"))).withColumn("document", F.lit("d"))
    q = spark.createDataFrame([([1.0, 0.5, -0.2, 0.1],)], "qv array<float>")
    got = retrieval.retrieve(df, q, "v", "id", 5, 4, {"g": 0}, None, ["x.py"], ["Alpha"]).orderBy("rank").collect()

    import numpy as np

    v = np.array([d[1] for d in data], dtype=np.float32).astype(float)
    qv = np.array([1.0, 0.5, -0.2, 0.1], dtype=np.float32).astype(float)
    dist = 1 - v @ qv / np.linalg.norm(v, axis=1) / np.linalg.norm(qv)
    order = sorted(range(120), key=lambda i: (dist[i], data[i][0]))
    score = lambda i: 1 - dist[i] if 0 <= dist[i] <= 1 else 1 / (1 + max(0, dist[i]))
    pool = {i: score(i) for i in [i for i in order if data[i][4] == 0][:5]}
    for i in order[:16]:
        if data[i][2] == "x.py":
            pool[i] = max(pool.get(i, 0), 1.2 * score(i))
    for i in order[:48]:
        if "Alpha" in data[i][3]:
            pool[i] = max(pool.get(i, 0), 1.3 * score(i))
    want = [data[i][0] for i in sorted(pool, key=lambda i: (-pool[i], dist[i], data[i][0]))[:5]]
    assert [r.id for r in got] == want


def test_merge_and_route(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.4)], "id string, score double")
    b = spark.createDataFrame([("x", 0.4), ("z", 0.4), (None, 1.0)], "id string, score double")
    assert rows(retrieval.merge_best(a, b, "id", 1.5)) == [("x", 0.6000000000000001), ("y", 0.4), ("z", 0.6000000000000001)]
    s = spark.createDataFrame([(1.0, 0.0, 0.0), (0.4, 0.4, 0.0), (0.0, 0.1, 0.9), (0.1, 0.2, 0.0)], "code double, document double, tabular double")
    assert [r.route for r in retrieval.decide_route(s).collect()] == ["code", "hybrid", "tabular", "document"]


def test_candidates():
    assert retrieval.symbol_candidates("please explain parse_rows and Router of the file") == ["parse_rows", "Router"]
    assert retrieval.file_candidates("see utils.py and 'b-c.md'") == ["utils.py", "b-c.md"]


@pytest.mark.parametrize(("n", "size", "overlap"), [(0, 10, 3), (5, 10, 3), (10, 10, 3), (11, 10, 3), (57, 10, 3), (40, 10, 9)])
def test_windows_cover_the_text(spark, n, size, overlap):
    text = "".join(chr(97 + i % 26) for i in range(n))
    df = spark.createDataFrame([(1, text)], "id int, t string")
    w = chunking.stopping_windows(df, F.length("t"), size, overlap).orderBy("seq").collect()
    if n:
        assert w[0].start == 0 and w[-1].end == n and all(b.start == a.start + size - overlap for a, b in zip(w, w[1:]))
        assert all(x.end < n for x in w[:-1])
    t = chunking.text_windows(df, "t", size, overlap).orderBy("seq").collect()
    assert [x.char_start for x in t] == list(range(0, n, size - overlap))


def test_window_overlap_is_checked(spark):
    with pytest.raises(ValueError):
        chunking.stopping_windows(spark.createDataFrame([(1,)], "id int"), F.lit(5), 3, 3)


def test_blocks_and_kinds(spark):
    texts = ["Questions\n1. a", "Solutions: b", "a | b | c\nd | e | f\n", "T", "ab", "x" * 80, "x" * 81]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.k for r in df.select("i", chunking.block_kind(F.col("t")).alias("k")).orderBy("i").collect()] == ["questions", "answers", "table", "para", "heading", "heading", "para"]
    b = chunking.blocks(spark.createDataFrame([("a\n \n b\n\n\nc",), (None,), ("",)], "t string"), "t")
    assert [r.block for r in b.orderBy("block_no").collect()] == ["a", "b", "c"]


def test_repeated_edges(spark):
    pages = [("d", i, f"Head\nbody {i}\nfoot {i}") for i in range(5)] + [("e", 1, "Head\nx"), ("e", 2, None)]
    got = {(r.doc, r.page): r.cleaned for r in chunking.repeated_edges(spark.createDataFrame(pages, "doc string, page int, text string"), "doc", "page", "text").collect()}
    assert got["d", 2] == "body 2\nfoot 2" and got["e", 1] == "Head\nx" and got["e", 2] == ""


def test_spans(spark):
    s = spark.createDataFrame([("f", 1, 4), ("f", 5, 9), ("f", 12, 14), ("f", 13, 20), ("g", 2, 2), ("g", None, 3)], "k string, line_start int, line_end int")
    assert rows(chunking.merged_spans(s, "k")) == [("f", 1, 9, 2), ("f", 12, 20, 2), ("g", 2, 2, 1)]
    assert rows(chunking.gaps(s, "k")) == [("f", 10, 11)]


def test_full_rebuild_equals_deltas(spark):
    rng = random.Random(5)
    content = {f"f{i}": 1 for i in range(20)}
    frame = lambda c: spark.createDataFrame([(k, v, v * 10) for k, v in c.items()], "relpath string, mtime long, size long")
    chunked = lambda c: spark.createDataFrame([(f"{k}:{v}:{j}", k) for k, v in c.items() for j in range(2)], "id string, relpath string")
    index = chunked(content)
    for _ in range(3):
        new = {k: v + (rng.random() < 0.3) for k, v in content.items() if rng.random() > 0.2} | {f"n{rng.random()}": 1}
        diff = indexing.manifest_difference(frame(content), frame(new))
        index = indexing.apply_delta(index, diff, chunked(new)).select("id", "relpath")
        content = new
    assert rows(index) == rows(chunked(content))


def test_latest_manifest(spark):
    m = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 2, 7), ("b", 1, None), ("b", 1, None), (None, 3, 3)], "relpath string, mtime long, size long")
    assert rows(indexing.latest_manifest(m)) == [("a", 2, 7), ("b", 1, None)]


def test_versions_and_upsert(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    indexing.write_version(old, str(tmp_path / "x"), 1)
    new = indexing.upsert(indexing.read_version(spark, str(tmp_path / "x"), 1), spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int"))
    indexing.write_version(new, str(tmp_path / "x"), 2)
    assert rows(indexing.read_version(spark, str(tmp_path / "x"), 2)) == [("a", 1), ("b", 3), ("c", 4)]


def test_grep_and_replace(spark):
    df = spark.createDataFrame([(1, "a.b  \nA.B\nxx"), (2, None), (3, "")], "id int, t string")
    assert rows(textsearch.grep(df, "id", "t", "a.b")) == [(1, 1, "a.b")]
    assert rows(textsearch.grep(df, "id", "t", "A.B", ignore_case=True)) == [(1, 1, "a.b"), (1, 2, "A.B")]
    assert rows(textsearch.grep(df, "id", "t", "^x+$", regex=True)) == [(1, 3, "xx")]
    assert rows(textsearch.grep_context(df, "id", "t", "A.B", 1)) == [(1, 2, "1:a.b  \n2:A.B\n3:xx")]
    assert rows(textsearch.replace_preview(df, "id", "t", ".", "!")) == [(1, 2, "a!b  \nA!B\nxx")]
    edits = spark.createDataFrame([(1, 2, "b", "c"), (1, 1, "a", "b"), (9, 1, "x", "y")], "id int, ord int, find string, replacement string")
    assert rows(textsearch.bulk_replace(df, "id", "t", edits)) == [(1, 2, "c.c  \nA.B\nxx"), (9, 1, None)]
    assert rows(textsearch.relevance(df, "id", "t", ["A", "x", "a"])) == [(1, 3)]
    assert rows(textsearch.line_relevance(df, "id", "t", ["a", "x"])) == [(1, 3)]


def test_history(spark):
    c = spark.createDataFrame([(1, 5.0, "p%q", "x", "P"), (2, 6.0, "ab", " ", "P"), (3, 4.0, None, "y", "")], "id long, ts double, prompt string, answer string, project string")
    for col in ("mode", "model", "embedder", "ts_iso", "project_path"):
        c = c.withColumn(col, F.lit(None).cast("string"))
    c = c.withColumn("streaming", F.lit(None).cast("int")).withColumn("rag_on", F.lit(1))
    assert [r.id for r in history.search_like(c, "P_Q").collect()] == [1]
    assert history.search_regex(c, "(").count() == 0 and [r.id for r in history.search_regex(c, "^A").collect()] == [2]
    assert [r.id for r in history.newest(c, 2).collect()] == [2, 1] and [r.id for r in history.oldest(c, 0).collect()] == [3]
    assert [r.id for r in history.appendable(c).collect()] == [1]
    assert [r.content for r in history.context_messages(c, 2).orderBy("pos").collect()] == ["p%q", "x", "ab"]
    assert [r.new_id for r in history.with_ids(10, c, ["ts", "id"]).orderBy("ts").collect()] == [11, 12, 13]


def test_resample_fills_gaps(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 1.0), (dt.datetime(2024, 1, 1, 6), 3.0), (dt.datetime(2024, 1, 4), 2.0), (None, 9.0)], "ts timestamp, v double")
    got = timeseries.resample(e, "ts", "v", "D").orderBy("bucket").collect()
    assert [(str(r.bucket), r["sum"], r.mean, r.n) for r in got] == [("2024-01-01", 4.0, 2.0, 2), ("2024-01-02", 0.0, None, 0), ("2024-01-03", 0.0, None, 0), ("2024-01-04", 2.0, 2.0, 1)]
    assert [str(r.bucket) for r in timeseries.resample(e, "ts", "v", "W").collect()] == ["2024-01-07"]
    assert timeseries.resample(e.filter("v > 99"), "ts", "v", "M").count() == 0


def test_histogram_edges(spark):
    v = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4, 10, 10)] + [(None,), (float("nan"),)], "v double")
    assert [r.n for r in timeseries.histogram(v, "v", 5).orderBy("bin").collect()] == [2, 2, 1, 0, 2]
    assert [r.n for r in timeseries.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", 2).orderBy("bin").collect()] == [2, 0]


def test_asof_and_range_joins_against_brute_force(spark):
    rng = random.Random(9)
    left = [(i, rng.randint(0, 3), rng.randint(0, 50)) for i in range(60)]
    right = list({(k, t): (k, t, float(i)) for i, (k, t) in enumerate((rng.randint(0, 3), rng.randint(0, 50)) for _ in range(40))}.values())
    got = timeseries.asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, rt int, v double"), "k", "t", "rt", "v", "id")
    for r in got.collect():
        k, t = next((k, t) for i, k, t in left if i == r.id)
        best = max(((rt, v) for rk, rt, v in right if rk == k and rt <= t), default=(None, None))
        assert (r.asof_ts, r.asof_value) == best
    spans = spark.createDataFrame([(i, a, a + rng.randint(1, 30)) for i, a in enumerate(rng.sample(range(100), 20))], "s int, lo int, hi int")
    points = spark.createDataFrame([(i, rng.randint(0, 130)) for i in range(80)], "p int, x int")
    got = {(r.p, r.s) for r in timeseries.range_join(points, spans, "x", "lo", "hi", 7).collect()}
    assert got == {(p.p, s.s) for p in points.collect() for s in spans.collect() if s.lo <= p.x < s.hi}


def test_neighbours_and_buckets(spark):
    pool = spark.createDataFrame([(f"p{i}", "f", i) for i in range(6)] + [("q", "g", 2), ("n", "f", None)], "id string, file string, page_number int")
    got = shaping.page_neighbours(pool.filter("id = 'p2'"), pool, "file", 1, 2, 3)
    assert rows(got) == [("p2", "p1", -1), ("p2", "p3", 1), ("p2", "p4", 2)]
    types = [("heading", "x", "topics"), (" QA ", "x", "questions"), ("para", "x", "other"), (None, "Exercise 3", "questions"), ("unknown", "Table 1", "tables"), (None, "1.2 Intro", "topics"), ("", "f :: page", "pages"), (None, None, "other")]
    df = spark.createDataFrame([(i, t, n, "doc") for i, (t, n, _) in enumerate(types)], "i int, t string, n string, d string")
    got = df.select("i", shaping.inferred_bucket(F.col("t"), F.col("n"), F.col("d")).alias("b")).orderBy("i").collect()
    assert [r.b for r in got] == [b for _, _, b in types]


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, x) for x in range(5001, 5100)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    got = graph.connected_components(spark.createDataFrame([*edges, (None, 3)], "src long, dst long")).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.node)
    want: dict = {}
    for a, b in edges:
        if a != b:
            want.setdefault(find(a), set()).update((a, b))
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_reachable(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "e")], "func string, callee string")
    got = graph.reachable(e, spark.createDataFrame([("a",)], "s string"), 2, "func", "callee")
    assert rows(got) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("a", "e", 2)]


def test_code(spark):
    text = "import os\nfrom a.b import c\n\nclass K:\n    def f(self):\n        return g(h(1))\n"
    df = spark.createDataFrame([(1, text), (2, "def ("), (3, "")], "id int, t string")
    assert ("import", "a") in {(r.kind, r.name) for r in code.structure(df, "id", "t").collect()}
    assert {(r.id, r.kind) for r in code.structure(df, "id", "t").collect()} >= {(2, "error"), (1, "class"), (1, "function")}
    assert rows(code.line_calls(df, "id", "t").select("func", "callee")) == [("f", "g"), ("f", "h")]
    assert rows(code.imports_of(df, "id", "t")) == [(1, "a"), (1, "os")]


def test_intents(spark):
    p = ["optimize and refactor", "a vs b", "x", None, 'find "big cat" in read_rows of the parser module', "list files", "Explain chapter 12, give me 500 hard questions"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p string").select("i", intents.general_intent(F.col("p")).alias("g"), intents.keyword_queries(F.col("p")).alias("k"), intents.tool_for(F.col("p")).alias("t"), intents.study_count(F.col("p")).alias("n"), intents.study_chapter(F.col("p")).alias("c"), intents.study_difficulty(F.col("p")).alias("d")).orderBy("i")
    r = df.collect()
    assert [x.g for x in r][:4] == ["refactor", "compare", "general", "general"]
    assert r[4].k[:2] == ["big cat", "read_rows find big cat"] and r[5].t == "list_files"
    assert (r[6].n, r[6].c, r[6].d) == (12, "12", "hard")
