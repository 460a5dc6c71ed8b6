import numpy as np
import pytest

from lodestrata.operators import building, code, retrieval


def test_files_are_divided_by_their_extension(spark):
    text = "\n".join(f"line {i}" for i in range(150))
    df = spark.createDataFrame([("a.py", text), ("b.md", "word " * 400), ("c.pdf", "one block\n\nanother\fnext page"), ("d.md", "  "), ("e", None)], "relpath string, text string")
    got = {}
    for r in building.chunk_files(df).collect():
        got.setdefault(r.relpath, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {"a.py": 2, "b.md": 3, "c.pdf": 3}
    assert sorted((r.line_start, r.line_end) for r in got["a.py"]) == [(1, 120), (101, 150)]
    assert sorted((r.part, r.document) for r in got["c.pdf"]) == [(1, "another"), (1, "one block"), (2, "next page")]
    assert building.chunk_files(df.limit(0)).count() == 0


def test_embedder_is_pluggable_and_checked(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "n int, t string")
    v = {r.n: r.embeddings for r in building.embedded(df, "t", building.hashed_words(8), 8).collect()}
    assert abs(np.linalg.norm(v[1]) - 1) < 1e-6 and not any(v[2])
    with pytest.raises(Exception, match="not 9 numbers"):
        building.embedded(df, "t", building.hashed_words(8), 9).collect()


def test_best_counts_copies_once(spark):
    df = spark.createDataFrame([("a", 0.1)] * 50 + [("b", 0.2), ("c", 0.2), ("d", 0.3)], "id string, distance double").repartition(3)
    assert [r.id for r in retrieval.best(df, "id", 3).orderBy("distance", "id").collect()] == ["a", "b", "c"]


def test_best_of_each_group(spark):
    df = spark.createDataFrame([(g, f"i{k}", float(k + g)) for g in (1, 2) for k in range(9)] * 2, "q int, id string, distance double").repartition(3)
    assert sorted((r.q, r.id) for r in retrieval.best(df, "id", 2, "q").collect()) == [(1, "i0"), (1, "i1"), (2, "i0"), (2, "i1")]


def test_relaxed_where_few_are_found(spark):
    df = spark.createDataFrame([(1, f"i{k}", 0.9 - k * 0.1) for k in range(9)] + [(2, f"i{k}", 0.9) for k in range(9)], "c int, id string, score double")
    got = retrieval.relaxed(df, "c", "id", 3, 0.75, least=3).collect()
    assert sorted((r.c, r.id, r.relaxed) for r in got) == [(1, f"i{k}", True) for k in range(4)] + [(2, f"i{k}", False) for k in range(3)]


def test_folder_of_a_prompt(spark):
    prompts = spark.createDataFrame([(1, "look in src/core please"), (2, "what about docs"), (3, ""), (4, None)], "id int, p string")
    paths = spark.createDataFrame([("src/core/a.py",), ("src/b.py",), ("docs/x/y.md",), (None,)], "relpath string")
    got = {r.id: (r.dir, r.score) for r in code.guessed_folders(prompts, paths, "id", "p", "relpath").collect()}
    assert got == {1: ("src/core", 1), 2: ("docs", 2)}


def test_related_files(spark):
    df = spark.createDataFrame([("a.py", ".py", "import Alpha\nx = 1"), ("b.py", ".py", "import os"), ("c.md", ".md", "about alpha"), ("d.md", ".md", None)], "f string, e string, t string")
    assert {(r.f, r.related) for r in code.related_files(df, "f", "t", "e").collect()} == {("a.py", 1), ("b.py", 0)}


def test_outer_spans_over_windows(spark):
    whole = ["import os", "", "@x", "def f():", "    pass", "# c", "class A:", "    def g(self):", "        pass", "y = 1"]
    df = spark.createDataFrame([("m", 1, "\n".join(whole[:6])), ("m", 4, "\n".join(whole[3:]))], "file string, line_start int, t string")
    got = {(r.kind, r.name, r.line_start, r.line_end) for r in code.line_spans(df, "file", "t", "line_start").collect()}
    assert got == {("function", "f", 4, 6), ("class", "A", 7, 9)}
