from lodestrata.llm import mixing as X

T = [("A ", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.0, 1)]


def frames(spark, docs):
    return spark.createDataFrame([(i, s, t, 9, "u") for i, s, t in docs], "doc_id long, source string, text string, key int, uses string"), spark.createDataFrame(T, "source string, target_share double, max_repeats int")


def docs():
    return [(i, (" a", "A", "B", "c ", None, "other")[i % 6], f"word {i} " * (1 + i % 7) if i % 11 else None) for i in range(1200)]


def test_shares_and_caps(spark):
    d, t = frames(spark, docs())
    r = {x.source: x for x in X.mix_report(d, t).collect()}
    assert set(r) == {"a", "b", "c", "gone"} and abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    for x in r.values():
        assert x.most_uses <= x.max_repeats and abs(x.actual_share - x.target_share) < 0.01
    m = X.mix(d, t).collect()
    assert len({x.doc_id for x in m}) == len(m) and {x.source for x in m} == {"a", "b", "c"}


def test_one_source_is_used_up(spark):
    """The largest total: some source reaches its cap."""
    d, t = frames(spark, docs())
    sized = X.sized_records(d)
    have = {r.source: r.n for r in sized.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    used = {r.source: r.tokens for r in X.mix_report(d, t).collect()}
    assert max(used[s.strip().lower()] / (have[s.strip().lower()] * cap) for s, share, cap in T if share) > 0.99


def test_same_mix_again_and_given_total(spark):
    d, t = frames(spark, docs())
    key = lambda df: sorted((r.doc_id, r.uses) for r in df.collect())
    assert key(X.mix(d, t)) == key(X.mix(d.repartition(7), t))
    assert abs(sum(r.tokens for r in X.mix_report(d, t, total_tokens=1000).collect()) - 1000) < 60


def test_edges(spark):
    d, t = frames(spark, docs())
    assert X.mix(d.limit(0), t).count() == 0 and {r.actual_share for r in X.mix_report(d.limit(0), t).collect()} == {0.0}
    assert X.mix(d, t.limit(0)).count() == 0
    only, _ = frames(spark, [(1, "A", "x y"), (1, "A", "x y"), (2, "c", ""), (3, "zz", "x")])
    assert {r.source for r in X.mix(only, t).collect()} == {"a"}


def test_a_cut_range_that_is_divided_further_cuts_at_the_same_record(spark, monkeypatch):
    d, t = frames(spark, docs())
    want = sorted((r.doc_id, r.uses) for r in X.mix(d, t, total_tokens=3000).collect())
    monkeypatch.setattr(X, "STEP", 3)
    monkeypatch.setattr(X, "IN_ONE_TASK", 4)
    assert sorted((r.doc_id, r.uses) for r in X.mix(d, t, total_tokens=3000).collect()) == want
