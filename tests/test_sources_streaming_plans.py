import datetime as dt

from pyspark.sql import functions as F

from lodestrata.operators import indexing
from lodestrata.plans import packs
from lodestrata.sources import corpus
from lodestrata.streaming import refresh


def test_scan_folder(spark, tmp_path):
    for name, data in {"a.py": b"x = 1", "sub/b.md": b"h\xff\xc3\xa9llo", "node_modules/c.py": b"", "d.bin": b"1", "Makefile": b"all:"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.relpath: r for r in corpus.scan_folder(spark, str(tmp_path)).withColumn("text", corpus.decoded(F.col("content"))).collect()}
    assert set(got) == {"a.py", "sub/b.md", "Makefile"} and got["sub/b.md"].text == "héllo" and got["a.py"].size == 5
    assert corpus.scan_folder(spark, str(tmp_path), with_content=False).columns == ["relpath", "mtime", "size"]


def test_csv_json_pages(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Date,Close\n2024-01-01,1.5\n")
    assert [tuple(r) for r in corpus.read_csv(spark, str(tmp_path / "x.csv"), "Date date, Close double").collect()] == [(dt.date(2024, 1, 1), 1.5)]
    df = spark.createDataFrame([(1, '[{"k": 1}, {"k": 2}]'), (2, '{"k": 3}'), (3, None), (4, "oops")], "id int, j string")
    assert sorted((r.id, r.k) for r in corpus.json_records(df, "j", "k int").filter("k is not null").collect()) == [(1, 1), (1, 2), (2, 3)]
    r = corpus.read_pages(spark.createDataFrame([("<title> T </title><style>x</style><p>a&amp;b</p>",)], "html string")).first()
    assert (r.title, r.text) == ("T", "T a&b")


def test_stream_refresh_equals_batch(spark, tmp_path):
    frames = [[("a", 1), ("b", 1)], [("b", 2), ("c", 2)], [("c", 3), ("c", 3)]]
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, "id string, n int").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    schema = spark.createDataFrame([], "id string, n int").schema
    for i in range(3):  # one delivery after another
        q = refresh.refresh_index(spark, str(tmp_path / f"in/{i}"), schema, str(tmp_path / f"ix{i}"), str(tmp_path / f"cp{i}"))
        q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "ix1/v=0"))
    assert sorted(map(tuple, got.collect())) == [("b", 2), ("c", 2)]
    allin = tmp_path / "all"
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, "id string, n int").coalesce(1).write.mode("append").parquet(str(allin))
    refresh.refresh_index(spark, str(allin), schema, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    last = indexing.read_version(spark, str(tmp_path / "ix"), 2)
    assert sorted(r.id for r in last.collect()) == ["a", "b", "c"]


def test_stream_windows_equal_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), "ab"[i % 2], float(i)) for i in range(50)] + [(3, dt.datetime(2024, 1, 1, 0, 51), "b", 3.0)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(2).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "ev"))
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(refresh.drain(refresh.event_windows(stream, size="2 hours", slide="1 hour"), str(tmp_path / "c1"))) == key(refresh.event_windows(df, size="2 hours", slide="1 hour"))
    assert refresh.drain(refresh.first_seen_events(stream), str(tmp_path / "c2"), "append").count() == 50 == refresh.first_seen_events(df).count()


def test_evidence_pack(spark):
    rows = [(f"c{i}", [float(i), 1.0], f"d{i} def Alpha" if i == 7 else f"d{i}", "f.pdf", "f.pdf", "f.pdf", "pdf_page" if i % 2 else "heading", f"n{i}", ["s"], i, None, None) for i in range(10)]
    c = spark.createDataFrame(rows, "id string, embeddings array<float>, document string, file_path string, relpath string, file_name string, chunk_type string, name string, symbols array<string>, page_number int, line_start int, line_end int")
    q = spark.createDataFrame([([0.0, 1.0],)], "qv array<float>")
    import lodestrata.operators.retrieval as r

    real, r.distances = r.distances, lambda rows, query, col, dim, metric="cosine": real(rows, query, col, 2, metric)
    try:
        e = packs.evidence(c, q, 3, question="what is Alpha in 'f.pdf'").orderBy("rank").collect()
    finally:
        r.distances = real
    assert len(e) == 3 and e[0].label.startswith("[f.pdf, p.") and {x.bucket for x in e} <= {"pages", "topics"}
    seeds = c.filter("id = 'c3'")
    assert {x.id: x.step for x in packs.with_neighbours(seeds, c).collect()} == {"c3": 0, "c2": 1, "c4": 1}
    assert packs.best_per_bucket(spark.createDataFrame([("a", 1.0, "x"), ("a", 2.0, "y"), ("b", 1.0, "z")], "bucket string, score double, id string"), 1).count() == 2
