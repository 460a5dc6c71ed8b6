import math
import random

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import vector as V


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_split_lines_is_pythons(spark):
    rng = random.Random(1)
    texts = ["", "a", "a\n", "\n", "a\r\nb\r", "a b\x0bc", None] + ["".join(rng.choice("ab\n\r\x0b\x1c\x85 ") for _ in range(12)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    for r in df.select("i", T.split_lines(F.col("x")).alias("l")).collect():
        assert list(r.l) == (texts[r.i] or "").splitlines()


def test_collapse_and_strip(spark):
    assert one(spark, "  a\xa0 b \n", T.collapse) == "a b"
    assert one(spark, None, T.collapse) == ""
    assert one(spark, " x ", T.strip) == "x"


def test_snippet_and_one_line(spark):
    assert one(spark, "abcdef", lambda c: T.snippet(c, 4)) == "abcd...(+2 chars)"
    assert one(spark, "abcd", lambda c: T.snippet(c, 4)) == "abcd"
    assert one(spark, "a b c d", lambda c: T.one_line(c, 5)) == "a b …"


def test_extension_and_markup(spark):
    assert one(spark, "a/b.c/D.PY", T.extension) == ".py"
    assert one(spark, "a/.env", T.extension) == ""
    assert one(spark, "<p>a &amp; b<script>x</script></p>", T.strip_markup) == "a & b"


def test_dehyphenate(spark):
    assert one(spark, "exam-\nination\r\n\n\n\nx  \n", T.dehyphenate) == "examination\n\nx\n"


def test_distances_and_score(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<float>, b array<float>")
    r = df.select(V.cosine_distance(F.col("a"), F.col("b")).alias("c"), V.l2_squared(F.col("a"), F.col("b")).alias("l"), V.variance(F.col("a")).alias("v")).first()
    assert (r.c, r.l, r.v) == (1.0, 5.0, 0.25)
    for d, want in ((0.4, 0.6), (1.0, 0.0), (1.0003, 1 / 2.0003), (-0.01, 1.0), (2.0, 1 / 3), (None, 0.0)):
        assert math.isclose(one(spark, d, V.score_from_distance, "double"), want)


def test_usable(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0],), (None,), ([None, 1.0],)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<float>").select(V.usable(F.col("a"), 2)).collect()]
    assert got == [True, False, False, False, False, False]
