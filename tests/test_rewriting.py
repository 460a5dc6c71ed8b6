from pyspark.sql import functions as F

from lodestrata.operators import rewriting as R


def test_with_blocks():
    assert R.with_blocks("f = open(p)\nx = f.read()\n\nf.close()\ny") == ("with open(p) as f:\n    x = f.read()\n\ny", 1)
    assert R.with_blocks("f = open(p)\nx") == ("f = open(p)\nx", 0)
    assert R.with_blocks("  f = open(p)\nx", True) == ("  with open(p) as f:\n      pass\nx", 1)


def test_rules_marks_commands(spark):
    df = spark.createDataFrame([(1, "Section A has 20 questions of 1 mark\nsection A contains 5 items worth 2 marks\nx"), (2, None), (3, "q (2 marks) r (10 marks) (1 mark)"), (4, 'Replace "a_b" with c')], "id int, t string")
    assert [tuple(r) for r in R.section_rules(df, "id", "t").collect()] == [(1, "A", 20, 1)]
    assert [tuple(r) for r in R.marked_totals(df, "id", "t").collect()] == [(3, 3, 13)]
    assert [tuple(r.c) for r in df.select(R.replace_command(F.col("t")).alias("c")).filter("c is not null").collect()] == [("a_b", "c")]
    assert R.rewrite_open(df, "id", "t").count() == 0
    one = spark.createDataFrame([("\\(x²\\) and \\[y\\]",)], "t string").select(R.plain_formulas(F.col("t"))).first()[0]
    assert one == "$x^2$ and $$y$$"
