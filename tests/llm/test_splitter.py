import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import splitter as S


def check(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    overlap = max(0, min(overlap, limit // 2))
    out, end = "", 0
    for s, e, _ in pieces:
        assert e - s <= limit and s <= end < e or (s, end) == (0, 0)
        assert end - s <= overlap or end == 0
        out += text[end:e]
        end = e
    assert out == text
    long_run = any(len(x) > limit for x in re.split(r"[\s.!?;。！？]", text))
    if len(text) > limit:
        assert any(f for _, _, f in pieces) == long_run
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n,;。x", max_size=400), st.integers(8, 60), st.integers(0, 40))
def test_pieces_cover_stay_within_and_end_naturally(text, limit, overlap):
    check(text, limit, overlap)


def test_stated_overlap_and_balance():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) + ("." if rng.random() < 0.1 else "") for _ in range(900))
    pieces = check(text, 1100, 120)
    assert all(a[1] - b[0] == 120 for a, b in zip(pieces, pieces[1:]))
    assert max(e - s for s, e, _ in pieces) - min(e - s for s, e, _ in pieces) < 500


def test_strong_boundaries_win():
    text = "a" * 40 + ". " + "b" * 38 + "\n\n" + "c" * 60
    assert S.split_text(text, 100, 0)[0][1] == text.index("c")


def test_operator(spark):
    chunks = spark.createDataFrame([("a", " Para ", 3, "x y. " * 400, "p"), ("a", " Para ", 3, "x y. " * 400, "p"), ("b", None, None, "z" * 1200, "p"), ("c", "code_block", 1, "s " * 900, "p"), ("d", "para", 1, None, "p"), ("e", "para", 1, "", "p"), (None, "para", 1, "q " * 700, "p")], "id string, chunk_type string, page_number int, document string, piece string")
    limits = spark.createDataFrame([("para", 1100, 120), ("code_block", 6000, 400), ("*", 1000, 100)], "chunk_type string, max_chars int, overlap_chars int")
    assert sorted(((r.id, r.cut) for r in S.found(chunks, limits).collect()), key=str) == [("a", "natural"), ("b", "forced"), (None, "natural")]
    p = S.split_oversized(chunks, limits).filter("id = 'a'").orderBy("piece_no").collect()
    assert "".join(r.piece[r.overlap :] for r in p) == "x y. " * 400 and {r.page_number for r in p} == {3}
    assert S.found(chunks.limit(0), limits).count() == 0 and S.found(chunks, limits.filter("chunk_type = 'para'")).count() == 2
