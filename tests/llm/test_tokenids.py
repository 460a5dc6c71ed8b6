import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import tokenids as K

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    t = tokenizers.Tokenizer.from_file(K.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return K.text_encoder(K.DEFAULT_VOCABULARY), t


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(pair, text):
    mine, theirs = pair
    text = text.encode("utf-8", "ignore").decode()
    assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_hard_texts(pair):
    mine, theirs = pair
    rng = random.Random(3)
    for text in ["<|endoftext|> hi", "I'LL we'll", "aaaaaaaaaaaaaaaaaaaa" * 50, "  \n\n\t x", "老师慢慢地", "👩‍🏫"] + ["".join(rng.choice("aeinorst") for _ in range(60)) for _ in range(2000)]:
        assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids and mine.count(text) == len(mine.encode(text))


def test_operator(spark):
    df = spark.createDataFrame([(1, "hi there", "x"), (2, None, "x"), (3, "", "x"), (1, "hi there", "x"), (None, "a", "x"), (4, "word " * 50_000, "x")], "doc_id long, text string, ids string")
    got = K.encode_corpus(df).collect()
    assert len(got) == 6 and [list(r.ids) for r in got if r.doc_id in (2, 3)] == [[], []]
    assert [list(r.ids) for r in got if r.doc_id == 1] == [[5303, 612]] * 2 and len(next(r.ids for r in got if r.doc_id == 4)) == 50_001
    assert K.encode_corpus(df.limit(0)).count() == 0
