import random

import numpy as np
import pytest

from lodestrata.llm import pairdefects as P
from lodestrata.llm.crf import ChainCrf

LEXICON = [(w, "en") for w in "index cache slow file page rows table warm first loads short answer question list".split()] + [(w, "de") for w in "index langsam datei seite zeilen tabelle zuerst lädt kurz antwort frage liste ordner".split()] + [(w, "fr") for w in "index lent fichier page lignes tableau charge court réponse liste dossier".split()] + [(w, "es") for w in "índice lento archivo página filas tabla carga corta respuesta lista carpeta".split()]
SCHEMA = "id long, prompt string, answer string, defect string"


@pytest.fixture(scope="module")
def tagger():
    return P.Reader(LEXICON), P.fit([], LEXICON)


CASES = [
    ("Why is the index slow?", "The index is slow because the cache is cold.", None),
    ("Why is the index slow?", "Twice.", None),
    ("Why is the index slow?", "42", None),
    ("Why is the index slow?", "- the cache is cold\n- the file is on a slow page", None),
    ("Why is the index slow?", "I can't reproduce the failure, so load_rows is most likely the cause. Clear the table.", None),
    ("Why is the index slow?", "", "empty"),
    ("Why is the index slow?", None, "empty"),
    ("Why is the index slow?", "N/A", "empty"),
    ("Why is the index slow?", "```\n```", "empty"),
    ("Why is the index slow?", "​\n", "empty"),
    ("Why is the index slow?", "  > why is the  index SLOW", "copied"),
    ("Why is the index slow?", "You asked: Why is the index slow?", "copied"),
    ("Why is the index slow?", "I'm sorry, but I can't help with that.", "refusal"),
    ("Warum ist der Index langsam?", "Leider gilt: dabei kann ich nicht helfen. Bitte fragen Sie eine Fachperson.", "refusal"),
    ("Why is the index slow?", "Die Tabelle ist langsam, weil die Datei auf einer Seite liegt. Die Liste ist kurz.", "other_language"),
    ("Answer in German, please. Why is the index slow?", "Die Tabelle ist langsam, weil die Datei auf einer Seite liegt. Die Liste ist kurz.", None),
    ("Why is the index slow?", "这个模块在发布之前合并最近的段落。", "other_language"),
    ("Why is the index slow?", "The index is slow. It loads the table and then the", "truncated"),
    ("Why is the index slow?", "Do this:\n\n```python\nfor row in rows:\n    print(row", "truncated"),
    (None, "The index is short.", None),
]


@pytest.mark.parametrize(("prompt", "answer", "want"), CASES)
def test_cases(tagger, prompt, answer, want):
    assert P.defect_of(*tagger, prompt, answer)[0] == want


def test_held_out_accuracy(tagger):
    """Made defects over texts that the field has not seen."""
    reader, field = tagger
    rng = random.Random(12)
    subj, verb, obj = ["the cache", "the table", "the file", "this page", "the list"], ["loads", "keeps", "warms", "copies"], ["the rows first", "a short answer", "every page", "the index"]
    sent = lambda: f"{rng.choice(subj)} {rng.choice(verb)} {rng.choice(obj)}".capitalize() + "."
    ok = n = 0
    for _ in range(200):
        prompt, full = f"Why is {rng.choice(subj)} slow?", " ".join(sent() for _ in range(3))
        lead, core, tail = (rng.choice(x) for x in P.REFUSALS["en"])
        for answer, want in ((full, None), (full + " Then the table of the", "truncated"), (lead + core + tail + ".", "refusal"), (prompt.upper(), "copied")):
            n += 1
            ok += P.defect_of(reader, field, prompt, answer)[0] == want
    assert ok / n >= 0.97


def test_crf_learns_a_chain():
    rng = np.random.default_rng(0)
    xs, ys = [], []
    for _ in range(300):
        y = np.cumsum(rng.random(20) < 0.08) % 2
        x = np.stack([np.ones(20), (y ^ (rng.random(20) < 0.2)).astype(float)], axis=1)
        xs.append(x)
        ys.append(y)
    crf = ChainCrf.fit(xs[:200], ys[:200], 2)
    assert np.mean([np.mean(np.array(crf.tag(x)) == y) for x, y in zip(xs[200:], ys[200:], strict=True)]) > 0.85


def test_operator_edges(spark):
    rows = [(i, p, a, "clash") for i, (p, a, _) in enumerate(CASES)] + [(1, *CASES[1][:2], "clash"), (None, "x", "", "clash"), (900, "Why is the index slow?", "The index is slow. " * 20_000, "clash")]
    lex = spark.createDataFrame([*LEXICON, (None, "en")], "word string, lang string")
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.defect for r in P.found(df, lex).collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(CASES) if d}
    assert P.found(df.limit(0), lex).count() == 0
