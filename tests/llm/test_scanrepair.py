import random

from lodestrata.llm import scanrepair as R

SCHEMA = "id string, file_path string, file_ext string, name string, chunk_type string, page_number int, document string, file string"
WORDS = "the index of the table keeps every page near its outline and the walker warns about a missing section while the reader copies another summary into the present document".split()
LEXICON = sorted(set(WORDS) | {"well-formed", "hidden"})


def page(n, body, head="Robust Reader — Chapter 4", foot=None):
    return f"{head}\n\n{body}\n\n{foot or f'[{n + 100}]'}"


def book(spark, scanned=True, extra=()):
    rng = random.Random(2)
    rows = []
    for n in range(1, 8):
        b = "\n".join(" ".join(rng.sample(WORDS, len(WORDS))) for _ in range(6))
        head = "Robust Reader — Chapter 4"
        if scanned:
            b = b.replace("walker", "wa1ker", 1).replace("missing", "rnissing", 1)
            head = head if n != 3 else "Roburnt Reader - Chapler 4"
        if n == 2:
            b += "\nthe read-\ner copies a well-\nformed table and a sum¬\nmary of the docu-"
        if n == 3:
            b = "ment keeps the hid-\nden page\n" + b
        rows.append((f"p::b.pdf::1::{n}", "b.pdf", ".pdf", f"b.pdf :: p{n}", " PDF_page", n, page(n, b, head), "x"))
    rows += extra
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(w,) for w in LEXICON], "word string")


def test_found(spark):
    chunks, lex = book(spark)
    got = {(r.id[-1], r.kind, r.line_no, r.fixed) for r in R.found(chunks, lex).collect()}
    assert {(str(n), "running_line", 1, "") for n in range(1, 8)} <= got
    assert sum(k == "page_number" for _, k, _, _ in got) == 7
    assert {(i, f) for i, k, _, f in got if k == "hyphenation"} == {("2", "reader"), ("2", "well-formed"), ("2", "summary"), ("2", "document"), ("3", "hidden")}
    assert {f for _, k, _, f in got if k == "misread"} == {"walker", "missing"} and sum(k == "misread" for _, k, _, _ in got) == 14


def test_digital_files_keep_their_words(spark):
    chunks, lex = book(spark, scanned=False)
    assert {r.kind for r in R.found(chunks, lex).collect()} == {"running_line", "page_number", "hyphenation"}


def test_repaired_text(spark):
    chunks, lex = book(spark)
    text = {r.id[-1]: r.text for r in R.repaired(chunks, lex).collect()}
    assert "Robust" not in text["2"] and "[102]" not in text["2"] and text["2"].endswith("the reader copies a well-formed table and a summary of the document")
    assert text["3"].startswith("ment keeps the hidden page") and "wa1ker" not in text["3"] and "\n" not in text["3"]


def test_edges(spark):
    extra = [("q", "c.pdf", ".pdf", "c.pdf :: p1", None, None, "alone\n7", "x"), ("q", "c.pdf", ".pdf", "c.pdf :: p1", None, None, "alone\n7", "x"), ("r", "c.pdf", None, "c.pdf :: p1 :: para", None, 1, "a block", "x"), ("s", None, ".pdf", None, "pdf_page", 1, None, "x"), ("t", "d.pdf", ".pdf", None, "pdf_page", 1, "  \n ", "x"), ("u", "e.md", ".md", "e", "para", 1, "x-\ny", "x"), ("v", "f.pdf", ".pdf", None, "pdf_page", 2, "word " * 60_000, "x")]
    chunks, lex = book(spark, extra=extra)
    ids = {r.id for r in R.pdf_pages(chunks).collect()}
    assert {"q", "t", "v"} <= ids and not {"r", "s", "u"} & ids
    assert R.found(chunks, lex).count() > 0
    assert R.found(chunks.limit(0), lex).count() == 0


def test_page_number_lines():
    for line, want in (("[142]", (142, True)), ("- 3 -", (3, True)), ("vii", (7, False)), ("Page 4 of 20", (4, True)), ("l37", (137, False)), ("9 / 20", (9, True)), ("Chapter 3", None), ("", None), ("mix", (1009, False))):
        got = R.printed_number(line)
        assert got == want or (line == "mix" and got is None)
    assert R.skeleton("Robust Reader — Chapter 4   17") == R.skeleton("R0bust  Reader- Chaptcr 4")


def test_a_lightly_misread_file_keeps_its_sure_corrections(spark):
    chunks, lex = book(spark, scanned=False, extra=[("p::b.pdf::1::8", "b.pdf", ".pdf", "b.pdf :: p8", "pdf_page", 8, page(8, "the wa1ker warns about a missing section"), "x")])
    assert {r.fixed for r in R.found(chunks, lex).collect() if r.kind == "misread"} == {"walker"}


def test_links_prefer_the_neighbour_by_vector(spark):
    import numpy as np

    words = spark.createDataFrame([("hcar", 2), ("hear", 100), ("hoar", 100), ("wa1ker", 1), ("walker", 50), ("well", 9)], "word string, n bigint")
    vectors = {"hear": np.array([1, 0], np.float32), "hoar": np.array([0, 1], np.float32)}
    rare = spark.createDataFrame([("hcar", [0.1, 0.9])], "word string, v array<float>")
    links = {r.word: r.links for r in R.link_words(words, frozenset({"well"}), vectors, rare).collect()}
    assert links["wa1ker"][0].form == "walker" and links["wa1ker"][0].sure and "well" not in links and "hear" not in links
    assert [x.form for x in links["hcar"]][:1] == ["hear"]  # the surer edit wins over the nearer vector at equal counts
    assert abs(links["hcar"][0].score - (0.4 * np.log(101) - 1.5 + 0.1 / np.hypot(0.1, 0.9))) < 1e-3
