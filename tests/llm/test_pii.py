import pytest

from lodestrata.llm import pii

GIVEN = ["Marisel", "Tavira", "Reed", "Søren", "Sage"]
WORDS = ["the", "parser", "router", "reviewed", "street", "dataset", "notebook", "order", "please", "ask", "about", "run"]
CASES = [
    ("Write to tav.ira_9@mail.example.net.", {("email", "tav.ira_9@mail.example.net")}),
    ("<odu AT inbox DOT invalid> x", {("email", "odu AT inbox DOT invalid")}),
    ("a (at) mail (dot) example (dot) org;", {("email", "a (at) mail (dot) example (dot) org")}),
    ("to matheo@ inbox.invalid, not", {("email", "matheo@ inbox.invalid")}),
    ("Pinned lib@21.38.3, @cached_row, <name>@<host>", set()),
    ("Tel. +1 (302) 555-0144, or 030 / 23125-497", {("phone", "+1 (302) 555-0144"), ("phone", "030 / 23125-497")}),
    ("(437) 555 0109.", {("phone", "(437) 555 0109")}),
    ("call 0049 (0)30 23125767 now", {("phone", "0049 (0)30 23125767")}),
    ("+33 1 99 00 86 22 01.99.00.89.72", {("phone", "+33 1 99 00 86 22"), ("phone", "01.99.00.89.72")}),
    ("ISBN 000-0-83-18208-5, row 555-86, version 27.40.23465.2, ports 63000-63999, 2031-03-13 10:20:30, uuid 0021339-0101-4520-9521-2133921339", set()),
    ("SSN 666-82-3861; NIR 2 10 00 99 638 144 11.", {("id_number", "666-82-3861"), ("id_number", "2 10 00 99 638 144 11")}),
    ("passport no. Q0045014 Personalausweis LA85X1451 Steuer-ID 00 250 685 003", {("id_number", "Q0045014"), ("id_number", "LA85X1451"), ("id_number", "00 250 685 003")}),
    ("at 12 bis, rue du Four, 00787 Valmonde today", {("address", "12 bis, rue du Four, 00787 Valmonde")}),
    ("C/ Almendro 51, 00721 Fuentelba for", {("address", "C/ Almendro 51, 00721 Fuentelba")}),
    ("Lindenauer Straße 143,\n00954 Lindwerder last", {("address", "Lindenauer Straße 143,\n00954 Lindwerder")}),
    ("167 Mill Road, Flat 3, Oakmere QX1 4ZZ.", {("address", "167 Mill Road, Flat 3, Oakmere QX1 4ZZ")}),
    ("Ms Marisel\nvan der Ilverström owns", {("name", "Marisel\nvan der Ilverström")}),
    ("Dr. Kaldfeld-Umbrup, Tavira marked", {("name", "Kaldfeld-Umbrup, Tavira")}),
    ("Author: Rosalba O'Fennfeld", {("name", "Rosalba O'Fennfeld")}),
    ("Notes by A. Penhfeld; REED KALDFELD", {("name", "A. Penhfeld"), ("name", "REED KALDFELD")}),
    ("The Reed Parser replaced the Main Street dataset", set()),
]


@pytest.fixture(scope="module")
def finder():
    return pii.Finder(GIVEN, WORDS)


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(finder, text, want):
    assert {(k, text[a:b]) for a, b, k in finder.find(text)} == want


def test_redaction_changes_nothing_else(finder):
    text = "İ x Ms Tavira Umbrup, tav@a.example, +44 20 7946 0423\nend"
    spans = finder.find(text)
    assert pii.redact(text, spans) == "İ x Ms [NAME], [EMAIL], [PHONE]\nend"


def test_operator(spark):
    docs = spark.createDataFrame([(1, "Author: Tavira Kaldfeld", "x"), (2, None, "x"), (3, "", "x"), (1, "Author: Tavira Kaldfeld", "x"), (4, "word " * 100_000, "x"), (5, "a@b.example a@b.example", "x")], "doc_id long, text string, found string")
    given = spark.createDataFrame([(i, g) for i, g in enumerate([*GIVEN, None])], "name_id int, given_name string")
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    assert sorted(map(tuple, pii.found(docs, given, words).collect())) == [(1, "name", "Tavira Kaldfeld")] * 2 + [(5, "email", "a@b.example")]
    r = {x.doc_id: x for x in pii.redact_texts(docs, given, words).collect()}
    assert r[2].redacted is None and r[3].redacted == "" and r[1].redacted == "Author: [NAME]" and r[5].redacted == "[EMAIL] [EMAIL]" and len(r[4].redacted) == 500_000
    assert pii.found(docs.limit(0), given, words).count() == 0


def test_endings_are_learned_from_several_given_names(spark):
    text = " ".join(f"{g} Kaldfeld." for g in ("Marisel", "Tavira", "Søren")) + " Sage Planbook. Sage Planbook."
    got = pii.learn_endings(spark.createDataFrame([(text,)], "text string"), tuple(GIVEN), tuple(WORDS))
    assert got == ("eld",)


def test_rare_endings_and_all_documents_count(spark):
    common = [f"{g} {f}eld" for g in ("Marisel", "Tavira", "Søren") for f in ("Kald", "Penhf")]
    texts = [f"Seen by {n} twice." for n in common] + ["Then Sage Planbook loads."] * 30 + ["Then Tavira Umbruqz loads.", "Then Ms Korrin Umbruqz loads.", "Then Ms Sage Planbook loads."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame([(g,) for g in GIVEN], "given_name string")
    words = spark.createDataFrame([(w,) for w in [*WORDS, "seen", "then"]], "word string")
    got = {(r.doc_id, r.found) for r in pii.found(docs, given, words).collect()}
    n = len(common)
    assert got == {*enumerate(common), (n + 30, "Tavira Umbruqz"), (n + 31, "Korrin Umbruqz"), (n + 32, "Sage Planbook")}


def test_no_document_is_left_out_of_the_endings(spark):
    late = [f"{g} Kaldfeld" for g in ("Marisel", "Tavira", "Søren")]
    docs = spark.createDataFrame([(t,) for t in ["x"] * 20_500 + late], "text string").coalesce(1)
    assert pii.learn_endings(docs, tuple(GIVEN), tuple(WORDS)) == ("eld",)
