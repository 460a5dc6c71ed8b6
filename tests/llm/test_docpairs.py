import ast

from lodestrata.llm import docpairs as D

SOURCE = '''
import os
# Copies the given rows into a table
# of its own.
@cached(ttl=30)
@other(
    "def not_me():",
)
async def copy_rows(rows: list[str] = ("def (x):",)) -> dict[str, int]:
    # type: ignore
    return {}

class K:
    def run(self):
        """Run."""
    def run_fast(self):
        "TODO: say what this does here"
    def parse_tables(self): 'Reads every table of the given page'; return 1
    def outer(self):
        r"""Matches \\d+ only, nothing else."""
        def inner(a,
                  b):
            """
            Adds both numbers up.
            """
            return a + b
        return inner
    def f_string(self):
        f"""This is no literal documentation at all."""
    def not_alone(self):
        """Strips what was given here.""".strip()
TEMPLATE = """
def shown():
    'Only shown in a template text.'
"""
'''


def names(text):
    return [(f.name, f.def_line) for f in D.functions_of(text)]


def test_against_the_parser():
    assert names(SOURCE) == [("copy_rows", 9), ("parse_tables", 18), ("outer", 19), ("inner", 21)]
    for f in D.functions_of(SOURCE):
        assert ast.parse("\n".join(line[len(f.code) - len(f.code.lstrip()) :] if f.name != "copy_rows" else line for line in f.code.split("\n"))) is not None


def test_window_that_begins_in_a_string():
    text = 'describes what the function does with its rows.\n    """\n    return 1\n\ndef next_one(x):\n    """Gives the one after the given one."""\n    return x\n'
    assert names(text) == [("next_one", 5)]
    assert names('    """\n    x = 1\n    return x\n\ndef g():\n    """Takes what is left of it."""\n    return 2\n') == [("g", 5)]


def test_window_that_ends_in_a_string_or_signature():
    assert names('# Loads the pages of a book\ndef load(\n    a,') == [("load", 2)]
    assert names('def load():\n    """Loads the pages of') == []


def test_line_ends_and_trivial_words():
    assert names('def a():\r\n    """Counts every line there is."""\r\n') == [("a", 1)]
    assert D.is_trivial("The load pages function", "load_pages") and D.is_trivial("Fixme later or never", "x") and D.is_trivial("two words", "x")
    assert not D.is_trivial("Loads pages of books", "load_pages")


def test_operator_edges(spark):
    schema = "id string, document string, file_ext string, name string, symbols array<string>, func_name int"
    rows = [("a", SOURCE, ".py", "x :: def copy_rows :: L1", ["def outer"], 1), ("a", SOURCE, ".py", "x :: def copy_rows :: L1", ["def outer"], 1), ("b", None, ".py", None, None, 1), ("c", "  ", " .PY", None, None, 1), ("d", SOURCE, ".md", None, None, None), ("e", "def " * 40_000, ".py", None, [None], 0), (None, "def f():\n  'Says the three words.'", ".py", None, None, 0)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.id, r.func_name): r.listed for r in D.document_pairs(df).collect()}
    assert got == {("a", "copy_rows"): True, ("a", "parse_tables"): False, ("a", "outer"): True, ("a", "inner"): False, (None, "f"): False}
    assert D.found(df.limit(0)).count() == 0 and D.found(df).columns == ["id", "func_name", "def_line"]
