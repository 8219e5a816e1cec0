import pytest

from lodestrata.llm.docpairs import described, documented_pairs

GOOD = [
    ("fetch_rows", "Liest die Zeilen aus dem Zwischenspeicher und verwirft abgelaufene Einträge."),
    ("f", "Idempotent: a second call is a no-op."),
    ("attachWidget", "Attach widget.\n\nBlocks until the queue is flushed."),
    ("f", "TODO(core): split this up\nTakes a stale row and drops it."),
    ("f", "-----\n<p>Not safe for concurrent use.</p>\n@param a a"),
    ("f", "Copyright the authors\nWrites one row per file."),
    ("f", 'Signs each row. {"client_id": "x", "client_secret": "y"}'),
]
BAD = [
    ("attach_widget", "Attach widget."), ("rotatePacket", "Rotates the packet."), ("encodeMelody", "This function encodes the melody."),
    ("x", ""), ("x", " \n "), ("x", None), ("x", "####"), ("x", "TBD"), ("x", "T.B.D."), ("x", "n/a"), ("x", "..."), ("x", "[summary]"), ("x", "_summary_"),
    ("x", "Summary.\n\n[description]"), ("x", "Auto-generated method stub"), ("x", "See above."), ("x", "see base class"), ("x", "{@inheritDoc}"),
    ("x", "eslint-disable-next-line no-shadow"), ("x", "noqa: E501"), ("x", "endregion"), ("x", "MARK: -"), ("x", "@deprecated"),
    ("x", "@param a a\n@returns layout\n@throws Error"), ("x", ":param a:\n:returns:"), ("x", "print(quota)"), ("x", "return orbit.publish(widget);"),
    ("x", "cursor = load_cursor(reading)"), ("x", "console.log(a);\nif (!a) return;"), ("x", "All rights reserved."), ("x", "SPDX-License-Identifier: MIT"),
    ("x", "helpers"), ("x", "public api"), ("x", "getters / setters"), ("trim_cursor", "Method trim_cursor."), ("a_b", "****\na_b\n****"),
    ("x", "TODO: document this function properly, see ticket CORE-8 for what is still missing here"), ("x", "Write a description here"),
]


@pytest.mark.parametrize("name,text", GOOD)
def test_described(name, text):
    assert described(text, name)


@pytest.mark.parametrize("name,text", BAD)
def test_not_described(name, text):
    assert described(text, name) is None


def test_pairs(spark):
    doc = "Writes rows in blocks of fixed size."
    rows = [
        (1, "a.py::f", "f", "Function", "def f(x)", doc, 1), (1, "a.py::f", "f", "Function", "def f(x)", doc, 2),
        (2, "a.py::C", "C", None, "class C(Base)", doc, 1), (3, "a.py::g", "g", None, "def g()", doc, 1),
        (4, "a.py::h", "h", "method", None, doc, 1), (5, "a.py::i", "i", "method", "def i()", None, 1),
        (6, "inc/m.h::run", "run", "function", "int run(char *a);", doc, 1), (7, "src/m.c::run", "run", "function", "int run(char *a) {", None, 1),
        (8, "src/m.c::run2", "run2", "function", "int run2(char *a) {", None, 1), (9, "src/m.c::w", "w", "function", "int w()", "word " * 50_000 + "describes long texts", 1),
        (None, "a.py::n", "n", "def", "def n()", doc, 1),
    ]
    df = spark.createDataFrame(rows, "symbol_id long, fqsn string, name string, kind string, signature_clean string, docstring_clean string, documentation int")
    got = {(r.symbol_id, r.doc_symbol_id) for r in documented_pairs(df).collect()}
    assert got == {(1, 1), (3, 3), (6, 6), (7, 6), (9, 9), (None, None)}
    assert documented_pairs(df.limit(0)).count() == 0


COLUMNS = "symbol_id long, file_id long, fqsn string, name string, kind string, signature_clean string, docstring_clean string"


def test_declarations_of_other_modules_do_not_describe(spark):
    rows = [(1, 1, "a/m.h::r", "r", "fn", "int r();", "Reads one block of rows."), (2, 2, "b/m.h::r", "r", "fn", "int r();", "Writes another block."), (3, 3, "m.c::r", "r", "fn", "int r() {", None), (4, 4, "b/src/m.c::r", "r", "fn", "int r() {", "TODO")]
    got = {(r.symbol_id, r.doc_symbol_id) for r in documented_pairs(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {(1, 1), (2, 2), (4, 2)}


def test_overloads_repositories_and_what_the_join_adds(spark):
    """Planted header and definition pairs: each overload takes the text of its own signature and repository."""
    n = 300
    rows, of = [], []
    for i in range(n):
        repo = f"r{i % 3}"
        for j, kind in enumerate(("int a", "char *b")):
            header, body = 4 * i + 2 * j, 4 * i + 2 * j + 1
            rows += [
                (header, header, f"include/m{i // 3}.h::Box::run", "run", "method", f"extern int run({kind});", f"Sends block {kind} of parcel {i} to the printer."),
                (body, body, f"src/m{i // 3}.c::Box::run", "run", "method", f"int run({kind})\n{{", [None, "TODO: document", "****"][i % 3]),
            ]
            of += [(header, repo), (body, repo)]
    files = spark.createDataFrame(of, "file_id long, repo string")
    symbols = spark.createDataFrame(rows, COLUMNS)
    got = {r.symbol_id: (r.doc_symbol_id, r.documentation) for r in documented_pairs(symbols, files).collect()}
    assert len(got) == 4 * n
    for i in range(n):
        for j in range(2):
            header, body = 4 * i + 2 * j, 4 * i + 2 * j + 1
            assert got[body][0] == header and f"parcel {i} " in got[body][1] and ("char" in got[body][1]) == bool(j)
    # Without the join, or with no declarations to join, the definitions are lost.
    without = {r.symbol_id for r in documented_pairs(symbols.where("fqsn like 'src/%'"), files).collect()}
    assert without == set()
