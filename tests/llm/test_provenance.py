import itertools
import math
import random
import time

import pytest

from lodestrata.llm.provenance import COMPATIBLE, DIRECTORY_NAMES, INNER, LABELS, ROOT, evidence, labelled_files, of_values, propagate

CODE = "import json\n\ndef load_rows(path):\n    with open(path) as handle:\n        return json.load(handle)\n\ndef total(rows):\n    if not rows:\n        return 0\n    return sum(r['n'] for r in rows)\n"
STUB = "class A(object):\n" + "".join(f"    def f{i}(self):\n        return self._f[{i}]\n" for i in range(20))
MINI = "".join(f"var a{i}=b(c),d=[e,f,{i}];!function(g){{h.i=j&&k[l]({i})}}(this);" for i in range(40))
TABLE = "D = [\n" + "".join("  " + ", ".join(str((i * j) % 977) for j in range(12)) + ",\n" for i in range(1, 20)) + "]\n"


@pytest.mark.parametrize(
    "path,content,label",
    [
        ("src/a.py", CODE, 0), ("src/a.py", STUB, 1), ("src/a.js", MINI, 2), ("src/a.py", TABLE, 4), ("src/a.min.js", None, 2), ("src/a.py", None, 0), ("src/a.py", "", 0),
        ("src/a.py", "# Code generated by tool v1. DO NOT EDIT.\n" + CODE, 1), ("src/a.py", "# Copied from carob@1.2.3 on 2024-01-01\n" + CODE, 3), ("src/a.py", "# This file is part of carob 1.2.3.\n" + CODE, 3),
        ("src/a.py", "# the generated report must not be edited by hand, see the exporter\n" + CODE, 0), ("src/a.py", "# autogenerated ids start at 0\n" + CODE, 0), ("src/a.py", "# Copyright (c) 2024 the acme authors.\n" + CODE, 0),
        ("src/a.php", CODE + 'q = "select ' + ", ".join(f"alpha_{i}, beta_gamma" for i in range(60)) + '"\n', 0),
    ],
)
def test_evidence(path, content, label):
    phi = evidence(path, content, "acme/tool")
    assert max(range(5), key=lambda i: (phi[i], -i)) == label


def test_own_notice_is_not_vendored():
    assert evidence("a.py", "# This file is part of tool.\n" + CODE, "acme/tool")[3] == evidence("a.py", CODE, "acme/tool")[3]


def test_notes_count_wherever_they_stand():
    licence = "".join(f"# Line {i} of the licence text.\n" for i in range(40))
    label = lambda text: max(range(5), key=lambda i: (evidence("src/a.py", text, "acme/tool")[i], -i))
    assert label(licence + "# This file was automatically generated from a.yaml.\n" + CODE) == 1
    assert label(CODE + licence + CODE + "# @generated by tool\n") == 1
    assert label(licence + "# Copied from carob@1.2.3 on 2024-01-01\n" + CODE) == 3
    for remark in ("do not change the order of these calls", "taken from the request", "derived from its parent", "@since v1.2", "since 1.2.3", "Auto-generated method stub"):
        assert label(CODE + licence + f"    # {remark}\n" + CODE) == 0, remark


def test_long_lines_are_judged():
    rows = [(i * 37 % 1009, f"name {i}") for i in range(1, 900)]
    numbers = ", ".join(str(a) for a, _ in rows)
    for text in (
        numbers + "\n", f"D = [{numbers}]\n", "/* table */ " + numbers + "\n", "const D = [" + ", ".join(f'{{ "id": {a}, "name": "{b}" }}' for a, b in rows) + "];\n",
        "INSERT INTO t (id, name) VALUES " + ", ".join(f"({a}, '{b}')" for a, b in rows) + ";\n", "D = [" + ", ".join(f"{{ id: {a}, name: '{b}' }}" for a, b in rows) + "]\n",
    ):
        phi = evidence("src/a.js", text)
        assert max(range(5), key=lambda i: (phi[i], -i)) == 4, text[:60]
    words = "This message tells the reader, at some length, what to do next. " * 60
    for text in (CODE + f'TEXT = "{words}"\n', CODE + f'run("{words}", 1, 2, 3, "x")\n', CODE + "x = call(alpha, beta) + other(gamma, delta) * factor\n" * 2 + "y = " + " + ".join(f"alpha_{i} * beta" for i in range(300)) + "\n"):
        phi = evidence("src/a.py", text)
        assert max(range(5), key=lambda i: (phi[i], -i)) == 0, text[-60:]


def test_long_lines_take_linear_time():
    for line in ("a" * 400_000, '"\\' * 200_000, "1" * 400_000 + "x", "'\\'" * 130_000, " " * 400_000 + "x", "1.2e" * 100_000, "a b" * 130_000):
        began = time.process_time()
        of_values(line)
        assert time.process_time() - began < 2, line[:10]


def _brute(files):
    """Exact marginals of a small tree by enumeration."""
    dirs = {""}
    for d, _ in files:
        while d:
            dirs.add(d)
            d = d.rpartition("/")[0]
    dirs = sorted(dirs)
    names = {n: (k, w) for k, t in DIRECTORY_NAMES.items() for n, w in t.items()}
    own = {d: [ROOT if d == "" else INNER] + [names[d.rpartition("/")[2]][1] if d.rpartition("/")[2] in names and names[d.rpartition("/")[2]][0] == k else 0.0 for k in range(1, 5)] for d in dirs}
    out = [[0.0] * 5 for _ in files]
    for combo in itertools.product(range(5), repeat=len(dirs)):
        at = dict(zip(dirs, combo, strict=True))
        w = sum(own[d][at[d]] for d in dirs) + sum(COMPATIBLE[at[d.rpartition("/")[0]]][at[d]] for d in dirs if d)
        each = [[math.exp(e[i] + COMPATIBLE[at[d]][i]) for i in range(5)] for d, e in files]
        sums = [sum(x) for x in each]
        for k, x in enumerate(each):
            rest = math.exp(w) * math.prod(s for j, s in enumerate(sums) if j != k)
            for i in range(5):
                out[k][i] += rest * x[i]
    return [[v / sum(o) for v in o] for o in out]


def test_propagation_is_exact(spark):
    rng = random.Random(5)
    files = [(d, [rng.uniform(0, 3) for _ in range(5)]) for d in ("", "src", "src/a", "vendor/x", "vendor/x", "src/a")]
    rows = [(i, "r", d, d.count("/") + 1 if d else 0, *e) for i, (d, e) in enumerate(files)]
    df = spark.createDataFrame(rows, "file_id long, repo string, directory string, depth int, e0 double, e1 double, e2 double, e3 double, e4 double")
    got = {r.file_id: [math.exp(r[f"p{i}"]) for i in range(5)] for r in propagate(df).collect()}
    for i, want in enumerate(_brute(files)):
        total = sum(got[i])
        assert [v / total for v in got[i]] == pytest.approx(want, abs=1e-9)


def test_operator(spark):
    rows = [(1, "o/r", "src/a.py", CODE, 0), (1, "o/r", "src/a.py", CODE, 0), (2, "o/r", "vendor/x/b.py", CODE, 0), (3, "o/r", "vendors/b.py", CODE, 0), (4, "o/r", "src\\c.py", STUB, 0), (5, None, None, None, 0), (6, "o/r", "src/d.py", None, 0), (7, "o/r", "src/e.py", TABLE * 400, 0)]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, content string, depth int")
    inv = spark.createDataFrame([("o/r", "src/./d.py", "generated: header", 0), ("o/r", "src/d.py", "GENERATED", 0), (None, None, None, 0)], "repo string, path string, excluded_reason string, p0 int")
    got = {r.file_id: r.label for r in labelled_files(files, inv).collect()}
    assert got == {1: "handwritten", 2: "vendored", 3: "handwritten", 4: "generated", 5: "handwritten", 6: "handwritten", 7: "blob"}
    assert set(got.values()) <= set(LABELS)
    assert labelled_files(files.limit(0), inv.limit(0)).count() == 0


def _labels(spark, paths: dict[str, str]) -> dict[str, str]:
    files = spark.createDataFrame([(i, "o/r", p, c) for i, (p, c) in enumerate(paths.items())], "file_id long, repo string, path string, content string")
    inventory = spark.createDataFrame([], "repo string, path string, excluded_reason string")
    return {r.path: r.label for r in labelled_files(files, inventory).collect()}


def test_siblings_decide_and_a_name_alone_does_not(spark):
    """A handwritten project below a directory with such a name, and a package only its files' siblings reveal."""
    notice = "# Copied from carob@1.2.3 on 2024-01-01\n" + CODE
    paths = {f"{d}/part{i}.py": CODE + f"\nN = {i}\n" for d in ("external", "services/deps", "src") for i in range(5)}
    paths |= {f"lib/carob/m{i}.py": notice for i in range(4)} | {"lib/carob/quiet.py": CODE, "lib/own.py": CODE, "lib/other.py": CODE, "lib/third.py": CODE}
    got = _labels(spark, paths)
    assert {p for p, label in got.items() if label != "handwritten"} == {p for p in paths if p.startswith("lib/carob/")}
    assert got["lib/carob/quiet.py"] == "vendored"
    # Propagation removed: what the file itself tells is not enough.
    phi = evidence("lib/carob/quiet.py", CODE, "o/r")
    assert phi[0] > phi[3]
    assert _labels(spark, {"quiet.py": CODE, **{p: c for p, c in paths.items() if p.startswith("src/")}})["quiet.py"] == "handwritten"


def test_a_vendored_file_without_a_notice_is_carried_by_name_and_siblings(spark):
    notice = "# Copied from carob@1.2.3 on 2024-01-01\n" + CODE
    own = {f"src/m{i}.py": CODE for i in range(6)}
    mixed = {f"vendor/p{i}/m.py": notice if i % 2 else CODE for i in range(8)}
    got = _labels(spark, own | mixed)
    assert {p for p, label in got.items() if label == "vendored"} == set(mixed)
