import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.operators.snapshot_diff import differences, snapshot_changes

RUNS = "scan_id string, repo string, state string, diagnostics_json string, created_at timestamp, extra int"
INV = "scan_id string, repo string, path string, content_sha256 string, loaded_at timestamp, kh int"
SYM = "scan_id string, repo string, fqsn string, signature string, loaded_at timestamp, table int"


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 400), st.integers(0, 400), st.integers(0, 200), st.integers(1, 5))
def test_peeling_is_exact(only_old, only_new, shared, tables):
    rng = np.random.default_rng(only_old * 7 + only_new)
    n = only_old + only_new + shared
    if n == 0:
        return
    k = rng.integers(1, 2**63, n, dtype=np.uint64)
    v = rng.integers(1, 2**63, n, dtype=np.uint64)
    t = rng.integers(0, tables, n)
    old = np.r_[0:only_old, only_old + only_new : n]
    new = np.r_[only_old:n]
    table, key, value = t[np.r_[old, new]], k[np.r_[old, new]], v[np.r_[old, new]]
    sign = np.r_[-np.ones(len(old), int), np.ones(len(new), int)]
    a, b, c, d = differences(table, key, value, sign, tables)
    got = set(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True))
    want = {(int(t[i]), int(k[i]), int(v[i]), -1) for i in range(only_old)} | {(int(t[i]), int(k[i]), int(v[i]), 1) for i in range(only_old, only_old + only_new)}
    assert got == want


def test_cases(spark):
    from datetime import datetime as D

    runs = [("b", "r", "complete", None, D(2024, 1, 1), 1), ("b", "r", "complete", None, D(2024, 1, 1), 1), ("x", "r", "partial", None, D(2024, 1, 2), 1), ("a", "r", "COMPLETE ", None, D(2024, 1, 3), 1), ("c", "r", "complete", None, D(2024, 1, 4), 1), (None, "r", "complete", None, D(2024, 1, 4), 1)]
    t = D(2024, 2, 1)
    inv = [
        ("b", "r", "src/./a.py", "AA", t, 0), ("a", "r", "src\\a.py", "aa", t, 0),  # same file, same hash
        ("b", "r", "ü.py", "01", t, 0), ("a", "r", "ü.py", "02", t, 0),  # same file, changed
        ("b", "r", "n.py", None, t, 0), ("a", "r", "n.py", "05", t, 0),  # unknown hash: no change
        ("b", "r", "gone.py", "07", t, 0), ("a", "r", "new.py", "08", t, 0), ("a", "r", "new.py", "08", t, 0),
        ("b", "r", "late.py", "01", t, 0), ("a", "r", "late.py", "99", D(2024, 1, 1), 0), ("a", "r", "late.py", "01", t, 0),
        ("x", "r", "never.py", "01", t, 0), ("a", "r", None, "01", t, 0),
    ]
    sym = [("b", "r", "f", "f( a )", t, 0), ("a", "r", "f", "f(a)", t, 0), ("b", "r", "g", "g()", t, 0), ("a", "r", "g", "g(x)", t, 0), ("b", "r", "h", None, t, 0), ("a", "r", "h", "h()", t, 0)]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(runs, RUNS), spark.createDataFrame(inv, INV), spark.createDataFrame(sym, SYM)).collect()}
    first = {("file", "a", "ü.py", "changed"), ("file", "a", "gone.py", "removed"), ("file", "a", "new.py", "added"), ("symbol", "a", "g", "changed")}
    gone = {("file", "c", p, "removed") for p in ("src/a.py", "ü.py", "n.py", "new.py", "late.py")} | {("symbol", "c", s, "removed") for s in "fgh"}
    assert got == first | gone


def test_empty(spark):
    empty = [spark.createDataFrame([], s) for s in (RUNS, INV, SYM)]
    assert snapshot_changes(*empty).count() == 0


def test_keys_of_equal_hash_are_told_apart():
    import numpy as np
    import pyarrow as pa

    from lodestrata.operators.snapshot_diff import _bucket_task, told_apart

    keys = pa.chunked_array([["a", "b", "a"], ["c", "b"]])
    got = told_apart(np.array([7, 7, 7, 7, 7], np.uint64), keys)
    assert got[0] == got[2] and got[1] == got[4] and len(set(got.tolist())) == 3
    # a stays, b is new and c is gone although all three have one hash.
    rows = [("s1", True, "s2", "a", 1), ("s2", False, None, "a", 1), ("s1", True, "s2", "c", 5), ("s2", False, None, "b", 6)]
    batch = pa.RecordBatch.from_pydict({
        "scan": [r[0] for r in rows], "is_first": [r[1] for r in rows], "next_scan": pa.array([r[2] for r in rows], pa.string()), "is_file": [True] * 4, "item_key": [r[3] for r in rows],
        "loaded": [0] * 4, "kh": [7] * 4, "known": [True] * 4, "vh": [r[4] for r in rows],
    })
    out = pa.Table.from_batches(_bucket_task(iter([batch]))).to_pylist()
    assert {(r["item_key"], r["change"], r["scan_id"]) for r in out} == {("b", "added", "s2"), ("c", "removed", "s2")}
