from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import vocab
from lodestrata.llm.packing import containers, count_tokens, fill_report, fullest, pack


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=10), st.integers(0, 60))
def test_fullest_is_optimal(sizes, room):
    got = fullest(sorted(Counter(sizes).items(), reverse=True), room)
    assert not got - Counter(sizes)
    best = max(sum(c) for k in range(len(sizes) + 1) for c in combinations(sizes, k) if sum(c) <= room)
    assert sum(s * n for s, n in got.items()) == best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_pack_uses_every_size_once(sizes):
    used: Counter = Counter()
    for content, times in pack(Counter(sizes), 100):
        assert sum(s * n for s, n in content.items()) <= 100
        for s, n in content.items():
            used[s] += n * times
    assert +used == Counter(sizes)


def test_containers(spark):
    rows = [(i, "word " * (1 + i * 37 % 900), 0) for i in range(300)] + [(5, "word " * (1 + 5 * 37 % 900), 0), (900, None, 0), (901, " \n\t", 0), (902, "word " * 9000, 0), (None, "a b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = containers(df, per_shard=100).collect()
    text = dict((r[0], r[1]) for r in rows)
    want = {k for k, t in text.items() if t and t.strip()}
    assert {r.doc_id for r in got} == want
    assert len({(r.doc_id, r.piece) for r in got}) == len(got)
    encode = vocab.encoding(vocab.default_path()).encode_ordinary
    total: Counter = Counter()
    use: Counter = Counter()
    for r in got:
        total[r.doc_id] += r.tokens
        use[r.container] += r.tokens
        assert r.pieces == (-(-len(encode(text[r.doc_id])) // 2048))
    assert all(total[k] == len(encode(text[k])) for k in want) and max(use.values()) <= 2048
    report = fill_report(containers(df)).first()
    assert report.containers <= report.least + 1
    assert containers(df.limit(0)).count() == 0


def test_counting_in_parts_is_exact():
    encode = vocab.encoding(vocab.default_path()).encode_ordinary
    text = "one two, three  four\nfive 6 " * 20_000
    assert count_tokens(text, encode) == len(encode(text))
