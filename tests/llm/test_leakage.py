import random

import numpy as np

from lodestrata.llm import leakage
from lodestrata.llm.leakage import BUCKETS, HALF, Passages, common, hashed, leaked_items, words

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "lar nix tov sed pim rug wan zek".split()]


def sentence(rng, n=16):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make(rng):
    items = [(i, "s", ". ".join(["State only the final number", *(sentence(rng) for _ in range(5))]) + ".", sentence(rng, 2)) for i in range(20)]
    docs, want = [], set()
    for d in range(200):
        parts = [sentence(rng) for _ in range(8)]
        if d % 10 == 3:
            k = rng.randrange(20)
            own = items[k][2].split(". ")[1:]
            rng.shuffle(own)
            keep = own[: rng.choice([1, 4, 5])]
            bent = []
            for s in keep:
                w = s.upper().split()
                w[rng.randrange(len(w))] = "changed"
                bent.append("<p>" + "​ ".join(w) + "</p>")
            parts[2:2] = bent
            if len(keep) >= 4:
                want.add((k, d))
        docs.append((d, "\n".join(parts)))
    return items, docs, want


def test_matches_planted_cases(spark):
    items, docs, want = make(random.Random(4))
    docs += [(900, None), (901, "  "), (902, "word " * 40_000), (0, docs[0][1])]
    dd = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, coverage int")
    ii = spark.createDataFrame([(*i, 0) for i in items] + [(99, "s", None, None, 0), (98, "s", "", "", 0)], "item_id long, suite string, question string, answer string, doc_id int")
    got = {(r.item_id, r.doc_id) for r in leaked_items(dd, ii).collect()}
    assert got == want
    assert leaked_items(dd.limit(0), ii).count() == 0
    assert leaked_items(dd, ii.limit(0)).count() == 0


def test_parts_of_sentences_count(spark):
    rng = random.Random(8)
    one, first, second, other = (sentence(rng, n).split() for n in (30, 20, 30, 30))
    stock = "please read the text below and answer with one word"
    items = [(1, " ".join(one) + "."), (2, " ".join(first) + ". " + " ".join(second) + "."), (3, stock + " " + " ".join(other[:14]) + "."), (4, stock + " " + " ".join(other[14:28]) + ".")]
    around = lambda w: sentence(rng, 40) + " " + " ".join(w) + " " + sentence(rng, 40)
    docs = [(1, around(one[7:23])), (2, around(first) + around(second[:14])), (3, around(one[:5])), (4, around(one[i] for i in range(0, 30, 2))), (5, around([stock])), (6, around(first[:9]) + around(second[:9]))]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame([(k, q, "") for k, q in items], "item_id long, question string, answer string")
    got = {(r.item_id, r.doc_id): r.coverage for r in leaked_items(dd, ii).collect()}
    assert set(got) == {(1, 1), (2, 2)}
    assert got[1, 1] >= 16 / 30 - 1e-6 and got[2, 2] >= 34 / 50 - 1e-6  # words around may fit by chance


def test_blocks_of_items_make_no_difference(spark, monkeypatch):
    rng = random.Random(9)
    stock = sentence(rng, 20)
    own = [sentence(rng, 16) for _ in range(4)]
    ii = spark.createDataFrame([(k, f"{stock}. {q}.", "") for k, q in enumerate(own)], "item_id long, question string, answer string")
    dd = spark.createDataFrame([(0, stock), (1, sentence(rng) + " " + own[1]), (2, sentence(rng) + " " + own[2] + ". " + stock)], "doc_id long, text string")
    found = []
    for block in (5_000, 1):
        monkeypatch.setattr(leakage, "ITEMS_PER_PASS", block)
        found.append({(r.item_id, r.doc_id, r.coverage) for r in leaked_items(dd, ii).collect()})
    assert found[0] == found[1] == {(1, 1, 1.0), (2, 2, 1.0)}


def test_candidate_search_finds_what_an_exact_scan_finds(spark):
    """Recall of the latent search over sentences of which every fourth word was replaced, at any offset."""
    rng = random.Random(12)
    asked = [sentence(rng) for _ in range(60)]
    docs, planted = [], []
    for d in range(300):
        parts = [sentence(rng, rng.randrange(5, 30)) for _ in range(6)]
        if d % 2:
            k = rng.randrange(len(asked))
            w = asked[k].split()
            for i in range(rng.randrange(4), len(w), 4):
                w[i] = rng.choice(WORDS)
            parts.insert(3, " ".join(w))
            planted.append((d, k))
        docs.append((d, " ".join(parts)))
    tokens = leakage.tokenized(spark.createDataFrame(docs, "doc_id long, text string"))
    basis = leakage.latent_basis(tokens)
    items = leakage.Items([(k, q, "", []) for k, q in enumerate(asked)])
    texts = dict(docs)
    exact = {(d, k) for d in texts for k in range(len(asked)) if leakage._found_in(items.tokens[k], hashed(words(texts[d])))}
    assert set(planted) <= exact
    near = set()
    queries = items.latent(basis)
    for d, text in texts.items():
        flat = np.array(hashed(words(text)), np.uint32)
        x = Passages(np.array([len(flat)]), flat).project(basis)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        near |= {(d, int(k)) for k in np.flatnonzero((x @ queries.T >= leakage.NEAR).any(axis=0))}
    assert len(exact & near) >= 0.9 * len(exact)


def test_answers_decide_where_words_were_replaced(spark):
    rng = random.Random(21)
    whole = sentence(rng, 40).split()
    body = " ".join(whole[:18])
    rest = sentence(rng, 30)
    ii = spark.createDataFrame([(1, " ".join(whole) + ".", "zanzibar quorum")], "item_id long, question string, answer string")
    dd = spark.createDataFrame([(1, f"{rest} {body} {rest}"), (2, f"{rest} {body} {rest} Zanzibar quorum."), (3, f"{rest} Zanzibar quorum {rest}")], "doc_id long, text string")
    got = {(r.item_id, r.doc_id): (r.coverage, r.has_answer) for r in leaked_items(dd, ii).collect()}
    assert set(got) == {(1, 2)} and 0.4 <= got[1, 2][0] < 0.5 and got[1, 2][1]


def test_an_id_with_several_questions(spark):
    rng = random.Random(22)
    one, two = sentence(rng, 30), sentence(rng, 30)
    ii = spark.createDataFrame([(1, one + ".", ""), (1, two + ".", "")], "item_id long, question string, answer string")
    dd = spark.createDataFrame([(1, sentence(rng) + " " + one), (2, sentence(rng) + " " + two), (3, sentence(rng, 60))], "doc_id long, text string")
    assert {(r.item_id, r.doc_id) for r in leaked_items(dd, ii).collect()} == {(1, 1), (1, 2)}


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common(a, b) == table[-1][-1]


def test_projection_equals_dense_products():
    rng = np.random.default_rng(2)
    lengths = np.array([5, 12, 13, 40, 24])
    flat = rng.integers(0, 2**32, lengths.sum(), dtype=np.uint32)
    p = Passages(lengths, flat)
    rows, at = [], 0
    for n in lengths:
        blocks = [flat[at + a : at + min(a + HALF, n)] for a in range(0, n, HALF)]
        at += n
        rows += [np.concatenate(blocks[i : i + 2]) for i in range(max(1, len(blocks) - 1))]
    dense = np.stack([np.bincount(r & (BUCKETS - 1), minlength=BUCKETS) for r in rows]).astype(np.float32)
    basis = rng.standard_normal((BUCKETS, 3)).astype(np.float32)
    x = p.project(basis)
    assert np.allclose(x, dense @ basis, atol=1e-4) and np.allclose(p.transposed(x), dense.T @ x, atol=1e-2)


def test_words_are_normalised():
    assert words("<p>Café&nbsp;re​ad, THE end</p>") == ["cafe", "read", "the", "end"]
    assert hashed(["a", "b"]) == hashed(["a", "b"])
