import itertools
import math
import random
from collections import Counter

import pytest

from lodestrata.llm.subjects import CLASS, Rules, _mine, document_subjects, sentences, surely

TERMS = {
    "music": "violin tempo choir melody octave chord".split(), "law": "court plaintiff verdict clause appeal statute".split(), "sport": "league striker penalty referee medal sprint".split(),
}
FRAMES = ["The summary names the {} and the {} today.", "Nobody should edit the {} before the {} is here.", "A missing {} usually means the {} is open.", "Questions about the {} come up with the {} again."]
FILLER = ["More detail follows further down.", "Open points are listed below."]


def make(rng, n):
    docs, want = [], []
    for d in range(n):
        main, other = rng.sample(sorted(TERMS), 2)
        plan = [main] * 6 + ([other] * 4 if d % 3 == 0 else [other] if d % 3 == 1 else [])
        body = [rng.choice(FRAMES).format(*rng.sample(TERMS[c], 2)) for c in plan] + [rng.choice(FILLER)]
        rng.shuffle(body)
        docs.append((d, " ".join(body)))
        want.append((d, {main, other} if d % 3 == 0 else {main}, main))
    return docs, want


def test_held_out_accuracy(spark):
    rng = random.Random(3)
    docs, want = make(rng, 400)
    labels = [(d, (" " + main.upper() if d % 7 == 0 else main[:-1] + "x" if d % 11 == 0 else rng.choice(sorted(TERMS)) if d % 13 == 0 else main), "a", None) for d, _, main in want[:200]]
    docs += [(900, None), (901, " \n"), (902, docs[0][1] * 3000), (0, docs[0][1])]
    dd = spark.createDataFrame([(*x, "x") for x in docs], "doc_id long, text string, subject string")
    ll = spark.createDataFrame([*labels, (None, "law", "a", None), (5, None, "a", None), (6, "nothing known", "a", None)], "doc_id long, subject string, annotator string, words string")
    ss = spark.createDataFrame([(s, "d") for s in TERMS], "subject string, description string")
    got: dict = {}
    for r in document_subjects(dd, ll, ss).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [got.get(d) == s for d, s, _ in want[200:]]
    assert sum(held) >= 0.97 * len(held)
    assert 900 not in got and 901 not in got and got[902] == want[0][1]
    assert document_subjects(dd.limit(0), ll, ss).count() == 0
    assert document_subjects(dd, ll.limit(0), ss).count() == 0
    assert document_subjects(dd, ll, ss.limit(0)).count() == 0


def test_every_document_that_is_not_blank_has_a_subject(spark):
    rng = random.Random(5)
    docs, want = make(rng, 60)
    docs += [(700, "Nothing here is known to anyone."), (701, "!!"), (702, "verdict"), (703, " ")]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ll = spark.createDataFrame([(d, main, "a", None) for d, _, main in want[:30]], "doc_id long, subject string, annotator string, words string")
    ss = spark.createDataFrame([(s, "d") for s in TERMS], "subject string, description string")
    got: dict = {}
    for r in document_subjects(dd, ll, ss).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert set(got) == {d for d, _ in docs} - {703} and all(1 <= len(x) <= 3 for x in got.values())
    assert got[702] == {"law"}


def test_redundant_rules_are_pruned():
    rules = Rules([(["x"], 100), (["x", "class=a"], 98), (["x", "z"], 30), (["x", "z", "class=a"], 29)], {"a": 0.2, "b": 0.8}, 0.3, 3)
    assert set(rules.evidence) == {frozenset("x")}
    assert rules.score(["x", "z"])[0] == "a" and rules.score(["z"]) is None


def test_rules_of_several_words_fire_in_long_sentences():
    singles = [f"w{i:02}" for i in range(40)]
    sets = [x for w in singles for x in (([w], 100), ([w, "class=b"], 45), ([w, "class=a"], 5))]
    trio = ["k", "l", "m"]
    sets += [x for w in trio for x in (([w], 400), ([w, "class=a"], 40))] + [(trio, 60), ([*trio, "class=a"], 60)]
    rules = Rules(sets, {"a": 0.05, "b": 0.2, "c": 0.75}, 0.35, 3)
    assert frozenset(trio) in rules.evidence and frozenset("k") not in rules.evidence
    for n in (0, 1, 5, 20, 21, 22, 40):
        total = {c: rules.evidence[frozenset(trio)][c] + sum(rules.evidence[frozenset([w])][c] for w in singles[:n]) for c in "abc"}
        weight = {c: rules.prior[c] * math.exp(total[c]) for c in "abc"}
        top, sure = rules.score([*trio, *singles[:n]])
        assert top == max(total, key=total.get) and sure == pytest.approx(weight[top] / sum(weight.values()))


def test_mining_finds_words_that_are_telling_only_together(spark):
    rng = random.Random(11)
    classes = ["a", "b", "c", "d"]
    # Each of x and y, and each two of p, q and r, are as frequent with every class; together they mean one.
    rows = []
    for i in range(1200):
        c = classes[i % 4]
        words = rng.sample([f"n{k}" for k in range(12)], rng.randint(2, 5)) + [f"{c}{rng.randint(0, 4)}"] * (i % 3 == 0)
        u, v = rng.random() < 0.5, rng.random() < 0.5
        words += ["x"] * u + ["y"] * v
        if u and v:
            c = "a"
        if rng.random() < 0.3:
            got = [w for w in "pqr" if rng.random() < 0.6]
            words += got
            c = "b" if len(got) == 3 else c
        rows.append((str(i), words + words[:1], [c] if i % 50 else [c, classes[(i + 1) % 4]] if i % 100 else []))
    found = spark.createDataFrame(rows, "sentence string, words array<string>, classes array<string>").repartition(3)
    counts: Counter = Counter()
    for _, words, own in rows:
        for k in (1, 2, 3):
            for w in itertools.combinations(sorted(set(words)), k):
                counts[w] += 1
                for c in own:
                    counts[(*w, CLASS + c)] += 1
    labelled = Counter(c for *_, own in rows for c in own)
    prior = {c: (labelled[c] + 1) / (sum(labelled.values()) + 4) for c in classes}
    least = 0.5
    want = Rules([(list(w), n) for w, n in counts.items() if n >= 4 or w[-1].startswith(CLASS)], prior, least, 3)
    got = _mine(found, classes, least, 3)
    assert frozenset("xy") in got.evidence and frozenset("pqr") in got.evidence
    assert frozenset("x") not in got.evidence and frozenset("y") not in got.evidence
    assert set(got.evidence) == set(want.evidence)
    for w, v in want.evidence.items():
        assert got.evidence[w] == pytest.approx(v)


def test_sentences():
    assert sentences(None) == [] and sentences(" ") == []
    assert sentences("# Heading\n\nOne two three. Four five six!\n- seven eight nine") == [["one", "two", "three"], ["four", "five", "six"], ["seven", "eight", "nine"]]
    assert sentences("<p>alpha beta gamma</p><p>delta épsilon zeta</p>") == [["alpha", "beta", "gamma"], ["delta", "épsilon", "zeta"]]


def test_lower_bound():
    assert surely(1, 1) < 0.5 and surely(90, 100) == pytest.approx(0.855, abs=0.02)
