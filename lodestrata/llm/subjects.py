"""Subject areas of documents by class-association rules.

Sentences of labelled documents are transactions of words and classes; parallel frequent-pattern growth mines
their frequent sets, those of words together with a class are rules. A rule that tells no more than its own
parts is redundant and pruned. A sentence is scored by the calibrated evidence of the most specific rules
that match it; a document has the subjects that about a fifth of its sentences or more are about.
Rules are mined twice: the labels are of documents, wrong at times, and silent on which sentences they mean, so
the first rules re-label the sentences from which the second, sharper ones are mined.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.runtime import materialize, ship_package

#: Bound of the labelled documents that rules are mined from; all others are scored.
MAX_LABELLED = 200_000
#: Least occurrences of a word or set, as a number and as a share of the sentences.
MIN_COUNT, MIN_SHARE = 4, 5e-5
#: How much more often than at large, and how often at least, a set must go with a class: by the labels of
#: documents, and by those of sentences, which are cleaner.
MIN_LIFT = 2.0
CONFIDENCE_BY_DOCUMENT, CONFIDENCE_BY_SENTENCE = 0.3, 0.35
#: Sets of several words are rules where they are not rare, as one mislabelled text can make a rare set.
MIN_TOGETHER = 12
LONGEST = 3
SMOOTHING = 2.0
SURE = 0.6
SHARE = 0.17
MOST_SUBJECTS = 3
CLASS = "class="

_MARKUP = re.compile(r"<[^<>\n]{1,200}>|```[\s\S]*?```|`[^`\n]*`|https?://\S+|^\s*[|>].*$", re.M)
_SPLIT = re.compile(r"(?<=[.!?;])\s+|\n\s*\n|\n(?=\s*(?:[-*+•]|\d+[.)])\s)|(?<=[.!?])\n")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={2,}\s|\*\*[^*]+\*\*\s*$)")
_WORD = re.compile(r"[^\W\d_]{3,}")


def sentences(text: str | None) -> list[list[str]]:
    """Words of every sentence; markup, code and headings are none."""
    if not text or not text.strip():
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "<" in text:
        text = re.sub(r"</(?:p|li|h\d|div|td|tr)>|<br\s*/?>", "\n\n", text, flags=re.I)
    text = html.unescape(_MARKUP.sub(" ", text))
    out = []
    for piece in _SPLIT.split(text):
        if not piece or _HEADING.match(piece):
            lines = piece.split("\n", 1) if piece else []
            if len(lines) < 2:
                continue
            piece = lines[1]
        found = _WORD.findall(piece.lower())
        if len(found) >= 3:
            out.append(found)
    if not out and (found := _WORD.findall(text.lower())):
        out.append(found)
    return out


def surely(part: int, n: int, z: float = 1.28) -> float:
    """Lower bound of a share (Wilson), so that a few chance finds make no rule."""
    p = part / n
    return (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)


class Rules:
    """Pruned rules and how they score a sentence."""

    def __init__(self, sets: list[tuple[list[str], int]], prior: dict[str, float], least: float, longest: int):
        """``sets``: frequent sets of words and classes with their counts; ``least``: confidence of a rule."""
        self.classes = sorted(prior)
        self.prior = prior
        count: dict[frozenset, int] = {}
        by_class: dict[frozenset, Counter] = defaultdict(Counter)
        for items, n in sets:
            words = frozenset(i for i in items if not i.startswith(CLASS))
            own = [i[len(CLASS) :] for i in items if i.startswith(CLASS)]
            if not words or len(words) > longest:
                continue
            if not own:
                count[words] = n
            elif len(own) == 1:
                by_class[words][own[0]] = n
        self.evidence: dict[frozenset, dict[str, float]] = {}
        #: Evidence of words that are no rules, for documents in which no rule matches.
        self.hints: dict[str, tuple[float, ...]] = {}
        for words in sorted(count, key=lambda w: (len(w), sorted(w))):
            n, got = count[words], by_class.get(words, {})
            if len(words) > 1 and n < MIN_TOGETHER:
                continue
            vector = {c: math.log((got.get(c, 0) + SMOOTHING * prior[c]) / (n + SMOOTHING) / prior[c]) for c in self.classes}
            top = max(self.classes, key=lambda c: (vector[c], c))
            if len(words) == 1:
                self.hints[next(iter(words))] = tuple(vector[c] for c in self.classes)
            if vector[top] < math.log(MIN_LIFT) or surely(got.get(top, 0), n) < least:
                continue
            if len(words) > 1:
                parts = [self.evidence[p] for k in range(1, len(words)) for p in map(frozenset, combinations(sorted(words), k)) if p in self.evidence]
                # Redundant: some part of it already says the same at least as clearly.
                if any(max(p, key=p.get) == top and p[top] >= vector[top] - 0.25 for p in parts):
                    continue
                # Words that each speak clearly for one other class do not speak for this one together.
                if parts and all(max(p, key=p.get) != top for p in parts) and len({max(p, key=p.get) for p in parts}) == 1:
                    continue
            self.evidence[words] = vector
        self.items = {w for s in self.evidence for w in s}
        self.longest = max(map(len, self.evidence), default=0)
        #: Every rule once, under its rarest word, with its place in the order of use: the most specific come first.
        self.under: dict[str, list[tuple[int, frozenset]]] = defaultdict(list)
        for place, words in enumerate(sorted(self.evidence, key=lambda f: (-len(f), sorted(f)))):
            self.under[min(words, key=lambda w: (count.get(frozenset([w]), 0), w))].append((place, words))

    def score(self, words: list[str]) -> tuple[str, float] | None:
        """Most likely class of a sentence and its probability; None if no rule matches."""
        hits = {w for w in words if w in self.items}
        if not hits:
            return None
        matched = sorted((place, f) for w in hits for place, f in self.under.get(w, ()) if f <= hits)
        if not matched:
            return None
        used: set[str] = set()
        total = {c: 0.0 for c in self.classes}
        for _, rule in matched:  # what the more specific ones cover counts once
            if rule <= used:
                continue
            used |= rule
            for c, v in self.evidence[rule].items():
                total[c] += v
        top = max(self.classes, key=lambda c: (total[c], c))
        norm = sum(self.prior[c] * math.exp(total[c] - total[top]) for c in self.classes)
        return top, self.prior[top] / norm


    def guess(self, words: list[str]) -> str | None:
        """Most likely class by all words, rules or not, and how common the classes are; None if nothing was learnt."""
        if not self.hints:
            return None
        total = np.log([self.prior[c] for c in self.classes])
        for w in set(words) & self.hints.keys():
            total += self.hints[w]
        return self.classes[int(np.argmax(total))]


def known_subject(label: Column, subjects: list[str]) -> Column:
    """The subject a label means: letter case and up to two wrong letters are forgiven."""
    said = F.lower(F.trim(label))
    near = F.array_min(F.array(*(F.struct(F.levenshtein(said, F.lit(s.lower())).alias("d"), F.lit(s).alias("s")) for s in subjects)))
    return F.when(near["d"] <= 2, near["s"])


def _mine(found: DataFrame, classes: list[str], least: float, longest: int) -> Rules:
    """``found``: sentence, words, classes. Rules of words for classes."""
    spark = found.sparkSession
    total = found.count()
    support = max(MIN_COUNT, math.ceil(MIN_SHARE * total))
    of_class = {r["c"]: r["n"] for r in found.select(F.explode("classes").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    labelled = sum(of_class.values())
    prior = {c: (of_class.get(c, 0) + 1) / (labelled + len(classes)) for c in classes}
    said = found.select("classes", F.explode(F.array_distinct("words")).alias("w"))
    tally = [F.count_if(F.array_contains("classes", c)).alias(f"c{i}") for i, c in enumerate(classes)]
    counted = said.groupBy("w").agg(F.count("*").alias("n"), *tally).where(F.col("n") >= support).collect()
    counted.sort(key=lambda r: (-r["n"], r["w"]))
    vocabulary = [r["w"] for r in counted]
    sets: list[tuple[list[str], int]] = []
    for r in counted:
        sets += _with_classes([r["w"]], r["n"], [r[f"c{i}"] for i in range(len(classes))], classes)
    if longest > 1 and vocabulary:
        alone = Rules(sets, prior, least, 1).evidence
        for r in _grow(found, vocabulary, classes, prior, alone, least, longest, max(support, MIN_TOGETHER)).collect():
            sets += _with_classes([vocabulary[i] for i in r["ids"]], r["n"], r["got"], classes)
    return Rules(sets, prior, least, longest)


def _with_classes(words: list[str], n: int, got: list[int], classes: list[str]) -> list[tuple[list[str], int]]:
    return [(words, n), *(([*words, CLASS + c], k) for c, k in zip(classes, got, strict=True) if k)]


def _grow(found: DataFrame, vocabulary: list[str], classes: list[str], prior: dict[str, float], alone: dict[frozenset, dict[str, float]], least: float, longest: int, support: int) -> DataFrame:
    """(ids, n, got): frequent sets of two and, if ``longest`` is three, three words that may be rules.

    Pattern growth over all words of ``vocabulary``, whose order is that of falling frequency: every word has its
    conditional transactions, the more frequent words beside it, and its sets are counted in one task. Only after
    counting, sets that ``Rules`` would drop for their confidence, lift or a single word that says the same are left out.
    """
    spark = found.sparkSession
    number = {w: i for i, w in enumerate(vocabulary)}
    place = {c: i for i, c in enumerate(classes)}
    weights = np.array([prior[c] for c in classes])[:, None]
    # The clearest class of the single-word rules and how clear it is; of equal ones the last, as in Rules.
    clear = np.full(len(vocabulary), -1)
    how = np.full(len(vocabulary), -np.inf)
    for words, v in alone.items():
        i = number[next(iter(words))]
        clear[i], how[i] = max((x, place[c]) for c, x in v.items())[1], max(v.values())
    shared = spark.sparkContext.broadcast((number, place, weights, clear, how))

    def conditional(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, place = shared.value[:2]
        columns = ["item", "beside", "said", "n"]
        for b in stream:
            seen: Counter[tuple[int, bytes, bytes]] = Counter()
            held = 0
            for words, own in zip(b["words"], b["classes"], strict=True):
                ids = np.array(sorted({number[w] for w in words if w in number}), dtype=np.int32)
                said = np.array(sorted({place[c] for c in own if c in place}), dtype=np.int32).tobytes()
                for k in range(1, len(ids)):
                    seen[int(ids[k]), ids[:k].tobytes(), said] += 1
                    held += 4 * k
                    if held > 32_000_000:
                        yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=columns)
                        seen.clear()
                        held = 0
            yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=columns)

    def promising(sets: np.ndarray, n: np.ndarray, got: np.ndarray) -> pd.DataFrame:
        """``sets``: ids, one set a row; ``got``: counts by class and set."""
        weights, clear, how = shared.value[2:]
        vector = np.log((got + SMOOTHING * weights) / (n + SMOOTHING) / weights)
        top = len(weights) - 1 - vector[::-1].argmax(axis=0)
        at = np.arange(len(n))
        value = vector[top, at]
        keep = (value >= math.log(MIN_LIFT) - 1e-9) & (surely(got[top, at], n) >= least - 1e-9)
        keep &= ~((clear[sets] == top[:, None]) & (how[sets] >= value[:, None] - 0.25 + 1e-9)).any(axis=1)
        return pd.DataFrame({"ids": pd.Series(sets[keep].tolist(), dtype=object), "n": n[keep].astype("int64"), "got": pd.Series(got[:, keep].T.astype("int64").tolist(), dtype=object)})

    def count(group: pd.DataFrame) -> pd.DataFrame:
        item, classes_ = int(group["item"].iloc[0]), len(shared.value[1])
        n = group["n"].to_numpy(dtype="float64")
        flat = np.frombuffer(b"".join(group["beside"]), dtype=np.int32)
        row = np.repeat(np.arange(len(n)), group["beside"].str.len().to_numpy() // 4)
        spoken = np.zeros((len(n), classes_))
        spoken[np.repeat(np.arange(len(n)), group["said"].str.len().to_numpy() // 4), np.frombuffer(b"".join(group["said"]), dtype=np.int32)] = 1.0
        spoken *= n[:, None]
        often = np.flatnonzero(np.bincount(flat, weights=n[row]) >= support)
        if not len(often):
            return promising(np.empty((0, 2), dtype=int), np.empty(0), np.empty((classes_, 0)))
        column = np.full(flat.max() + 1, -1)
        column[often] = np.arange(len(often))
        inside = column[flat] >= 0
        flat, row = column[flat[inside]], row[inside]
        step = max(1, 4_000_000 // len(often))

        def together(weight: np.ndarray) -> np.ndarray:
            total = np.zeros((len(often), len(often)))
            used = np.flatnonzero(weight)
            for start in range(0, len(used), step):
                part = used[start : start + step]
                at = np.full(len(n), -1)
                at[part] = np.arange(len(part))
                mine = at[row] >= 0
                x = np.zeros((len(part), len(often)))
                x[at[row[mine]], flat[mine]] = 1.0
                total += x.T @ (x * weight[part, None])
            return total

        both = together(n)
        first, second = np.nonzero(np.triu(both >= support, 1)) if longest > 2 else (np.empty(0, dtype=int), np.empty(0, dtype=int))
        pairs, triples = [], []
        for c in range(classes_):
            of_class = together(spoken[:, c])
            pairs.append(np.diag(of_class))
            triples.append(of_class[first, second])
        two = promising(np.column_stack([often, np.full(len(often), item)]), np.diag(both), np.array(pairs))
        three = promising(np.column_stack([often[first], often[second], np.full(len(first), item)]), both[first, second], np.array(triples))
        return pd.concat([two, three], ignore_index=True)

    beside = found.select("words", "classes").mapInPandas(conditional, "item int, beside binary, said binary, n long")
    return beside.groupBy("item").applyInPandas(count, "ids array<int>, n long, got array<long>")


def _sentences_of(documents: DataFrame) -> DataFrame:
    """(doc_id, sentence, words) with a number per sentence of a document."""
    schema = T.StructType([*(f for f in documents.schema if f.name != "text"), T.StructField("sentence", T.StringType()), T.StructField("words", T.ArrayType(T.StringType()))])
    rest = [f.name for f in documents.schema if f.name != "text"]

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in stream:
            rows = [(*(keys), f"{keys[0]}:{i}", s) for *keys, text in b[[*rest, "text"]].itertuples(index=False, name=None) for i, s in enumerate(sentences(text))]
            yield pd.DataFrame(rows, columns=schema.names)

    return documents.mapInPandas(run, schema)


def learn(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = MAX_LABELLED) -> Rules:
    """Rules from the labelled documents, at most ``most`` of them (taken by the hash of their id)."""
    spark = documents.sparkSession
    said = labels.select("doc_id", known_subject(F.col("subject"), subjects).alias("c")).where("c is not null and doc_id is not null")
    per_doc = said.groupBy("doc_id").agg(F.array_sort(F.collect_set("c")).alias("classes")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = documents.where("text is not null").select("doc_id", "text").join(per_doc, "doc_id").select("doc_id", "classes", "text").distinct()
    found = materialize(_sentences_of(texts))
    first = _mine(found, subjects, CONFIDENCE_BY_DOCUMENT, LONGEST)
    shared = spark.sparkContext.broadcast(first)

    def relabel(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = shared.value
        for b in stream:
            # Only where rules and label agree; else a chance rule would confirm itself.
            got = [rules.score(list(w)) for w in b["words"]]
            b["classes"] = [[g[0]] if g and g[1] >= SURE and g[0] in set(c) else [] for g, c in zip(got, b["classes"], strict=True)]
            yield b

    return _mine(found.mapInPandas(relabel, found.schema), subjects, CONFIDENCE_BY_SENTENCE, LONGEST)


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, subject, share, sentences): subjects of every document with the share of sentences about them.

    Null and blank texts have none; every other document has at least the subject with the most evidence and at
    most three. Where no rule matches, the words that are no rules and the subjects' frequency decide, with a
    share of 0. Ties go to the alphabetically first subject. Labels that name no
    subject are ignored; without labels nothing can be learnt and no rows result. Repeated rows count once.
    """
    spark = documents.sparkSession
    ship_package(spark)
    names = sorted({r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect()})
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("subject", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("sentences", T.IntegerType())])
    if not names:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(learn(documents, labels, names))

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = shared.value
        for b in stream:
            rows = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                found = sentences(text)
                weight: Counter[str] = Counter()
                doubt: Counter[str] = Counter()
                for s in found:
                    got = rules.score(s)
                    if got:
                        (weight if got[1] >= SURE else doubt)[got[0]] += 1
                n = len(found)
                top = sorted(weight, key=lambda c: (-weight[c], c))
                chosen = [c for c in top if weight[c] >= share * n][:MOST_SUBJECTS]
                if not chosen and (weight or doubt):
                    chosen = [min(weight or doubt, key=lambda c: (-weight[c], -doubt[c], c))]
                elif not chosen and text.strip():
                    guessed = rules.guess([w for s in found for w in s])
                    chosen = [guessed] if guessed else []
                rows += [(key, c, round(weight[c] / max(n, 1), 6), n) for c in chosen]
            yield pd.DataFrame(rows, columns=schema.names)

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, schema).distinct()
