"""Evaluation texts that leaked into a corpus.

Latent semantic retrieval: every document is cut into overlapping passages of words, a randomised SVD of their
TF-IDF matrix is computed where the passages lie, and each sentence of each item is compared with every
passage in the latent space. A sentence found near is then checked by its longest common subsequence with the words
around; for an item with a confirmed sentence all its sentences are looked for in the whole document. Parts of
sentences count by their runs of words that no other item has, which are looked up in every document.

What travels is bounded by parameters: document frequencies (vocabulary buckets), sketches (buckets times rank) and the
items of one block. Statistics cover all passages; there is no cap on candidates.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.runtime import materialize, ship_package

BUCKETS = 1 << 14
RANK, OVERSAMPLE = 64, 8
#: Words of half a passage; passages are two neighbouring halves.
HALF = 12
#: Latent cosine from which a passage is looked at, share of a sentence that must be in order, share of an item.
NEAR, IN_ORDER, LEAKED = 0.5, 0.6, 0.5
#: Share that is enough where the answer stands in the document too: words replaced by others are lost to the ordered-word check.
WITH_ANSWER = 0.4
#: Words in a row from which a part of a sentence counts.
RUN = 5
ITEMS_PER_PASS = 5_000
#: Words of a piece of a sentence, bits of a bitmap of words, and blocks after its first that a piece may reach into.
PIECE, BITS = 40, 1024
AHEAD = (PIECE + PIECE // 2 + 6) // HALF + 1
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]{1,200}>")
_UNSEEN = re.compile("[​-‏‪-‮⁠-⁤﻿­]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_hashes: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Lower-case words without markup, invisible characters and accents."""
    text = _UNSEEN.sub("", html.unescape(_TAG.sub(" ", text)) if "<" in text or "&" in text else text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.lower())


def hashed(tokens: list[str]) -> list[int]:
    if len(_hashes) > 500_000:
        _hashes.clear()
    get = _hashes.get
    out = []
    for t in tokens:
        h = get(t)
        if h is None:
            h = _hashes[t] = zlib.crc32(t.encode())
        out.append(h)
    return out


def runs(tokens: np.ndarray) -> np.ndarray:
    """Hashes of all ``RUN`` words in a row."""
    n = max(0, len(tokens) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for j in range(RUN):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[j : j + n].astype(np.uint64) + np.uint64(1)
    return out


def split(question: str | None) -> list[list[str]]:
    """Words of every sentence of a question."""
    return [w for s in _SENTENCE.split(question or "") if (w := words(s))]


def units(question: str | None) -> list[str]:
    """A question's sentences and runs, for finding those that items share."""
    found = split(question)
    return sorted({"s" + " ".join(w) for w in found} | {f"r{h}" for w in found for h in runs(np.array(hashed(w), np.uint32)).tolist()})


def common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        m = masks.get(x)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def contains(doc: list[int], part: list[int]) -> bool:
    """Whether ``part`` stands in ``doc``; nothing stands nowhere."""
    return bool(part) and any(doc[i] == part[0] and doc[i : i + len(part)] == part for i in range(len(doc) - len(part) + 1))


class Passages:
    """Blocks of ``HALF`` words of a batch of documents; a passage is a block and the next one of its document."""

    def __init__(self, lengths: np.ndarray, flat: np.ndarray):
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        per_doc = -(-lengths // HALF)
        self.block_doc = np.repeat(np.arange(len(lengths)), per_doc)
        index = np.arange(len(self.block_doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        self.block_at = index * HALF
        doc_of_token = np.repeat(np.arange(len(lengths)), lengths)
        offset = np.arange(len(flat)) - starts[doc_of_token]
        self.token_block = (np.cumsum(per_doc) - per_doc)[doc_of_token] + offset // HALF
        last = np.ones(len(self.block_doc), bool)
        last[:-1] = self.block_doc[1:] != self.block_doc[:-1]
        # A passage per block that has a successor, and one for documents of a single block.
        self.passage_block = np.flatnonzero(~last | (per_doc[self.block_doc] == 1))
        self.second = np.where(last[self.passage_block], self.passage_block, self.passage_block + 1)
        self.buckets = (flat & np.uint32(BUCKETS - 1)).astype(np.int64)
        self.blocks = len(self.block_doc)

    def project(self, basis: np.ndarray) -> np.ndarray:
        """Latent vectors of the passages; the rows of ``basis`` are weighted terms."""
        sums = np.zeros((self.blocks, basis.shape[1]), np.float32)
        step = 100_000
        for a in range(0, len(self.buckets), step):
            at = self.token_block[a : a + step]
            heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            sums[at[heads]] += np.add.reduceat(basis[self.buckets[a : a + step]], heads, axis=0)
        out = sums[self.passage_block]
        two = self.second != self.passage_block
        out[two] += sums[self.second[two]]
        return out

    def around(self, tokens: np.ndarray) -> np.ndarray:
        """A bitmap of the words of each block, the one before and the next ``AHEAD``, of its document."""
        bits = np.zeros((self.blocks, BITS // 64), np.uint64)
        np.bitwise_or.at(bits, (self.token_block, (tokens & np.uint32(BITS - 1)) >> np.uint32(6)), np.uint64(1) << (tokens & np.uint32(63)).astype(np.uint64))
        out = bits.copy()
        for step in (-1, *range(1, AHEAD + 1)):
            here, there = (slice(1, None), slice(None, -1)) if step < 0 else (slice(None, -step), slice(step, None))
            same = self.block_doc[here] == self.block_doc[there]
            out[here][same] |= bits[there][same]
        return out

    def transposed(self, latent: np.ndarray) -> np.ndarray:
        """Sum over passages and their words of the passages' vectors: buckets x rank, without term weights."""
        per_block = np.zeros((self.blocks, latent.shape[1]), np.float32)
        per_block[self.passage_block] += latent
        two = self.second != self.passage_block
        np.add.at(per_block, self.second[two], latent[two])
        out = np.zeros((BUCKETS, latent.shape[1]), np.float32)
        step = 100_000
        for a in range(0, len(self.buckets), step):
            b = self.buckets[a : a + step]
            order = np.argsort(b, kind="stable")
            b = b[order]
            heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            out[b[heads]] += np.add.reduceat(per_block[self.token_block[a : a + step][order]], heads, axis=0)
        return out


def _batches(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in stream:
        if b.num_rows:
            column = b.column("tokens")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
            lengths = np.diff(column.offsets.to_numpy())
            if len(flat):
                yield b, lengths.astype(np.int64), flat


def tokenized(documents: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, tokens): hashes of all words of every text that has any."""
    schema = T.StructType([T.StructField("doc_key", documents.schema[key].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in stream:
            tokens = [np.array(hashed(words(t)), np.uint32).astype(np.int32) for t in b["t"]]
            yield pd.DataFrame({"doc_key": b["k"], "tokens": tokens})

    return documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, schema).where(F.size("tokens") > 0)


def _summed(df: DataFrame, partial, rows: int, width: int) -> np.ndarray:
    """Sum of one matrix per task, added up in blocks of rows by other tasks."""
    block = max(1, min(rows, 65_536 // width))
    schema = "part int, cells binary"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, lengths, flat in _batches(stream):
            m = partial(Passages(lengths, flat))
            total = m if total is None else total + m
        if total is not None:
            parts = list(range(0, rows, block))
            yield pa.RecordBatch.from_pydict({"part": pa.array([a // block for a in parts], pa.int32()), "cells": pa.array([total[a : a + block].astype(np.float32).tobytes() for a in parts], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(c, np.float32).astype(np.float64) for c in table["cells"].to_pylist())
        return pa.table({"part": table["part"][:1], "cells": pa.array([cells.astype(np.float32).tobytes()], pa.binary())})

    # A second level keeps the number of matrices that one task adds small, however many tasks there are.
    first = df.mapInArrow(run, schema).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    once = first.groupBy("part", "salt").applyInArrow(lambda t: add(t.select(["part", "cells"])), schema)
    got = once.groupBy("part").applyInArrow(add, schema).collect()
    out = np.zeros((rows, width), np.float32)
    for r in got:
        out[r["part"] * block : (r["part"] + 1) * block] = np.frombuffer(r["cells"], np.float32).reshape(-1, width)
    return out


def latent_basis(tokens: DataFrame, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Terms x rank: inverse document frequencies times right singular vectors of the passages' TF-IDF matrix.

    Randomised range finder with one power iteration, then the eigenvectors of the small Gram matrix.
    """

    def frequency(p: Passages) -> np.ndarray:
        seen = np.unique(p.token_block * BUCKETS + p.buckets)
        return np.stack([np.bincount(seen % BUCKETS, minlength=BUCKETS), np.full(BUCKETS, p.blocks / BUCKETS)], 1).astype(np.float32)

    counts = _summed(tokens, frequency, BUCKETS, 2)
    blocks = max(1.0, float(counts[:, 1].sum()))
    idf = np.log((blocks + 1) / (counts[:, :1] + 1)).astype(np.float32)
    rng = np.random.default_rng(seed)
    width = rank + OVERSAMPLE
    omega = idf * rng.standard_normal((BUCKETS, width), np.float32)

    def sketch(p: Passages) -> np.ndarray:
        return p.transposed(p.project(omega))

    q, _ = np.linalg.qr((idf * _summed(tokens, sketch, BUCKETS, width)).astype(np.float64))
    q = (idf * q).astype(np.float32)

    def gram(p: Passages) -> np.ndarray:
        x = p.project(q)
        return x.T @ x

    values, vectors = np.linalg.eigh(_summed(tokens, gram, width, width).astype(np.float64))
    top = vectors[:, np.argsort(-values)[:rank]]
    return (q @ top).astype(np.float32)


class Items:
    """Sentences of one block of items; a sentence that several items share is a stock phrase.

    ``rows``: key, question, answer and those of its ``units`` that other items have as well.
    """

    def __init__(self, rows: list[tuple]):
        # An item is a row: an id may come with several questions.
        parts = {i: (split(q), set(shared)) for i, (_, q, _, shared) in enumerate(rows)}
        self.keys = [r[0] for r in rows]
        self.item, self.tokens, self.total, self.of = [], [], {}, defaultdict(list)
        self.answers = [hashed(words(a or "")) for _, _, a, _ in rows]
        #: Runs of every piece: hash and place of the first word; a run that crosses the end of a piece is in both.
        self.runs: list[list[tuple[int, int]]] = []
        owner: dict[int, int] = {}
        for k, (ss, shared) in parts.items():
            own = [s for s in ss if "s" + " ".join(s) not in shared] or ss
            self.total[k] = sum(map(len, own))
            for s in own:
                mine = [(i, h) for i, h in enumerate(runs(np.array(hashed(s), np.uint32)).tolist()) if f"r{h}" not in shared]
                owner.update((h, k) for _, h in mine)
                for a in range(0, len(s), PIECE):
                    piece = s[a : a + PIECE]
                    self.of[k].append(len(self.item))
                    self.item.append(k)
                    self.tokens.append(hashed(piece))
                    self.runs.append([(h, i - a) for i, h in mine if -RUN < i - a < len(piece)])
        self.run_hashes = np.array(sorted(owner), np.uint64)
        self.run_items = [owner[h] for h in self.run_hashes.tolist()]

    def runs_in(self, flat: np.ndarray, lengths: np.ndarray) -> dict[int, dict[object, set[int]]]:
        """Own runs of items by document and item."""
        found: dict[int, dict[object, set[int]]] = defaultdict(lambda: defaultdict(set))
        h = runs(flat)
        if not len(h) or not len(self.run_hashes):
            return found
        at = np.minimum(np.searchsorted(self.run_hashes, h), len(self.run_hashes) - 1)
        hits = np.flatnonzero(self.run_hashes[at] == h)
        ends = np.cumsum(lengths)
        docs = np.searchsorted(ends, hits, side="right")
        for i, d, r in zip(hits.tolist(), docs.tolist(), at[hits].tolist(), strict=True):
            if i + RUN <= ends[d]:
                found[d][self.run_items[r]].add(int(self.run_hashes[r]))
        return found

    def in_runs(self, piece: int, seen: set[int]) -> int:
        """Words of a piece that lie in the runs seen."""
        n = len(self.tokens[piece])
        return len({i + j for h, i in self.runs[piece] if h in seen for j in range(RUN) if 0 <= i + j < n})

    def bitmaps(self) -> np.ndarray:
        out = np.zeros((len(self.tokens), BITS // 64), np.uint64)
        for i, t in enumerate(self.tokens):
            for h in t:
                out[i, (h & (BITS - 1)) >> 6] |= np.uint64(1 << (h & 63))
        return out

    def latent(self, basis: np.ndarray) -> np.ndarray:
        out = np.stack([basis[np.array(t, np.int64) & (BUCKETS - 1)].sum(0) for t in self.tokens]) if self.tokens else np.zeros((0, basis.shape[1]), np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _found_in(sentence: list[int], doc: list[int], near: list[int] | None = None) -> int:
    """Words of a sentence in order somewhere in a document, 0 unless they are most of it."""
    n = len(sentence)
    reach = n + n // 2 + 4
    best, need = 0, IN_ORDER * n
    own = set(sentence)
    if near is None:
        # Places at which many of the sentence's words begin to gather.
        hits = [i for i, x in enumerate(doc) if x in own]
        near, lo = [], 0
        for hi, at in enumerate(hits):
            while hits[lo] < at - reach:
                lo += 1
            if hi - lo + 1 >= need:
                near.append(max(0, at - reach))
        near = near[:1] + [b for a, b in zip(near, near[1:], strict=False) if b > a]
    last = -reach
    for at in near:
        if at - last < n // 3 and best >= 0.95 * n:
            continue
        last = at
        window = doc[max(0, at) : at + reach + 2]
        # No more words can be in order than there are.
        if sum(map(own.__contains__, window)) >= need:
            best = max(best, common(sentence, window))
        if best == n:
            break
    return best if best >= need else 0


def leaked_items(documents: DataFrame, items: DataFrame, near: float = NEAR, leaked: float = LEAKED) -> DataFrame:
    """(item_id, doc_id, coverage, has_answer): documents that hold at least ``leaked`` of an item's own words, or
    ``WITH_ANSWER`` of them and its answer.

    Sentences that several items share (instructions, stock phrases) count neither way, unless an item has no
    others; a sentence most of which is not there counts by its runs of ``RUN`` words or more that no other item has. Null and blank texts hold nothing, null and blank questions are in nothing. Repeated documents come
    out under each id, repeated rows once.
    """
    spark = documents.sparkSession
    ship_package(spark)
    key_type, item_type = documents.schema["doc_id"].dataType, items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("item_id", item_type), T.StructField("doc_id", key_type), T.StructField("coverage", T.DoubleType()), T.StructField("has_answer", T.BooleanType())])
    asked = items.where("question is not null").select("item_id", "question", "answer").distinct()

    def in_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(units=[units(q) for q in b["question"]])

    # What items share is counted over all of them, so that the blocks make no difference.
    asked = materialize(asked.mapInPandas(in_units, T.StructType([*asked.schema, T.StructField("units", T.ArrayType(T.StringType()))])))
    each = asked.select("item_id", "question", "answer", F.explode("units").alias("unit"))
    several = each.select("item_id", "unit").distinct().groupBy("unit").count().where("count > 1").select("unit", F.lit(True).alias("several"))
    shared = F.collect_set(F.when(F.col("several"), F.col("unit"))).alias("shared")
    questions = each.join(several, "unit", "left").groupBy("item_id", "question", "answer").agg(shared).orderBy("item_id", "question")
    tokens = materialize(tokenized(documents))
    basis = latent_basis(tokens)
    out: DataFrame | None = None
    block: list[tuple] = []
    stream = questions.toLocalIterator()
    while True:
        row = next(stream, None)
        if row is not None:
            block.append(tuple(row))
        if block and (row is None or len(block) == ITEMS_PER_PASS):
            part = _one_pass(tokens, spark.sparkContext.broadcast((basis, Items(block))), schema, near, leaked)
            out = part if out is None else out.unionByName(part)
            block = []
        if row is None:
            if out is None:
                return spark.createDataFrame([], schema)
            # Of several questions of one id, the one that leaked most.
            return out.groupBy("item_id", "doc_id").agg(F.max("coverage").alias("coverage"), F.max("has_answer").alias("has_answer"))


def _one_pass(tokens: DataFrame, shared, schema: T.StructType, near: float, leaked: float) -> DataFrame:
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, items = shared.value
        queries, own = items.latent(basis), items.bitmaps()
        # How many of a piece's words, as bits, may be absent before too few are left to be in order.
        spare = np.array([len(t) - IN_ORDER * len(t) for t in items.tokens])
        has = np.bitwise_count(own).sum(axis=1)
        target = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])
        for b, lengths, flat in _batches(stream):
            p = Passages(lengths, flat)
            x = p.project(basis)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            there = p.around(flat)
            candidates: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
            for a in range(0, len(x), 2048):
                rows, cols = np.nonzero(x[a : a + 2048] @ queries.T >= near)
                blocks = p.passage_block[rows + a]
                absent = has[cols] - np.bitwise_count(there[blocks] & own[cols]).sum(axis=1)
                possible = absent <= spare[cols] + 1e-9
                blocks, cols = blocks[possible], cols[possible]
                for d, at, s in zip(p.block_doc[blocks].tolist(), p.block_at[blocks].tolist(), cols.tolist(), strict=True):
                    candidates[d][s].append(at)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            keys = b.column("doc_key").to_pylist()
            rows = []
            in_row = items.runs_in(flat, lengths)
            for d in candidates.keys() | in_row.keys():
                sentences, seen = candidates.get(d, {}), in_row.get(d, {})
                doc = flat[starts[d] : starts[d + 1]].tolist()
                confirmed = {items.item[s] for s, places in sentences.items() if _found_in(items.tokens[s], doc, [max(0, q - HALF) for q in places] + places)}
                # Without a confirmed sentence, the runs alone must do.
                confirmed |= {k for k, r in seen.items() if sum(items.in_runs(s, r) for s in items.of[k]) >= min(leaked, WITH_ANSWER) * items.total[k]}
                for k in confirmed:
                    got = sum(max(_found_in(items.tokens[s], doc), items.in_runs(s, seen.get(k, set()))) for s in items.of[k])
                    share = got / items.total[k]
                    if share >= min(leaked, WITH_ANSWER):
                        answered = contains(doc, items.answers[k])
                        if share >= leaked or answered:
                            rows.append((items.keys[k], keys[d], round(share, 6), answered))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    return tokens.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
