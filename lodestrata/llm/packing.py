"""Filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

Minimum bin slack: each bin starts with the largest piece that is left and is filled up by the combination of
available lengths that leaves the least space, found by subset-sum dynamic programming over a bitset; the
combination is removed and, while the lengths last, repeated. The lengths form a histogram no larger than the
capacity. Texts are spread over shards of a bounded number of pieces and each shard is packed by one task; a
shard loses at most part of its last bins, so the shards' size, not their number, sets the waste.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import vocab
from lodestrata.runtime import materialize, ship_package

CAPACITY = 2048
PIECES_PER_SHARD = 20_000


def fullest(lengths: list[tuple[int, int]], room: int) -> Counter[int]:
    """Multiset of available (length, count) pairs with the greatest sum that is at most ``room``.

    Bit s of ``reach`` says whether a sum of s is possible; counts are taken in powers of two.
    """
    reach, limit = 1, (1 << (room + 1)) - 1
    steps: list[tuple[int, int, int]] = []
    full = 1 << room
    for length, count in lengths:
        if length > room:
            continue
        count = min(count, room // length)
        take = 1
        while count > 0:
            n = min(take, count)
            grown = (reach | reach << (n * length)) & limit
            if grown != reach:
                steps.append((length, n, reach))
                reach = grown
            count -= n
            take *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    out: Counter[int] = Counter()
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            out[length] += n
            at -= n * length
    return out


def pack(sizes: Counter[int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Contents of the bins as (multiset of sizes, how often); uses every size exactly as often as it occurs."""
    left = {s: n for s, n in sizes.items() if n > 0}
    if left and (max(left) > capacity or min(left) < 1):
        raise ValueError("a piece does not fit into a container")
    order = sorted(left, reverse=True)
    out: list[tuple[dict[int, int], int]] = []
    while order:
        largest = order[0]
        left[largest] -= 1
        content = fullest([(s, left[s]) for s in order if left[s] > 0], capacity - largest)
        left[largest] += 1
        content[largest] += 1
        times = min(left[s] // n for s, n in content.items())
        for s, n in content.items():
            left[s] -= n * times
        out.append((dict(content), times))
        order = [s for s in order if left[s] > 0]
    return out


_BETWEEN_WORDS = re.compile(r"(?<=[a-z]) (?=[a-z])")


def count_tokens(text: str, encode) -> int:
    """Tokens of a whole text; long ones in parts cut between words, where no token spans the cut."""
    total = at = 0
    while len(text) - at > 200_000:
        m = _BETWEEN_WORDS.search(text, at + 100_000)
        if not m:
            break
        total += len(encode(text[at : m.start()]))
        at = m.start()
    return total + len(encode(text[at:] if at else text))


def pieces_of(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece, pieces, tokens): lengths of the texts; only a text longer than a container has several pieces."""
    path = vocabulary or vocab.default_path()
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), T.StructField("tokens", T.LongType())])

    def measure(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = vocab.encoding(path).encode_ordinary
        for b in stream:
            b = b[[bool(t.strip()) for t in b["text"]]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [count_tokens(t, encode) for t in b["text"]]})

    measured = documents.where("text is not null").select("doc_id", "text").mapInPandas(measure, schema)
    once = measured.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    parts = F.ceil(F.col("tokens") / capacity).cast("int")
    return once.select("doc_id", F.posexplode(F.sequence(F.lit(1), parts)).alias("piece", "_"), parts.alias("pieces"), "tokens").select(
        "doc_id", "piece", "pieces", F.when(F.col("piece") + 1 < F.col("pieces"), F.lit(capacity)).otherwise(F.col("tokens") - F.col("piece") * capacity).cast("int").alias("tokens")
    )


def containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """(doc_id, piece, pieces, tokens, container): every piece of every text once, no container over its capacity.

    Null and blank texts need no space and do not come out. Repeated rows of a document come out once; if
    its texts differ, the longest counts. Very long texts fill containers of their own and share the last.
    """
    ship_package(documents.sparkSession)
    pieces = materialize(pieces_of(documents, capacity, vocabulary))
    shards = max(1, -(-pieces.count() // per_shard))
    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    schema = T.StructType([*pieces.schema.fields, T.StructField("container", T.LongType())])

    def fill(table: pa.Table) -> pa.Table:
        sizes = table["tokens"].to_pylist()
        shard = table["shard"][0].as_py()
        # Pieces of equal length are interchangeable; taking them by id makes the outcome reproducible.
        waiting: dict[int, list[int]] = {}
        keys = table["doc_id"].to_pylist()
        places = table["piece"].to_pylist()
        for i in sorted(range(len(sizes)), key=lambda i: (keys[i] is None, keys[i], places[i]), reverse=True):
            waiting.setdefault(sizes[i], []).append(i)
        container = [0] * len(sizes)
        number = 0
        for content, times in pack(Counter(sizes), capacity):
            for _ in range(times):
                for s, n in content.items():
                    for _ in range(n):
                        container[waiting[s].pop()] = (shard << 32) | number
                number += 1
        return table.drop_columns(["shard"]).append_column("container", pa.array(container, pa.int64()))

    return spread.groupBy("shard").applyInArrow(fill, schema)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers used, the least that any packing needs, and the share of space left empty."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    return per.agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.ceil(F.sum("used") / capacity).alias("least"), F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count("*") * capacity), 6).alias("empty_share"),
    )


def invariants(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: texts placed, pieces placed twice or missing, containers over their capacity, texts split without need."""
    per_text = packed.groupBy("doc_id").agg(F.count("*").alias("k"), F.count_distinct("piece").alias("different"), F.max("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    texts = per_text.agg(F.count("*").alias("n_texts"), F.count_if((F.col("k") != F.col("pieces")) | (F.col("different") != F.col("pieces"))).alias("n_wrong"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= capacity)).alias("n_split"))
    over = packed.groupBy("container").agg(F.sum("tokens").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("n_over"))
    return texts.withColumn("one", F.lit(1)).join(over.withColumn("one", F.lit(1)), "one").drop("one")
