"""What changed between consecutive full snapshots.

Every snapshot is a set of pairs (key hash, value hash). The pairs of two neighbouring snapshots are
put into invertible Bloom lookup tables, one per hash bucket; the tables are subtracted cell by cell,
so whatever the snapshots share cancels, and the remaining pairs are peeled off. A table that cannot
be peeled completely is enlarged, with other hash functions, and built again. The recovered pairs are
verified against the digest (exclusive or of all pair hashes) of the two snapshots, then classified.

The tables of a bucket are built where the bucket's rows lie, so enlarging costs no further shuffle.
Rows are spread by (entity, series, key bucket); the number of buckets follows the number of rows, so
one series that holds a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.runtime import partitions_for, row_bound, ship_package

RESULT = "entity string, scan_id string, item_key string, change string"
ROWS_PER_TASK = 400_000
#: Differences a table is first sized for, as a share of the rows of the larger side.
FIRST_SHARE = 0.06
HASHES = 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), one independent function per seed."""
    with np.errstate(over="ignore"):
        x = x + _GOLD * np.uint64(2 * seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pair_check(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Check hash of a (key hash, value hash) pair."""
    return _mix(_mix(keys, 11) ^ values, 29)


class TableSet:
    """Subtracted lookup tables of several snapshot pairs, in one set of arrays."""

    def __init__(self, cells: np.ndarray, seed: int):
        """``cells``: number of cells of each table, a multiple of ``HASHES``."""
        self.width = (cells // HASHES).astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(cells)[:-1]]).astype(np.int64)
        self.cells, self.seed = cells, seed
        total = int(cells.sum())
        self.owner = np.repeat(np.arange(len(cells)), cells)
        self.count = np.zeros(total, np.int64)
        self.key, self.value, self.check = (np.zeros(total, np.uint64) for _ in range(3))

    def _places(self, table: np.ndarray, check: np.ndarray) -> list[np.ndarray]:
        width = self.width[table]
        return [self.start[table] + (width * np.uint64(i) + _mix(check, 101 + HASHES * self.seed + i) % width).astype(np.int64) for i in range(HASHES)]

    def add(self, table: np.ndarray, key: np.ndarray, value: np.ndarray, sign: np.ndarray) -> None:
        check = pair_check(key, value)
        for at in self._places(table, check):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, key)
            np.bitwise_xor.at(self.value, at, value)
            np.bitwise_xor.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(table, key, value, sign) of all recovered pairs and, per table, whether it came out empty."""
        found: list[tuple[np.ndarray, ...]] = []
        todo = np.flatnonzero(self.count)
        while len(todo):
            pure = todo[np.abs(self.count[todo]) == 1]
            pure = pure[pair_check(self.key[pure], self.value[pure]) == self.check[pure]]
            if not len(pure):
                break
            seen = np.stack([self.owner[pure].astype(np.uint64), self.check[pure]], 1)
            _, first = np.unique(seen, axis=0, return_index=True)
            pure = pure[first]
            table, key, value, sign = self.owner[pure], self.key[pure].copy(), self.value[pure].copy(), self.count[pure].copy()
            found.append((table, key, value, sign))
            self.add(table, key, value, -sign)
            todo = np.unique(np.concatenate(self._places(table, pair_check(key, value))))
        empty = np.ones(len(self.cells), bool)
        left = (self.count != 0) | (self.check != 0) | (self.key != 0) | (self.value != 0)
        empty[self.owner[left]] = False
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return cols[0], cols[1], cols[2], cols[3], empty


def differences(table: np.ndarray, key: np.ndarray, value: np.ndarray, sign: np.ndarray, tables: int, first_share: float = FIRST_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs on one side only, of ``tables`` snapshot pairs at once; exact.

    ``sign`` is +1 for the later and -1 for the earlier snapshot. Pairs must be distinct per side.
    """
    rows = np.bincount(table, minlength=tables)
    size = (24 + 1.5 * first_share * rows).astype(np.int64)
    todo, out = np.arange(tables), []
    place = np.arange(tables)
    for seed in range(64):
        keep = place[table] >= 0
        if not keep.all():
            table, key, value, sign = table[keep], key[keep], value[keep], sign[keep]
        local = place[table]
        cells = HASHES * size[todo]
        peeler = TableSet(cells, seed)
        peeler.add(local, key, value, sign)
        t, k, v, s, empty = peeler.peel()
        digest, balance = np.zeros(len(todo), np.uint64), np.zeros(len(todo), np.int64)
        np.bitwise_xor.at(digest, local, pair_check(key, value))
        np.add.at(balance, local, sign)
        np.bitwise_xor.at(digest, t, pair_check(k, v))
        np.subtract.at(balance, t, s)
        good = empty & (digest == 0) & (balance == 0)
        ok = good[t]
        out.append((todo[t[ok]], k[ok], v[ok], s[ok]))
        todo = todo[~good]
        if not len(todo):
            break
        size[todo] *= 2
        place = np.full(tables, -1)
        place[todo] = np.arange(len(todo))
    else:
        raise ArithmeticError("a lookup table could not be peeled at any size")
    a, b, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b, c, d


def told_apart(kh: np.ndarray, keys: pa.ChunkedArray) -> np.ndarray:
    """Key hashes such that different keys of a task never share one.

    All rows of a hash lie in one task, so equal hashes of different spellings are seen here; all but one of the spellings
    get other hashes, the same for every row of the spelling.
    """
    code = keys.dictionary_encode().unify_dictionaries()
    codes = np.concatenate([np.asarray(c.indices) for c in code.chunks]).astype(np.int64) if code.num_chunks else np.zeros(0, np.int64)
    first = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.uint64)
    first[codes] = kh
    for seed in range(64):
        order = np.argsort(first, kind="stable")
        again = np.zeros(len(first), bool)
        again[order[1:]] = first[order[1:]] == first[order[:-1]]
        if not again.any():
            return first[codes]
        first[again] = _mix(first[again] ^ np.flatnonzero(again).astype(np.uint64), 307 + seed)
    raise ArithmeticError("keys could not be told apart")


def _bucket_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of the buckets of one task to their differences."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.Table.from_batches(got).combine_chunks()
    # The delivery that holds: the latest, then the one with a value, then the larger hash.
    code = rows["scan"].combine_chunks().dictionary_encode() if rows["scan"].num_chunks != 1 else rows["scan"].chunk(0).dictionary_encode()
    scans = code.dictionary.to_pylist()
    scan = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    entity = np.asarray(rows["is_file"]).astype(np.int64)
    kh, vh = (np.asarray(rows[c]).astype(np.int64).view(np.uint64) for c in ("kh", "vh"))
    kh = told_apart(kh, rows["item_key"])
    known = np.asarray(rows["known"])
    loaded = np.asarray(rows["loaded"]).astype(np.int64)
    group = scan * 2 + entity
    order = np.lexsort((vh, known, loaded, kh, group))
    last = np.ones(len(order), bool)
    last[:-1] = (group[order][1:] != group[order][:-1]) | (kh[order][1:] != kh[order][:-1])
    at = order[last]  # sorted by (group, kh)
    # A row is in the table of its own snapshot and, with the other sign, in that of the next one.
    nxt = rows["next_scan"].to_pandas().to_numpy()
    names = {s: i for i, s in enumerate(scans)}
    next_of: dict[int, int] = {}
    firsts = np.zeros(len(scans) * 2 + 2, bool)
    heads = np.unique(scan[at], return_index=True)[1]
    first_flag = np.asarray(rows["is_first"])
    for h in at[heads]:
        s = int(scan[h])
        firsts[s] = first_flag[h]
        if nxt[h] is not None:
            next_of[s] = names.setdefault(nxt[h], len(names))
    follow = np.full(len(names), -1, np.int64)
    for s, t in next_of.items():
        follow[s] = t
    labels = [""] * len(names)
    for s, i in names.items():
        labels[i] = s
    own = ~firsts[scan[at]]
    later = follow[scan[at]]
    prev = later >= 0
    table = np.concatenate([scan[at][own] * 2 + entity[at][own], later[prev] * 2 + entity[at][prev]])
    key = np.concatenate([kh[at][own], kh[at][prev]])
    value = np.concatenate([vh[at][own], vh[at][prev]])
    sign = np.concatenate([np.ones(own.sum(), np.int64), -np.ones(prev.sum(), np.int64)])
    if not len(table):
        return
    used, compact = np.unique(table, return_inverse=True)
    t, k, v, s = differences(compact, key, value, sign, len(used))
    if not len(t):
        return
    # One line per key: which sides it was recovered from, and whether both values are known.
    t = used[t]
    order = np.lexsort((s, k, t))
    t, k, v, s = t[order], k[order], v[order], s[order]
    head = np.ones(len(t), bool)
    head[1:] = (t[1:] != t[:-1]) | (k[1:] != k[:-1])
    at_head = np.flatnonzero(head)
    ends = np.append(at_head[1:], len(t))
    both = ends - at_head == 2
    unknown = np.uint64(0)
    missing = (v[at_head] == unknown) | (v[ends - 1] == unknown)
    keep = ~(both & missing)
    at_head, both = at_head[keep], both[keep]
    kind = np.where(both, 2, np.where(s[at_head] > 0, 0, 1))
    # The spelling of a recovered key: any row of the bucket with this key.
    by_key = np.argsort(kh, kind="stable")
    spelled = by_key[np.searchsorted(kh[by_key], k[at_head])]
    yield from pa.table({
        "entity": pa.array(np.where(t[at_head] % 2 == 1, "file", "symbol").tolist(), pa.string()),
        "scan_id": pa.array([labels[i] for i in t[at_head] // 2], pa.string()),
        "item_key": rows["item_key"].take(pa.array(spelled)).cast(pa.string()),
        "change": pa.array(np.array(["added", "removed", "changed"])[kind].tolist(), pa.string()),
    }).to_batches()


@F.arrow_udf(T.StringType())
def _nfc(path: pa.Array) -> pa.Array:
    mask = pc.fill_null(pc.invert(pc.string_is_ascii(path)), False)
    if not pc.any(mask).as_py():
        return path
    return pc.replace_with_mask(path, mask, pa.array([unicodedata.normalize("NFC", x) for x in path.filter(mask).to_pylist()], path.type))


#: Unicode NFC of a column; marked so that the optimizer does not evaluate it once per use.
nfc = _nfc.asNondeterministic()


def canonical_path(path: Column) -> Column:
    """Relative, forward slashes, no empty or '.' segments, NFC."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return nfc(F.array_join(F.filter(parts, lambda s: ~s.isin("", ".")), "/"))


def complete_scans(scan_runs: DataFrame) -> DataFrame:
    """Each complete scan once, with the complete scan that follows it in its repository.

    Columns: scan, series, is_first, next_scan. Rows without id, repository or time cannot be ordered
    and are left out; scans of equal time are ordered by id.
    """
    from pyspark.sql import Window

    runs = (
        scan_runs.where(F.lower(F.trim("state")) == "complete")
        .where("scan_id is not null and repo is not null and created_at is not null")
        .groupBy(F.col("scan_id").alias("scan"), F.col("repo").alias("series"))
        .agg(F.max("created_at").alias("at"))
    )
    w = Window.partitionBy("series").orderBy("at", "scan")
    return runs.select("scan", "series", F.lag("scan").over(w).isNull().alias("is_first"), F.lead("scan").over(w).alias("next_scan"))


def snapshot_changes(scan_runs: DataFrame, inventory: DataFrame, symbols: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Files and symbols added, removed or changed since the previous complete scan of a repository.

    Returns (entity, scan_id, item_key, change). Rows without key or of scans that are not complete
    are ignored; a null hash or signature is unknown and makes no change; of several rows of a key in a
    scan the one with the latest loaded_at holds (null is earliest; ties: the larger value hash).
    Repeated rows, empty inputs and further columns are harmless.
    """
    spark = scan_runs.sparkSession
    ship_package(spark)
    scans = complete_scans(scan_runs)
    digest = lambda c: F.when(F.xxhash64(c) == 0, F.lit(1).cast("bigint")).otherwise(F.xxhash64(c))

    def side(df: DataFrame, key: Column, value: Column, is_file: bool) -> DataFrame:
        return df.select(
            F.col("scan_id").alias("scan"), key.alias("item_key"), value.alias("value"),
            F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**62))).alias("loaded"), F.lit(is_file).alias("is_file"),
        )

    sha = F.lower(F.trim(F.col("content_sha256")))
    items = side(inventory, canonical_path(F.col("path")), F.when(sha != "", sha), True).unionByName(
        side(symbols, F.col("fqsn"), F.regexp_replace("signature", r"\s+", ""), False)
    )
    items = items.where("item_key is not null and item_key <> ''").join(scans, "scan")
    n = partitions_for(spark, row_bound(inventory) + row_bound(symbols), rows_per_task)
    keyed = items.select(
        "scan", "series", "is_first", "next_scan", "is_file", "item_key", "loaded",
        F.xxhash64("item_key").alias("kh"), F.col("value").isNotNull().alias("known"),
        F.when(F.col("value").isNull(), F.lit(0).cast("bigint")).otherwise(digest("value")).alias("vh"),
    )
    spread = keyed.repartition(n, "is_file", "series", F.pmod("kh", F.lit(n))).drop("series")
    return spread.mapInArrow(_bucket_task, RESULT)
