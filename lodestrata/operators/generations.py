"""Immutable generations of tables: attempts, staging, publication, retention, pinned reads and pages.

A generation is a directory per scan; the pointer is a small table of its own that is written last, by a rename.
"""

from __future__ import annotations

import base64
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 5
KEEP, MOST_KEPT = 5, 1000
PAGE_ROWS, PAGE_BYTES = 500, 1 << 20
STATES = ("running", "complete", "partial", "failed", "superseded")


class GenerationError(ValueError):
    """A refused write or a read of what is not there; the message starts with a code."""


def retained(runs: DataFrame, keep: int = KEEP) -> DataFrame:
    """(scan_id, repo, state, kept): the newest complete run and ``keep`` before it stay, older ones are superseded."""
    keep = max(0, min(MOST_KEPT, keep))
    one = runs.where("state = 'complete'").groupBy("scan_id", "repo").agg(F.max("created_at").alias("created_at"))
    n = F.row_number().over(Window.partitionBy("repo").orderBy(F.col("created_at").desc(), F.col("scan_id").desc()))
    return one.withColumn("n", n).select("scan_id", "repo", F.when(F.col("n") <= keep + 1, "complete").otherwise("superseded").alias("state"), (F.col("n") <= keep + 1).alias("kept"))


def pointers(runs: DataFrame) -> DataFrame:
    """(repo, active_scan_id, latest_attempt_id): newest complete run and newest run of any state."""
    key = F.struct("created_at", "scan_id")
    done = F.when(F.col("state") == "complete", F.col("scan_id"))
    return runs.groupBy("repo").agg(F.max_by(done, F.when(done.isNotNull(), key)).alias("active_scan_id"), F.max_by("scan_id", key).alias("latest_attempt_id"))


def latest_rows(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Upsert: of several rows of a key the one that is latest in a total order; one aggregation, no join."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Batch replace: all rows of the keys that the new rows have give way to these."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def vanished(old: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is no longer there."""
    return old.join(current.select(*keys).distinct(), keys, "left_anti")


def page(df: DataFrame, key: str, after: object | None = None, rows: int = PAGE_ROWS) -> DataFrame:
    """The next rows in order of the key; by key, not by offset, so a page costs the same wherever it lies."""
    if not 1 <= rows <= PAGE_ROWS:
        raise GenerationError(f"INVALID_LIMIT: {rows}")
    if after is not None:
        df = df.where(F.col(key) > F.lit(after))
    return df.orderBy(key).limit(rows)


def byte_capped(page_rows: DataFrame, key: str, most: int = PAGE_BYTES) -> DataFrame:
    """Leading rows of one page whose JSON texts fit, with the running size. A page is bounded, so one task orders it.

    A first row that alone is too large fails the query with ITEM_TOO_LARGE; an empty page would end the reading.
    """
    size = F.octet_length(F.to_json(F.struct(*page_rows.columns)))
    order = Window.orderBy(key)
    running = page_rows.withColumn("json_bytes", size).withColumns({"total_bytes": F.sum("json_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(order)})
    too_large = (F.col("_n") == 1) & (F.col("json_bytes") > most)
    fits = F.when(too_large, F.raise_error(F.concat(F.lit("ITEM_TOO_LARGE: "), F.col("json_bytes").cast("string"))).cast("boolean")).otherwise(F.col("total_bytes") <= most)
    return running.where(fits).drop("_n")


def cursor(**fields: object) -> str:
    return json.dumps(fields, sort_keys=True).encode().hex()


def read_cursor(text: str, **expected: object) -> dict:
    """The fields of a cursor; it must belong to the same snapshot, collection and filter."""
    try:
        fields = json.loads(bytes.fromhex(text))
    except ValueError as e:
        raise GenerationError("INVALID_CURSOR: unreadable") from e
    if any(fields.get(k) != v for k, v in expected.items()):
        raise GenerationError("INVALID_CURSOR: of another snapshot, collection or filter")
    return fields


def catalog_digest(rows: DataFrame) -> DataFrame:
    """One row: count and digest of all rows' JSON texts, whatever their order.

    The digest is over sums of the parts of the rows' hashes, so it is added up where the rows lie and nothing is gathered.
    """
    each = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias(f"p{i}") for i in range(8)]
    return each.agg(F.count("*").alias("n"), *parts).select("n", F.sha2(F.concat_ws(":", "n", *(f"p{i}" for i in range(8))), 256).alias("digest"))


def catalog_cursor(digest: str, offset: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([digest, offset]).encode()).decode()


def read_catalog_cursor(text: str, digest: str) -> int:
    """Where the next page begins; a cursor of another state of the catalogue is refused."""
    try:
        known, offset = json.loads(base64.urlsafe_b64decode(text.encode()))
    except (ValueError, TypeError) as e:
        raise GenerationError("INVALID_CURSOR: unreadable") from e
    if known != digest:
        raise GenerationError("STALE_CURSOR: the catalogue has changed")
    return int(offset)


def catalog_page(rows: DataFrame, count: int, cursor_text: str | None = None) -> tuple[DataFrame, str | None]:
    """(rows of the page in order of their JSON texts, cursor of the next page or None)."""
    if not 1 <= count <= PAGE_ROWS:
        raise GenerationError(f"INVALID_LIMIT: {count}")
    state = catalog_digest(rows).first()
    at = read_catalog_cursor(cursor_text, state["digest"]) if cursor_text else 0
    page_rows = rows.orderBy(F.to_json(F.struct(*sorted(rows.columns)))).offset(at).limit(count)
    return page_rows, catalog_cursor(state["digest"], at + count) if at + count < state["n"] else None


#: Collections of a snapshot, with their tables, the order of their pages and the names of their fields outside.
COLLECTIONS = {
    "files": ("inventory_files", "path", {"path": "path", "category": "category", "support": "support", "contentSha256": "content_sha256", "excludedReason": "excluded_reason", "readError": "read_error"}),
    "facts": ("facts", "fact_id", {"id": "fact_id", "kind": "kind", "attributes": "attributes", "evidenceIds": "evidence_ids"}),
    "evidence": ("evidence", "evidence_id", {"id": "evidence_id", "path": "path", "contentSha256": "content_sha256", "lineStart": "line_start", "lineEnd": "line_end", "extractor": "extractor", "method": "method"}),
    "relations": ("relations", "relation_id", {"id": "relation_id", "fromId": "from_id", "toId": "to_id", "kind": "kind", "resolution": "resolution", "candidateIds": "candidate_ids", "evidenceIds": "evidence_ids"}),
}
CATEGORIES = ("source", "markup", "style", "manifest", "infra", "docs", "asset")
SUPPORTS = ("ast", "heuristic", "metadata")


def outside(rows: DataFrame, collection: str) -> DataFrame:
    """Rows of a collection under the names of the interface; unknown categories are assets, unknown support is metadata."""
    if collection not in COLLECTIONS:
        raise GenerationError(f"INVALID_COLLECTION: {collection}")
    known = {"category": (CATEGORIES, "asset"), "support": (SUPPORTS, "metadata")}
    field = lambda c: F.when(F.lower(c).isin(*known[c][0]), F.lower(c)).otherwise(known[c][1]) if c in known and collection == "files" else F.col(c)
    return rows.select(*(field(c).alias(n) for n, c in COLLECTIONS[collection][2].items()))


def coverage_of(counts: dict[str, int], diagnostics: list[dict]) -> dict[str, dict]:
    """What a snapshot covers, overall and by collection."""
    part = lambda state, n, *codes: {"state": state, "examined": n, "excluded": 0, "diagnostics": [{"code": c} for c in codes]}
    overall = {"state": "partial" if diagnostics else "complete", "examined": counts.get("files", 0), "excluded": 0, "diagnostics": [{"code": d.get("code") or "SCAN_DIAGNOSTIC", "path": d.get("path")} for d in diagnostics]}
    return {
        "overall": overall, "facts": part("unsupported", counts.get("facts", 0), "FACT_EXTRACTION_UNAVAILABLE"), "schema": part("unsupported", 0, "SCHEMA_FACT_EXTRACTION_UNAVAILABLE"),
        "evidence": part("partial", counts.get("evidence", 0), "CALLSITE_EVIDENCE_ONLY"), "relations": part("partial", counts.get("relations", 0), "CALL_RELATIONS_ONLY"),
    }


class GenerationStore:
    """Generations under one directory that all executors share: a local path, or one of any file system Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path("generations"))
        self._runs: dict[str, str] = self._read("runs.json", {})
        self._order: list[str] = self._read("order.json", [])
        self._notes: dict[str, dict] = self._read("notes.json", {})

    def _path(self, below: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{below}" if below else self.root)

    def _read(self, name: str, default):
        p = self._path(name)
        if not self._fs.exists(p):
            return default
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _write(self, name: str, value) -> None:
        """A new file takes the place of the old one in one step."""
        temporary = self._path(f".{name}.new")
        stream = self._fs.create(temporary, True)
        stream.write(json.dumps(value).encode())
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(self._path(name)), how)

    def _save(self) -> None:
        self._write("runs.json", self._runs)
        self._write("order.json", self._order)

    @property
    def active(self) -> str | None:
        return self._read("pointer.json", {}).get("active")

    @property
    def latest_attempt(self) -> str | None:
        return self._order[-1] if self._order else None

    def state(self, scan_id: str) -> str | None:
        return self._runs.get(scan_id)

    def begin(self, scan_id: str, created_at: str | None = None) -> None:
        if not re.fullmatch(r"[A-Za-z0-9_.-]{1,128}", scan_id) or scan_id in (".", ".."):
            raise GenerationError("E501: a scan id has letters, digits, dots, dashes and underscores")
        if scan_id in self._runs:
            raise GenerationError(f"E501: {scan_id} has begun before")
        self._runs[scan_id] = "running"
        self._order.append(scan_id)
        self._notes[scan_id] = {"created_at": created_at, "diagnostics": []}
        self._write("notes.json", self._notes)
        self._save()

    def stage(self, scan_id: str, **tables: DataFrame) -> None:
        """Tables of a running scan; rows of another scan are refused."""
        if self._runs.get(scan_id) != "running":
            raise GenerationError(f"E201: {scan_id} is not running")
        for name, df in tables.items():
            if "scan_id" in df.columns:
                if not df.where(~F.col("scan_id").eqNullSafe(F.lit(scan_id))).isEmpty():
                    raise GenerationError(f"E201: {name} has rows of another scan than {scan_id}")
                df = df.drop("scan_id")
            df.write.mode("errorifexists").parquet(f"{self.root}/_staging/{scan_id}/{name}")

    def record(self, scan_id: str, state: str, diagnostics: list[dict] | None = None) -> None:
        if state not in STATES or self._runs.get(scan_id) != "running":
            raise GenerationError(f"E201: {scan_id} cannot become {state}")
        self._runs[scan_id] = state
        self._notes.setdefault(scan_id, {})["diagnostics"] = diagnostics or []
        self._write("notes.json", self._notes)
        self._save()
        self._drop(f"_staging/{scan_id}")

    def publish(self, scan_id: str, keep: int = KEEP, diagnostics: list[dict] | None = None) -> None:
        """Staged tables become the generation; the pointer moves last. Only the latest attempt may be published."""
        if self._runs.get(scan_id) != "running":
            raise GenerationError(f"E201: {scan_id} is not running")
        if scan_id != self.latest_attempt:
            raise GenerationError(f"E201: {scan_id} is not the latest attempt")
        if not self._fs.rename(self._path(f"_staging/{scan_id}"), self._path(f"generations/scan_id={scan_id}")):
            raise GenerationError(f"E201: {scan_id} has nothing staged")
        self._notes.setdefault(scan_id, {})["diagnostics"] = diagnostics or []
        self._write("notes.json", self._notes)
        self._runs[scan_id] = "complete"
        self._save()
        self._write("pointer.json", {"active": scan_id, "schema_version": SCHEMA_VERSION})
        complete = [s for s in self._order if self._runs[s] == "complete"]
        for old in complete[: -(max(0, min(MOST_KEPT, keep)) + 1)]:
            self._runs[old] = "superseded"
            self._drop(f"generations/scan_id={old}")
        self._save()

    def table(self, name: str, scan_id: str | None = None) -> DataFrame:
        """A table of a pinned generation, or of the active one."""
        scan_id = scan_id or self.active
        if scan_id is None:
            raise GenerationError("NOT_SCANNED: nothing is published")
        below = f"generations/scan_id={scan_id}/{name}"
        if not self._fs.exists(self._path(below)):
            raise GenerationError(f"SNAPSHOT_UNAVAILABLE: {scan_id}/{name}")
        return self.spark.read.parquet(f"{self.root}/{below}").withColumn("scan_id", F.lit(scan_id))

    def _tables(self, scan_id: str | None) -> list[str]:
        base = self._path(f"generations/scan_id={scan_id}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(base)) if scan_id and self._fs.exists(base) else []

    def metadata(self, scan_id: str | None = None) -> dict[str, int]:
        """Rows per table of a generation."""
        scan_id = scan_id or self.active
        return {name: self.table(name, scan_id).count() for name in self._tables(scan_id)}

    def describe(self, scan_id: str | None = None) -> dict:
        """What a snapshot is: identity, totals of its collections, coverage, and the latest attempt beside it."""
        scan_id = scan_id or self.active
        if scan_id is None:
            raise GenerationError("NOT_SCANNED: nothing is published")
        rows = self.metadata(scan_id)
        totals = {c: rows.get(t, 0) for c, (t, _, _) in COLLECTIONS.items()}
        note = self._notes.get(scan_id, {})
        return {"schemaVersion": SCHEMA_VERSION, "scanId": scan_id, "repositoryRoot": self.root, "createdAt": note.get("created_at"), "latestAttempt": self.latest_attempt, "totals": totals, "coverage": coverage_of(totals, note.get("diagnostics") or [])}

    def collection_page(self, collection: str, scan_id: str | None = None, rows: int = PAGE_ROWS, cursor_text: str | None = None, most: int = PAGE_BYTES) -> tuple[list[dict], str | None]:
        """(items, cursor of the next page or None) of files, facts, evidence or relations.

        A cursor is bound to the store, the snapshot and the collection, and continues after the last key, so that a page
        costs the same wherever it lies.
        """
        if collection not in COLLECTIONS:
            raise GenerationError(f"INVALID_COLLECTION: {collection}")
        scan_id = scan_id or self.active
        name, key, _ = COLLECTIONS[collection]
        bound = {"version": 1, "root": self.root, "scan_id": scan_id, "collection": collection, "filter": ""}
        after = read_cursor(cursor_text, **bound)["after"] if cursor_text else None
        there = page(self.table(name, scan_id), key, after, rows)
        view = outside(there, collection)
        first = view.columns[0]
        kept = [r.asDict(recursive=True) for r in byte_capped(view, first, most).drop("json_bytes", "total_bytes").orderBy(first).collect()]
        more = bool(kept) and not self.table(name, scan_id).where(F.col(key) > F.lit(kept[-1][first])).isEmpty()
        return kept, cursor(**bound, after=kept[-1][first]) if more else None

    def compact(self, name: str, rows_per_file: int = 5_000_000) -> int:
        """The table of the active generation rewritten to as few files as its rows need; a reader between the two renames has to try again."""
        scan_id = self.active
        df = self.table(name, scan_id).drop("scan_id")
        files = max(1, -(-df.count() // rows_per_file))
        df.coalesce(files).write.mode("overwrite").parquet(f"{self.root}/_staging/.compact/{name}")
        self._fs.rename(self._path(f"generations/scan_id={scan_id}/{name}"), self._path(f"_staging/.compact/{name}.old"))
        self._fs.rename(self._path(f"_staging/.compact/{name}"), self._path(f"generations/scan_id={scan_id}/{name}"))
        self._drop(f"_staging/.compact/{name}.old")
        return files

    def purge(self) -> int:
        """Deletes all generations that are not active; how many there were."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("generations"))]
        gone = [n for n in names if n != f"scan_id={self.active}"]
        for n in gone:
            self._drop(f"generations/{n}")
        return len(gone)

    def _drop(self, below: str) -> None:
        self._fs.delete(self._path(below), True)
