"""Repositories as tables: walk, classification, hashing, verified reads."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.text import classify, extension
from lodestrata.runtime import ship_package

MAX_SOURCE_BYTES = 4 << 20
OWN_DIRECTORY = ".lodestrata"
LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("modified_ns", T.LongType())])
CONTENT = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())])


class Ignore:
    """Rules of the ignore files from the root down to a directory; the last rule that matches decides."""

    def __init__(self, rules: tuple[tuple[str, re.Pattern, bool, bool], ...] = ()):
        self.rules = rules

    def below(self, directory: Path, base: str, names: tuple[str, ...] = (".gitignore", ".ignore")) -> Ignore:
        out = list(self.rules)
        for name in names:
            try:
                lines = (directory / name).read_text(errors="replace").splitlines()
            except OSError:
                continue
            for line in lines:
                line = line.rstrip()
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                line = line.lstrip("!\\")
                only_directories = line.endswith("/")
                line = line.rstrip("/")
                anchored = "/" in line
                parts = []
                for piece in line.strip("/").split("/"):
                    parts.append(".*" if piece == "**" else fnmatch.translate(piece)[4:-3].replace(".*", "[^/]*").replace("(?s:", "(?:"))
                body = "/".join(parts).replace("/.*/", "/(?:.*/)?")
                prefix = re.escape(base + "/") if base else ""
                out.append((base, re.compile(prefix + ("" if anchored else "(?:.*/)?") + body + r"\Z"), only_directories, keep))
        return Ignore(tuple(out))

    def ignored(self, path: str, directory: bool) -> bool:
        verdict = False
        for _, pattern, only_directories, keep in self.rules:
            if (directory or not only_directories) and pattern.match(path):
                verdict = not keep
        return verdict


def walk(root: str) -> Iterator[tuple[str, int, int]]:
    """(path, size, mtime) of every file that is neither ignored nor a link, hidden ones included, in order."""
    top = Path(root)
    rules = Ignore()
    exclude = top / ".git" / "info" / "exclude"
    if exclude.exists():
        rules = rules.below(exclude.parent, "", ("exclude",))

    def visit(directory: Path, base: str, ignore: Ignore) -> Iterator[tuple[str, int, int]]:
        ignore = ignore.below(directory, base)
        for e in sorted(os.scandir(directory), key=lambda e: e.name):
            path = f"{base}/{e.name}" if base else e.name
            if e.is_symlink() or e.name in (".git", OWN_DIRECTORY) or ignore.ignored(path, e.is_dir(follow_symlinks=False)):
                continue
            if e.is_dir(follow_symlinks=False):
                yield from visit(Path(e.path), path, ignore)
            elif e.is_file(follow_symlinks=False):
                s = e.stat(follow_symlinks=False)
                yield path, s.st_size, s.st_mtime_ns

    yield from visit(top, "", rules)


def read_confined(root: str, path: str) -> bytes:
    """Bytes of a file below the root; no component may be a link or lead out."""
    parts = path.split("/")
    if path.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise OSError("E101: path leaves the root")
    at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
    try:
        for p in parts[:-1]:
            below = os.open(p, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
            os.close(at)
            at = below
        f = os.open(parts[-1], os.O_RDONLY | os.O_NOFOLLOW, dir_fd=at)
        with os.fdopen(f, "rb") as h:
            return h.read()
    finally:
        os.close(at)


def listing(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame(list(walk(root)), LISTING)


def read_files(files: DataFrame, root: str, reader: Callable[[str, str], bytes] = read_confined) -> DataFrame:
    """(path, content, read_error) of the listed files; reading happens in the tasks."""
    ship_package(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            rows = []
            for p in b["path"]:
                try:
                    rows.append((p, reader(root, p), None))
                except OSError as e:
                    rows.append((p, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "read_error"])

    return files.select("path").mapInPandas(run, CONTENT)


def inventory(spark: SparkSession, root: str, max_source_bytes: int = MAX_SOURCE_BYTES, reader: Callable[[str, str], bytes] = read_confined) -> DataFrame:
    """path, category, support, content_sha256, excluded_reason, read_error, size_bytes, modified_ns.

    Documents and assets are only listed; source files over the budget are not read; binary content keeps its
    hash and is marked.
    """
    category, support = classify(F.col("path"))
    files = listing(spark, root).withColumns({"category": category, "support": support})
    over = (F.col("category") == "source") & (F.col("size_bytes") > max_source_bytes)
    files = files.withColumn("excluded_reason", F.when(over, F.concat(F.lit("SOURCE_SIZE_LIMIT: size="), F.col("size_bytes"), F.lit(f" limit={max_source_bytes}"))))
    wanted = files.where((F.col("support") != "metadata") & F.col("excluded_reason").isNull())
    read = read_files(wanted, root, reader)
    binary = F.col("content").isNotNull() & (~F.is_valid_utf8(F.col("content").cast("string")) | F.expr("position(x'00' in content) > 0"))
    hashed = read.select("path", F.sha2("content", 256).alias("content_sha256"), F.coalesce("read_error", F.when(binary, "BINARY_CONTENT")).alias("read_error"))
    return files.join(hashed, "path", "left").select("path", "category", "support", "content_sha256", "excluded_reason", "read_error", "size_bytes", "modified_ns")


def verified(files: DataFrame, root: str) -> DataFrame:
    """(path, content, error): content read again; STALE_SOURCE where it is no longer what the inventory hashed."""
    again = read_files(files, root).join(files.select("path", F.col("content_sha256").alias("expected")), "path")
    actual = F.sha2("content", 256)
    stale = F.concat(F.lit("STALE_SOURCE expected="), F.coalesce("expected", F.lit("none")), F.lit(" actual="), F.coalesce(actual, F.lit("none")))
    same = F.coalesce(actual == F.col("expected"), F.lit(False))
    return again.select("path", F.when(same, F.col("content")).alias("content"), F.coalesce("read_error", F.when(~same, stale)).alias("error"))


def readable(files: DataFrame, categories: tuple[str, ...] | None = None, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Inventory rows of these categories and extensions that were hashed and neither excluded nor unreadable."""
    kept = files.where("content_sha256 is not null and excluded_reason is null and read_error is null")
    if categories is not None:
        kept = kept.where(F.col("category").isin(*categories))
    return kept if extensions is None else kept.where(extension(F.col("path")).isin(*extensions))


def parse_candidates(files: DataFrame) -> DataFrame:
    """What is to be parsed: source files with a hash that could be read."""
    return files.where("category = 'source' and content_sha256 is not null and read_error is null")


def newest_cache(candidates: DataFrame) -> DataFrame:
    """(location): of the places that may hold a cache the one whose active generation is newest; ties by location."""
    return candidates.where("active_scan_id is not null").agg(F.max_by("location", F.struct("created_at", "location")).alias("location")).where("location is not null")
