"""Reads of a generation: lookups, components, languages, totals, states of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import extension, is_test_path
from lodestrata.operators.report import lookup_status

#: What a component may be, and parts of paths in which none is looked for.
COMPONENT_KINDS = ("class", "interface", "struct", "function")
NOT_COMPONENTS = ("%test%", "%spec%", "%mock%", "%fixture%", "%.sh", "%.bash", "%.zsh", "%scripts/%", "%migrations/%", "%backup%")


def published_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols as a generation holds them, with repository and path of their file instead of its number; symbols of no file are left out."""
    of = files.where("file_id is not null").groupBy("file_id").agg(F.min_by(F.struct("repo", "path"), F.struct("repo", "path")).alias("f")).select("file_id", "f.repo", F.col("f.path").alias("file_path"))
    return symbols.drop("repo", "file_path").join(of, "file_id").drop("file_id")


def published_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, callee, edge_kind, weight): edges between numbers as edges between names; those with an unknown end are left out."""
    names = symbols.where("symbol_id is not null and fqsn is not null").groupBy("symbol_id").agg(F.min("fqsn").alias("fqsn"))
    end = lambda column, name: names.select(F.col("symbol_id").alias(column), F.col("fqsn").alias(name))
    return edges.join(end("caller_id", "caller"), "caller_id").join(end("callee_id", "callee"), "callee_id").groupBy("caller", "callee", "edge_kind").agg(F.sum("weight").alias("weight"))


def lookup(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lookup_id, n, status, fqsn) of lookups by full or bare name and, if given, path.

    symbols: fqsn, name, path; wanted: lookup_id, key, in_path (null for any). ``fqsn`` is given where there is just one. Both
    ways of naming are joined by equality; a symbol found by both counts once.
    """
    known = symbols.where("fqsn is not null").select("fqsn", "name", "path").distinct()
    by = lambda column: wanted.join(known.withColumn("key", F.col(column)), "key").where("in_path is null or in_path = path").select("lookup_id", "fqsn")
    found = by("fqsn").unionByName(by("name")).groupBy("lookup_id").agg(F.count_distinct("fqsn").alias("n"), F.min("fqsn").alias("fqsn"))
    out = wanted.select("lookup_id").distinct().join(found, "lookup_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("lookup_id", "n", lookup_status(F.col("n")).alias("status"), F.when(F.col("n") == 1, F.col("fqsn")).alias("fqsn"))


def components(symbols: DataFrame, files: DataFrame, most: int = 50) -> DataFrame:
    """(fqsn, name, kind, path, complexity, span): the ``most`` most complex symbols of the application itself.

    Tests, scripts, migrations and backups hold none. By complexity, then length, then name; a symbol extracted several times
    counts once, with the most complex extraction.
    """
    path = F.lower("path")
    wanted = ~is_test_path(F.col("path"))
    for pattern in NOT_COMPONENTS:
        wanted = wanted & ~path.like(pattern)
    of = files.where(F.col("path").isNotNull() & wanted).groupBy("file_id").agg(F.min("path").alias("path"))
    span = F.coalesce(F.col("line_end") - F.col("line_start"), F.lit(0))
    one = symbols.where(F.lower("kind").isin(*COMPONENT_KINDS) & F.col("fqsn").isNotNull()).groupBy("file_id", "fqsn").agg(
        F.max(F.struct(F.coalesce("cyclomatic_complexity", F.lit(0)).alias("complexity"), span.alias("span"), F.lower("kind").alias("kind"), "name")).alias("s")
    )
    return one.join(of, "file_id").select("fqsn", "s.name", "s.kind", "path", "s.complexity", "s.span").orderBy(F.desc("complexity"), F.desc("span"), "fqsn").limit(most)


def component_graph(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, dst, kind) between the components; relations to what is none are left out."""
    names = nodes.select("fqsn").distinct()
    return relations.join(names.withColumnRenamed("fqsn", "src"), "src", "left_semi").join(names.withColumnRenamed("fqsn", "dst"), "dst", "left_semi").select("src", "dst", "kind").distinct()


def languages(files: DataFrame, group: str = "repo") -> DataFrame:
    """(group, languages): sorted, each once, by file extension."""
    ext = F.lower(extension(F.col("path")))
    return files.groupBy(group).agg(F.sort_array(F.collect_set(F.when(ext != "", ext))).alias("languages"))


def scan_totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo, n_files, n_lines, n_symbols). files: repo, file_id, n_lines; symbols: file_id, fqsn."""
    per_file = symbols.select("file_id", "fqsn").distinct().groupBy("file_id").agg(F.count("*").alias("k"))
    one = files.groupBy("repo", "file_id").agg(F.max("n_lines").alias("n_lines"))
    return one.join(per_file, "file_id", "left").groupBy("repo").agg(F.count("*").alias("n_files"), F.sum("n_lines").cast("bigint").alias("n_lines"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_symbols"))


def run_states(processed: DataFrame, diagnostics: DataFrame, group: str) -> DataFrame:
    """(group, analysis_state, coverage_state, files_with_errors) of runs.

    A run is complete unless something other than a missing tree was diagnosed; then it is failed if it processed nothing, else
    partial. processed: group, n; diagnostics: group, code, path.
    """
    block = F.col("code") != "AST_UNSUPPORTED"
    d = diagnostics.groupBy(group).agg(F.max(block).alias("blocked"), F.count("*").alias("n_diagnostics"), F.count_distinct(F.when(block, F.col("path"))).alias("files_with_errors"))
    both = processed.join(d, group, "left")
    state = F.when(~F.coalesce("blocked", F.lit(False)), "complete").when(F.coalesce("n", F.lit(0)) == 0, "failed").otherwise("partial")
    return both.select(group, state.alias("analysis_state"), F.when((F.coalesce("n_diagnostics", F.lit(0)) > 0) | (state != "complete"), "partial").otherwise("complete").alias("coverage_state"), F.coalesce("files_with_errors", F.lit(0)).alias("files_with_errors"))
