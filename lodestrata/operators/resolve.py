"""Calls to symbols: lexical resolution, edges, evidence and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import scope_of
from lodestrata.operators.report import ORPHAN_EXEMPT, all_valid

OCCURRENCE_FIELDS = ("caller_fqsn", "callee_name", "callee_expression", "edge_kind", "line_start", "column_start", "line_end", "column_end", "content_sha256")


def occurrence_id(columns: list[Column]) -> Column:
    return F.sha2(F.concat_ws("\u0000", *(c.cast("string") for c in columns)), 256)


def ancestors(fqsn: Column) -> Column:
    """Scopes around a symbol, the nearest first, ending with the file: array<struct<depth, scope>>."""
    parts = F.split(F.regexp_replace(fqsn, r"::<signature:[^>]*>$", ""), "::")
    n = F.size(parts)
    return F.when(n < 2, F.array().cast("array<struct<depth:int,scope:string>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda d: F.struct(d.cast("int").alias("depth"), F.array_join(F.slice(parts, 1, n - d), "::").alias("scope")))
    )


def nearest_scope(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """Candidates of every occurrence in the nearest enclosing scope that declares the called name.

    occurrences: occurrence_id, caller_fqsn, callee_name, direct, shadowed. symbols: fqsn, name. Returns
    occurrence_id, resolution (resolved, ambiguous, unresolved) and sorted candidates. Member and shadowed
    calls stay unresolved. The scope chain is exploded, so the join is a plain equality on scope and name;
    a scope is part of a path, so no key is hot.
    """
    declared = symbols.where("fqsn is not null and name is not null").select(scope_of(F.col("fqsn")).alias("scope"), F.col("name").alias("callee_name"), "fqsn").distinct()
    chain = occurrences.where("direct and not shadowed").select("occurrence_id", "callee_name", F.explode(ancestors(F.col("caller_fqsn"))).alias("a")).select("occurrence_id", "callee_name", "a.depth", "a.scope")
    levels = chain.join(declared, ["scope", "callee_name"]).groupBy("occurrence_id", "depth").agg(F.sort_array(F.collect_set("fqsn")).alias("candidates"))
    best = levels.groupBy("occurrence_id").agg(F.min_by("candidates", "depth").alias("candidates"))
    return occurrences.select("occurrence_id").distinct().join(best, "occurrence_id", "left").select(
        "occurrence_id",
        F.when(F.size("candidates") == 1, "resolved").when(F.size("candidates") > 1, "ambiguous").otherwise("unresolved").alias("resolution"),
        F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"),
    )


def name_unique_edges(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller, callee, edge_kind, weight): calls whose name is that of exactly one symbol of the file."""
    named = symbols.groupBy("file_path", F.col("name").alias("callee_name")).agg(F.countDistinct("fqsn").alias("n"), F.min("fqsn").alias("callee")).where("n = 1").drop("n")
    return occurrences.join(named, ["file_path", "callee_name"]).groupBy(F.col("caller_fqsn").alias("caller"), "callee", "edge_kind").agg(F.sum(F.lit(1.0)).alias("weight"))


def with_evidence(occurrences: DataFrame, inventory: DataFrame) -> DataFrame:
    """Occurrences whose file is in the inventory with the very content they were read from."""
    return occurrences.join(inventory.select("path", "content_sha256").where("content_sha256 is not null").distinct(), ["path", "content_sha256"], "left_semi")


def relations(resolved: DataFrame, generation: DataFrame) -> DataFrame:
    """Relations of resolutions: candidates that are in the generation, the target where there is one only."""
    kept = resolved.select("occurrence_id", F.posexplode_outer("candidates").alias("at", "fqsn")).join(generation.select("fqsn").distinct(), "fqsn", "left_semi")
    lists = kept.groupBy("occurrence_id").agg(F.array_sort(F.collect_list(F.struct("at", "fqsn"))).alias("c")).select("occurrence_id", F.transform("c", lambda x: x["fqsn"]).alias("candidate_ids"))
    return resolved.select("occurrence_id").join(lists, "occurrence_id", "left").select(
        F.concat(F.lit("rel:"), "occurrence_id").alias("relation_id"), "occurrence_id", F.coalesce("candidate_ids", F.array().cast("array<string>")).alias("candidate_ids"),
        F.when(F.size("candidate_ids") == 1, F.get("candidate_ids", F.lit(0))).alias("to_id"),
        F.when(F.size("candidate_ids") == 1, "resolved").when(F.size("candidate_ids") > 1, "ambiguous").otherwise("unresolved").alias("resolution"),
    )


def orphans(facts: DataFrame, relations_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Functions and methods that no relation leads to, names of entry points apart.

    facts: fact_id, kind, name, evidence_ids and further columns; relations: relation_id, to_id, resolution, evidence_ids. A fact or
    relation counts only with evidence of which every id exists.
    """
    sure = relations_.where("resolution = 'resolved' and to_id is not null")
    called = all_valid(sure, "relation_id", evidence).select(F.col("to_id").alias("fact_id")).distinct()
    functions = facts.where(F.lower("kind").isin("function", "method") & ~F.lower("name").isin(*ORPHAN_EXEMPT))
    return all_valid(functions, "fact_id", evidence).join(called, "fact_id", "left_anti")


def path_relations(path: DataFrame, relations_: DataFrame) -> DataFrame:
    """(position, from_id, to_id, relation_id) of the steps of a traced path: the first relation by id between neighbours."""
    ahead = path.select((F.col("position") - 1).alias("position"), F.col("node").alias("to_id"))
    steps = path.select("position", F.col("node").alias("from_id")).join(ahead, "position")
    return steps.join(relations_.select("relation_id", "from_id", "to_id"), ["from_id", "to_id"], "left").groupBy("position", "from_id", "to_id").agg(F.min("relation_id").alias("relation_id"))
