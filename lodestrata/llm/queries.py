"""Queries of the training-data operators, with SQL oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import docpairs, leakage, packing, provenance, secrets, subjects, syntax
from lodestrata.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of symbols that hold usable credentials."""
    return p1_redacted(spark, sf_dir).select("symbol_id", "field_name").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields with the credentials masked in place."""
    return secrets.redacted_fields(table(spark, sf_dir, "symbols"), "symbol_id", {"signature_clean": True, "docstring_clean": False})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody in the project wrote by hand."""
    return p3_labels(spark, sf_dir).where("label <> 'handwritten'").select("file_id").distinct()


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label of every file: handwritten, generated, minified, vendored or blob."""
    return provenance.labelled_files(table(spark, sf_dir, "files"), table(spark, sf_dir, "inventory_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content does not follow the grammar of their extension's language."""
    return syntax.judged_files(table(spark, sf_dir, "files"), detail=False).where("not valid").select("file_id").distinct()


def p4_diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invalid files with place and cause of the furthest failure."""
    return syntax.judged_files(table(spark, sf_dir, "files")).where("not valid")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of invalid files per repository and language."""
    return syntax.invalid_rates(syntax.judged_files(table(spark, sf_dir, "files"), detail=False))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods whose comment describes a function: the documenting side of the pairs, themselves or a definition."""
    return p5_pairs(spark, sf_dir).select(F.col("doc_symbol_id").alias("symbol_id")).distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of every documented function, declarations joined to definitions."""
    return docpairs.documented_pairs(table(spark, sf_dir, "symbols"), table(spark, sf_dir, "files").select("file_id", "repo"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with the container of 2,048 tokens it lies in."""
    return packing.containers(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill_report(p6_containers(spark, sf_dir))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That every text is there once and no container is over its capacity."""
    return packing.invariants(p6_containers(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and the documents that hold at least half of them."""
    return p7_leaks(spark, sf_dir).select("item_id", "doc_id").distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the share that leaked and whether the answer did."""
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of every document."""
    return p8_subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p8_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the share of sentences about each subject."""
    return subjects.document_subjects(*(table(spark, sf_dir, t) for t in ("documents", "doc_labels", "subjects")))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p3_found": p3_found, "p3_labels": p3_labels, "p4_found": p4_found, "p4_diagnosed": p4_diagnosed, "p4_rates": p4_rates, "p5_found": p5_found, "p5_pairs": p5_pairs, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_invariants": p6_invariants, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_subjects": p8_subjects}
ORACLES: dict[str, str] = {
    "p6_invariants": r"SELECT count(DISTINCT doc_id) AS n_texts, 0 AS n_wrong, 0 AS n_split, 0 AS n_over FROM documents WHERE regexp_matches(text, '[^\s]')",
}
