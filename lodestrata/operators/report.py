"""Reports over a generation: coverage, maps, honesty, documentation."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of coverage by precedence, and what kinds belong to which map.
COVERAGE = ("partial", "not_scanned", "unsupported", "complete")
MAP_KINDS = {"infrastructure": r"infrastructure|container|deployment", "entrypoints": r"entry.?point", "imports": r"import|depends_on|dependency", "code": r"function|method|class|interface|struct|symbol"}
MAP_RELATIONS = {"infrastructure": r"infra|container|deploy|configures", "imports": r"import|depends_on|dependency", "code": r"calls|call|data.flow"}
ORPHAN_EXEMPT = ("main", "start", "init", "index", "run", "handler")
LOW_CONFIDENCE = ("room:", "rtc:", "sfu:", "webrtc:", "screenshare:", "presence:", "notification:")
#: Fixed value: the event of the connection itself, which nobody emits.
NEVER_DEAD = "connection"


def combined_coverage(parts: DataFrame, group: str) -> DataFrame:
    """(group, state, examined, excluded): the worst state and the sums."""
    rank = F.array_position(F.array(*(F.lit(s) for s in COVERAGE)), F.col("state"))
    return parts.groupBy(group).agg(F.min_by("state", rank).alias("state"), F.sum("examined").alias("examined"), F.sum("excluded").alias("excluded"))


def file_nodes(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """Files as nodes with the sorted ids of their evidence."""
    ids = evidence.groupBy("path").agg(F.sort_array(F.collect_list("evidence_id")).alias("evidence_ids"))
    return files.join(ids, "path", "left").select("path", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"))


def fact_nodes(facts: DataFrame, evidence: DataFrame, kind: str) -> DataFrame:
    """(fact_id, kind, label) of the facts of a map that have any valid evidence."""
    wanted = facts.where(F.lower("kind").rlike(MAP_KINDS[kind])) if kind in MAP_KINDS else facts
    valid = wanted.select("fact_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi").select("fact_id").distinct()
    return wanted.join(valid, "fact_id", "left_semi").select("fact_id", "kind", F.coalesce(F.col("attributes")["name"], F.col("attributes")["path"], F.col("kind")).alias("label"))


def relation_view(relations: DataFrame, evidence: DataFrame, kind: str | None = None) -> DataFrame:
    """Relations with their standing: confirmed if resolved with a target and valid evidence, else hypothesis."""
    wanted = relations.where(F.lower("kind").rlike(MAP_RELATIONS[kind])) if kind in MAP_RELATIONS else relations
    valid = wanted.select("relation_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi").select("relation_id").distinct().withColumn("ok", F.lit(True))
    sure = (F.col("resolution") == "resolved") & F.col("to_id").isNotNull() & F.coalesce("ok", F.lit(False))
    return wanted.join(valid, "relation_id", "left").select("relation_id", "from_id", "to_id", "kind", F.when(sure, "confirmed").otherwise("hypothesis").alias("standing"))


def all_valid(df: DataFrame, key: str, evidence: DataFrame) -> DataFrame:
    """Rows that have evidence and of whose evidence every id exists; for maps some is enough, for reports it is not."""
    ids = df.select(key, F.explode("evidence_ids").alias("evidence_id")).distinct()
    known = evidence.select("evidence_id").distinct().withColumn("known", F.lit(True))
    whole = ids.join(known, "evidence_id", "left").groupBy(key).agg(F.min(F.coalesce("known", F.lit(False))).alias("whole")).where("whole").select(key)
    return df.join(whole, key, "left_semi")


def merged_diagnostics(diagnostics: DataFrame, group: str) -> DataFrame:
    """(group, code, path, message): one diagnostic per code and path, the last one in order."""
    return diagnostics.groupBy(group, "code", "path").agg(F.max_by("message", "at").alias("message"))


def architecture_map(kind: str, root: str, scan_id: str, files: DataFrame, facts: DataFrame, evidence: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, relations) of a map: context, structure, infrastructure, entrypoints, imports or code.

    nodes: id, label, kind, state, evidence_ids. Excluded files are in none. The context is the repository alone.
    """
    spark = files.sparkSession
    none = F.array().cast("array<string>")
    there = files.where("excluded_reason is null")

    def of_files(df: DataFrame) -> DataFrame:
        return file_nodes(df, evidence).select(F.concat(F.lit("file:"), "path").alias("id"), F.col("path").alias("label"), F.lit("file").alias("kind"), F.lit("inventory").alias("state"), "evidence_ids")

    def of_facts() -> DataFrame:
        known = fact_nodes(facts, evidence, kind)
        valid = facts.select("fact_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id").distinct(), "evidence_id", "left_semi").groupBy("fact_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"))
        return known.join(valid, "fact_id").select(F.col("fact_id").alias("id"), "label", "kind", F.lit("confirmed").alias("state"), "evidence_ids")

    if kind == "context":
        label = [p for p in root.replace("\\", "/").split("/") if p][-1:] or [root]
        nodes = spark.range(1).select(F.lit(f"repository:{root}").alias("id"), F.lit(label[0]).alias("label"), F.lit("repository").alias("kind"), F.lit("inventory").alias("state"), none.alias("evidence_ids"))
    elif kind in ("structure", "imports"):
        nodes = of_files(there)
    elif kind == "infrastructure":
        nodes = of_files(there.where("category = 'infra'")).unionByName(of_facts())
    elif kind in ("entrypoints", "code"):
        nodes = of_facts()
    else:
        raise ValueError(f"INVALID_MAP: {kind}")
    edges = relation_view(relations, evidence, kind) if kind in MAP_RELATIONS else relation_view(relations.limit(0), evidence)
    return nodes.orderBy("id"), edges.orderBy("relation_id")


def map_status(nodes: Column, complete: Column) -> Column:
    return F.when(nodes == 0, "UNSUPPORTED").when(complete, "SUCCESS").otherwise("PARTIAL")


def lookup_status(n: Column) -> Column:
    return F.when(n == 0, "NOT_FOUND").when(n == 1, "SUCCESS").otherwise("AMBIGUOUS")


def event_confidence(name: Column) -> Column:
    low = F.lit(False)
    for p in LOW_CONFIDENCE:
        low = low | name.startswith(p)
    return F.when(low, "low").when(name.contains(":"), "medium").otherwise("high")


def dead_and_undeclared(typed: DataFrame, used: DataFrame) -> DataFrame:
    """(event_name, finding, confidence): declared and never used, used and never declared."""
    t, u = typed.select("event_name").distinct(), used.select("event_name").distinct()
    dead = t.where(F.col("event_name") != NEVER_DEAD).join(u, "event_name", "left_anti").withColumn("finding", F.lit("dead"))
    bare = u.join(t, "event_name", "left_anti").withColumn("finding", F.lit("undeclared"))
    return dead.unionByName(bare).withColumn("confidence", event_confidence(F.col("event_name")))


def honesty_report(typed: DataFrame, used: DataFrame, facts: DataFrame, relations: DataFrame, evidence: DataFrame) -> DataFrame:
    """(type, name, source_file, confidence): dead and undeclared events and orphan functions.

    typed, used: event_name, source_file. Orphans are the functions and methods with nothing but valid evidence
    that no resolved relation with nothing but valid evidence leads to.
    """
    from lodestrata.operators.resolve import orphans

    place = typed.select("event_name", "source_file").unionByName(used.select("event_name", "source_file")).groupBy("event_name").agg(F.min("source_file").alias("source_file"))
    kind = F.when(F.col("finding") == "dead", "DEAD_DECLARED_EVENT").otherwise("UNDECLARED_EVENT")
    events = dead_and_undeclared(typed, used).join(place, "event_name").select(kind.alias("type"), F.col("event_name").alias("name"), "source_file", F.when(F.col("finding") == "dead", F.col("confidence")).alias("confidence"))
    lost = orphans(facts, relations, evidence).select(F.lit("ORPHAN_SYMBOL").alias("type"), "name", F.col("path").alias("source_file"), F.lit(None).cast("string").alias("confidence"))
    return events.unionByName(lost)


def honesty_summary(findings: DataFrame) -> DataFrame:
    """(type, n) with a row for every type, and the total as candidates."""
    kinds = F.explode(F.array(*(F.lit(k) for k in ("DEAD_DECLARED_EVENT", "UNDECLARED_EVENT", "ORPHAN_SYMBOL", "CANDIDATES"))))
    all_ = findings.select(F.explode(F.array(F.col("type"), F.lit("CANDIDATES"))).alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    return findings.sparkSession.range(1).select(kinds.alias("type")).join(all_, "type", "left").select("type", F.coalesce("n", F.lit(0)).alias("n"))


def precision_recall(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: precision and recall of distinct keys; 1 where there is nothing to find or to err on."""
    both = found.select(*keys, F.lit(1).alias("f"), F.lit(0).alias("e")).unionByName(expected.select(*keys, F.lit(0).alias("f"), F.lit(1).alias("e")))
    c = both.groupBy(*keys).agg(F.max("f").alias("f"), F.max("e").alias("e")).agg(F.coalesce(F.sum(F.col("f") * F.col("e")), F.lit(0)).alias("hit"), F.coalesce(F.sum("f"), F.lit(0)).alias("nf"), F.coalesce(F.sum("e"), F.lit(0)).alias("ne"))
    return c.select(F.when(F.col("nf") == 0, 1.0).otherwise(F.col("hit") / F.col("nf")).alias("precision"), F.when(F.col("ne") == 0, 1.0).otherwise(F.col("hit") / F.col("ne")).alias("recall"))


def decision_record(number: int, title: str, context: str, decision: str, consequences: str) -> str:
    return f"# ADR {number:03d}: {title}\n\n## Status\n\nAccepted\n\n## Context\n\n{context}\n\n## Decision\n\n{decision}\n\n## Consequences\n\n{consequences}\n"


def documentation(tables: dict[str, DataFrame], most: int = 200) -> dict[str, str]:
    """Markdown pages, one per table, of at most ``most`` rows each, in order; a page that stops says how many rows there are."""
    pages = {}
    for name, df in sorted(tables.items()):
        rows = df.orderBy(*df.columns).limit(most + 1).collect()
        stopped = f"\n{most} of {df.count()} rows.\n" if len(rows) > most else ""
        rows = rows[:most]
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        body = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
        pages[f"{name}.md"] = f"# {name.replace('_', ' ').capitalize()}\n\n" + "\n".join(body) + "\n" + stopped
    return pages


def _recovered(root: Path) -> dict[str, str]:
    """What the last export owns. One that was cut short left a journal of the pages it was about to write; those of them that are
    there as announced are owned too."""
    record, journal = root / ".manifest.json", root / ".journal.json"
    owned = json.loads(record.read_text()) if record.exists() else {}
    if journal.exists():
        for name, digest in json.loads(journal.read_text()).items():
            p = root / name
            if p.exists() and hashlib.sha256(p.read_bytes()).hexdigest() == digest:
                owned[name] = digest
        for left in root.glob(".*.new"):
            left.unlink()
        record.write_text(json.dumps(owned))
        journal.unlink()
    return owned


def export(pages: dict[str, str], target: str) -> dict[str, list[str]]:
    """Write pages, keep what others changed, remove own pages that are gone; what was done, by outcome.

    One export at a time: a second one is refused with EXPORT_LOCKED, as is one after a crash until its lock is removed. What a crashed
    one had written is then known as its own.
    """
    root = Path(target)
    root.mkdir(parents=True, exist_ok=True)
    lock = root / ".lock"
    try:
        os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError as e:
        raise RuntimeError(f"EXPORT_LOCKED: {lock}") from e
    try:
        return _export(pages, root)
    finally:
        lock.unlink()


def _export(pages: dict[str, str], root: Path) -> dict[str, list[str]]:
    record, journal = root / ".manifest.json", root / ".journal.json"
    before = _recovered(root)
    journal.write_text(json.dumps({n: hashlib.sha256(t.encode()).hexdigest() for n, t in pages.items()}))
    digest = lambda b: hashlib.sha256(b).hexdigest()
    done: dict[str, list[str]] = {"written": [], "unchanged": [], "conflict": [], "removed": []}
    after = {}
    for name, text in sorted(pages.items()):
        p, new = root / name, text.encode()
        old = p.read_bytes() if p.exists() else None
        if old is not None and digest(old) != before.get(name) and old != new:
            done["conflict"].append(name)
            continue
        if old != new:
            temporary = p.with_name(f".{p.name}.new")
            temporary.write_bytes(new)
            temporary.replace(p)
        done["unchanged" if old == new else "written"].append(name)
        after[name] = digest(new)
    for name in sorted(set(before) - set(pages)):
        p = root / name
        if p.exists() and digest(p.read_bytes()) == before[name]:
            p.unlink()
            done["removed"].append(name)
        elif p.exists():
            done["conflict"].append(name)
    record.write_text(json.dumps(after))
    journal.unlink()
    return done
