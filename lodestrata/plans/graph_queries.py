"""Queries of generations, resolution, graphs, contracts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.operators import contracts, generations, graph, infra, parsing, report, resolve
from lodestrata.runtime import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and quantities of line items as a graph."""
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")).alias("dst")).distinct()


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Symbols, and as a call of each the name of the next symbol of its file."""
    s = table(spark, d, "symbols").where("fqsn is not null and name is not null").groupBy("fqsn").agg(F.min("name").alias("name"), F.min("file_id").alias("file_id"))
    s = s.withColumn("file_path", F.regexp_extract("fqsn", r"^(.*?)::", 1))
    w = Window.partitionBy("file_path").orderBy("fqsn")
    calls = s.withColumn("callee_name", F.lead("name").over(w)).where("callee_name is not null").select(
        "file_path", F.col("fqsn").alias("caller_fqsn"), "callee_name", F.lit("calls").alias("edge_kind"), F.sha2(F.concat_ws("\u0000", "fqsn", "callee_name"), 256).alias("occurrence_id"), F.lit(True).alias("direct"), F.lit(False).alias("shadowed"))
    return s, calls


def generation_retention(spark: SparkSession, d: str) -> DataFrame:
    return generations.retained(table(spark, d, "scan_runs"), 3)


def active_pointer(spark: SparkSession, d: str) -> DataFrame:
    return generations.pointers(table(spark, d, "scan_runs"))


def generation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct symbols per complete generation."""
    done = table(spark, d, "scan_runs").where("state = 'complete'").select("scan_id").distinct()
    return table(spark, d, "generation_symbols").join(done, "scan_id", "left_semi").groupBy("scan_id").agg(F.count("*").alias("n_rows"), F.countDistinct("fqsn").alias("n_symbols"))


def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    """Files by repository and path, the latest index of each."""
    f = table(spark, d, "files").select("repo", "path", "file_id", "git_oid", "indexed_at")
    return generations.latest_rows(f, ["repo", "path"], F.struct("indexed_at", "file_id")).select("repo", "path", "file_id", "git_oid")


def batch_replace(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of re-parsed files give way to those of the newest extraction: here, of files with parser results."""
    s = table(spark, d, "symbols").select("file_id", "fqsn").distinct()
    new = s.join(table(spark, d, "parse_outputs").where("lower(analysis_state) = 'complete'").select("file_id").distinct(), "file_id", "left_semi").select("file_id", F.concat("fqsn", F.lit("#2")).alias("fqsn"))
    return generations.replaced(s, new, ["file_id"])


def reconcile_vanished(spark: SparkSession, d: str) -> DataFrame:
    """Files that no inventory has."""
    return generations.vanished(table(spark, d, "files").select("repo", "path").distinct(), table(spark, d, "inventory_files"), ["repo", "path"])


def paging(spark: SparkSession, d: str) -> DataFrame:
    """The page of 200 orders after a key."""
    return generations.page(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 1000, 200)


def paging_byte_cap(spark: SparkSession, d: str) -> DataFrame:
    """Of that page, what fits into 4,000 bytes of JSON."""
    return generations.byte_capped(paging(spark, d), "o_orderkey", 4000).select("o_orderkey", "json_bytes", "total_bytes")


def catalog_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the catalogue of all orders."""
    return generations.catalog_digest(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))


def publish_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges with keys translated to names by two joins, weighted by their line items."""
    e = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("weight"))
    return e.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("s_name", "p_brand").agg(F.sum("weight").alias("weight"))


def nearest_scope(spark: SparkSession, d: str) -> DataFrame:
    s, calls = _calls(spark, d)
    r = resolve.nearest_scope(calls, s)
    return r.select("occurrence_id", "resolution", F.array_join("candidates", "|").alias("candidates"))


def name_unique_edges(spark: SparkSession, d: str) -> DataFrame:
    s, calls = _calls(spark, d)
    return resolve.name_unique_edges(calls, s)


def semi_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Parser results whose path and content the inventory confirms."""
    p = table(spark, d, "parse_outputs").where("content_sha256 is not null").select("repo", "path", F.lower("content_sha256").alias("content_sha256")).distinct()
    i = table(spark, d, "inventory_files").select("path", F.lower("content_sha256").alias("content_sha256"))
    return resolve.with_evidence(p, i).groupBy("repo").agg(F.count("*").alias("n_confirmed"))


def relation_targets(spark: SparkSession, d: str) -> DataFrame:
    """Relations per resolution after candidates that the latest generations lack are gone."""
    s, calls = _calls(spark, d)
    return resolve.relations(resolve.nearest_scope(calls, s), table(spark, d, "generation_symbols")).groupBy("resolution").agg(F.count("*").alias("n"), F.count("to_id").alias("n_targets"))


def orphan_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods that no resolved relation leads to, with parser results as evidence, per file extension."""
    s, calls = _calls(spark, d)
    kinds = table(spark, d, "symbols").where("fqsn is not null").groupBy("fqsn").agg(F.min(F.lower("kind")).alias("kind"))
    evidence = table(spark, d, "parse_outputs").select(F.col("file_id").cast("string").alias("evidence_id")).distinct()
    ids = F.array(F.col("file_id").cast("string")).alias("evidence_ids")
    facts = s.join(kinds, "fqsn").select(F.col("fqsn").alias("fact_id"), "kind", "name", "file_path", ids)
    callers = calls.join(s.select(F.col("fqsn").alias("caller_fqsn"), "file_id"), "caller_fqsn").select("occurrence_id", ids)
    rel = resolve.relations(resolve.nearest_scope(calls, s), s).join(callers, "occurrence_id")
    return resolve.orphans(facts, rel, evidence).groupBy(F.regexp_extract("file_path", r"\.([a-z]+)$", 1).alias("ext")).agg(F.count("*").alias("n_orphans"))


def degree_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 70 nodes of most neighbours."""
    return graph.prune(_edges(spark, d), 70)[0]


def pruned_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges among them."""
    return graph.prune(_edges(spark, d), 70)[1].select("src", "dst")


def bfs_distances(spark: SparkSession, d: str) -> DataFrame:
    """Nations within four steps of the first one, each linked to those three and seven numbers on."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"))
    e = n.select("src", F.explode(F.array((F.col("src") + 3) % 25, (F.col("src") + 7) % 25)).alias("dst"))
    return graph.distances(e, n.where("src = 0").select(F.col("src").alias("node")), 4).select("node", "distance")


def bfs_supply(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers, parts and orders within four steps of the first supplier, along the line items in either direction."""
    item = table(spark, d, "lineitem").select(*(F.concat(F.lit(k[2]), F.col(k).cast("string")).alias(k) for k in ("l_suppkey", "l_partkey", "l_orderkey")))
    pairs = F.array(*(F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for x, y in (("l_suppkey", "l_partkey"), ("l_partkey", "l_orderkey")) for a, b in ((x, y), (y, x))))
    e = item.select(F.explode(pairs).alias("e")).select("e.*")
    first = item.select(F.lit("s1").alias("node")).limit(1)
    return graph.distances(e, first, 4).select("node", "distance")


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "nation").select(F.col("n_regionkey").alias("src"), F.col("n_nationkey").alias("dst"))
    return graph.adjacency(e).select("src", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


def mermaid_diagram(spark: SparkSession, d: str) -> DataFrame:
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    nodes = r.select(F.concat(F.lit("R"), F.lpad(F.col("r_regionkey").cast("string"), 2, "0")).alias("node"), F.col("r_name").alias("label")).unionByName(n.select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("node"), F.col("n_name").alias("label")))
    edges = n.select(F.concat(F.lit("R"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("src"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("dst"))
    return graph.mermaid(nodes, edges)


def coverage_combine(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each repository from its parser results."""
    p = table(spark, d, "parse_outputs").select("repo", F.when(F.lower("analysis_state") == "complete", "complete").when(F.lower("analysis_state") == "partial", "partial").otherwise("not_scanned").alias("state"), F.lit(1).alias("examined"), F.when(F.col("diagnostics").isNull(), 1).otherwise(0).alias("excluded"))
    return report.combined_coverage(p, "repo")


def files_with_errors(spark: SparkSession, d: str) -> DataFrame:
    """Files per repository with diagnostics other than an unsupported language."""
    p = table(spark, d, "parse_outputs").select("repo", "file_id", F.explode("diagnostics").alias("x")).where("x.code <> 'AST_UNSUPPORTED'")
    return p.groupBy("repo").agg(F.countDistinct("file_id").alias("n_files"))


def run_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics of runs by stage and code, from their JSON."""
    kind = "array<struct<stage:string,code:string,message:string>>"
    r = table(spark, d, "scan_runs").select("scan_id", F.explode(F.from_json("diagnostics_json", kind)).alias("x")).distinct()
    return r.groupBy("x.stage", "x.code").agg(F.countDistinct("scan_id").alias("n_runs"))


def json_attributes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("sum_k"), F.count("p.k").alias("n_k"))


def symbol_lookup(spark: SparkSession, d: str) -> DataFrame:
    """How many symbols a name means, per name, and what a lookup would answer."""
    s = table(spark, d, "symbols").where("name is not null").select("name", "fqsn").distinct().groupBy("name").agg(F.count("*").alias("n"))
    return s.select("name", "n", report.lookup_status(F.col("n")).alias("status"))


def project_profiles(spark: SparkSession, d: str) -> DataFrame:
    return infra.project_profiles(table(spark, d, "inventory_files"))


def package_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Customers' segments as packages that depend on segments and on what is no package."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("package"), F.array(F.lower("c_mktsegment"), F.lit("BUILDING"), F.concat(F.lit("x"), "c_mktsegment")).alias("deps"))
    return infra.dependencies(c).select("package", F.array_join("internal", ",").alias("internal"))


def socket_event_merge(spark: SparkSession, d: str) -> DataFrame:
    """Events by name, even users hearing and odd ones sending."""
    e = table(spark, d, "events").select(F.col("event_type").alias("event_name"), F.when((F.col("user_id") % 2 == 0) | (F.col("event_type") == "view"), "S2C").otherwise("C2S").alias("direction"), (F.col("value") > 50).alias("typed"), (F.col("user_id") % 7 == 0).alias("ack"), F.lpad((F.col("user_id") % 97).cast("string"), 2, "0").alias("source"))
    return contracts.merged_events(e)


def dead_and_undeclared(spark: SparkSession, d: str) -> DataFrame:
    """Symbols' names as events: declared by methods, used by functions."""
    s = table(spark, d, "symbols")
    return report.dead_and_undeclared(s.where("lower(kind) = 'method' and name is not null").select(F.col("name").alias("event_name")), s.where("lower(kind) = 'function' and name is not null").select(F.col("name").alias("event_name")))


def model_merge(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "symbols").where("name is not null").select("name", (F.coalesce("line_end", F.lit(0)) - F.coalesce("line_start", F.lit(0))).alias("n_fields"), (F.lower(F.coalesce("kind", F.lit(""))) == "class").alias("registered"))
    return contracts.merged_models(m)


def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    t = contracts.transitions(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["o_orderdate", "o_orderkey"])
    return t.groupBy("from_state", "to_state", "event").agg(F.count("*").alias("n"))


def endpoint_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Paths as declared routes: one endpoint per method and route, the first declaration."""
    i = table(spark, d, "inventory_files").where("path is not null").select("path", F.when(F.length("path") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.lit("/"), F.regexp_extract("path", r"^([^/\\]+)", 1)).alias("endpoint"), F.lit(0).alias("extractor_order"), F.lit(0).alias("at")).distinct()
    return contracts.first_endpoints(i).select("endpoint_id", "method", "endpoint", "path")


def response_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("operation"), (F.col("p_size") % 5 * 100 + 200).cast("string").alias("status"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("description"), F.col("p_partkey").alias("at"))
    m = contracts.merged_responses(p.withColumn("status", F.col("status").cast("int")))
    return m.select("operation", F.explode("responses").alias("status", "description"))


def routes_found(spark: SparkSession, d: str) -> DataFrame:
    """Routes that the files declare."""
    return contracts.endpoints(table(spark, d, "files").select("path", "content").distinct())


def symbols_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that parsing finds in the files, per method and kind."""
    return parsing.parse_files(table(spark, d, "files"))[0].groupBy("method", "kind").agg(F.count("*").alias("n"), F.count("docstring").alias("n_documented"))


def calls_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Calls of all files by kind, and how many are shadowed."""
    return parsing.parse_files(table(spark, d, "files"))[1].groupBy("edge_kind").agg(F.count("*").alias("n"), F.count_if("shadowed").alias("n_shadowed"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_E = "SELECT DISTINCT 's' || l_suppkey AS src, 'q' || cast(l_quantity AS INT) AS dst FROM lineitem"
_TOP = f"WITH e AS ({_E}), n AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 70)"
_CALLS = r"""s AS (SELECT fqsn, min(name) AS name, regexp_extract(fqsn, '^(.*?)::', 1) AS file_path FROM symbols WHERE fqsn IS NOT NULL AND name IS NOT NULL GROUP BY fqsn),
  o AS (SELECT *, sha256(caller || chr(0) || callee_name) AS occurrence_id FROM (SELECT file_path, fqsn AS caller, lead(name) OVER (PARTITION BY file_path ORDER BY fqsn) AS callee_name FROM s) WHERE callee_name IS NOT NULL),
  chain AS (SELECT occurrence_id, callee_name, d AS depth, array_to_string(list_slice(parts, 1, len(parts) - d), '::') AS scope FROM (SELECT occurrence_id, callee_name, parts, unnest(range(1, len(parts))) AS d
    FROM (SELECT occurrence_id, callee_name, string_split(regexp_replace(caller, '::<signature:[^>]*>$', ''), '::') AS parts FROM o))),
  decl AS (SELECT regexp_replace(regexp_replace(fqsn, '::<signature:[^>]*>$', ''), '::[^:]*$', '') AS scope, name AS callee_name, fqsn FROM s),
  best AS (SELECT occurrence_id, depth, list_sort(list_distinct(list(fqsn))) AS c FROM chain JOIN decl USING (scope, callee_name) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY occurrence_id ORDER BY depth) = 1),
  res AS (SELECT o.occurrence_id, coalesce(c, []) AS c FROM (SELECT DISTINCT occurrence_id FROM o) o LEFT JOIN best USING (occurrence_id))"""
_LABEL = "CASE WHEN len(c) = 1 THEN 'resolved' WHEN len(c) > 1 THEN 'ambiguous' ELSE 'unresolved' END"

ORACLES = {
    "generation_retention": "WITH r AS (SELECT scan_id, repo, max(created_at) AS t FROM scan_runs WHERE state = 'complete' GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY t DESC, scan_id DESC) AS n FROM r) SELECT scan_id, repo, CASE WHEN n <= 4 THEN 'complete' ELSE 'superseded' END AS state, n <= 4 AS kept FROM n",
    "active_pointer": "SELECT repo, max_by(scan_id, (created_at, scan_id)) FILTER (state = 'complete') AS active_scan_id, max_by(scan_id, (created_at, scan_id)) AS latest_attempt_id FROM scan_runs GROUP BY repo",
    "generation_counts": "SELECT scan_id, count(*) AS n_rows, count(DISTINCT fqsn) AS n_symbols FROM generation_symbols WHERE scan_id IN (SELECT scan_id FROM scan_runs WHERE state = 'complete') GROUP BY scan_id",
    "upsert_files": "SELECT repo, path, max_by(file_id, (indexed_at, file_id)) AS file_id, max_by(git_oid, (indexed_at, file_id)) AS git_oid FROM files GROUP BY repo, path",
    "batch_replace": "WITH k AS (SELECT DISTINCT file_id FROM parse_outputs WHERE lower(analysis_state) = 'complete'), s AS (SELECT DISTINCT file_id, fqsn FROM symbols) SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM k) THEN fqsn || '#2' ELSE fqsn END AS fqsn FROM s",
    "reconcile_vanished": "SELECT DISTINCT repo, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM inventory_files i WHERE i.repo = f.repo AND i.path = f.path)",
    "paging": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 200",
    "paging_byte_cap": """WITH p AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 200),
  b AS (SELECT o_orderkey, strlen('{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}') AS json_bytes FROM p),
  t AS (SELECT o_orderkey, cast(json_bytes AS INT) AS json_bytes, cast(sum(json_bytes) OVER (ORDER BY o_orderkey) AS BIGINT) AS total_bytes FROM b) SELECT * FROM t WHERE total_bytes <= 4000""",
    "catalog_digest": "WITH h AS (SELECT sha256('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}') AS h FROM orders) SELECT count(*) AS n, sha256(count(*) || ':' || " + " || ':' || ".join(f"cast(sum(cast('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)) + ") AS digest FROM h",
    "publish_edges": "SELECT s_name, p_brand, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "nearest_scope": f"WITH {_CALLS} SELECT occurrence_id, {_LABEL} AS resolution, array_to_string(c, '|') AS candidates FROM res",
    "name_unique_edges": f"WITH {_CALLS}, u AS (SELECT file_path, name AS callee_name, min(fqsn) AS callee FROM s GROUP BY 1, 2 HAVING count(DISTINCT fqsn) = 1) SELECT caller, callee, 'calls' AS edge_kind, cast(count(*) AS DOUBLE) AS weight FROM o JOIN u USING (file_path, callee_name) GROUP BY 1, 2",
    "semi_evidence": "WITH i AS (SELECT DISTINCT path, lower(content_sha256) AS h FROM inventory_files WHERE content_sha256 IS NOT NULL) SELECT repo, count(*) AS n_confirmed FROM (SELECT DISTINCT repo, path, lower(content_sha256) AS h FROM parse_outputs WHERE content_sha256 IS NOT NULL) WHERE (path, h) IN (SELECT (path, h) FROM i) GROUP BY repo",
    "relation_targets": f"WITH {_CALLS}, x AS (SELECT occurrence_id, unnest(c) AS fqsn FROM res), k AS (SELECT occurrence_id, count(*) AS n FROM x WHERE fqsn IN (SELECT fqsn FROM generation_symbols) GROUP BY 1), m AS (SELECT occurrence_id, coalesce(n, 0) AS n FROM res LEFT JOIN k USING (occurrence_id)) SELECT CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution, count(*) AS n, count(*) FILTER (n = 1) AS n_targets FROM (SELECT n FROM m) GROUP BY 1",
    "orphan_symbols": f"""WITH {_CALLS}, e AS (SELECT DISTINCT file_id FROM parse_outputs WHERE file_id IS NOT NULL), k AS (SELECT fqsn, min(lower(kind)) AS kind, min(file_id) AS file_id FROM symbols WHERE fqsn IS NOT NULL AND name IS NOT NULL GROUP BY fqsn),
  t AS (SELECT DISTINCT c[1] AS fqsn FROM res JOIN o USING (occurrence_id) JOIN k ON k.fqsn = o.caller WHERE len(c) = 1 AND k.file_id IN (FROM e))
SELECT regexp_extract(file_path, '\\.([a-z]+)$', 1) AS ext, count(*) AS n_orphans FROM s JOIN k USING (fqsn) WHERE k.kind IN ('function', 'method') AND k.file_id IN (FROM e) AND lower(name) NOT IN ('main', 'start', 'init', 'index', 'run', 'handler') AND fqsn NOT IN (SELECT fqsn FROM t) GROUP BY 1""",
    "degree_topk": f"{_TOP} SELECT node, degree FROM n",
    "pruned_graph": f"{_TOP} SELECT src, dst FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)",
    "bfs_distances": "WITH RECURSIVE e AS (SELECT n_nationkey AS src, unnest([(n_nationkey + 3) % 25, (n_nationkey + 7) % 25]) AS dst FROM nation), w(node, distance) AS (SELECT dst, 1 FROM e WHERE src = 0 UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.node WHERE w.distance < 4) SELECT node, min(distance) AS distance FROM w GROUP BY node",
    "bfs_supply": """WITH RECURSIVE i AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS p, 'o' || l_orderkey AS o FROM lineitem),
  e AS (SELECT s AS src, p AS dst FROM i UNION SELECT p, s FROM i UNION SELECT p, o FROM i UNION SELECT o, p FROM i),
  w(node, distance) AS (SELECT dst, 1 FROM e WHERE src = 's1' UNION SELECT e.dst, w.distance + 1 FROM w JOIN e ON e.src = w.node WHERE w.distance < 4)
SELECT node, min(distance) AS distance FROM w GROUP BY node""",
    "adjacency": "SELECT n_regionkey AS src, array_to_string(list_sort(list(DISTINCT n_nationkey)), ',') AS neighbours FROM nation GROUP BY n_regionkey",
    "mermaid_diagram": """WITH l AS (SELECT 0 AS part, 'R' || lpad(cast(r_regionkey AS VARCHAR), 2, '0') AS a, '' AS b, r_name AS t FROM region UNION ALL SELECT 0, 'N' || lpad(cast(n_nationkey AS VARCHAR), 2, '0'), '', n_name FROM nation
  UNION ALL SELECT 1, 'R' || lpad(cast(n_regionkey AS VARCHAR), 2, '0'), 'N' || lpad(cast(n_nationkey AS VARCHAR), 2, '0'), NULL FROM nation)
SELECT 'flowchart LR' || chr(10) || string_agg(CASE WHEN part = 0 THEN '  n_' || a || '["' || t || '"]' ELSE '  n_' || a || ' --> n_' || b END, chr(10) ORDER BY part, a, b) AS diagram FROM l""",
    "coverage_combine": "WITH p AS (SELECT repo, CASE lower(analysis_state) WHEN 'complete' THEN 'complete' WHEN 'partial' THEN 'partial' ELSE 'not_scanned' END AS state, CASE WHEN diagnostics IS NULL THEN 1 ELSE 0 END AS x FROM parse_outputs) SELECT repo, min_by(state, list_position(['partial', 'not_scanned', 'unsupported', 'complete'], state)) AS state, count(*) AS examined, cast(sum(x) AS BIGINT) AS excluded FROM p GROUP BY repo",
    "files_with_errors": "SELECT repo, count(DISTINCT file_id) AS n_files FROM (SELECT repo, file_id, unnest(diagnostics) AS x FROM parse_outputs) WHERE x.code <> 'AST_UNSUPPORTED' GROUP BY repo",
    "run_diagnostics": """SELECT x.stage AS stage, x.code AS code, count(DISTINCT scan_id) AS n_runs FROM (SELECT scan_id, unnest(from_json(diagnostics_json, '[{"stage":"VARCHAR","code":"VARCHAR","message":"VARCHAR"}]')) AS x FROM scan_runs) GROUP BY 1, 2""",
    "json_attributes": "SELECT event_type, cast(sum(cast(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS sum_k, count(json_extract_string(props, '$.k')) AS n_k FROM events GROUP BY event_type",
    "symbol_lookup": "SELECT name, count(DISTINCT fqsn) AS n, CASE count(DISTINCT fqsn) WHEN 1 THEN 'SUCCESS' ELSE 'AMBIGUOUS' END AS status FROM symbols WHERE name IS NOT NULL AND fqsn IS NOT NULL GROUP BY name",
    "project_profiles": r"""WITH p AS (SELECT repo, CASE WHEN excluded_reason IS NULL THEN lower(path) END AS p FROM inventory_files),
  s AS (SELECT repo, coalesce(bool_or(p LIKE '%.html' OR regexp_matches(p, '(^|/)index\.html?$')), false) AS html, coalesce(bool_or(p LIKE '%.css'), false) AS css, coalesce(bool_or(p LIKE '%.js'), false) AS js,
    coalesce(bool_or(regexp_matches(p, '(^|/)(vite|webpack|next|astro)\.config\.')), false) AS conf, coalesce(bool_or(regexp_matches(p, '\.(py|ts|tsx|js|jsx|rs|go|java|cs|cpp|c)$')), false) AS code,
    coalesce(bool_or(regexp_matches(p, '^(main|cli)\.(py|ts|tsx|js|jsx|rs|go)$')), false) AS main, coalesce(bool_or(contains(p, '/') AND regexp_matches(p, '(^|/)(package\.json|cargo\.toml|pyproject\.toml|go\.mod|pom\.xml|build\.gradle(\.kts)?)$')), false) AS nested FROM p GROUP BY repo),
  k AS (SELECT repo, CASE WHEN (html OR css OR conf) AND code AND main THEN 'mixed' WHEN html AND (css OR js) THEN 'static_site' WHEN main THEN 'cli' WHEN nested THEN 'workspace' ELSE 'unknown' END AS profile FROM s)
SELECT repo, profile, CASE WHEN profile = 'unknown' THEN 'unknown' ELSE 'hypothesis' END AS state FROM k""",
    "package_dependencies": "WITH p AS (SELECT DISTINCT c_mktsegment AS package FROM customer), x AS (SELECT package, unnest([lower(package), 'BUILDING', 'x' || package]) AS dep FROM p) SELECT p.package, coalesce(string_agg(DISTINCT dep, ',' ORDER BY dep) FILTER (dep IN (SELECT package FROM p)), '') AS internal FROM p LEFT JOIN x ON x.package = p.package GROUP BY p.package",
    "socket_event_merge": "WITH e AS (SELECT event_type AS event_name, CASE WHEN user_id % 2 = 0 OR event_type = 'view' THEN 'S2C' ELSE 'C2S' END AS direction, value > 50 AS typed, user_id % 7 = 0 AS ack, lpad(cast(user_id % 97 AS VARCHAR), 2, '0') AS source FROM events) SELECT event_name, CASE WHEN count(DISTINCT direction) > 1 THEN 'BIDIRECTIONAL' ELSE min(direction) END AS direction, bool_or(typed) AS is_typed, bool_or(ack) AS acknowledged, min(source) AS source_file, count(*) AS n FROM e GROUP BY event_name",
    "dead_and_undeclared": "WITH t AS (SELECT DISTINCT name FROM symbols WHERE lower(kind) = 'method' AND name IS NOT NULL), u AS (SELECT DISTINCT name FROM symbols WHERE lower(kind) = 'function' AND name IS NOT NULL) SELECT name AS event_name, 'dead' AS finding, 'high' AS confidence FROM t WHERE name NOT IN (SELECT name FROM u) UNION ALL SELECT name, 'undeclared', 'high' FROM u WHERE name NOT IN (SELECT name FROM t)",
    "model_merge": "WITH m AS (SELECT name, coalesce(line_end, 0) - coalesce(line_start, 0) AS n, lower(coalesce(kind, '')) = 'class' AS r FROM symbols WHERE name IS NOT NULL) SELECT lower(name) AS model_key, min_by(name, (CASE WHEN regexp_matches(name, '^[A-Z]') THEN 0 ELSE 1 END, name)) AS name, max(n) AS n_fields, bool_or(r) AS registered, count(*) AS n_sources FROM m GROUP BY lower(name)",
    "state_transitions": "WITH t AS (SELECT o_orderstatus AS from_state, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS to_state FROM orders) SELECT from_state, to_state, 'TRANSITION_TO_' || upper(to_state) AS event, count(*) AS n FROM t WHERE to_state IS NOT NULL GROUP BY 1, 2, 3",
    "endpoint_first_wins": r"""WITH i AS (SELECT DISTINCT path, CASE WHEN length(path) % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/' || regexp_extract(path, '^([^/\\]+)', 1) AS endpoint FROM inventory_files WHERE path IS NOT NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY method, endpoint ORDER BY path) AS n FROM i) SELECT 'endpoint:' || substr(sha256(method || chr(0) || endpoint || chr(0) || path), 1, 24) AS endpoint_id, method, endpoint, path FROM f WHERE n = 1""",
    "response_merge": "WITH p AS (SELECT p_brand AS operation, p_size % 5 * 100 + 200 AS status, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS description, row_number() OVER (PARTITION BY p_brand, p_size % 5 ORDER BY p_partkey) AS n FROM part) SELECT operation, status, coalesce(description, CASE status WHEN 200 THEN 'OK' WHEN 400 THEN 'Bad Request' WHEN 500 THEN 'Internal Server Error' ELSE 'HTTP ' || status END) AS description FROM p WHERE n = 1",
}
