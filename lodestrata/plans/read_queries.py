"""Queries of reads, parsing and contracts, also on small sources made from the tables, for which SQL knows the outcome.

The literals of the oracles are written out here; they are not those of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import sanitize, text
from lodestrata.operators import contracts, events, generations, parsing, reads, report, resolve
from lodestrata.operators.models import field_type
from lodestrata.runtime import table
from lodestrata.sources import inventory


def parse_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Rows of inventories that are to be parsed, per repository."""
    return inventory.parse_candidates(table(spark, d, "inventory_files")).groupBy("repo").agg(F.count("*").alias("n"))


def readable_files(spark: SparkSession, d: str) -> DataFrame:
    """Readable source and infrastructure files of two languages, per category."""
    return inventory.readable(table(spark, d, "inventory_files"), ("source", "infra"), ("py", "ts")).groupBy("category").agg(F.count("*").alias("n"))


def snapshot_files(spark: SparkSession, d: str) -> DataFrame:
    """Inventory rows as the interface gives them, counted by their normalised classes."""
    return generations.outside(table(spark, d, "inventory_files"), "files").groupBy("category", "support").agg(F.count("*").alias("n"), F.count("contentSha256").alias("n_hashed"))


def code_components(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most complex symbols of the applications."""
    return reads.components(table(spark, d, "symbols"), table(spark, d, "files"))


def component_graph(spark: SparkSession, d: str) -> DataFrame:
    """Relations between the components that lie in one file."""
    c = reads.components(table(spark, d, "symbols"), table(spark, d, "files"), 400)
    s = table(spark, d, "symbols").where("fqsn is not null").select("file_id", "fqsn").distinct()
    r = s.withColumnRenamed("fqsn", "src").join(s.groupBy("file_id").agg(F.max("fqsn").alias("dst")), "file_id").select("src", "dst", F.lit("same_file").alias("kind"))
    return reads.component_graph(c, r)


def symbol_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Lookups of every twentieth symbol by its name, and by its full name within its file."""
    of = table(spark, d, "files").groupBy("file_id").agg(F.min("path").alias("path"))
    s = table(spark, d, "symbols").join(of, "file_id").select("symbol_id", "fqsn", "name", "path")
    w = s.where("symbol_id % 20 = 0 and name is not null and fqsn is not null").select("symbol_id", "fqsn", "name", "path").distinct()
    wanted = w.select(F.concat(F.lit("n"), F.col("symbol_id").cast("string")).alias("lookup_id"), F.col("name").alias("key"), F.lit(None).cast("string").alias("in_path")).unionByName(
        w.select(F.concat(F.lit("f"), F.col("symbol_id").cast("string")).alias("lookup_id"), F.col("fqsn").alias("key"), F.col("path").alias("in_path"))
    )
    return reads.lookup(s, wanted)


def publish_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with the path of their file, per repository."""
    return reads.published_symbols(table(spark, d, "symbols"), table(spark, d, "files")).groupBy("repo").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("n_paths"))


def publish_symbol_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges from every symbol to the one with the next number, translated to names, per kind."""
    s = table(spark, d, "symbols")
    e = s.select(F.col("symbol_id").alias("caller_id"), (F.col("symbol_id") + 1).alias("callee_id"), F.lit("calls").alias("edge_kind"), F.lit(1.0).alias("weight"))
    return reads.published_edges(e, s).groupBy("edge_kind").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def repo_languages(spark: SparkSession, d: str) -> DataFrame:
    return reads.languages(table(spark, d, "files")).select("repo", F.array_join("languages", ",").alias("languages"))


def scan_totals(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").where("content is not null").select("repo", "file_id", text.line_count(F.col("content")).alias("n_lines"))
    return reads.scan_totals(f, table(spark, d, "symbols"))


def run_states(spark: SparkSession, d: str) -> DataFrame:
    """State of each run by the diagnostics of its JSON and the rows of its inventory."""
    kind = "array<struct<stage:string,code:string,message:string>>"
    runs = table(spark, d, "scan_runs").select("scan_id", "diagnostics_json").distinct()
    done = table(spark, d, "inventory_files").groupBy("scan_id").agg(F.count("*").alias("n"))
    diagnostics = runs.select("scan_id", F.explode(F.from_json("diagnostics_json", kind)).alias("x")).select("scan_id", "x.code", F.lit(None).cast("string").alias("path"))
    return reads.run_states(runs.select("scan_id").distinct().join(done, "scan_id", "left"), diagnostics, "scan_id")


def diagnostics_merged(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics of parsers, one per repository, code and path, counted by code."""
    p = table(spark, d, "parse_outputs").select("repo", "path", F.struct("parsed_at", "file_id").alias("at"), F.explode("diagnostics").alias("x")).select("repo", "path", "at", "x.code", "x.message")
    return report.merged_diagnostics(p, "repo").groupBy("repo", "code").agg(F.count("*").alias("n"))


def _sources(spark: SparkSession, d: str, path: str, content: str) -> DataFrame:
    """A source file per supplier; {k} is its number."""
    filled = lambda t: F.replace(F.lit(t), F.lit("{k}"), F.col("s_suppkey").cast("string"))
    return table(spark, d, "supplier").select(filled(path).alias("path"), filled(content).alias("content"))


def routes_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Routes of small sources: a guarded one, and one under the prefix that another file mounts."""
    app = _sources(spark, d, "s{k}/app.js", "const orders = require('./orders');\napp.use('/api/{k}', orders);\napp.get('/health/{k}', open);\n")
    own = _sources(spark, d, "s{k}/orders.js", "router.post('/orders/:id', requireAuth, create);\n// router.get is not a route here\n")
    return contracts.endpoints(app.unionByName(own)).select("method", "endpoint", "source_file", "auth")


def events_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Events of small sources: declared, sent and heard, merged by name."""
    server = _sources(spark, d, "server/s{k}.ts", "interface ServerToClientEvents { 'sold:{k}': (n: number, callback: Ack) => void; 'idle:{k}': () => void }\nio.to('r').emit('sold:{k}', 1); socket.on('buy:{k}', f); socket.on('disconnect', f);")
    client = _sources(spark, d, "client/s{k}.ts", "socket.on('sold:{k}', show); socket.emit('buy:{k}');")
    return contracts.merged_events(events.socket_events(server.unionByName(client)))


def honesty_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Findings about those sources, counted."""
    server = _sources(spark, d, "server/s{k}.ts", "interface ServerToClientEvents { 'sold:{k}': (n: number) => void; 'idle:{k}': () => void; connection: () => void }\nio.emit('sold:{k}', 1); socket.on('buy:{k}', f);")
    e = events.socket_events(server).withColumnRenamed("source", "source_file")
    s = table(spark, d, "supplier")
    key = F.col("s_suppkey").cast("string")
    facts = s.select(F.concat(F.lit("f"), key).alias("fact_id"), F.when(F.col("s_suppkey") % 2 == 0, "function").otherwise("class").alias("kind"), F.when(F.col("s_suppkey") % 10 == 0, "Main").otherwise(key).alias("name"), F.lit("p").alias("path"), F.array(key).alias("evidence_ids"))
    evidence = s.where("s_suppkey % 6 <> 0").select(key.alias("evidence_id"))
    relations = s.where("s_suppkey % 8 = 0").select(F.concat(F.lit("r"), key).alias("relation_id"), F.concat(F.lit("f"), key).alias("to_id"), F.lit("resolved").alias("resolution"), F.array(key).alias("evidence_ids"))
    return report.honesty_summary(report.honesty_report(e.where("typed"), e.where("not typed"), facts, relations, evidence))


def symbols_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and resolved calls that parsing finds in small sources of four languages."""
    files = _sources(spark, d, "s{k}.ts", "export class A{k} { run(x: number) { return this.go(help{k}(x)); } }\nfunction help{k}(y: number) { return y; }\n")
    files = files.unionByName(_sources(spark, d, "s{k}.rs", "pub fn a{k}(x: u8) -> u8 { b{k}(x) }\nfn b{k}(y: u8) -> u8 { y }\n"))
    files = files.unionByName(_sources(spark, d, "s{k}.go", "package a\n\nfunc A{k}(x int) int {\n\treturn b{k}(x)\n}\n\nfunc b{k}(y int) int {\n\treturn y\n}\n"))
    files = files.unionByName(_sources(spark, d, "s{k}.py", "def a{k}(x):\n    return b{k}(x)\n\n\ndef b{k}(y):\n    return y\n"))
    symbols, calls, _ = parsing.parse_files(files)
    found = resolve.nearest_scope(parsing.occurrences_of(calls), symbols).where("resolution = 'resolved'").select(F.get("candidates", F.lit(0)).alias("fqsn")).groupBy("fqsn").agg(F.count("*").alias("n_callers"))
    return symbols.join(found, "fqsn", "left").select("fqsn", "kind", "visibility", "line_start", "line_end", F.coalesce("n_callers", F.lit(0)).alias("n_callers"))


def call_graph(spark: SparkSession, d: str) -> DataFrame:
    """Calls of all files by kind and how their names resolve in the nearest scope, per extension."""
    symbols, calls, _ = parsing.parse_files(table(spark, d, "files"))
    o = parsing.occurrences_of(calls)
    ext = F.lower(text.extension(F.col("file_path")))
    return resolve.nearest_scope(o, symbols).join(o.select("occurrence_id", "edge_kind", ext.alias("ext")).distinct(), "occurrence_id").groupBy("ext", "edge_kind", "resolution").agg(F.count("*").alias("n"))


def redactions_of_customers(spark: SparkSession, d: str) -> DataFrame:
    """Redactions in texts made from customers: an address, a number that may be valid, a key and a password."""
    k = F.col("c_custkey")
    ssn = F.concat_ws("-", F.lpad((k % 1000).cast("string"), 3, "0"), F.lpad((k % 100).cast("string"), 2, "0"), F.lpad((k % 10000).cast("string"), 4, "0"))
    t = F.concat(F.lit("Mail c"), k.cast("string"), F.lit("@mail.example; ssn "), ssn, F.lit(" key AKIA"), F.lpad(k.cast("string"), 16, "7"), F.lit(" at postgres://svc:p@ss"), k.cast("string"), F.lit("@db.internal/x"))
    c = sanitize.redact(table(spark, d, "customer").select("c_custkey", t.alias("t")), "t", "redacted")
    clean = ~F.col("redacted").contains("p@ss") & ~F.col("redacted").contains("AKIA") & ~F.col("redacted").contains("@mail")
    return c.select("c_custkey", sanitize.redaction_count(F.col("redacted")).alias("n"), clean.alias("clean"))


def pii_of_customers(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of personal data in texts made from customers."""
    k = F.col("c_custkey")
    card = F.lpad((k * 15485863 % F.lit(10**16)).cast("string"), 16, "4")
    t = F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.example, card "), card, F.lit(", host 10.1."), (k % 256).cast("string"), F.lit(".7, mac 0a:1b:2c:3d:4e:5f"))
    return sanitize.detect(table(spark, d, "customer").select("c_custkey", t.alias("t")), "c_custkey", "t").groupBy("label").agg(F.count("*").alias("n"))


def field_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of an interface for types as languages declare them, one a part."""
    names = F.array(*(F.lit(t) for t in ("string", "z.number()", "int64", "float64", "Double", "bool", "z.date()", "UUID", "z.string().email()", "Array<Order>", "Order", "z.enum(['a'])", "whatever")))
    kind, shape = field_type(F.col("declared"))
    return table(spark, d, "part").select(F.get(names, (F.col("p_partkey") % 13).cast("int")).alias("declared")).select("declared", kind.alias("type"), shape.alias("format")).groupBy("declared", "type", "format").agg(F.count("*").alias("n"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

_EXT = r"regexp_extract(path, '\.([^./\\]+)$', 1)"
_COMPONENTS = r"""f AS (SELECT file_id, min(path) AS path FROM files WHERE path IS NOT NULL AND lower(path) NOT LIKE '%test%' AND lower(path) NOT LIKE '%spec%' AND lower(path) NOT LIKE '%mock%' AND lower(path) NOT LIKE '%fixture%'
    AND lower(path) NOT LIKE '%.sh' AND lower(path) NOT LIKE '%.bash' AND lower(path) NOT LIKE '%.zsh' AND lower(path) NOT LIKE '%scripts/%' AND lower(path) NOT LIKE '%migrations/%' AND lower(path) NOT LIKE '%backup%'
    AND NOT regexp_matches(lower(path), '(^|/)e2e/') GROUP BY file_id),
  o AS (SELECT file_id, fqsn, name, lower(kind) AS kind, coalesce(cyclomatic_complexity, 0) AS complexity, coalesce(line_end - line_start, 0) AS span,
    row_number() OVER (PARTITION BY file_id, fqsn ORDER BY coalesce(cyclomatic_complexity, 0) DESC, coalesce(line_end - line_start, 0) DESC, lower(kind) DESC, name DESC) AS n FROM symbols WHERE lower(kind) IN ('class', 'interface', 'struct', 'function') AND fqsn IS NOT NULL)"""
_K = "cast(s_suppkey AS VARCHAR)"

ORACLES = {
    "parse_candidates": "SELECT repo, count(*) AS n FROM inventory_files WHERE category = 'source' AND content_sha256 IS NOT NULL AND read_error IS NULL GROUP BY repo",
    "readable_files": rf"SELECT category, count(*) AS n FROM inventory_files WHERE category IN ('source', 'infra') AND {_EXT} IN ('py', 'ts') AND content_sha256 IS NOT NULL AND excluded_reason IS NULL AND read_error IS NULL GROUP BY category",
    "snapshot_files": """SELECT CASE WHEN lower(category) IN ('source', 'markup', 'style', 'manifest', 'infra', 'docs', 'asset') THEN lower(category) ELSE 'asset' END AS category,
  CASE WHEN lower(support) IN ('ast', 'heuristic', 'metadata') THEN lower(support) ELSE 'metadata' END AS support, count(*) AS n, count(content_sha256) AS n_hashed FROM inventory_files GROUP BY 1, 2""",
    "code_components": f"WITH {_COMPONENTS} SELECT fqsn, name, kind, path, complexity, span FROM o JOIN f USING (file_id) WHERE n = 1 ORDER BY complexity DESC, span DESC, fqsn LIMIT 50",
    "component_graph": f"""WITH {_COMPONENTS}, c AS (SELECT fqsn FROM o JOIN f USING (file_id) WHERE n = 1 ORDER BY complexity DESC, span DESC, fqsn LIMIT 400),
  r AS (SELECT s.fqsn AS src, m.dst FROM symbols s JOIN (SELECT file_id, max(fqsn) AS dst FROM symbols GROUP BY file_id) m USING (file_id)) SELECT DISTINCT src, dst, 'same_file' AS kind FROM r WHERE src IN (FROM c) AND dst IN (FROM c)""",
    "symbol_lookups": """WITH f AS (SELECT file_id, min(path) AS path FROM files GROUP BY file_id), s AS (SELECT DISTINCT symbol_id, fqsn, name, path FROM symbols JOIN f USING (file_id)),
  w AS (SELECT DISTINCT 'n' || symbol_id AS lookup_id, name AS key, NULL AS in_path FROM s WHERE symbol_id % 20 = 0 AND name IS NOT NULL AND fqsn IS NOT NULL UNION ALL SELECT DISTINCT 'f' || symbol_id, fqsn, path FROM s WHERE symbol_id % 20 = 0 AND name IS NOT NULL AND fqsn IS NOT NULL),
  h AS (SELECT lookup_id, count(DISTINCT s.fqsn) AS n, min(s.fqsn) AS fqsn FROM w JOIN s ON (s.fqsn = w.key OR s.name = w.key) AND (w.in_path IS NULL OR w.in_path = s.path) GROUP BY lookup_id)
SELECT lookup_id, n, CASE WHEN n = 1 THEN 'SUCCESS' ELSE 'AMBIGUOUS' END AS status, CASE WHEN n = 1 THEN fqsn END AS fqsn FROM h""",
    "publish_symbols": "WITH f AS (SELECT DISTINCT file_id, repo, path FROM files WHERE file_id IS NOT NULL) SELECT repo, count(*) AS n, count(DISTINCT path) AS n_paths FROM symbols JOIN f USING (file_id) GROUP BY repo",
    "publish_symbol_edges": "WITH n AS (SELECT symbol_id, min(fqsn) AS fqsn FROM symbols WHERE fqsn IS NOT NULL GROUP BY symbol_id), e AS (SELECT a.fqsn AS a, b.fqsn AS b, count(*) AS w FROM symbols s JOIN n a ON a.symbol_id = s.symbol_id JOIN n b ON b.symbol_id = s.symbol_id + 1 GROUP BY 1, 2) SELECT 'calls' AS edge_kind, count(*) AS n, cast(sum(w) AS DOUBLE) AS weight FROM e",
    "repo_languages": rf"SELECT repo, coalesce(string_agg(DISTINCT lower({_EXT}), ',' ORDER BY lower({_EXT})) FILTER ({_EXT} <> ''), '') AS languages FROM files GROUP BY repo",
    "scan_totals": """WITH f AS (SELECT repo, file_id, max(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - (CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END) END) AS n_lines FROM files WHERE content IS NOT NULL GROUP BY 1, 2),
  s AS (SELECT file_id, count(*) AS k FROM (SELECT DISTINCT file_id, fqsn FROM symbols) GROUP BY 1) SELECT repo, count(*) AS n_files, cast(sum(n_lines) AS BIGINT) AS n_lines, cast(coalesce(sum(k), 0) AS BIGINT) AS n_symbols FROM f LEFT JOIN s USING (file_id) GROUP BY repo""",
    "run_states": """WITH r AS (SELECT DISTINCT scan_id, diagnostics_json FROM scan_runs), d AS (SELECT scan_id, bool_or(x.code <> 'AST_UNSUPPORTED') AS b, count(*) AS k FROM (SELECT scan_id, unnest(from_json(diagnostics_json, '[{"code":"VARCHAR"}]')) AS x FROM r) GROUP BY 1),
  i AS (SELECT scan_id, count(*) AS n FROM inventory_files GROUP BY 1), s AS (SELECT scan_id, CASE WHEN NOT coalesce(b, false) THEN 'complete' WHEN coalesce(n, 0) = 0 THEN 'failed' ELSE 'partial' END AS analysis_state, coalesce(k, 0) AS k FROM (SELECT DISTINCT scan_id FROM r) LEFT JOIN d USING (scan_id) LEFT JOIN i USING (scan_id))
SELECT scan_id, analysis_state, CASE WHEN k > 0 OR analysis_state <> 'complete' THEN 'partial' ELSE 'complete' END AS coverage_state, 0 AS files_with_errors FROM s""",
    "diagnostics_merged": "SELECT repo, code, count(*) AS n FROM (SELECT DISTINCT repo, path, x.code AS code FROM (SELECT repo, path, unnest(diagnostics) AS x FROM parse_outputs)) GROUP BY 1, 2",
    "routes_of_suppliers": f"SELECT 'GET' AS method, '/health/' || {_K} AS endpoint, 's' || {_K} || '/app.js' AS source_file, 'None' AS auth FROM supplier UNION ALL SELECT 'POST', '/api/' || {_K} || '/orders/:id', 's' || {_K} || '/orders.js', 'Bearer / Session' FROM supplier",
    "events_of_suppliers": f"""SELECT 'sold:' || {_K} AS event_name, 'SERVER_TO_CLIENT' AS direction, true AS is_typed, true AS acknowledged, 'client/s' || {_K} || '.ts' AS source_file, 3 AS n FROM supplier
UNION ALL SELECT 'idle:' || {_K}, 'SERVER_TO_CLIENT', true, false, 'server/s' || {_K} || '.ts', 1 FROM supplier UNION ALL SELECT 'buy:' || {_K}, 'CLIENT_TO_SERVER', false, false, 'client/s' || {_K} || '.ts', 2 FROM supplier""",
    "honesty_of_suppliers": """WITH c AS (SELECT count(*) AS s, count(*) FILTER (s_suppkey % 2 = 0 AND s_suppkey % 10 <> 0 AND s_suppkey % 6 <> 0 AND s_suppkey % 8 <> 0) AS o FROM supplier)
SELECT 'DEAD_DECLARED_EVENT' AS type, s AS n FROM c UNION ALL SELECT 'UNDECLARED_EVENT', s FROM c UNION ALL SELECT 'ORPHAN_SYMBOL', o FROM c UNION ALL SELECT 'CANDIDATES', s + s + o FROM c""",
    "symbols_of_suppliers": f"""SELECT 's' || {_K} || '.ts::A' || {_K} AS fqsn, 'class' AS kind, 'public' AS visibility, 1 AS line_start, 1 AS line_end, 0 AS n_callers FROM supplier UNION ALL SELECT 's' || {_K} || '.ts::A' || {_K} || '::run', 'method', 'public', 1, 1, 0 FROM supplier
UNION ALL SELECT 's' || {_K} || '.ts::help' || {_K}, 'function', 'public', 2, 2, 1 FROM supplier UNION ALL SELECT 's' || {_K} || '.rs::a' || {_K}, 'function', 'public', 1, 1, 0 FROM supplier UNION ALL SELECT 's' || {_K} || '.rs::b' || {_K}, 'function', 'private', 2, 2, 1 FROM supplier
UNION ALL SELECT 's' || {_K} || '.go::A' || {_K}, 'function', 'public', 3, 5, 0 FROM supplier UNION ALL SELECT 's' || {_K} || '.go::b' || {_K}, 'function', 'private', 7, 9, 1 FROM supplier UNION ALL SELECT 's' || {_K} || '.py::a' || {_K}, 'function', 'public', 1, 2, 0 FROM supplier UNION ALL SELECT 's' || {_K} || '.py::b' || {_K}, 'function', 'public', 5, 6, 1 FROM supplier""",
    "redactions_of_customers": "SELECT c_custkey, 3 + (CASE WHEN c_custkey % 1000 > 0 AND c_custkey % 1000 <> 666 AND c_custkey % 1000 < 900 AND c_custkey % 100 > 0 AND c_custkey % 10000 > 0 THEN 1 ELSE 0 END) AS n, true AS clean FROM customer",
    "pii_of_customers": """WITH c AS (SELECT lpad(cast(c_custkey * 15485863 % 10000000000000000 AS VARCHAR), 16, '4') AS card FROM customer),
  v AS (SELECT list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN cast(card[i] AS INT) ELSE (cast(card[i] AS INT) * 2) // 10 + (cast(card[i] AS INT) * 2) % 10 END)) % 10 = 0 AS ok FROM c)
SELECT label, n FROM (SELECT 'EMAIL' AS label, count(*) AS n FROM customer UNION ALL SELECT 'IP_ADDR', count(*) FROM customer UNION ALL SELECT 'MAC_ADDR', count(*) FROM customer UNION ALL SELECT 'CREDIT_CARD', count(*) FROM v WHERE ok) WHERE n > 0""",
    "field_types": """WITH t AS (SELECT * FROM (VALUES (0, 'string', 'string', NULL), (1, 'z.number()', 'number', NULL), (2, 'int64', 'integer', NULL), (3, 'float64', 'integer', NULL), (4, 'Double', 'number', NULL), (5, 'bool', 'boolean', NULL), (6, 'z.date()', 'string', 'date-time'), (7, 'UUID', 'string', 'uuid'),
  (8, 'z.string().email()', 'string', 'email'), (9, 'Array<Order>', 'array', NULL), (10, 'Order', 'object', NULL), (11, 'z.enum([''a''])', 'string', NULL), (12, 'whatever', 'string', NULL)) AS t(k, declared, type, format))
SELECT declared, type, format, count(*) AS n FROM part JOIN t ON p_partkey % 13 = k GROUP BY 1, 2, 3""",
}
