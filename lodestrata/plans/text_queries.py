"""Queries of the text functions: personal data, guards, metrics, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import checksums, sanitize, text
from lodestrata.runtime import table


def pii_detect(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and documents per kind of personal data."""
    return sanitize.detect(table(spark, d, "documents"), "doc_id", "text").groupBy("label").agg(F.count("*").alias("n_matches"), F.countDistinct("doc_id").alias("n_docs"))


def pii_checksums(spark: SparkSession, d: str) -> DataFrame:
    """Validity of identity numbers made from order keys."""
    k = F.col("o_orderkey")
    num = lambda mult, n: F.lpad(((k * mult) % F.lit(10**n)).cast("string"), n, "0")
    ssn = F.concat_ws("-", F.lpad((k % 1000).cast("string"), 3, "0"), F.lpad((k % 100).cast("string"), 2, "0"), F.lpad((k % 10000).cast("string"), 4, "0"))
    o = table(spark, d, "orders")
    return o.agg(
        F.count_if(checksums.cpf_valid(num(7919, 11))).alias("cpf"), F.count_if(checksums.cnpj_valid(num(104729, 14))).alias("cnpj"), F.count_if(checksums.ssn_valid(ssn)).alias("ssn"),
        F.count_if(checksums.luhn_valid(num(15485863, 16))).alias("pan"), F.count_if(checksums.cns_valid(F.concat(F.lit("7"), num(104729, 14)))).alias("cns"),
    )


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text holds personal data, redacted, with the number of redactions."""
    docs = sanitize.redact(table(spark, d, "documents").select("doc_id", "text"), "text", "redacted")
    return docs.select("doc_id", "redacted", sanitize.redaction_count(F.col("redacted")).alias("redaction_count")).where("redaction_count > 0")


def correlation_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", sanitize.correlation_hash(F.col("c_name")).alias("hash"))


def entropy_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Distinct long tokens of signatures with their entropy and whether the entropy rule takes them for secrets."""
    tokens = table(spark, d, "symbols").select(F.explode(F.regexp_extract_all("signature_clean", F.lit(r"[A-Za-z0-9+/=_-]{20,}"), F.lit(0))).alias("token")).distinct()
    return tokens.select("token", F.round(sanitize.shannon_entropy(F.col("token")), 6).alias("entropy")).withColumn("suspicious", F.col("entropy") >= 4.5)


def prompt_guard(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("docstring_clean is not null and fqsn is not null").select("symbol_id", "fqsn", "name", "docstring_clean").distinct()
    return s.select("symbol_id", sanitize.prompt_guard(F.col("docstring_clean"), F.lit("docstring"), F.col("fqsn"), F.col("name")).alias("guarded"))


def line_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Files, lines and complexity per extension."""
    f = table(spark, d, "files").where("content is not null").select("file_id", "path", "content").dropDuplicates(["file_id"])
    return f.select(text.extension(F.col("path")).alias("ext"), text.line_count(F.col("content")).alias("l"), text.complexity(F.col("content")).alias("c")).groupBy("ext").agg(F.count("*").alias("n_files"), F.sum("l").cast("bigint").alias("n_lines"), F.sum("c").cast("bigint").alias("complexity"))


def inventory_classify(spark: SparkSession, d: str) -> DataFrame:
    """Paths per class that the classifier gives."""
    category, support = text.classify(F.col("path"))
    return table(spark, d, "inventory_files").select(category.alias("category"), support.alias("support")).groupBy("category", "support").agg(F.count("*").alias("n"))


def test_path_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "inventory_files").where(text.is_test_path(F.col("path"))).groupBy("repo").agg(F.countDistinct("path").alias("n_test_paths"))


def inventory_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    """Contents that lie under several paths."""
    i = table(spark, d, "inventory_files").where("content_sha256 is not null").select(F.lower("content_sha256").alias("sha"), "repo", "path").distinct()
    return i.groupBy("sha").agg(F.count("*").alias("n_places")).where("n_places > 1")


def stale_source(spark: SparkSession, d: str) -> DataFrame:
    """Files whose content is not the one that was parsed."""
    f = table(spark, d, "files").where("content is not null").select("file_id", F.sha2("content", 256).alias("actual")).distinct()
    p = table(spark, d, "parse_outputs").where("content_sha256 is not null").select("file_id", F.lower("content_sha256").alias("expected")).distinct()
    return f.join(p, "file_id").where("actual <> expected").select("file_id", "expected", "actual")


def trigram_index(spark: SparkSession, d: str) -> DataFrame:
    """Symbols per trigram of their names."""
    s = table(spark, d, "symbols").where("name is not null").select("symbol_id", "name").distinct()
    return s.select("symbol_id", F.explode(text.trigrams(F.col("name"))).alias("gram")).groupBy("gram").agg(F.count_distinct("symbol_id").alias("n_symbols"))


def operation_names(spark: SparkSession, d: str) -> DataFrame:
    """Operation ids, tags, routes and parameters of routes made from paths on which both dialects of SQL agree."""
    return operation_names_all(spark, d).where("path rlike '^[a-z]+/[a-z0-9_/-]+[.][a-z]+$'")


def operation_names_all(spark: SparkSession, d: str) -> DataFrame:
    """Operation ids, tags, routes and parameters of routes made from all paths of the inventories."""
    i = table(spark, d, "inventory_files").where("path is not null").select("path").distinct()
    route = F.concat(F.lit("/api/"), F.regexp_replace("path", r"[a-z]+[_-]([a-z0-9]+)", ":$1"))
    r = i.select("path", route.alias("route"))
    return r.select("path", text.operation_id(F.lit("GET"), F.col("route")).alias("operation_id"), text.tag_of(F.col("route")).alias("tag"), text.normalise_route(F.col("route")).alias("normal"), F.size(text.path_params(text.normalise_route(F.col("route")))).alias("n_params"))


def service_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles that names of services suggest, on names made from part keys."""
    names = F.array(*(F.lit(n) for n, _ in text.SERVICE_ROLES), F.lit("web"))
    parts = table(spark, d, "part").select("p_partkey", F.concat_ws("-", F.lit("App"), F.get(names, (F.col("p_partkey") % (len(text.SERVICE_ROLES) + 1)).cast("int")), F.col("p_partkey").cast("string")).alias("word"))
    return parts.select("p_partkey", text.service_role(F.col("word")).alias("role"))


def status_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select((F.col("p_size") * 10 + 190).alias("code")).distinct().select("code", text.status_text(F.col("code")).alias("description"))


QUERIES = {f.__name__: f for f in (pii_detect, pii_checksums, redact_text, correlation_hash, entropy_tokens, prompt_guard, line_metrics, inventory_classify, test_path_filter, inventory_hash_dups, stale_source, trigram_index, operation_names, operation_names_all, service_roles, status_names)}

_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_DIGIT = lambda e, i: f"cast(substr({e}, {i}, 1) AS INT)"


def _sum(e: str, weights: list[int]) -> str:
    return " + ".join(f"{_DIGIT(e, i + 1)} * {w}" for i, w in enumerate(weights))


def _mod11(e: str, weights) -> str:
    tests = [f"{_DIGIT(e, len(w) + 1)} = (CASE WHEN ({_sum(e, w)}) % 11 < 2 THEN 0 ELSE 11 - ({_sum(e, w)}) % 11 END)" for w in weights]
    alike = " AND ".join(f"substr({e}, {i}, 1) = substr({e}, 1, 1)" for i in range(2, len(weights[1]) + 2))
    return " AND ".join([*tests, f"NOT ({alike})"])


def _luhn(e: str, n: int) -> str:
    parts = []
    for i in range(n):
        digit = _DIGIT(e, n - i)
        parts.append(f"({digit} * 2) // 10 + ({digit} * 2) % 10" if i % 2 else digit)
    return f"({' + '.join(parts)}) % 10 = 0"


def _detect_sql() -> str:
    gated = {"luhn": "length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN cast(d[length(d) + 1 - i] AS INT) ELSE (cast(d[length(d) + 1 - i] AS INT) * 2) // 10 + (cast(d[length(d) + 1 - i] AS INT) * 2) % 10 END)) % 10 = 0",
             "cpf": "length(d) = 11 AND " + _mod11("rpad(d, 15, '0')", checksums.CPF_WEIGHTS), "cnpj": "length(d) = 14 AND " + _mod11("rpad(d, 15, '0')", checksums.CNPJ_WEIGHTS),
             "ssn": "substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'",
             "cns": "length(d) = 15 AND CASE WHEN d[1] IN ('7', '8', '9') THEN (" + _sum("rpad(d, 15, '0')", list(range(15, 0, -1))) + ") % 11 = 0 ELSE false END"}
    parts = []
    for r in sanitize.RULES:
        pattern = r.pattern.replace("'", "''")
        where = f" WHERE {gated[r.check]}" if r.check else ""
        parts.append(f"SELECT '{r.label}' AS label, doc_id FROM (SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m FROM documents)){where}")
    return f"SELECT label, count(*) AS n_matches, count(DISTINCT doc_id) AS n_docs FROM ({' UNION ALL '.join(parts)}) GROUP BY label"


def _number(mult: int, n: int) -> str:
    return f"lpad(cast((o_orderkey * {mult}) % {10**n} AS VARCHAR), {n}, '0')"


_KEYWORD_SUM = " + ".join(f"(length(x) - length(replace(x, '{k}', ''))) // {len(k)}" for k in text.COMPLEXITY_KEYWORDS)
_GUARDED = "replace(replace(docstring_clean, '</untrusted_code_context>', '&lt;/untrusted_code_context&gt;'), '<untrusted_code_context', '&lt;untrusted_code_context')"
for _token, _safe in sanitize.CONTROL_TOKENS.items():
    _GUARDED = f"replace({_GUARDED}, '{_token}', '{_safe}')"
_EXT = r"regexp_extract(path, '\.([^./\\]+)$', 1)"
_NAME = r"lower(regexp_extract(path, '([^/\\]*)$', 1))"
_CATEGORY = f"""CASE WHEN {_EXT} IN ({_IN(text.AST_EXTENSIONS + text.HEURISTIC_EXTENSIONS)}) THEN 'source' WHEN {_EXT} IN ({_IN(text.MARKUP)}) THEN 'markup' WHEN {_EXT} IN ({_IN(text.STYLE)}) THEN 'style'
  WHEN {_NAME} IN ({_IN(text.MANIFESTS)}) OR {_NAME} LIKE '%.lock' THEN 'manifest'
  WHEN {_NAME} IN ({_IN(text.INFRA_NAMES)}) OR {_NAME} LIKE 'dockerfile.%' OR {_EXT} IN ({_IN(text.INFRA_EXTENSIONS)}) THEN 'infra' WHEN {_EXT} IN ({_IN(text.DOCS)}) THEN 'docs' ELSE 'asset' END"""
_ROLE = "CASE " + " ".join(f"WHEN contains(word, '{p}') THEN '{r}'" for p, r in text.SERVICE_ROLES) + " ELSE 'service' END"

ORACLES = {
    "pii_detect": _detect_sql(),
    "pii_checksums": f"""SELECT count(*) FILTER ({_mod11(_number(7919, 11), checksums.CPF_WEIGHTS)}) AS cpf, count(*) FILTER ({_mod11(_number(104729, 14), checksums.CNPJ_WEIGHTS)}) AS cnpj,
  count(*) FILTER (o_orderkey % 1000 > 0 AND o_orderkey % 1000 <> 666 AND o_orderkey % 1000 < 900 AND o_orderkey % 100 > 0 AND o_orderkey % 10000 > 0) AS ssn,
  count(*) FILTER ({_luhn(_number(15485863, 16), 16)}) AS pan, count(*) FILTER (({_sum("'7' || " + _number(104729, 14), list(range(15, 0, -1))).replace("substr('7' || ", "substr('7' || ")}) % 11 = 0) AS cns FROM orders""",
    "correlation_hash": "SELECT c_custkey, substr(sha256(c_name), 1, 4) AS hash FROM customer",
    "entropy_tokens": """WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(signature_clean, '[A-Za-z0-9+/=_-]{20,}')) AS token FROM symbols),
  c AS (SELECT token, ch, count(*) AS k, any_value(length(token)) AS n FROM (SELECT token, unnest(string_split(token, '')) AS ch FROM t) GROUP BY token, ch)
SELECT token, round(-sum(k / n * log2(k / n)), 6) AS entropy, round(-sum(k / n * log2(k / n)), 6) >= 4.5 AS suspicious FROM c GROUP BY token""",
    "prompt_guard": f"""SELECT DISTINCT symbol_id, '<untrusted_code_context origin="docstring" file="' || fqsn || '" symbol="' || name || '">' || chr(10) || {_GUARDED} || chr(10) || '</untrusted_code_context>' AS guarded
FROM symbols WHERE docstring_clean IS NOT NULL AND fqsn IS NOT NULL""",
    "line_metrics": rf"""WITH f AS (SELECT DISTINCT file_id, path, content FROM files WHERE content IS NOT NULL),
  l AS (SELECT file_id, regexp_extract(path, '\.([^./\\]+)$', 1) AS ext, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - (CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END) END AS n,
    list_filter(string_split(content, chr(10)), lambda x: NOT regexp_matches(trim(replace(x, chr(13), '')), '^(//|#|/\*|\*)')) AS code FROM f),
  c AS (SELECT ext, n, least(100, greatest(1, 1 + coalesce(list_sum(list_transform(code, lambda x: {_KEYWORD_SUM})), 0))) AS k FROM l)
SELECT ext, count(*) AS n_files, cast(sum(n) AS BIGINT) AS n_lines, cast(sum(k) AS BIGINT) AS complexity FROM c GROUP BY ext""",
    "inventory_classify": f"WITH c AS (SELECT {_CATEGORY} AS category, {_EXT} AS ext FROM inventory_files) SELECT category, CASE WHEN ext IN ({_IN(text.AST_EXTENSIONS)}) THEN 'ast' WHEN category IN ('docs', 'asset') THEN 'metadata' ELSE 'heuristic' END AS support, count(*) AS n FROM c GROUP BY 1, 2",
    "test_path_filter": rf"""SELECT repo, count(DISTINCT path) AS n_test_paths FROM inventory_files
WHERE len(list_filter(list_slice(string_split(lower(path), '/'), 1, len(string_split(path, '/')) - 1), lambda p: p IN ({_IN(text.TEST_DIRECTORIES)}))) > 0
  OR regexp_matches({_NAME}, '\.(test|spec|mock|fixture)\.') OR {_NAME} LIKE 'test\_%' ESCAPE '\' OR regexp_matches({_NAME}, '(_test|test|tests)\.[a-z0-9]+$') GROUP BY repo""",
    "inventory_hash_dups": "SELECT sha, count(*) AS n_places FROM (SELECT DISTINCT lower(content_sha256) AS sha, repo, path FROM inventory_files WHERE content_sha256 IS NOT NULL) GROUP BY sha HAVING count(*) > 1",
    "stale_source": """SELECT file_id, expected, actual FROM (SELECT DISTINCT file_id, sha256(content) AS actual FROM files WHERE content IS NOT NULL)
JOIN (SELECT DISTINCT file_id, lower(content_sha256) AS expected FROM parse_outputs WHERE content_sha256 IS NOT NULL) USING (file_id) WHERE actual <> expected""",
    "trigram_index": "WITH s AS (SELECT DISTINCT symbol_id, name FROM symbols WHERE name IS NOT NULL) SELECT gram, count(DISTINCT symbol_id) AS n_symbols FROM (SELECT symbol_id, unnest(list_transform(range(1, length(name) - 1), lambda i: substr(lower(name), i, 3))) AS gram FROM s WHERE length(name) >= 3) GROUP BY gram",
    "operation_names": r"""WITH r AS (SELECT DISTINCT path, '/api/' || regexp_replace(path, '[a-z]+[_-]([a-z0-9]+)', ':\1', 'g') AS route FROM inventory_files WHERE regexp_matches(path, '^[a-z]+/[a-z0-9_/-]+[.][a-z]+$')),
  p AS (SELECT path, route, list_filter(string_split(route, '/'), lambda x: x <> '') AS parts, regexp_replace(route, ':([a-zA-Z0-9_]+)', '{\1}', 'g') AS normal FROM r),
  q AS (SELECT *, list_transform(parts, lambda x: CASE WHEN x[1] IN (':', '{') THEN 'By' || upper(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')[1]) || substr(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g'), 2)
    ELSE upper(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')[1]) || substr(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g'), 2) END) AS named, list_filter(parts, lambda x: x[1] NOT IN (':', '{')) AS fixed FROM p)
SELECT path, substr('get' || array_to_string(named, ''), 1, 120) AS operation_id,
  CASE WHEN len(fixed) = 0 THEN 'root' ELSE coalesce(list_filter(fixed, lambda x: lower(x) NOT IN ('api', 'v1', 'v2', 'v3', 'rest'))[1], fixed[1]) END AS tag, normal, cast(len(list_distinct(regexp_extract_all(normal, '\{(\w+)\}', 1))) AS INT) AS n_params FROM q""",
    "service_roles": f"WITH w AS (SELECT p_partkey, lower('App-' || [{_IN([n for n, _ in text.SERVICE_ROLES] + ['web'])}][p_partkey % {len(text.SERVICE_ROLES) + 1} + 1] || '-' || p_partkey) AS word FROM part) SELECT p_partkey, {_ROLE} AS role FROM w",
    "status_names": "WITH c AS (SELECT DISTINCT p_size * 10 + 190 AS code FROM part) SELECT code, CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in text.STATUS_TEXT.items()) + " ELSE 'HTTP ' || code END AS description FROM c",
}
