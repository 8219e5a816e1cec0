"""Scalar functions on source text, names, routes and paths as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What raises the complexity of a function.
COMPLEXITY_KEYWORDS = ("if ", "if(", "elif ", "elif(", "else if", "while ", "while(", "for ", "for(", "case ", "catch ", "catch(", "except ", "except:", "&&", "||", " ? ")
#: File classes, first match wins.
AST_EXTENSIONS = ["rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "java", "c", "h", "cpp", "cc"]
HEURISTIC_EXTENSIONS = ["pyi", "cxx", "hpp", "cs", "php", "rb", "sql", "kt", "kts", "swift", "r", "R", "f", "f90", "f95", "pas", "dpr", "m", "s", "asm", "pl", "pm", "vb", "sh", "bash", "prisma"]
MARKUP, STYLE, DOCS = ["html", "htm", "vue", "svelte"], ["css", "scss", "sass", "less"], ["md", "mdx", "rst", "txt"]
MANIFESTS = ["package.json", "cargo.toml", "go.mod", "pyproject.toml", "requirements.txt", "pom.xml", "composer.json", "gemfile", "pnpm-workspace.yaml", "lerna.json"]
INFRA_NAMES, INFRA_EXTENSIONS = ["dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml", "makefile"], ["yaml", "yml", "toml", "ini", "container", "kube", "pod", "nomad"]
#: Directories of tests.
TEST_DIRECTORIES = ["tests", "__tests__", "test", "testing", "fixtures", "__fixtures__", "mocks", "__mocks__", "e2e", "spec", "specs"]
#: Descriptions of status codes.
STATUS_TEXT = {200: "OK", 201: "Created", 202: "Accepted", 204: "No Content", 301: "Moved Permanently", 302: "Found", 304: "Not Modified", 400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 409: "Conflict", 422: "Unprocessable Entity", 429: "Too Many Requests", 500: "Internal Server Error", 503: "Service Unavailable"}


def line_count(content: Column) -> Column:
    """Lines without a phantom last one; 0 for the empty text."""
    return F.when(content == "", 0).otherwise(F.size(F.split(content, "\n")) - F.when(content.endswith("\n"), 1).otherwise(0))


def complexity(content: Column) -> Column:
    """1 and the keywords on lines that are no comments, from 1 to 100."""
    lines = F.filter(F.split(content, "\n"), lambda x: ~F.trim(F.replace(x, F.lit("\r"), F.lit(""))).rlike(r"^(?://|#|/\*|\*)"))
    count = lambda x: reduce(lambda a, b: a + b, (((F.length(x) - F.length(F.replace(x, F.lit(k), F.lit("")))) / len(k)).cast("int") for k in COMPLEXITY_KEYWORDS))
    return F.least(F.lit(100), F.greatest(F.lit(1), 1 + F.aggregate(lines, F.lit(0), lambda a, x: a + count(x))))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def classify(path: Column) -> tuple[Column, Column]:
    """(category, support) of a path."""
    ext, name = extension(path), F.lower(file_name(path))
    infra = name.isin(INFRA_NAMES) | name.startswith("dockerfile.") | ext.isin(INFRA_EXTENSIONS)
    category = (
        F.when(ext.isin(AST_EXTENSIONS + HEURISTIC_EXTENSIONS), "source").when(ext.isin(MARKUP), "markup").when(ext.isin(STYLE), "style")
        .when(name.isin(MANIFESTS) | name.endswith(".lock"), "manifest").when(infra, "infra").when(ext.isin(DOCS), "docs").otherwise("asset")
    )
    support = F.when(ext.isin(AST_EXTENSIONS), "ast").when(category.isin("docs", "asset"), "metadata").otherwise("heuristic")
    return category, support


def is_test_path(path: Column) -> Column:
    """A parent directory of tests, or a file name that says so."""
    parts = F.split(F.lower(path), "/")
    parents = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.lower(file_name(path))
    return F.exists(parents, lambda p: p.isin(TEST_DIRECTORIES)) | name.rlike(r"\.(?:test|spec|mock|fixture)\.") | name.startswith("test_") | name.rlike(r"(?:_test|test|tests)\.[a-z0-9]+$")


def normalise_route(route: Column) -> Column:
    """:name as {name}; / for the empty route."""
    r = F.regexp_replace(route, r":([a-zA-Z0-9_]+)", "{$1}")
    return F.when(r == "", "/").otherwise(r)


def join_route(prefix: Column, route: Column) -> Column:
    """A mount prefix and a route under it."""
    p = F.regexp_replace(prefix, r"/+$", "")
    r = F.when(route.startswith("/"), route).otherwise(F.concat(F.lit("/"), route))
    return F.when(p == "", r).when((r == "/") | (p == r), p).otherwise(F.concat(p, r))


def path_params(route: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(route, F.lit(r"\{(\w+)\}"), F.lit(1)))


def pascal(text: Column) -> Column:
    words = F.filter(F.split(text, r"[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), "")


def operation_id(method: Column, route: Column) -> Column:
    """Method and capitalised path parts, parameters as By..., at most 120 characters."""
    parts = F.filter(F.split(route, "/"), lambda p: p != "")
    capital = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1_000_000))
    plain = lambda p: F.regexp_replace(p, r"[^a-zA-Z0-9]", "")
    named = F.transform(parts, lambda p: capital(F.when(p.rlike(r"^[:{]"), F.concat(F.lit("By"), capital(plain(p)))).otherwise(plain(p))))
    return F.substring(F.concat(F.lower(method), F.array_join(named, "")), 1, 120)


def tag_of(route: Column) -> Column:
    """First path part that is no prefix, version or parameter; root if there is none at all."""
    parts = F.filter(F.split(route, "/"), lambda p: (p != "") & ~p.rlike(r"^[:{]"))
    telling = F.filter(parts, lambda p: ~F.lower(p).isin("api", "v1", "v2", "v3", "rest"))
    return F.when(F.size(parts) == 0, "root").otherwise(F.coalesce(F.get(telling, 0), F.get(parts, 0)))


#: Types that names of parameters suggest, by equality or ending, first match wins.
PARAM_TYPES = {
    "id": "string", "string": "string", "str": "string", "text": "string", "email": "string", "uuid": "string", "date": "string", "datetime": "string", "password": "string", "token": "string",
    "name": "string", "slug": "string", "query": "string", "search": "string", "sort": "string", "filter": "string", "page": "integer", "limit": "integer", "offset": "integer", "count": "integer",
    "int": "integer", "integer": "integer", "float": "number", "double": "number", "number": "number", "num": "number", "price": "number", "amount": "number", "score": "number",
    "boolean": "boolean", "bool": "boolean", "is": "boolean", "has": "boolean", "enabled": "boolean",
}


def param_type(name: Column) -> Column:
    low = F.lower(name)
    out = None
    for key, kind in PARAM_TYPES.items():
        out = F.when(low.endswith(key), kind) if out is None else out.when(low.endswith(key), kind)
    return out.when(name.rlike(r"^(?:is|has|should|can)[A-Z_]"), "boolean").otherwise("string")


def status_text(code: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in STATUS_TEXT.items() for x in kv))
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit("HTTP "), code.cast("string")))


def escape_html(text: Column) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), text)


def safe_uri(uri: Column) -> Column:
    return F.when(F.trim(F.lower(uri)).rlike(r"^(?:javascript|data|vbscript):"), "#blocked").otherwise(uri)


def node_id(text: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(text, r"[^A-Za-z0-9]", "_"))


def trigrams(text: Column) -> Column:
    low = F.lower(text)
    n = F.length(text)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3)))))


def iso_millis(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def json_block(text: Column) -> Column:
    """JSON inside chatty text: a fenced block, else from the first brace to the last."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    return F.when(fenced != "", F.trim(fenced)).otherwise(F.regexp_extract(text, r"(\{[\s\S]*\})", 1))


#: Technologies by part of a name, first match wins.
SERVICE_ROLES = (("mongo", "database"), ("valkey", "cache"), ("redis", "cache"), ("postgres", "database"), ("pgsql", "database"), ("mysql", "database"), ("mariadb", "database"), ("rabbit", "queue"), ("kafka", "queue"), ("nats", "queue"), ("nginx", "gateway"), ("caddy", "gateway"), ("traefik", "gateway"), ("envoy", "gateway"), ("livekit", "sfu"), ("mediasoup", "sfu"), ("sfu", "sfu"))


def service_role(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(low.isNull(), "service")
    for part, role in SERVICE_ROLES:
        out = out.when(low.contains(part), role)
    return out.otherwise("service")


def scope_of(fqsn: Column) -> Column:
    """The enclosing scope of a qualified name."""
    return F.regexp_replace(F.regexp_replace(fqsn, r"::<signature:[^>]*>$", ""), r"::[^:]*$", "")
