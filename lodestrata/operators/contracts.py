"""Interfaces that source text declares: routes, mounts, operations, socket events, data models, state machines."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import STATUS_TEXT, extension, join_route, normalise_route, operation_id, param_type, path_params, status_text, tag_of
from lodestrata.runtime import materialize

#: How frameworks declare a route: name, extensions, pattern, group of the method, group of the route, words that show authentication.
ROUTES = (
    ("express", ("js", "jsx", "ts", "tsx", "mjs", "cjs"), r"(?i)(?:router|app|fastify|server)\.(get|post|put|delete|patch|options|head)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, 2, r"(?i)auth|token|jwt|session|protect|guard|requireUser|adminOnly"),
    ("route_chain", ("js", "jsx", "ts", "tsx", "mjs", "cjs"), r"(?i)router\.route\s*\(\s*['\"`]([^'\"`]+)['\"`]\s*\)\s*\.(get|post|put|delete|patch)", 2, 1, r"(?i)auth|token|jwt|session|guard"),
    ("nest", ("ts", "js"), r"@(Get|Post|Put|Delete|Patch)\s*\(\s*(?:['\"`]([^'\"`]*)['\"`])?\s*\)", 1, 2, r"(?i)@UseGuards|AuthGuard"),
    ("python", ("py",), r"(?i)@(?:app|router|api)\.(get|post|put|delete|patch|options)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, 2, r"(?i)Depends\(|Security\(|auth|token"),
    ("go", ("go",), r"\.(GET|POST|PUT|DELETE|PATCH|Handle|HandleFunc)\s*\(\s*[\"']([^\"']+)[\"']", 1, 2, r"(?i)Auth|Token|JWT|Session"),
    ("rust_attribute", ("rs",), r"(?i)#\[(get|post|put|delete|patch)\s*\(\s*[\"']([^\"']+)[\"']", 1, 2, r"(?i)Auth|Token|Claims|guard"),
    ("axum", ("rs",), r"(?i)\.route\s*\(\s*[\"']([^\"']+)[\"']\s*,\s*(get|post|put|delete|patch)\s*\(", 2, 1, r"(?i)Auth|Token|Claims"),
    ("spring", ("java", "kt"), r"(?i)@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?['\"`]([^'\"`]+)['\"`]", 1, 2, r"(?i)@PreAuthorize|@Secured|Security"),
    ("dotnet", ("cs",), r"(?i)\[Http(Get|Post|Put|Delete|Patch)\s*(?:\(\s*[\"']([^\"']+)[\"']\s*\))?\]", 1, 2, r"(?i)\[Authorize\]"),
    ("laravel", ("php",), r"(?i)Route::(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]+)['\"`]", 1, 2, r"(?i)middleware\(['\"]auth"),
    ("rails_match", ("rb",), r"(?i)\bmatch\s+['\"`](/[^'\"`]*)['\"`][^\n]*?via:\s*\[?\s*:(get|post|put|delete|patch)", 2, 1, r"(?i)authenticate_user|before_action :authenticate"),
    ("rails", ("rb",), r"(?i)\b(get|post|put|delete|patch)\s+['\"`](/[^'\"`]*)['\"`]", 1, 2, r"(?i)authenticate_user|before_action :authenticate"),
)
#: Characters after a route in which authentication is looked for, instead of the whole file.
AUTH_WINDOW = {"express": 220, "python": 180}
#: How files are mounted under a prefix, and how they are imported.
MOUNT = r"(?:app|router|server)\.(?:use|register)\s*\(\s*['\"`](/[^'\"`]*)['\"`]\s*,\s*(\w+)"
INCLUDE = r"include_router\s*\(\s*(\w+)(?:\.router)?\s*,\s*prefix\s*=\s*['\"`](/[^'\"`]*)['\"`]"
IMPORTS = r"(?:import\s+(\w+)\s+from\s+['\"]([^'\"]+)['\"]|(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*['\"]([^'\"]+)['\"])"
SUFFIXES = ("", ".ts", ".js", ".tsx", "/index.ts", "/index.js")


def raw_routes(files: DataFrame) -> DataFrame:
    """(path, extractor, at, method, route, auth, source) of every declaration, all in SQL."""

    def declared(order: int, name: str, extensions: tuple[str, ...], pattern: str, method: int, route: int, auth: str) -> Column:
        window = AUTH_WINDOW.get(name)
        seen = pattern + (rf"(?=([\s\S]{{0,{window}}}))" if window else "()")
        every = lambda g: F.regexp_extract_all("content", F.lit(seen), F.lit(g))
        both = F.arrays_zip(every(method).alias("m"), every(route).alias("r"), every(3).alias("w"))
        one = lambda x, i: F.struct(
            F.lit(name).alias("extractor"), F.lit(order).alias("extractor_order"), i.alias("at"), F.upper(x["m"]).alias("method"), F.coalesce(x["r"], F.lit("")).alias("route"), (F.concat_ws(" ", x["m"], x["r"], x["w"]) if window else F.col("content")).rlike(auth).alias("auth")
        )
        return F.when(extension(F.col("path")).isin(*extensions), F.transform(both, one)).otherwise(F.array().cast("array<struct<extractor:string,extractor_order:int,at:int,method:string,route:string,auth:boolean>>"))

    parts = [declared(i, *r) for i, r in enumerate(ROUTES)]
    rows = files.where("path is not null and content is not null").select("path", F.regexp_extract("content", r"@Controller\s*\(\s*['\"`]([^'\"`]*)['\"`]\s*\)", 1).alias("controller"), F.explode(F.concat(*parts)).alias("x")).select("path", "controller", "x.*")
    method = F.when(F.col("method").isin("HANDLE", "HANDLEFUNC"), "GET").otherwise(F.col("method"))
    nest = F.when((F.col("extractor") == "nest") & (F.col("controller") != ""), join_route(F.concat(F.lit("/"), F.regexp_replace("controller", "^/+", "")), F.when(F.col("route") == "", "/").otherwise(F.col("route"))))
    return rows.select("path", "extractor", "extractor_order", "at", method.alias("method"), F.coalesce(nest, F.when(F.col("route").startswith("/"), F.col("route")).otherwise(F.concat(F.lit("/"), "route"))).alias("route"), "auth")


def mounts(files: DataFrame) -> DataFrame:
    """(path, prefix): files mounted under a prefix, by the imports of the file that mounts them.

    Relative imports are resolved by trying suffixes in order: candidates are exploded with their rank and
    joined with the files by equality.
    """
    js = F.transform(F.arrays_zip(F.regexp_extract_all("content", F.lit(MOUNT), F.lit(2)).alias("n"), F.regexp_extract_all("content", F.lit(MOUNT), F.lit(1)).alias("p")), lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p")))
    py = F.transform(F.arrays_zip(F.regexp_extract_all("content", F.lit(INCLUDE), F.lit(1)).alias("n"), F.regexp_extract_all("content", F.lit(INCLUDE), F.lit(2)).alias("p")), lambda x: F.struct(x["n"].alias("n"), x["p"].alias("p")))
    known = files.where("path is not null and content is not null")
    uses = known.select("path", F.explode(F.concat(js, py)).alias("u")).select("path", F.col("u.n").alias("name"), F.col("u.p").alias("prefix"))
    pick = lambda a, b: F.transform(F.arrays_zip(F.regexp_extract_all("content", F.lit(IMPORTS), F.lit(a)).alias("n"), F.regexp_extract_all("content", F.lit(IMPORTS), F.lit(b)).alias("f")), lambda x: F.struct(x["n"].alias("n"), x["f"].alias("f")))
    imports = known.select("path", F.explode(F.concat(pick(1, 2), pick(3, 4))).alias("i")).select("path", F.col("i.n").alias("name"), F.col("i.f").alias("target")).where("name <> '' and target <> ''")
    base = F.regexp_replace("path", r"/?[^/]*$", "")
    joined = F.regexp_replace(F.concat_ws("/", F.when(base != "", base), F.regexp_replace("target", r"^(?:\./)+", "")), r"[^/]+/\.\./", "")
    tries = uses.join(imports, ["path", "name"]).select(F.col("path").alias("by"), "name", "prefix", F.posexplode(F.array(*(F.concat(joined, F.lit(s)) for s in SUFFIXES))).alias("rank", "candidate"))
    hit = tries.join(known.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return hit.groupBy("by", "name", "prefix").agg(F.min_by("candidate", "rank").alias("path")).select("path", "prefix").distinct()


def base_key(name: Column) -> Column:
    """A name without endings that only say what it is: usersRouter, users.routes and user-routes are users, users and user."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[A-Za-z]+$", "")), r"[._-]|(?:routes?|router|controller|api|handlers?|module)(?=$|[._-])", "")


def mounted(files: DataFrame) -> DataFrame:
    """(path, prefix, how) of every file that lies under a prefix: as imported, else in a mounted directory, else by its base name.

    Directories are matched by equality with each parent directory of a file, the deepest first, base names by equality, so
    no join compares all with all.
    """
    imported = materialize(mounts(files))  # read twice below
    exact = imported.groupBy("path").agg(F.min("prefix").alias("prefix"))
    known = files.where("path is not null and content is not null")
    used = known.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("content", F.lit(MOUNT), F.lit(2)).alias("n"), F.regexp_extract_all("content", F.lit(MOUNT), F.lit(1)).alias("p"))).alias("u")).select(F.col("u.n").alias("name"), F.col("u.p").alias("prefix"))
    by_name = used.select(base_key(F.col("name")).alias("key"), "prefix").where("key <> ''").groupBy("key").agg(F.min("prefix").alias("prefix"))
    parts = F.split("path", "/")
    folder = F.when(F.col("path").rlike(r"/index\.[a-z]+$"), F.regexp_replace("path", r"/index\.[a-z]+$", ""))
    roots = imported.select(folder.alias("folder"), "prefix").where("folder is not null").groupBy("folder").agg(F.min("prefix").alias("prefix"))
    parents = known.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("folder")))).alias("x")).select("path", "x.*")
    inside = parents.join(roots, "folder").groupBy("path").agg(F.max_by("prefix", "depth").alias("prefix"))
    named = known.select("path", base_key(F.regexp_extract("path", r"([^/]*)$", 1)).alias("key")).join(by_name, "key").select("path", "prefix")
    every = exact.withColumn("rank", F.lit(0)).unionByName(inside.withColumn("rank", F.lit(1))).unionByName(named.withColumn("rank", F.lit(2)))
    how = F.element_at(F.array(F.lit("import"), F.lit("directory"), F.lit("name")), F.min("rank") + 1)
    return every.groupBy("path").agg(F.min_by("prefix", "rank").alias("prefix"), how.alias("how"))


def endpoints(files: DataFrame) -> DataFrame:
    """(endpoint_id, method, endpoint, source_file, auth, extractor): one per method and route, the first in order."""
    found = raw_routes(files).join(mounted(files).drop("how"), "path", "left")
    full = F.when(F.col("prefix").isNotNull(), join_route(F.col("prefix"), F.col("route"))).otherwise(F.col("route"))
    return first_endpoints(found.withColumn("endpoint", full)).select("endpoint_id", "method", "endpoint", F.col("path").alias("source_file"), F.when(F.col("auth"), "Bearer / Session").otherwise("None").alias("auth"), "extractor")


def first_endpoints(found: DataFrame) -> DataFrame:
    """First declaration of each method and route, with its identity."""
    w = Window.partitionBy("method", "endpoint").orderBy("path", "extractor_order", "at")
    one = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return one.withColumn("endpoint_id", endpoint_id(F.col("method"), F.col("endpoint"), F.col("path")))


def endpoint_id(method: Column, endpoint: Column, path: Column) -> Column:
    return F.concat(F.lit("endpoint:"), F.substring(F.sha2(F.concat_ws("\u0000", method, endpoint, path), 256), 1, 24))


def operations(endpoints_: DataFrame) -> DataFrame:
    """(operation_id, method, route, tag, params): parameters with the types their names suggest, at most 30."""
    route = normalise_route(F.col("endpoint"))
    params = F.transform(F.slice(path_params(route), 1, 30), lambda p: F.struct(p.alias("name"), param_type(p).alias("type")))
    return endpoints_.select(operation_id(F.col("method"), F.col("endpoint")).alias("operation_id"), "method", route.alias("route"), tag_of(F.col("endpoint")).alias("tag"), params.alias("params"))


def openapi_document(operations_: DataFrame, details: DataFrame, title: str = "API", version: str = "1.0.0", most: int = 1000) -> dict:
    """An OpenAPI document with bodies, responses, parameters, components and security, of at most ``most`` operations.

    details: method, route, body_ref, body_fields, query_params, header_params, statuses, security, as handlers give them.
    Every referenced component is there; one that no handler describes is an object without properties.
    """
    said = {(r.method, r.route): r for r in details.orderBy("method", "route").collect()}
    document = json.loads(openapi(operations_, title, version, most))
    components: dict[str, dict] = {}
    secured: set[str] = set()
    for route, methods in document["paths"].items():
        for method, body in methods.items():
            d = next((r for (m, known), r in said.items() if m.lower() == method and known.replace("{", ":").replace("}", "").rstrip("/") and route.replace("{", ":").replace("}", "").endswith(known.replace("{", ":").replace("}", "").rstrip("/"))), None)
            if d is None:
                continue
            name = (d.body_ref or (body["operationId"][:1].upper() + body["operationId"][1:] + "Request")) if d.body_ref or d.body_fields else None
            if name:
                fields = d.body_fields or []
                shape = {"type": "object", "properties": {f["name"]: {"type": f["type"], **({"format": f["format"]} if f["format"] else {})} for f in fields}}
                needed = [f["name"] for f in fields if f["required"]]
                if needed:
                    shape["required"] = needed
                if len(shape["properties"]) >= len(components.get(name, {}).get("properties", {})):
                    components[name] = shape
                body["requestBody"] = {"required": True, "content": {"application/json": {"schema": {"$ref": f"#/components/schemas/{name}"}}}}
            for where, names in (("query", d.query_params), ("header", d.header_params)):
                body.setdefault("parameters", []).extend({"name": n, "in": where, "required": False, "schema": {"type": "string"}} for n in names)
            body["responses"] = {s: {"description": STATUS_TEXT.get(int(s), f"HTTP {s}")} for s in d.statuses if s.isdigit()} or body["responses"]
            kinds = [s for s in d.security if s != "none"]
            if kinds:
                body["security"] = [{s: []} for s in kinds]
                secured |= set(kinds)
    schemes = {"bearerAuth": {"type": "http", "scheme": "bearer"}, "basicAuth": {"type": "http", "scheme": "basic"}, "apiKeyAuth": {"type": "apiKey", "in": "header", "name": "x-api-key"}, "oauth2": {"type": "oauth2", "flows": {}}}
    document["components"] = {"schemas": dict(sorted(components.items())), "securitySchemes": {s: schemes[s] for s in sorted(secured)}}
    return document


def write_openapi(document: dict, target: str) -> str:
    """The document as a file, put in place in one step; its path."""
    path = Path(target)
    temporary = path.with_name(f".{path.name}.new")
    temporary.write_text(json.dumps(document, indent=2) + "\n")
    temporary.replace(path)
    return str(path)


def openapi(operations_: DataFrame, title: str = "API", version: str = "1.0.0", most: int = 1000) -> str:
    """An OpenAPI document of at most ``most`` operations, assembled on the driver."""
    paths: dict = {}
    tags = set()
    for r in operations_.orderBy("route", "method").limit(most).collect():
        tags.add(r.tag)
        body = {"operationId": r.operation_id, "tags": [r.tag], "responses": {"200": {"description": "OK"}}}
        if r.params:
            body["parameters"] = [{"name": p.name, "in": "path", "required": True, "schema": {"type": p.type}} for p in r.params]
        paths.setdefault(r.route, {})[r.method.lower()] = body
    return json.dumps({"openapi": "3.1.0", "info": {"title": title, "version": version}, "tags": [{"name": t} for t in sorted(tags)], "paths": paths}, indent=2)


def merged_responses(responses: DataFrame) -> DataFrame:
    """Responses of each operation by status, the first one each, with the status' text where none is given."""
    w = Window.partitionBy("operation", "status").orderBy("at")
    one = responses.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return one.groupBy("operation").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", F.coalesce("description", status_text(F.col("status"))).alias("description"))))).alias("responses"))


def merged_events(events: DataFrame) -> DataFrame:
    """Socket events by name: two directions make BIDIRECTIONAL, typed and acknowledged if ever, first source."""
    n = F.count_distinct("direction")
    return events.groupBy("event_name").agg(
        F.when(n > 1, "BIDIRECTIONAL").otherwise(F.min("direction")).alias("direction"), F.bool_or("typed").alias("is_typed"), F.bool_or("ack").alias("acknowledged"), F.min("source").alias("source_file"), F.count("*").alias("n")
    )


def merged_models(models: DataFrame) -> DataFrame:
    """Data models by lower-case name: a capitalised spelling, the most fields, all flags and sources."""
    indexes = [F.array_distinct(F.flatten(F.collect_list("indexes"))).alias("indexes")] if "indexes" in models.columns else []
    return models.groupBy(F.lower("name").alias("model_key")).agg(
        F.min_by("name", F.struct(F.when(F.col("name").rlike("^[A-Z]"), 0).otherwise(1), "name")).alias("name"), F.max("n_fields").alias("n_fields"), F.bool_or("registered").alias("registered"), F.count("*").alias("n_sources"), *indexes
    )


def transitions(members: DataFrame, group: str, state: str, order: list[str]) -> DataFrame:
    """(group, from_state, to_state, event) of consecutive states."""
    w = Window.partitionBy(group).orderBy(*order)
    return members.select(group, F.col(state).alias("from_state"), F.lead(state).over(w).alias("to_state")).where("to_state is not null").withColumn("event", F.concat(F.lit("TRANSITION_TO_"), F.upper("to_state")))
