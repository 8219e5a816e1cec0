"""What repositories run on: packages, services, workflows, and the profile of a project."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import file_name, service_role
from lodestrata.operators.report import all_valid
from lodestrata.runtime import ship_package

#: Lock and manifest files by package manager, in order of precedence.
PACKAGE_MANAGERS = (("pnpm", "pnpm-lock.yaml"), ("bun", "bun.lockb"), ("yarn", "yarn.lock"), ("npm", "package-lock.json"), ("cargo", "cargo.toml"), ("go", "go.mod"), ("poetry", "poetry.lock"), ("pip", "requirements.txt"), ("maven", "pom.xml"), ("gradle", "build.gradle"), ("dotnet", "global.json"), ("composer", "composer.json"), ("bundler", "gemfile"))
#: Orchestration by precedence.
ORCHESTRATION = ("kubernetes", "helm", "podman-quadlet", "docker-compose", "podman-compose", "nomad", "dockerfile", "containerfile")
SERVICE = "path string, service string, image string, ports array<string>, env_keys array<string>, pattern string"


def package_managers(paths: DataFrame, group: str = "repo") -> DataFrame:
    """(group, manager): the first that a file of its own speaks for."""
    name = F.lower(file_name(F.col("path")))
    rank = reduce(lambda c, x: c.when(name == x[1][1], x[0]), enumerate(PACKAGE_MANAGERS), F.when(F.lit(False), -1))
    table = F.array(*(F.lit(m) for m, _ in PACKAGE_MANAGERS))
    return paths.select(group, rank.alias("rank")).groupBy(group).agg(F.min("rank").alias("rank")).select(group, F.coalesce(F.get(table, "rank"), F.lit("unknown")).alias("manager"))


#: Profiles that a fact may state, names of root entries, and manifests.
PROFILES = ("static_site", "cli", "library", "service", "workspace", "mixed", "unknown")
ROOT_ENTRY = r"^(?:main|cli)\.(?:py|ts|tsx|js|jsx|rs|go)$"
MANIFEST = r"(?:^|/)(?:package\.json|cargo\.toml|pyproject\.toml|go\.mod|pom\.xml|build\.gradle(?:\.kts)?)$"


def project_profiles(files: DataFrame, group: str = "repo", facts: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """(group, profile, state): what a fact with valid evidence states, else what the paths suggest.

    files: group, path, excluded_reason; excluded files do not count. facts: group, fact_id, kind, profile, evidence_ids. A
    profile from paths is a hypothesis.
    """
    p = F.lower("path")
    has = lambda pattern: F.coalesce(F.bool_or(p.rlike(pattern)), F.lit(False))
    seen = files.groupBy(group).agg(F.max(F.lit(1))).select(group).join(
        files.where("excluded_reason is null").groupBy(group).agg(
            has(r"\.html$|(?:^|/)index\.htm$").alias("pages"), has(r"\.css$").alias("styles"), has(r"\.js$").alias("scripts"), has(r"(?:^|/)(?:vite|webpack|next|astro)\.config\.").alias("bundler"),
            has(r"\.(?:py|ts|tsx|js|jsx|rs|go|java|cs|cpp|c)$").alias("code"), has(ROOT_ENTRY).alias("entry"), F.coalesce(F.bool_or(p.rlike(MANIFEST) & p.contains("/")), F.lit(False)).alias("nested"),
        ), group, "left",
    )
    web = F.col("pages") | F.col("styles") | F.col("bundler")
    guess = F.when(web & F.col("code") & F.col("entry"), "mixed").when(F.col("pages") & (F.col("styles") | F.col("scripts")), "static_site").when(F.col("entry"), "cli").when(F.col("nested"), "workspace").otherwise("unknown")
    out = seen.select(group, guess.alias("profile"))
    if facts is None or evidence is None:
        return out.withColumn("state", F.when(F.col("profile") == "unknown", "unknown").otherwise("hypothesis"))
    stated = all_valid(facts.where(F.lower("kind") == "project_profile"), "fact_id", evidence).groupBy(group).agg(F.min_by("profile", "fact_id").alias("stated"))
    sure = F.col("stated").isin(*PROFILES)
    return out.join(stated, group, "left").select(group, F.when(sure, F.col("stated")).otherwise(F.col("profile")).alias("profile"), F.when(sure, "confirmed").when(F.col("profile") == "unknown", "unknown").otherwise("hypothesis").alias("state"))


def dependencies(packages: DataFrame) -> DataFrame:
    """(package, internal): dependencies of each package that are packages here, as a map row each."""
    names = packages.select(F.col("package").alias("dep")).distinct()
    pairs = packages.select("package", F.explode("deps").alias("dep")).distinct().join(names, "dep", "left_semi")
    return packages.select("package").distinct().join(pairs.groupBy("package").agg(F.sort_array(F.collect_list("dep")).alias("internal")), "package", "left").select("package", F.coalesce("internal", F.array().cast("array<string>")).alias("internal"))


def manifests(files: DataFrame) -> DataFrame:
    """(path, package, version, deps) of package.json, Cargo.toml, go.mod and pyproject.toml."""
    ship_package(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            rows = [(p, *found) for p, c in zip(b["path"], b["content"], strict=True) if (found := read_manifest(p, c))]
            yield pd.DataFrame(rows, columns=["path", "package", "version", "deps"])

    mine = F.lower(file_name(F.col("path"))).isin("package.json", "cargo.toml", "go.mod", "pyproject.toml")
    return files.where(mine & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, "path string, package string, version string, deps array<string>")


def read_manifest(path: str, content: str) -> tuple[str, str | None, list[str]] | None:
    import tomllib

    name = path.rsplit("/", 1)[-1].lower()
    try:
        if name == "package.json":
            d = json.loads(content)
            return d.get("name") or path, d.get("version"), sorted({**d.get("dependencies", {}), **d.get("devDependencies", {})})
        if name == "cargo.toml":
            d = tomllib.loads(content)
            return d.get("package", {}).get("name") or path, d.get("package", {}).get("version"), sorted(d.get("dependencies", {}))
        if name == "pyproject.toml":
            d = tomllib.loads(content).get("project", {})
            return d.get("name") or path, d.get("version"), sorted(re.split(r"[\s<>=!~\[;]", x)[0] for x in d.get("dependencies", []))
    except (ValueError, AttributeError, TypeError):
        return None
    m = re.search(r"^module\s+(\S+)", content, re.M)
    return (m[1], None, sorted(re.findall(r"^\s*(?:require\s+)?([\w./-]+\.[\w./-]+)\s+v\d", content, re.M))) if m else None


def make_targets(files: DataFrame) -> DataFrame:
    """(path, target) of makefiles."""
    mine = F.lower(file_name(F.col("path"))) == "makefile"
    return files.where(mine & F.col("content").isNotNull()).select("path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^([A-Za-z0-9_-]+)\s*:(?!=)"), F.lit(1)))).alias("target"))


def environment_keys(files: DataFrame) -> DataFrame:
    """(path, key) of the variables that examples of environment files name; values are not read."""
    mine = F.lower(file_name(F.col("path"))).rlike(r"^\.env\.(?:example|sample|template|dist)$")
    keys = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_][A-Za-z0-9_]*)[ \t]*="), F.lit(1)))
    return files.where(mine & F.col("content").isNotNull()).select("path", F.explode(keys).alias("key"))


#: What a package manager is told to do, by manager, where no manifest names commands of its own.
COMMANDS = {
    "cargo": {"build": "cargo build", "test": "cargo test"}, "go": {"build": "go build ./...", "test": "go test ./..."}, "maven": {"build": "mvn package", "test": "mvn test"}, "gradle": {"build": "gradle build", "test": "gradle test"},
    "dotnet": {"build": "dotnet build", "test": "dotnet test"}, "poetry": {"test": "poetry run pytest"}, "pip": {"test": "python -m pytest"},
}


def commands(files: DataFrame, managers: DataFrame, group: str = "repo") -> DataFrame:
    """(group, name, command): scripts of package.json run by the manager of the repository, else what the manager is told."""
    scripts = F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")
    named = files.where((F.lower(file_name(F.col("path"))) == "package.json") & F.col("content").isNotNull()).select(group, F.explode(F.map_keys(scripts)).alias("name")).distinct()
    js = named.join(managers.where(F.col("manager").isin("npm", "pnpm", "yarn", "bun")), group).select(group, "name", F.concat("manager", F.lit(" run "), "name").alias("command"))
    table = F.create_map(*(F.lit(x) for m, c in COMMANDS.items() for x in (m, json.dumps(c))))
    usual = managers.where(F.col("manager").isin(*COMMANDS)).select(group, F.explode(F.from_json(F.try_element_at(table, F.col("manager")), "map<string,string>")).alias("name", "command"))
    return js.unionByName(usual)


def read_services(path: str, content: str) -> list[tuple]:
    """Services of compose files, quadlets, manifests of clusters and container files."""
    name = path.rsplit("/", 1)[-1].lower()
    out: list[tuple] = []
    if re.fullmatch(r"(?:docker-|podman-)?compose(?:\.[\w-]+)?\.ya?ml", name):
        pattern = "podman-compose" if name.startswith("podman") else "docker-compose"
        at: dict | None = None
        inside, key = False, ""
        for line in content.split("\n"):
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            indent = len(line) - len(line.lstrip())
            text = line.strip()
            if indent == 0:
                inside = text.startswith("services:")
            elif inside and indent == 2 and text.endswith(":"):
                at = {"service": text[:-1], "image": None, "ports": [], "env": []}
                out.append((path, at, pattern))
            elif inside and at is not None and indent == 4:
                key, _, value = text.partition(":")
                if key == "image":
                    at["image"] = value.strip().strip("\"'")
            elif inside and at is not None and indent > 4:
                item = text.lstrip("- ").strip("\"'")
                if key == "ports":
                    at["ports"].append(item)
                elif key == "environment":
                    at["env"].append(re.split(r"[=:]", item)[0].strip())
        return [(p, a["service"], a["image"], a["ports"], a["env"], k) for p, a, k in out]
    if name.endswith((".container", ".kube", ".pod")):
        return [(path, name.rsplit(".", 1)[0], (re.findall(r"^Image=(.+)$", content, re.M) or [None])[0], re.findall(r"^PublishPort=(.+)$", content, re.M), re.findall(r"^Environment=(\w+)", content, re.M), "podman-quadlet")]
    if name in ("dockerfile", "containerfile") or name.startswith("dockerfile."):
        return [(path, name, (re.findall(r"(?mi)^FROM\s+(\S+)", content) or [None])[-1], re.findall(r"(?mi)^EXPOSE\s+(\S+)", content), re.findall(r"(?mi)^ENV\s+(\w+)", content), "containerfile" if name == "containerfile" else "dockerfile")]
    if name in ("devcontainer.json", ".devcontainer.json"):
        # Comments and trailing commas are allowed there.
        bare = re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(?m)^\s*//.*$", "", content))
        try:
            d = json.loads(bare)
        except ValueError:
            return []
        env = {**(d.get("containerEnv") or {}), **(d.get("remoteEnv") or {})} if isinstance(d, dict) else {}
        return [(path, d.get("name") or "devcontainer", d.get("image"), [str(p) for p in d.get("forwardPorts") or []], sorted(env), "devcontainer")] if isinstance(d, dict) else []
    if name in ("chart.yaml", "values.yaml"):
        return [(path, (re.findall(r"^name:\s*(\S+)", content, re.M) or [name])[0], None, [], [], "helm")]
    if name.endswith((".yaml", ".yml")) and re.search(r"^kind:\s*(?:Deployment|StatefulSet|DaemonSet|Pod|Job|CronJob|Service)\b", content, re.M):
        names = re.findall(r"^\s{2}name:\s*(\S+)", content, re.M) or [name]
        return [(path, names[0], (re.findall(r"image:\s*(\S+)", content) or [None])[0], re.findall(r"containerPort:\s*(\d+)", content), re.findall(r"^\s+- name:\s*([A-Z_]+)$", content, re.M), "kubernetes")]
    if name.endswith(".nomad"):
        return [(path, (re.findall(r'^job\s+"([^"]+)"', content, re.M) or [name])[0], (re.findall(r'image\s*=\s*"([^"]+)"', content) or [None])[0], [], [], "nomad")]
    return []


def services(files: DataFrame) -> DataFrame:
    """Services of all files with role, by the image or name."""
    ship_package(files.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            rows = [r for p, c in zip(b["path"], b["content"], strict=True) for r in read_services(p, c)]
            yield pd.DataFrame(rows, columns=["path", "service", "image", "ports", "env_keys", "pattern"])

    mine = F.lower(file_name(F.col("path"))).rlike(r"\.(?:ya?ml|container|kube|pod|nomad)$|^(?:docker|container)file|^\.?devcontainer\.json$")
    found = files.where(mine & F.col("content").isNotNull()).select("path", "content").mapInPandas(run, SERVICE)
    return found.withColumn("role", service_role(F.coalesce("image", "service")))


def primary_orchestration(services_: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*(F.lit(x) for x in ORCHESTRATION)), F.col("pattern"))
    return services_.agg(F.min_by("pattern", rank).alias("orchestration"))


def role_groups(services_: DataFrame) -> DataFrame:
    return services_.groupBy("role").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("service")).alias("services"))
