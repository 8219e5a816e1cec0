"""Source text to symbols, calls and diagnostics: Python by its syntax tree, languages with braces by their tokens and
brackets, other languages by the words that begin a line."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.text import COMPLEXITY_KEYWORDS
from lodestrata.operators import structure
from lodestrata.runtime import materialize, ship_package

SYMBOL = "path string, fqsn string, name string, kind string, visibility string, line_start int, line_end int, complexity int, signature string, docstring string, method string"
CALL = "path string, caller_fqsn string, callee_name string, callee_expression string, edge_kind string, line int, column int, shadowed boolean"
DIAGNOSTIC = "path string, state string, code string, message string"
#: Fixed value: functions that are handed a callback, which is not called where it stands.
CALLBACKS = frozenset({"addEventListener", "add_handler", "register_callback", "on"})
#: How many lines a symbol of a language without a tree is taken to have after its first.
SPANS = {"class": 15, "function": 10, "table": 5, "view": 5, "label": 5}
OPENS_TYPE = frozenset({"class", "struct", "interface", "trait", "enum", "module", "unit"})
OPENS_FUNCTION = frozenset({"def", "fn", "fun", "func", "function", "sub", "procedure"})
MODIFIES = frozenset({"pub", "public", "private", "protected", "internal", "abstract", "final", "static", "async", "override", "open", "export", "local", "virtual", "create", "or", "replace"})
_WORDS = re.compile(r"[A-Za-z_][\w.]*[?!]?|\S")
_EXTRACTORS: dict[str, Callable[[str, str], list[tuple]]] = {}


def register_extractor(extension: str, extract: Callable[[str, str], list[tuple]]) -> None:
    """Use ``extract(path, content)`` for the symbols of files of an extension."""
    _EXTRACTORS[extension] = extract


def text_complexity(text: str) -> int:
    lines = [x for x in text.split("\n") if not x.strip().startswith(("//", "#", "/*", "*"))]
    return max(1, min(100, 1 + sum(line.count(k) for line in lines for k in COMPLEXITY_KEYWORDS)))


def comment_above(lines: list[str], at: int) -> str | None:
    """The contiguous comment lines right above a line, without markers."""
    found: list[str] = []
    i = at - 1
    while i >= 0 and (s := lines[i].strip()) and s.startswith(("//", "#", "/*", "*", "--", ";")):
        found.append(re.sub(r"^(?:///?!?|#+|/\*+|\*+/?|--|;+)\s?|\s*\*+/$", "", s).strip())
        i -= 1
    text = "\n".join(x for x in reversed(found) if x)
    return text or None


def _python(path: str, content: str) -> tuple[list[tuple], list[tuple]]:
    tree = ast.parse(content)
    lines = content.split("\n")
    symbols: list[tuple] = []
    calls: list[tuple] = []
    assigned = {n.arg for n in ast.walk(tree) if isinstance(n, ast.arg)} | {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}

    def visit(node: ast.AST, scope: list[str], caller: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                fqsn = "::".join([path, *scope, child.name])
                text = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                kind = "class" if isinstance(child, ast.ClassDef) else "function"
                signature = lines[child.lineno - 1].strip().rstrip(":")
                symbols.append((path, fqsn, child.name, kind, "private" if child.name.startswith("_") else "public", child.lineno, child.end_lineno, text_complexity(text), signature, ast.get_docstring(child), "python_ast"))
                visit(child, [*scope, child.name], fqsn if kind == "function" else caller)
                continue
            if isinstance(child, ast.Call) and caller:
                f = child.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    calls.append((path, caller, name, ast.unparse(f), "direct_call" if isinstance(f, ast.Name) else "member_call", child.lineno, child.col_offset, isinstance(f, ast.Name) and name in assigned))
            visit(child, scope, caller)

    visit(tree, [], None)
    return symbols, calls


def _braces(path: str, content: str) -> tuple[list[tuple], list[tuple], bool]:
    found = structure.read(path, content)
    lines = content.split("\n")
    symbols = [
        (path, s.fqsn, s.name, s.kind, "public" if s.public else "private", s.first, s.last, text_complexity(content[s.start : s.end]), structure.signature(content, s), comment_above(lines, s.first - 1), "brackets")
        for s in found.symbols
    ]
    calls = [(path, caller, name, text, kind, line, column, kind == "direct_call" and name in found.bound) for caller, name, text, kind, line, column in found.calls]
    return symbols, calls, found.balanced


def _opened(words: list[str], extension: str) -> tuple[str, str] | None:
    """(name, kind) of what a line opens, by its first words."""
    low = [w.lower() for w in words]
    if extension == "sql":
        if low[:1] != ["create"]:
            return None
        at = next((i for i, w in enumerate(low[:6]) if w in ("table", "view")), None)
        if at is None:
            return None
        named = [w for w in words[at + 1 :] if w.lower() not in ("if", "not", "exists")]
        return (named[0], low[at]) if named and re.match(r"[A-Za-z_]", named[0]) else None
    if extension in ("s", "asm"):
        return (words[0], "label") if len(words) > 1 and words[1] == ":" and re.match(r"[A-Za-z_.]", words[0]) else None
    at = 0
    while at < len(words) and words[at] in MODIFIES:
        at += 1
    if at + 1 >= len(words) or not re.match(r"[A-Za-z_]", words[at + 1]):
        return None
    if words[at] in OPENS_TYPE:
        return words[at + 1].split(".")[0], "class"
    if words[at] in OPENS_FUNCTION:
        return words[at + 1].split(".")[-1].rstrip("?!"), "function"
    return None


def heuristic_symbols(path: str, content: str) -> list[tuple]:
    """Symbols by the words that begin a line; ends of spans are estimates."""
    extension = path.rsplit(".", 1)[-1].lower()
    lines = content.splitlines()
    out = []
    for i, line in enumerate(lines):
        label = extension in ("s", "asm")
        if not line.strip() or (label and line[0].isspace()):
            continue
        words = re.findall(r"[.\w]+|\S", line[:400]) if label else _WORDS.findall(line[:400])
        found = _opened(words, extension)
        if found is None:
            continue
        name, kind = found
        last = min(len(lines), i + 1 + SPANS[kind])
        hidden = "private" in words or name.startswith("_")
        out.append((path, f"{path}::{name}", name, kind, "private" if hidden else "public", i + 1, max(i + 1, last), text_complexity("\n".join(lines[i:last])), line.strip(), comment_above(lines, i), "heuristic"))
    return out


def parse_text(path: str, content: str, extra: dict | None = None) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Symbols, calls and diagnostics of one file."""
    extension = path.rsplit(".", 1)[-1].lower()
    if extra and extension in extra:
        return extra[extension](path, content), [], []
    recovered = "parser recovered from syntax errors; facts may be incomplete"
    if extension in ("py", "pyi"):
        try:
            symbols, calls = _python(path, content)
        except (SyntaxError, ValueError, RecursionError):
            return heuristic_symbols(path, content), [], [(path, "partial", "SYNTAX_RECOVERY", recovered)]
        whole = True
    elif extension in structure.LANGUAGES:
        try:
            symbols, calls, whole = _braces(path, content)
        except RecursionError:
            return heuristic_symbols(path, content), [], [(path, "partial", "SYNTAX_RECOVERY", recovered)]
    else:
        complete = extension in ("sql", "s", "asm")
        return heuristic_symbols(path, content), [], [] if complete else [(path, "partial", "AST_UNSUPPORTED", "line patterns only")]
    notes = [] if whole else [(path, "partial", "SYNTAX_RECOVERY", recovered)]
    notes += [(path, "partial", "CALLBACK_BINDING_UNSUPPORTED", c[3]) for c in calls if c[2] in CALLBACKS]
    return symbols, calls, notes


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, calls, diagnostics) of files with path and content; each file is parsed once, where it was read.

    The rows of all three are written to the shared folder and read back from there. A file whose tree cannot be built
    falls back to line words with SYNTAX_RECOVERY, one with unbalanced brackets is read as far as they go; a language
    without a tree gets AST_UNSUPPORTED. Null contents give nothing.
    """
    ship_package(files.sparkSession)
    chosen = files.where("path is not null and content is not null").select("path", "content").distinct()
    extra = dict(_EXTRACTORS)
    parts = (("symbol", SYMBOL), ("call", CALL), ("diagnostic", DIAGNOSTIC))
    names = [[c.split()[0] for c in schema.split(", ")] for _, schema in parts]

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in stream:
            columns: list[list] = [[], [], []]
            for p, c in zip(b["path"], b["content"], strict=True):
                for which, rows in enumerate(parse_text(p, c, extra)):
                    for r in rows:
                        for k in range(3):
                            columns[k].append(dict(zip(names[k], r, strict=True)) if k == which else None)
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for (n, _), v in zip(parts, columns, strict=True)})

    schema = ", ".join(f"{n} struct<{', '.join(': '.join(c.split()) for c in s.split(', '))}>" for n, s in parts)
    tagged = materialize(chosen.mapInPandas(run, schema))
    table = lambda n: tagged.where(F.col(n).isNotNull()).select(f"{n}.*")
    return table("symbol"), table("call"), table("diagnostic")


def occurrences_of(calls: DataFrame) -> DataFrame:
    """Calls as occurrences: with an id, and whether they can be resolved by name."""
    from lodestrata.operators.resolve import occurrence_id

    key = [F.col(c) for c in ("caller_fqsn", "callee_name", "callee_expression", "edge_kind", "line", "column")]
    return calls.select(occurrence_id(key).alias("occurrence_id"), F.col("path").alias("file_path"), "caller_fqsn", "callee_name", "edge_kind", (F.col("edge_kind") == "direct_call").alias("direct"), "shadowed")


def file_states(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(path, analysis_state): partial where anything was diagnosed."""
    bad = diagnostics.select("path").distinct().withColumn("p", F.lit(True))
    return files.select("path").distinct().join(bad, "path", "left").select("path", F.when(F.col("p"), "partial").otherwise("complete").alias("analysis_state"))
