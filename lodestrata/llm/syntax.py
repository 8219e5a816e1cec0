"""Source files that do not parse.

A packrat grammar per language must consume the whole content. The language is that of the file
extension; a declared language or a parser's report plays no part. Parsing happens where the file was read, so
no content is shuffled; only the verdicts are.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.grammars import cfamily, ecmascript, scripting
from lodestrata.llm.peg import Grammar
from lodestrata.runtime import ship_package

same = lambda text: text
#: Language by extension, and per language its grammar and what makes its layout visible.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript",
    "jsx": "jsx", "tsx": "tsx", "java": "java", "c": "c", "h": "c", "cs": "csharp", "go": "go", "rs": "rust", "php": "php", "rb": "ruby", "sql": "sql",
}
LANGUAGES: dict[str, tuple[Callable[[], Grammar], Callable[[str], str]]] = {
    "python": (scripting.python, scripting.python_layout), "javascript": (ecmascript.javascript, same), "typescript": (ecmascript.typescript, same), "jsx": (ecmascript.jsx, same), "tsx": (ecmascript.tsx, same), "java": (cfamily.java, same),
    "c": (cfamily.c, same), "csharp": (cfamily.csharp, same), "go": (cfamily.go, cfamily.go_layout), "rust": (cfamily.rust, same), "php": (cfamily.php, same), "ruby": (scripting.ruby, scripting.ruby_layout), "sql": (scripting.sql, same),
}
CONFLICT = re.compile(r"^(?:<{7}(?: .*)?|={7}|>{7}(?: .*)?|\|{7}(?: .*)?)\r?$", re.M)
CAUSES = (
    ("lfs_pointer", re.compile(r"\Aversion https?://[^\n]*/spec/v1\s*\noid sha256:")),
    ("binary", re.compile(r"\A(?:%PDF-|\x7fELF|PK\x03\x04|\x89PNG)|\x00|\ufffd{3}")),
    ("markup", re.compile(r"\A\s*<(?:!DOCTYPE|html|\?xml)", re.I)),
    ("diff", re.compile(r"\Adiff --git |\A--- a/|\AIndex: ")),
    ("template", re.compile(r"^\s*(?:\{%.*%\}|<%=?.*%>|@@[A-Z ]+@@)", re.M)),
)


def language_of(path: Column) -> Column:
    """Language named by the extension; null where there is none or no grammar for it."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.try_element_at(table, ext)


@functools.lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))
    return LANGUAGES[language][0]()


def is_valid(language: str, content: str) -> bool:
    return grammar(language).accepts(LANGUAGES[language][1](content))


def other_language(language: str, content: str) -> str | None:
    """A language that the content does follow, if it is not blank there."""
    for name in LANGUAGES:
        if name not in (language, "php", "sql", "jsx", "tsx") and is_valid(name, content):
            return name
    return None


def diagnose(language: str, content: str) -> tuple[int, int, str] | None:
    """None for valid content, else (offset, line, cause) of the furthest failure."""
    laid = LANGUAGES[language][1](content)
    at = grammar(language).failure(laid)
    if at is None:
        return None
    too_deep = grammar(language).diagnosing.too_deep
    offset = min(len(content), at - laid.count("\x03", 0, at) if language == "python" else at)
    line = content.count("\n", 0, offset) + 1
    if too_deep:
        return offset, line, "nesting"
    # A marker of a merge: at the failure or, where a line of it parses, further down.
    lines = content.split("\n")
    if CONFLICT.search("\n".join(lines[max(0, line - 2) : line + 1])) or len(CONFLICT.findall(content)) >= 2:
        return offset, line, "merge_conflict"
    for cause, pattern in CAUSES:
        if pattern.search(content):
            return offset, line, cause
    if not content[offset:].strip():
        return offset, line, "truncated"
    if other_language(language, content):
        return offset, line, "wrong_extension"
    return offset, line, "syntax"


def judged_files(files: DataFrame, detail: bool = True) -> DataFrame:
    """(file_id, repo, language, valid[, offset, line, cause]) of every file.

    ``valid`` is null for contents that are null or of no known language; empty and comment-only files are
    valid. Repeated rows of a file come out once; if rows of one file_id differ in content, each verdict
    does. Content of any length is read whole; one nested some ten thousand levels deep, which no compiler of these
    languages takes, is invalid for its nesting.
    """
    ship_package(files.sparkSession)
    schema = T.StructType([
        T.StructField("file_id", files.schema["file_id"].dataType), T.StructField("repo", T.StringType()), T.StructField("language", T.StringType()), T.StructField("valid", T.BooleanType()),
        *([T.StructField("offset", T.LongType()), T.StructField("line", T.LongType()), T.StructField("cause", T.StringType())] if detail else []),
    ])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, repo, lang, content in zip(b["file_id"], b["repo"], b["language"], b["content"], strict=True):
                verdict, more = None, (None, None, None)
                if lang is not None and content is not None:
                    verdict = is_valid(lang, content)
                    if detail and not verdict:
                        more = diagnose(lang, content) or more
                rows.append((key, repo, lang, verdict, *(more if detail else ())))
            out = pd.DataFrame(rows, columns=schema.names, dtype=object)
            yield out

    chosen = files.select("file_id", "repo", language_of(F.col("path")).alias("language"), "content")
    return chosen.mapInPandas(judge, schema).distinct()


def invalid_rates(judged: DataFrame) -> DataFrame:
    """Files judged, files invalid and their share, per repository and language."""
    return (
        judged.where("valid is not null")
        .groupBy("repo", "language")
        .agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
        .withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
    )
