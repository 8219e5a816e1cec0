"""Functions paired with their documentation.

All callables of all files form one symbol table, keyed by repository, module, qualified name and normalised
signature, so that overloads keep apart. Every row is joined with the documented separate declaration (header,
prototype, stub, interface) of its key and with its own comment; only then are the comments judged, after markup,
rulers, tags, directives, notices, code and restated names are taken away, and pairs without a description dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.runtime import materialize, ship_package

#: Directories that run in parallel for declarations and definitions, and extensions of declarations.
PARALLEL = r"(?:^|/)(?:include|inc|headers?|src|source|sources|lib|impl|stubs|typings|types)(?=/|$)"
DECLARING = r"\.(?:h|hh|hpp|hxx|pyi|d\.ts|mli|rbi)::"

TYPE_DECLARATION = r"(?i)^\s*(?:@\S+\s+|\[[^\]]*\]\s*)*(?:(?:export|default|public|private|protected|internal|abstract|final|sealed|static|partial|pub|unsafe|readonly|data|open|inner|declare|const|ref)(?:\([^)]*\))?\s+)*(?:class|struct|interface|enum|trait|type|typedef|union|record|module|namespace|impl|protocol|extension)\b(?!\s*[(:=])"
CALLABLE_KIND = r"(?i)^\s*(?:.*_)?(?:func|function|fn|def|method|procedure|proc|sub|subroutine|constructor|ctor|lambda|getter|setter|operator)\s*$"
TYPE_KIND = r"(?i)^\s*(?:class|struct|interface|enum|trait|type|typedef|union|record|module|namespace|object|protocol)\s*$"

STOP = frozenset(
    "a an and are as at be by description do does for from func function functions get has in into is it its itself method methods of on or procedure that the their then this to true false used use uses using var void with self cls name value values param params parameter parameters arg args argument arguments option options callback result results return returns returned returning error errors throws throw raises none null nil "
    "der die das den dem des ein eine einer und oder für mit von zu zur zum ist wird diese dieser dieses funktion methode el la los las un una y o de del al para con por que es esta este esto función metodo método se su".split()
)
PLACEHOLDER = re.compile(
    r"^(?:t\.?\s?b\.?\s?[dac]\.?|n/?a|none|null|nil|nothing|todo|fixme|xxx+|hack|wip|tba|empty|undocumented|no description(?: (?:yet|available|provided))?|description|summary|docstring|documentation|missing|pending|ditto|idem|same|\W*)$"
    r"|^[\[<{_(]*\s*(?:summary|description|brief|short description|long description|docstring|extended_summary|type|returns|add (?:a )?description|write (?:a )?description|insert description)[^\w]*\s*[\]>}_)]*\W*$"
    r"|^(?:auto[- ]?generated|automatically generated)\b.*\b(?:stub|method|constructor|code|comment|catch block)\b.*$"
    r"|^(?:write|add|insert|put|enter|place|provide|fill in|your)\b.{0,30}\b(?:description|documentation|docs?|docstring|comment|summary|text)s?\b(?:\s+here)?\W*$"
    r"|^(?:missing|no)\s+(?:docs?|documentation|docstring|comment|description)\b.*$|^lorem ipsum\b.*$|^(?:type )?description here\W*$",
    re.I,
)
TODO = re.compile(r"^\W*(?:to-?do|fixme|xxx+|hack|tbd|wip|refactor me|document(?:ation)? me)\b(?:\s*\([^)]*\))?\s*(?:[:\-!].*|$)|^\W*(?:to-?do|fixme|xxx+)\s+\S.*$|^(?:por hacer|pendiente|zu tun|offen)\s*:.*$", re.I)
POINTER = re.compile(
    r"^(?:(?:for (?:more |further )?(?:details|information|info|docs|documentation)\W*)?(?:please\s+)?(?:see|cf\.?|refer to|compare|same as|as|like|ditto|look at|check|consult|described in|documented in|defined in|inherited from|inherits from|overrides|implements|siehe|véase|ver|vgl\.?)\b)(?:\s+(?:also|to|the|in|at|from|arriba|oben|above|below|base|parent|super|class|classe|interface|method|function|its|documentation|docs|wiki|readme|header|declaration|overload|implementation|for|details|más|unten|basisklasse|clase))*[\s:]*[\w./#:@{}()<>-]*\W*$"
    r"|^\{?@?\s*inherit[_ ]?doc\}?.*$|^(?:inherited|overridden|inherit) doc.*$|^\{@(?:link|see)[^}]*\}\W*$|^https?://\S+$|^@see\b.*$|^(?:issue|ticket|pr|bug|jira)\W*[#A-Z]*-?\d+\W*$",
    re.I,
)
DIRECTIVE = re.compile(
    r"^\W*(?:eslint(?=[-\s:])|tslint|jshint|jslint|pylint|flake8|noqa|mypy:|pyright:|pyre-|type:\s*ignore|ruff:|isort:|yapf:|fmt:|black:|rubocop|reek:|nolint|golint|go:\w+|\+build|swiftlint|ktlint|detekt|checkstyle|nosonar|nosec\b|noinspection|suppresswarnings|clang-format|cppcheck|iwyu\b|coverage:|pragma:|istanbul ignore|c8 ignore|v8 ignore|codecov|phpcs|phpstan|psalm|@codecoverage|prettier-ignore|biome-ignore|stylelint|@ts-|@jsx|@flow|@internal|@override|@deprecated|@suppress\w*|@nodoc|@ignore|@hidden|@private|@protected|@public|@static|@final|@abstract|@async|@api|@inheritdoc|resharper|(?:end)?region(?=(?:\s+[\w-]+){0,3}\s*$)|#region|#endregion|mark:|vim:|-\*-|cython:|language=|rustfmt|clippy|allow\(|#!\[|#\[|shellcheck|hadolint|webpack\w+:|sourcemappingurl|<auto-generated).*$",
    re.I,
)
LICENCE = re.compile(r"\b(?:licen[sc]ed? under|licen[sc]e\b.{0,40}\b(?:file|text|notice|agreement|terms)|all rights reserved|copyright|spdx|permission is hereby granted|redistribution and use|warranty|apache license|mit licen[cs]e|gnu (?:lesser )?general public|bsd licen|alle rechte vorbehalten|todos los derechos|mozilla public)\b|©|\(c\)\s*(?:19|20)\d\d", re.I)
HEADING = re.compile(
    r"^(?:(?:public|private|protected|internal|static|instance|class|helper|utility|core|main|misc|common|shared|local|global|event|lifecycle|react|test|type|other|extra)\s*)*(?:api|helpers?|utils?|utilities|functions?|methods?|getters?|setters?|accessors?|mutators?|constants?|constructors?|destructors?|properties|fields|members|handlers?|callbacks?|hooks?|types?|interfaces?|imports?|exports?|variables|globals|overrides|implementation|internals?|privates?|publics?|setup|teardown|tests?|fixtures|section|misc(?:ellaneous)?|entry ?points?|main|init(?:iali[sz]ation)?|examples?|usage|notes?|parameters|arguments|returns?|raises|todo|header|footer|beispiel|ejemplo|hilfsfunktionen)(?:\s*(?:/|&|,|and|-|und|y)\s*(?:setters?|getters?|helpers?|utils?|utilities|methods?|functions?|types?|constants?|properties))*\s*:?\W*$",
    re.I,
)
TAG = re.compile(r"^\s*(?:[@\\](\w+)|:(\w+)[^:\n]*:)(.*)$", re.S)
TAG_NAMED = {"param", "arg", "argument", "property", "prop", "tparam", "typeparam", "throws", "exception", "raises", "raise", "type", "rtype", "var", "ivar"}
TAG_PROSE = {"brief", "summary", "description", "desc", "details", "remarks", "note", "notes", "short", "par", "warning", "attention", "abstract"}
FIELD = re.compile(r"^\s*[\w$*&]+\s*(?:\([^)]*\))?\s*:\s+(?:\S+)(?:,? (?:may|can|must|should) be \w+|, optional|, required)?\s*\.?$")
CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:return|if|for|while|const|let|var|import|from \S+ import|#include|using|throw|raise|yield|await|print|assert|def|fn|func|function|public|private|else|try|catch|except|class|elif|end|package|use)\b.*[()=;:{}].*$"
    r"|^\s*[\w.$>:\[\]'\"-]+\s*(?:=|\+=|-=|:=|==|=>|->)\s*\S+|^\s*[\w.$:>-]+\([^)]*\)\s*[;:]?\s*$|^\s*(?:\$|>>>|>|%|#)\s*\w+.*$|^\s*(?:curl|sqlcmd|psql|npm|pip|export|docker|kubectl|git|make|machine|wget|sudo)\s+\S+.*$|^\s*[\[{].*[\]}]\s*$|^\s*<[\w/][^>]*>\s*$"
)
#: Six words in a row are prose, whatever follows them.
PROSE = re.compile(r"(?:[A-Za-zÀ-ÿ'’-]+,?\s+){6}")
DATA = re.compile(
    r"^\s*(?:[\w-]+:\s*)?[A-Za-z0-9+/=_.-]{24,}\s*$|^-----(?:BEGIN|END) [A-Z0-9 ]+-----$|^\s*(?:integrity|icon|download|expected digest|digest|checksum|sha\d*|request id|trace id|x-api-key|authorization|user|password|passwd|login|token|pwd|host|server|commit|signed with|introduced in commit|since|version|author|date|created|last modified|file|module|fichero|datei)\b\s*[:=]?(?:\s+(?:\S+))?\W*$|^\s*Introduced in (?:commit|version|release)\b.*$|^\s*\w+=[^;]*;\w+=.*$|^\s*\w+://\S+\s*$|^\s*[\w-]+:\s*[\[*]\S+$",
    re.I,
)
RULER = re.compile(r"^[\W_]*$")
MARKUP = re.compile(r"</?(?:p|br|b|i|em|strong|code|pre|ul|ol|li|div|span|summary|remarks|para|tt|h\d|returns|value|example)\b[^>]*>|\*\*|``?|</?see[^>]*>", re.I)
SECTION = re.compile(r"^\s*(?:example|examples|usage|beispiel|ejemplo|sample|>>>|```\w*)\s*:?\s*$", re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")


def _stem(word: str) -> str:
    w = unicodedata.normalize("NFC", word).lower()
    for end in ("ies", "ing", "ers", "es", "ed", "er", "s", "e", "y"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            return w[: -len(end)]
    return w


def name_words(name: str) -> set[str]:
    """Stems of the words a camel- or snake-case name is made of."""
    parts = re.findall(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|\d+", name)
    return {_stem(p) for p in parts} | {_stem(name)}


def _content(text: str, own: set[str]) -> list[str]:
    """Words that say something beyond the name and grammar."""
    return [w for w in WORD.findall(text) if w.lower() not in STOP and len(w) > 1 and not ((s := _stem(w)) in own or any(len(o) - len(s) == 1 and o.startswith(s) for o in own))]


def described(docstring: str | None, name: str | None) -> str | None:
    """The describing part of a comment, or None where nothing describes the function."""
    if not docstring or not docstring.strip():
        return None
    own = name_words(name or "")
    kept, skip_code = [], False
    for raw in docstring.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = MARKUP.sub(" ", raw)
        line = re.sub(r"^\s*(?:/\*+|\*+/?|//+!?|#+|--+|\"\"\"|''')\s?", "", line) if re.match(r"^\s*(?:/\*|\*|//|#|--|\"\"\"|''')", line) else line
        line = re.sub(r"\s*\*+/\s*$", "", line).strip()
        if not line or RULER.match(line):
            skip_code = skip_code and bool(line)
            continue
        if SECTION.match(line):
            skip_code = True
            continue
        tag = TAG.match(line)
        if tag:
            label, rest = (tag[1] or tag[2]).lower(), tag[3].strip()
            if label in TAG_PROSE:
                line = rest
            else:
                if label in TAG_NAMED and not tag[2]:
                    rest = re.sub(r"^(?:\{[^}]*\}\s*)?\S+\s*-?\s*", "", rest)
                # A tag tells of the use of the function where it explains at length.
                if label not in ("param", "arg", "return", "returns", "throws", "raises", "tparam") or len(_content(rest, own)) < 4:
                    continue
                kept.append(rest)
                continue
        if FIELD.match(line) or TODO.match(line) or PLACEHOLDER.match(line) or DIRECTIVE.match(line) or LICENCE.search(line):
            continue
        if HEADING.match(line) or POINTER.match(line) or DATA.match(line):
            continue
        if skip_code and raw[:1] in " \t":
            continue
        kept += [part for part in re.split(r"(?<=[.!?])\s+", line) if PROSE.match(part) or not CODE.search(part)]
    text = " ".join(kept)
    good = []
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        if PLACEHOLDER.match(sentence) or TODO.match(sentence) or POINTER.match(sentence) or HEADING.match(sentence):
            continue
        if _content(sentence, own):
            good.append(sentence)
    return " ".join(good) or None


def callable_row(kind: Column, signature: Column) -> Column:
    """Whether a symbol is a function or method: by its declaration, else by the spelling of its kind."""
    is_type = F.coalesce(signature.rlike(TYPE_DECLARATION), F.lit(False))
    by_form = signature.rlike(r"\w\s*[(<]") & ~is_type
    by_kind = F.coalesce(kind.rlike(CALLABLE_KIND), F.lit(False))
    typed = F.coalesce(kind.rlike(TYPE_KIND), F.lit(False))
    return signature.isNotNull() & ~is_type & (by_kind | (F.coalesce(by_form, F.lit(False)) & ~typed))


def normalised_signature(signature: Column) -> Column:
    """Equal for a declaration and its definition: no defaults, annotations, modifiers, names of parameters' values or white space."""
    s = F.regexp_replace(signature, r"/\*.*?\*/|//[^\n]*", "")
    s = F.regexp_replace(s, r"#\[[^\]]*\]|@\w+(?:\([^)]*\))?", "")
    s = F.regexp_replace(s, r"""\s*=\s*(?:"[^"]*"|'[^']*'|\[[^\]]*\]|\{[^}]*\}|[^,()]+)(?=[,)])""", "")
    s = F.regexp_replace(s, r"\b(?:extern|static|inline|export|default|declare|public|private|protected|internal|virtual|override|abstract|final|async|pub|unsafe|const)\b", "")
    return F.regexp_replace(s, r"\s+|;\s*$|\{\s*$", "")


def keyed(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The symbol table: callables with the parts of their key.

    ``separate`` marks declarations that are no definitions. ``files`` (file_id, repo) tells the repository of a symbol; without
    it all symbols are of one.
    """
    own = symbols.where(callable_row(F.col("kind"), F.col("signature_clean")))
    if files is not None:
        of = files.where("file_id is not null").groupBy("file_id").agg(F.min("repo").alias("in_repo"))
        own = own.select("symbol_id", "file_id", "fqsn", "name", "signature_clean", "docstring_clean").join(of, "file_id", "left")
    else:
        own = own.select("symbol_id", "fqsn", "name", "signature_clean", "docstring_clean").withColumn("in_repo", F.lit(None).cast("string"))
    path = F.regexp_extract("fqsn", r"^(.*?)::", 1)
    return own.select(
        "symbol_id", "fqsn", "name", F.col("signature_clean").alias("signature"), F.col("docstring_clean").alias("own_doc"),
        F.coalesce("in_repo", F.lit("")).alias("in_repo"),
        F.regexp_replace(F.regexp_replace(path, r"/?[^/]*$", ""), PARALLEL, "").alias("module"),
        F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?:\.d)?\.[A-Za-z+]+$", "").alias("stem"),
        F.regexp_replace(F.regexp_replace("fqsn", r"::<signature:[0-9a-f]+>$", ""), r"^.*?::", "").alias("qualified"),
        normalised_signature(F.col("signature_clean")).alias("normal"),
        (F.col("signature_clean").rlike(r";\s*$") | F.coalesce(F.col("fqsn").rlike(DECLARING), F.lit(False))).alias("separate"),
    )


def joined_pairs(table: DataFrame) -> DataFrame:
    """Every callable with its own comment and that of its declaration, before anything is judged.

    A declaration is looked for in the module (directories of headers and sources are the same), else in the
    repository if all of that name and signature say the same. There is one row per key on that side, the
    longest of differing comments, so the join cannot grow however many rows share a key.
    """
    said = F.struct(F.col("own_doc").alias("doc"), F.col("symbol_id").alias("id"))
    documented = materialize(table.where(F.col("separate") & (F.trim(F.coalesce("own_doc", F.lit(""))) != "")))
    order = F.struct(F.length("own_doc"), F.col("own_doc"), F.col("symbol_id"))
    near_key, far_key = ["in_repo", "module", "stem", "qualified", "normal"], ["in_repo", "stem", "qualified", "normal"]
    near = documented.groupBy(*near_key).agg(F.max_by(said, order).alias("near"))
    far = documented.groupBy(*far_key).agg(F.max_by(said, order).alias("far"), F.min("own_doc").alias("least"), F.max("own_doc").alias("most")).where("least = most").drop("least", "most")
    both = table.join(near, near_key, "left").join(far, far_key, "left")
    found = F.when(~F.col("separate"), F.coalesce("near", "far"))
    return both.select("symbol_id", "fqsn", "name", "signature", "own_doc", found["doc"].alias("declared_doc"), found["id"].alias("declared_id"))


def documented_pairs(symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(symbol_id, fqsn, signature, documentation, doc_symbol_id) of every described function or method.

    ``doc_symbol_id`` is the row whose comment it is: the symbol itself, or its separate declaration where the
    own comment describes nothing. Rows without signature, and types, give no pair. Repeated and re-extracted rows of a
    symbol give one pair; of differing texts of one symbol an own one, then the smallest, is taken.
    """
    ship_package(symbols.sparkSession)
    joined = joined_pairs(keyed(symbols, files))
    key = joined.schema["symbol_id"].dataType
    schema = T.StructType([T.StructField("symbol_id", key), T.StructField("fqsn", T.StringType()), T.StructField("signature", T.StringType()), T.StructField("documentation", T.StringType()), T.StructField("doc_symbol_id", key)])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[tuple, str | None] = {}

            def says(text: str | None, name: str | None) -> str | None:
                at = (text, name)
                if at not in known:
                    known[at] = described(text, name)
                return known[at]

            rows = []
            for k, fqsn, name, signature, own, declared, by in b.astype(object).where(b.notna(), None).itertuples(index=False, name=None):
                if text := says(own, name):
                    rows.append((k, fqsn, signature, text, k))
                elif text := says(declared, name):
                    rows.append((k, fqsn, signature, text, by))
            yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    judged = joined.mapInPandas(judge, schema)
    first = F.struct(~F.col("doc_symbol_id").eqNullSafe(F.col("symbol_id")), "documentation", "signature", "fqsn")
    return judged.groupBy("symbol_id").agg(F.min_by(F.struct("fqsn", "signature", "documentation", "doc_symbol_id"), first).alias("s")).select("symbol_id", "s.*")
