"""Files that nobody in the project wrote by hand: generated, minified, vendored, or data saved as code.

Every file and every directory has one of five labels. What a file's content and name, the inventory, and a
directory's name tell is evidence for a label; a directory and what lies in it are compatible to
different degrees. Belief propagation over the directory tree (a tree, so two passes give the exact marginals)
combines the two: siblings reach each other through their directory. The passes go level by level as
aggregations and joins over all repositories; messages are summed before they are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.snapshot_diff import canonical_path
from lodestrata.runtime import materialize, ship_package

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
H, G, M, V, B = range(5)
#: Log-compatibility of a directory's label (row) and that of an entry in it (column). A project's directory may
#: well hold a vendored or generated part; hardly anything handwritten lies within one.
COMPATIBLE = (
    (0.0, -1.5, -1.5, -2.0, -1.5),
    (-3.0, 0.0, -3.0, -3.0, -3.0),
    (-2.5, -3.0, 0.0, -2.5, -3.0),
    (-6.0, -4.0, -4.0, 0.0, -4.0),
    (-2.5, -3.0, -3.0, -3.0, 0.0),
)
#: Names of directories that hold what others wrote or programs made, with the weight of their evidence. A name
#: weighs no more than one file's notice: several files that look handwritten outvote it, siblings with notices carry it.
DIRECTORY_NAMES = {
    V: {"vendor": 6.5, "third_party": 6.5, "third-party": 6.5, "thirdparty": 6.5, "node_modules": 6.5, "bower_components": 6.5, "jspm_packages": 6.5, "pods": 6.5, "site-packages": 6.5, "external": 6.0, "extern": 6.0, "deps": 6.0, "contrib": 6.0},
    G: {"generated": 4.0, "__generated__": 4.5, "_generated": 4.5, "gen-src": 4.5, "generated-sources": 4.5, "autogen": 4.5, "gen": 1.5, "stubs": 1.0, "target": 0.5},
    M: {"dist": 0.6, "static": 0.4, "public": 0.4, "assets": 0.4},
    B: {"data": 0.4, "fixtures": 0.4, "tables": 0.4, "testdata": 0.4},
}
#: How much more a repository, and any directory in it, is taken for handwritten than for another label beforehand.
ROOT, INNER = 2.0, 0.1
MINIFIED_NAME = re.compile(r"(?:[.-]min|\.bundle|\.[0-9a-z]{8,20}|(?:^|/)bundle|\.chunk)\.(?:js|css|mjs)$", re.I)
GENERATED_NAME = re.compile(r"(?:_gen|_generated|\.generated|\.g|\.pb|_pb2|_pb2_grpc|\.designer|\.gen)\.\w+$", re.I)
BLOB_NAME = re.compile(r"(?:_dump|_data|_table|\.data|-dump)\.\w+$", re.I)
COMMENT = re.compile(r"^\s*(?://+!?|#+|/?\*+!?|--+|<!--|;+|%+|\"\"\")\s?(.*?)\s*(?:\*/|-->)?\s*$")
GENERATED_NOTE = re.compile(
    r"^(?:</?auto-?generated\s*/?>|@generated\b|auto-?generated\b(?!\s+(?:method|constructor|function|ids?|catch|stub|keys?|names?))|code generated\b|(?:this|the following) (?:file|code|module|class|source)\s+(?:was|is|has been)\s+(?:\w+ly\s+|auto-?)?(?:generated|created by|produced by|written by)|(?:automatically\s+)?generated\s+(?:by|from|with|using|on|file)\b|machine[- ](?:made|generated|written)\b|(?:written|produced|emitted|created) by \S+.*\bedits?\b|"
    r"(?:please\s+)?do not (?:edit|modify|change)\b(?!\s+(?:(?:the|an?|its?|these|those|any|either|both|one|how|what|when|while|without|until|unless|if)\b(?!.*\b(?:file|by hand|manually)\b)|this (?!file|code|module|class|source)))|(?:manual|hand|any) (?:changes|edits|modifications) (?:will|may) be (?:lost|overwritten)|changes (?:to this file )?will be (?:lost|overwritten)|"
    r"(?:diese|die) datei (?:wird|wurde)\b.*\b(?:erzeugt|generiert|erstellt)|(?:este|el) (?:archivo|fichero|código)\b.*\b(?:gener|cread|se produce)|ce fichier\b.*\bgénér|.*\bdo not edit(?:\s+(?:by hand|manually|this file))?\s*[.!-]*$|.*\bhands off\s*[.!]*$|.*\bedits? belongs? in the (?:source|template|schema)|.*\brun \S+(?: \S+)? instead\b)",
    re.I,
)
VENDORED_NOTE = re.compile(
    r"^(?:this file is part of (?:the )?(?P<a>[\w.-]+?)(?: project| library)?\.?(?:\s+v?\d[\w.]*)?\.?$|(?:copied|vendored|imported|taken|adapted|borrowed|ported|derived) (?:verbatim |unchanged )?from (?:https?://(?:www\.)?\S*?(?P<b>[\w.-]+?)/?(?=\s|$)|(?:the\s+(?=.*\b(?:project|library|package|repository|distribution)\b))?(?P<c>(?!(?:the|an?|this|that|these|those|its?|our|their|each|both|here|above|below|parent|base|super|other|another|one|all|any)\b)@?[\w./-]+?))(?:@v?\d\S*)?(?:[ ,].*)?$|upstream\s*:\s*\S*?(?P<d>[\w-]+)(?:/tree|/blob|/raw|\.git|$|\s)\S*|(?:copyright\s+)?(?:\(c\)|©)\s*(?:[\d, -]+\s+)?(?:the\s+)?(?P<e>[\w.-]+) contributors\b.*|(?P<f>(?!@?(?:since|version|deprecated|added|removed|changed|fixed|new|introduced|until|before|after|from|in|as|of|for|with|requires?|needs?|see|api)\b)[\w@/.-]+)\s+v\d+\.\d+(?:\.\d+)?(?:[ |,-].*)?$|!?\s*(?P<g>(?!@?(?:since|version|deprecated|added|removed|changed|fixed|new|introduced|until|before|after|from|in|as|of|for|with|requires?|needs?|see|api)\b)[\w.-]+)\s+\d+\.\d+\.\d+\b.*|@license\s+(?P<h>[\w.-]+)\s+v?\d.*)",
    re.I,
)
REASONS = {V: r"(?i)vendor|third.?party", G: r"(?i)^generated|auto.?gen", M: r"(?i)minif", B: r"(?i)^data$|^data:|blob|^SOURCE_SIZE_LIMIT"}
DATA_LINE = re.compile(r"^\s*(?:[\[{(]?\s*(?:[-+]?(?:0x[\da-fA-F]+|\d+(?:\.\d+)?)\s*[,;]?\s*){4,}[\])}]?[,;]?|[\"'`][A-Za-z0-9+/=_-]{30,}[\"'`]\s*[+.,;\\]?|[A-Za-z0-9+/=]{40,}|INSERT\s+INTO\b.*\bVALUES\s*\(.*|\(?(?:\s*(?:-?\d[\d.]*|'[^']*'|\"[^\"]*\"|null)\s*,){3,}.*\)?[,;]?)\s*$", re.I)
DIGITS = re.compile(r"\d+")
#: What a long line of data is made of: strings, other values, keys, separators. Possessive, so a scan is linear.
LITERAL = re.compile(r"""("(?:[^"\\]|\\.)*+"?|'(?:[^'\\]|\\.)*+'?)|((?<![\w.])[-+]?(?:0x[\da-f]++|\d[\d.]*+(?:e[-+]?\d++)?)[flu]{0,3}(?!\w)|\b(?:null|true|false|none|nil)\b)|\b[a-z_]\w*+\s*+:(?!:)|[\s,;:|[\]{}()]++""", re.I)
INSERT = re.compile(r"INSERT\s+INTO\b.*?\bVALUES\s*\(", re.I)
LEADING_COMMENT = re.compile(r"(?:/\*.*?\*/\s*)+")
#: A line, or a string with spaces, is long beyond this many characters; up to the second bound DATA_LINE judges lines too.
LONG, LONGEST_PATTERN = 250, 2_000


def _own(name: str | None, repo: str | None) -> bool:
    """Whether a notice names the project itself or its owner."""
    return bool(name) and bool(repo) and name.lower().strip(".") in {p for p in re.split(r"[/\s]", repo.lower())} | {repo.lower()}


def of_values(line: str) -> bool:
    """Whether a long line consists of data: four values or more, and hardly anything but values and separators."""
    if INSERT.match(line):
        return True
    values = covered = 0
    for m in LITERAL.finditer(line):
        n = m.end() - m.start()
        # A long query or message is a string with words, not a value.
        if m[1] and n > LONG and line.count(" ", m.start(), m.end()) >= 0.02 * n:
            continue
        covered += n
        values += bool(m[1] or m[2])
    return values >= 4 and covered >= 0.9 * len(line)


def evidence(path: str | None, content: str | None, repo: str | None = None) -> list[float]:
    """Log-evidence of a file's name and content for each label."""
    phi = [1.2, 0.0, 0.0, 0.0, 0.0]
    path = path or ""
    if MINIFIED_NAME.search(path):
        phi[M] += 2.5
    if GENERATED_NAME.search(path):
        phi[G] += 1.5
    if BLOB_NAME.search(path):
        phi[B] += 0.8
    if content is None or not content.strip():
        return phi
    lines = content.split("\n")
    total = len(content)
    notes = [m[1] for m in map(COMMENT.match, lines) if m]
    if any(GENERATED_NOTE.match(n) for n in notes):
        phi[G] += 5.0
    for n in notes:
        m = VENDORED_NOTE.match(n)
        if m and not _own(next((g for g in m.groups() if g), None), repo):
            phi[V] += 6.0
            break
    dense = data = solid = code = 0
    templates: Counter[str] = Counter()
    commas: Counter[int] = Counter()
    for line in lines:
        n = len(line)
        s = line.strip()
        if n > LONG:
            s = LEADING_COMMENT.sub("", s, count=1) if s.startswith("/*") else s
        remark = bool(COMMENT.match(s)) and not s.startswith(("#define", "#["))
        counted = False
        if n > LONG:
            spaces = line.count(" ")
            if not remark and of_values(s):
                data += n
                counted = True
            elif spaces < 0.08 * n:
                # A long query or message has words and no code marks, a table in one line has no spaces.
                if sum(map(line.count, ";{}()")) > 0.05 * n:
                    dense += n
                elif spaces < 0.02 * n:
                    data += n
                    counted = True
        if len(s) < 4 or remark:
            continue
        solid += len(s)
        code += 1
        if not counted and n <= LONGEST_PATTERN and DATA_LINE.match(s):
            data += n
        commas[-1 if re.search(r"[(){};=]", s) else s.count(",")] += 1
        if len(s) >= 8:
            templates[DIGITS.sub("0", s)] += 1
    rows, most = (commas.most_common(1) or [(-1, 0)])[0]
    table = rows >= 2 and most >= 4 and most >= 0.8 * code
    repeated = sum(c for _, c in templates.most_common(3) if c >= 4) / max(1, sum(templates.values()))
    special = False
    if dense > 0.4 * total:
        phi[M] += 6.0
        special = True
    elif table or data > 0.5 * max(solid, 1):
        phi[B] += 6.0
        special = True
    elif repeated > 0.6:
        phi[G] += 5.0
        special = True
    if not special:
        # Looks as if a person wrote it: here or in another project.
        phi[H] += 2.0
        phi[V] += 2.0
        if repeated < 0.4 and code >= 4:
            phi[H] += 0.5
            phi[V] += 0.5
    return phi


def _named(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(5)]


def _cols(prefix: str) -> list[Column]:
    return [F.col(c) for c in _named(prefix)]


def _message(df: DataFrame, source: list[Column], out: str, up: bool) -> DataFrame:
    """Adds what an entry tells its directory (up) or a directory tells its entry, centred.

    In steps, each of which names what the next one uses more than once; as one expression it would
    be hundreds of times as large.
    """
    df = df.withColumns(dict(zip(_named("q_"), source, strict=True)))
    terms = [[F.col(f"q_{j}") + F.lit(COMPATIBLE[i][j] if up else COMPATIBLE[j][i]) for j in range(5)] for i in range(5)]
    df = df.withColumns({f"t_{i}": F.greatest(*terms[i]) for i in range(5)})
    df = df.withColumns({f"r_{i}": F.col(f"t_{i}") + F.log(reduce(lambda a, b: a + b, (F.exp(v - F.col(f"t_{i}")) for v in terms[i]))) for i in range(5)})
    return df.withColumns({f"{out}{i}": F.col(f"r_{i}") - F.col("r_0") for i in range(5)}).drop(*_named("q_"), *_named("t_"), *_named("r_"))


def directory_evidence(directory: Column) -> list[Column]:
    """Log-evidence of a directory's name."""
    last = F.lower(F.regexp_extract(directory, r"([^/]*)$", 1))
    out = [F.when(directory == "", ROOT).otherwise(INNER)]
    for label in (G, M, V, B):
        c = F.lit(0.0)
        for name, weight in DIRECTORY_NAMES[label].items():
            c = F.when(last == name, weight).otherwise(c)
        out.append(c)
    return out


def propagate(files: DataFrame) -> DataFrame:
    """Marginals of the files of all trees.

    ``files``: repo, directory, its depth (0 at the root), e0..e4 and any further columns. Adds p0..p4, log
    marginals up to a constant.
    """
    own = _message(files.select("repo", "directory", "depth", *_named("e")), _cols("e"), "s", True)
    at_files = materialize(own.groupBy("repo", "directory", "depth").agg(*(F.sum(n).alias(n) for n in _named("s"))))
    deepest = at_files.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.select("*", *(F.lit(0.0).alias(n) for n in _named("p")))
    parent = F.regexp_replace("directory", r"/?[^/]*$", "")
    levels: dict[int, DataFrame] = {}
    below: DataFrame | None = None
    for level in range(deepest, -1, -1):
        told = at_files.where(F.col("depth") == level).select("repo", "directory", *_named("s"))
        if below is not None:
            told = told.unionByName(below).groupBy("repo", "directory").agg(*(F.sum(n).alias(n) for n in _named("s")))
        here = told.select("repo", "directory", *((s + e).alias(n) for s, e, n in zip(_cols("s"), directory_evidence(F.col("directory")), _named("b"), strict=True)))
        levels[level] = materialize(_message(here, _cols("b"), "u", True))
        below = levels[level].select("repo", parent.alias("directory"), *(F.col(u).alias(s) for u, s in zip(_named("u"), _named("s"), strict=True)))
    # Down: a directory's belief is what it gathered and what its parent tells it without its own part.
    above = lambda df, name: df.select("repo", F.col("directory").alias(name), *(F.col(b).alias(a) for b, a in zip(_named("b"), _named("a"), strict=True)))
    beliefs = levels[0].select("repo", "directory", *_named("b"))
    everywhere = [beliefs]
    for level in range(1, deepest + 1):
        child = levels[level].withColumn("parent", parent).join(above(beliefs, "parent"), ["repo", "parent"])
        child = _message(child, [a - u for a, u in zip(_cols("a"), _cols("u"), strict=True)], "d", False)
        beliefs = materialize(child.select("repo", "directory", *((b + d).alias(n) for b, d, n in zip(_cols("b"), _cols("d"), _named("b"), strict=True))))
        everywhere.append(beliefs)
    told = _message(files.join(above(reduce(DataFrame.unionByName, everywhere), "directory"), ["repo", "directory"]), _cols("e"), "s", True)
    told = _message(told, [a - s for a, s in zip(_cols("a"), _cols("s"), strict=True)], "d", False)
    # Written, as a filter on the outcome would otherwise be pushed down through, and copy, every step.
    return materialize(told.select(*files.columns, *((e + d).alias(n) for e, d, n in zip(_cols("e"), _cols("d"), _named("p"), strict=True))))


def labelled_files(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """(file_id, repo, path, label, certainty) of every file.

    A file without content is judged by its path, the inventory and its neighbours; a null path lies in the
    root, a null repository is a repository of its own. Repeated rows count once; of differing contents of
    one file_id the one that looks least handwritten is taken. Ties go to handwritten.
    """
    spark = files.sparkSession
    ship_package(spark)
    schema = T.StructType([T.StructField("file_id", files.schema["file_id"].dataType), T.StructField("repo", T.StringType()), T.StructField("path", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in _named("e"))])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            phi = [evidence(p, c, r) for p, c, r in zip(b["path"], b["content"], b["repo"], strict=True)]
            out = b[["file_id", "repo", "path"]].copy()
            for i, n in enumerate(_named("e")):
                out[n] = [x[i] for x in phi]
            yield out

    seen = files.select("file_id", F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("path", F.lit("")).alias("path"), "content").mapInPandas(judge, schema)
    # A later spelling of a path must not hide the inventory's words on it.
    said = (
        inventory.where("excluded_reason is not null")
        .select("repo", canonical_path(F.col("path")).alias("path"), *(F.col("excluded_reason").rlike(REASONS[k]).alias(f"r{k}") for k in (G, M, V, B)))
        .groupBy("repo", "path").agg(*(F.max(f"r{k}").alias(f"r{k}") for k in (G, M, V, B)))
    )
    one = seen.groupBy("file_id", "repo", "path").agg(F.min_by(F.struct(*_named("e")), F.col("e0") - F.greatest("e1", "e2", "e3", "e4")).alias("e")).select("file_id", "repo", canonical_path(F.col("path")).alias("path"), "e.*")
    added = {H: F.lit(0.0)} | {k: F.when(F.coalesce(f"r{k}", F.lit(False)), 1.0).otherwise(0.0) for k in (G, M, V, B)}
    placed = one.join(said, ["repo", "path"], "left").select(
        "file_id", "repo", "path", F.regexp_replace("path", r"/?[^/]*$", "").alias("directory"), *((F.col(n) + added[i]).alias(n) for i, n in enumerate(_named("e")))
    )
    placed = materialize(placed.withColumn("depth", F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))))
    p = propagate(placed).withColumn("top", F.greatest(*_cols("p")))
    top = F.col("top")
    label = F.lit(LABELS[H])
    for i in range(4, 0, -1):
        label = F.when(F.col(f"p{i}") == top, LABELS[i]).otherwise(label)
    label = F.when(F.col("p0") == top, LABELS[H]).otherwise(label)
    return p.select("file_id", "repo", "path", label.alias("label"), F.round(1 / reduce(lambda a, b: a + b, (F.exp(x - top) for x in _cols("p"))), 6).alias("certainty"))
