"""Credentials in source code: found by unnatural strings and context, masked in place.

Every string that context makes a candidate is measured: how unnatural its characters per subword are under a public
vocabulary (``naturalness``). The measure, the weight of the context (the name it is assigned to, a URI, a header, a
command, a sentence, the form of an issued token, nothing at all) and the form of the value add up; a positive sum is a
secret. Strong contexts find passwords made of words, weak ones only what no words make up. The secret's characters
are replaced one by one, so offsets, quotes and the code around stay as they are.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import naturalness, vocab
from lodestrata.runtime import ship_package

MASK = "*"
#: Weights of contexts, in the units of the measure (within -4 and 4). Only the place of a password and the fixed form of an issued token outweigh it.
CONTEXT = {"uri": 4.5, "command": 4.5, "basic": 4.5, "issued": 4.5, "password": 2.0, "secret": 1.5, "prose": 1.5, "header": 0.0, "signed": 0.0, "general": 0.0, "weak": 0.0, "none": -2.0}
#: What a digit or sign within a password, or three words and more as a passphrase, add.
MIXED, PASSPHRASE = 3.0, 3.0

# Shapes of issued tokens, in any surrounding.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_+/-])(?:"
    r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|AIza[A-Za-z0-9_-]{30,40}"
    r"|gh[opsur]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}"
    r"|gl(?:pat|dt|rt)-[A-Za-z0-9_-]{18,}"
    r"|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_-]{40,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|whsec_[A-Za-z0-9+/=]{20,}"
    r"|sk-(?:[a-z]+-)*[A-Za-z0-9_-]{24,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{16,}|xapp-[A-Za-z0-9-]{20,}"
    r"|[a-z]{2,6}[_.][a-z0-9]{24,40}(?![A-Za-z0-9_.-])"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|(?:dop|doo|dor)_v1_[a-f0-9]{40,}|shp(?:at|ss|ca)_[a-fA-F0-9]{32}"
    r"|hf_[A-Za-z0-9]{30,}|dckr_pat_[A-Za-z0-9_-]{20,}|hvs\.[A-Za-z0-9_-]{20,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"
    r")"
)
GENERAL = re.compile(r"(?!(?:npm|hf|hvs|whsec|ghp|gho|ghs|ghu|ghr|sk|rk)[_.])[a-z]{2,6}[_.][a-z0-9]{24,40}\Z")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
OPAQUE_BLOCK = re.compile(
    r"-----BEGIN (?:PUBLIC KEY|[A-Z0-9 ]*CERTIFICATE(?: REQUEST)?|[A-Z0-9 ]+ PUBLIC KEY(?: BLOCK)?|PGP SIGNATURE)-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)"
    r"|data:[\w.+-]+/[\w.+-]+;base64,[A-Za-z0-9+/=\s]*?(?=[\"'\s)]|\Z)"
    r"|\bsha(?:1|224|256|384|512)[-:=][A-Za-z0-9+/=]{20,}"
    r"|\bssh-(?:rsa|ed25519|dss)\s+[A-Za-z0-9+/=]{20,}"
    r"|\b(?:commit|revision|digest|checksum|request id|trace id|etag)[\s:=]+[\"']?[0-9a-fA-F-]{7,}",
    re.S | re.I,
)
URI = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s:@/\"'`<>]*):([^\s\"'`<>@]+)@(?=[\w\[])")
BASIC = re.compile(r"\bBasic\s+([A-Za-z0-9+/_-]{8,}={0,2})")
BEARER = re.compile(r"\b(?:Bearer|Token|ApiKey)\s+([A-Za-z0-9+/=._~-]{8,})")
SIGNED = re.compile(r"[?&](?:sig|signature|x-amz-signature|x-goog-signature|token|access_token|auth|api_?key|secret)=([A-Za-z0-9%_+/=.~-]{12,})", re.I)
COMMANDS = (
    re.compile(r"\blogin\s+\S+\s+password\s+(\S+)"),
    re.compile(r"\b(?:curl|wget|http)\b[^\n]*?\s(?:-u|--user)[\s=]+[\"']?[^\s:\"']+:([^\s\"']+)"),
    re.compile(r"\b(?:sqlcmd|psql|mysql|mysqldump|mongo|mongosh|redis-cli|sshpass|ldapsearch|isql|osql|bcp|smbclient|docker|az|mariadb)\b[^\n]*?\s(?:-P|-p|-a|-w|--password|--pass)[\s=]?\s*(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"']{6,}))"),
    re.compile(r"--(?:password|passwd|token|api-key|secret|auth-token)[\s=]+(?:\"([^\"\n]+)\"|'([^'\n]+)'|([^\s\"']{6,}))"),
)
PROSE = re.compile(
    r"(?:\b(?:password|passphrase|passcode|pass phrase|secret key|secret|api key|access key|auth token|token|pin)\b(?:\s+(?:for|of|on|to|in)\s+[^.\n,;:]{1,40}?)?\s+(?:is|was|remains|stays|=|equals)"
    r"|\b(?:kennwort|passwort|schlüssel|zugangsschlüssel|geheimnis|token)\b[^.\n]{0,60}?\s+(?:lautet|ist|heißt)"
    r"|\b(?:contraseña|contrasena|clave(?: de acceso)?|secreto|token)\b[^.\n]{0,60}?\s+(?:es|era|sigue siendo)"
    r"|\b(?:paste|use|enter|type|try|send|with|pass)\s+(?:the\s+)?(?:password|passphrase|token|key|secret|api key)"
    r"|\b(?:mot de passe)\b[^.\n]{0,60}?\s+(?:est)"
    r")\s*:?\s+[\"'`]?([^\s\"'`<>()]+)",
    re.I,
)
# A name and the value it is given: code, JSON, environment, headers, connection strings.
ASSIGN = re.compile(
    r"(?<![A-Za-z0-9_$])([A-Za-zÀ-ÿ_$][\wÀ-ÿ.$-]{0,60})[\"']?\s*(?::\s*&?[A-Za-z_][\w.?]*(?:<[^<>=]*>)?(?:\[[^\[\]=]*\])*(?:\s*\|\s*\w+)*\s*(?==))?(?::=|=>|[:=])\s*(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([^\s\"'`;,(){}\[\]<>][^\s\"'`;,<>]*))"
)
RUST_DEFAULT = re.compile(r"#\[\w+\(\"((?:[^\"\\]|\\.)*)\"\)\]\s*(?:mut\s+)?(\w+)\s*:")
JAVA_DEFAULT = re.compile(r"@\w+\((?:\w+\s*=\s*)?\"((?:[^\"\\]|\\.)*)\"\)\s*(?:final\s+)?[\w<>\[\], ?.]+?\s(\w+)\s*(?=[,)])")
LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`")
GLUE = re.compile(r"(?<=[\w+/=_.!#?*%&@-])([\"'`])\s*(?:\+|\.\.?|~|&|\|\||<>|\\\s*\n)?\s*\1(?=[\w+/=_.!#?*%&@-])")

PASSWORD_NAME = re.compile(r"pass(?:word|wd|phrase|code)?$|^pwd$|pwd$|(?:^|[a-z_])pw$|^pw|kennwort$|passwort$|contrase[nñ]a$|clave$|^pass|_pass$|passwd|password$|mot_?de_?passe$")
SECRET_NAME = re.compile(r"secret$|secret_?key$|api_?key$|auth_?key$|access_?key$|signing_?key$|private_?key$|encryption_?key$|master_?key$|account_?key$|shared_?key$|token$|credentials?$|^bearer$|^authorization$|webhook_?secret$|geheimnis$|schl[uü]ssel$|client_?secret$|^sas$|^auth$|^apikey|secret_?value$|_secret_|x-api-key$|x-auth-token$")
WEAK_NAME = re.compile(r"key$|^cred$|^auth")
NOT_SECRET_NAME = re.compile(r"(?:type|name|field|scheme|length|len|size|count|url|uri|path|file|id|uuid|policy|hint|label|format|header_?name|env|ttl|expiry|prefix|column|public_?key|version|limit|min|max|regex|pattern|provider|store|ref|arn)$|^(?:etag|sha\d+|checksum|digest|revision|commit|trace|request_id|build_id|integrity|cache_?key|primary_?key|foreign_?key|sort_?key|partition_?key|public_?key)$")
REFERENCE = re.compile(
    r"^\$|^\$\{|^%[A-Za-z_]+%$|^\{+[^{}]*\}+$|^<[^<>]*>|^\[|^(?:env|vault|ssm|secretsmanager|kms|arn|file|op|keyring|aws-sm|gcp-sm|sops|ref|secret|bao)[:/]|^(?:process\.env|os\.environ|os\.getenv|getenv|ENV|System\.getenv|std::env|env|config|settings|vault|secrets|self|this|request|args|opts?|params)\b[.\[(:]"
    r"|^@|^\$\(|^#\{|^\*+$|^%s$|^%\(|^\{\{"
)
#: Words that stand for a secret not given, and words for the thing itself, of which stand-ins consist.
STAND_IN = frozenset({
    "redacted", "placeholder", "change", "changeme", "replace", "replaceme", "your", "example", "dummy", "todo", "fixme", "tbd", "insert", "sample", "masked", "hidden", "removed", "goes", "here",
    "undefined", "unset", "put", "enter", "fill", "null", "none", "nil", "true", "false", "unknown", "empty", "default", "optional", "required", "vault", "xxxx", "xxx",
})
THING = frozenset({
    "password", "passwd", "pass", "pwd", "secret", "token", "key", "api", "apikey", "access", "auth", "user", "username", "db", "database", "kennwort", "contraseña", "credential", "credentials", "bearer", "basic",
    "primary", "oauth", "oauth2", "string", "str", "value", "the", "from", "team", "me", "this", "not", "set", "in", "my", "a", "an", "to", "na", "of", "name", "real",
})
#: A documented example ends in the word itself.
EXAMPLE = re.compile(r"EXAMPLE(?:KEY)?\Z")
_PARTS = re.compile(r"[A-Za-zÀ-ÿ]+|\d+")
_HUMPS = re.compile(r"(?<=[a-zß-ÿ])(?=[A-ZÀ-Þ])")
HEX = re.compile(r"^[0-9a-fA-F]+$")
UUID = re.compile(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$")


def entropy(s: str) -> float:
    """Shannon entropy, bits per character."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def is_placeholder(value: str, vocabulary: str) -> bool:
    """Empty, masked, a reference to somewhere else, or words that stand for a secret and nothing besides."""
    v = value.strip()
    if len(v) < 4 or REFERENCE.search(v) or EXAMPLE.search(v) or "<" in v or ">" in v:
        return True
    body = re.sub(r"[^A-Za-z0-9]", "", v)
    if len(body) < 3 or len(set(body)) <= 2:
        return True
    tail = re.sub(r"^(?:AKIA|ASIA|AIza|gh[opsur]_|glpat-|npm_|sk_(?:live|test)_|xox[a-z]-|sk-)", "", v)
    if tail and len(set(re.sub(r"[-_.]", "", tail).lower())) <= 2:
        return True
    low = v.lower()
    if low in THING or low in STAND_IN:
        return True
    words = [w.lower() for w in _PARTS.findall(_HUMPS.sub("-", v))]
    stands = [w for w in words if w in STAND_IN]
    rest = [w for w in words if w not in STAND_IN and w not in THING]
    if not rest:
        return not any(w.isdigit() for w in words) and not re.search(r"[!?#%&*@$]", v)
    if not stands:
        return False
    # What is left beside the stand-in must be words too: a key that contains "removed" is a key.
    return not re.search(r"\d", v) and max(naturalness.unnatural(w, vocabulary) for w in rest) <= 0


def weigh(value: str, context: str, vocabulary: str) -> float:
    """Sum of the measure, the context's weight and the form of the value; a secret where positive."""
    total = naturalness.unnatural(value, vocabulary) + CONTEXT[context]
    if context in ("password", "secret", "prose"):
        if re.search(r"\d|[!?#%&*@$^+=~]", value):
            total += MIXED
        elif context == "password" and len(value) >= 16 and re.fullmatch(r"[A-Za-z]+(?:[_-][A-Za-z]+){2,}", value):
            total += PASSPHRASE
    return total


def context_of(name: str) -> str | None:
    """What a name says of the value given to it."""
    low = re.sub(r"^[$&@]+", "", name).strip("-_.").lower()
    low = low.rsplit(".", 1)[-1].replace("-", "_")
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name.strip("$")).lower().replace("-", "_")
    if NOT_SECRET_NAME.search(low) or NOT_SECRET_NAME.search(snake):
        return None
    for context, pattern in (("password", PASSWORD_NAME), ("secret", SECRET_NAME)):
        if pattern.search(low) or pattern.search(snake):
            return context
    return "weak" if WEAK_NAME.search(low) else None


def is_secret(name: str, value: str, vocabulary: str) -> bool:
    """Whether ``value`` given to ``name`` is a usable secret."""
    v, context = value.strip(), context_of(name)
    if context is None or is_placeholder(v, vocabulary) or re.search(r"\(\)?$", v):
        return False
    if UUID.match(v) and context != "secret":
        return False
    if context != "password" and (re.search(r"\s", v) or re.fullmatch(r"[a-z_-]+(?:[/.:][a-z_-]+)*", v) or re.search(r"[()\[\]]", v)):
        return False
    if context == "password" and re.search(r"\s", v):
        context = "weak"
    elif context == "weak":
        # Hexadecimal digits are digests and ids, unless an environment variable that is a key has 128 bits of them.
        if len(v) < 16 or (HEX.match(v) and not (name.isupper() and len(v) >= 32)):
            return False
        context = "secret" if HEX.match(v) else context
    return weigh(v, context, vocabulary) > 0


def is_opaque(value: str, vocabulary: str) -> bool:
    """A long random string of mixed characters, recognisable without any name."""
    if len(value) < 24 or not re.fullmatch(r"[A-Za-z0-9+/=_-]+", value) or HEX.match(value) or UUID.match(value):
        return False
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return classes == 3 and weigh(value, "none", vocabulary) > 0 and entropy(value) >= 3.7 and not is_placeholder(value, vocabulary)


def _decoded(value: str) -> str | None:
    """Printable text hidden in base64 or hexadecimal digits."""
    for decode in (lambda v: base64.b64decode(v + "=" * (-len(v) % 4), validate=True), lambda v: binascii.unhexlify(v)):
        try:
            text = decode(value.replace("-", "+").replace("_", "/")).decode("utf-8")
        except (ValueError, binascii.Error):
            continue
        if len(text) >= 6 and text.isprintable():
            return text
    return None


def _usable(value: str, context: str, vocabulary: str) -> bool:
    return not is_placeholder(value, vocabulary) and weigh(value, context, vocabulary) > 0


def _basic(value: str, vocabulary: str) -> bool:
    text = _decoded(value)
    return bool(text) and ":" in text and _usable(text.split(":", 1)[1], "basic", vocabulary)


def _first(m: re.Match, groups: tuple[int, ...]) -> int:
    return next((g for g in groups if m[g] is not None), 0)


def _scan(text: str, vocabulary: str, signature: bool, depth: int = 0) -> Iterator[tuple[int, int, str]]:
    """Spans of secrets in one joined text, possibly overlapping."""
    closed = [m.span() for m in OPAQUE_BLOCK.finditer(text)]
    inside = lambda a: any(s <= a < e for s, e in closed)
    for m in PEM.finditer(text):
        body = re.sub(r"(?:\\n|\s|\*|#|//)+", "", m[2])
        body = re.sub(r"(?:Proc-Type|DEK-Info):[^\n]*", "", body)
        if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 16 and not re.search(r"redacted|\.\.\.|<", body, re.I) and len(set(body)) > 4:
            yield m.start(2), m.end(2), "private_key"
    for m in ISSUED.finditer(text):
        if inside(m.start()):
            continue
        # The general shape must be a string that no words make up; a known prefix says more.
        general = bool(GENERAL.match(m[0]))
        if (not general or re.search(r"\d", m[0])) and _usable(m[0], "general" if general else "issued", vocabulary):
            yield *m.span(), "token"
    for m in URI.finditer(text):
        if _usable(unquote(m[2]), "uri", vocabulary):
            yield *m.span(2), "uri"
    for m in BASIC.finditer(text):
        if _basic(m[1], vocabulary):
            yield *m.span(1), "header"
    for m in BEARER.finditer(text):
        if not inside(m.start(1)) and _usable(m[1], "header", vocabulary):
            yield *m.span(1), "header"
    for m in SIGNED.finditer(text):
        if _usable(m[1], "signed", vocabulary):
            yield *m.span(1), "signed_link"
    for pattern in COMMANDS:
        for m in pattern.finditer(text):
            g = _first(m, tuple(range(1, (m.re.groups or 0) + 1)))
            if g and not re.search(r"[()]", m[g]) and _usable(m[g], "command", vocabulary):
                yield *m.span(g), "command"
    for m in PROSE.finditer(text):
        value = m[1].rstrip(".,;:")
        if len(value) >= 6 and not re.fullmatch(r"\d+", value) and _usable(value, "prose", vocabulary):
            yield m.start(1), m.start(1) + len(value), "prose"
    for m in ASSIGN.finditer(text):
        g = _first(m, (2, 3, 4, 5))
        if not g or inside(m.start(g)):
            continue
        value, start = m[g], m.start(g)
        if g == 5:
            if signature or re.match(r"[\w.]+\(", value):
                continue
            value = value.rstrip(".,;:)")
        if is_secret(m[1], value, vocabulary):
            yield start, start + len(value), "assignment"
    if signature:
        for pattern in (RUST_DEFAULT, JAVA_DEFAULT):
            for m in pattern.finditer(text):
                if is_secret(m[2], m[1], vocabulary):
                    yield *m.span(1), "assignment"
    for m in LITERAL.finditer(text):
        g = _first(m, (1, 2, 3))
        if not g or len(m[g]) < 16 or inside(m.start(g)):
            continue
        before = text[max(0, m.start() - 60) : m.start()]
        if re.search(r"\b(?:etag|sha\d*|checksum|digest|revision|commit|trace|build_id|request_id|integrity)\w*\W[^,]*$", before, re.I):
            continue
        if signature and is_opaque(m[g], vocabulary):
            yield *m.span(g), "opaque"
        if depth == 0 and (plain := _decoded(m[g])) and any(True for _ in _scan(plain, vocabulary, False, 1)):
            yield *m.span(g), "encoded"


def find_secrets(text: str | None, signature: bool = False, vocabulary: str | None = None) -> list[tuple[int, int, str]]:
    """Non-overlapping (start, end, kind) of the secrets in ``text``; literals in pieces give one span each."""
    if not text:
        return []
    vocabulary = vocabulary or vocab.default_path()
    glue = [m.span() for m in GLUE.finditer(text)]
    joined, place = text, None
    if glue:
        keep, last = [], 0
        for a, b in glue:
            keep += range(last, a)
            last = b
        place = keep + list(range(last, len(text))) + [len(text)]
        joined = "".join(text[i] for i in place[:-1])
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(_scan(joined, vocabulary, signature), key=lambda x: (x[0], -x[1])):
        if out and a < out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2])
        elif b > a:
            out.append((a, b, kind))
    if place is None:
        return out
    pieces = []
    for a, b, kind in out:
        start = place[a]
        for i in range(a, b):
            if i + 1 == b or place[i + 1] != place[i] + 1:
                pieces.append((start, place[i] + 1, kind))
                start = place[i + 1]
    return pieces


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each character of a secret becomes one mask character; line ends stay."""
    parts, last = [], 0
    for a, b, _ in spans:
        parts += [text[last:a], re.sub(r"[^\r\n]", MASK, text[a:b])]
        last = b
    return "".join([*parts, text[last:]])


def redacted_fields(df: DataFrame, key: str, fields: dict[str, bool], vocabulary: str | None = None) -> DataFrame:
    """(key, field_name, redacted, kinds) of every field that holds a secret.

    ``fields`` maps a column to whether it is a declaration (defaults of parameters) rather than prose.
    Null and empty fields hold none; repeated rows come out once; whole texts are read, of any length.
    """
    ship_package(df.sparkSession)
    names, flags = list(fields), list(fields.values())
    path = vocabulary or vocab.default_path()
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("field_name", T.StringType()),
        T.StructField("redacted", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())),
    ])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, name in enumerate(names):
                for k, text in zip(b[key], b[name], strict=True):
                    if text and (spans := find_secrets(text, flags[i], path)):
                        rows.append((k, name, mask(text, spans), sorted({s[2] for s in spans})))
            yield pd.DataFrame(rows, columns=[key, "field_name", "redacted", "kinds"])

    found = df.select(key, *names).where(F.greatest(*(F.length(n) for n in names)) > 0)
    return found.mapInPandas(scan, schema).distinct()
