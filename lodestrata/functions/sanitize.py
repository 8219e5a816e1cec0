"""Personal data in text: detection as SQL, redaction with checksum-gated replacement, prompt guarding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import checksums
from lodestrata.runtime import ship_package


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    label: str
    pattern: str
    check: str | None = None
    #: Which group of the pattern is the value; 0 is all of it.
    group: int = 0


#: The ten rules in their order; the later ones see the output of the earlier ones.
RULES = (
    Rule("Email", "General", "EMAIL", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"),
    Rule("InternationalPhone", "General", "PHONE", r"\+[1-9]\d{1,14}\b"),
    Rule("IPv4Public", "General", "IP_ADDR", r"\b(?:[1-9]\d?|1\d\d|2[01]\d|22[0-3])(?:\.(?:1?\d{1,2}|2[0-4]\d|25[0-5])){3}\b"),
    Rule("AuthorAnnotation", "General", "AUTHOR", r"@author\s+[\w\.\-]+(?:\s+<[^>]+>)?"),
    Rule("BrazilCPF", "Latam", "CPF", r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "cpf"),
    Rule("BrazilCNPJ", "Latam", "CNPJ", r"\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b", "cnpj"),
    Rule("US_SSN", "Europe", "SSN", r"\b\d{3}-\d{2}-\d{4}\b", "ssn"),
    Rule("CreditCardPAN", "FinTech", "CREDIT_CARD", r"\b(?:\d{4}[ -]?){3,4}\d{1,4}\b", "luhn"),
    Rule("BrazilCNS", "HealthTech", "HEALTH_ID", r"\b[12789]\d{2}\.?\d{4}\.?\d{4}\.?\d{4}\b", "cns"),
    Rule("MAC_Address", "Industrial", "MAC_ADDR", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}(?:[0-9A-Fa-f]{2})\b"),
)
#: Secrets go before the identifiers, so that these find nothing within them. The catalogue is our own.
SECRETS = (
    Rule("PrivateKey", "Secret", "PRIVATE_KEY", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s\\]+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("AwsAccessKey", "Secret", "AWS_KEY", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    Rule("JsonWebToken", "Secret", "JWT_TOKEN", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("DatabasePassword", "Secret", "DB_PASSWORD", r"\b[a-z][a-z0-9+.-]*://[^\s:/@]*:([^\s/\"'<>]+)@[A-Za-z0-9\[]", None, 1),
    Rule("GitHubToken", "Secret", "GITHUB_TOKEN", r"\bgh[opsur]_[A-Za-z0-9]{30,}\b"),
)
ALL_RULES = (*SECRETS, *RULES)
_CHECKS = {
    "cpf": lambda d, m: _mod11(d, 11, checksums.CPF_WEIGHTS),
    "cnpj": lambda d, m: _mod11(d, 14, checksums.CNPJ_WEIGHTS),
    "ssn": lambda d, m: m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000",
    "luhn": lambda d, m: 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
    "cns": lambda d, m: _cns(d),
}


def _mod11(d: str, length: int, weights) -> bool:
    if len(d) != length or len(set(d)) == 1:
        return False
    for w in weights:
        rest = sum(int(c) * k for c, k in zip(d, w, strict=False)) % 11
        if int(d[len(w)]) != (0 if rest < 2 else 11 - rest):
            return False
    return True


def _cns(d: str) -> bool:
    if len(d) != 15:
        return False
    if d[0] in "789":
        return sum(int(c) * w for c, w in zip(d, range(15, 0, -1), strict=True)) % 11 == 0
    if d[0] not in "12":
        return False
    total = sum(int(c) * w for c, w in zip(d, range(15, 4, -1), strict=False))
    check = -total % 11
    return d == (f"{d[:11]}001{-(total + 2) % 11}" if check == 10 else f"{d[:11]}000{check}")


def add_rule(rules: tuple[Rule, ...], rule: Rule) -> tuple[Rule, ...]:
    """The rules with one more; a pattern that does not compile is ignored."""
    try:
        re.compile(rule.pattern)
    except re.error:
        return rules
    return (*rules, rule)


def correlation_hash(text: Column) -> Column:
    """Four hexadecimal digits that let equal values be recognised as equal."""
    return F.substring(F.sha2(text, 256), 1, 4)


def detect(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, label, match) of every occurrence in the raw text; one scan, no Python."""

    def matches(r: Rule) -> Column:
        every = F.regexp_extract_all(F.col(text), F.lit(r.pattern), F.lit(r.group))
        kept = F.filter(every, checksums.VALIDATORS[r.check]) if r.check else every
        return F.transform(kept, lambda m: F.struct(F.lit(r.label).alias("label"), m.alias("match")))

    found = [matches(r) for r in rules]
    return df.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(*found)).alias("f")).select(key, "f.label", "f.match")


def redact_text(text: str | None, rules: tuple[Rule, ...] = ALL_RULES) -> str | None:
    """Secrets, then identifiers that pass their checksum, become [REDACTED_LABEL:hash]."""
    if text is None:
        return None
    for r in rules:

        def put(m: re.Match, r: Rule = r) -> str:
            value = m[r.group]
            if r.check and not _CHECKS[r.check](re.sub(r"[^0-9]", "", m[0]), m[0]):
                return m[0]
            marked = f"[REDACTED_{r.label}:{hashlib.sha256(value.encode()).hexdigest()[:4]}]"
            return m[0][: m.start(r.group) - m.start()] + marked + m[0][m.end(r.group) - m.start() :]

        text = re.sub(r.pattern, put, text)
    return text


def redact(df: DataFrame, text: str, out: str, rules: tuple[Rule, ...] = ALL_RULES) -> DataFrame:
    """Adds the redacted text; null stays null."""
    ship_package(df.sparkSession)

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: redact_text(t, rules), na_action="ignore")

    return df.withColumn(out, run(F.col(text)))


def redaction_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\[REDACTED_"))


#: The tag around untrusted text, and control tokens with what makes them harmless.
GUARD_TAG = "untrusted_code_context"
CONTROL_TOKENS = {
    "<|im_start|>": "[NEUTRALIZED_TOKEN_IM_START]", "<|im_end|>": "[NEUTRALIZED_TOKEN_IM_END]", "[INST]": "[NEUTRALIZED_TOKEN_INST]",
    "[/INST]": "[NEUTRALIZED_TOKEN_SLASH_INST]", "<<SYS>>": "[NEUTRALIZED_TOKEN_SYS]", "<</SYS>>": "[NEUTRALIZED_TOKEN_SLASH_SYS]",
}


def prompt_guard(text: Column, origin: Column, file: Column, symbol: Column) -> Column:
    """Text wrapped in a tag, its own such tags escaped and control tokens made harmless."""
    closing = F.replace(text, F.lit(f"</{GUARD_TAG}>"), F.lit(f"&lt;/{GUARD_TAG}&gt;"))
    escaped = F.replace(closing, F.lit(f"<{GUARD_TAG}"), F.lit(f"&lt;{GUARD_TAG}"))
    quiet = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), CONTROL_TOKENS.items(), escaped)
    return F.concat(F.lit(f'<{GUARD_TAG} origin="'), origin, F.lit('" file="'), file, F.lit('" symbol="'), symbol, F.lit('">\n'), quiet, F.lit(f"\n</{GUARD_TAG}>"))


def shannon_entropy(text: Column) -> Column:
    """Bits per byte of the UTF-8 form; 0 for the empty text. Equal bytes lie together once sorted, so one pass counts them."""
    pairs = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), F.lit(1))
    n = F.size(pairs)
    part = lambda run: F.when(run > 0, run * F.log2(run)).otherwise(0.0)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(at: Column, x: Column) -> Column:
        same = at["last"] == x
        return F.struct(x.alias("last"), F.when(same, at["run"] + 1.0).otherwise(1.0).alias("run"), F.when(same, at["sum"]).otherwise(at["sum"] + part(at["run"])).alias("sum"))

    total = F.aggregate(F.sort_array(pairs), start, step, lambda at: at["sum"] + part(at["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)
