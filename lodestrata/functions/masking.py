"""Code shielded from translation, messages in several languages, host paths kept out of results."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words after which a declared name follows, and endings of names of components.
DECLARING = ("class", "interface", "struct", "enum", "fn", "function", "def", "public", "private", "protected")
COMPONENTS = ("Repository", "Service", "Controller", "Handler", "Entity", "DTO", "Gateway", "Client", "Broker")
#: One character from a private area of the code space per shielded span, so that no text can look like one by chance.
FIRST_MARK, LAST_MARK = 0xF0000, 0xFFFFD
_TOKEN = re.compile(r"(?P<quoted>`[^`]+`)|(?P<word>[A-Za-z_]\w*)|(?P<gap>\s+)|(?P<other>.)", re.S)
_BUNDLES: dict[str, dict[str, str]] = {"en": {}}


@dataclass(frozen=True)
class Masked:
    """A text with one mark per shielded span, and the spans in order."""

    text: str
    spans: tuple[str, ...]

    def restore(self, text: str | None = None) -> str:
        """The spans put back into this or a translated text; marks may have moved, been repeated or lost."""
        return "".join(self.spans[ord(c) - FIRST_MARK] if FIRST_MARK <= ord(c) < FIRST_MARK + len(self.spans) else c for c in (self.text if text is None else text))


def code_spans(text: str) -> list[tuple[int, int]]:
    """Where code stands in prose: quoted code, declared names with the word before them, names of components."""
    tokens = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text)]
    found: list[tuple[int, int]] = []
    i = 0
    while i < len(tokens):
        kind, start, end = tokens[i]
        word = text[start:end]
        if kind == "quoted":
            found.append((start, end))
        elif kind == "word" and word in DECLARING and i + 2 < len(tokens) and tokens[i + 1][0] == "gap" and tokens[i + 2][0] == "word":
            found.append((start, tokens[i + 2][2]))
            i += 2
        elif kind == "word" and word[0].isupper() and word.endswith(COMPONENTS):
            found.append((start, end))
        i += 1
    return found


def shield(text: str) -> Masked:
    """The text with its code replaced by marks. Characters of the private area that the text has of its own are shielded too."""
    spans = code_spans(text)
    taken = {i for a, b in spans for i in range(a, b)}
    spans += [(i, i + 1) for i, c in enumerate(text) if FIRST_MARK <= ord(c) <= LAST_MARK and i not in taken]
    spans.sort()
    parts, last = [], 0
    for k, (a, b) in enumerate(spans):
        parts += [text[last:a], chr(FIRST_MARK + k)]
        last = b
    return Masked("".join([*parts, text[last:]]), tuple(text[a:b] for a, b in spans))


def register_bundle(locale: str, messages: dict[str, str]) -> None:
    _BUNDLES.setdefault(locale, {}).update(messages)


def message(key: str, locale: str = "en", **values: object) -> str:
    """A message in a language, else in English, else its key; {name} is filled in."""
    text = _BUNDLES.get(locale, {}).get(key) or _BUNDLES["en"].get(key) or key
    return re.sub(r"\{(\w+)\}", lambda m: str(values.get(m[1], m[0])), text)


def scrub_host_path(path: Column, root: str) -> Column:
    """Relative to the root; the home directory of a user elsewhere becomes [USER_HOME]."""
    inside = F.regexp_replace(path, "^" + re.escape(root.rstrip("/")) + r"[/\\]*", "")
    home = F.regexp_replace(path, r"^/(?:home|Users)/[^/]*", "[USER_HOME]")
    return F.when(path.startswith(root.rstrip("/")), inside).otherwise(home)
