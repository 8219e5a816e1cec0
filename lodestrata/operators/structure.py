"""Symbols and calls of languages with braces, from tokens and matching brackets.

A file is cut into tokens once; brackets are paired; then one walk over the tokens follows the nesting: what opens a
scope (types, namespaces, implementations, functions) is a symbol, a name before an argument list within a function is
a call. Nothing is guessed from line shapes, so spans are exact and strings and comments never count.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

#: Languages by extension, and the words that matter here.
LANGUAGES = {"js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "ts": "js", "tsx": "js", "mts": "js", "cts": "js", "rs": "rust", "go": "go", "java": "typed", "cs": "typed", "c": "typed", "h": "typed", "php": "php"}
TYPES = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait", "record": "class", "union": "struct"}
FUNCTIONS = {"js": ("function",), "rust": ("fn",), "go": ("func",), "typed": (), "php": ("function",)}
CONTROL = frozenset({"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "match", "loop", "select", "sizeof", "typeof", "new", "throw", "await", "yield", "in", "of", "case", "using", "lock", "fixed", "foreach", "synchronized", "delete", "void", "super", "function", "fn", "func", "import", "elseif", "declare", "isset", "unset", "array", "list", "echo", "print", "go", "defer", "unsafe", "where", "when", "default", "assert"})
HIDDEN = frozenset({"private", "protected"})
BINDING = {"js": ("let", "const", "var"), "rust": ("let",), "go": ("var", "const"), "typed": (), "php": ()}
_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|(?<![^\n])[ \t]*\#(?:include|define|if|ifdef|ifndef|else|elif|endif|pragma|undef|error)\b(?:[^\\\n]|\\[\s\S])*)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|$)|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|'(?:[^'\\\n]|\\.)+')"
    r"|(?P<word>[#$@]?[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<sign>=>|->|::|:=|\?\.|&&|\|\||.)"
)
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Symbol:
    fqsn: str
    name: str
    kind: str
    public: bool
    first: int
    last: int
    start: int
    end: int


@dataclass
class Structure:
    symbols: list[Symbol] = field(default_factory=list)
    #: caller, name, expression, edge kind, line, column
    calls: list[tuple[str, str, str, str, int, int]] = field(default_factory=list)
    bound: set[str] = field(default_factory=set)
    balanced: bool = True


class Reader:
    """The tokens of a file, its brackets, and the walk over them."""

    def __init__(self, path: str, text: str, language: str):
        self.path, self.text, self.language = path, text, language
        self.out = Structure()
        #: What joins a member to its object; an arrow does so in C and PHP only.
        self.links = {".", "::", "?."} | ({"->"} if path.endswith((".c", ".h", ".php")) else set())
        self.arrows: set[str] = set()
        self.kind: list[str] = []
        self.word: list[str] = []
        self.at: list[int] = []
        for m in _TOKEN.finditer(text):
            if m.lastgroup != "skip":
                self.kind.append(m.lastgroup)
                self.word.append(m[0])
                self.at.append(m.start())
        self.lines = [m.start() for m in re.finditer(r"\n", text)]
        self.partner: dict[int, int] = {}
        stack: list[int] = []
        for i, (k, w) in enumerate(zip(self.kind, self.word, strict=True)):
            if k == "sign" and w in "([{":
                stack.append(i)
            elif k == "sign" and w in _PAIRS:
                while stack and self.word[stack[-1]] != _PAIRS[w]:
                    self.out.balanced = False
                    stack.pop()
                if stack:
                    self.partner[stack.pop()] = i
                else:
                    self.out.balanced = False
        if stack:
            self.out.balanced = False
            self.partner.update((i, len(self.word)) for i in stack)
        self.opening = {c: o for o, c in self.partner.items()}

    def line(self, offset: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.lines, offset) + 1

    def is_sign(self, i: int, sign: str) -> bool:
        return 0 <= i < len(self.word) and self.kind[i] == "sign" and self.word[i] == sign

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.word) and self.kind[i] == "word"

    def after_generics(self, i: int) -> int:
        """Past <...> at i, if there is one."""
        if not self.is_sign(i, "<"):
            return i
        depth = 0
        for j in range(i, min(i + 200, len(self.word))):
            w = self.word[j]
            depth += (w == "<") - (w == ">")
            if w in "{;" or depth == 0:
                return j + 1 if depth == 0 else i
        return i

    def body_after(self, i: int, end: int) -> tuple[int, int] | None:
        """Braces of a body that follows position i before any statement ends; arguments and types in brackets are passed."""
        while i < end:
            w = self.word[i]
            if self.kind[i] == "sign":
                if w == "{":
                    return i, min(self.partner.get(i, end), end)
                if w == ";" or w in ")}]":
                    return None
                if w in "([":
                    i = self.partner.get(i, end)
            i += 1
        return None

    def declare(self, scope: list[str], name: str, kind: str, first: int, last: int) -> str:
        begin = first
        while begin > 0 and self.is_word(begin - 1) and self.line(self.at[begin - 1]) == self.line(self.at[first]) and self.word[begin - 1] not in ("else", "return"):
            begin -= 1
        before = set(self.word[begin:first])
        hidden = bool(before & HIDDEN) or name.startswith(("_", "#")) or (self.language == "rust" and "pub" not in before) or (self.language == "go" and not name[:1].isupper())
        fqsn = "::".join([self.path, *scope, name])
        end = self.at[last] + 1 if last < len(self.at) else len(self.text)
        self.out.symbols.append(Symbol(fqsn, name, kind, not hidden, self.line(self.at[begin]), self.line(max(0, end - 1)), self.at[begin], end))
        return fqsn

    def parameters(self, opening: int) -> None:
        """Names bound by a parameter list: the last word of each part, or the first where a type follows."""
        close = self.partner.get(opening, len(self.word))
        part: list[int] = []
        i = opening + 1
        while i <= close and i <= len(self.word):
            ends = i == close or self.is_sign(i, ",")
            if ends:
                words = []
                for j in part:
                    if self.kind[j] == "sign" and self.word[j] in (":", "="):
                        break
                    if self.kind[j] == "word":
                        words.append(self.word[j])
                if words and words != ["void"]:
                    self.out.bound.add((words[0] if self.language == "go" else words[-1]).lstrip("$"))
                part = []
            elif i < len(self.word) and self.kind[i] == "sign" and self.word[i] in "([{":
                i = self.partner.get(i, close)
            else:
                part.append(i)
            i += 1

    def walk(self, i: int, end: int, scope: list[str], caller: str | None, in_type: bool) -> None:
        while i < end:
            step = self.declaration(i, end, scope, caller, in_type) if self.kind[i] == "word" else None
            if step is not None:
                i = step
                continue
            if self.kind[i] == "word":
                self.binding(i)
                if caller and self.is_call(i):
                    self.call(i, caller)
            i += 1

    def binding(self, i: int) -> None:
        w = self.word[i]
        if w in BINDING[self.language] and self.is_word(i + 1):
            at = i + 2 if self.word[i + 1] == "mut" else i + 1
            if self.is_word(at):
                self.out.bound.add(self.word[at])
        elif self.is_sign(i + 1, ":=") or (self.language == "typed" and self.is_word(i - 1) and self.word[i - 1] not in CONTROL and self.kind[i + 1 : i + 2] == ["sign"] and self.word[i + 1] in ("=", ";", ":") and w not in CONTROL):
            self.out.bound.add(w)

    def is_call(self, i: int) -> bool:
        after = self.after_generics(i + 1) if self.language in ("typed", "js") else i + 1
        if self.language == "rust" and self.is_sign(i + 1, "::") and self.is_sign(i + 2, "<"):
            after = self.after_generics(i + 2)
        return self.is_sign(after, "(") and self.word[i] not in CONTROL and not (i and self.word[i - 1] in ("new", "function", "fn", "func", "#", "@"))

    def call(self, i: int, caller: str) -> None:
        first = i
        while first >= 2 and self.kind[first - 1] == "sign" and self.word[first - 1] in self.links:
            back = first - 2
            if self.kind[back] == "sign" and self.word[back] in ")]":
                opening = self.opening.get(back)
                if opening is None:
                    break
                back = opening - 1 if self.is_word(opening - 1) else opening
            elif self.kind[back] == "sign":
                break
            first = back
        member = i > 0 and self.kind[i - 1] == "sign" and self.word[i - 1] in self.links
        text = re.sub(r"\s+", "", self.text[self.at[first] : self.at[i] + len(self.word[i])])
        line = self.line(self.at[i])
        column = self.at[first] - (self.lines[line - 2] + 1 if line > 1 else 0)
        self.out.calls.append((caller, self.word[i], text, "member_call" if member else "direct_call", line, max(0, column)))

    def function(self, name: str, first: int, opening: int, end: int, scope: list[str], caller: str | None, in_type: bool) -> int:
        """A function whose parameters open at ``opening``; returns where the walk goes on."""
        self.parameters(opening)
        close = self.partner.get(opening, end)
        body = self.body_after(close + 1, end)
        last = body[1] if body else close
        fqsn = self.declare(scope, name, "method" if in_type else "function", first, min(last, len(self.word) - 1))
        if body is None:
            return close + 1
        self.walk(body[0] + 1, body[1], [*scope, name], fqsn, False)
        return body[1] + 1

    def declaration(self, i: int, end: int, scope: list[str], caller: str | None, in_type: bool) -> int | None:
        w, lang = self.word[i], self.language
        if lang == "go" and w == "type" and self.is_word(i + 1) and self.is_word(self.after_generics(i + 2)) and self.word[self.after_generics(i + 2)] in ("struct", "interface"):
            kind, name = TYPES[self.word[self.after_generics(i + 2)]], self.word[i + 1]
            return self.type_of(i + 1, self.after_generics(i + 2) + 1, end, scope, caller, name, kind)
        if lang != "go" and w in TYPES and self.is_word(i + 1) and not self.is_sign(i - 1, "."):
            return self.type_of(i + 1, i + 2, end, scope, caller, self.word[i + 1], TYPES[w])
        if lang == "rust" and w == "impl" and caller is None:
            body = self.body_after(i + 1, end)
            if body is None:
                return None
            words = [self.word[j] for j in range(self.after_generics(i + 1), body[0]) if self.kind[j] == "word"]
            names = words[words.index("for") + 1 :] if "for" in words else words
            self.walk(body[0] + 1, body[1], [*scope, names[0]] if names else scope, None, True)
            return body[1] + 1
        if w in FUNCTIONS[lang]:
            at, inside, within = i + 1, scope, in_type
            if lang == "go" and self.is_sign(at, "("):
                self.parameters(at)
                receiver = [self.word[j] for j in range(at + 1, self.partner.get(at, end)) if self.kind[j] == "word"]
                at, within = self.partner.get(at, end) + 1, True
                inside = [*scope, receiver[1] if len(receiver) > 1 else receiver[0]] if receiver else scope
            if self.is_sign(at, "*") or self.is_sign(at, "&"):
                at += 1
            if self.is_word(at):
                opening = self.after_generics(at + 1)
                if self.is_sign(opening, "("):
                    return self.function(self.word[at], at, opening, end, inside, caller, within)
            return None
        if (lang, w) == ("rust", "mod") or w == "namespace":
            body = self.body_after(i + 1, end) if self.is_word(i + 1) else None
            if body is not None:
                self.walk(body[0] + 1, body[1], [*scope, self.word[i + 1]], None, False)
                return body[1] + 1
        if lang == "js" and self.is_sign(i + 1, "=") and not self.is_sign(i - 1, "."):
            # A name bound to a function or an arrow.
            at = i + 2 + (self.word[i + 2 : i + 3] == ["async"])
            if self.word[at : at + 1] == ["function"]:
                opening = at + 1 + self.is_word(at + 1)
                if self.is_sign(opening, "("):
                    self.arrows.add(w)
                    return self.function(w, i, opening, end, scope, caller, in_type)
            if self.is_sign(at, "("):
                close = self.partner.get(at, end)
                arrow = next((j for j in range(close + 1, min(close + 12, end)) if self.is_sign(j, "=>") or self.kind[j] == "sign" and self.word[j] in ";{"), None)
                if arrow is not None and self.is_sign(arrow, "=>"):
                    self.arrows.add(w)
                    if self.is_sign(arrow + 1, "{"):
                        return self.function(w, i, at, end, scope, caller, in_type)
                    self.parameters(at)
                    stop = arrow + 1
                    while stop < end and not (self.kind[stop] == "sign" and self.word[stop] in (";", ")", "}", "]", ",")):
                        stop = self.partner.get(stop, stop) + 1
                    fqsn = self.declare(scope, w, "function", i, min(stop, len(self.word) - 1))
                    self.walk(arrow + 1, min(stop, end), [*scope, w], fqsn, False)
                    return min(stop, end)
        method = (in_type and lang in ("js", "typed")) or (lang == "typed" and caller is None)
        if method and w not in CONTROL and not self.is_sign(i - 1, "."):
            opening = self.after_generics(i + 1)
            if self.is_sign(opening, "(") and (lang == "js" or in_type or self.is_word(i - 1) or self.is_sign(i - 1, "*")):
                close = self.partner.get(opening, end)
                body = self.body_after(close + 1, end)
                bare = self.is_sign(close + 1, ";") and self.is_word(i - 1) and lang == "typed"
                # Between the parameters and the body stand throws clauses and types, nothing that makes it an expression.
                between = range(close + 1, body[0]) if body else ()
                if (body and not any(self.kind[j] == "sign" and self.word[j] in ("=", "=>", "&&", "||", "+", "(") for j in between)) or bare:
                    return self.function(w, i, opening, end, scope, caller, in_type)
        return None

    def type_of(self, at: int, after: int, end: int, scope: list[str], caller: str | None, name: str, kind: str) -> int | None:
        body = self.body_after(after, end)
        if body is None or (self.is_sign(after, "(") and kind != "class") or any(self.is_sign(j, "=") for j in range(after, body[0])):
            return None
        self.declare(scope, name, kind, at, min(body[1], len(self.word) - 1))
        if self.language == "typed" and kind == "struct" and caller is None and self.path.endswith((".c", ".h")):
            return body[1] + 1
        self.walk(body[0] + 1, body[1], [*scope, name], None, True)
        return body[1] + 1


def read(path: str, text: str) -> Structure:
    """Symbols and calls of a file. Symbols of one name in one scope are told apart by their signatures."""
    reader = Reader(path, text, LANGUAGES[path.rsplit(".", 1)[-1].lower()])
    reader.walk(0, len(reader.word), [], None, False)
    out = reader.out
    out.bound -= reader.arrows
    same: dict[str, int] = {}
    for s in out.symbols:
        same[s.fqsn] = same.get(s.fqsn, 0) + 1
    for s in out.symbols:
        if same[s.fqsn] > 1:
            s.fqsn += f"::<signature:{hashlib.sha256(signature(text, s).encode()).hexdigest()[:12]}>"
    return out


def signature(text: str, s: Symbol) -> str:
    """The declaration up to its body, in one line."""
    head = re.split(r"\{|;", text[s.start : s.end], maxsplit=1)[0]
    return re.sub(r"\s+", " ", head).strip()
