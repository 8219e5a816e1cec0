"""Parsing-expression grammars: a small notation and a packrat parser.

Notation, one rule per ``name = expression``:

    'x'    literal, then white space     "word"  keyword, then white space     `re`  pattern, then white space
    ~      in front of one of these: no white space after it
    a b    sequence     a / b  ordered choice     a* a+ a?  greedy, never given back     !a &a  look ahead

The same grammar is used in two ways. ``Packrat`` memorises every rule at every position, so it runs in
linear time, and knows the furthest position at which anything was expected. For mere acceptance the parts
of a grammar that do not recurse are compiled to single patterns of atomic groups, which have the semantics
of ordered choice; a full run follows only where the input is rejected.
"""

from __future__ import annotations

import functools
import re

import regex

FAIL = -1


class Node:
    __slots__ = ("kind", "value", "kids", "first")

    def __init__(self, kind: str, value=None, kids: tuple[Node, ...] = (), first: set[str] | None = None):
        self.kind, self.value, self.kids, self.first = kind, value, kids, first


_LEX = regex.compile(r"\s+|\#[^\n]*\n|(?P<rule>^\w+)\s*=(?!=)|(?P<name>\w+)|(?P<term>~?(?:'(?:[^'\\]|\\.)+'|\"[^\"]+\"|`[^`]+`))|(?P<op>[/*+?!&()])", regex.M)


class Grammar:
    """Rules by name. ``space`` is skipped after every terminal; ``boundary`` must not follow a keyword."""

    def __init__(self, text: str, space: str, start: str = "file", boundary: str = r"[\w$]"):
        self.space, self.start, self.boundary = space, start, boundary
        self.rules: dict[str, Node] = {}
        tokens, at = [], 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise ValueError(f"grammar: {text[at:at + 40]!r}")
            at = m.end()
            if m.lastgroup:
                tokens.append((m.lastgroup, m[m.lastgroup]))
        i = 0
        while i < len(tokens):
            kind, name = tokens[i]
            if kind != "rule":
                raise ValueError(f"grammar: expected a rule at {tokens[i : i + 5]}")
            self.rules[name], i = self._choice(tokens, i + 1)
        missing = {n.value for r in self.rules.values() for n in self._walk(r) if n.kind == "ref"} - set(self.rules)
        if missing or start not in self.rules:
            raise ValueError(f"grammar: no rule {missing or start}")

    def _walk(self, node: Node):
        yield node
        for k in node.kids:
            yield from self._walk(k)

    def _choice(self, t, i):
        kids = []
        while True:
            seq = []
            while i < len(t) and t[i][0] != "rule" and t[i][1] not in ("/", ")"):
                node, i = self._item(t, i)
                seq.append(node)
            kids.append(seq[0] if len(seq) == 1 else Node("seq", None, tuple(seq)))
            if i < len(t) and t[i] == ("op", "/"):
                i += 1
                continue
            return (kids[0] if len(kids) == 1 else Node("choice", None, tuple(kids))), i

    def _item(self, t, i):
        kind, value = t[i]
        if value in ("!", "&") and kind == "op":
            node, i = self._item(t, i + 1)
            return Node("not" if value == "!" else "and", None, (node,)), i
        if value == "(" and kind == "op":
            node, i = self._choice(t, i + 1)
            i += 1
        elif kind == "name":
            node, i = Node("ref", value), i + 1
        elif kind == "term":
            lead = value.lstrip("~")
            node, i = Node("term", self._terminal(value), first={lead[2] if lead[1] == "\\" else lead[1]} if lead[0] != "`" else None), i + 1
        else:
            raise ValueError(f"grammar: unexpected {t[i]}")
        while i < len(t) and t[i][0] == "op" and t[i][1] in "*+?":
            node, i = Node({"*": "star", "+": "plus", "?": "opt"}[t[i][1]], None, (node,)), i + 1
        return node, i

    def _terminal(self, text: str) -> str:
        raw = text[0] == "~"
        body = text[1:] if raw else text
        inner = body[1:-1]
        if body[0] == "'":
            pattern = regex.escape(inner.replace("\\'", "'"), literal_spaces=True)
        elif body[0] == '"':
            pattern = f"{inner}(?!{self.boundary})"
        else:
            pattern = f"(?>{inner})"
        return pattern if raw or not self.space else f"{pattern}{self.space}"

    @functools.cached_property
    def recursive(self) -> set[str]:
        """Rules that can reach themselves; the others are put in place of their references."""
        direct = {n: {x.value for x in self._walk(r) if x.kind == "ref"} for n, r in self.rules.items()}
        reach = {n: set(d) for n, d in direct.items()}
        changed = True
        while changed:
            changed = False
            for n, d in reach.items():
                more = set().union(*(reach[x] for x in d)) - d if d else set()
                if more:
                    d |= more
                    changed = True
        self.reach = reach
        return {n for n, d in reach.items() if n in d}

    def flat(self, name: str) -> bool:
        """Whether a rule can do without subroutines."""
        return name not in self.recursive and not self.reach[name] & self.recursive

    def _regex(self, node: Node) -> str:
        k = node.kind
        if k == "term":
            return node.value
        if k == "ref":
            if node.value in self.recursive:
                return f"(?&{node.value})"
            return f"(?>{self._regex(self.rules[node.value])})"
        if k == "seq":
            return "".join(self._regex(x) for x in node.kids)
        if k == "choice":
            return "(?>" + "|".join(self._regex(x) for x in node.kids) + ")"
        inner = self._regex(node.kids[0])
        return {"star": f"(?:{inner})*+", "plus": f"(?:{inner})++", "opt": f"(?:{inner})?+", "not": f"(?!{inner})", "and": f"(?={inner})"}[k]

    @functools.cached_property
    def packrat(self) -> Packrat:
        """Answers acceptance only; parts without recursion are single patterns."""
        return Packrat(self, True)

    @functools.cached_property
    def diagnosing(self) -> Packrat:
        """Follows every terminal, to know the furthest position."""
        return Packrat(self, False)

    def accepts(self, text: str) -> bool:
        return self.packrat.parse(text)[0]

    def failure(self, text: str) -> int | None:
        """None for accepted input, else the furthest position at which something was expected."""
        ok, furthest = self.diagnosing.parse(text)
        return None if ok else furthest


def _compile(pattern: str):
    try:
        return re.compile(pattern)
    except re.error:
        return regex.compile(pattern)


class Packrat:
    """The grammar as memorising functions."""

    def __init__(self, grammar: Grammar, fast: bool):
        self.g, self.is_fast = grammar, fast
        self.furthest, self.text, self.too_deep = 0, "", False
        self.memo: dict[str, dict[int, int]] = {}
        self.leading = _compile(grammar.space)
        self.refs = {n: self._rule(n) for n in grammar.rules}
        self.bodies = {n: self._make(r) for n, r in grammar.rules.items()}

    def _rule(self, name: str):
        memo = self.memo[name] = {}

        def run(at: int) -> int:
            end = memo.get(at)
            if end is None:
                end = memo[at] = self.bodies[name](at)
            return end

        return run

    def _plain(self, node: Node) -> bool:
        return not any(x.kind == "ref" and not self.g.flat(x.value) for x in self.g._walk(node)) and node.kind not in ("not", "and")

    def _first(self, node: Node) -> set[str] | None:
        """Characters a match can start with; None if unknown."""
        k = node.kind
        if k == "term":
            return node.first
        if k == "ref":
            if node.value in self.g.recursive and node.value in self._seen:
                return None
            self._seen.add(node.value)
            out = self._first(self.g.rules[node.value])
            self._seen.discard(node.value)
            return out
        if k == "seq":
            for x in node.kids:
                if x.kind in ("not", "and"):
                    continue
                if x.kind in ("opt", "star"):
                    return None
                return self._first(x)
            return None
        if k == "choice":
            sets = [self._first(x) for x in node.kids]
            return None if any(s is None for s in sets) else set().union(*sets)
        return self._first(node.kids[0]) if k == "plus" else None

    def _make(self, node: Node):
        k = node.kind
        if self.is_fast and k != "ref" and self._plain(node):
            match = _compile(self.g._regex(node)).match

            def whole(at: int) -> int:
                m = match(self.text, at)
                return FAIL if m is None else m.end()

            return whole
        if k == "term":
            match = _compile(node.value).match

            def term(at: int) -> int:
                m = match(self.text, at)
                if m is None:
                    if at > self.furthest:
                        self.furthest = at
                    return FAIL
                return m.end()

            return term
        if k == "ref":
            return self.refs[node.value]
        kids = [self._make(x) for x in node.kids]
        if k == "seq":
            if len(kids) == 2:
                first, second = kids

                def pair(at: int) -> int:
                    at = first(at)
                    return FAIL if at < 0 else second(at)

                return pair

            def seq(at: int) -> int:
                for f in kids:
                    at = f(at)
                    if at < 0:
                        return FAIL
                return at

            return seq
        if k == "choice":
            if not self.is_fast:

                def choice(at: int) -> int:
                    for f in kids:
                        end = f(at)
                        if end >= 0:
                            return end
                    return FAIL

                return choice
            self._seen = set()
            firsts = [self._first(x) for x in node.kids]
            table: dict[str, tuple] = {}

            def dispatch(at: int) -> int:
                c = self.text[at : at + 1]
                options = table.get(c)
                if options is None:
                    options = table[c] = tuple(f for f, s in zip(kids, firsts, strict=True) if s is None or c in s)
                for f in options:
                    end = f(at)
                    if end >= 0:
                        return end
                return FAIL

            return dispatch
        inner = kids[0]
        if k == "opt":

            def opt(at: int) -> int:
                end = inner(at)
                return at if end < 0 else end

            return opt
        if k in ("star", "plus"):
            least = k == "plus"

            def many(at: int) -> int:
                n = 0
                while (end := inner(at)) >= 0:
                    n += 1
                    if end == at:
                        break
                    at = end
                return FAIL if least and not n else at

            return many
        positive = k == "and"

        def look(at: int) -> int:
            seen = self.furthest
            end = inner(at)
            self.furthest = seen
            return at if (end >= 0) == positive else FAIL

        return look

    def parse(self, text: str) -> tuple[bool, int]:
        """(whether the whole input is accepted, furthest position at which something was expected).

        Input nested deeper than the interpreter's stack allows is not accepted; ``too_deep`` tells so.
        """
        self.text, self.furthest, self.too_deep = text, 0, False
        try:
            start = self.leading.match(text).end()
            end = self.refs[self.g.start](start)
            ok = end == len(text)
            if end >= 0 and not ok:
                self.furthest = max(self.furthest, end)
            return ok, len(text) if ok else self.furthest
        except RecursionError:
            self.too_deep = True
            return False, self.furthest
        finally:
            # Nothing of one input may be seen by the next.
            self.text = ""
            for memo in self.memo.values():
                memo.clear()
