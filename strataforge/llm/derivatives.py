"""Parsing with derivatives, memoised.

A grammar is a set of rules over concatenation, alternative and repetition. The derivative of an
expression by a token is what may follow that token. Expressions are hash-consed: equal ones have
one number, so that the derivative of a number by a symbol is computed once and then looked up, across all
files that a worker reads. An empty derivative marks the failing token; an expression that can't
be empty at the end of the text marks truncation. Rules must not be left-recursive.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))

EMPTY, EPS = 0, 1
_WORD = re.compile(r'\s*(?:(?P<comment>#[^\n]*)|(?P<term>"[^"]*")|(?P<name>[A-Za-z_]\w*)|(?P<punct>[=|()\[\]{}.]))')


class Grammar:
    """Rules as text: ``name = "word" OTHER_TOKEN rule [optional] {repeated} (a | b) .``

    Names in capitals are token classes, which ``classes`` may map to several symbols.
    """

    #: Numbers of expressions and of known derivatives at which the tables start anew (a memory bound; results don't change).
    LIMIT = 600_000

    def __init__(self, text: str, start: str, classes: dict[str, frozenset[str]] | None = None):
        self.classes = classes or {}
        self.rules: dict[str, tuple] = {}
        self._read(text)
        self.start = start
        self.nullable_rules: set[str] = set()
        changed = True
        while changed:
            changed = False
            for name, tree in self.rules.items():
                if name not in self.nullable_rules and self._tree_nullable(tree):
                    self.nullable_rules.add(name)
                    changed = True
        self.reset()

    # -- rule text --------------------------------------------------------------------------------
    def _read(self, text: str) -> None:
        words, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _WORD.match(text, at)
            if not m:
                raise ValueError(f"rule text: {text[at : at + 40]!r}")
            at = m.end()
            if m.lastgroup != "comment":
                words.append((m.lastgroup, m.group(m.lastgroup)))
        self._w, self._i = words, 0
        while self._i < len(words):
            name = words[self._i][1]
            if words[self._i + 1][1] != "=":
                raise ValueError(f"rule {name} has no =")
            self._i += 2
            self.rules[name] = self._alternatives()
            if self._w[self._i][1] != ".":
                raise ValueError(f"rule {name} doesn't end: {self._w[self._i]}")
            self._i += 1
        missing = {n for t in self.rules.values() for n in _names(t)} - self.rules.keys()
        if missing:
            raise ValueError(f"no rules for {sorted(missing)}")

    def _alternatives(self) -> tuple:
        parts = [self._sequence()]
        while self._w[self._i][1] == "|" and self._w[self._i][0] == "punct":
            self._i += 1
            parts.append(self._sequence())
        return parts[0] if len(parts) == 1 else ("alt", *parts)

    def _sequence(self) -> tuple:
        parts = []
        while True:
            kind, word = self._w[self._i]
            if kind == "punct" and word in "|)]}.":
                return parts[0] if len(parts) == 1 else ("seq", *parts)
            self._i += 1
            if kind == "term":
                parts.append(("tok", word[1:-1]))
            elif kind == "name":
                parts.append(("tok" if word.isupper() else "rule", word))
            else:
                inner = self._alternatives()
                self._i += 1
                parts.append({"(": inner, "[": ("alt", ("seq",), inner), "{": ("star", inner)}[word])

    def _tree_nullable(self, t: tuple) -> bool:
        match t[0]:
            case "tok":
                return False
            case "rule":
                return t[1] in self.nullable_rules
            case "seq":
                return all(map(self._tree_nullable, t[1:]))
            case "alt":
                return any(map(self._tree_nullable, t[1:]))
        return True

    # -- hash-consed expressions ------------------------------------------------------------------
    def reset(self) -> None:
        self.nodes: list[tuple] = [("empty",), ("eps",)]
        self.null: list[bool] = [False, True]
        self.number: dict[tuple, int] = {n: i for i, n in enumerate(self.nodes)}
        self.known: dict[tuple[int, str], int] = {}
        self.bodies: dict[str, int] = {}
        self.first = self._node(("rule", self.start), self.start in self.nullable_rules)

    def _node(self, node: tuple, null: bool) -> int:
        i = self.number.get(node)
        if i is None:
            i = self.number[node] = len(self.nodes)
            self.nodes.append(node)
            self.null.append(null)
        return i

    def _cat(self, a: int, b: int) -> int:
        if a == EMPTY or b == EMPTY:
            return EMPTY
        if a == EPS:
            return b
        if b == EPS:
            return a
        kind = self.nodes[a]
        if kind[0] == "cat":
            return self._cat(kind[1], self._cat(kind[2], b))
        return self._node(("cat", a, b), self.null[a] and self.null[b])

    def _alt(self, parts: set[int]) -> int:
        flat: set[int] = set()
        for p in parts:
            node = self.nodes[p]
            flat.update(node[1]) if node[0] == "alt" else flat.add(p)
        flat.discard(EMPTY)
        if len(flat) < 2:
            return flat.pop() if flat else EMPTY
        return self._node(("alt", frozenset(flat)), any(self.null[p] for p in flat))

    def _expression(self, t: tuple) -> int:
        match t[0]:
            case "tok":
                return self._node(("tok", self.classes.get(t[1], frozenset([t[1]]))), False)
            case "rule":
                return self._node(("rule", t[1]), t[1] in self.nullable_rules)
            case "seq":
                out = EPS
                for x in reversed(t[1:]):
                    out = self._cat(self._expression(x), out)
                return out
            case "alt":
                return self._alt({self._expression(x) for x in t[1:]})
        return self._node(("star", self._expression(t[1])), True)

    def derive(self, e: int, sym: str) -> int:
        """What may follow ``sym`` in ``e``; EMPTY if it can't come first."""
        key = (e, sym)
        out = self.known.get(key)
        if out is not None:
            return out
        node = self.nodes[e]
        match node[0]:
            case "tok":
                out = EPS if sym in node[1] else EMPTY
            case "rule":
                body = self.bodies.get(node[1])
                if body is None:
                    body = self.bodies[node[1]] = self._expression(self.rules[node[1]])
                out = self.derive(body, sym)
            case "cat":
                out = self._cat(self.derive(node[1], sym), node[2])
                if self.null[node[1]]:
                    out = self._alt({out, self.derive(node[2], sym)})
            case "alt":
                out = self._alt({self.derive(x, sym) for x in node[1]})
            case "star":
                out = self._cat(self.derive(node[1], sym), e)
            case _:
                out = EMPTY
        self.known[key] = out
        return out


def _names(t: tuple):
    if t[0] == "rule":
        yield t[1]
    elif t[0] != "tok":
        for x in t[1:]:
            yield from _names(x)


@dataclass(frozen=True)
class Verdict:
    """``fault`` is None for valid text, else ``token`` (``index`` is the failing token) or ``truncated``."""

    fault: str | None = None
    index: int = -1


def recognise(grammar: Grammar, syms: list[str], implied: str | None = None, breaks: set[int] = frozenset()) -> Verdict:
    """Take derivatives token by token.

    ``implied`` is a separator that may stand for a line break (``breaks``), a closing brace or the end where
    the next token fails without it.
    """
    if len(grammar.known) > grammar.LIMIT or len(grammar.nodes) > grammar.LIMIT:
        grammar.reset()
    known, derive, state = grammar.known, grammar.derive, grammar.first
    for i, sym in enumerate(syms):
        after = known.get((state, sym))
        if after is None:
            after = derive(state, sym)
        if not after and implied and (i in breaks or sym == "}" or (i and syms[i - 1] == "}")):
            state = derive(state, implied)
            after = derive(state, sym)
        if not after:
            return Verdict("token", i)
        state = after
    if not grammar.null[state] and implied:
        state = derive(state, implied)
    return Verdict() if grammar.null[state] else Verdict("truncated", len(syms))
