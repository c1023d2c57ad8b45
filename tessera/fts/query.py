"""The MATCH language: terms, phrases, prefixes, AND, OR, NOT, column filters, parentheses."""

from __future__ import annotations

import re
from dataclasses import dataclass

MAX_DEPTH, MAX_NODES = 48, 256
_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([(){}:*^+-])|([^\s"(){}:*^+-]+))')


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Leaf:
    text: str
    prefix: bool = False
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Node:
    kind: str  # and, or, not
    left: Node | Leaf
    right: Node | Leaf


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"syntax error near {text[at:]!r}")
            self.tokens.append(("string", m[1][1:-1].replace('""', '"')) if m[1] else ("mark", m[2]) if m[2] else ("word", m[3]))
            at = m.end()
        self.at = self.nodes = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1] in values and self.tokens[self.at][0] != "string"

    def take(self):
        if self.at >= len(self.tokens):
            raise QueryError("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1]

    def grow(self):
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise QueryError("query too large")

    def chain(self, kind: str, word: str, part, depth: int, columns):
        left = part(depth, columns)
        while self.peek(word):
            self.take()
            self.grow()
            left = Node(kind, left, part(depth, columns))
        return left

    def either(self, depth, columns):
        return self.chain("or", "OR", self.both, depth, columns)

    def both(self, depth, columns):
        return self.chain("and", "AND", self.without, depth, columns)

    def without(self, depth, columns):
        return self.chain("not", "NOT", self.run, depth, columns)

    def run(self, depth, columns):
        """Neighbours without an operator are joined by AND."""
        left = self.item(depth, columns)
        while self.at < len(self.tokens) and not self.peek("AND", "OR", "NOT", ")"):
            self.grow()
            left = Node("and", left, self.item(depth, columns))
        return left

    def item(self, depth, columns):
        if depth > MAX_DEPTH:
            raise QueryError("query too deep")
        self.grow()
        kind, value = self.take()
        if (kind, value) == ("mark", "("):
            inner = self.either(depth + 1, columns)
            if not self.peek(")"):
                raise QueryError("missing )")
            self.take()
            return inner
        if (kind, value) == ("mark", "{"):
            names = []
            while not self.peek("}"):
                names.append(self.take()[1])
            self.take()
            if not self.peek(":"):
                raise QueryError("missing :")
            self.take()
            return self.item(depth + 1, tuple(names))
        if kind == "mark" or (kind == "word" and value in ("AND", "OR", "NOT")):
            raise QueryError(f"syntax error near {value!r}")
        if kind == "word" and self.peek(":"):
            self.take()
            return self.item(depth + 1, (value,))
        prefix = self.peek("*")
        if prefix:
            self.take()
        return Leaf(value, prefix, columns)


def parse(text: str) -> Node | Leaf:
    p = _Parser(text)
    if not p.tokens:
        raise QueryError("empty query")
    out = p.either(0, None)
    if p.at < len(p.tokens):
        raise QueryError(f"syntax error near {p.tokens[p.at][1]!r}")
    return out


def leaves(node: Node | Leaf, scored: bool = True) -> list[tuple[Leaf, bool]]:
    """Leaves from left to right, and whether they score: operands of NOT never do."""
    if isinstance(node, Leaf):
        return [(node, scored)]
    return leaves(node.left, scored) + leaves(node.right, scored and node.kind != "not")
