"""Parser of the search dialect: one SELECT over one collection, with text, phrase, score and knn predicates."""

from __future__ import annotations

import json
import re

from ..errors import InvalidParam
from .ir import And, Between, InList, Knn, Node, Not, Or, Phrase, Search, Term, Text

_TOKEN = re.compile(r"\s*(?:(?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^']|'')*')|(?P<quoted>`[^`]+`)|(?P<word>[^\W\d][\w.]*)|(?P<mark><=|>=|!=|<>|=|<|>|\(|\)|,|\*|;))")
_KEYWORDS = frozenset("select from where order by limit offset and or not in between as asc desc".split())
_FUNCTIONS = frozenset("text phrase score knn".split())


def _lex(text: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise InvalidParam(f"cannot read the query at {text[at : at + 20]!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "string":
            value = value[1:-1].replace("''", "'")
        elif kind == "quoted":
            kind, value = "word", value[1:-1]
        elif kind == "word" and value.lower() in _KEYWORDS:
            kind, value = "key", value.lower()
        out.append((kind, value))
        at = m.end()
    if out and out[-1] == ("mark", ";"):
        out.pop()
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = _lex(text), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        got = self.peek()
        if (kind and got[0] != kind) or (value and got[1] != value):
            raise InvalidParam(f"expected {value or kind}, found {got[1] or 'the end'!r}")
        self.at += 1
        return got[1]

    def skip(self, kind: str, value: str) -> bool:
        if self.peek() == (kind, value):
            self.at += 1
            return True
        return False

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise InvalidParam(f"unexpected {self.peek()[1]!r}")

    def query(self) -> Search:
        self.take("key", "select")
        fields = self.projection()
        self.take("key", "from")
        source = self.take("word")
        where = self.expr() if self.skip("key", "where") else None
        order, offset, limit = self.order(), 0, 10
        if self.skip("key", "limit"):
            limit = self.integer()
            if self.skip("mark", ","):
                offset, limit = limit, self.integer()
            elif self.skip("key", "offset"):
                offset = self.integer()
        elif self.skip("key", "offset"):
            offset = self.integer()
        self.end()
        return Search(where, fields, order, offset, limit, source)

    def projection(self) -> tuple[tuple[str, str], ...]:
        if self.skip("mark", "*"):
            return ()
        out = []
        while True:
            name = self.take("word")
            out.append((name, self.take("word") if self.skip("key", "as") else name))
            if not self.skip("mark", ","):
                return tuple(out)

    def order(self) -> tuple[tuple[str, bool], ...]:
        out = []
        if self.skip("key", "order"):
            self.take("key", "by")
            while True:
                name = self.take("word")
                name = "_score" if name.lower() == "_score" else name
                ascending = not self.skip("key", "desc")
                if ascending:
                    self.skip("key", "asc")
                out.append((name, ascending))
                if not self.skip("mark", ","):
                    break
        return tuple(out)

    def integer(self) -> int:
        value = self.take("number")
        if not value.isdigit():
            raise InvalidParam(f"{value!r} is no count")
        return int(value)

    def expr(self) -> Node:
        left = self.conjunction()
        while self.skip("key", "or"):
            left = Or(left, self.conjunction())
        return left

    def conjunction(self) -> Node:
        left = self.unary()
        while self.skip("key", "and"):
            left = And(left, self.unary())
        return left

    def unary(self) -> Node:
        if self.skip("key", "not"):
            return Not(self.unary())
        if self.skip("mark", "("):
            inner = self.expr()
            self.take("mark", ")")
            return inner
        return self.predicate()

    def predicate(self) -> Node:
        name = self.take("word")
        negated = self.skip("key", "not")
        if self.skip("key", "in"):
            self.take("mark", "(")
            values = [self.literal()]
            while self.skip("mark", ","):
                values.append(self.literal())
            self.take("mark", ")")
            return InList(name, tuple(values), negated)
        if self.skip("key", "between"):
            low = self.literal()
            self.take("key", "and")
            return Between(name, low, True, self.literal(), True, negated)
        if negated:
            raise InvalidParam("NOT stands before IN or BETWEEN only")
        mark = self.take("mark")
        if mark not in ("=", "!=", "<>", "<", "<=", ">", ">="):
            raise InvalidParam(f"{mark!r} is no comparison")
        if self.peek()[0] == "word" and self.peek(1) == ("mark", "("):
            return self.function(name, mark)
        return _comparison(name, mark, self.literal(), 1.0)

    def function(self, name: str, mark: str) -> Node:
        kind = self.take("word").lower()
        if kind not in _FUNCTIONS:
            raise InvalidParam(f"no function {kind!r}")
        self.take("mark", "(")
        value, options = self.literal(bare=True), {}
        while self.skip("mark", ","):
            key = self.take("word").lower()
            self.take("mark", "=")
            options["boost" if key == "score" else key] = self.literal(bare=True)
        self.take("mark", ")")
        allowed = {"text": {"boost", "operator"}, "phrase": {"boost", "slop"}, "score": {"boost"}, "knn": {"boost", "k", "metric"}}[kind]
        if set(options) - allowed:
            raise InvalidParam(f"{kind} has no option {sorted(set(options) - allowed)}")
        boost = _number(options.get("boost", 1.0), "boost")
        if kind == "score":
            return _comparison(name, mark, value, boost)
        if mark != "=":
            raise InvalidParam(f"{kind} goes with = only")
        if kind == "text":
            operator = str(options.get("operator", "or")).lower()
            if operator not in ("and", "or"):
                raise InvalidParam(f"operator {operator!r}: and, or")
            return Text(name, str(value), operator, boost)
        if kind == "phrase":
            return Phrase(name, str(value), int(_number(options.get("slop", 0), "slop")), boost)
        try:
            vector = tuple(float(x) for x in json.loads(str(value)))
        except (ValueError, TypeError):
            raise InvalidParam(f"{value!r} is no vector") from None
        return Knn(name, vector, int(_number(options.get("k", 10), "k")), str(options.get("metric", "euclidean")).lower(), boost)

    def literal(self, bare: bool = False):
        kind, value = self.peek()
        self.at += 1
        if kind == "number":
            return int(value) if re.fullmatch(r"[+-]?\d+", value) else float(value)
        if kind == "string":
            return value
        if kind == "word" and value.lower() in ("true", "false"):
            return value.lower() == "true"
        if (kind == "word" or kind == "key" and value in ("and", "or")) and bare:
            return value
        raise InvalidParam(f"expected a literal, found {value or 'the end'!r}")


def _number(value, what: str) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise InvalidParam(f"{what} {value!r} is no number") from None


def _comparison(name: str, mark: str, value, boost: float) -> Node:
    if mark == "=":
        return Term(name, value, False, boost)
    if mark in ("!=", "<>"):
        return Term(name, value, True, boost)
    if mark in (">", ">="):
        return Between(name, low=value, low_eq=mark == ">=", boost=boost)
    return Between(name, high=value, high_eq=mark == "<=", boost=boost)


def parse(sql: str) -> Search:
    """A whole SELECT."""
    return _Parser(sql).query()


def parse_where(text: str) -> Node | None:
    """A predicate by itself; None for an empty one."""
    if not text or not text.strip():
        return None
    p = _Parser(text)
    out = p.expr()
    p.end()
    return out


def parse_order(items: list[str]) -> tuple[tuple[str, bool], ...]:
    """Sort keys such as "age desc" or "age,desc"; the direction must be there."""
    out = []
    for item in items:
        parts = item.replace(",", " ").split()
        if len(parts) != 2 or parts[1].lower() not in ("asc", "desc"):
            raise InvalidParam(f"order {item!r}: a field and asc or desc")
        out.append(("_score" if parts[0].lower() == "_score" else parts[0], parts[1].lower() == "asc"))
    return tuple(out)
