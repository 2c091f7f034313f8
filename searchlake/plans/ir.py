"""The tree of a query."""

from __future__ import annotations

from dataclasses import dataclass, field

Literal = str | int | float | bool


@dataclass(frozen=True)
class Term:
    """field = value or field != value; a missing value is unequal to everything."""

    field: str
    value: Literal
    negated: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Between:
    """A range with either bound open, and each bound in or out."""

    field: str
    low: Literal | None = None
    low_eq: bool = True
    high: Literal | None = None
    high_eq: bool = True
    negated: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class InList:
    field: str
    values: tuple[Literal, ...] = ()
    negated: bool = False
    boost: float = 1.0


@dataclass(frozen=True)
class Text:
    """Any (or) or every (and) token of the value occurs; scored by BM25."""

    field: str
    value: str
    operator: str = "or"
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase:
    """The tokens of the value occur in order, each within slop of its place."""

    field: str
    value: str
    slop: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class Knn:
    """Among the k nearest, of the records that the rest of the query matches."""

    field: str
    vector: tuple[float, ...]
    k: int = 10
    metric: str = "euclidean"
    boost: float = 1.0


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


@dataclass(frozen=True)
class Not:
    child: Node


Node = Term | Between | InList | Text | Phrase | Knn | And | Or | Not


@dataclass(frozen=True)
class Search:
    """A whole query. fields: (name, alias) pairs, none for all; order: (name, ascending) pairs."""

    where: Node | None = None
    fields: tuple[tuple[str, str], ...] = ()
    order: tuple[tuple[str, bool], ...] = ()
    offset: int = 0
    limit: int | None = 10
    source: str | None = field(default=None)
