"""Text analysis: tokenizers and token filters, as columns for records and as Python for queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidParam
from ..types import TextOption
from .stemmer import stem

STANDARD = r"[\p{L}\p{N}_]+"
_STANDARD, _SEGMENT, _WORD = regex.compile(STANDARD), regex.compile(r"\b", flags=regex.WORD | regex.V1), regex.compile(r"[\p{L}\p{N}]")
TOKENIZERS = ("standard", "whitespace", "uax29", "uax29_all")


def segments(text: str, everything: bool = False) -> list[str]:
    """Unicode word segments: of letters or digits, or with everything also of blanks and punctuation."""
    return [s for s in _SEGMENT.split(text) if s and (everything or _WORD.search(s))]


#: Texts whose tokens are Python objects at a time.
PIECE = 64


def _by_piece(values: pa.Array, analyse) -> pa.Array:
    """A list of strings for each value, null for null; the tokens of a batch are never all Python objects at once."""
    kind = pa.list_(pa.string())
    pieces = [pa.array([None if v is None else analyse(v) for v in values.slice(lo, PIECE).to_pylist()], kind) for lo in range(0, len(values), PIECE)]
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _segmented(texts: pa.Array) -> pa.Array:
    return _by_piece(texts, segments)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _segmented_all(texts: pa.Array) -> pa.Array:
    return _by_piece(texts, lambda t: segments(t, True))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pa.Array) -> pa.Array:
    return _by_piece(tokens, lambda ts: [stem(t) for t in ts])


@dataclass(frozen=True)
class Analyzer:
    """Tokenizer, lower case, stop words and stemmer, in this order; the same for records and queries."""

    option: TextOption = TextOption()

    def __post_init__(self):
        if self.option.tokenizer not in TOKENIZERS:
            raise InvalidParam(f"tokenizer {self.option.tokenizer!r}: one of {TOKENIZERS}")
        if self.option.stemmer not in (None, "english"):
            raise InvalidParam(f"stemmer {self.option.stemmer!r}: only english")

    def tokens(self, text: Column) -> Column:
        """The tokens of a text column; their place in the array is their position."""
        o = self.option
        text = F.lower(text) if o.lowercase else text
        if o.tokenizer == "standard":
            out = F.regexp_extract_all(text, F.lit(STANDARD), F.lit(0))
        elif o.tokenizer == "whitespace":
            out = F.filter(F.split(text, r"\s+"), lambda t: t != "")
        else:
            out = (_segmented if o.tokenizer == "uax29" else _segmented_all)(text)
        if o.stopwords:
            stop = F.array(*[F.lit(w) for w in o.stopwords])
            out = F.filter(out, lambda t: ~F.array_contains(stop, t))
        return _stemmed(out) if o.stemmer else out

    def analyze(self, text: str) -> list[str]:
        """The tokens of a query."""
        return [self._stem(t) for t in self._kept(text)]

    def expand(self, text: str) -> list[list[str]]:
        """By query position the token and its synonyms, all of which stand at that position."""
        groups: dict[str, list[str]] = {}
        for group in self.option.synonyms:
            for w in group:
                groups.setdefault(w, []).extend(group)
        return [list(dict.fromkeys(self._stem(x) for x in [t, *groups.get(t, ())])) for t in self._kept(text)]

    def _kept(self, text: str) -> list[str]:
        o = self.option
        text = text.lower() if o.lowercase else text
        if o.tokenizer == "standard":
            out = _STANDARD.findall(text)
        elif o.tokenizer == "whitespace":
            out = [t for t in re.split(r"\s+", text) if t]
        else:
            out = segments(text, o.tokenizer == "uax29_all")
        return [t for t in out if t not in o.stopwords]

    def _stem(self, token: str) -> str:
        return stem(token) if self.option.stemmer else token
