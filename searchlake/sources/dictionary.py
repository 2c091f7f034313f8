"""Word lists for analyzers, from JSON arrays or files of lines."""

from __future__ import annotations

import json
from pathlib import Path

from ..errors import DecodeError, NotSupported


def load_words(value: str, protocol: str = "json") -> tuple[str, ...]:
    """Distinct words in order. protocol: json (an array of strings in value) or file (a path of lines)."""
    if protocol == "json":
        try:
            words = json.loads(value)
        except ValueError as e:
            raise DecodeError(f"dictionary is no JSON: {e}") from None
        if not isinstance(words, list) or not all(isinstance(w, str) for w in words):
            raise DecodeError("dictionary is no array of strings")
    elif protocol == "file":
        words = [line.rstrip("\n") for line in Path(value).read_text(encoding="utf-8").splitlines()]
    else:
        raise NotSupported(f"dictionary protocol {protocol!r}: json, file")
    return tuple(dict.fromkeys(w for w in words if w))


def load_synonyms(value: str, protocol: str = "file") -> tuple[tuple[str, ...], ...]:
    """Groups of synonyms, one for each entry, its words parted by tabs."""
    return tuple(tuple(w for w in line.split("\t") if w) for line in load_words(value, protocol))
