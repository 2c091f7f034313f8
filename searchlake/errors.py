"""Errors with the numeric codes that mutation results carry."""

from __future__ import annotations


class SearchError(Exception):
    code = 1

    def __str__(self) -> str:
        return f"[{self.code}] {super().__str__()}"


class Duplicated(SearchError):
    code = 2


class NotExisted(SearchError):
    code = 3


class StorageError(SearchError):
    code = 4


class DecodeError(SearchError):
    code = 5


class NotSupported(SearchError):
    code = 6


class InvalidParam(SearchError):
    code = 7


class Existed(SearchError):
    code = 8


OK = 0
CODES = {"Ok": OK} | {e.__name__: e.code for e in (Duplicated, NotExisted, StorageError, DecodeError, NotSupported, InvalidParam, Existed)} | {"Internal": 1}
