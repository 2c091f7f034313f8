"""Field types, their options, and the mapping between collection schemas and StructTypes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import types as T

from .errors import InvalidParam


class FieldType(Enum):
    BOOL = "bool"
    INT = "int"
    FLOAT = "float"
    STRING = "string"
    TEXT = "text"
    VECTOR = "vector"


SPARK_TYPES = {
    FieldType.BOOL: T.BooleanType(),
    FieldType.INT: T.LongType(),
    FieldType.FLOAT: T.FloatType(),
    FieldType.STRING: T.StringType(),
    FieldType.TEXT: T.StringType(),
    FieldType.VECTOR: T.ArrayType(T.FloatType()),
}


@dataclass(frozen=True)
class TextOption:
    """How a text field is analysed; the same chain runs on records and on queries."""

    tokenizer: str = "standard"
    lowercase: bool = True
    stemmer: str | None = None
    stopwords: tuple[str, ...] = ()
    synonyms: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class VectorOption:
    dimension: int
    metric: str = "euclidean"


@dataclass(frozen=True)
class Field:
    name: str
    type: FieldType
    array: bool = False
    text: TextOption = TextOption()
    vector: VectorOption | None = None

    def __post_init__(self):
        if not self.name or self.name.startswith("_"):
            raise InvalidParam(f"field name {self.name!r}: names may not be empty or begin with an underscore")
        if self.type is FieldType.VECTOR and self.vector is None:
            raise InvalidParam(f"vector field {self.name} needs a dimension")

    @property
    def spark_type(self) -> T.DataType:
        own = SPARK_TYPES[self.type]
        return T.ArrayType(own) if self.array else own


@dataclass(frozen=True)
class Schema:
    """The indexed fields of a collection; all other keys of a record stay in its JSON."""

    name: str
    fields: dict[str, Field] = field(default_factory=dict)
    schemaless: bool = False

    @classmethod
    def of(cls, name: str, *fields: Field, schemaless: bool = False) -> Schema:
        return cls(name, {f.name: f for f in fields}, schemaless)

    def with_field(self, f: Field) -> Schema:
        if f.name in self.fields:
            raise InvalidParam(f"field {f.name} exists")
        return Schema(self.name, self.fields | {f.name: f}, self.schemaless)

    def without_field(self, name: str) -> Schema:
        if name not in self.fields:
            raise InvalidParam(f"no field {name}")
        return Schema(self.name, {k: v for k, v in self.fields.items() if k != name}, self.schemaless)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type, True, {"searchlake": _plain(f)}) for f in self.fields.values()])

    def json(self) -> str:
        return json.dumps({"name": self.name, "schemaless": self.schemaless, "fields": [_plain(f) for f in self.fields.values()]}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        raw = json.loads(text)
        return cls.of(raw["name"], *(_field(f) for f in raw["fields"]), schemaless=raw["schemaless"])


def _plain(f: Field) -> dict:
    out = asdict(f)
    out["type"] = f.type.value
    return out


def _field(raw: dict) -> Field:
    text = TextOption(**{**raw["text"], "stopwords": tuple(raw["text"]["stopwords"]), "synonyms": tuple(tuple(g) for g in raw["text"]["synonyms"])})
    return Field(raw["name"], FieldType(raw["type"]), raw["array"], text, VectorOption(**raw["vector"]) if raw["vector"] else None)
