"""JSON records as rows with one typed column for each indexed field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import coerce
from ..functions.vectors import is_valid
from ..types import Field, FieldType, Schema


def field_column(f: Field, data: str = "_data"):
    """A field of the JSON in a column, coerced to its type; what cannot be coerced is null."""
    raw = F.get_json_object(F.col(data), f"$['{f.name}']")
    if f.type is FieldType.VECTOR:
        parsed = _vectors(f, raw)
        return F.when(_all_valid(f, parsed), parsed)
    if f.array:
        listed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, "array<string>")).otherwise(F.when(raw.isNotNull(), F.array(raw)))
        return coerce(listed, T.ArrayType(T.StringType()), f.type)
    if f.type is FieldType.BOOL:
        return F.when(raw.isin("true", "1"), True).when(raw.isin("false", "0"), False)
    if f.type is FieldType.INT:
        # a JSON number with a fraction is cut to an integer
        return F.coalesce(coerce(raw, T.StringType(), f.type), raw.try_cast("double").try_cast("bigint"), raw.try_cast("boolean").cast("bigint"))
    return coerce(raw, T.StringType(), f.type)


def _vectors(f: Field, raw):
    """The JSON of a vector field: a vector, or for an array field several, of which one may stand alone."""
    if not f.array:
        return F.from_json(raw, "array<float>")
    return F.coalesce(F.from_json(raw, "array<array<float>>"), F.array(F.from_json(raw, "array<float>")))


def _all_valid(f: Field, parsed):
    if not f.array:
        return is_valid(parsed, f.vector.dimension)
    return F.coalesce((F.size(parsed) > 0) & F.forall(parsed, lambda v: is_valid(v, f.vector.dimension)), F.lit(False))


def invalid_vectors(schema: Schema, data: str = "_data"):
    """Whether a record has a vector of another dimension than its field's, or one that is not finite."""
    out = F.lit(False)
    for f in schema.fields.values():
        if f.type is FieldType.VECTOR:
            raw = F.get_json_object(F.col(data), f"$['{f.name}']")
            out = out | (raw.isNotNull() & ~_all_valid(f, _vectors(f, raw)))
    return out


def shred(df: DataFrame, schema: Schema, data: str = "_data") -> DataFrame:
    """df with the schema's columns read from its JSON column."""
    return df.select("*", *[field_column(f, data).alias(f.name) for f in schema.fields.values()])


def invalid_json(data: str = "_data"):
    """Whether a record's JSON is no object, or has a null among its values."""
    keyed = F.from_json(F.col(data), "map<string,string>")
    ok = F.col(data).isNotNull() & F.ltrim(F.col(data)).startswith("{") & keyed.isNotNull() & ~F.coalesce(F.exists(F.map_values(keyed), lambda v: v.isNull()), F.lit(False))
    return ~F.coalesce(ok, F.lit(False))


def infer_schema(df: DataFrame, name: str, data: str = "_data") -> Schema:
    """For schemaless collections: a field for each top-level key but objects, strings as keywords; one aggregation."""
    keys = df.select(data, F.explode(F.json_object_keys(F.col(data))).alias("k")).filter(~F.col("k").startswith("_"))
    raw = keys.withColumn("raw", F.element_at(F.from_json(F.col(data), "map<string,string>"), F.col("k"))).filter("raw IS NOT NULL")
    listed = F.ltrim("raw").startswith("[")
    one = F.when(listed, F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    parts = raw.withColumn("listed", listed).withColumn("v", F.explode(one))

    def every(pattern: str, alias: str):
        return F.min(F.col("v").rlike(pattern)).alias(alias)

    found = parts.groupBy("k").agg(F.max("listed").alias("listed"), every(r"^(true|false)$", "bool"), every(r"^[+-]?[0-9]{1,18}$", "int"), every(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "float"), every(r"^\{", "object"))
    fields = []
    for r in found.filter("NOT object").orderBy("k").collect():
        kind = FieldType.BOOL if r["bool"] else FieldType.INT if r["int"] else FieldType.FLOAT if r["float"] else FieldType.STRING
        fields.append(Field(r["k"], kind, r["listed"]))
    return Schema.of(name, *fields, schemaless=True)
