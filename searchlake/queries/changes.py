"""Mutations, persistence, JSON, coercion and the ordered map."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import values
from ..operators import mutations
from ..operators.ordered_map import OrderedMap
from ..scratch import shared_dir
from ..types import FieldType
from .base import query, read

#: The base is every customer; the batch too, every other one under a name that the base does not have.
BASE = "base AS (SELECT c_custkey AS _id, c_name AS _name, c_acctbal AS bal FROM customer)"
BATCH = "batch AS (SELECT c_custkey AS _seq, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE concat(c_name, ' new') END AS _name, c_acctbal + 100 AS bal FROM customer)"
TOP = "(SELECT max(_id) FROM base)"


def _tables(spark, sf_dir, action):
    c = read(spark, sf_dir, "customer")
    base = c.select(F.col("c_custkey").alias("_id"), F.col("c_name").alias("_name"), F.col("c_acctbal").alias("bal"))
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit(" new")))
    batch = c.select(F.col("c_custkey").alias("_seq"), F.lit(action).alias("_action"), name.alias("_name"), (F.col("c_acctbal") + 100).alias("bal"))
    return base, batch


def _state(spark, sf_dir, action):
    base, batch = _tables(spark, sf_dir, action)
    return mutations.merged(base, mutations.apply_batch(base, batch)).select("_id", "_name", F.round("bal", 4).alias("bal"))


ROUNDED = "SELECT _id, _name, round(bal, 4) AS bal FROM"


@query(f"WITH {BASE}, {BATCH} {ROUNDED} (SELECT * FROM base UNION ALL SELECT {TOP} + row_number() OVER (ORDER BY _seq), _name, bal FROM batch)")
def mut_append(spark, sf_dir):
    """Append: new ids, names are not looked at."""
    return _state(spark, sf_dir, mutations.APPEND)


@query(f"WITH {BASE}, {BATCH} {ROUNDED} (SELECT * FROM base UNION ALL SELECT {TOP} + row_number() OVER (ORDER BY _seq), _name, bal FROM batch WHERE _name NOT IN (SELECT _name FROM base))")
def mut_insert(spark, sf_dir):
    """Insert: only names that are not there."""
    return _state(spark, sf_dir, mutations.INSERT)


@query(f"WITH {BASE}, {BATCH} {ROUNDED} (SELECT * FROM base WHERE _name NOT IN (SELECT _name FROM batch) UNION ALL SELECT {TOP} + row_number() OVER (ORDER BY _seq), _name, bal FROM batch)")
def mut_upsert(spark, sf_dir):
    """Upsert: the old record is hidden, the new one has a new id."""
    return _state(spark, sf_dir, mutations.UPSERT)


@query(f"WITH {BASE}, {BATCH} {ROUNDED} (SELECT * FROM base WHERE _name NOT IN (SELECT _name FROM batch))")
def mut_delete(spark, sf_dir):
    return _state(spark, sf_dir, mutations.DELETE)


@query(f"""WITH {BASE}, {BATCH}
  SELECT _seq, _name, CASE WHEN _seq % 4 < 2 THEN 'insert' ELSE 'delete' END AS _action,
         CAST(CASE WHEN _seq % 4 < 2 AND _name IN (SELECT _name FROM base) THEN 2 WHEN _seq % 4 >= 2 AND _name NOT IN (SELECT _name FROM base) THEN 3 ELSE 0 END AS INTEGER) AS code
  FROM batch""")
def mut_results(spark, sf_dir):
    """A result for each action of a mixed batch."""
    base, batch = _tables(spark, sf_dir, mutations.INSERT)
    batch = batch.withColumn("_action", F.when(F.col("_seq") % 4 < 2, mutations.INSERT).otherwise(mutations.DELETE))
    return mutations.apply_batch(base, batch).results.select("_seq", "_name", "_action", "code")


@query(f"WITH {BASE}, {BATCH} SELECT _name, round(coalesce(n.bal, b.bal), 4) AS bal FROM base b FULL JOIN batch n USING (_name)")
def upsert_latest(spark, sf_dir):
    """A bulk upsert by one window: of each name the change, else the base row."""
    base, batch = _tables(spark, sf_dir, mutations.UPSERT)
    rows = mutations.upsert_latest(base.select("_name", "bal", F.col("_id").alias("o")), batch.select("_name", "bal", F.col("_seq").alias("o")), "_name", "o")
    return rows.select("_name", F.round("bal", 4).alias("bal"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def persist_roundtrip(spark, sf_dir):
    """Orders written as segments in the order of ids, and read again."""
    path = f"{shared_dir(spark)}/searchlake-persist-{uuid.uuid4().hex[:12]}"
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    df.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.option("maxRecordsPerFile", 1_000_000).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query("SELECT CAST(floor(o_orderkey / 1000) AS BIGINT) AS segment, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY 1")
def store_info(spark, sf_dir):
    """Rows and id ranges by segment of a thousand ids."""
    return read(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("segment")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def add_field(spark, sf_dir):
    """A field indexed after the fact, from the records' JSON."""
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, coalesce(json_extract_string(props, '$.none'), '') AS missing FROM events")
def json_to_string(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", values.json_text(F.col("props"), "$.k").alias("k"), values.json_text(F.col("props"), "$.none").alias("missing"))


@query("SELECT event_id, user_id, event_type, value FROM events")
def json_roundtrip(spark, sf_dir):
    """Events through JSON and back."""
    df = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    schema = df.schema
    return df.select(F.from_json(F.to_json(F.struct(*df.columns)), schema).alias("r")).select("r.*")


@query("""SELECT p_partkey, p_size <> 0 AS int_bool, CAST(p_size AS VARCHAR) AS int_string, CAST(trunc(p_retailprice) AS BIGINT) AS float_int, p_retailprice <> 0 AS float_bool,
  TRY_CAST(CASE WHEN regexp_full_match(p_brand, '[+-]?[0-9]+') THEN p_brand END AS BIGINT) AS string_int, CAST(CAST(p_size > 10 AS INTEGER) AS DOUBLE) AS bool_float, CAST(p_size > 10 AS VARCHAR) AS bool_string FROM part""")
def cast_matrix(spark, sf_dir):
    """Coercions between field types; what cannot be is null."""
    p = read(spark, sf_dir, "part")
    big = F.col("p_size") > 10
    return p.select(
        "p_partkey",
        values.coerce(F.col("p_size"), T.IntegerType(), FieldType.BOOL).alias("int_bool"),
        values.coerce(F.col("p_size"), T.IntegerType(), FieldType.STRING).alias("int_string"),
        values.coerce(F.col("p_retailprice"), T.DoubleType(), FieldType.INT).alias("float_int"),
        values.coerce(F.col("p_retailprice"), T.DoubleType(), FieldType.BOOL).alias("float_bool"),
        values.coerce(F.col("p_brand"), T.StringType(), FieldType.INT).alias("string_int"),
        values.coerce(big, T.BooleanType(), FieldType.FLOAT).cast("double").alias("bool_float"),
        values.coerce(big, T.BooleanType(), FieldType.STRING).alias("bool_string"),
    )


@query("SELECT p_partkey, array_to_string(flatten([string_split(p_name, ' '), [p_brand]]), '|') AS flat FROM part")
def array_flatten(spark, sf_dir):
    nested = F.array(F.split("p_name", " "), F.array("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(values.flatten_deep(nested, T.ArrayType(T.ArrayType(T.StringType()))), "|").alias("flat"))


# The ordered map, over events by their id


def _map(spark, sf_dir):
    return OrderedMap(read(spark, sf_dir, "events").select("event_id", "user_id", "value"), "event_id")


@query("SELECT event_id, user_id, value FROM events WHERE event_id = 123")
def kv_get(spark, sf_dir):
    return _map(spark, sf_dir).get(123)


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE user_id END AS user_id, CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE value END AS value FROM events WHERE event_id % 7 <> 0
  UNION ALL SELECT event_id + 10000000, -1, 0.5 FROM events WHERE event_id % 100 = 0""")
def kv_merge(spark, sf_dir):
    """Puts and deletes merged in one pass; a delete of a key that is put elsewhere in the batch is not among these."""
    m = _map(spark, sf_dir)
    ids = read(spark, sf_dir, "events").select("event_id")
    gone = ids.filter("event_id % 7 = 0").withColumn("deleted", F.lit(True))
    put = ids.filter("event_id % 5 = 0 AND event_id % 7 <> 0").union(ids.filter("event_id % 100 = 0").select(F.col("event_id") + 10000000)).withColumn("deleted", F.lit(False))
    batch = gone.union(put).select("event_id", F.lit(-1).cast("bigint").alias("user_id"), F.lit(0.5).alias("value"), "deleted")
    return m.merge(batch, "deleted").df


@query("SELECT event_id, user_id FROM events ORDER BY event_id DESC")
def kv_scan_desc(spark, sf_dir):
    return _map(spark, sf_dir).scan(descending=True).select("event_id", "user_id")


@query("SELECT event_id, value FROM events WHERE event_id >= 500 ORDER BY event_id LIMIT 20")
def kv_seek(spark, sf_dir):
    return _map(spark, sf_dir).seek(500, 20).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE event_id <= 500 ORDER BY event_id DESC LIMIT 20")
def kv_seek_prev(spark, sf_dir):
    return _map(spark, sf_dir).seek_prev(500, 20).select("event_id", "value")


@query("SELECT CASE WHEN event_id < 400 THEN 'left' ELSE 'right' END AS side, event_id FROM events")
def kv_split(spark, sf_dir):
    left, right = _map(spark, sf_dir).split_off(400)
    return left.df.select(F.lit("left").alias("side"), "event_id").union(right.df.select(F.lit("right"), "event_id"))


@query("SELECT min(event_id) AS min_event_id, max(event_id) AS max_event_id, arg_min(user_id, event_id) AS min_user_id, arg_min(value, event_id) AS min_value, arg_max(user_id, event_id) AS max_user_id, arg_max(value, event_id) AS max_value FROM events")
def kv_minmax(spark, sf_dir):
    return _map(spark, sf_dir).ends()


@query("SELECT event_id, user_id FROM events WHERE ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-20 00:00:00'")
def kv_ttl(spark, sf_dir):
    """Entries that expire seven days after their time, purged as of a fixed now."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.expr("ts + INTERVAL 7 DAYS").alias("expiry"))
    return OrderedMap(e, "event_id", "expiry").expire(F.lit("2024-01-20 00:00:00").cast(e.schema["expiry"].dataType)).df.select("event_id", "user_id")
