"""How much the Python workers are sent at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of an Arrow batch, where the session sets no bound: ten thousand rows of long texts or of blocks of vectors would not fit in a worker.
BATCH_BYTES, CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session then bounds the bytes of a batch for mapInArrow and the like: by its own setting, or else by BATCH_BYTES."""
    conf = df.sparkSession.conf
    if conf.get(CONF, None) is None:
        conf.set(CONF, str(BATCH_BYTES))
    return df
