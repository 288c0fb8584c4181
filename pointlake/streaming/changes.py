"""A stream of bag and array changes, applied batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def apply_log(points: DataFrame, log: DataFrame, axes: list[str]) -> DataFrame:
    """The bag after a log of (op, axes...), where op is ``insert`` or ``remove``.

    Order between batches does not matter: each point's inserts less its removes, never
    below none, says how often it is there.
    """
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "remove", -1)
    rows = points.select(*axes, F.lit(1).alias("n")).unionByName(log.select(*axes, sign.alias("n")))
    left = rows.groupBy(*axes).agg(F.sum("n").alias("n")).filter("n > 0")
    return left.select(*axes, F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("_one")).drop("_one")


def write_changes(stream: DataFrame, path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append a change stream to a log table exactly once: a batch's folder is replaced if it is run again."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(batch, number)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
