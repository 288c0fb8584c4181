"""Point sets and indexed arrays from files, Python values or generators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_points(spark: SparkSession, axes: Sequence[str]) -> DataFrame:
    """No points, of the given axes; (id, axes...)."""
    return spark.createDataFrame([], "id long, " + ", ".join(f"{a} double" for a in axes))


def points(spark: SparkSession, rows: Sequence[Sequence[float]], axes: Sequence[str]) -> DataFrame:
    """Points from memory; ids follow the given order."""
    for row in rows:
        if len(row) != len(axes):
            raise ValueError(f"a point of {len(row)} values for {len(axes)} axes")
    if not rows:
        return empty_points(spark, axes)
    schema = "id long, " + ", ".join(f"{a} double" for a in axes)
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(rows)], schema)


def array(spark: SparkSession, values: Sequence[int], kind: str = "long") -> DataFrame:
    """(idx, val) from memory."""
    return spark.createDataFrame(list(enumerate(values)), f"idx long, val {kind}")


def as_array(df: DataFrame, idx: str, val: str) -> DataFrame:
    """(idx, val) of a table with an index column."""
    return df.select(F.col(idx).cast("long").alias("idx"), F.col(val).alias("val"))


def random_points(spark: SparkSession, n: int, axes: Sequence[str], low: int, high: int, seed: int = 0) -> DataFrame:
    """n points of uniform integers in [low, high)."""
    columns = [(F.floor(F.rand(seed + k) * (high - low)) + low).cast("long").alias(a) for k, a in enumerate(axes)]
    return spark.range(n).select("id", *columns)


def random_array(spark: SparkSession, n: int, low: int, high: int, seed: int = 0) -> DataFrame:
    return random_points(spark, n, ["val"], low, high, seed).withColumnRenamed("id", "idx")
