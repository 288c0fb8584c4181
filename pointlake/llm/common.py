"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where the session names none, a single-machine session (tests) gets a folder that goes
    with the process; a cluster, whose machines would not share it, gets a ValueError.
    """
    sc = spark.sparkContext
    here = sc.getCheckpointDir()
    if here:
        return here
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="pointlake-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of what plans that were cut off have left.

    Spark's cleaner deletes their shuffle files once the driver's JVM has collected them,
    which a quiet heap puts off for long. Executors keep a heap at the size that the heaviest
    plan so far made it, beside which Python workers find no room; a full collection in each,
    run by one short task for each core, gives the free part back to the machine.
    """
    gc.collect()
    spark._jvm.System.gc()
    cores = spark.sparkContext.defaultParallelism
    collect = F.reflect(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, cores, 1, cores).select(collect).write.format("noop").mode("overwrite").save()


def bounded(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """``df``, marked for broadcast only if its known number of (narrow) rows is within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def join_rows(rows: DataFrame, values: DataFrame, key: str, count: str, total: int, least: int = 1000) -> DataFrame:
    """Inner join of many ``rows`` with one row of ``values`` a ``key``; no task gets a hot key's rows alone.

    ``count`` (a column of ``values``, dropped) says how many of the ``total`` rows have the key.
    Keys with more than a ten-thousandth of them, hence fewer than 10,000 keys, are broadcast;
    the rows of all others are shuffled.
    """
    limit = max(least, total // 10_000)
    hot = values.filter(F.col(count) > limit).drop(count)
    rest = values.filter(F.col(count) <= limit).drop(count)
    mine = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return mine.unionByName(rows.join(F.broadcast(hot), key))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: the binary MD5 of its UTF-8 bytes."""
    return F.unhex(F.md5(text))


def doc_fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(modulus)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each string of an Arrow column; null becomes empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the machine; a reused Python worker would keep it through all later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a mapInArrow body, giving back its memory at the end of each task."""

    def thrifty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return thrifty


def arrow_map(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
    slice_rows: int = 512,
) -> DataFrame:
    """``mapInArrow`` with per-task state: ``make`` runs once in each task.

    Batches are worked on ``slice_rows`` rows at a time, so what a step makes of
    long texts stays small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                yield step(batch.slice(at, slice_rows))
            give_back()

    return df.mapInArrow(frugal(run), schema)
