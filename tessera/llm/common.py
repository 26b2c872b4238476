"""Shared pieces: cutting lineage, bounded Arrow batches, two-level ranks, row keys."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows, and bytes where Spark knows the setting, that one Arrow batch may hold.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ASCII white space, the separators of words and the characters stripped from lines.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, that of ``spark.checkpoint.dir``.

    Only where that is unset, and only in local mode, a folder of this machine
    serves instead.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; Spark removes it when nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def cut_table(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """As ``cut``, for large tables and many rounds: compressed columns, which stay in the shared folder as long as it does.

    The shuffle files that the table came from go as soon as it is written, and so
    does the table that it was made ``instead_of``, to which nothing else may refer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    if instead_of is not None:
        discarded(instead_of)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_to = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Remove what ``cut_table`` wrote of ``tables``, to which nothing else may refer."""
    for table in tables:
        spark = table.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(table._cut_to)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for tables with very long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def named(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``, whatever their names), id (0 for null), and a and b, 128 bits of text and of whether the id is null."""
    text, key = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(F.struct("*").alias("row"), key.alias("doc_id"), text.alias("text"), F.coalesce(key, F.lit(0)).alias("id"), F.xxhash64(text).alias("a"), F.xxhash64(key.isNull(), text).alias("b"))


def one_of_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of ``docs``, as it was, for each of ``wanted`` (id, a, b as by ``named``); of equal ones that of the least hash of all columns."""
    own = named(docs).select("row", "id", "a", "b").join(wanted.select("id", "a", "b").distinct(), ["id", "a", "b"], "left_semi")
    comparable = [F.col("row").getField(f.name) for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    nth = F.row_number().over(Window.partitionBy("id", "a", "b").orderBy(F.xxhash64(*comparable)))
    return own.withColumn("nth", nth).filter("nth = 1").select("row.*")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``, after the last of which this worker, which other tasks use again, gives free memory back."""
    yield from batches
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # a C library without malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(key: Column, modulus: int, remainder: int) -> Column:
    """True for ids whose crc32 as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def chunk_rows(rows: int) -> int:
    """Rows of a chunk of a two-level sum: as many as there are chunks, 4096 at least."""
    return max(4096, math.isqrt(rows))


def ranked(df: DataFrame, keys: list[str], order: list[str], rows: int, name: str = "rank") -> DataFrame:
    """Add a dense 0-based ``name`` among rows of equal ``keys`` without gathering a key in one task.

    Rows of a key are dealt by hash into chunks, numbered within their chunk,
    and shifted by the sizes of the chunks before; ``rows`` (the table's size)
    sets how many chunks there are, so each window sees about ``chunk_rows(rows)``
    rows however hot its key is. The order is by chunk, then by ``order``.
    """
    chunks = max(1, -(-rows // chunk_rows(rows)))
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    sizes = dealt.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    match = (F.col("_chunk") == F.col("_c")) & F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return numbered.join(sizes, match).withColumn(name, F.col("_inside") + F.col("_before")).drop("_chunk", "_inside", "_before", "_c", *[f"_k_{k}" for k in keys])


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns of sorted batches, as many whole runs at a time as come together."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        last = np.ones(table.num_rows, bool)
        for c in range(keys):
            values = table.column(c).to_numpy()
            last &= values == values[-1]
        begin = table.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if begin:
            yield table.slice(0, begin)
        held = table.slice(begin)
    if held is not None and held.num_rows:
        yield held


def bounds(table: pa.Table, keys: int) -> np.ndarray:
    """Where runs of rows with equal first ``keys`` columns begin, and the end."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for c in range(keys):
        values = table.column(c).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)
