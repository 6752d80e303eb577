"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word of the corpus contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (local tests) a folder of this machine is taken.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = os.path.join(tempfile.gettempdir(), "strandloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/strandloom/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, kind: str) -> DataFrame:
    """As cut(), but compressed and columnar, for tables with long values."""
    path = new_path(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, keys: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but the keys in one struct, so that no name of theirs meets one of an operator's own; and the way back."""
    others = [c for c in docs.columns if c not in keys]
    own = [c for c in keys if c in docs.columns]
    base = docs.select(*own, F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in others)).alias("__rest")) if others else docs.select(*own)

    def restored(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(c) if c in own else F.col("__rest").getField(c).alias(c) for c in docs.columns))

    return base, restored


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc32_text(x: Column) -> Column:
    """crc32 of a value's decimal text; null counts as the empty text."""
    return F.crc32(F.coalesce(x.cast("string"), F.lit("")).cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows and about `most` bytes of strings (one row at least)."""
    for batch in batches:
        ends = np.cumsum(string_bytes(batch))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
            # a copy: Arrow's ascii_lower misreads strings whose first offset isn't 0, as casts of slices are
            yield batch if end - at == batch.num_rows else batch.take(pa.array(np.arange(at, end)))
            at = end


def string_bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of the strings and binary values of each row."""
    total = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if any(is_kind(column.type) for is_kind in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return total


def release() -> None:
    """Give back what Python's and Arrow's allocators keep: workers are used again by other stages, beside a JVM that has grown."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def leaves_no_memory(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches, with release() at its end."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def clip(value: float, least: float, most: float) -> int:
    return int(max(least, min(most, value)))


#: Bits of a filter on ids, whatever their number; 32 a row, so that it is a table of 32,768 rows at most.
FILTER_BITS = 1 << 20


def may_hold(df: DataFrame, probe: Column, ids: DataFrame, column: str, out: str) -> DataFrame:
    """df with a flag that is true for every probe among the ids, and for few others while the ids are few.

    Both are of one type, whichever. A bitmap of fixed size, joined by broadcast, so that rows which can't have a partner needn't be shuffled; an exact
    join must follow.
    """
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda c: c.bitwiseAND(31).cast("int")
    at = ids.select(spread(F.col(column)).alias("__at"))
    words = at.groupBy((F.col("__at") - F.pmod("__at", F.lit(32))).alias("__w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("__at")))).alias("__v"))
    df = df.withColumn("__p", spread(probe))
    both = df.join(F.broadcast(words), F.col("__p") - F.pmod("__p", F.lit(32)) == F.col("__w"), "left")
    held = F.call_function("shiftright", F.col("__v"), bit(F.col("__p"))).bitwiseAND(F.lit(1).cast("long")) == 1
    return both.withColumn(out, F.coalesce(held, F.lit(False))).drop("__p", "__w", "__v")
