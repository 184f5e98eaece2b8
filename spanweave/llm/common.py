"""What the operators of this subpackage share: shared-folder tables, size-checked joins, byte-level words, columns."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side of a join may be broadcast only if its measured size is at most this many bytes.
BROADCAST_BYTES = 24 << 20

#: A-Z as one string and a-z as one string: the only letters that contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What a word is: a run of anything but ASCII white space. bytes.split() splits at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a local one is set only where that is unset and Spark runs on one machine, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        folder = f"file://{tempfile.mkdtemp(prefix='spanweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage is cut and any executor may be lost.

    by: a column with few values, each of which gets a folder, so that reading one leaves the others alone. The shuffle files
    of the writing query go once it is done, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint behind a count of the (already written) table; beyond the limit Spark shuffles both sides instead."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; for pure ASCII texts, where lower() does just that, the faster lower() is used."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_crc(column: Column) -> Column:
    """crc32 of the id as decimal text; null ids count as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def text_keys(text_col: str, *names: str) -> tuple[Column, Column]:
    """128 bits of hash, by which a text is found again whatever its row's id; null counts as empty."""
    text, (one, two) = F.coalesce(F.col(text_col), F.lit("")), names or ("k1", "k2")
    return F.xxhash64(text).alias(one), F.xxhash64(F.lit(1), text).alias(two)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch, at most, while texts go through Python: with texts of a few KB that is a few MB at a time.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a task and its Python worker hold at a time; it changes no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker, which lives on for other tasks, gives its free memory back."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # not glibc

    return wrapped


def portions(sizes: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum up to about `most`, one row at least."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)
