"""What the text operators share: staging tables, word dictionaries, hashes."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow's own pool keeps freed memory; workers share an executor's memory, so it goes back at once.
pa.set_memory_pool(pa.system_memory_pool())

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task and share their executor's memory."""
    if _TRIM is not None:
        _TRIM(0)


_STAGED: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset and one machine runs all (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "voxelith-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; removed when the session's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(drop_staged)
    _STAGED.append((spark, path))
    return path


def drop_staged() -> None:
    """Delete the staging tables written so far."""
    while _STAGED:
        spark, path = _STAGED.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone at exit  # noqa: BLE001
            return


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for the queries that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go when it ends, as the table replaces them.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    with setting(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staging tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._staged_at
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _STAGED[:] = [x for x in _STAGED if x[1] != path]


def documents(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id and text (and `more`) alone, whatever else the input has; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs, written, with a number for each row, so that of rows that are alike one can be told from another."""
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Split at blanks: distinct words, the code of every word in order, offsets of the texts in the codes.

    The distinct words of a batch are few beside its words, so what is costly
    is done once a distinct word. The empty words between blanks stay.
    """
    if pa.types.is_large_string(texts.type) is False:
        texts = texts.cast(pa.large_string())
    lists = pc.split_pattern(texts, " ")
    encoded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def expand(codes: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, starts: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each code by its run of the pool; returns the values and the texts' new offsets."""
    n = lengths[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    first = starts[codes] - (ends - n)
    values = pool[np.repeat(first, n) + np.arange(total)]
    bounds = np.concatenate(([0], ends))
    return values, bounds[offsets]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of an Arrow array."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))
