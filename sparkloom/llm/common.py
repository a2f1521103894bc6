"""What the operators of this subpackage share: word splitting, hashing, shared folders, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are split into words at a time; a longer text is split in pieces.
CHUNK = 1 << 21
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the cluster's shared one, spark.checkpoint.dir; one of our own only in local mode, and only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    return f"{folder.rstrip('/')}/sparkloom/{spark.sparkContext.applicationId}"


@lru_cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="sparkloom-")


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as a table in the shared folder, in folders by those columns: computed once, its lineage cut, safe when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: Where written() put what is still in use.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for df in tables:
        if path := _PATHS.pop(df, None):
            _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Deletes all that this application has written to the shared folder; its results can't be read afterwards."""
    _delete(spark, shared_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of df's input as the optimizer estimates them; what has no estimate counts as some for each shuffle partition."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else partitions(df.sparkSession) << 24


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(df: DataFrame, mb: int = 3) -> int:
    """Buckets for what is hashed from df's rows: some for each shuffle partition, and one for so many MB of input."""
    return max(4 * partitions(df.sparkSession), input_bytes(df) // (mb << 20), 1)


def fmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


def word_chunks(text: bytes, size: int = CHUNK) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of text in order, as lists of bounded size (a longer word stays whole)."""
    if len(text) <= size:
        yield text.split()
        return
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end + 1


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def binary(df: DataFrame, column: str = "text") -> DataFrame:
    """The text column as UTF-8 bytes; null as empty."""
    return df.withColumn(column, F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary")))


def binary_array(data: bytes, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])


def trimmed(run):
    """run for mapInArrow, whose memory goes back to the system when a task ends: workers are used again."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return whole


def blob(*arrays: np.ndarray) -> bytes:
    """Arrays compressed, byte by byte of their numbers, so that high bytes, mostly zero, stand together; unblob() gives them back."""
    import zstandard

    head = np.array([len(arrays), *(len(a) for a in arrays)], np.int32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays))


def unblob(data: bytes, *types: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    lengths, at, out = np.frombuffer(raw, np.int32, n, 4), 4 + 4 * n, []
    for length, kind in zip(lengths.tolist(), types, strict=True):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, length * size, at).reshape(size, length).T).view(kind).ravel())
        at += length * size
    return out
