"""Corpus-wide facts about hashed keys, asked and answered in packed rows.

Documents are written once as *chunks* (up to a few thousand rows, bounded in
bytes, bucketed by chunk so that later passes read them without a shuffle).  A pass over the chunks
sends, per chunk and key bucket, one row with the chunk's distinct keys as a
packed array; a reducer sees all rows of one bucket and answers each of them;
the answers return to their chunk.  The shuffles carry packed arrays instead of
one row per word, and a key that is in a third of all documents arrives once
per chunk, not once per occurrence.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farmspark.llm.shared import scratch, shuffle_partitions

#: rows of a chunk, as a power of two, and the longest text of which so many fit
CHUNK_BITS = 11
CHUNK_TEXT = 16 << 10
#: keys of one bucket, on average
BUCKET_KEYS = 2_000_000


def chunk_of(row, size, bits: int):
    """Chunk of a row number for a text of ``size`` bytes.

    Texts of up to CHUNK_TEXT bytes share a chunk with 2**bits rows; for every
    factor of eight in length an eighth as many do, down to one, so a chunk holds
    at most 2**bits * CHUNK_TEXT bytes or a single text.
    """
    kind = F.lit(0)
    for k in range(bits // 3 + 1):
        kind = kind + (size > CHUNK_TEXT << 3 * k).cast("int")
    chunk = F.shiftright(row, bits)
    for k in range(1, bits // 3 + 2):
        chunk = F.when(kind == k, F.shiftright(row, max(bits - 3 * k, 0))).otherwise(chunk)
    return chunk * 16 + kind


def chunk_table(docs: DataFrame, *columns, bits: int = CHUNK_BITS) -> tuple[DataFrame, Callable[[], None]]:
    """The given columns of ``docs`` (``text`` among them) with ``chunk``, written
    bucketed by chunk, and a function that drops the table and its files.

    On large input partitions more bits keep the number of files down, fewer a
    task's memory.
    """
    spark = docs.sparkSession
    row = F.monotonically_increasing_id()
    # groups of chunks of about 8,000 documents, so the tasks of a pass are alike;
    # beyond Spark's own bound a bucket holds more chunks, which pass one by one
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    buckets = min(max(shuffle_partitions(spark), math.ceil(docs.count() / 8192)), most)
    name = f"llm_chunks_{uuid.uuid4().hex}"
    path = scratch(spark, "chunks")
    (docs.select(*columns).withColumn("chunk", chunk_of(row, F.octet_length("text"), bits))
     .write.format("parquet").bucketBy(buckets, "chunk").option("path", path).saveAsTable(name))

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    return spark.table(name), drop


def bucket_count(spark, keys: int) -> int:
    return max(shuffle_partitions(spark), math.ceil(keys / BUCKET_KEYS))


def pack(a: np.ndarray) -> bytes:
    """Byte planes of ``a``: sorted keys and small counts then compress well."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(data, np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def pack_counts(a: np.ndarray) -> bytes:
    """:func:`pack` in the narrowest unsigned type that holds every count."""
    top = int(a.max()) if len(a) else 0
    size = next(n for n in (1, 2, 4, 8) if top < 1 << 8 * n)
    return bytes([size]) + pack(a.astype(f"<u{size}"))


def unpack_counts(data: bytes) -> np.ndarray:
    return unpack(data[1:], f"<u{data[0]}").astype("<i8")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each 64-bit key, from its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, slice) over ascending keys: buckets are ranges of the key."""
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), slice(cuts[b], cuts[b + 1])


def group_arrow(frame: DataFrame, key: str, f, schema: str) -> DataFrame:
    return frame.groupBy(key).applyInArrow(f, schema)


def rejoin(chunks: DataFrame, replies: DataFrame, f, schema: str) -> DataFrame:
    """``f(chunk rows, replies of that chunk)`` for every chunk."""
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(f, schema)
