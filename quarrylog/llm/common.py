"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, TAB, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Where it is unset, a local master gets a folder of
    this machine (driver and executors are one process) and a cluster the warehouse.
    """
    conf = spark.sparkContext.getConf()
    if base := conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if conf.get("spark.master", "local").startswith("local[") or conf.get("spark.master", "") == "local":
        return f"file://{tempfile.gettempdir()}/quarrylog-shared"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_quarrylog"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and returns what was written.

    It cuts the lineage at a point that survives the loss of executors. The shuffles of the
    write go with its end, since nothing reads them again, and do not wait for the driver's
    garbage collection. The files go by ``discard``, or when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*written: DataFrame) -> None:
    """Deletes the files of what ``materialize`` returned; nothing that is still to run may read them."""
    for df in written:
        place, files = _place(df.sparkSession, df._written)
        files.delete(place, True)
        files.cancelDeleteOnExit(place)


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words above this many bytes are hashed one by one; the others in runs of about SEGMENT bytes.
_LONG, SEGMENT = 1 << 14, 1 << 21
_BASE = _STEP


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(_LONG)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, dtype=np.uint8)
    return raw, offsets - offsets[0]


def find_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each row."""
    solid = np.zeros(len(raw) + 1, dtype=bool)
    solid[:-1] = ~_SEPARATOR[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:]
    ends = np.zeros(len(raw) + 1, dtype=bool)
    ends[1:] = solid[:-1] & (~solid[1:] | edge[1:])
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends), np.diff(np.searchsorted(starts, offsets))


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of words, with A-Z lower-cased or not. Memory is bounded by SEGMENT, whatever the texts' lengths."""
    lengths = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    for k in np.flatnonzero(lengths > _LONG):
        word = raw[starts[k] : ends[k]]
        out[k] = np.frombuffer(hashlib.blake2b((_LOWER[word] if lower else word).tobytes(), digest_size=8).digest(), dtype=np.uint64)[0]
    short = np.flatnonzero(lengths <= _LONG)
    total = np.cumsum(lengths[short])
    begin = 0
    while begin < len(short):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + SEGMENT)))
        run = short[begin:stop]
        size = lengths[run]
        first = np.zeros(len(run), dtype=np.int64)
        np.cumsum(size[:-1], out=first[1:])
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        letters = raw[np.repeat(starts[run], size) + place]
        letters = _LOWER[letters] if lower else letters
        value = (letters.astype(np.uint64) + np.uint64(1)) * _POWERS[place]
        out[run] = mix64(np.add.reduceat(value, first))
        begin = stop
    return out


def word_hashes(column, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of an Arrow string column, and the number of words of each row."""
    raw, offsets = column_bytes(column)
    starts, ends, counts = find_words(raw, offsets)
    return hash_words(raw, starts, ends, lower), counts


def slices(batch, column: str, most: int = 4 << 20):
    """Parts of an Arrow batch with about ``most`` bytes of ``column`` each; a longer row is a part of its own."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0)), dtype=np.int64)
    begin = 0
    while begin < len(size):
        stop = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + most)))
        yield batch.slice(begin, stop - begin)
        begin = stop
