"""What the operators share: shared work folders, size estimates, Arrow text buffers.

Every operator selects the columns it names and ignores the others, so extra
columns of an input can have any name.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: ASCII white space, the only separators of words in these operators.
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Python workers look at so many bytes of text at a time.
SLICE_BYTES = 4 << 20

#: An estimate from here on is the optimizer's word for a size that it doesn't know.
UNKNOWN = 1 << 60


try:
    LIBC = ctypes.CDLL(ctypes.util.find_library("c") or "libc.so.6")
    LIBC.malloc_trim  # noqa: B018  (another C library has none)
except (OSError, AttributeError):
    LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset and driver and executor are one process, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isDefined():
            base = own.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = "file://" + tempfile.mkdtemp(prefix="tidemill-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Shuffle files of ended jobs go once the driver has collected their handles."""
    gc.collect()
    spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of what df reads, from file sizes, without a job. Where an input has no known size (rows of the driver, RDDs), df's rows are read and their bytes counted."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if max(sizes, default=0) < UNKNOWN:
        return sum(sizes)
    types = [f.dataType for f in df.schema]
    lengths = [F.coalesce(F.octet_length(f"c{i}"), F.lit(0)).cast("long") for i, t in enumerate(types) if isinstance(t, StringType | BinaryType)]
    counted = df.toDF(*[f"c{i}" for i in range(len(types))]).agg(F.sum(reduce(add, lengths, F.lit(8 * len(types)).cast("long"))))
    return sum(n for n in sizes if n < UNKNOWN) + (counted.first()[0] or 0)


def pieces_for(df: DataFrame, mb_each: float, least: int = 1) -> int:
    """How many groups of about mb_each MB the rows of df make."""
    return max(least, -(-input_bytes(df) // int(mb_each * (1 << 20))))


def one_chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column, one text after the other, and where each begins (one more at the end); null is empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"").cast(pa.large_binary())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text is alone in its batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        lo = 0
        while lo < batch.num_rows:
            base = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    returned()


def returned() -> None:
    """What a task has freed goes back to the machine: workers live on, and executors share their memory with the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def spans_of_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and for every text the number of its first word (one more at the end)."""
    solid = ~IS_SPACE[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = solid[1:]
    edges = at[(at > 0) & (at < len(data))]
    before[edges] = False
    after[edges - 1] = False
    begin = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return begin, end, np.searchsorted(begin, at)


def encoded_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words (binary) and each word's place among them."""
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(end - begin, out=offsets[1:])
    solid = data[~IS_SPACE[data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    coded = words.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, dtype=np.int64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of lengths[i] items each, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def sums_between(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


class Memo:
    """A dictionary of bounded size: entries that were asked for lately, and those before them."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def keep(self, keys: list[bytes], values: list[bytes], longest: int = 200) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young.update((k, v) for k, v in zip(keys, values, strict=True) if len(k) < longest)
