"""What several operators here share: word rules, splits by checksum, batches of text."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.session import remove, scratch_path, scratch_scope, shuffles_removed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of text per Arrow batch. Texts may be very long, so batches are kept short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches short enough for very long texts (a larger user setting is lowered)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def _write(df: DataFrame, path: str) -> DataFrame:
    """Write and read back. The shuffle files that the write needed go with it: nothing reads them again."""
    spark = df.sparkSession
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts the lineage, work is done once."""
    return _write(df, scratch_path(df.sparkSession, name))


def only_result(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Write what ``make`` returns; all that it has written on its way is removed then."""
    path = scratch_path(spark, name)
    with scratch_scope(spark):
        return _write(make(), path)


def dropped(table: DataFrame) -> None:
    """Remove a table that ``written`` or ``only_result`` wrote."""
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        remove(table.sparkSession, folder)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def is_remainder(doc_id: Column, modulus: int, wanted: int) -> Column:
    """False for a null id."""
    return F.coalesce(remainder(doc_id, modulus) == wanted, F.lit(False))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column without copying; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    at = at[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lowered."""
    return text.translate(_LOWERED).split()


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The texts of a string column in UTF-8; a null is an empty text."""
    offsets, data = text_buffers(column)
    whole = data.tobytes()
    at = offsets.tolist()
    return (whole[a:b] for a, b in zip(at[:-1], at[1:]))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i]+lengths[i]-1 of all i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Memo(dict):
    """``memo[key]`` computes a missing value once; emptied when what it holds may pass ``room`` bytes. Long keys
    and values are not kept."""

    LONG = 512

    def __init__(self, compute, room: int = 64 << 20):
        super().__init__()
        self.compute, self.room, self.size = compute, room, 0

    def __missing__(self, key):
        value = self.compute(key)
        longest = max((len(x) for x in (key, value) if isinstance(x, (bytes, str, tuple))), default=0)
        if longest > self.LONG:
            return value
        self.size += 200 + 8 * longest
        if self.size > self.room:
            self.clear()
            self.size = 0
        self[key] = value
        return value


def released(parts: Iterator) -> Iterator:
    """Pass ``parts`` on and give freed memory back at the end: workers live on, and what one job has freed in
    them would count beside what the next one takes."""
    yield from parts
    del parts
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(work):
    """A function over batches that gives freed memory back when it is through."""

    @functools.wraps(work)
    def run(parts):
        return released(work(parts))

    return run


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in rows if b.num_rows)
