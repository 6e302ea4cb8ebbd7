"""Helpers shared by the operators of this subpackage.

Text rules used everywhere: a null text is an empty text, lower-casing means
A-Z only, and words are runs of anything but the six ASCII blanks
(``[^\\x20\\x09-\\x0D]+``).  ``bytes.lower`` and ``bytes.split`` follow exactly
these rules on UTF-8.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python call holds at once; longer single texts come alone.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is the cluster's ``spark.checkpoint.dir``; only where that is unset and
    driver and executors are one process, as in tests, a temporary folder is made
    and set.  A cluster without that setting has no such folder, which is an error:
    each machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir isn't set: intermediate tables need a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Rows that go to Python at once; the default of 10,000 long texts fills the memory beside the heap.
ARROW_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ARROW_ROWS at most while the block runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of a narrow table that one file holds.
FILE_ROWS = 50_000


def files_for(rows: int) -> int:
    """Files of a narrow table of about ``rows`` rows.

    Every file costs the writer a call of its own (on local folders even a
    process), so a small result of many shuffle partitions is written as a few
    files; their number grows with the rows, not with the partitions.
    """
    return max(1, -(-rows // FILE_ROWS))


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than the reading.  ``rows``:
    about how many there are at most, where that is known.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagewright-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        (df if rows is None else df.coalesce(files_for(rows))).write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch = path
    _scratch[path] = spark
    return back


#: Tables of ``materialize`` that nobody has discarded: results may still read them.
_scratch: dict[str, SparkSession] = {}


@atexit.register
def _sweep() -> None:
    """Deletes, as the driver ends, what results have read to the last."""
    for path, spark in list(_scratch.items()):
        with suppress(Exception):  # the session may be gone
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _scratch.pop(path, None)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.scratch)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8, null as empty."""
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def _libc_trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not glibc
        return lambda _: 0


_malloc_trim = _libc_trim()


def trim() -> None:
    """Gives memory that Arrow and the C library hold for later back to the system:
    several workers share an executor's allowance with its heap."""
    pa.default_memory_pool().release_unused()
    _malloc_trim(0)


def _merged(batches: Iterable[pa.RecordBatch], at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Small batches put together up to about ``most`` bytes of column ``at``."""
    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column(at).nbytes
        if size >= most:
            yield from _one(held)
            held, size = [], 0
    yield from _one(held)


def _one(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if len(held) == 1:
        yield held[0]
    elif held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``most`` bytes or one row."""
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    at = first.schema.get_field_index(column)
    for batch in _merged(chain([first], batches), at, most):
        col = batch.column(at)
        wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
        ends = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            trim()
            begin = end


def documents_only(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator needs, under names of its own, so that
    other columns of the input, whatever they are called, can't clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def boxed(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that their names, whatever they are, can't clash."""
    return F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns)).alias(name)


def unboxed(columns: Iterable[str], name: str = "row") -> list[Column]:
    return [F.col(f"{name}.`{c}`").alias(c) for c in columns]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out, else as good as random."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
